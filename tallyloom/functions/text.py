"""Text functions: tags, comments, cases, macros, brackets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_tags(html: Column) -> Column:
    """Text outside tags, each piece trimmed, put together without a separator."""
    return F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", "\x00"), r"\s*\x00\s*", "")


def tokens(text: Column, lower: bool = True) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(r"(\w+)"), 1)


def remove_comments(text: Column, mark: str = "") -> Column:
    """Without what follows an unescaped per-cent sign up to and with the line's end."""
    return F.regexp_replace(text, r"(?<!\\)%[^\n]*\n?", mark)


def to_camel_case(name: Column) -> Column:
    """snake_case as camelCase."""
    parts = F.split(name, "_")
    rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p))))
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


def to_snake_case(name: Column) -> Column:
    """camelCase as snake_case."""
    return F.lower(F.regexp_replace(name, r"(?<=[a-z0-9])([A-Z])", "_$1"))


def bracket_content(text: str, depth: int = 1, left: str = "(", right: str = ")") -> tuple[str, str, str] | None:
    """(before, inside, after) of the first balanced pair of brackets at a depth."""
    level, start = 0, -1
    for i, c in enumerate(text):
        if c == left:
            level += 1
            if level == depth and start < 0:
                start = i + 1
        elif c == right:
            if level == depth and start >= 0:
                return text[: start - 1], text[start:i], text[i + 1 :]
            level -= 1
    return None


def remove_brackets(text: str, left: str = "{", right: str = "}") -> str:
    """Without every balanced pair of brackets; what is inside stays."""
    opened, drop = [], set()
    for i, c in enumerate(text):
        if c == left:
            opened.append(i)
        elif c == right and opened:
            drop |= {opened.pop(), i}
    return "".join(c for i, c in enumerate(text) if i not in drop)
