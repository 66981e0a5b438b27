"""Macros of one source text: definitions, expansion with balanced arguments, clean-up. Small helpers that
run inside tasks, a text at a time."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

#: Expansions in one text after which its macros are taken to go round in circles.
MOST = 1_000_000
NAME = re.compile(r"\\([A-Za-z]+)")
#: Stands behind a name until all is expanded; texts themselves have none.
END = "\x00"
DEFINING = ("newcommand", "renewcommand", "providecommand", "def")


@dataclass(frozen=True)
class Macro:
    name: str
    arguments: int
    body: str
    first: str | None = None  # what the first argument is if it is left out in brackets

    def filled(self, given: list[str]) -> str:
        """The body with its arguments; one that ends with a name is closed by END, so no letter joins it."""
        given = [g + END if re.search(r"\\[A-Za-z]+$", g) else g for g in given]
        return re.sub(r"#([1-9])", lambda m: given[int(m[1]) - 1] if int(m[1]) <= len(given) else m[0], self.body)


def balanced(text: str, at: int, left: str = "{", right: str = "}") -> int:
    """The place behind the bracket that closes the one at a place, past escaped ones; -1 if none does."""
    level = 0
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 1
        elif c == left:
            level += 1
        elif c == right:
            level -= 1
            if not level:
                return at + 1
        at += 1
    return -1


def blanks(text: str, at: int) -> int:
    while at < len(text) and (text[at].isspace() or text[at] == END):
        at += 1
    return at


def argument(text: str, at: int, left: str = "{", right: str = "}") -> tuple[str, int] | None:
    """(what the next brackets hold, the place behind them), or None if the text goes on with something else."""
    at = blanks(text, at)
    if text[at : at + 1] != left:
        return None
    end = balanced(text, at, left, right)
    return (text[at + 1 : end - 1], end) if end >= 0 else None


def definition(text: str, at: int) -> tuple[Macro, int] | None:
    """The definition that begins at a place with one of DEFINING, and the place behind it."""
    begun = NAME.match(text, at)
    if not begun or begun[1] not in DEFINING:
        return None
    at = begun.end()
    if begun[1] == "def":
        at = blanks(text, at)
        named = NAME.match(text, at)
        if not named:
            return None
        body_at = text.find("{", named.end())
        marks = re.fullmatch(r"\s*((?:#[1-9])*)\s*", text[named.end() : body_at]) if body_at >= 0 else None
        body = argument(text, body_at) if marks else None
        return (Macro(named[1], len(marks[1]) // 2, body[0]), body[1]) if body else None
    at += text[at : at + 1] == "*"
    name = argument(text, at)
    if name is None:
        named = NAME.match(text, blanks(text, at))
        name = (named[0], named.end()) if named else None
    if name is None or not NAME.fullmatch(name[0].strip()):
        return None
    at, count, first = name[1], 0, None
    if number := argument(text, at, "[", "]"):
        if not number[0].strip().isdigit():
            return None
        count, at = int(number[0]), number[1]
        if default := argument(text, at, "[", "]"):
            first, at = default
    body = argument(text, at)
    return (Macro(name[0].strip()[1:], count, body[0], first), body[1]) if body else None


def definitions(text: str) -> list[Macro]:
    """All definitions of a text, in order; those inside others' bodies are theirs."""
    out, at = [], 0
    while m := NAME.search(text, at):
        got = definition(text, m.start())
        if got:
            out.append(got[0])
        at = got[1] if got else m.end()
    return out


def expanded(text: str, names: Iterable[str] | None = None, known: Iterable[Macro] = (), keep: bool = True) -> str:
    """text with the uses of its macros, or of those named, filled in, from left to right.

    A use takes the definition that stands before it last; known are those from elsewhere. What a
    macro gives is expanded in turn, its arguments with it. Definitions stay where they are if keep,
    else those of expanded macros go. A use that lacks arguments stays as it is.
    """
    wanted = None if names is None else set(names)
    table = {m.name: m for m in known if wanted is None or m.name in wanted}
    out: list[str] = []
    frames: list[tuple[str, int]] = [(text, 0)]
    made = 0
    while frames:
        text, at = frames.pop()
        m = NAME.search(text, at)
        if not m:
            out.append(text[at:])
            continue
        out.append(text[at : m.start()])
        if got := definition(text, m.start()):
            macro, end = got
            mine = wanted is None or macro.name in wanted
            if mine:
                table[macro.name] = macro
            if keep or not mine:
                out.append(text[m.start() : end])
            elif not keep and text[end : end + 1] == "\n":
                end += 1
            frames.append((text, end))
            continue
        macro = table.get(m[1])
        if macro is None:
            out.append(m[0])
            frames.append((text, m.end()))
            continue
        given, end = [], m.end()
        if macro.first is not None:
            optional = argument(text, end, "[", "]")
            given, end = ([optional[0]], optional[1]) if optional else ([macro.first], end)
        while len(given) < macro.arguments and (got := argument(text, end)):
            given.append(got[0])
            end = got[1]
        if len(given) < macro.arguments:
            if frames:  # its arguments may follow what it came from
                below, place = frames.pop()
                frames.append((text[m.start() :] + below[place:], 0))
                continue
            out.append(m[0])
            frames.append((text, m.end()))
            continue
        made += 1
        if made > MOST:
            raise ValueError(f"\\{m[1]} goes round in circles")
        frames += [(text, end), (macro.filled(given), 0)]
    return "".join(out).replace(END, "")


def without_unused(text: str) -> str:
    """text without the definitions of macros that nothing else uses, until all that are left are used."""
    while True:
        spans, at = [], 0
        while m := NAME.search(text, at):
            got = definition(text, m.start())
            if got:
                spans.append((m.start(), got[1], got[0].name))
            at = got[1] if got else m.end()
        uses: dict[str, int] = {}
        for name in NAME.findall(text):
            uses[name] = uses.get(name, 0) + 1
        defined: dict[str, int] = {}
        for *_, name in spans:
            defined[name] = defined.get(name, 0) + 1
        gone = [s for s in spans if uses[s[2]] <= defined[s[2]]]
        if not gone:
            return text
        kept, at = [], 0
        for a, b, _ in gone:
            kept.append(text[at:a])
            at = b + (text[b : b + 1] == "\n")
        text = "".join(kept) + text[at:]


def figure_files(text: str) -> list[tuple[str, str]]:
    """(label, image file) of each figure that has both."""
    out = []
    for block in re.findall(r"\\begin\{figure\*?\}(.*?)\\end\{figure\*?\}", text, re.S):
        image = re.search(r"\\includegraphics\s*(?:\[[^\]]*\])?\s*\{([^}]*)\}", block)
        label = re.search(r"\\label\s*\{([^}]*)\}", block)
        if image and label:
            out.append((label[1].strip(), image[1].strip()))
    return out


def renamed_figures(text: str, numbers: Mapping[str, str], folder: str = "") -> tuple[str, list[tuple[str, str]]]:
    """(text, [(old file, new file)]): images of numbered figures are called fig<number> with their ending."""
    moves = []
    for label, image in figure_files(text):
        if label in numbers:
            ending = re.search(r"\.\w+$", image)
            new = f"{folder}fig{numbers[label]}{ending[0] if ending else ''}"
            text = re.sub(r"(\\includegraphics\s*(?:\[[^\]]*\])?\s*\{\s*)" + re.escape(image) + r"(\s*\})", lambda m, new=new: m[1] + new + m[2], text)
            moves.append((image, new))
    return text, moves
