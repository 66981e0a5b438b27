"""Quality rules by the frequency of lines across the documents of a host, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import has_word, let, materialise, salted_join, single_blanks, without_places, words_of

#: Symbols that the base rules count (fixed by the contract).
SYMBOLS = "#*$%&|<>"
#: Words in a window of the repetition rule.
WINDOW = 8


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by windows that a text has twice or more, the first ones included.

    Windows are compared by a 64-bit hash. Texts without a repeated window, nearly all, stop at a
    comparison of two counts; for the others the windows are sorted, and the covered words are
    added up along the repeated ones' places.
    """

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def along(s: Column) -> Column:
            again = F.filter(
                s,
                lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))),
            )
            places = F.array_sort(F.transform(again, lambda x: x["i"]))
            start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(
                places,
                start,
                lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(window), p - a["last"])).alias("n")),
                lambda a: a["n"],
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(placed, along))

    def of(w: Column) -> Column:
        """Every word is hashed once, and a window from its words' hashes."""

        def windows(h: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(window))))

        hashes = let(F.transform(w, lambda x: F.xxhash64(x)), windows)
        return F.when(F.size(w) < window + 1, F.lit(0)).otherwise(let(hashes, covered))

    return let(words, of)


def base_columns(text: Column) -> dict[str, Column]:
    """n_symbols, n_dup_lines and _words (n, chars and again: n_words, word_chars and n_repeat_words) of
    a text; null has none of each."""
    text = F.coalesce(text, F.lit(""))
    worded = F.filter(F.split(text, "\n"), has_word)
    return {
        "n_symbols": F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"),
        "n_dup_lines": let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "_words": let(
            words_of(text),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n"),
                F.length(F.array_join(w, "")).cast("long").alias("chars"),
                repeated_words(w).cast("long").alias("again"),
            ),
        ),
    }


def normal_lines(text: Column) -> Column:
    """Array of (hash, words, place) of the lines with a word: lower case, digits as 0, blanks as one space, trimmed."""
    plain = let(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[1-9]", "0"), single_blanks)
    lines = F.transform(F.split(plain, "\n"), lambda x, i: F.struct(F.trim(x).alias("x"), i.alias("at")))
    return F.transform(
        F.filter(lines, lambda s: s["x"] != ""),
        lambda s: F.struct(
            F.xxhash64(s["x"]).alias("h"),
            (F.length(s["x"]) - F.length(F.replace(s["x"], F.lit(" "), F.lit(""))) + 1).alias("w"),
            s["at"].alias("at"),
        ),
    )


def without_lines(text: Column, places: Column) -> Column:
    """text without the lines at these places (from 0)."""
    return F.array_join(without_places(F.split(text, "\n"), places), "\n")


def rule_documents(
    docs: DataFrame,
    max_share: float = 0.1,
    min_docs: int = 20,
    min_left: float = 0.3,
    min_words: int = 20,
    max_repeat: int = 30,
    carry: tuple[str, ...] = (),
    with_places: bool = False,
) -> DataFrame:
    """Base rules and cross-document line frequency for every document.

    docs: doc_id, text and source (the host); other columns are ignored. A line (normalised) is
    over the limit if, among the distinct texts of its host, at least min_docs and more than
    max_share of them have it. Such lines are to be removed (n_removed_words; with_places gives their
    places, for without_lines); a document of which less than min_left of the words remain is
    depleted. kept: neither base_failed nor depleted.

    Equal texts count once a host, so copies do not push their own lines over the limit. Returns a
    row for each row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, n_removed_words, depleted, with_places removed_lines (places from 0, empty if
    none), and the columns named in carry. Null or empty text has no words and fails the
    base; a null host is a host of its own; an empty table gives no rows.

    The text is read once; what is shuffled are line hashes, summed before the exchange. The lines
    over the limit of one host are at most (mean distinct lines of its documents) / max_share, so
    they travel as one array a host; the documents of a hot host are dealt over salts to meet it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        *carry,
        F.coalesce(F.concat(F.lit("h"), F.col("source").cast("string")), F.lit("")).alias("_host"),
        F.xxhash64(text).alias("_copy"),
        *(c.alias(k) for k, c in base_columns(text).items()),
        normal_lines(text).alias("_lines"),
    )
    rows = materialise(rows, "line-frequency")
    hosts = rows.select("_host", "_copy").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_docs"))
    frequent = (
        rows.select("_host", "_copy", F.explode(F.array_distinct(F.transform("_lines", lambda x: x["h"]))).alias("_h"))
        .groupBy("_host", "_h", "_copy")
        .agg(F.lit(1).alias("_one"))
        .groupBy("_host", "_h")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= min_docs)
    )
    over = (
        frequent.join(hosts, "_host")
        .where(F.col("_n") > F.col("_docs") * max_share)
        .groupBy("_host")
        .agg(F.collect_list("_h").alias("_over"))
    )
    none = F.array().cast(rows.schema["_lines"].dataType)
    found = F.array_intersect(F.transform("_lines", lambda x: x["h"]), F.col("_over"))
    gone = let(found, lambda hit: F.when(F.size(hit) > 0, F.filter("_lines", lambda x: F.array_contains(hit, x["h"]))).otherwise(none))
    gone = F.when(F.col("_over").isNull(), none).otherwise(gone)
    removed = F.aggregate("_gone", F.lit(0).cast("long"), lambda a, x: a + x["w"].cast("long"))
    n, again = F.col("_words")["n"], F.col("_words")["again"]
    failed = (n < min_words) | (again * 100 > n * max_repeat)
    sizes = rows.groupBy("_host").agg(F.count(F.lit(1)).alias("_weight"))
    return (
        salted_join(rows, over, ["_host"], sizes, F.xxhash64("doc_id", "_copy"), "left", merge=False)
        .withColumn("_gone", gone)
        .withColumn("n_removed_words", removed)
        .withColumn("depleted", (n - F.col("n_removed_words")) < n * min_left)
        .select(
            "doc_id",
            n.alias("n_words"),
            F.col("_words")["chars"].alias("word_chars"),
            "n_symbols",
            "n_dup_lines",
            again.alias("n_repeat_words"),
            failed.alias("base_failed"),
            (~failed & ~F.col("depleted")).alias("kept"),
            "n_removed_words",
            "depleted",
            *([F.transform("_gone", lambda x: x["at"]).alias("removed_lines")] if with_places else []),
            *carry,
        )
    )
