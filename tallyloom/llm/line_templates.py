"""Line dedup by a log-template tree, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import let, materialise, salted_join, single_blanks, without_places

#: What stands for a variable field: a run of digits.
FIELD = "0"
#: Lines of fewer tokens have no fields but their digits: they recur as they are or not at all.
FIELD_TOKENS = 8


def masked_text(text: Column) -> Column:
    """Lower case, blanks in a line as one space, and every run of digits as one variable field."""
    return let(F.regexp_replace(F.lower(text), "[0-9]+", FIELD), single_blanks)


def document_lines(docs: DataFrame, depth: int, min_tokens: int, with_text: bool) -> DataFrame:
    """A row for each line of at least min_tokens tokens: _doc, _copy (hash of the whole text), _head
    (whether it is the first such line of its row), _at (place of the line), _leaf (hash of token count
    and leading tokens, or all tokens of a line of fewer than FIELD_TOKENS), _line (hash), _text (masked)."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def parsed(line: Column, at: Column) -> Column:
        tokens = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
        return F.when(
            (line != "") & (tokens >= min_tokens),
            F.struct(
                at.alias("_at"),
                F.xxhash64(tokens, F.when(tokens < FIELD_TOKENS, line).otherwise(F.substring_index(line, " ", depth))).alias("_leaf"),
                F.xxhash64(line).alias("_line"),
                *([line.alias("_text")] if with_text else []),
            ),
        )

    lines = F.transform(F.split(masked_text(text), "\n"), lambda x, i: let(F.trim(x), lambda t: parsed(t, i)))
    rows = docs.select(
        F.col("doc_id").alias("_doc"), F.xxhash64(text).alias("_copy"), F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("_p", "_l")
    )
    return rows.select("_doc", "_copy", (F.col("_p") == 0).alias("_head"), "_l.*")


def alike(a: Column, b: Column, similarity: float) -> Column:
    """Whether two arrays of as many tokens have at least similarity of them at the same places."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) >= similarity * F.size(a)


def template_members(texts: DataFrame, similarity: float) -> DataFrame:
    """(_leaf, _line, _template) of the lines that belong to another line's template.

    texts: _leaf, _line, _n (texts that have it), _tokens. A leaf's first template is seeded by its
    most widespread line (ties: smaller tokens); a line of the leaf belongs to it if at least
    similarity of its tokens stand at the same places, and the places that differ are its variable
    fields. The lines left seed the next template in the same way, and so on until none is left.

    The first round has one seed a leaf, as nearly all leaves need no more. Later ones look at the
    next 16, 64 and then 256 lines of each leaf at once, find the seeds among them in order, and
    give every line left to the first seed it matches: the same templates, in fewer passes.
    """
    left, found, ahead = materialise(texts, "line-texts"), [], 1
    while True:
        order = Window.partitionBy("_leaf").orderBy(F.desc("_n"), "_tokens")
        first = left.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= ahead)
        row = F.struct("_rank", F.col("_line").alias("line"), F.col("_tokens").alias("tokens"))
        first = first.groupBy("_leaf").agg(F.array_sort(F.collect_list(row)).alias("_first"))
        seeds = F.aggregate(
            "_first",
            F.filter("_first", lambda x: F.lit(False)),
            lambda have, x: F.when(F.exists(have, lambda s: alike(s["tokens"], x["tokens"], similarity)), have).otherwise(
                F.concat(have, F.array(x))
            ),
        )
        first = materialise(first.select("_leaf", seeds.alias("_seeds")), "seeds")
        match = F.filter("_seeds", lambda s: alike(s["tokens"], F.col("_tokens"), similarity))
        told = left.join(first, "_leaf").select("_leaf", "_line", "_n", "_tokens", F.get(match, F.lit(0))["line"].alias("_template"))
        told = materialise(told, "told")
        found.append(told.where(F.col("_template") != F.col("_line")).select("_leaf", "_line", "_template"))
        rest = told.where(F.col("_template").isNull()).drop("_template")
        several = rest.groupBy("_leaf").agg(F.count(F.lit(1)).alias("_variants")).where(F.col("_variants") > 1).select("_leaf")
        left = materialise(rest.join(several, "_leaf"), "left")
        if left.isEmpty():
            break
        ahead = min(256, 16 if ahead == 1 else ahead * 4)
    return reduce(DataFrame.unionByName, found)


def identity(doc: Column, copy: Column) -> Column:
    """A hash of a row's id and text, ids being null or not."""
    return F.xxhash64(doc.isNull(), doc, copy)


def recurring_templates(lines: DataFrame, depth: int, min_tokens: int, docs: DataFrame, similarity: float, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """(_leaf, _line, _owner) of the lines whose template is in at least min_docs distinct texts, and
    (_leaf, _line, _weight), the rows of every line.

    Templates are those of template_members. _owner is the text (hash) of the smallest doc_id that
    has the template.
    """
    by_text = lines.groupBy("_leaf", "_line", "_copy").agg(F.min("_doc").alias("_doc"), F.count(F.lit(1)).alias("_rows"))
    by_line = by_text.groupBy("_leaf", "_line").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("_doc", "_copy")).alias("_first"), F.sum("_rows").alias("_weight")
    )
    by_line = materialise(by_line, "lines")
    leaves = by_line.groupBy("_leaf").agg(F.count(F.lit(1)).alias("_variants")).where(F.col("_variants") > 1).select("_leaf")
    varied = materialise(by_line.join(leaves, "_leaf"), "varied")
    wanted = varied.select("_leaf", "_line", identity(F.col("_first")["_doc"], F.col("_first")["_copy"]).alias("_id"))
    text = F.coalesce(F.col("text"), F.lit(""))
    owners = docs.select("doc_id", "text", identity(F.col("doc_id"), F.xxhash64(text)).alias("_id")).join(
        materialise(wanted.select("_id").distinct(), "owners").hint("merge"), "_id", "left_semi"
    )
    texts = (
        document_lines(owners, depth, min_tokens, True)
        .withColumn("_id", identity(F.col("_doc"), F.col("_copy")))
        .join(wanted, ["_leaf", "_line", "_id"], "left_semi")
        .groupBy("_leaf", "_line")
        .agg(F.first("_text").alias("_text"))
    )
    texts = varied.join(texts, ["_leaf", "_line"]).select("_leaf", "_line", "_n", F.split("_text", " ").alias("_tokens"))
    members = template_members(texts, similarity)
    grouped = by_line.join(members, ["_leaf", "_line"], "left").withColumn("_template", F.coalesce("_template", "_line"))
    totals = (
        grouped.groupBy("_leaf", "_template")
        .agg(F.sum("_n").alias("_texts"), F.max("_n").alias("_least"), F.min("_first").alias("_first"))
        .where(F.col("_texts") >= min_docs)
        .select("_leaf", "_template", "_least", F.col("_first")["_copy"].alias("_owner"))
    )
    if min_docs > 2:
        # A text with several lines of a template counts once. (A template of one text only drops nothing, as that text owns it.)
        totals = materialise(totals, "totals")
        unsure = totals.where(F.col("_least") < min_docs).select("_leaf", "_template")
        unsure = grouped.select("_leaf", "_line", "_template").join(unsure, ["_leaf", "_template"])
        counts = by_text.join(unsure, ["_leaf", "_line"]).select("_leaf", "_template", "_copy").distinct()
        counts = counts.groupBy("_leaf", "_template").agg(F.count(F.lit(1)).alias("_sure"))
        totals = totals.join(counts, ["_leaf", "_template"], "left").where(F.coalesce("_sure", "_least") >= min_docs)
    found = grouped.select("_leaf", "_line", "_template").join(totals, ["_leaf", "_template"]).select("_leaf", "_line", "_owner")
    return found, by_line.select("_leaf", "_line", "_weight")


def drop_recurring_lines(
    docs: DataFrame, depth: int = 4, min_tokens: int = 8, similarity: float = 0.6, min_docs: int = 2
) -> DataFrame:
    """Drop lines whose template recurs across documents.

    docs: doc_id and text, and any further columns, which are kept as they are (but for those with the
    names of the results). A tree of fixed depth parses each line of
    at least min_tokens tokens: token count, then the first depth tokens; runs of digits are variable
    fields, and so are the places in which lines of one template differ. Lines of fewer than
    FIELD_TOKENS tokens are of one template only if they are equal but for digits, as a few words in
    common say little there. A leaf holds any number of templates.
    A template found in at least min_docs distinct texts is dropped everywhere but in the text that
    owns it (that of the smallest doc_id), so no passage is lost altogether; equal texts count once
    and share what they own, hence exact copies are left to the near-duplicate operator.

    Returns docs with text cut down, and n_lines, n_dropped (int) and emptied (boolean: the text
    had a word and no line with a word is left). Null text stays null with no lines; a null doc_id
    sorts first; repeated rows are treated alike; an empty table gives no rows; lines of fewer than
    min_tokens tokens are never dropped (with 1, every line with a word is looked at).

    Lines meet by 64-bit hashes summed before each exchange. Lines and texts with more than 1 / 500 of
    all rows are dealt over salts where they meet what is dropped. The texts move by merge joins at
    every size, twice at most. Only the lines of leaves with variants are compared as text, each with
    its leaf's seeds.
    """
    lines = materialise(document_lines(docs, depth, min_tokens, False), "line-hashes")
    found, weights = recurring_templates(lines, depth, min_tokens, docs, similarity, min_docs)
    found = materialise(found, "recurring")
    recurring_weights = weights.join(found, ["_leaf", "_line"], "left_semi")
    drops = (
        salted_join(lines.drop("_head"), found, ["_leaf", "_line"], recurring_weights, F.xxhash64("_copy", "_at"))
        .where(F.col("_owner") != F.col("_copy"))
        .groupBy("_copy")
        .agg(F.collect_set("_at").alias("_drops"))
    )
    drops = materialise(drops, "drops")
    copies = lines.where("_head").groupBy("_copy").agg(F.count(F.lit(1)).alias("_weight"))
    text = F.coalesce(F.col("text"), F.lit(""))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "emptied")]
    rows = docs.select(F.struct(*columns).alias("_row"), F.xxhash64(text).alias("_copy"))
    before, gone = F.col("_row")["text"], F.col("_drops")
    joined = salted_join(rows, drops, ["_copy"], copies, F.xxhash64(F.col("_row")["doc_id"], F.lit(7)), "left").withColumn(
        "_text", F.when(gone.isNull(), before).otherwise(F.array_join(without_places(F.split(before, "\n"), gone), "\n"))
    )
    return joined.select(
        *(F.col("_text").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in columns),
        F.when(before.isNull(), 0).otherwise(F.size(F.split(before, "\n"))).alias("n_lines"),
        F.coalesce(F.when(gone.isNotNull(), F.size(gone)), F.lit(0)).alias("n_dropped"),
        F.coalesce(gone.isNotNull() & ~F.col("_text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("emptied"),
    )
