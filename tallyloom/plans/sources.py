"""Queries of source trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import flattening
from tallyloom.plans.registry import Catalogue
from tallyloom.plans.session import table

catalogue = Catalogue()
query = catalogue.query


@query("""WITH t AS (SELECT conv_id, count(*) AS n, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS t FROM conversations GROUP BY 1)
  SELECT CAST(conv_id AS VARCHAR) AS path, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5, CAST(n AS BIGINT) AS n_includes FROM t""")
def flattened_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as source trees: a file for each turn, and one that includes them in order and says how a role is told."""
    turns = table(spark, sf_dir, "conversations")
    path = F.concat_ws("/", "conv_id", "turn")
    own = turns.select(path.alias("path"), F.concat(F.lit("\\say{"), "role", F.lit("} "), F.coalesce("text", F.lit(""))).alias("text"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda t: F.concat(F.lit("\\input{"), F.col("conv_id"), F.lit("/"), t, F.lit("}"))), "\n")
    mains = turns.groupBy("conv_id").agg(listed.alias("_t")).select(F.col("conv_id").cast("string").alias("path"), F.concat(F.lit("\\newcommand{\\say}[1]{#1:}\n"), "_t").alias("text"))
    made = flattening.flatten(own.unionByName(mains), mains, names=None, comments=True, keep=False)
    return made.select("path", F.length("text").cast("long").alias("n_chars"), F.md5(F.encode("text", "UTF-8")).alias("text_md5"), "n_includes")
