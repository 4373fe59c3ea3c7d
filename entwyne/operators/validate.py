"""Rules that an output must keep, as one table of offences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_offences(lines: DataFrame, column: str, s1: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(file, rule, offender) for a list file given as (at, value) lines, the first being the header.

    Rules: header, tab, duplicate row, repeated id, own source, prefix, unknown id (with ``known``), missing, extra.
    """
    tag = lambda df, rule, offender: df.select(F.lit(column).alias("file"), F.lit(rule).alias("rule"), offender.cast("string").alias("offender"))
    head = lines.agg(F.min("at").alias("first"))
    numbered = lines.join(F.broadcast(head), F.lit(True))
    bad_head = numbered.where((F.col("at") == F.col("first")) & (F.rtrim("value") != f"source1_entity_id\t{column}"))
    body = numbered.where((F.col("at") != F.col("first")) & (F.trim("value") != ""))
    parts = F.split("value", "\t")
    rows = body.where(F.size(parts) == 2).select(F.trim(F.get(parts, F.lit(0))).alias("id"), F.filter(F.transform(F.split(F.get(parts, F.lit(1)), ","), lambda t: F.trim(t)), lambda t: t != "").alias("ids"))
    each = rows.select("id", F.explode("ids").alias("cand_id"))
    own = s1.select(F.col(s1.columns[0]).alias("id")).distinct()
    found = [
        tag(bad_head, "header", F.col("value")), tag(body.where(F.size(parts) != 2), "tab", F.col("value")),
        tag(rows.groupBy("id").count().where("count > 1"), "duplicate row", F.col("id")),
        tag(rows.where(F.size(F.array_distinct("ids")) < F.size("ids")), "repeated id", F.col("id")),
        tag(each.where(F.col("cand_id").startswith("S1-")), "own source", F.col("cand_id")),
        tag(each.where(~F.col("cand_id").rlike("^S[123]-")), "prefix", F.col("cand_id")),
        tag(own.join(rows, "id", "left_anti"), "missing", F.col("id")), tag(rows.select("id").distinct().join(own, "id", "left_anti"), "extra", F.col("id")),
    ]
    if known is not None:
        pool = known.select(F.col(known.columns[0]).alias("cand_id")).distinct()
        found.append(tag(each.select("cand_id").distinct().join(pool, "cand_id", "left_anti"), "unknown id", F.col("cand_id")))
    return reduce(DataFrame.unionByName, found)


def subset_offences(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """A warning for each match that is no candidate; both are pairs."""
    lost = matches.join(candidates, ["source1_entity_id", "cand_id"], "left_anti")
    return lost.select(F.lit("matched_entity_ids").alias("file"), F.lit("not a candidate").alias("rule"), F.concat_ws(" ", "source1_entity_id", "cand_id").alias("offender"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), "value")
