"""Scans and sinks: tab-separated records, their Parquet cache, id lists, vocabularies and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entwyne import schemas
from entwyne.functions.text import id_set
from entwyne.functions.vocabulary import Vocabulary


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = schemas.RECORD) -> DataFrame:
    """All strings, no quoting, missing values empty."""
    options = {"sep": "\t", "header": True, "quote": "", "escape": "", "enforceSchema": True, "mode": "PERMISSIVE"}
    return spark.read.options(**options).schema(T.StructType([T.StructField(f.name, f.dataType) for f in schema])).csv(path).na.fill("")


def write_tsv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).options(sep="\t", header=True, quote="", escape="", emptyValue="").csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def ingest(spark: SparkSession, source: str, target: str, schema: T.StructType = schemas.RECORD) -> DataFrame:
    """The Parquet form of a TSV file; written once, read after that."""
    if not exists(spark, f"{target}/_SUCCESS"):
        read_tsv(spark, source, schema).write.mode("overwrite").option("compression", "zstd").parquet(target)
    return spark.read.parquet(target)


def load(spark: SparkSession, folder: str, split: str, source: int) -> DataFrame:
    return ingest(spark, f"{folder}/{split}_source{source}.tsv", f"{folder}/cache/{split}_source{source}")


def load_truth(spark: SparkSession, folder: str) -> DataFrame:
    return ingest(spark, f"{folder}/ground_truth.tsv", f"{folder}/cache/ground_truth", schemas.TRUTH)


def explode_truth(truth: DataFrame) -> DataFrame:
    """(source1_entity_id, cand_id); entities without matches have no row."""
    return truth.where("matched_entity_ids <> ''").select("source1_entity_id", F.explode(F.split("matched_entity_ids", ",")).alias("cand_id"))


def read_id_lists(spark: SparkSession, path: str) -> DataFrame:
    """(source1_entity_id, ids) of a list file. Of repeated ids the last row of the file wins."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    parts = F.split("value", "\t")
    rows = lines.select(F.trim(F.get(parts, F.lit(0))).alias("source1_entity_id"), id_set(F.get(parts, F.lit(1))).alias("ids"), "at")
    header = rows.agg(F.min("at").alias("first"))
    return rows.join(F.broadcast(header), F.col("at") != F.col("first")).groupBy("source1_entity_id").agg(F.max_by("ids", "at").alias("ids"))


def read_first_column(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.options(sep="\t", header=True, quote="").csv(path)
    return rows.toDF(*[f"c{i}" for i in range(len(rows.columns))]).select(F.col("c0").alias("entity_id")).distinct()


def write_ids(ids: DataFrame, path: str) -> None:
    """One id per line."""
    ids.select(F.col(ids.columns[0]).cast("string").alias("value")).write.mode("overwrite").text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("source1_entity_id"))


def match_lists(pairs: DataFrame, ids: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """One row for every entity, with its candidate ids in order; those without any have the empty string."""
    lists = pairs.groupBy("source1_entity_id").agg(F.array_join(F.array_sort(F.collect_set("cand_id")), ",").alias(name))
    return ids.select("source1_entity_id").distinct().join(lists, "source1_entity_id", "left").na.fill("", [name])


def write_submission(matches: DataFrame, candidates: DataFrame, ids: DataFrame, folder: str) -> None:
    write_tsv(match_lists(matches, ids), f"{folder}/matches", "overwrite")
    write_tsv(match_lists(candidates, ids, "candidate_entity_ids"), f"{folder}/candidates", "overwrite")


def read_vocabulary(spark: SparkSession, path: str | None) -> Vocabulary:
    """A small JSON file; defaults where there is none."""
    if path is None or not exists(spark, path):
        return Vocabulary()
    return Vocabulary.from_json("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def write_vocabulary(spark: SparkSession, vocabulary: Vocabulary, path: str) -> None:
    spark.createDataFrame([(vocabulary.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_token_stats(stats: DataFrame, path: str) -> None:
    """Token statistics (tok, keep, drop, add, df) as Parquet."""
    stats.write.mode("overwrite").parquet(path)


def write_table(rows: DataFrame, path: str, kind: str = "markdown", most: int = 10_000) -> None:
    """A small table of figures as one Markdown or CSV file in a folder; a larger one is an error."""
    if kind == "csv":
        rows.coalesce(1).write.mode("overwrite").csv(path, header=True)
        return
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report has {most} rows at most")
    cell = lambda x: "" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [rows.columns, ["-"] * len(rows.columns), *([cell(x) for x in r] for r in found)]
    text = "\n".join("|" + "|".join(x) + "|" for x in lines)
    rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_report(row: DataFrame, path: str) -> None:
    """A few rows of figures as JSON lines."""
    row.coalesce(1).write.mode("overwrite").json(path)
