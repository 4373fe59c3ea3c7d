"""Folds of entities, stratified by country and number of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEED, N_DEV, N_VAL = 20260925, 40_000, 60_000


def assign_folds(entities: DataFrame, truth: DataFrame, n_dev: int = N_DEV, n_val: int = N_VAL, seed: int = SEED) -> DataFrame:
    """``entities`` (source1_entity_id, ctry) with n_match, bucket and fold.

    Within each stratum entities are ranked by a digest; the first share goes to dev, the next to val, the rest to train.
    A stratum may be most of all entities, so ranks are made within the digests of one beginning, of 4,096, and moved by the
    running sums of their sizes.
    """
    counts = truth.groupBy("source1_entity_id").agg(F.count_distinct("cand_id").alias("n_match"))
    rows = entities.select("source1_entity_id", "ctry").join(counts, "source1_entity_id", "left").na.fill(0, ["n_match"])
    n = F.col("n_match")
    bucket = F.when(n == 0, "0").when(n <= 2, "1-2").when(n <= 4, "3-4").otherwise("5+")
    rows = rows.withColumn("bucket", bucket).withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), "source1_entity_id")))
    rows = rows.withColumn("_part", F.substring("_h", 1, 3))
    own, parts = ["ctry", "bucket", "_part"], Window.partitionBy("ctry", "bucket")
    sizes = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(*own, F.coalesce(F.sum("_n").over(parts.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(parts).alias("_all"))
    rank = F.row_number().over(Window.partitionBy(*own).orderBy("_h", "source1_entity_id"))
    rows = rows.withColumn("_rank", rank).join(sizes.withColumnsRenamed({"ctry": "_c", "bucket": "_b", "_part": "_p"}), F.col("ctry").eqNullSafe(F.col("_c")) & (F.col("bucket") == F.col("_b")) & (F.col("_part") == F.col("_p")))
    place = (F.col("_rank") - 1 + F.col("_before")) / F.col("_all")
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    dev, val = F.lit(float(n_dev)) / F.col("_total"), F.lit(float(n_dev + n_val)) / F.col("_total")
    placed = rows.withColumn("_place", place).join(F.broadcast(total), F.lit(True))
    return placed.withColumn("fold", F.when(F.col("_place") < dev, "dev").when(F.col("_place") < val, "val").otherwise("train")).select(*entities.select("source1_entity_id", "ctry").columns, "n_match", "bucket", "fold")


def summary(folds: DataFrame) -> DataFrame:
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("n_match") == 0, 1.0).otherwise(0.0)).alias("singleton_rate"), F.avg("n_match").alias("mean_matches"))


def fold_truth(truth: DataFrame, folds: DataFrame, fold: str) -> DataFrame:
    """The true pairs of one fold's entities."""
    return truth.join(folds.where(F.col("fold") == fold).select("source1_entity_id"), "source1_entity_id", "left_semi")


def subset(records: DataFrame, n: int, seed: int = 11, key: str = "entity_id") -> DataFrame:
    """``n`` records by a seeded digest of their key: the same ones whatever the partitioning."""
    return records.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key))), key).limit(n)


def country_fold(folds: DataFrame, name: str) -> DataFrame:
    """One country held out as a whole."""
    return folds.where(F.col("ctry") == name).select("source1_entity_id")


def sample(records: DataFrame, truth: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """A share of the S1 entities, all their matches and the same share of pool records that match nothing."""
    chance = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "entity_id")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    is_s1, taken = F.col("entity_id").startswith("S1-"), chance < share
    s1 = records.where(is_s1 & taken)
    own = truth.join(s1.select(F.col("entity_id").alias("source1_entity_id")), "source1_entity_id", "left_semi").select(F.col("cand_id").alias("entity_id")).distinct()
    pool = records.where(~is_s1)
    orphans = pool.join(truth.select(F.col("cand_id").alias("entity_id")).distinct(), "entity_id", "left_anti").where(taken)
    return s1.unionByName(pool.join(own, "entity_id", "left_semi")).unionByName(orphans)
