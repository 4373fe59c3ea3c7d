"""Blocking: candidate pairs from shared keys.

Records of both sides become rows (ctry, key, id); a key that too many pool records hold is dropped before the join, so
the join's size is bounded by query keys times the posting cap. All joins and counts carry the country, so there is no
loop over countries. Keys are tagged strings, equal only if what they stand for is equal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from entwyne.functions.text import tokens


@dataclass(frozen=True)
class BlockingConfig:
    """Families: b1 compact name, b2 its consonants, b3 rare name tokens, b4 rare name token with number, b5 number with
    rare address token, b6 first eight letters, b7 rarest name with rarest address token (only together with b5)."""

    rare_df_max: int = 4000
    max_posting: int = 300
    max_cand: int = 0
    b4_tokens: int = 2
    b5_tokens: int = 2
    max_nums: int = 3
    families: frozenset[str] = frozenset({"b1", "b2", "b3", "b4", "b5", "b6", "b7"})


def token_frequency(pool: DataFrame) -> DataFrame:
    """(ctry, tok, df): occurrences in nm_core and ad_alpha of the pool, counted together."""
    both = F.concat(tokens(F.col("nm_core")), tokens(F.col("ad_alpha")))
    return pool.select("ctry", F.explode(both).alias("tok")).groupBy("ctry", "tok").agg(F.count(F.lit(1)).alias("df"))


def _with_frequencies(side: DataFrame, frequency: DataFrame) -> DataFrame:
    """One row per record with its distinct tokens as sorted (df, tok) arrays; unseen tokens have df 0."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.array_distinct(tokens(F.col(c))).alias("toks")) for f, c in (("n", "nm_core"), ("a", "ad_alpha"))])
    long = side.select("entity_id", "ctry", F.explode(fields).alias("x")).select("entity_id", "ctry", "x.field", F.explode("x.toks").alias("tok"))
    rated = long.join(frequency, ["ctry", "tok"], "left").select("entity_id", "field", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "tok").alias("t"))
    grouped = rated.groupBy("entity_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("field") == "n", F.col("t")))).alias("names"),
        F.array_sort(F.collect_list(F.when(F.col("field") == "a", F.col("t")))).alias("addresses"),
    )
    return side.join(grouped, "entity_id", "left")


def _tagged(tag: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(f"{tag}:"), v))


def _one(tag: str, value: Column, good: Column) -> Column:
    return F.when(good, F.array(F.concat(F.lit(f"{tag}:"), value)))


def _crossed(left: Column, right: Column, between: str) -> Column:
    return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.concat(a, F.lit(between), b))))


def keys(side: DataFrame, frequency: DataFrame, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    """(ctry, key, entity_id), distinct. Within a record everything is array work; only records that repeat an id need the last step."""
    rows = _with_frequencies(side, frequency)
    rare = lambda field, n: F.transform(F.slice(F.coalesce(F.col(field), F.array().cast("array<struct<df:bigint,tok:string>>")), 1, n), lambda t: t["tok"])
    numbers = F.slice(F.array_distinct(tokens(F.col("ad_num"))), 1, config.max_nums)
    common = F.transform(F.filter(F.coalesce(F.col("names"), F.array().cast("array<struct<df:bigint,tok:string>>")), lambda t: t["df"] <= config.rare_df_max), lambda t: t["tok"])
    compact, skel = F.col("nm_compact"), F.col("nm_skel")
    made = {
        "b1": _one("1", compact, compact != ""),
        "b2": _one("2", skel, F.length(skel) >= 4),
        "b6": _one("6", F.substring(compact, 1, 8), F.length(compact) >= 8),
        "b3": _tagged("3", common),
        "b4": _tagged("4", _crossed(rare("names", config.b4_tokens), numbers, "|")),
        "b5": _tagged("5", _crossed(numbers, rare("addresses", config.b5_tokens), "|")),
        "b7": _tagged("7", _crossed(rare("names", 1), rare("addresses", 1), "~")),
    }
    on = [k for k in made if k in config.families and (k != "b7" or "b5" in config.families)]
    none = F.array().cast("array<string>")
    every = F.array_distinct(F.flatten(F.array(*[F.coalesce(made[k], none) for k in on]))) if on else none
    return rows.select("ctry", F.explode(every).alias("key"), "entity_id").distinct()


def candidates(queries: DataFrame, pool: DataFrame, config: BlockingConfig = BlockingConfig(), frequency: DataFrame | None = None) -> DataFrame:
    """(source1_entity_id, cand_id, n_keys): pairs that share a key few enough pool records hold."""
    frequency = token_frequency(pool) if frequency is None else frequency
    pool_keys = keys(pool, frequency, config).withColumnRenamed("entity_id", "cand_id")
    rare = pool_keys.groupBy("ctry", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= config.max_posting).select("ctry", "key")
    kept = pool_keys.join(rare, ["ctry", "key"], "left_semi")
    asked = keys(queries, frequency, config).withColumnRenamed("entity_id", "source1_entity_id")
    pairs = asked.join(kept, ["ctry", "key"]).groupBy("source1_entity_id", "cand_id").agg(F.count(F.lit(1)).cast("int").alias("n_keys"))
    return top(pairs, F.col("n_keys"), config.max_cand) if config.max_cand else pairs


def top(pairs: DataFrame, score: Column, k: int) -> DataFrame:
    """The k best candidates of each entity; equal scores go by candidate id."""
    order = Window.partitionBy("source1_entity_id").orderBy(score.desc(), F.col("cand_id").asc())
    return pairs.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def evaluate(pairs: DataFrame, truth: DataFrame, ids: DataFrame, n_pool: int) -> DataFrame:
    """One row: how much of the truth the candidates hold and what they cost. ``truth`` is (source1_entity_id, cand_id)."""
    hit = truth.join(pairs.select("source1_entity_id", "cand_id", F.lit(1).alias("hit")), ["source1_entity_id", "cand_id"], "left")
    captured = hit.groupBy("source1_entity_id").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("got"))
    counts = pairs.groupBy("source1_entity_id").agg(F.count(F.lit(1)).alias("n"))
    rows = ids.select("source1_entity_id").join(captured, "source1_entity_id", "left").join(counts, "source1_entity_id", "left").na.fill(0, ["total", "got", "n"])
    recall = F.col("got") / F.col("total")
    ceiling = F.when(F.col("total") == 0, F.lit(1.0)).when(F.col("got") == 0, F.lit(0.0)).otherwise(1.25 * recall / (0.25 + recall))
    real = F.col("total") > 0
    s2 = hit.agg(F.avg(F.when(F.col("cand_id").startswith("S2-"), F.coalesce("hit", F.lit(0)))).alias("recall_s2"), F.avg(F.when(F.col("cand_id").startswith("S3-"), F.coalesce("hit", F.lit(0)))).alias("recall_s3"))
    share = lambda good, of: F.sum(F.when(good, 1).otherwise(0)) / F.sum(F.when(of, 1).otherwise(0))
    whole = rows.agg(
        F.count(F.lit(1)).alias("n_queries"), F.sum("n").alias("n_pairs"), F.sum("total").alias("n_truth"),
        (F.sum("got") / F.sum("total")).alias("pair_recall"), F.avg(ceiling).alias("ceiling"),
        share(real & (F.col("got") == F.col("total")), real).alias("fully_captured"), share(real & (F.col("n") == 0), real).alias("zero_candidates"),
        F.sum(F.when(F.col("total") == 0, 1).otherwise(0)).alias("singletons"), F.avg("n").alias("avg_candidates"),
        F.percentile("n", F.lit(0.5)).alias("p50"), F.percentile("n", F.lit(0.95)).alias("p95"), F.percentile("n", F.lit(0.99)).alias("p99"), F.max("n").alias("most"),
        (1 - F.sum("n") / (F.count(F.lit(1)) * F.lit(float(n_pool)))).alias("reduction_ratio"),
    )
    return whole.join(s2, F.lit(True))  # one row each


def cap_sweep(pairs: DataFrame, truth: DataFrame, ids: DataFrame, n_pool: int, caps: tuple[int, ...] = (10, 20, 30, 40, 60, 0)) -> DataFrame:
    """Per cap on candidates (0: none), best by shared keys: recall, ceiling, what it costs, and the reduction ratio."""
    rows = _by_cap(pairs, truth, ids, "n_keys", caps)
    return rows.groupBy("k").agg(
        *_reached(), F.sum("n").alias("n_pairs"), F.avg("n").alias("avg_candidates"), F.percentile("n", F.lit(0.5)).alias("p50"), F.percentile("n", F.lit(0.95)).alias("p95"),
        F.percentile("n", F.lit(0.99)).alias("p99"), F.max("n").alias("most"), (1 - F.sum("n") / (F.count(F.lit(1)) * F.lit(float(n_pool)))).alias("reduction_ratio"),
    )


def recall_at(pairs: DataFrame, truth: DataFrame, ids: DataFrame, score: str, ks: tuple[int, ...]) -> DataFrame:
    """Recall, ceiling and candidates per entity when only the k best are kept (0: all)."""
    return _by_cap(pairs, truth, ids, score, ks).groupBy("k").agg(*_reached(), F.avg("n").alias("avg_candidates"))


def _reached() -> tuple[Column, Column]:
    recall = F.col("got") / F.col("total")
    ceiling = F.when(F.col("total") == 0, F.lit(1.0)).when(F.col("got") == 0, F.lit(0.0)).otherwise(1.25 * recall / (0.25 + recall))
    return (F.sum("got") / F.sum("total")).alias("recall"), F.avg(ceiling).alias("ceiling")


def _by_cap(pairs: DataFrame, truth: DataFrame, ids: DataFrame, score: str, ks: tuple[int, ...]) -> DataFrame:
    """Per entity and cap: true matches, those among the best k, and candidates kept. Ranks are worked out once."""
    order = Window.partitionBy("source1_entity_id").orderBy(F.col(score).desc(), F.col("cand_id").asc())
    ranked = pairs.select("source1_entity_id", "cand_id", F.row_number().over(order).alias("rk"))
    limits = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    within = F.col("rk").isNotNull() & ((F.col("k") == 0) | (F.col("rk") <= F.col("k")))  # no rank: the match is no candidate
    hit = truth.join(ranked, ["source1_entity_id", "cand_id"], "left").select("*", limits)
    captured = hit.groupBy("source1_entity_id", "k").agg(F.count(F.lit(1)).alias("total"), F.sum(F.when(within, 1).otherwise(0)).alias("got"))
    kept = ranked.groupBy("source1_entity_id").agg(F.count(F.lit(1)).alias("all")).select("*", limits).select("source1_entity_id", "k", F.when(F.col("k") == 0, F.col("all")).otherwise(F.least("all", F.col("k").cast("long"))).alias("n"))
    return ids.select("source1_entity_id", limits).join(captured, ["source1_entity_id", "k"], "left").join(kept, ["source1_entity_id", "k"], "left").na.fill(0, ["total", "got", "n"])
