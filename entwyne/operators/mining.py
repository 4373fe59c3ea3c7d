"""Vocabulary mined from matched pairs: aliases from substitutions, noise from tokens that come and go.

Token multisets of both sides of a pair are counted and compared by a full outer join on (pair, token); everything after
is sums by token. Only the accepted aliases, a few hundred at most, come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from entwyne.functions.text import is_abbreviation


@dataclass(frozen=True)
class MiningConfig:
    min_support: int = 150
    min_confidence: float = 0.05
    noise_min_n: int = 300
    noise_min_df: int = 1500
    noise_drop_rate: float = 0.45
    added_min: int = 1500
    added_df_share: float = 0.2
    added_top: int = 600
    abbreviations_only: bool = True


def token_diff(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(pair, tok, a, b): occurrences of each token on both sides; ``left`` and ``right`` are token arrays."""
    long = lambda side: pairs.select("pair", F.explode(side).alias("tok")).groupBy("pair", "tok").agg(F.count(F.lit(1)).alias("n"))
    return long(left).withColumnRenamed("n", "a").join(long(right).withColumnRenamed("n", "b"), ["pair", "tok"], "full").na.fill(0, ["a", "b"])


def token_stats(diff: DataFrame) -> DataFrame:
    """(tok, keep, drop, add, df): df counts pairs whose reference side holds the token."""
    zero = F.lit(0)
    return diff.groupBy("tok").agg(
        F.sum(F.least("a", "b")).alias("keep"), F.sum(F.greatest(F.col("a") - F.col("b"), zero)).alias("drop"),
        F.sum(F.greatest(F.col("b") - F.col("a"), zero)).alias("add"), F.sum(F.when(F.col("a") > 0, 1).otherwise(0)).alias("df"),
    )


def substitutions(diff: DataFrame) -> DataFrame:
    """(a, b, n) both ways, from pairs that lose exactly one token and gain exactly one."""
    lost, gained = F.greatest(F.col("a") - F.col("b"), F.lit(0)), F.greatest(F.col("b") - F.col("a"), F.lit(0))
    one = diff.groupBy("pair").agg(F.sum(lost).alias("lost"), F.sum(gained).alias("gained"), F.max(F.when(lost > 0, F.col("tok"))).alias("x"), F.max(F.when(gained > 0, F.col("tok"))).alias("y"))
    both = one.where("lost = 1 and gained = 1 and x <> y").select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b")))).alias("s"))
    return both.groupBy("s.a", "s.b").agg(F.count(F.lit(1)).alias("n"))


def best_replacement(subs: DataFrame) -> DataFrame:
    """(a, b, n, confidence): the most frequent replacement of each token."""
    of = Window.partitionBy("a")
    rated = subs.withColumn("r", F.row_number().over(of.orderBy(F.desc("n"), "b"))).withColumn("confidence", F.col("n") / F.sum("n").over(of))
    return rated.where("r = 1").drop("r")


def aliases(diff: DataFrame, config: MiningConfig = MiningConfig()) -> DataFrame:
    """(alias, canonical, n): mutual best replacements; the spelling the reference side holds more often is canonical."""
    best, stats = best_replacement(substitutions(diff)), token_stats(diff).select("tok", "df")
    back = best.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("confidence").alias("back"))
    mutual = best.join(back, ["a", "b"]).where(F.col("a") < F.col("b"))
    digits = lambda c: F.col(c).rlike(r"^\d+$")
    good = (F.col("n") >= config.min_support) & (F.least("confidence", "back") >= config.min_confidence) & (digits("a") == digits("b"))
    if config.abbreviations_only:
        good = good & is_abbreviation(F.col("a"), F.col("b"))
    own = mutual.where(good).join(stats.select(F.col("tok").alias("a"), F.col("df").alias("da")), "a", "left").join(stats.select(F.col("tok").alias("b"), F.col("df").alias("db")), "b", "left")
    a_first = F.coalesce("da", F.lit(0)) >= F.coalesce("db", F.lit(0))
    return own.select(F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("alias"), F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("canonical"), "n")


def resolve(found: DataFrame, most: int = 10_000) -> dict[str, str]:
    """The alias table as a dict in which no alias points to another. Over ``most`` of them are an error."""
    table = {r.alias: r.canonical for r in found.limit(most + 1).collect()}
    if len(table) > most:
        raise ValueError(f"more than {most} aliases: ask for more support or confidence")
    for k in table:
        seen, v = {k}, table[k]
        while v in table and v not in seen:
            seen.add(v)
            v = table[v]
        table[k] = v
    return table


def unstable_tokens(stats: DataFrame, alias: list[str], config: MiningConfig = MiningConfig()) -> DataFrame:
    """(tok): tokens that matched pairs drop often, or that are added often and hardly known to the reference side."""
    n = F.col("keep") + F.col("drop")
    dropped = (n >= config.noise_min_n) & (F.col("df") >= config.noise_min_df) & (F.col("drop") / n >= config.noise_drop_rate)
    top = stats.where(F.col("add") > 0).orderBy(F.desc("add"), "tok").limit(config.added_top)
    added = top.where((F.col("add") >= config.added_min) & (F.col("df") < F.col("add") * config.added_df_share))
    return stats.where(dropped).select("tok").unionByName(added.select("tok")).distinct().where(~F.col("tok").isin(alias))


def _wordlike() -> Column:
    return ~F.col("tok").rlike(r"\d") & (F.length("tok") > 1)


def noise_by_injection(stats: DataFrame, alias: list[str], n_pairs: int, add_rate: float = 0.05, df_share: float = 0.02, drop_rate: float = 0.25, min_n: int = 300, min_added: int = 1000) -> DataFrame:
    """(tok, kind) for names: injected tokens, and saturated ones that are no alias."""
    n = F.col("keep") + F.col("drop")
    supported = _wordlike() & ((n >= min_n) | (F.col("add") >= min_added))
    all_added = F.col("keep") + F.col("add")
    added = F.when(all_added > 0, F.col("add") / all_added).otherwise(1.0)
    dropped = F.when(n > 0, F.col("drop") / n).otherwise(0.0)
    kind = F.when(added >= add_rate, "injected").when((F.col("df") / n_pairs >= df_share) & (dropped >= drop_rate) & ~F.col("tok").isin(alias), "saturated")
    return stats.where(supported).select("tok", kind.alias("kind")).where("kind is not null")


def noise_by_instability(stats: DataFrame, alias: list[str], config: MiningConfig = MiningConfig()) -> DataFrame:
    """(tok) for addresses, whose aliases are resolved before counting."""
    n = F.col("keep") + F.col("drop")
    dropped = (n >= config.noise_min_n) & (F.col("df") >= config.noise_min_df) & (F.col("drop") / n >= config.noise_drop_rate)
    added = (F.col("add") >= config.added_min) & (F.col("df") < F.col("add") * config.added_df_share)
    return stats.where(_wordlike() & (dropped | added) & ~F.col("tok").isin(alias)).select("tok")


def gate(noise: list[str], must_keep: list[str], must_drop: list[str]) -> list[str]:
    """What is wrong with a noise list: content words it holds and filler it lacks."""
    return [f"noise holds {t}" for t in must_keep if t in noise] + [f"noise lacks {t}" for t in must_drop if t not in noise]
