"""Scores of predicted matches: macro F0.5 over entities, and what belongs to it.

Truth and predictions are pairs (source1_entity_id, cand_id); the universe of entities decides what is averaged, so
entities without predictions count and predictions outside it don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from entwyne.functions.text import f_beta, id_set


def pairs_of(lists: DataFrame, ids: str) -> DataFrame:
    """Pairs from a table of comma-separated lists."""
    return lists.select("source1_entity_id", F.explode(id_set(F.col(ids))).alias("cand_id")).distinct()


def entity_f05(n_true: Column, n_pred: Column, tp: Column) -> Column:
    """An entity without matches scores 1 if none is predicted; one with matches scores 0 if none is predicted."""
    both = f_beta(tp / n_pred, tp / n_true)
    return F.when(n_true == 0, F.when(n_pred == 0, 1.0).otherwise(0.0)).when(n_pred == 0, F.lit(0.0)).otherwise(both)


def per_entity(truth: DataFrame, predicted: DataFrame, ids: DataFrame) -> DataFrame:
    """(source1_entity_id, n_true, n_pred, tp, f05) for the whole universe: one union, one aggregation."""
    marked = truth.select("source1_entity_id", "cand_id", F.lit(1).alias("t"), F.lit(0).alias("p")).unionByName(predicted.select("source1_entity_id", "cand_id", F.lit(0).alias("t"), F.lit(1).alias("p")))
    each = marked.groupBy("source1_entity_id", "cand_id").agg(F.max("t").alias("t"), F.max("p").alias("p"))
    counts = each.groupBy("source1_entity_id").agg(F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"), F.sum(F.col("t") * F.col("p")).alias("tp"))
    rows = ids.select("source1_entity_id").distinct().join(counts, "source1_entity_id", "left").na.fill(0)
    return rows.withColumn("f05", entity_f05(F.col("n_true"), F.col("n_pred"), F.col("tp")))


def _safe(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def summarise(entities: DataFrame, *by: str) -> DataFrame:
    """The official metrics, overall or by group."""
    single, predicted = F.col("n_true") == 0, F.col("n_pred") > 0
    n = F.count(F.lit(1))
    tp, n_pred, n_true = F.sum("tp"), F.sum("n_pred"), F.sum("n_true")
    precision = F.avg(F.when(predicted, F.col("tp") / F.col("n_pred")))
    recall = F.avg(F.when(predicted, _safe(F.col("tp"), F.col("n_true"))))
    out = entities.groupBy(*by).agg(
        n.alias("n_entities"), F.coalesce(F.avg("f05"), F.lit(0.0)).alias("macro_f05"), F.avg(F.when(single, F.col("f05"))).alias("macro_f05_singletons"),
        F.avg(F.when(~single, F.col("f05"))).alias("macro_f05_nonsingletons"), F.coalesce(precision, F.lit(0.0)).alias("mean_precision"), F.coalesce(recall, F.lit(0.0)).alias("mean_recall"),
        F.avg(F.when(single, F.when(predicted, 0.0).otherwise(1.0))).alias("singleton_accuracy"), F.coalesce(F.sum(F.when(single, 1).otherwise(0)), F.lit(0)).alias("n_singletons"),
        F.coalesce(F.sum(F.when(predicted, 1).otherwise(0)), F.lit(0)).alias("n_with_prediction"), F.coalesce(n_pred, F.lit(0)).alias("n_predicted"), F.coalesce(n_true, F.lit(0)).alias("n_true"),
        F.coalesce(tp, F.lit(0)).alias("tp"), F.coalesce(n_pred - tp, F.lit(0)).alias("fp"), F.coalesce(n_true - tp, F.lit(0)).alias("fn"),
        _safe(tp, n_pred).alias("micro_precision"), _safe(tp, n_true).alias("micro_recall"),
    )
    return out.withColumn("micro_f05", f_beta(F.col("micro_precision"), F.col("micro_recall")))


def evaluate(truth: DataFrame, predicted: DataFrame, ids: DataFrame) -> DataFrame:
    return summarise(per_entity(truth, predicted, ids))


def of_source(pairs: DataFrame, source: str) -> DataFrame:
    return pairs.where(F.col("cand_id").startswith(f"{source}-"))


def per_source(truth: DataFrame, predicted: DataFrame, ids: DataFrame) -> DataFrame:
    """The metrics of truth and predictions restricted to each source."""
    own = [evaluate(of_source(truth, s), of_source(predicted, s), ids).withColumn("source", F.lit(s)) for s in ("S2", "S3")]
    return own[0].unionByName(own[1])


def report(truth: DataFrame, predicted: DataFrame, candidates: DataFrame, ids: DataFrame) -> DataFrame:
    """Achieved score beside what perfect decisions on these candidates would reach."""
    ceiling = summarise(per_entity(truth, candidates.join(truth.distinct(), ["source1_entity_id", "cand_id"], "left_semi"), ids)).select(F.col("macro_f05").alias("ceiling"))
    return evaluate(truth, predicted, ids).join(ceiling, F.lit(True)).withColumn("gap", F.col("ceiling") - F.col("macro_f05"))


def paired_compare(truth: DataFrame, a: DataFrame, b: DataFrame, ids: DataFrame) -> DataFrame:
    """Per-entity difference of two predictions (b - a): mean, standard error, t, 95 % interval, better, worse, same."""
    one, two = per_entity(truth, a, ids).select("source1_entity_id", F.col("f05").alias("x")), per_entity(truth, b, ids).select("source1_entity_id", F.col("f05").alias("y"))
    d = F.col("y") - F.col("x")
    out = one.join(two, "source1_entity_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_a"), F.avg("y").alias("mean_b"), F.avg(d).alias("mean_diff"), (F.stddev_samp(d) / F.sqrt(F.count(F.lit(1)))).alias("se"),
        F.sum(F.when(d > 0, 1).otherwise(0)).alias("better"), F.sum(F.when(d < 0, 1).otherwise(0)).alias("worse"), F.sum(F.when(d == 0, 1).otherwise(0)).alias("same"),
    )
    return out.withColumns({"t": F.when(F.col("se") > 0, F.col("mean_diff") / F.col("se")), "low": F.col("mean_diff") - 1.96 * F.col("se"), "high": F.col("mean_diff") + 1.96 * F.col("se")})


def by_true_count(entities: DataFrame, most: int = 8) -> DataFrame:
    return entities.groupBy(F.least("n_true", F.lit(most)).alias("n_true_bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("f05").alias("f05"), F.sum("tp").alias("tp"), F.sum("n_pred").alias("n_pred"))


def by_country(entities: DataFrame, countries: DataFrame) -> DataFrame:
    """Overall and per country in one pass; the overall row is named all."""
    rows = entities.join(countries.select(F.col("entity_id").alias("source1_entity_id"), "ctry"), "source1_entity_id")
    out = rows.rollup("ctry").agg(F.count(F.lit(1)).alias("n"), F.avg("f05").alias("f05"), F.sum("tp").alias("tp"), F.sum("n_pred").alias("n_pred"), F.sum("n_true").alias("n_true"), F.grouping("ctry").alias("_all"))
    return out.withColumn("ctry", F.when(F.col("_all") == 1, "all").otherwise(F.col("ctry"))).drop("_all")


def _ranked(scored: DataFrame, value: str, counts: tuple[str, ...], parts: int = 256) -> DataFrame:
    """One row per distinct value, with sums of ``counts`` and, as below_*, the sums over all smaller values.

    Values are dealt into ranges by approximate quantiles; a window runs within a range, and ranges are joined by the
    running sums of their totals, a row each. So no task sorts all values.
    """
    values = scored.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(*[F.sum(c).alias(c) for c in counts])
    bounds = values.agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 1000)).first()[0] or []
    placed = values.withColumn("_part", F.aggregate(F.array(*[F.lit(float(x)) for x in sorted(set(bounds))]).cast("array<double>"), F.lit(0), lambda n, x: n + (F.col("v") > x).cast("int")))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_{c}") for c in counts]).select("_part", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in counts])
    within = Window.partitionBy("_part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumns({f"below_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in counts}).join(F.broadcast(totals), "_part")
    return rows.select("v", *counts, *[(F.col(f"below_{c}") + F.col(f"_{c}")).alias(f"below_{c}") for c in counts])


def percentiles(scored: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row of exact percentiles, with linear interpolation, by ranks of distinct values; null without values."""
    ranked = _ranked(scored.select(value, F.lit(1).alias("n")), value, ("n",))
    total = ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_total"))
    rows, out = ranked.join(F.broadcast(total), F.lit(True)), []
    for name, q in shares.items():
        at = (F.col("_total") - 1) * F.lit(q)
        holds = lambda place: (F.col("below_n") <= place) & (place < F.col("below_n") + F.col("n"))
        low, high = F.max(F.when(holds(F.floor(at)), F.col("v"))), F.max(F.when(holds(F.ceil(at)), F.col("v")))
        out.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return rows.agg(*out)


def binary_scores(scored: DataFrame) -> DataFrame:
    """ROC AUC by ranks with ties averaged, average precision by distinct scores, log-loss, precision and recall at 0.7."""
    rated = _ranked(scored.select("p", F.col("y").alias("pos"), F.lit(1).alias("n")), "p", ("pos", "n"))
    totals = rated.agg(F.sum("pos").alias("_pos"), F.sum("n").alias("_n"))
    rated = rated.join(F.broadcast(totals), F.lit(True)).withColumns({"tp": F.col("_pos") - F.col("below_pos"), "seen": F.col("_n") - F.col("below_n")})
    clipped = F.least(F.greatest(F.col("v"), F.lit(1e-15)), F.lit(1 - 1e-15))
    total, good = F.sum("n"), F.sum("pos")
    above = F.col("v") >= 0.7
    return rated.agg(
        ((F.sum(F.col("pos") * (F.col("below_n") + (F.col("n") + 1) / 2)) - good * (good + 1) / 2) / (good * (total - good))).alias("auc"),
        (F.sum(F.col("pos") * F.col("tp") / F.col("seen")) / good).alias("average_precision"),
        (-F.sum(F.col("pos") * F.ln(clipped) + (F.col("n") - F.col("pos")) * F.ln(1 - clipped)) / total).alias("log_loss"),
        _safe(F.sum(F.when(above, F.col("pos")).otherwise(0)), F.sum(F.when(above, F.col("n")).otherwise(0))).alias("precision_70"),
        _safe(F.sum(F.when(above, F.col("pos")).otherwise(0)), good).alias("recall_70"), total.alias("n"), good.alias("positives"),
    )


def fit_check(seen: DataFrame, held_out: DataFrame) -> DataFrame:
    """Scores on what a model was fitted on beside those on what it wasn't."""
    return binary_scores(seen).withColumn("part", F.lit("seen")).unionByName(binary_scores(held_out).withColumn("part", F.lit("held out")))


def boundary_bands(scored: DataFrame, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """Pairs near the boundary, by label, and the upper percentiles of negatives."""
    inside = F.col("p").between(low, high)
    counts = scored.agg(
        F.sum(F.when(inside & (F.col("y") == 1), 1).otherwise(0)).alias("band_pos"), F.sum(F.when(inside & (F.col("y") == 0), 1).otherwise(0)).alias("band_neg"),
        F.sum(F.when((F.col("p") > high) & (F.col("y") == 0), 1).otherwise(0)).alias("neg_above"), F.sum(F.when((F.col("p") < low) & (F.col("y") == 1), 1).otherwise(0)).alias("pos_below"),
    )
    return counts.join(percentiles(scored.where("y = 0"), "p", {"neg_p99": 0.99, "neg_p999": 0.999}), F.lit(True))  # one row each


def miss_diagnosis(truth: DataFrame, candidates: DataFrame, records: DataFrame) -> DataFrame:
    """Recall of the candidates by country, source, script of the names and missing address, in one pass.

    ``records`` has entity_id, business_name, business_address and ctry.
    """
    odd = lambda c: F.coalesce(F.col(c), F.lit("")).rlike(r"[^\x00-\x7F]")
    q = records.select(F.col("entity_id").alias("source1_entity_id"), "ctry", odd("business_name").alias("_q_odd"))
    c = records.select(F.col("entity_id").alias("cand_id"), odd("business_name").alias("_c_odd"), (F.trim(F.coalesce("business_address", F.lit(""))) == "").alias("_bare"))
    hit = candidates.select("source1_entity_id", "cand_id", F.lit(1).alias("hit")).distinct()
    rows = truth.distinct().join(hit, ["source1_entity_id", "cand_id"], "left").join(q, "source1_entity_id").join(c, "cand_id")
    kinds = {"country": F.col("ctry"), "source": F.substring("cand_id", 1, 2), "non-ASCII name": (F.col("_q_odd") | F.col("_c_odd")).cast("string"), "missing address": F.col("_bare").cast("string"), "all": F.lit("all")}
    cells = rows.select("hit", F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("value")) for k, v in kinds.items()])).alias("x"))
    return cells.groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n_truth"), F.count("hit").alias("n_found"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))


def feature_diagnostics(rows: DataFrame, names: list[str]) -> DataFrame:
    """Per feature: distinct values, NaNs, infinities, least and most; one scan, one row per feature."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("v")) for n in names]))
    x = rows.select(pairs.alias("x")).select("x.*")
    infinite = F.abs("v") == float("inf")
    return x.groupBy("feature").agg(F.count_distinct("v").alias("n_unique"), F.count_if(F.isnan("v")).alias("n_nan"), F.count_if(infinite).alias("n_inf"), F.min("v").alias("least"), F.max("v").alias("most"))


def binned(df: DataFrame, value: str, width: float) -> DataFrame:
    return df.groupBy((F.floor(F.col(value) / width) * width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
