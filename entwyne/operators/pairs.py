"""Scores and features of candidate pairs, and the training set made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from entwyne.functions import similarity as S
from entwyne.functions.text import tokens
from entwyne.operators.blocking import top
from entwyne.schemas import VIEWS

PAIR = ("source1_entity_id", "cand_id")


def attach(pairs: DataFrame, queries: DataFrame, pool: DataFrame, views: tuple[str, ...] = VIEWS) -> DataFrame:
    """Views of both sides beside each pair, as q_* and c_*. Unread views are pruned from the scans.

    Pairs are few bytes, but dear to compare: they are dealt out by number, so that small partitions aren't put together.
    """
    pairs = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *PAIR)
    q = queries.select(F.col("entity_id").alias("source1_entity_id"), *[F.col(v).alias(f"q_{v}") for v in views])
    c = pool.select(F.col("entity_id").alias("cand_id"), *[F.col(v).alias(f"c_{v}") for v in views])
    return pairs.join(q, "source1_entity_id").join(c, "cand_id")


def _number_score(q: Column, c: Column) -> Column:
    na, nb, shared = S.set_counts(q, c)
    return F.when((na == 0) | (nb == 0), F.lit(0.5)).otherwise(shared / F.least(na, nb))


def rerank(pairs: DataFrame, queries: DataFrame, pool: DataFrame) -> DataFrame:
    """``pairs`` with rr_score: names count half, addresses 0.28, numbers 0.14, shared keys 0.08."""
    rows = attach(pairs, queries, pool, ("nm_core", "nm_compact", "ad_core", "ad_num"))
    rows = rows.withColumn("_k", S.kernels([
        ("name", "indel", F.col("q_nm_compact"), F.col("c_nm_compact")),
        ("words", "token_set", F.col("q_nm_core"), F.col("c_nm_core")),
        ("address", "token_set", F.col("q_ad_core"), F.col("c_ad_core")),
    ]))
    number = _number_score(S.token_array(F.col("q_ad_num")), S.token_array(F.col("c_ad_num")))
    score = 0.5 * F.greatest("_k.name", "_k.words") + 0.28 * F.col("_k.address") + 0.14 * number + 0.08 * F.least(F.col("n_keys") / 4, F.lit(1.0))
    return rows.select(*pairs.columns, score.alias("rr_score"))


def rerank_top(pairs: DataFrame, queries: DataFrame, pool: DataFrame, k: int = 80) -> DataFrame:
    return top(rerank(pairs, queries, pool), F.col("rr_score"), k)


def add_context(pairs: DataFrame) -> DataFrame:
    """Where a pair stands among its entity's candidates; one window partitioning serves all columns."""
    whole = Window.partitionBy("source1_entity_id")
    order = whole.orderBy(F.col("rr_score").desc(), F.col("cand_id").asc())
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = pairs.withColumns({
        "rr_rank": F.row_number().over(order), "rr_best": F.max("rr_score").over(whole),
        "rr_second": F.coalesce(F.nth_value("rr_score", 2).over(every), F.lit(0.0)), "n_cand": F.count(F.lit(1)).over(whole),
    })
    return out.withColumns({
        "rr_margin": F.col("rr_score") - F.col("rr_best"), "rr_rel": F.col("rr_score") / F.greatest("rr_best", F.lit(1e-6)),
        "rr_top_gap": F.col("rr_best") - F.col("rr_second"),
    })


def label(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """``pairs`` with y: 1 where (source1_entity_id, cand_id) is in the truth."""
    own = truth.select(*PAIR, F.lit(1).alias("y")).distinct()
    return pairs.join(own, list(PAIR), "left").withColumn("y", F.coalesce("y", F.lit(0)))


def sample_negatives(labelled: DataFrame, n_hard: int = 8, n_random: int = 4, seed: int = 7) -> DataFrame:
    """All positives, the hardest negatives by rr_score and some of the rest by a digest, per entity."""
    of = Window.partitionBy("source1_entity_id", "y")
    hard = F.row_number().over(of.orderBy(F.col("rr_score").desc(), F.col("cand_id").asc()))
    rows = labelled.withColumn("_hard", (F.col("y") == 0) & (hard <= n_hard))
    chance = F.md5(F.concat(F.lit(f"{seed}:"), "source1_entity_id", F.lit("|"), "cand_id"))
    rest = F.row_number().over(Window.partitionBy("source1_entity_id", "y", "_hard").orderBy(chance, "cand_id"))
    return rows.withColumn("_rest", rest).where((F.col("y") == 1) | F.col("_hard") | (F.col("_rest") <= n_random)).drop("_hard", "_rest")


def _flag(c: Column) -> Column:
    return c.cast("double")


def features(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """``rows`` (with q_* and c_* views) plus the 62 pair features, and their names in the order models expect."""
    q = {v: F.col(f"q_{v}") for v in VIEWS}
    c = {v: F.col(f"c_{v}") for v in VIEWS}
    first = lambda text: F.coalesce(F.get(tokens(text), F.lit(0)), F.lit(""))
    rows = rows.withColumns({"_fq": first(q["ad_num"]), "_fc": first(c["ad_num"]), "_qa": F.replace(q["ad_core"], F.lit(" "), F.lit("")), "_ca": F.replace(c["ad_core"], F.lit(" "), F.lit(""))})
    fq, fc = F.col("_fq"), F.col("_fc")
    rows = rows.withColumn("_k", S.kernels([
        ("nm_lev_compact", "indel", q["nm_compact"], c["nm_compact"]), ("nm_jw_compact", "jaro_winkler", q["nm_compact"], c["nm_compact"]),
        ("nm_lev_skel", "indel", q["nm_skel"], c["nm_skel"]), ("nm_tok_sort", "token_sort", q["nm_core"], c["nm_core"]),
        ("nm_tok_set", "token_set", q["nm_core"], c["nm_core"]), ("nm_partial", "partial", q["nm_compact"], c["nm_compact"]),
        ("ad_lev_core", "indel", q["ad_core"], c["ad_core"]), ("ad_tok_sort", "token_sort", q["ad_core"], c["ad_core"]),
        ("ad_tok_set", "token_set", q["ad_core"], c["ad_core"]), ("ad_partial", "partial", q["ad_full"], c["ad_full"]),
        ("num_first_lev", "indel", fq, fc), ("num_any_lev", "token_set", q["ad_num"], c["ad_num"]),
    ]))
    k = lambda name: F.col(f"_k.{name}")
    sets = {}
    for tag, view in (("nm", "nm_core"), ("ad", "ad_alpha"), ("num", "ad_num")):
        sets[tag] = S.set_counts(S.token_array(q[view]), S.token_array(c[view]))
    ratio = {tag: S.set_ratios(*v) for tag, v in sets.items()}
    q_empty, c_empty = q["ad_full"] == "", c["ad_full"] == ""
    usable = _flag(~(q_empty | c_empty))
    both = _flag((fq != "") & (fc != ""))
    lengths = lambda a, b: F.abs(F.length(a) - F.length(b)).cast("double")
    off_by = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(fq), F.lit(1))), lambda i: F.substring(fq, i, F.lit(1)) != F.substring(fc, i, F.lit(1))))
    short = (fq != "") & (fc != "") & (F.length(fq) < 10) & (F.length(fc) < 10) & fq.rlike(r"^\d+$") & fc.rlike(r"^\d+$")
    a, b = fq.try_cast("long"), fc.try_cast("long")
    name_best, address_best = F.greatest(k("nm_lev_compact"), k("nm_tok_set")), F.greatest(k("ad_lev_core"), k("ad_tok_set"))
    name_exact, address_exact, first_equal = _flag(q["nm_core"] == c["nm_core"]), _flag(q["ad_core"] == c["ad_core"]), _flag((fq == fc) & (fq != ""))
    made = {
        "nm_core_exact": name_exact, "nm_compact_exact": _flag(q["nm_compact"] == c["nm_compact"]),
        "nm_skel_exact": _flag(q["nm_skel"] == c["nm_skel"]), "nm_full_exact": _flag(q["nm_full"] == c["nm_full"]),
        **{n: k(n) for n in ("nm_lev_compact", "nm_jw_compact", "nm_lev_skel", "nm_tok_sort", "nm_tok_set", "nm_partial")},
        "nm_char3_jacc": S.ngram_jaccard(q["nm_compact"], c["nm_compact"], 3), "nm_char4_jacc": S.ngram_jaccard(q["nm_compact"], c["nm_compact"], 4),
        "nm_tok_jaccard": ratio["nm"][0], "nm_tok_containment": ratio["nm"][1], "nm_tok_coverage": ratio["nm"][2], "nm_tok_shared": sets["nm"][2],
        "nm_tok_q": sets["nm"][0], "nm_tok_c": sets["nm"][1], "nm_tok_diff": F.abs(sets["nm"][0] - sets["nm"][1]),
        "nm_len_ratio": S.length_ratio(q["nm_compact"], c["nm_compact"]), "nm_len_q": F.length(q["nm_compact"]).cast("double"), "nm_len_diff": lengths(q["nm_compact"], c["nm_compact"]),
        "ad_q_empty": _flag(q_empty), "ad_c_empty": _flag(c_empty), "ad_core_exact": address_exact,
        **{n: k(n) for n in ("ad_lev_core", "ad_tok_sort", "ad_tok_set", "ad_partial")},
        "ad_char3_jacc": S.ngram_jaccard(F.col("_qa"), F.col("_ca"), 3),
        "ad_tok_jaccard": ratio["ad"][0], "ad_tok_containment": ratio["ad"][1], "ad_tok_coverage": ratio["ad"][2], "ad_tok_shared": sets["ad"][2],
        "ad_tok_q": sets["ad"][0], "ad_tok_c": sets["ad"][1],
        "num_jaccard": ratio["num"][0], "num_containment": ratio["num"][1], "num_shared": sets["num"][2], "num_q": sets["num"][0], "num_c": sets["num"][1],
        "num_any_shared": _flag(sets["num"][2] > 0), "num_none_either": _flag((sets["num"][0] == 0) | (sets["num"][1] == 0)),
        "num_first_eq": first_equal, "num_first_both_present": both, "num_first_lev": k("num_first_lev") * both,
        "num_first_prefix": S.prefix_similarity(fq, fc) * both, "num_first_postfix": S.postfix_similarity(fq, fc) * both, "num_first_len_diff": lengths(fq, fc),
        "num_first_is_prefix": both * _flag(fq.startswith(fc) | fc.startswith(fq)),
        "num_first_one_digit_off": both * _flag((F.length(fq) == F.length(fc)) & (off_by == 1)),
        "num_first_rel_diff": F.when(short, F.abs(a - b) / F.greatest(a, b, F.lit(1))).otherwise(F.lit(0.0)),
        "num_any_lev": k("num_any_lev"), "ad_len_ratio": S.length_ratio(q["ad_core"], c["ad_core"]), "ad_len_diff": lengths(q["ad_core"], c["ad_core"]),
        "country_eq": _flag(q["ctry"] == c["ctry"]), "is_s3": _flag(F.col("cand_id").startswith("S3-")),
        "nm_x_ad": name_best * address_best, "nm_minus_ad": name_best - address_best, "ad_usable": usable, "nm_x_ad_usable": name_best * usable,
        "exact_agreement": name_exact + address_exact + first_equal,
    }
    keep = [x for x in rows.columns if x not in ("_fq", "_fc", "_qa", "_ca", "_k") and x not in made]
    return rows.select(*keep, *[v.cast("double").alias(n) for n, v in made.items()]), list(made)


def owner(scored: DataFrame, least: float = 0.05) -> DataFrame:
    """Each candidate stays with the one entity that scores it highest."""
    order = Window.partitionBy("cand_id").orderBy(F.col("p").desc(), F.col("source1_entity_id").asc())
    return scored.where(F.col("p") >= least).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
