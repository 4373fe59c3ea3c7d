"""The second way to candidates: weighted keys of names and addresses, best sums first.

A sparse inner product is a join on the key and a sum of squared weights. Keys beyond ``max_df`` records are left out of
the vocabulary, which bounds what one key can pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from entwyne.functions import similarity as S
from entwyne.functions.text import decompose, tokens

# Abbreviations, ordinals and states that the second normaliser knows.
NAME_ABBREVIATIONS = {
    "pvt": "private", "ltd": "limited", "corp": "corporation", "inc": "incorporated", "co": "company", "intl": "international", "assn": "association", "svc": "service",
    "svcs": "services", "mfg": "manufacturing", "bros": "brothers", "dept": "department", "univ": "university", "mgmt": "management", "amp": "and", "&": "and",
}
ADDRESS_ABBREVIATIONS = {
    "st": "street", "str": "street", "rd": "road", "ave": "avenue", "av": "avenue", "avnue": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court",
    "hwy": "highway", "pkwy": "parkway", "pl": "place", "cir": "circle", "ter": "terrace", "sq": "square", "apt": "apartment", "ste": "suite", "bldg": "building",
    "flr": "floor", "nr": "near", "opp": "opposite", "rte": "route", "n": "north", "s": "south", "e": "east", "w": "west",
}
ORDINALS = {"first": "1", "second": "2", "third": "3", "fourth": "4", "fifth": "5", "sixth": "6", "seventh": "7", "eighth": "8", "ninth": "9", "tenth": "10", "eleventh": "11", "twelfth": "12"}
STATES = {
    "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br", "chhattisgarh": "cg", "goa": "ga", "gujarat": "gj", "haryana": "hr",
    "himachal pradesh": "hp", "jharkhand": "jh", "karnataka": "ka", "kerala": "kl", "madhya pradesh": "mp", "maharashtra": "mh", "manipur": "mn", "meghalaya": "ml",
    "mizoram": "mz", "nagaland": "nl", "odisha": "od", "punjab": "pb", "rajasthan": "rj", "sikkim": "sk", "tamil nadu": "tn", "telangana": "ts", "tripura": "tr",
    "uttar pradesh": "up", "uttarakhand": "uk", "west bengal": "wb", "delhi": "dl", "jammu and kashmir": "jk", "chandigarh": "ch", "puducherry": "py", "ladakh": "la",
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de", "florida": "fl",
    "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me",
    "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne",
    "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh",
    "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx",
    "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy",
}
DROPPED = ("no", "number", "nr", "num")
_DOMAIN = r"\.(com|net|org|info|biz|co|in|fr|us)\b"
_PUNCTUATION = r"[!\"#$%&()*+,\-./:;<=>?@\[\\\]^_{|}~\u2010-\u2015\u201c-\u201f\u00b7\u00ab\u00bb\u2022]"
# A weight is summed as a multiple of the first and one of the second, which doubles add without rounding up to some 100,000 keys.
_COARSE, _FINE = 2.0**-24, 2.0**-60


def _mapped(toks: Column, table: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.transform(toks, lambda t: F.coalesce(F.try_element_at(known, t), t))


def _clean(text: Column) -> Column:
    low = F.lower(decompose(F.coalesce(text, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(low, _DOMAIN, " "), "&", " and "), "['\u2018\u2019`\u00b4.]", "")


def second_name(text: Column) -> Column:
    """Other scripts stay; domains go whatever stands around them."""
    return F.array_join(_mapped(tokens(F.regexp_replace(F.regexp_replace(_clean(text), _PUNCTUATION, " "), r"\s+", " ")), NAME_ABBREVIATIONS), " ")


def second_address(text: Column) -> Column:
    names = "|".join(sorted(STATES, key=lambda s: (-len(s), s)))
    spaced = F.trim(F.regexp_replace(F.regexp_replace(_clean(text), _PUNCTUATION, " "), r"\s+", " "))
    marked = F.regexp_replace(spaced, rf"\b({names})\b", "\u0001$1\u0002")
    known = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    coded = F.array_join(F.transform(F.split(marked, "\u0001"), lambda p: F.when(F.contains(p, F.lit("\u0002")), F.concat(F.try_element_at(known, F.substring_index(p, "\u0002", 1)), F.substring_index(p, "\u0002", -1))).otherwise(p)), "")
    plain = F.transform(tokens(coded), lambda t: F.regexp_replace(t, r"^(\d+)(st|nd|rd|th|er|e|eme)$", "$1"))
    return F.array_join(F.filter(_mapped(_mapped(plain, ORDINALS), ADDRESS_ABBREVIATIONS), lambda t: ~t.isin(*DROPPED)), " ")


def learn_lexicon(pairs: DataFrame, least: float = 0.3) -> DataFrame:
    """(token, latin): what a token of another script stands for, by how close by position it occurs in matched names."""
    left = pairs.select("pair", F.posexplode(tokens(F.col("name_a"))).alias("i", "latin"))
    right = pairs.select("pair", F.posexplode(tokens(F.col("name_b"))).alias("j", "token")).where(F.col("token").rlike(r"[^\x00-\x7F]"))
    involved = left.join(right.select("pair").distinct(), "pair", "left_semi")
    cn = right.select("pair", "token").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("cn"))
    cl = involved.select("pair", "latin").distinct().groupBy("latin").agg(F.count(F.lit(1)).alias("cl"))
    together = involved.join(right, "pair").groupBy("token", "latin").agg(F.sum(1.0 / (1 + F.abs(F.col("i") - F.col("j")))).alias("w"))
    rated = together.join(cn, "token").join(cl, "latin").withColumn("score", F.col("w") / (F.col("cn") + F.col("cl") - F.col("w")))
    best = Window.partitionBy("token").orderBy(F.desc("score"), "latin")
    return rated.withColumn("r", F.row_number().over(best)).where((F.col("r") == 1) & (F.col("score") >= least)).select("token", "latin", "score")


def apply_lexicon(names: DataFrame, lexicon: DataFrame, column: str = "name_n") -> DataFrame:
    """``names`` (entity_id, ...) with known tokens of other scripts replaced; a shuffle join, so the lexicon may be large."""
    long = names.select("entity_id", F.posexplode(tokens(F.col(column))).alias("i", "token"))
    done = long.join(lexicon.select("token", "latin"), "token", "left").select("entity_id", F.struct("i", F.coalesce("latin", "token").alias("t")).alias("x"))
    joined = done.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), " ").alias("_new"))
    return names.join(joined, "entity_id", "left").withColumn(column, F.coalesce("_new", F.lit(""))).drop("_new")


def token_frequency(records: DataFrame, column: str) -> DataFrame:
    return records.select("country", F.explode(F.array_distinct(tokens(F.col(column)))).alias("tok")).groupBy("country", "tok").agg(F.count(F.lit(1)).alias("df"))


def _rarest(records: DataFrame, column: str, frequency: DataFrame, max_df: int, n: int) -> DataFrame:
    """(entity_id, core): the n rarest distinct tokens, rarest first, ties by token."""
    long = records.select("entity_id", "country", F.explode(F.array_distinct(tokens(F.col(column)))).alias("tok")).join(frequency, ["country", "tok"], "left")
    rare = long.withColumn("df", F.coalesce("df", F.lit(0))).where(F.col("df") <= max_df).groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("x"))
    return rare.select("entity_id", F.transform(F.slice("x", 1, n), lambda t: t["tok"]).alias("core"))


def _pairs_of(tag: str, core: Column) -> Column:
    return F.flatten(F.transform(core, lambda a, i: F.transform(F.slice(core, i + 2, F.greatest(F.size(core) - i - 1, F.lit(0))), lambda b: F.concat(F.lit(tag), a, F.lit("_"), b))))


def weighted_keys(records: DataFrame, max_df: int, name_col: str = "name_n", address_col: str = "addr_n") -> DataFrame:
    """(entity_id, country, field, key) of names and addresses."""
    none = F.array().cast("array<string>")
    tag = lambda t, xs: F.transform(xs, lambda x: F.concat(F.lit(t), x))
    name = tokens(F.col(name_col))
    named = records.join(_rarest(records, name_col, token_frequency(records, name_col), max_df, 6), "entity_id", "left").select(
        "entity_id", "country", F.lit("n").alias("field"),
        F.explode(F.array_distinct(F.concat(
            tag("n", F.filter(name, lambda t: F.length(t) >= 3)), _pairs_of("b", F.coalesce("core", none)),
            tag("p", F.transform(F.filter(name, lambda t: F.length(t) >= 5), lambda t: F.substring(t, 1, 4))),
            tag("x", F.transform(F.filter(name, lambda t: F.length(t) >= 6), lambda t: F.substring(t, -4, 4))),
        ))).alias("key"),
    )
    address = tokens(F.col(address_col))
    digits = lambda t: t.rlike(r"^\d+$")
    placed = records.join(_rarest(records, address_col, token_frequency(records, address_col), max_df, 8), "entity_id", "left").select(
        "entity_id", "country", F.lit("a").alias("field"),
        F.explode(F.array_distinct(F.concat(
            tag("a", F.filter(address, lambda t: (F.length(t) >= 4) & ~digits(t))), _pairs_of("c", F.coalesce("core", none)),
            tag("z", F.filter(address, lambda t: digits(t) & (F.length(t) >= 5))),
        ))).alias("key"),
    )
    return named.unionByName(placed)


def top_candidates(records: DataFrame, max_df: int = 300, k: int = 30) -> DataFrame:
    """(source1_entity_id, cand_id, sn, sa, s_tot): the k best pool records of each S1 record per source, by sums of idf².

    Sums are exact but for the last rounding, whatever the order of rows: candidates with equal keys tie, and ties go by id.
    """
    keyed = weighted_keys(records, max_df)
    sizes = records.groupBy("country").agg(F.count(F.lit(1)).alias("n_rec"))
    weight = keyed.groupBy("country", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, max_df)).join(sizes, "country").select("country", "key", F.pow(F.ln(F.col("n_rec") / F.col("n")), 2).alias("w"))
    low = F.col("w") % F.lit(_COARSE)
    weight = weight.select("country", "key", (F.col("w") - low).alias("hi"), (F.rint(low / F.lit(_FINE)) * F.lit(_FINE)).alias("lo"))
    asked = keyed.where(F.col("entity_id").startswith("S1-")).join(weight, ["country", "key"]).withColumnRenamed("entity_id", "source1_entity_id")
    offered = keyed.where(~F.col("entity_id").startswith("S1-")).select("country", "key", F.col("entity_id").alias("cand_id"))
    part = lambda f, w: F.sum(F.when(F.col("field") == f, F.col(w)).otherwise(0.0)).alias(f + w)
    parts = asked.join(offered, ["country", "key"]).groupBy("source1_entity_id", "cand_id").agg(*[part(f, w) for f in "na" for w in ("hi", "lo")])
    total = (F.col("nhi") + F.col("ahi")) + (F.col("nlo") + F.col("alo"))
    sums = parts.select("source1_entity_id", "cand_id", (F.col("nhi") + F.col("nlo")).alias("sn"), (F.col("ahi") + F.col("alo")).alias("sa"), total.alias("s_tot"))
    order = Window.partitionBy("source1_entity_id", F.substring("cand_id", 1, 2)).orderBy(F.round("s_tot", 9).desc(), F.col("cand_id"))
    return sums.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def competition(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """``pairs`` with ranks and ratios among an entity's and among a candidate's rivals."""
    pairs = pairs.withColumn("_src", F.substring("cand_id", 1, 2)).withColumn("_t", F.round("s_tot", 9))
    mine, theirs = Window.partitionBy("source1_entity_id", "_src"), Window.partitionBy("cand_id")
    out = pairs.withColumns({
        "rank_s1": F.row_number().over(mine.orderBy(F.desc("_t"), "cand_id")), "ratio_best_s1": F.col("s_tot") / F.max("s_tot").over(mine), "n_cand_s1": F.count(F.lit(1)).over(mine),
        "rank_b": F.row_number().over(theirs.orderBy(F.desc("_t"), "source1_entity_id")), "ratio_best_b": F.col("s_tot") / F.max("s_tot").over(theirs), "n_s1_for_b": F.count(F.lit(1)).over(theirs),
    })
    out = out.withColumn("gap_b", F.max("s_tot").over(theirs) - F.coalesce(F.max(F.when(F.col("rank_b") == 2, F.col("s_tot"))).over(theirs), F.lit(0.0)))
    s1 = records.where(F.col("entity_id").startswith("S1-"))
    same = s1.groupBy("country", "name_n").agg(F.count(F.lit(1)).alias("s1_name_dup"))
    dup = s1.join(same, ["country", "name_n"]).select(F.col("entity_id").alias("source1_entity_id"), "s1_name_dup")
    return out.join(dup, "source1_entity_id").drop("_src", "_t")


def token_weights(records: DataFrame, column: str, generic: float) -> DataFrame:
    """(entity_id, w, core): map of a record's distinct tokens to idf within its country, and those above ``generic``."""
    n = records.groupBy("country").agg(F.count(F.lit(1)).alias("n_rec"))
    idf = token_frequency(records, column).join(n, "country").select("country", "tok", F.ln(F.col("n_rec") / F.col("df")).alias("w"))
    long = records.select("entity_id", "country", F.explode(F.array_distinct(tokens(F.col(column)))).alias("tok")).join(idf, ["country", "tok"])
    return long.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("tok", "w"))).alias("w"), F.array_sort(F.collect_list(F.when(F.col("w") > generic, F.col("tok")))).alias("core"))


def pair_features(pairs: DataFrame, records: DataFrame, generic: float = 2.5) -> DataFrame:
    """The 46 features of the second pipeline for (source1_entity_id, cand_id, sn, sa, s_tot); address features are null
    where either address is missing. ``records``: entity_id, country, business_name, name_n, addr_n."""
    names, places = token_weights(records, "name_n", generic), token_weights(records, "addr_n", 99.0)
    own = records.select("entity_id", "business_name", "name_n", "addr_n").join(names.select("entity_id", F.col("w").alias("nw"), F.col("core").alias("nc")), "entity_id", "left").join(places.select("entity_id", F.col("w").alias("aw")), "entity_id", "left")
    side = lambda s, key: own.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{s}_{c}") for c in ("business_name", "name_n", "addr_n", "nw", "nc", "aw")])
    rows = pairs.join(side("a", "source1_entity_id"), "source1_entity_id").join(side("b", "cand_id"), "cand_id")
    na, nb, aa, ab = (F.col(c) for c in ("a_name_n", "b_name_n", "a_addr_n", "b_addr_n"))
    rows = rows.withColumn("_k", S.kernels([(f"n_{n}", k, na, nb) for n, k in (("ratio", "indel"), ("tsort", "token_sort"), ("tset", "token_set"), ("partial", "partial"), ("jw", "jaro_winkler"))] + [(f"a_{n}", k, aa, ab) for n, k in (("ratio", "indel"), ("tsort", "token_sort"), ("tset", "token_set"))]))
    missing = (aa == "") | (ab == "")
    here = lambda c: F.when(~missing, c)
    none = F.array().cast("array<string>")
    x, y, cx, cy = S.token_array(na), S.token_array(nb), F.coalesce("a_nc", none), F.coalesce("b_nc", none)
    u, v, ux, vx = S.token_array(aa), S.token_array(ab), tokens(aa), tokens(ab)
    number = lambda xs: F.filter(xs, lambda t: t.rlike(r"^\d+$"))
    nu, nv = number(u), number(v)
    post = lambda xs: F.filter(xs, lambda t: F.length(t).isin(5, 6))
    jaccard = lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))

    def coverage(a: Column, b: Column, w: str) -> Column:
        total = F.aggregate(F.map_values(w), F.lit(0.0), lambda s, t: s + t)
        shared = F.aggregate(F.transform(F.array_intersect(a, b), lambda t: F.try_element_at(F.col(w), t)), F.lit(0.0), lambda s, t: s + t)
        return F.coalesce(F.when(total > 0, shared / total), F.lit(0.0))

    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    first, last = lambda xs: F.get(xs, F.lit(0)), lambda xs: F.get(xs, F.size(xs) - 1)
    same = lambda a, b: flag(F.coalesce(a == b, F.lit(False)))
    lead = first(number(ux))
    made = {
        "is_s3": flag(F.col("cand_id").startswith("S3-")), **{f"n_{n}": F.col(f"_k.n_{n}") for n in ("ratio", "tsort", "tset", "partial", "jw")}, "n_lev": S.levenshtein_similarity(na, nb),
        "n_nonlatin_b": flag(F.col("b_business_name").rlike(r"[^\x00-\x7F]")), "n_untrans_b": F.size(F.filter(tokens(nb), lambda t: t.rlike(r"[^\x00-\x7F]"))).cast("double"), "a_missing": flag(missing),
        **{f"a_{n}": here(F.col(f"_k.a_{n}")) for n in ("ratio", "tsort", "tset")},
        "n_jac": jaccard(x, y), "n_core_jac": jaccard(cx, cy), "n_core_ov": F.size(F.array_intersect(cx, cy)).cast("double"), "n_core_a": F.size(cx).cast("double"), "n_core_b": F.size(cy).cast("double"),
        "n_cov_a": coverage(x, y, "a_nw"), "n_cov_b": coverage(y, x, "b_nw"), "n_first_eq": same(first(tokens(na)), first(tokens(nb))), "n_last_eq": same(last(tokens(na)), last(tokens(nb))), "n_len_ratio": S.length_ratio(na, nb),
        "a_jac": here(jaccard(u, v)), "a_cov_a": here(coverage(u, v, "a_aw")), "a_cov_b": here(coverage(v, u, "b_aw")), "a_num_ov": here(F.size(F.array_intersect(nu, nv)).cast("double")), "a_num_jac": here(jaccard(nu, nv)),
        "a_num_a": here(F.size(nu).cast("double")), "a_num_b": here(F.size(nv).cast("double")), "a_first_num_eq": here(flag(lead.isNotNull() & F.coalesce(F.array_contains(nv, lead), F.lit(False)))),
        "a_postal_eq": here(flag(F.size(F.array_intersect(post(nu), post(nv))) > 0)), "a_last_eq": here(same(last(ux), last(vx))), "a_tok_a": here(F.size(ux).cast("double")), "a_tok_b": here(F.size(vx).cast("double")),
    }
    plain = rows.select(*pairs.columns, *[c.cast("double").alias(n) for n, c in made.items()])
    return competition(plain, records)


def lexicon_pairs(records: DataFrame, truth: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """(pair, name_a, name_b) of true matches to learn a lexicon from, leaving out the S1 entities in ``without``."""
    kept = truth if without is None else truth.join(without.select("source1_entity_id"), "source1_entity_id", "left_anti")
    a = records.select(F.col("entity_id").alias("source1_entity_id"), F.col("name_n").alias("name_a"))
    b = records.select(F.col("entity_id").alias("cand_id"), F.col("name_n").alias("name_b"))
    return kept.distinct().join(a, "source1_entity_id").join(b, "cand_id").select(F.concat_ws("|", "source1_entity_id", "cand_id").alias("pair"), "name_a", "name_b")


def block_report(found: DataFrame, truth: DataFrame, records: DataFrame) -> DataFrame:
    """Per country and source: queries, pool, pairs, recall and reduction ratio of retrieved candidates."""
    source = lambda c: F.substring(c, 1, 2).alias("source")
    one, pool = records.where(F.col("entity_id").startswith("S1-")), records.where(~F.col("entity_id").startswith("S1-"))
    own = one.select(F.col("entity_id").alias("source1_entity_id"), "country")
    asked = own.groupBy("country").agg(F.count(F.lit(1)).alias("n_queries"))
    there = pool.groupBy("country", source("entity_id")).agg(F.count(F.lit(1)).alias("n_pool"))
    pairs = found.select("source1_entity_id", "cand_id", F.lit(1).alias("hit")).distinct()
    made = pairs.join(own, "source1_entity_id").groupBy("country", source("cand_id")).agg(F.count(F.lit(1)).alias("n_pairs"))
    true = truth.distinct().join(pairs, ["source1_entity_id", "cand_id"], "left").join(own, "source1_entity_id").groupBy("country", source("cand_id")).agg(F.count(F.lit(1)).alias("n_truth"), F.count("hit").alias("n_found"))
    rows = there.join(asked, "country").join(made, ["country", "source"], "left").join(true, ["country", "source"], "left").na.fill(0, ["n_pairs", "n_truth", "n_found"])
    return rows.select("country", "source", "n_queries", "n_pool", "n_pairs", "n_truth", F.when(F.col("n_truth") > 0, F.col("n_found") / F.col("n_truth")).alias("recall"), (1 - F.col("n_pairs") / (F.col("n_queries") * F.col("n_pool"))).alias("reduction_ratio"))
