"""The record-linkage engine: hand-worked cases, and every query against its SQL."""

import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from entwyne import queries, schemas
from entwyne.functions import similarity as S
from entwyne.functions import text as X
from entwyne.functions.vocabulary import Vocabulary
from entwyne.operators import blocking, decision, metrics, mining, model, pairs, retrieval, splits, validate
from entwyne.sources import shared, tables
from entwyne.streaming.arrivals import resolve_stream

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def lists(spark, table):
    rows = [(k, v if isinstance(v, str) else ",".join(v)) for k, v in table.items()]
    return spark.createDataFrame(rows, "source1_entity_id string, ids string")


CASES = {
    "worked example": ({"a": "S2-47,S3-812"}, {"a": "S2-47,S3-193,S3-812"}, {"macro_f05": 5 / 7}),
    "singleton left empty": ({"a": ""}, {"a": ""}, {"macro_f05": 1.0, "singleton_accuracy": 1.0}),
    "singleton matched": ({"a": ""}, {"a": "S2-1"}, {"macro_f05": 0.0, "singleton_accuracy": 0.0}),
    "matches missed": ({"a": "S2-1"}, {"a": ""}, {"macro_f05": 0.0}),
    "rows missing": ({"a": "S2-1", "b": ""}, {}, {"macro_f05": 0.5, "n_entities": 2}),
    "perfect": ({"a": "S2-1,S3-2", "b": ""}, {"a": "S3-2,S2-1"}, {"macro_f05": 1.0}),
    "repeated ids": ({"a": "S2-1"}, {"a": "S2-1, S2-1,,"}, {"macro_f05": 1.0, "n_predicted": 1}),
    "five of five": ({"a": ",".join(f"S2-{i}" for i in range(5))}, {"a": ",".join(f"S2-{i}" for i in range(5))}, {"macro_f05": 1.0, "tp": 5}),
    "half precise": ({"a": "S2-1"}, {"a": "S2-1,S2-2"}, {"macro_f05": 5 / 9}),
    "half recalled": ({"a": "S2-1,S2-2"}, {"a": "S2-1"}, {"macro_f05": 5 / 6}),
    "macro is not micro": ({"big": ",".join(f"S2-{i}" for i in range(100)), "small": ""}, {"big": ",".join(f"S2-{i}" for i in range(100)), "small": "S3-1"}, {"macro_f05": 0.5, "micro_precision": 100 / 101}),
    "counters": ({"a": "S2-1,S2-2", "b": "", "c": "S3-9"}, {"a": "S2-1,S2-3", "b": "S2-7"}, {"tp": 1, "fp": 2, "fn": 2, "macro_f05": 0.5 / 3, "singleton_accuracy": 0.0}),
    "outside the universe": ({"a": "S2-1"}, {"a": "S2-1", "zz": "S2-5"}, {"macro_f05": 1.0, "n_predicted": 1}),
}


def test_metric_cases(spark):
    for name, (truth, predicted, want) in CASES.items():
        t = lists(spark, truth)
        p = lists(spark, predicted)
        got = metrics.evaluate(metrics.pairs_of(t, "ids"), metrics.pairs_of(p, "ids"), t.select("source1_entity_id")).first()
        for k, v in want.items():
            assert got[k] == pytest.approx(v), (name, k)


def test_no_singletons_no_accuracy(spark):
    t = lists(spark, {"a": "S2-1"})
    assert metrics.evaluate(metrics.pairs_of(t, "ids"), metrics.pairs_of(t, "ids"), t.select("source1_entity_id")).first().singleton_accuracy is None


def test_names_and_addresses(spark):
    rows = [("carneybryant.com", "23404b 2nd ave, Bombay"), ("Bryánt", "second st null 007"), ("Prabhav Business Center", ""), ("LLC Ltd", "Unit"), (None, None), ("हिन्दी & Co", "क्")]
    df = spark.createDataFrame([(f"S1-{i}", a, b, "Fránce ") for i, (a, b) in enumerate(rows)], "entity_id string, business_name string, business_address string, country string")
    v = {r.entity_id: r for r in X.normalise(df).collect()}
    assert (v["S1-0"].nm_full, v["S1-0"].nm_compact, v["S1-1"].nm_core) == ("carneybryant", "carneybryant", "bryant")
    assert (v["S1-2"].nm_full, v["S1-2"].nm_core) == ("prabhav business center", "prabhav")
    assert v["S1-3"].nm_core == "llc limited"
    assert v["S1-0"].ad_full == "23404 b 2 avenue mumbai" and v["S1-0"].ad_num == "23404 2" and v["S1-0"].ad_alpha == "b avenue mumbai"
    assert v["S1-1"].ad_full == "2 street 007" and v["S1-1"].ad_num == "2 7"
    assert v["S1-3"].ad_core == "unit" and v["S1-4"].nm_full == v["S1-4"].ad_full == ""
    assert v["S1-5"].nm_full == "hindi and co" and v["S1-5"].ad_full == "k" and v["S1-5"].ctry == "france"
    assert v["S1-0"].nm_skel == "crnybrynt" and tuple(df.columns) == tuple(f.name for f in schemas.RECORD)
    names = df.select("entity_id", X.name_view(F.col("business_name")).alias("n")).collect()
    assert names[0].n.was_domain and not names[2].n.was_domain
    own = Vocabulary.from_json('{"name_noise": ["prabhav"]}')
    assert X.normalise(df, own).where("entity_id = 'S1-2'").first().nm_core == "business center"


def test_accents_follow_unicode(spark):
    import unicodedata

    text = "Ærøskøbing Ångström naïve Čapek ộ ﬁ ß İ é " + "é한"
    want = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)))
    assert spark.range(1).select(X.strip_accents(F.lit(text))).first()[0] == want


def test_kernels():
    assert S.indel("abc", "abd") == pytest.approx(4 / 6) and S.indel("", "") == 1.0 and S.indel("a", "") == 0.0
    assert S.token_sort("new york mets", "mets york new") == 1.0
    assert S.token_set("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1.0 and S.token_set("", "a") == 0.0
    assert S.token_set("a b c", "a b d") == pytest.approx(2 * 4 / 10)
    assert S.partial("abcd", "xxabcdyy") == 1.0 and S.partial("", "abc") == 0.0
    assert S.partial("abxd", "zzabcdzz") == pytest.approx(6 / 8)
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-5) and S.jaro_winkler("", "a") == 0.0
    assert S.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.813333, abs=1e-5)


def test_lcs_equals_dynamic_programming():
    import random

    rnd = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 14))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        assert S.lcs(a, b) == row[-1], (a, b)


def test_partial_equals_all_windows():
    import random

    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(1, n))) for n in (5, 9))
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        m = len(short)
        every = [long[max(0, e - m) : min(e, len(long))] for e in range(1, len(long) + m)]
        assert S.partial(a, b) == pytest.approx(max(S.indel(short, w) for w in every)), (a, b)


def test_text_functions(spark):
    df = spark.createDataFrame([("ltd", "limited"), ("abc", "acb"), ("a", "ab"), ("zz", "zz"), ("8465", "846")], "a string, b string")
    got = df.select(X.is_abbreviation(F.col("a"), F.col("b")).alias("x"), S.prefix_similarity(F.col("a"), F.col("b")).alias("p"), S.postfix_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.x for r in got] == [True, False, False, False, True]
    assert got[4].p == pytest.approx(3 / 4) and got[4].s == 0.0 and got[3].p == 1.0
    assert spark.range(1).select(X.id_set(F.lit(" S2-1, S2-1,,S3-2 "))).first()[0] == ["S2-1", "S3-2"]


def test_posting_cap_and_families(spark):
    rows = [("S1-1", "red widget works", "1 oak road"), *[(f"S2-{i}", "red widget works", f"{i} oak road") for i in range(6)], ("S2-99", "blue widget works", "1 oak road")]
    v = X.normalise(spark.createDataFrame([(*r, "us") for r in rows], "entity_id string, business_name string, business_address string, country string"))
    q, pool = v.where("entity_id like 'S1%'"), v.where("entity_id like 'S2%'")
    only = lambda **kw: {r.cand_id for r in blocking.candidates(q, pool, blocking.BlockingConfig(**kw)).collect()}
    assert only(families=frozenset({"b1"})) == {f"S2-{i}" for i in range(6)}
    assert only(families=frozenset({"b1"}), max_posting=5) == set()
    assert only(families=frozenset({"b7"})) == set()
    assert "S2-99" in only(families=frozenset({"b5"}))


def test_matches_that_are_no_candidates_are_missed_without_a_cap(spark):
    pair = "source1_entity_id string, cand_id string"
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "source1_entity_id string")
    truth = spark.createDataFrame([("a", "S2-1"), ("a", "S2-2"), ("a", "S3-9"), ("b", "S2-3")], pair)  # S3-9 and S2-3 are no candidates
    found = spark.createDataFrame([("a", "S2-1", 3), ("a", "S2-5", 2), ("a", "S2-2", 1)], f"{pair}, n_keys int")
    got = {r.k: r for r in blocking.cap_sweep(found, truth, ids, 6, (1, 0)).collect()}
    assert (got[1].recall, got[1].n_pairs, got[0].recall, got[0].n_pairs) == (1 / 4, 1, 2 / 4, 3)
    assert got[0].ceiling == pytest.approx((1.25 * (2 / 3) / (0.25 + 2 / 3) + 0 + 1) / 3)
    whole = blocking.evaluate(found, truth, ids, 6).first()
    assert (got[0].recall, got[0].ceiling) == (whole.pair_recall, pytest.approx(whole.ceiling))


def test_recall_at_k_counts_only_candidates(spark):
    pair = "source1_entity_id string, cand_id string"
    ids, truth = spark.createDataFrame([("a",)], "source1_entity_id string"), spark.createDataFrame([("a", "S2-1"), ("a", "S3-9")], pair)
    scored = spark.createDataFrame([("a", "S2-0", 0.5), ("a", "S2-1", 0.5)], f"{pair}, rr_score double")  # equal scores go by id; S3-9 is no candidate
    got = {r.k: (r.recall, r.avg_candidates) for r in blocking.recall_at(scored, truth, ids, "rr_score", (1, 2, 0)).collect()}
    assert got == {1: (0.0, 1.0), 2: (0.5, 2.0), 0: (0.5, 2.0)}


def test_rules(spark):
    rows = [("a", "S2-1", 0.9, 0.1), ("a", "S3-1", 0.86, 0.9), ("a", "S2-2", 0.3, 0.9), ("b", "S3-9", 0.4, 0.0), ("c", "S2-5", 0.7, 0.8)]
    df = spark.createDataFrame(rows, "source1_entity_id string, cand_id string, p double, rr_score double")
    kept = lambda **kw: sorted(r.cand_id for r in decision.apply(df, decision.Rule(**kw)).collect())
    assert kept(t_s2=0.5, t_s3=0.5) == ["S2-1", "S2-5", "S3-1"]
    assert kept(t_s2=0.5, t_s3=0.88) == ["S2-1", "S2-5"]
    assert kept(rel_margin=0.99) == ["S2-1", "S2-5"] and kept(min_best=0.8) == ["S2-1", "S3-1"] and kept(gap_min=0.5) == ["S2-5"]
    assert kept(t_s2=0.95, t_s3=0.95, min_best=0.99, override_rr=0.74, override_p=0.65) == ["S2-5", "S3-1"]
    assert kept(count_bumps=((0, 0.3),)) == ["S2-1", "S3-1"] and kept(max_k=1) == ["S2-1", "S2-5"]
    truth = spark.createDataFrame([("a", "S2-1"), ("c", "S2-5")], "source1_entity_id string, cand_id string")
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "source1_entity_id string")
    rule, score = decision.search(df, truth, ids, [0.3, 0.5, 0.88], [0.1], [0.99])
    assert score == pytest.approx(metrics.evaluate(truth, decision.apply(df, rule), ids).first().macro_f05) == 1.0


def test_splits(spark):
    ids = spark.createDataFrame([(f"S1-{i}", "us" if i % 3 else "fr") for i in range(300)], "source1_entity_id string, ctry string")
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{i}-{k}") for i in range(0, 300, 2) for k in range(i % 5)], "source1_entity_id string, cand_id string")
    folds = splits.assign_folds(ids, truth, 60, 90).persist()
    n = {r.fold: r.n for r in splits.summary(folds).collect()}
    assert sum(n.values()) == 300 and abs(n["dev"] - 60) <= 8 and abs(n["val"] - 90) <= 8
    assert splits.assign_folds(ids.repartition(3), truth, 60, 90).exceptAll(folds).isEmpty()
    assert splits.country_fold(folds, "fr").count() == 100


def test_mining(spark):
    rows = [(i, "acme limited".split(), "acme ltd".split()) for i in range(6)] + [(10 + i, "big bank".split(), "big bank inc".split()) for i in range(4)] + [(20, ["x", "x"], ["x"])]
    diff = mining.token_diff(spark.createDataFrame(rows, "pair int, l array<string>, r array<string>"), "l", "r").persist()
    stats = {r.tok: tuple(r)[1:] for r in mining.token_stats(diff).collect()}
    assert stats["acme"] == (6, 0, 0, 6) and stats["ltd"] == (0, 0, 6, 0) and stats["inc"] == (0, 0, 4, 0) and stats["x"] == (1, 1, 0, 1)
    small = mining.MiningConfig(min_support=3, noise_min_n=1, noise_min_df=1, added_min=3)
    table = mining.resolve(mining.aliases(diff, small))
    assert table == {"ltd": "limited"}
    assert {r.tok for r in mining.unstable_tokens(mining.token_stats(diff), list(table), small).collect()} == {"inc", "limited", "x"}
    kinds = {r.tok: r.kind for r in mining.noise_by_injection(mining.token_stats(diff), [], 11, min_n=1, min_added=1).collect()}
    assert kinds == {"inc": "injected", "ltd": "injected", "limited": "injected"}  # never kept nor added counts as injected
    assert mining.gate(["llc"], ["good"], ["inc"]) == ["noise lacks inc"]


def test_validator(spark):
    lines = ["source1_entity_id\tmatched_entity_ids", "S1-1\tS2-1,S2-1", "S1-1\tS1-2", "no tab", "S1-3\tX9,S2-77", "S1-9\t"]
    df = spark.createDataFrame(list(enumerate(lines)), "at long, value string")
    s1, known = spark.createDataFrame([("S1-1",), ("S1-3",), ("S1-4",)], "id string"), spark.createDataFrame([("S2-1",), ("S1-2",), ("X9",)], "id string")
    got = {(r.rule, r.offender) for r in validate.list_offences(df, "matched_entity_ids", s1, known).collect()}
    assert got == {("duplicate row", "S1-1"), ("repeated id", "S1-1"), ("own source", "S1-2"), ("tab", "no tab"), ("prefix", "X9"), ("unknown id", "S2-77"), ("missing", "S1-4"), ("extra", "S1-9")}
    bad = spark.createDataFrame([(0, "id,matches")], "at long, value string")
    assert {r.rule for r in validate.list_offences(bad, "matched_entity_ids", s1).collect()} == {"header", "missing"}


def test_files(spark, tmp_path):
    path = f"{tmp_path}/train_source1.tsv"
    with open(path, "w") as f:
        f.write('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"Quoted" Ltd\t\tFrance\n')
    row = tables.load(spark, str(tmp_path), "train", 1).first()
    assert (row.business_name, row.business_address) == ('"Quoted" Ltd', "")
    os.remove(path)
    assert tables.load(spark, str(tmp_path), "train", 1).count() == 1
    ids = spark.createDataFrame([("S1-1",), ("S1-2",)], "source1_entity_id string")
    found = spark.createDataFrame([("S1-1", "S3-2"), ("S1-1", "S2-9"), ("S1-1", "S2-9")], "source1_entity_id string, cand_id string")
    tables.write_submission(found, found, ids, f"{tmp_path}/out")
    back = {r.source1_entity_id: r.ids for r in tables.read_id_lists(spark, f"{tmp_path}/out/matches").collect()}
    assert back["S1-1"] == ["S2-9", "S3-2"]
    tables.write_ids(ids, f"{tmp_path}/ids")
    assert {r[0] for r in tables.read_ids(spark, f"{tmp_path}/ids").collect()} == {"S1-1", "S1-2"}
    own = Vocabulary(name_alias={"x": "y"})
    tables.write_vocabulary(spark, own, f"{tmp_path}/vocabulary")
    assert tables.read_vocabulary(spark, f"{tmp_path}/vocabulary") == own and tables.read_vocabulary(spark, f"{tmp_path}/none") == Vocabulary()


def test_second_normaliser(spark):
    df = spark.createDataFrame([("Acme Corp. & Bros.com", "12th Main St, New York no 5"), (None, None)], "n string, a string")
    got = df.select(retrieval.second_name(F.col("n")).alias("n"), retrieval.second_address(F.col("a")).alias("a")).collect()
    assert got[0].n == "acme corporation and brothers" and got[0].a == "12 main street ny 5" and got[1].n == ""
    matched = spark.createDataFrame([(1, "ram traders", "राम traders"), (2, "ram foods", "राम foods"), (3, "sita foods", "सीता foods")], "pair int, name_a string, name_b string")
    lexicon = retrieval.learn_lexicon(matched)
    assert {r.token: r.latin for r in lexicon.collect()} == {"राम": "ram", "सीता": "sita"}
    names = spark.createDataFrame([("S2-1", "राम shop")], "entity_id string, name_n string")
    assert retrieval.apply_lexicon(names, lexicon).first().name_n == "ram shop"


def test_sums_of_weights_are_exact(spark):
    rnd = random.Random(43)
    words = [f"word{chr(97 + i)}{i}" for i in range(12)]
    shuffled = lambda: " ".join(rnd.sample(words[:8], 8))
    same = [(f"S{1 + i % 3}-{i}", "fr", shuffled(), shuffled()) for i in range(30)]  # equal but for the order of words
    rest = [(f"S{1 + i % 3}-{i}", "fr", " ".join(rnd.sample(words, 5)), " ".join(rnd.sample(words, 5))) for i in range(30, 75)]
    own = spark.createDataFrame(same + rest, "entity_id string, country string, name_n string, addr_n string")
    keyed = [tuple(r) for r in retrieval.weighted_keys(own, 300).select("entity_id", "field", "key").collect()]
    held = Counter(k for _, _, k in keyed)
    weight = {r.n: r.w for r in spark.createDataFrame([(n,) for n in set(held.values())], "n long").select("n", F.pow(F.ln(len(same + rest) / F.col("n")), 2).alias("w")).collect()}
    keys = {e: {(f, k) for x, f, k in keyed if x == e} for e in {x for x, _, _ in keyed}}
    got = {(r.source1_entity_id, r.cand_id): r for r in retrieval.top_candidates(own, k=75).collect()}
    assert len(got) > 1000
    for (a, b), r in got.items():
        shared = [(f, weight[held[k]]) for f, k in keys[a] & keys[b] if held[k] >= 2]
        assert (r.sn, r.sa, r.s_tot) == (math.fsum(w for f, w in shared if f == "n"), math.fsum(w for f, w in shared if f == "a"), math.fsum(w for _, w in shared))
    equal = {e for e, *_ in same}
    assert len({r.s_tot for (a, b), r in got.items() if a in equal and b in equal}) == 1


def test_features_model_and_stream(spark, tmp_path):
    rows = [(f"S1-{i}", f"firm number{i} alpha{i % 7}", f"{i} oak road", "us") for i in range(40)] + [(f"S2-{i}", f"firm number{i} alpha{i % 7}" + (" inc" if i % 2 else ""), f"{i} oak rd", "us") for i in range(40)]
    df = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")
    v = X.normalise(df).persist()
    q, pool = v.where("entity_id like 'S1%'"), v.where("entity_id like 'S2%'")
    cand = pairs.rerank_top(blocking.candidates(q, pool), q, pool, 5).persist()
    assert all(0 <= r.rr_score <= 1 + 1e-9 for r in cand.collect())
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{i}") for i in range(40)], "source1_entity_id string, cand_id string")
    full, names = pairs.features(pairs.attach(pairs.label(pairs.add_context(cand), truth), q, pool))
    assert len(names) == 62 and not set(names) - set(full.columns)
    names = names + list(schemas.CONTEXT)
    full = full.persist()
    fitted = model.fit(full, names)
    scored = model.score(full, fitted, names)
    top = {r.source1_entity_id: r.cand_id for r in blocking.top(scored.select("source1_entity_id", "cand_id", "p"), F.col("p"), 1).collect()}
    assert sum(top[f"S1-{i}"] == f"S2-{i}" for i in range(40)) >= 38
    model.save(fitted, f"{tmp_path}/model")
    assert len(model.importances(model.load(f"{tmp_path}/model"))) == 71
    with pytest.raises(ValueError):
        model.score(full, fitted, names[::-1])
    df.where("entity_id like 'S1%'").write.parquet(f"{tmp_path}/in")
    arriving = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    resolve_stream(arriving, pool, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() >= 30


@pytest.fixture(scope="module")
def oracle():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return con


@pytest.mark.parametrize("name", ["normalised_views", "blocking_keys", "blocking_evaluation", "context_features", "pair_features_native", "spelling_similarity", "decision_rule", "official_metrics", "stratified_folds", "mined_token_stats"])
def test_query_equals_sql(spark, oracle, name):
    want = oracle.execute(queries.SQL[name]).df()
    got = queries.QUERIES[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    clean = lambda df: sorted(tuple(None if x is None or x != x else round(float(x), 6) if isinstance(x, int | float) or re.fullmatch(r"(int|float|bool|uint)\d*", type(x).__name__) else x for x in row) for row in df[sorted(df.columns)].itertuples(index=False))
    assert clean(got) == clean(want)


LETTERS = "translate({}, '0123456789', 'bcdfghjklm')"
TABLES = {
    # 640 true matches of 640 entities, 41 of them candidates: 41 / 640 is 0.0640625.
    "a last 5 in the seventh digit": f"""SELECT 3 * i + s AS page_id, 'https://' || {LETTERS.format("s || 'x' || i || 'x'")} || '/' AS url, '<html lang="en"><head><title>'
      || {LETTERS.format("CASE WHEN s = 1 AND i >= 41 THEN 'z' ELSE '' END || i || 'q' || i")} || '</title></head><article>text ' || i || '</article></html>' AS html FROM range(640) a(i), range(2) b(s)""",
    "rows that stand twice": "SELECT * FROM {pages} UNION ALL SELECT * FROM {pages} WHERE page_id < 40",
    "other pages of the same id": "SELECT * FROM {pages} UNION ALL SELECT page_id, url || '/v2', replace(html, '<title>', '<title>zz ') FROM {pages} WHERE page_id BETWEEN 10 AND 40",
    # 160 records with the same name, each there twice: 320 rows, but no more than 160 of 300 postings.
    "postings of rows that stand twice": """SELECT i AS page_id, 'https://w/' AS url, '<html lang="en"><head><title>same name</title></head><article>text ' || i % 80 || '</article></html>' AS html FROM range(240) a(i), range(2)""",
}


@pytest.mark.parametrize("table", TABLES)
def test_recall_at_k_equals_sql(spark, tmp_path, table):
    import duckdb

    con = duckdb.connect()
    con.execute(f"COPY ({TABLES[table].replace('{pages}', repr(f'{DATA}/pages.parquet'))}) TO '{tmp_path}/pages.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    got = [tuple(r) for r in queries.QUERIES["recall_at_k"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.execute(queries.SQL["recall_at_k"]).fetchall())


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["source1_entity_id", "cand_id", "n_keys"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_lanes_equal_scalar_kernels():
    rnd = random.Random(41)
    for letters, most in (("ab ", 10), ("abcdefgh 12", 80), ("aé漢\U0001f600 b", 20)):
        word = lambda n: "".join(rnd.choice(letters) for _ in range(n))  # noqa: B023, E731
        a = [word(rnd.randint(0, most)) for _ in range(150)]
        b = [x[rnd.randint(0, 3) :] + word(2) if rnd.random() < 0.4 else word(rnd.randint(0, most)) for x in a]
        for name, lanes in S.KERNELS.items():
            want = [getattr(S, name)(x, y) for x, y in zip(a, b, strict=True)]
            assert max(abs(g - w) for g, w in zip(lanes(a, b).tolist(), want, strict=True)) < 1e-12, name
        assert all(len(lanes([], [])) == 0 for lanes in S.KERNELS.values())


def test_ranks_and_percentiles(spark):
    rnd = random.Random(42)
    rows = [(round(rnd.random() ** 4, 2), int(rnd.random() < 0.3)) for _ in range(700)]
    df = spark.createDataFrame(rows, "p double, y int")
    got = metrics.percentiles(df, "p", {"a": 0.0, "b": 0.37, "c": 0.99, "d": 1.0}).first()
    values = sorted(p for p, _ in rows)
    for name, q in (("a", 0.0), ("b", 0.37), ("c", 0.99), ("d", 1.0)):
        at = (len(values) - 1) * q
        low = int(at)
        want = values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)
        assert abs(got[name] - want) < 1e-9
    assert metrics.percentiles(df.limit(0), "p", {"a": 0.5}).first().a is None
    better = sum((p > q) + (p == q) / 2 for p, y in rows if y for q, z in rows if not z)
    n_pos = sum(y for _, y in rows)
    check = {r.part: r for r in metrics.fit_check(df, df.where("p < 0.5")).collect()}
    assert abs(check["seen"].auc - better / n_pos / (len(rows) - n_pos)) < 1e-9 and check["held out"].n < len(rows)


def test_stage_tables_follow_their_input(spark, tmp_path):
    path, built = f"{tmp_path}/in", []

    def build():
        built.append(1)
        return spark.read.parquet(path)

    spark.range(3).write.parquet(path)
    assert shared.kept(spark, path, "x", build).count() == 3 and shared.kept(spark, path, "x", build).count() == 3 and len(built) == 1
    spark.range(5).write.mode("overwrite").parquet(path)
    assert shared.kept(spark, path, "x", build).count() == 5 and len(built) == 2
    one = shared.materialise(spark.range(2), "t")
    shared.discard(one, spark.range(1))
    assert not os.path.exists(one._entwyne_path.removeprefix("file://"))


def test_reports(spark, tmp_path):
    rows = [("S1-1", "fr", "a b", "x"), ("S1-2", "fr", "c", ""), ("S2-1", "fr", "a é", ""), ("S3-1", "fr", "d", "y"), ("S2-2", "us", "e", "z")]
    own = spark.createDataFrame(rows, "entity_id string, country string, name_n string, business_address string")
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S3-1"), ("S1-2", "S2-1")], "source1_entity_id string, cand_id string")
    found = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S3-1")], truth.schema)
    got = {(r.country, r.source): (r.n_queries, r.n_pool, r.n_pairs, r.n_truth, r.recall) for r in retrieval.block_report(found, truth, own).collect()}
    assert got == {("fr", "S2"): (2, 1, 1, 2, 0.5), ("fr", "S3"): (2, 1, 1, 1, 0.0)}
    miss = {(r.dimension, r.value): r.recall for r in metrics.miss_diagnosis(truth, found, own.selectExpr("entity_id", "name_n business_name", "business_address", "country ctry")).collect()}
    assert miss["all", "all"] == 1 / 3 and miss["source", "S3"] == 0 and miss["non-ASCII name", "true"] == 0.5 and miss["missing address", "true"] == 0.5
    pairs_ = retrieval.lexicon_pairs(own, truth, spark.createDataFrame([("S1-2",)], "source1_entity_id string"))
    assert sorted((r.name_a, r.name_b) for r in pairs_.collect()) == [("a b", "a é"), ("a b", "d")]
    assert {r.entity_id for r in splits.subset(own, 2).collect()} == {r.entity_id for r in splits.subset(own.repartition(3), 2).collect()}
    tables.write_table(found.orderBy("cand_id"), f"{tmp_path}/md")
    assert "".join(r.value + "\n" for r in spark.read.text(f"{tmp_path}/md").collect()).startswith("|source1_entity_id|cand_id|\n|-|-|\n|S1-1|S2-1|")
    with pytest.raises(ValueError):
        tables.write_table(found, f"{tmp_path}/md", most=1)
    with pytest.raises(ValueError):
        mining.resolve(spark.createDataFrame([("a", "b", 2), ("c", "d", 1)], "alias string, canonical string, n long"), most=1)
