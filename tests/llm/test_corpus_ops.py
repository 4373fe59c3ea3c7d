"""Corpus operators against brute force, on awkward rows and on the small tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from entwyne.llm import bpe, chunkdup, decontam, html, linedup, neardup, pii, quality, toxicity, wavelet  # noqa: E402

P50, MULTI = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sigma tau ups phi chi psi omega".split()


def words_text(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Null and empty texts, null ids, repeated rows, very long and odd texts, clashing extra columns."""
    rnd = random.Random(5)
    base = words_text(rnd, 120)
    texts = [None, "", " ", "a", "x" * 5000, "\n\n", base, base, base + " tail", "Tab\tand\x0bmore\r\nlines", "héllo wörld  漢字 \U0001f600 " * 9, words_text(rnd, 9000)]
    rows = [(i, t, "en" if i % 2 else None, None, None) for i, t in enumerate(texts)]
    rows += [(6, base, "en", "again", 1), (None, base, "en", None, 3), (None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, hash string, key string, digest string"
    return spark.createDataFrame([(*r, "h", "k", "d") for r in rows], schema), rows


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


def test_wavelet_structure():
    rnd = np.random.default_rng(1)
    seq = rnd.integers(0, 50257, 300_000).astype(np.uint16)
    seq[::3] = 7
    shard = wavelet.WaveletShard.from_bytes(wavelet.WaveletShard.build(seq, [1, None], [100_000, 200_000], 16).to_bytes())
    assert (shard.tokens() == seq).all()
    for i in rnd.integers(0, len(seq), 30).tolist():
        assert shard.access(i) == seq[i]
    for token in (7, int(seq[1]), 60000):
        where = np.flatnonzero(seq == token)
        assert shard.count(token) == len(where)
        assert shard.count(token, 1000, 70_001) == ((where >= 1000) & (where < 70_001)).sum()
        for k in {0, len(where) // 2, len(where) - 1} if len(where) else ():
            assert shard.select(token, k) == where[k]
    rare = int(seq[4])
    assert shard.occurrences(rare) == np.flatnonzero(seq == rare).tolist()
    empty = wavelet.WaveletShard.from_bytes(wavelet.WaveletShard.build(np.empty(0, np.uint16), [], [], 16).to_bytes())
    assert empty.n == 0 and empty.count(3) == 0 and len(empty.tokens()) == 0


def test_wavelet_documents(spark, awkward, nothing):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P50)
    df, rows = awkward
    rows = [(*r, "h", "k", "d") for r in rows] + [(40, "hi <|endoftext|> there<|endoftext|>", *[None] * 6), (41, "a  <|endoftext|>  b <|endoftext", *[None] * 6)]
    df = spark.createDataFrame(rows, df.schema)
    got = wavelet.token_shards(df, P50, shard_tokens=3000).orderBy("start").collect()
    want = []
    for r in rows:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want.append((r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == sorted(r.doc_id if r.doc_id is not None else -1 for r in got)
    assert wavelet.token_shards(nothing, P50).count() == 0


def test_bpe_against_library(spark, awkward, nothing):
    import tiktoken

    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.TextCoder.at(MULTI, public_tokenizers.PATTERN)
    rnd = random.Random(2)
    letters = list("ab'sd ll  \n\t\r\x1c\x85\xa0 é漢1２.,!<|>x\U0001f600")
    for _ in range(800):
        s = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))
        assert coder.encode(s) == enc.encode_ordinary(s), repr(s)
    for s in ("a" * 300, "ab" * 4000, " " * 900 + "a", "!?" * 200, "é" * 300):
        assert coder.encode(s) == enc.encode_ordinary(s)
    df, rows = awkward
    got = sorted((tuple(r) for r in bpe.round_trip(df, MULTI, public_tokenizers.PATTERN).collect()), key=repr)
    want = []
    for r in rows:
        ids = enc.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.round_trip(nothing, MULTI, public_tokenizers.PATTERN).count() == 0
    ids = bpe.encode_column(MULTI, public_tokenizers.PATTERN)(df["text"])
    back = df.select("text", bpe.decode_column(MULTI, public_tokenizers.PATTERN)(ids).alias("b")).collect()
    assert all(bytes(r.b).decode() == (r.text or "") for r in back)


def _line_truth(rows, min_docs):
    strip = lambda s: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", s)
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), strip(s))
    seen = defaultdict(set)
    for k, (_, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            seen[key(line)].add(k)
    hot = {x for x, v in seen.items() if x and len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in hot]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("kw", [{}, {"broadcast_keys": 0}, {"slots": 1 << 6}])
def test_lines(spark, nothing, kw):
    rnd = random.Random(3)
    pool = ["Common LINE ", "  common line", "Ünïcode", "\x0bodd\t", "", "once"] + [f"line {i}" for i in range(30)]
    rows = [(i if i % 9 else None, None if i == 4 else "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 7)))) for i in range(90)]
    rows += [(3, rows[3][1]), (3, rows[3][1])]
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, line string, digest string, n long")
    got = sorted((tuple(r) for r in linedup.line_report(df, 10, 1, **kw).collect()), key=repr)
    assert got == _line_truth(rows, 10)
    assert linedup.line_report(nothing, 10, 1).count() == 0
    whole = linedup.drop_frequent_lines(df, 10, **kw)
    assert whole.columns[:5] == df.columns and whole.count() == len(rows)
    assert whole.where("text is null").count() == 1


def test_lines_keep_first(spark):
    df = spark.createDataFrame([(5, "a\nshared"), (2, "Shared \nb"), (9, "shared")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in linedup.drop_frequent_lines(df, 2, keep_first=True).collect()}
    assert got == {5: "a", 2: "Shared \nb", 9: ""}


def _contamination_truth(docs, items, size):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for i, t in docs:
        w, hit, found = fold(t), set(), set()
        for item, text in items:
            own = fold(text)
            wins = [own[k : k + size] for k in range(max(1, len(own) - size + 1))] if own else []
            for win in wins:
                for k in range(len(w) - len(win) + 1):
                    if w[k : k + len(win)] == win:
                        hit.update(range(k, k + len(win)))
                        found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [100_000, 3])
def test_contamination(spark, nothing, block):
    rnd = random.Random(4)
    items = [(k, " ".join(rnd.choice("a b c d É".split()) for _ in range(n))) for k, n in enumerate([1, 2, 3, 5, 7, 12, 0, 6])] + [(50, None), (51, "Q7"), (11, "a B, c")]
    docs = [(i, None if i == 3 else "-".join(rnd.choice("A b c d É q7 zz".split()) for _ in range(rnd.randint(0, 60)))) for i in range(40)]
    docs += [docs[1], (None, docs[2][1])]
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontam.contamination(df, bench, window=5, block_windows=block).collect()), key=repr)
    assert got == _contamination_truth(docs, items, 5)
    clean = decontam.clean(df, bench, window=5, block_windows=block)
    assert clean.columns == df.columns and clean.count() == sum(not x[-1] for x in got)
    assert decontam.contamination(nothing, bench).count() == 0
    assert decontam.contamination(df, spark.createDataFrame([], "item_id long, text string")).where("contaminated").count() == 0


def _near_truth(rows, percent, size):
    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sets = []
    for _, t in rows:
        w = low(t)
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                    up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    out = [(i, len(sets[k]), least[root(k)] if i is not None else None, i is None or least[root(k)] == i) for k, (i, _) in enumerate(rows)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("percent", "size", "block"), [(85, 3, 8192), (80, 5, 8192), (80, 5, 4)])
def test_near_duplicates(spark, awkward, nothing, percent, size, block):
    rnd = random.Random(6)
    rows = [(i, t) for i, t, *_ in awkward[1]]
    for g in range(6):
        own = words_text(rnd, 80).split()
        for k in range(8):
            copy = list(own)
            for _ in range(rnd.randint(0, 6)):
                copy[rnd.randrange(len(copy))] = "Edit" + str(rnd.random())
            rows.append((100 + g * 10 + k, " ".join(copy)))
    chain = words_text(rnd, 200).split()
    for k in range(12):  # a chain: neighbours are linked, ends are not
        rows.append((300 - k, " ".join(chain[k * 5 : k * 5 + 110])))
    base = words_text(rnd, 60).split()
    for k in range(25):  # near copies of one text, at about the least similarity that links
        copy = list(base)
        for _ in range(rnd.randint(1, 4)):
            copy[rnd.randrange(len(copy))] = f"e{k}x{rnd.randrange(3)}"
        rows.append((400 + k, " ".join(copy)))
    one, two = words_text(rnd, 90), words_text(rnd, 90)
    shared = [(501, one), (505, one + " tail"), (505, two), (509, two + " tail"), (505, two)]  # one doc_id, several texts
    rows += shared
    rnd.shuffle(rows)
    df = spark.createDataFrame([(i, t, "c", "b") for i, t in rows], "doc_id long, text string, component string, bands string")
    got = sorted((tuple(r) for r in neardup.near_duplicates(df, percent, size, block).collect()), key=repr)
    assert got == _near_truth(rows, percent, size)
    kept = neardup.keep_one(df, percent, size, block)
    assert kept.columns == df.columns and kept.count() == sum(x[3] for x in got)
    assert sorted(tuple(r) for r in kept.where("doc_id > 500").select("doc_id", "text").collect()) == sorted([shared[0], shared[2], shared[4]])
    assert neardup.near_duplicates(nothing).count() == 0


def test_odd_sketch_estimates():
    rnd = random.Random(7)
    a = [f"w{rnd.random()}".encode() for _ in range(400)]
    for share in (0.95, 0.8):
        b = list(a)
        b[int(400 * share) :] = [f"w{rnd.random()}".encode() for _ in range(400 - int(400 * share))]
        one, two = (neardup.odd_sketch(neardup.shingle_hashes(x, 1)) for x in (a, b))
        real = len(set(a) & set(b)) / len(set(a) | set(b))
        assert abs(neardup.similarity_estimate(int(np.bitwise_count(one ^ two).sum()), len(a) + len(b)) - real) < 0.12


def test_repeats(spark, nothing):
    rnd = random.Random(8)
    passage = words_text(rnd, 60)
    rows = [(i, words_text(rnd, 50) + f" {i} é " + (passage if i % 4 == 0 else words_text(rnd, 60)) + " " + words_text(rnd, 30)) for i in range(24)]
    rows += [(50, None), (51, ""), (None, passage), (52, "tiny"), (53, "Und " * 3000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, first string")
    got = {r.doc_id: r for r in chunkdup.report(df, slots=1 << 12).collect()}
    text = dict(rows)
    for i in text:
        if i is not None and i < 50:
            assert got[i].has_repeat == (i % 4 == 0), i
        if got[i].has_repeat:
            for span in got[i].repeat_spans.split(","):
                a, b = map(int, span.split(":"))
                assert text[i][a:b] in f" é {passage} "
            assert got[i].n_repeat_chars > 0.7 * len(passage)
            assert got[i].n_dropped_chars == (0 if i == 0 else got[i].n_repeat_chars)
    left = {r.doc_id: r.text for r in chunkdup.drop_repeats(df, slots=1 << 12).collect()}
    for i, t in text.items():
        if i is not None and got[i].has_repeat and i:
            assert len(left[i]) == len(t) - got[i].n_dropped_chars
            for span in got[i].dropped_spans.split(","):
                a, b = map(int, span.split(":"))
            assert left[i].startswith(t[: int(got[i].dropped_spans.split(":")[0])])
        else:
            assert left[i] == t
    assert chunkdup.report(nothing).count() == 0


def test_chunk_ends_against_a_byte_loop():
    rnd = random.Random(33)
    for n in (0, 5, 16, 17, 300, 3000):
        text = "".join(rnd.choice("ab é漢") if rnd.random() < 0.7 else "aaaa" for _ in range(n)).encode() + b"a" * n
        h, strict, loose = 0, set(), set()
        for k, c in enumerate(text[:-1]):
            h = ((h << 1) + int(chunkdup._GEAR[c])) & 0xFFFF
            if text[k + 1] & 0xC0 != 0x80:
                strict |= {k + 1} if h >> 12 == 0 else set()
                loose |= {k + 1} if h >> 14 == 0 else set()
        ends, last = [], 0
        while last < len(text):
            near = [k for k in range(last + 16, min(len(text), last + 129)) if k in strict]
            back = [k for k in range(last + 16, min(len(text), last + 129)) if k in loose]
            if near:
                last = near[0]
            elif len(text) - last <= 128:
                last = len(text)
            elif back:
                last = back[-1]
            else:
                last += 128
                while last < len(text) and text[last] & 0xC0 == 0x80:
                    last += 1
            ends.append(last)
        assert chunkdup.boundaries(text) == (ends if len(text) > 16 else [len(text)] if text else [])


def test_repeats_by_either_join(spark):
    rnd = random.Random(34)
    passage = words_text(rnd, 60)
    rows = [(i % 9, words_text(rnd, 20) + " " + passage + " " + words_text(rnd, 20)) for i in range(12)] + [(20, "own words only"), (20, "own words only")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    both = [sorted(tuple(r) for r in chunkdup.repeated_spans(df, slots=1 << 12, broadcast_chunks=n).collect()) for n in (300_000, 0)]
    assert both[0] == both[1] and [r[0] for r in both[0]] == list(range(9))


def test_chunks_cover_text():
    rnd = random.Random(9)
    for _ in range(60):
        s = "".join(rnd.choice("abc é漢\U0001f600") for _ in range(rnd.randint(0, 700))).encode()
        parts = chunkdup.chunks(s)
        assert b"".join(parts) == s
        for p in parts:
            p.decode()
        assert all(len(p) <= chunkdup.MOST + 3 + chunkdup.LEAST for p in parts)


def _quality_truth(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    cover = {x for v in at.values() if len(v) > 1 for i in v for x in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover)


def test_quality_counts(spark, awkward, nothing):
    df, rows = awkward
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = sorted((tuple(r) for r in quality.report(df, labels).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        c = _quality_truth(t)
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        want.append((i, *c, failed, not failed))
    assert got == sorted(want, key=repr)
    assert quality.report(nothing, labels).count() == 0
    rnd = random.Random(1)
    for _ in range(200):
        t = "".join(rnd.choice("ab  \n#\t\x0b\x1c|é") for _ in range(rnd.randint(0, 120)))
        assert quality.counts(t.encode())[:5] == _quality_truth(t), repr(t)


def test_quality_cutoffs(spark):
    rnd = random.Random(11)
    rows, labels = [], []
    for i in range(1600):
        bad = i % 5 == 0
        rows.append((i, " ".join(w + ("###" if bad and rnd.random() < 0.9 else "") for w in words_text(rnd, 30).split()), "en", None, None))
        labels.append((i, None if i == 7 else int(not bad), 0))
    docs, lab = spark.createDataFrame(rows, DOC), spark.createDataFrame([*labels, (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality.report(docs, lab).collect()}
    assert not any(kept[i] for i in range(0, 1600, 5))
    assert all(kept[i] for i in range(1600) if i % 5)
    stay = quality.keep_good(docs, lab)
    assert stay.columns == docs.columns and stay.count() == 1280
    # Too few labels certify nothing.
    few = {r.doc_id: r.kept for r in quality.report(docs, lab.limit(60)).collect()}
    assert all(few.values())


def test_binomial_tail():
    from math import comb

    for k, n, p in ((0, 10, 0.3), (3, 20, 0.02), (50, 60, 0.9), (7, 7, 0.5)):
        assert quality.binomial_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_main_text(spark):
    rnd = random.Random(12)
    nav = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in WORDS[:12])
    bodies = [f"Story {i} " + words_text(rnd, 25) for i in range(40)]
    quote = "this very line is quoted by many of the articles here"

    def page(i):
        return (f"<html><head><title>t{i}</title><script>var a='</p>';x({i})</script></head><body><div class=x1><ul>{nav}</ul></div>"
                f"<div id='cookie-notice'>We use cookies {i}</div><p>shared teaser about the host that stands on each page</p>"
                f"<div class='body'><h1>Head {i} &amp; more</h1><p>{bodies[i]}<br>x&nbsp;&#233;\n  y<p>" + (quote if i % 9 == 0 else f"last {i}") + "</div><footer>foot</footer>")  # fmt: skip

    rows = [(i, "https://Host.example/a" if i % 2 else "https://host.example/b", page(i)) for i in range(40)]
    rows += [(100, None, None), (101, "http://solo.example/", "<nav>menu</nav><article><header><h1>T</h1></header><p>a <b>b</b>c<div class=comments>bad</div><p>d</article><p>after"), (102, "x", ""), (101, "http://solo.example/", "plain text < 3 & more")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    for kw in ({}, {"group_pages": 12}, {"group_pages": 12, "broadcast_hosts": 0}):
        got = sorted(((r.page_id, r.text, r.n_chars) for r in html.main_text(df, **kw).collect()), key=repr)
        want = [(i, f"Head {i} & more\n{bodies[i]} x é y\n" + (quote if i % 9 == 0 else f"last {i}")) for i in range(40)]
        want += [(100, ""), (102, ""), (101, "T\na bc\nd"), (101, "plain text < 3 & more")]
        assert got == sorted(((i, t, len(t)) for i, t in want), key=repr)
    assert html.main_text(df.limit(0)).count() == 0


def test_shared_substrings():
    rnd = np.random.default_rng(3)
    for _ in range(20):
        pages = [rnd.integers(0, 3, rnd.integers(0, 40)).tolist() for _ in range(6)]
        ids, page = [], []
        for k, p in enumerate(pages):
            ids += [*p, -1 - k]
            page += [k] * (len(p) + 1)
        got = html.shared(np.array(ids), np.array(page), 3, 4)
        where = defaultdict(set)
        for i in range(len(ids) - 3):
            where[tuple(ids[i : i + 4])].add(page[i])
        want = np.zeros(len(ids), bool)
        for i in range(len(ids) - 3):
            if len(where[tuple(ids[i : i + 4])]) >= 3:
                want[i : i + 4] = True
        assert (got == want).all()


def test_personal_data(spark, nothing):
    texts = [
        "mail a.b@x.com, and c@d.e_f@g.h.i or bad@host then 1.2.3.4.5.6.7.8 and 300.1.1.1 999999999999.1.1.1",
        "card 4111 1111 1111 1111 and 4111-1111-1111-1112 call +1 (743) 555-3824 or +12 34 é漢 +1 2", None, "", "é" * 50 + " x@y.zz",
        "4" * 40 + "@" + "a." * 30 + "b", "1 " * 3000, "+1" + "(" * 2000, "a" * 20000, ". ".join(f"u{i}@h.com" for i in range(300)),
    ]
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def luhn(s):
        d = [int(c) for c in reversed(s)]
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0

    def base(t):
        out = []
        for k, (name, pattern) in enumerate(kinds):
            for m in re.finditer(pattern, t if len(t) < 15000 else ""):
                d = re.sub("[^0-9]", "", m[0])
                if (name == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (name == "card" and not (12 <= len(d) <= 19 and luhn(d))) or (name == "phone" and not 9 <= len(d) <= 15):
                    continue
                out.append((m.start(), k, name, m.end()))
        return ",".join(f"{n}:{a}:{b}" for a, _, n, b in sorted(out))

    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (0, texts[0])]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, base string, h string")
    got = sorted(((r.doc_id, r.base_sha256, r.spans) for r in pii.report(df).collect()), key=repr)
    want = sorted(((i, hashlib.sha256(base(t or "").encode()).hexdigest(), base(t or "")) for i, t in rows), key=repr)
    assert got == want
    assert pii.report(nothing).count() == 0


def test_disclosure(spark):
    rnd = random.Random(13)
    rows = [(i, f"The clerk Zebediah wrote from {'boss@corp.example'} about {rnd.choice(WORDS)} things") for i in range(5)]
    rows += [(10 + i, "the clerk wrote about other things " + words_text(rnd, 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    text = dict(rows)
    for i in range(5):
        terms = {text[i][int(a) : int(b)] for k, a, b in (s.split(":") for s in got[i].spans.split(",")) if k == "term"}
        assert "Zebediah" in terms and "clerk" not in terms and "The" not in terms
    assert all(got[i].n_terms == 0 for i in text if i >= 10)
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "Zebediah" not in clean[0] and "boss" not in clean[0] and "[email]" in clean[0] and clean[10] == text[10]


def test_fuzzy_lexicon():
    words = {"moron": 1.0, "worthless": 2.0, "scum": 1.5, "idiot": 1.0}
    lex = toxicity.FuzzyLexicon(words, {"vequ": 3.0}, frozenset({"oron"}))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rnd = random.Random(14)
    for _ in range(3000):
        w = list(rnd.choice(list(words)))
        for _ in range(rnd.randint(0, 3)):
            k, c = rnd.randrange(len(w) + 1), rnd.choice("aeiost0")
            w[k : k + rnd.randint(0, 1)] = [c] * rnd.randint(0, 1)
        t = "".join(w)
        if not t:
            continue
        near = {e: distance(t, e) for e in words if distance(t, e) <= toxicity.edits_allowed(len(e))}
        got = lex._read(t)
        if t.startswith("vequ"):
            continue
        if t == "oron" or not near:
            assert got is False, t
        else:
            assert got and near[got[0]] == got[1] == min(near.values()), t
    assert lex._read("veqution")[0] == "vequ" and lex._read("vequ") is not None


def test_toxicity(spark, awkward, nothing):
    rnd = random.Random(15)
    rows, labels = [], []
    for i in range(700):
        toxic = i % 4 == 0
        t = words_text(rnd, 20)
        if toxic:
            t += rnd.choice([" you worthless fool", " such a worthless thing you fool", " fool, worthless"]) + " " + words_text(rnd, 5)
        rows.append((i, t, None, None, None))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([*rows, (900, "you worthles foool worthlesss", None, None, None), (901, None, None, None, None), (902, "", None, None, None), (None, "x", None, None, None)], DOC)
    lab = spark.createDataFrame([*labels, (None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, lab).collect()}
    held = [i for i in range(700) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in range(700))
    assert all(got[i].predicted == int(i % 4 == 0) for i in held)
    assert got[900].score > got[901].score == got[902].score and got[901].predicted == 0
    assert toxicity.toxicity(nothing, lab).count() == 0
    none = toxicity.toxicity(awkward[0], lab.limit(0)).collect()
    assert len(none) == len(awkward[1]) and {r.score for r in none} == {0.0}
    quoted = toxicity.evidence('he called it "worthless" once', toxicity.FuzzyLexicon({"worthless": 2.0}, {}))
    assert quoted[0] == 0 and quoted[3] > 0


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(16)
    item = words_text(rnd, 12)
    good = [words_text(rnd, 60) for _ in range(40)]
    texts = [f"{g}\nShared boilerplate line" for g in good] + [good[3] + " extra", "too short", None, words_text(rnd, 30) + " " + item, "spam " * 50]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOC)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256(good[i].encode()).hexdigest() for i in range(40)}
    own = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        own = stage(spark, own, str(tmp_path))
        assert own.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in own.collect())


def _article_pages(n):
    """Distinct articles with a notice in each third of them; a line that each ninth has; copies of one story; a quotation."""
    rnd = random.Random(21)
    notice = "Read all about our new reader offer today and save a lot"
    story = [words_text(rnd, 30) for _ in range(3)]
    quote = "it was the best of times it was the worst of times"
    line = "this text may be passed on by anyone who names where it stood first"
    rows, want = [], []
    for i in range(n):
        own = story if i % 10 == 9 else [words_text(rnd, 30), words_text(rnd, 20)]
        body = own + ([quote] if i % 64 == 1 else []) + ([line] if i % 9 == 1 else [])
        rows.append((i, "https://host.example/a", "<article>" + "".join(f"<p>{p}</p>" for p in [*body[:1], *([notice] if i % 3 == 0 else []), *body[1:]]) + "</article>"))
        want.append((i, "\n".join(body)))
    return rows, want


@pytest.mark.parametrize(("n", "kw"), [(100, {}), (240, {}), (240, {"windows": 5})])
def test_boilerplate_inside_articles(spark, n, kw):
    rows, want = _article_pages(n)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((r.page_id, r.text) for r in html.main_text(df, **kw).collect()) == want


def test_template_on_a_small_share_of_a_large_host(spark):
    rnd = random.Random(23)
    teaser = "<div class='x7'>this month our readers chose the following ten stories</div>"
    bodies = [words_text(rnd, 25) for _ in range(400)]
    rows = [(i, "https://host.example/a", (teaser if i % 20 == 0 else "") + f"<p>{b}</p>") for i, b in enumerate(bodies)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == list(enumerate(bodies))


def test_deep_elements_close_their_own():
    page = "<div><article>" + "<div>" * 250 + "deep<nav>menu</nav>" + "</div>" * 250 + "<p>rest of it</article></div>"
    assert html.extract([page]) == ["deep\nrest of it"]


def test_wrapping_forms_and_telling_classes():
    wrapped = "<form id='aspnetForm'><nav>menu</nav><div><h1>Head</h1><p>one two three</p><form><p>ask</p></form></div></form>"
    assert html.extract([wrapped]) == ["Head\none two three\nask"]
    inside = "<article><p>one two three four</p><form><p>your comment</p></form><div class='social-history'>kept</div><div class='share-widget x'>kept too</div><div class='share widget'>gone</div><div id='cookie-notice'>gone</div></article>"
    assert html.extract([inside]) == ["one two three four\nkept"]


@pytest.mark.parametrize("chars", [8_000_000, 1])
def test_hosts_against_brute_force(spark, monkeypatch, chars):
    """Covered runs by plain counting of substrings, on either way, for hosts of all sizes."""
    monkeypatch.setattr(html, "GROUP_CHARS", chars)
    rnd = random.Random(31)
    rows = []
    for n in (2, 5, 9, 30):
        common = [words_text(rnd, 12) for _ in range(4)]
        for i in range(n):
            parts = [f"<div class='c{rnd.randrange(3)}'>{rnd.choice(common) if rnd.random() < 0.6 else words_text(rnd, 12)}</div>" for _ in range(5)]
            if n == 9:
                parts = ["<article>", *parts, "</article>"]
            rows.append((len(rows), f"http://h{n}.example/{i}", "".join(parts)))
        rows.append((len(rows), f"http://h{n}.example/again", rows[-1][2]))
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n in (2, 5, 9, 30):
        own = [(i, html.blocks(h)) for i, u, h in rows if f"//h{n}." in u]
        texts = {h for _, u, h in rows if f"//h{n}." in u}
        least = min(8, max(3, -(-len(texts) // 2)))
        holders, tellers, sites = defaultdict(set), defaultdict(lambda: [set(), set(), set()]), defaultdict(set)
        for i, bs in own:
            words, around = [w for b in bs for w in b.words], html.around(bs)
            for k in range(len(words) - 7):
                holders[tuple(words[k : k + 8])].add(rows[i][2])
                for j in range(3):
                    if around[j, k] >= 0:
                        tellers[tuple(words[k : k + 8])][j].add(around[j, k])
                        sites[tuple(words[k : k + 8])].add(i)
        marks = {}
        for i, bs in own:
            words = [w for b in bs for w in b.words]
            marks[i] = np.zeros(len(words), bool), np.zeros(len(words), bool)
            for k in range(len(words) - 7):
                key = tuple(words[k : k + 8])
                marks[i][0][k : k + 8] |= len(holders[key]) >= least
                marks[i][1][k : k + 8] |= max(map(len, tellers[key])) >= least and len(sites[key]) >= 0.25 * len(own)
        hit, total = defaultdict(int), defaultdict(int)
        for i, bs in own:
            html._count_paths(bs, marks[i][0], hit, total)
        changed = 0
        for i, bs in own:
            assert got[i] == html._text(bs, *marks[i], lambda p, hit=hit, total=total: 2 * hit[p] >= total[p]), (n, i)
            changed += got[i] != "\n".join(" ".join(b.words) for b in bs)
        assert changed if n == 30 else True


def test_disclosure_of_rare_values(spark):
    rnd = random.Random(22)
    far = " ".join(f"word{chr(97 + k % 26)}" for k in range(60))
    rows = [(i, f"Quixada spoke. {far} write to user{i}@corp.example please") for i in range(6)]
    rows += [(10 + i, f"Someone spoke. {far} write to please " + words_text(rnd, 5)) for i in range(300)] + [(500, "solitary hapax for one@else.example")]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("term:0:7" in got[i].spans.split(",") and got[i].n_terms == 1 for i in range(6))
    assert all(got[i].n_terms == 0 for i, _ in rows if i >= 10)


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_disclosures_against_brute_force(spark, broadcast_rows):
    rnd = random.Random(32)
    names = ["Quix", "Zebul", "Marnok", "Tolvan"]
    rows = []
    for i in range(260):
        who = rnd.choice(names) if i % 5 == 0 else "Someone"
        rows.append((i % 250, f"{who} said {rnd.choice(WORDS)} {rnd.choice(WORDS)} and {rnd.choice(WORDS)}" + (f" to {who}{rnd.randrange(2)}@{who}.example now" if i % 5 == 0 else "")))
    rows += [(None, rows[0][1]), (None, rows[0][1]), (900, None), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find(df)
    got = {(r.entity, r.term): r.disclosure for r in pii.disclosures(df, found, broadcast_rows=broadcast_rows).collect()}
    n_e, n_t, n_et = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, t in rows:
        t = t or ""
        mails = re.findall(r"\S+@\S+", t)
        for w in set(re.findall(r"[a-z]+", t.lower())):
            n_t[w] += 1
        ents = {f"email:{m.lower()}" for m in mails} | {"@" + m.lower().split("@")[1] for m in mails} | ({"email"} if mails else set())
        free = {w for w in re.findall(r"[a-z]{3,}", re.sub(r"\S+@\S+", " ", t).lower())}
        for e in ents:
            n_e[e] += 1
            for w in free:
                n_et[e, w] += 1
    want, needed = {}, np.log(len(n_et) / pii.RISK)
    for (e, w), k in n_et.items():
        chance, share = n_e[e] / len(rows), k / n_t[w]
        far = share * np.log(share / chance) + ((1 - share) * np.log((1 - share) / (1 - chance)) if share < 1 else 0)
        if share > chance and n_t[w] * far >= needed:
            want[e, w] = np.log(share / chance) / -np.log(chance)
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    spans = [sorted((r.doc_id, r.spans) for r in pii.report(df, broadcast_rows=n).where("doc_id is not null").collect()) for n in (0, 200_000)]
    assert spans[0] == spans[1]


@pytest.mark.parametrize("block", [100_000, 1])
def test_benchmark_items_without_id(spark, block):
    docs = spark.createDataFrame([(1, "x a b c y"), (2, "q r s a b c"), (3, "none")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "a b c"), (None, "x a b"), (7, "q r s")], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.contamination(docs, bench, window=3, block_windows=block).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {i: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for i, r in got.items()} == {1: (4, 1, digest(""), True), 2: (6, 2, digest("7"), True), 3: (0, 0, digest(""), False)}
    assert [r.doc_id for r in decontam.clean(docs, bench, window=3, block_windows=block).collect()] == [3]


def test_pipeline_against_brute_force(spark, tmp_path):
    """Labels that certify a cutoff, shared lines, near copies, repeated ids and rows, nulls, a benchmark passage."""
    import corpus_pipeline

    rnd = random.Random(51)
    item = words_text(rnd, 14)
    rows, labels, bad = [], [], set()
    for i in range(800):
        text = words_text(rnd, 30)
        if i % 5 == 0:
            text, _ = " ".join(w + "###" for w in text.split()), bad.add(i)
        rows.append((i, text))
        labels.append((i, int(i % 5 > 0), 0))
    rows += [(900 + i, words_text(rnd, 24) + "\n Shared LINE here\t\n" + words_text(rnd, 12)) for i in range(12)]
    rows += [(950 + i, rows[1 + 5 * i][1] + f" tail{i}") for i in range(6)] + [(970, rows[2][1]), (3, rows[4][1] + " more"), (3, rows[3][1]), (None, rows[6][1])]
    rows += [(980, words_text(rnd, 22) + " " + item), (981, None), (982, ""), (983, "few words"), (984, words_text(rnd, 3) + " again and again" * 30)]
    rnd.shuffle(rows)
    extra = "doc_id long, text string, lang string, source string, n_chars long, component string, hit string, h string"
    docs = spark.createDataFrame([(i, t, "en", None, len(t or ""), "c", "x", "y") for i, t in rows], extra)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [(i, t) for i, t in rows if (q := _quality_truth(t)) and q[0] >= 20 and 100 * q[4] <= 30 * q[0] and i not in bad]
    key = lambda s: s.strip(" \t\r\x0b\x0c").lower()
    held = defaultdict(set)
    for k, (_, t) in enumerate(left):
        for line in t.split("\n"):
            held[key(line)].add(k)
    left = [(i, "\n".join(x for x in t.split("\n") if not key(x) or len(held[key(x)]) < 10)) for i, t in left]
    words = [t.lower().split() for _, t in left]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]
    least = list(range(len(left)))  # components by repeated relabelling
    near = [(a, b) for a in range(len(left)) for b in range(a) if left[a][0] is not None and left[b][0] is not None and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in range(len(left)):
        before = list(least)
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    first = {}
    for (i, _), c in zip(left, least, strict=True):
        if i is not None:
            first[c] = min(i, first.get(c, i))
    left = [(i, t) for (i, t), c in zip(left, least, strict=True) if i is None or first[c] == i]
    hit = {(r[0], k) for k, r in enumerate(left) if _contamination_truth([r], [(1, item)], 10)[0][5]}
    left = [r for k, r in enumerate(left) if (r[0], k) not in hit]
    got = sorted(((r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in left), key=repr)
    assert len(hit) == 1 and 640 < len(left) < 670
    own = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, own, str(tmp_path))
        assert out.count() == 0 and (stage is corpus_pipeline.STAGES[-1][1] or out.columns == docs.columns)
