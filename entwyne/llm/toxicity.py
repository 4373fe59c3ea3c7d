"""Toxicity from a learnt lexicon that tolerates misspelling.

1. From labelled documents outside the held-out fold, words and word beginnings (stems) that toxic documents hold far
   more often than others become the lexicon, with the logarithm of that ratio as weight.
2. The lexicon is a trie. A Levenshtein automaton runs over it: a state is a set of (node, edits so far), made
   deterministic as tokens need it, so a token is read once, letter by letter, and most die after a few. Words of five
   letters or more may be one edit away, of eight or more two; stems match as they are. A near miss that benign
   training documents hold is a word of its own and no misspelling.
3. A window of tokens around each hit tells quotation from abuse: a hit between quotation marks or beside a word of
   reporting counts as quoted, one beside a word of address as aimed.
4. A logistic regression over the counted evidence gives the score.

Labels are learnt from about ``FIT_ROWS`` labelled rows at most, taken by a digest of their id, and what the driver holds
of them is bounded by that alone; all documents are scored in one pass. Labels, lang, source and doc_id are no inputs of a score.

Defined results: a null or empty text has no tokens and the score of a document without evidence; without labels of both
kinds nothing is learnt and every score is 0; labels with null id or toxic are ignored, of several the highest counts;
repeated rows each get the same score; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entwyne.llm.common import keyed_text, slices

#: Expected number of labelled documents that are learnt from, at most.
FIT_ROWS = 20_000
FOLDS = 5
LEAST_POSITIVE, LEAST_RATIO = 6, 15.0
STEM_LENGTHS = range(4, 9)
#: Tokens on either side of a hit.
CONTEXT = 4
#: Tokens and states of the automaton that a worker remembers before it starts anew.
CACHE_TOKENS, CACHE_STATES = 400_000, 100_000

#: Words that report what others say, and words that address someone, in the languages of the corpus.
REPORTING = frozenset("word words term terms phrase called calling quote quoted quotes said says saying slur insult wort begriff genannt sagte zitat mot terme dit citation palabra dicho dijo cita".split())
ADDRESS = frozenset("you your youre u ur ihr du dich dir tu te toi vous votre usted ustedes vosotros eres".split())

_SPLIT = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_QUOTES = str.maketrans({c: '"' for c in "“”„«»‘‹›"})


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().encode("utf-8", "replace").translate(_SPLIT).decode().split()


def edits_allowed(length: int) -> int:
    return 0 if length < 5 else 1 if length < 8 else 2


class FuzzyLexicon:
    """A trie of words and stems, intersected with the Levenshtein automaton of whatever token is read."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], benign: frozenset[str] = frozenset()):
        self.words, self.stems, self.benign = words, stems, benign
        self.child: list[dict[str, int]] = [{}]
        self.word_at: dict[int, str] = {}
        self.stem_at: dict[int, str] = {}
        self.reach: list[int] = [0]
        for entry, k in [*((w, edits_allowed(len(w))) for w in words), *((s, 0) for s in stems)]:
            node = 0
            self.reach[0] = max(self.reach[0], k)
            for c in entry:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.reach.append(0)
                node = self.child[node][c]
                self.reach[node] = max(self.reach[node], k)
            (self.word_at if entry in words else self.stem_at)[node] = entry
            if entry in words and entry in stems:
                self.stem_at[node] = entry
        self.known: dict[str, tuple[str, int, float] | bool] = {}
        self._forget()

    def _forget(self) -> None:
        """Drop all states; what is known of whole tokens stays."""
        self.sets: list[frozenset] = [frozenset()]
        self.ids: dict[frozenset, int] = {frozenset(): 0}
        self.steps: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str | None, int, str | None]] = [(None, 0, None)]
        self.start = self._state({(0, 0)}) if self.words or self.stems else 0

    def _state(self, raw: set[tuple[int, int]]) -> int:
        """Number of the state of these positions and of all that skipping letters of an entry adds."""
        best: dict[int, int] = {}
        todo = sorted(raw, key=lambda x: x[1])
        while todo:
            node, e = todo.pop(0)
            if e > self.reach[node] or best.get(node, 99) <= e:
                continue
            best[node] = e
            todo += [(n, e + 1) for n in self.child[node].values()]
        key = frozenset(best.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            found = min(((e, self.word_at[n]) for n, e in key if n in self.word_at and e <= edits_allowed(len(self.word_at[n]))), default=(0, None))
            stem = next((self.stem_at[n] for n, e in key if e == 0 and n in self.stem_at), None)
            self.ends.append((found[1], found[0], stem))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            out.add((node, e + 1))
            out |= {(n, e + (own != c)) for own, n in self.child[node].items()}
        self.steps[state][c] = got = self._state(out)
        return got

    def _read(self, token: str) -> tuple[str, int, float] | bool:
        """(entry, edits, weight) of the best match of a token."""
        state, stem = self.start, None
        for c in token:
            step = self.steps[state].get(c)
            state = self._step(state, c) if step is None else step
            if not state:
                break
            stem = self.ends[state][2] or stem
        word, e, _ = self.ends[state]
        if word is not None and e == 0:
            return word, 0, self.words[word]
        if stem is not None:
            return stem, 0, self.stems[stem]
        if word is not None and token not in self.benign:
            return word, e, self.words[word]
        return False

    def match(self, text: list[str]) -> list[tuple[int, tuple[str, int, float]]]:
        """(place, match) of every token that matches."""
        known = self.known
        if len(known) > CACHE_TOKENS:
            known.clear()
        got = list(map(known.get, text))
        out = []
        for i, x in enumerate(got):
            if x is None:
                x = known.get(text[i])
                if x is None:
                    if len(self.sets) > CACHE_STATES:
                        self._forget()
                    x = known[text[i]] = self._read(text[i])
            if x:
                out.append((i, x))
        return out

    def __reduce__(self):
        return FuzzyLexicon, (self.words, self.stems, self.benign)


FEATURES = ("abuse", "abuse_rate", "near", "quoted", "aimed", "strongest", "kinds")


def _quoted(text: str, hits: list[str]) -> Counter:
    """How often each of these tokens stands between quotation marks of one line."""
    out: Counter = Counter()
    spans = re.findall(r'"([^"\n]+)"', text.lower().translate(_QUOTES))
    for own in spans:
        out.update(t for t in tokens(own) if t in hits)
    return out


def evidence(text: str | None, lexicon: FuzzyLexicon) -> np.ndarray:
    own = tokens(text)
    hits = lexicon.match(own)
    if not hits:
        return np.zeros(len(FEATURES))
    between = _quoted(text, {own[i] for i, _ in hits})
    abuse = near = quoted = aimed = strongest = 0.0
    for i, (_, edits, weight) in hits:
        around = own[max(0, i - CONTEXT) : i] + own[i + 1 : i + 1 + CONTEXT]
        if between[own[i]] > 0 or any(w in REPORTING for w in around):
            between[own[i]] -= 1
            quoted += weight
            continue
        if edits:
            near += weight / (1 + edits)
        else:
            abuse += weight
            strongest = max(strongest, weight)
        aimed += any(w in ADDRESS for w in around)
    kinds = len({m[0] for _, m in hits})
    return np.array([math.log1p(abuse), math.log1p(100 * abuse / len(own)), math.log1p(near), math.log1p(quoted), math.log1p(aimed), strongest, math.log1p(kinds)])


@dataclass(frozen=True)
class Model:
    lexicon: FuzzyLexicon = field(default_factory=lambda: FuzzyLexicon({}, {}))
    weights: tuple[float, ...] = ()

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        z = self.weights[0] + float(np.dot(self.weights[1:], evidence(text, self.lexicon)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> tuple[float, ...]:
    """Newton's method with a ridge on all weights but the intercept."""
    a = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(a.shape[1]), np.full(a.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + penalty * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        move = np.linalg.solve(hess, grad)
        w = w - move
        if np.abs(move).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _terms(own: list[str]) -> set[tuple[str, bool]]:
    """Distinct words and stems of a document; a stem is a word's beginning and not the whole of it."""
    out = set()
    for w in set(own):
        if len(w) >= 3:
            out.add((w, False))
        out.update((w[:k], True) for k in STEM_LENGTHS if k < len(w))
    return out


_TERM = "term string, stem boolean, n long"


def _count_terms(only):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()

        def out():
            keys = list(sums)
            batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array(list(sums.values()), pa.int64())], ["term", "stem", "n"])
            sums.clear()
            return batch

        for batch in slices(batches, 512):
            for text in batch.column(0).to_pylist():
                own = _terms(tokens(text))
                sums.update(own if only is None else own & only.value)
            if len(sums) > 400_000:
                yield out()
        yield out()

    return run


def in_fold(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def held_out(col):
    return F.crc32(col.cast("string").cast("binary")) % FOLDS == 0


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    spark = docs.sparkSession
    own = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = own.count()
    share = min(1.0, fit_rows / max(1, n))
    chosen = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
    # About fit_rows rows of two numbers at most: small enough for every executor.
    sample = keyed_text(docs).join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        return Model()
    counted = sample.where("toxic = 1").select("text").mapInArrow(_count_terms(None), _TERM).groupBy("term", "stem").agg(F.sum("n").alias("n"))
    pos = {(r.term, r.stem): r.n for r in counted.where(F.col("n") >= LEAST_POSITIVE).collect()}
    shared = spark.sparkContext.broadcast(frozenset(pos))
    against = sample.where("toxic = 0").select("text").mapInArrow(_count_terms(shared), _TERM).groupBy("term", "stem").agg(F.sum("n").alias("n"))
    neg = {(r.term, r.stem): r.n for r in against.collect()}
    ratio = {k: (v / n_pos) / ((neg.get(k, 0) + 0.5) / n_neg) for k, v in pos.items()}
    strong = sorted((k for k in ratio if ratio[k] >= LEAST_RATIO), key=lambda k: (len(k[0]), k))
    stems: dict[str, float] = {}
    words: dict[str, float] = {}
    for term, stem in strong:
        # A stem is worth having if words beyond one spelling support it; the shortest one covers the longer.
        if stem and not any(term[:k] in stems for k in range(1, len(term))):
            longest = max((v for (t, s), v in pos.items() if not s and t.startswith(term)), default=0)
            if pos[term, True] > 1.5 * longest and neg.get((term, True), 0) * 50 * n_pos < pos[term, True] * n_neg:
                stems[term] = math.log(ratio[term, True])
    for term, stem in strong:
        if not stem and not any(term[:k] in stems for k in STEM_LENGTHS):
            words[term] = math.log(ratio[term, False])
    lexicon = FuzzyLexicon(words, stems)
    # Near misses that benign documents hold.
    rough = spark.sparkContext.broadcast(lexicon)

    def misses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch in slices(batches, 512):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = tokens(text)
                for t in {seen[i] for i, m in rough.value.match(seen) if m[1]}:
                    sums[t][1 if toxic else 0] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.int64())], ["token", "benign", "toxic"])

    near = sample.mapInArrow(misses, "token string, benign long, toxic long").groupBy("token").agg(F.sum("benign").alias("benign"), F.sum("toxic").alias("toxic"))
    benign = frozenset(r.token for r in near.where(F.col("benign") * n_pos >= F.col("toxic") * n_neg * 0.2).select("token").collect())
    lexicon = FuzzyLexicon(words, stems, benign)
    final = spark.sparkContext.broadcast(lexicon)

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            rows = [evidence(t, final.value).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], ["x", "y"])

    seen = sample.mapInArrow(facts, "x array<double>, y int").groupBy("x", "y").count().collect()
    x = np.array([r.x for r in seen for _ in range(r["count"])]).reshape(-1, len(FEATURES))
    y = np.array([r.y for r in seen for _ in range(r["count"])], dtype=float)
    return Model(lexicon, logistic(x, y))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, whether it is held out, score and prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(col: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(t) for at in range(0, len(col), 512) for t in col.slice(at, 512).to_pylist()], pa.float64())

    rows = docs.select("doc_id", F.arrow_udf(run, T.DoubleType())(F.col("text").cast("string")).alias("score"))
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    return scores(docs, learn(docs, labels, fit_rows))
