"""Quality rules whose cutoffs carry a guarantee.

Each rule is a badness between 0 and 1 computed from counts of a whole text; a document is rejected when a rule's badness
reaches the rule's cutoff. Labelled documents fall into two halves by a digest of their id. The tuning half proposes, for
each stratum, a path of ever stricter rule sets: first the cutoff that rejects most bad documents net of ``price`` times
the good ones, then the next rule that adds most, and so on. The holdout half then tests the path in order: step j passes
if so few good holdout documents are rejected that, were the rate of false rejection above ``alpha``, the exact binomial
probability of seeing no more would be at most ``delta`` divided by the number of strata with a path (Bonferroni; this number
is fixed before the holdout is read). Testing stops at
the first step that fails (fixed-sequence testing), so with probability 1 - delta no stratum rejects more than alpha of
its good documents. A stratum with too few labels certifies nothing and rejects nothing beyond the base rules.

Counts of both halves are histograms of a fixed size; all labelled documents enter them.

Defined results: a null or empty text has no words, fails the base rules and is not kept; unknown or null strata are one
stratum of their own; labels with a null id or quality are ignored, of several labels of a document the best counts;
repeated rows each get their answer; no labels: only the base rules act; empty tables give no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entwyne.llm.common import materialise

#: Strata are these values of the stratum column and one for all others, so that their number is bounded.
STRATA = ("ar", "cs", "de", "en", "es", "fr", "it", "ja", "ko", "nl", "pl", "pt", "ru", "sv", "tr", "zh")
BINS = 200
WINDOW = 8

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_distinct")
_STRUCT = T.StructType([T.StructField(c, T.LongType()) for c in _COUNTS])
_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that occur twice or more in the text."""
    n = len(words)
    if n <= size:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.uint64)
    if len(seen) == n:
        return 0
    h = ids[: n - size + 1].copy()
    for k in range(1, size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : n - size + 1 + k]
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    if not len(same):
        return 0
    windows = np.lib.stride_tricks.sliding_window_view(ids, size)
    a, b = order[same], order[same + 1]
    true = (windows[a] == windows[b]).all(axis=1)
    edge = np.zeros(n + 1, dtype=np.int64)
    starts = np.unique(np.concatenate([a[true], b[true]]))
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def counts(text: bytes | None) -> tuple[int, ...]:
    words = (text or b"").split()
    joined = b"".join(words)
    lines, dup, with_word = set(), 0, 0
    for line in (text or b"").split(b"\n"):
        if line.strip():
            with_word += 1
            dup += line in lines
            lines.add(line)
    gone = lambda chars: len(joined) - len(joined.translate(None, chars))
    upper = gone(_UPPER)
    return (len(words), len(joined.translate(None, _CONTINUATION)), gone(b"#*$%&|<>"), dup, repeated_words(words), with_word, upper, upper + gone(_LOWER), gone(b"!?"), len(set(words)))


def count_column(text: Column) -> Column:
    """Struct of the counts of a text."""

    def run(col: pa.Array) -> pa.Array:
        rows = np.array([counts(t) for t in col.cast(pa.binary()).to_pylist()], dtype=np.int64).reshape(-1, len(_COUNTS))
        return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(_COUNTS))], list(_COUNTS))

    return F.arrow_udf(run, _STRUCT)(text.cast("string"))


def _rules(c: str) -> dict[str, Column]:
    """Badness by rule from the struct column ``c``; order and number are part of the method."""
    x = lambda name: F.col(f"{c}.{name}").cast("double")
    over = lambda a, b: F.least(F.lit(1.0), a / F.greatest(b, F.lit(1.0)))
    mean = over(x("word_chars"), x("n_words") * 20)
    return {
        "symbols": over(x("n_symbols"), x("word_chars")),
        "bars": over(x("n_symbols"), x("n_words")),
        "capitals": over(x("n_upper"), x("n_letters")),
        "marks": over(x("n_marks"), x("n_words")),
        "dup_lines": over(x("n_dup_lines"), x("n_lines")),
        "repeats": over(x("n_repeat_words"), x("n_words")),
        "sameness": 1 - over(x("n_distinct"), x("n_words")),
        "long_words": mean,
        "short_words": 1 - mean,
    }


def base_failed(c: str) -> Column:
    n = F.col(f"{c}.n_words")
    return (n < 20) | (100 * F.col(f"{c}.n_repeat_words") > 30 * n)


def stratum(col: str) -> Column:
    return F.when(F.col(col).isin(*STRATA), F.col(col)).otherwise(F.lit("other"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of n trials with chance p, exactly summed in logarithms."""
    if k >= n:
        return 1.0
    # Terms some hundred deviations below k add nothing that a double could hold.
    low = max(0, k - 1000 - int(100 * math.sqrt(n * p * (1 - p))))
    first = math.lgamma(n + 1) - math.lgamma(low + 1) - math.lgamma(n - low + 1) + low * math.log(p) + (n - low) * math.log1p(-p)
    i = np.arange(low, k, dtype=np.float64)
    logs = first + np.concatenate([[0.0], np.cumsum(np.log(n - i) - np.log(i + 1) + math.log(p) - math.log1p(-p))])
    top = logs.max()
    return min(1.0, float(math.exp(top) * np.exp(logs - top).sum()))


@dataclass(frozen=True)
class Cutoffs:
    """Certified cutoffs: by stratum, (rule, bin) pairs; a document goes if a rule's bin is at or above it."""

    by_stratum: dict[str, tuple[tuple[str, int], ...]]

    def rejects(self, c: str, stratum_: Column) -> Column:
        bad, rules = F.lit(False), _bins(c)
        for name, own in sorted(self.by_stratum.items()):
            for rule, cut in own:
                bad = bad | ((stratum_ == F.lit(name)) & (rules[rule] >= cut))
        return bad


def _bins(c: str) -> dict[str, Column]:
    return {k: F.floor(v * BINS).cast("int") for k, v in _rules(c).items()}


def learn(labelled: DataFrame, alpha: float = 0.02, delta: float = 0.05, price: float = 10.0) -> Cutoffs:
    """``labelled``: struct column c of counts, string s (stratum), boolean good, boolean holdout; base failures left out."""
    names = list(_rules("c"))
    bins = _bins("c")
    tuning = labelled.where(~F.col("holdout"))
    cells = tuning.select("s", "good", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), bins[n].alias("bin")) for n in names])).alias("x"))
    cells = cells.groupBy("s", "x.rule", "x.bin").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).collect()
    hist: dict[str, dict[str, np.ndarray]] = {}
    for r in cells:
        hist.setdefault(r.s, {n: np.zeros((2, BINS + 1)) for n in names})[r.rule][:, r.bin] += r.good, r.bad
    paths = {}
    for s, own in hist.items():
        steps = []
        for n in names:
            good, bad = np.cumsum(own[n][:, ::-1], axis=1)[:, ::-1]
            gain = bad - price * good
            cut = int(np.flatnonzero(gain == gain.max())[-1])
            if gain[cut] > 0:
                steps.append((-gain[cut], n, cut))
        paths[s] = tuple((n, cut) for _, n, cut in sorted(steps))
    if not paths:
        return Cutoffs({})
    first = F.lit(len(names) + 1)
    for s, path in paths.items():
        step = F.lit(len(names) + 1)
        for j in reversed(range(len(path))):
            step = F.when(bins[path[j][0]] >= path[j][1], F.lit(j)).otherwise(step)
        first = F.when(F.col("s") == s, step).otherwise(first)
    held = labelled.where("holdout and good").groupBy("s", first.alias("step")).count().collect()
    certified = {}
    proposed = max(1, sum(bool(p) for p in paths.values()))  # fixed before the holdout is read
    for s, path in paths.items():
        n = sum(r["count"] for r in held if r.s == s)
        for j in range(len(path)):
            gone = sum(r["count"] for r in held if r.s == s and r.step <= j)
            if not n or binomial_tail(gone, n, alpha) > delta / proposed:
                break
            certified[s] = path[: j + 1]
    return Cutoffs(certified)


def _join_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    own = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"))
    half = F.crc32(F.concat(F.lit("half:"), F.col("doc_id").cast("string"))) % 2 == 1
    return features.where(~base_failed("c")).join(own, "doc_id").select("c", "s", "good", half.alias("holdout"))


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **kw) -> tuple[DataFrame, Cutoffs]:
    """Counts of all documents, written once, and the cutoffs learnt from those with labels."""
    features = docs.select(F.col(id_col).cast("long").alias("doc_id"), stratum(stratum_col).alias("s"), count_column(F.col(text_col)).alias("c"))
    features = materialise(features, "quality")
    return features, learn(materialise(_join_labels(features, labels), "labelled"), **kw)


def report(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """Per document: its counts, whether it fails the base rules, whether it is kept."""
    features, cutoffs = assess(docs, labels, **kw)
    failed = base_failed("c")
    return features.select("doc_id", *[F.col(f"c.{n}").alias(n) for n in _COUNTS[:5]], failed.alias("base_failed"), (~failed & ~cutoffs.rejects("c", F.col("s"))).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", stratum_col: str = "lang", **kw) -> DataFrame:
    """Only the documents that pass, with their own columns."""
    _, cutoffs = assess(docs, labels, text_col=text_col, stratum_col=stratum_col, **kw)
    counted = docs.withColumns({"__entwyne_c": count_column(F.col(text_col)), "__entwyne_s": stratum(stratum_col)})
    passed = ~base_failed("__entwyne_c") & ~cutoffs.rejects("__entwyne_c", F.col("__entwyne_s"))
    return counted.where(passed).drop("__entwyne_c", "__entwyne_s")
