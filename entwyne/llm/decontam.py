"""Benchmark decontamination: Wu-Manber search for windows of benchmark words.

Texts become words (A-Z lower-cased; runs of ASCII letters, digits and all code points above ASCII). A pattern is a
window of ``window`` consecutive words of an item, or the whole item where it has fewer. Patterns of one length are
searched together: a table tells how far the search may go on from the two words under its end, a shift of none leads to
the patterns with that end, told apart by their first word, and a comparison of all words confirms.

The benchmark is a stated set of patterns against all documents: it is read in blocks of at most ``block_windows``
patterns, each small enough for every executor, and the documents pass by once for each block.

Defined results: a null text has no words and no hits; items without words match nothing; repeated items each count;
items without an id are searched and counted as one, but are not in the digest of ids;
repeated rows each get the same answer; empty tables give no rows or no hits; other columns stay.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_WINDOWS = 100_000
_RESULT = "__entwyne_hits"

#: Upper to lower case; other ASCII than letters and digits to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def windows(item: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    if not item:
        return set()
    return {tuple(item[i : i + size]) for i in range(max(1, len(item) - size + 1))}


class WuManber:
    """Search for word sequences of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], tuple], length: int):
        self.length, self.patterns = length, patterns
        #: Last word of a block to the word before it to the shift; a word that is no key is in no pattern.
        self.shift: dict[bytes, dict[bytes, int]] = defaultdict(dict)
        self.bucket: dict[tuple[bytes, bytes], dict[bytes, list[tuple[bytes, ...]]]] = {}
        for p in patterns:
            if length == 1:
                self.shift[p[0]] = {}
                continue
            self.shift.setdefault(p[0], {})
            for j in range(1, length):
                own, far = self.shift[p[j]], length - 1 - j
                own[p[j - 1]] = min(far, own.get(p[j - 1], length - 1))
            self.bucket.setdefault(p[-2:], {}).setdefault(p[0], []).append(p)
        self.shift = dict(self.shift)

    def search(self, text: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(place of the first word, pattern) of each occurrence."""
        m, shift = self.length, self.shift
        i, n = m - 1, len(text)
        if m == 1:
            yield from ((i, (w,)) for i, w in enumerate(text) if w in shift)
            return
        while i < n:
            own = shift.get(text[i])
            if own is None:
                i += m
                continue
            step = own.get(text[i - 1], m - 1)
            if step:
                i += step
                continue
            start = i - m + 1
            for p in self.bucket[text[i - 1], text[i]].get(text[start], ()):
                if tuple(text[start : i + 1]) == p:
                    yield start, p
            i += 1


def index(items: list[tuple[str | None, set[tuple[bytes, ...]]]]) -> list[WuManber]:
    """One search for each length of pattern; each pattern knows its items."""
    by: dict[int, dict[tuple[bytes, ...], list[str | None]]] = defaultdict(dict)
    for item_id, wins in items:
        for w in wins:
            by[len(w)].setdefault(w, []).append(item_id)
    return [WuManber({k: tuple(v) for k, v in own.items()}, size) for size, own in sorted(by.items())]


def find(text: bytes | None, searches: list[WuManber]) -> tuple[int, list[int], list[str | None]]:
    """Words, places of hit words, ids of the items found."""
    own = words(text)
    hit: set[int] = set()
    items: set[str | None] = set()
    for s in searches:
        for start, p in s.search(own):
            hit.update(range(start, start + s.length))
            items.update(s.patterns[p])
    return len(own), sorted(hit), sorted(items, key=lambda i: (i is None, i or ""))


_STRUCT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])


def blocks(benchmark: DataFrame, size: int, block_windows: int, id_col: str = "item_id", text_col: str = "text") -> Iterator[list]:
    """The benchmark's items with their windows, never more than a block (or one item) at a time."""
    held, n = [], 0
    for row in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator(prefetchPartitions=False):
        wins = windows(words(None if row.t is None else row.t.encode()), size)
        if not wins:
            continue
        if held and n + len(wins) > block_windows:
            yield held
            held, n = [], 0
        held.append((row.i, wins))
        n += len(wins)
    yield held


def _finder(spark, items) -> Column:
    shared = spark.sparkContext.broadcast(index(items))

    def run(col: pa.Array) -> pa.Array:
        found = [find(t, shared.value) for t in col.cast(pa.binary()).to_pylist()]
        n, hit, ids = zip(*found, strict=True) if found else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(hit, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.string()))], ["n_words", "hit", "items"])

    return F.arrow_udf(run, _STRUCT)


def with_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with the struct column ``__entwyne_hits``: n_words, places of hit words, ids of the items found."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    own = [_finder(spark, items) for items in blocks(benchmark, window, block_windows)]
    if len(own) == 1:
        return docs.withColumn(_RESULT, own[0](text))
    # Several blocks: equal texts have equal hits, so a text's digest brings the blocks' hits together.
    key, empty = F.sha2(text, 256), F.array().cast("array<int>")
    found = [docs.where(text.isNotNull()).select(key.alias("k"), u(text).alias("h")).where(F.size("h.hit") > 0).select("k", "h.hit", "h.items") for u in own]
    met = reduce(DataFrame.unionByName, found).dropDuplicates(["k", "hit", "items"]).groupBy("k").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    met = met.select(F.col("k").alias("__entwyne_k"), F.col("hit").alias("__entwyne_h"), F.col("items").alias("__entwyne_i"))
    counted = docs.withColumn(_RESULT, own[0](text)).withColumn("__entwyne_t", key)
    joined = counted.join(met, F.col("__entwyne_t") == F.col("__entwyne_k"), "left")
    whole = F.struct(F.col(f"{_RESULT}.n_words").alias("n_words"), F.coalesce("__entwyne_h", empty).alias("hit"), F.coalesce("__entwyne_i", F.array().cast("array<string>")).alias("items"))
    return joined.withColumn(_RESULT, whole).drop("__entwyne_t", "__entwyne_k", "__entwyne_h", "__entwyne_i")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, **kw) -> DataFrame:
    """Per document: words, hit words, items found and their digest."""
    h = with_hits(docs.select("doc_id", "text"), benchmark, window, **kw)
    n_hit = F.size(f"{_RESULT}.hit").cast("long")
    return h.select(
        "doc_id", F.col(f"{_RESULT}.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size(f"{_RESULT}.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", f"{_RESULT}.items").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, **kw) -> DataFrame:
    """Only the documents without a hit, with their own columns."""
    return with_hits(docs, benchmark, window, **kw).where(F.size(f"{_RESULT}.hit") == 0).drop(_RESULT)
