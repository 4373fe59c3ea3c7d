"""Removal of lines that many documents share, found with two Bloom filters.

Every task hashes the distinct line keys of its documents into two filters of a fixed size: keys met once, and keys met
again. Merging two tasks' filters marks what both have met once as met again, so no key of two documents is missed.
Only keys that the merged second filter suspects are counted, after sums within each task, by a 128-bit digest; a
filter's false alarms cost a little shuffle and never a line.

A key is a line without white space at both ends and with A-Z lower-cased. Keys of ``min_chars`` code points or more
that ``min_docs`` documents or more hold lose their lines: all of them, or with ``keep_first`` all but those of the
smallest doc_id that holds the key (a null doc_id counts as the smallest).

Defined results: a null or empty text is one empty line and stays what it is; every row counts as a document of its own,
rows with equal doc_id or text too; an empty table gives no rows; all columns of the input stay, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entwyne.llm.common import materialise, raw_texts, slices

#: Slots of each filter: a power of two between these, by the rows of the input. Beyond the upper bound filters fill up
#: and more keys are counted exactly; results stay the same.
LEAST_SLOTS, MOST_SLOTS, SLOTS_PER_ROW = 1 << 20, 1 << 27, 256
SEGMENT = 1 << 20
#: So many shared keys are sent to all executors (about 100 bytes each); more are joined by shuffles.
BROADCAST_KEYS = 300_000
#: Suspected keys a task counts before it passes its sums on.
TASK_KEYS = 200_000

_TEXT, _ROW = "__entwyne_text", "__entwyne_lines"


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def _keys(text: bytes | None, min_chars: int) -> set[bytes]:
    got = {line_key(x) for x in (text or b"").split(b"\n")}
    if min_chars <= 1:
        got.discard(b"")
        return got
    return {k for k in got if len(k) >= min_chars and len(k.decode("utf-8", "replace")) >= min_chars}


def _digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def _places(hashes: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(slots - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


def _sketch(slots: int, keys: Callable[[bytes | None], Iterable[bytes]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(slots, np.uint8), np.zeros(slots, np.uint8)
        for batch in slices(batches, 1024):
            hashes = [xxhash.xxh3_64_intdigest(k) for text in raw_texts(batch) for k in keys(text)]
            if not hashes:
                continue
            values, counts = np.unique(np.array(hashes, dtype=np.uint64), return_counts=True)
            a, b = _places(values, slots)
            again = (counts > 1) | ((once[a] & once[b]) > 0)
            twice[a[again]] = twice[b[again]] = 1
            once[a] = once[b] = 1
        step, packer = min(SEGMENT, slots), zstandard.ZstdCompressor(level=1)
        segs, ones, twos = [], [], []
        for at in range(0, slots, step):
            if once[at : at + step].any():
                segs.append(at // step)
                ones.append(packer.compress(np.packbits(once[at : at + step]).tobytes()))
                twos.append(packer.compress(np.packbits(twice[at : at + step]).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(segs, pa.int32()), pa.array(ones, pa.binary()), pa.array(twos, pa.binary())], ["seg", "once", "twice"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Any number of filters, one at a time; what is held is at most one pair of whole filters."""
    opener, held = zstandard.ZstdDecompressor(), {}
    for batch in slices(batches, 16):
        for seg, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            one, two = (np.frombuffer(opener.decompress(x), np.uint8) for x in (once, twice))
            if seg in held:
                had = held[seg]
                held[seg] = had[0] | one, had[1] | two | (had[0] & one)
            else:
                held[seg] = one, two
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v[1].tobytes() for v in held.values()], pa.binary())], ["seg", "twice"])


def slots_for(rows: int, per_row: int = SLOTS_PER_ROW) -> int:
    return min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (per_row * max(1, rows) - 1).bit_length()))


def suspects(texts: DataFrame, slots: int, keys: Callable[[bytes | None], Iterable[bytes]]) -> bytes:
    """The merged second filter, packed: ``slots / 8`` bytes, however many keys there are. ``keys``: a text's distinct keys."""
    parts = texts.mapInArrow(_sketch(slots, keys), "seg int, once binary, twice binary")
    merged = parts.repartition(max(1, min(16, slots // SEGMENT)), "seg").mapInArrow(_merge, "seg int, twice binary")
    step = min(SEGMENT, slots) // 8
    out = bytearray(slots // 8)
    for row in merged.toLocalIterator():
        out[row.seg * step : (row.seg + 1) * step] = row.twice
    return bytes(out)


class Suspected:
    def __init__(self, packed: bytes):
        self.slots, self.bits = len(packed) * 8, np.frombuffer(packed, np.uint8)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        a, b = _places(hashes, self.slots)
        hit = lambda p: (self.bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1
        return (hit(a) & hit(b)) > 0


def _suspected_keys(batch: pa.RecordBatch, seen: Suspected, min_chars: int) -> Iterator[tuple[int, bytes, int]]:
    """(row of the batch, key, hash) of distinct suspected keys of each row."""
    rows, keys = [], []
    for i, text in enumerate(raw_texts(batch)):
        own = _keys(text, min_chars)
        rows += [i] * len(own)
        keys += own
    if keys:
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        for at in np.flatnonzero(seen(hashes)).tolist():
            yield rows[at], keys[at], int(hashes[at])


def _count(filter_, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sums, hashes = Suspected(filter_.value), Counter(), {}

        def out():
            rows = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array([hashes[k] for k in sums], pa.int64()), pa.array(list(sums.values()), pa.int64())], ["digest", "hash", "n"])
            sums.clear()
            hashes.clear()
            return rows

        for batch in slices(batches, 1024):
            for _, key, h in _suspected_keys(batch, seen, min_chars):
                d = _digest(key)
                sums[d] += 1
                hashes[d] = h - (1 << 64) if h >> 63 else h
            if len(sums) > TASK_KEYS:
                yield out()
        yield out()

    return run


def frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text_col: str = "text", slots: int | None = None):
    """(digest, hash, n) of each key of ``min_docs`` documents or more, written to the shared folder; and the filter."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    if slots is None:
        slots = slots_for(texts.count())
    filter_ = spark.sparkContext.broadcast(suspects(texts, slots, lambda text: _keys(text, min_chars)))
    counted = texts.mapInArrow(_count(filter_, min_chars), "digest binary, hash long, n long")
    counted = counted.groupBy("digest", "hash").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)
    return materialise(counted, "lines"), filter_


def _drop(hashes: set[int], digests: set[bytes], text: bytes | None):
    lines = (text or b"").split(b"\n")
    kept = []
    for line in lines:
        key = line_key(line)
        if not (key and xxhash.xxh3_64_intdigest(key) in hashes and _digest(key) in digests):
            kept.append(line)
    return text if len(kept) == len(lines) else b"\n".join(kept), len(lines), len(lines) - len(kept)


def _lines_struct(rows) -> pa.Array:
    texts, n, d = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], ["text", "n_lines", "n_dropped"])


_STRUCT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_first: bool = False, broadcast_keys: int = BROADCAST_KEYS, slots: int | None = None) -> DataFrame:
    """``docs`` with shared lines gone from the text, and the struct column ``__entwyne_lines`` (n_lines, n_dropped).

    Up to ``broadcast_keys`` shared keys go to all executors; beyond that, or with ``keep_first``, (row, key) pairs of
    suspected keys meet the shared keys in a shuffle join, and each row gets its own keys back.
    """
    spark = docs.sparkSession
    frequent, filter_ = frequent_lines(docs, min_docs, min_chars, text_col, slots)
    text = F.col(text_col).cast("string")
    if not keep_first and frequent.count() <= broadcast_keys:
        rows = frequent.collect()
        shared = spark.sparkContext.broadcast(({r.hash % (1 << 64) for r in rows}, {bytes(r.digest) for r in rows}))

        def own(col: pa.Array) -> pa.Array:
            hashes, digests = shared.value
            return _lines_struct([_drop(hashes, digests, t) for t in col.cast(pa.binary()).to_pylist()])

        out = docs.withColumn(_ROW, F.arrow_udf(own, _STRUCT)(text))
    else:
        out = _drop_by_join(docs, frequent, filter_, min_chars, id_col, text_col, keep_first)
    out = out.withColumn(text_col, F.col(f"{_ROW}.text"))
    return out.withColumn(_ROW, F.struct(f"{_ROW}.n_lines", f"{_ROW}.n_dropped"))


def _drop_by_join(docs, frequent, filter_, min_chars, id_col, text_col, keep_first) -> DataFrame:
    """The way beyond the broadcast bound. Equal rows (id and text) share their keys, so rows need no number of their own."""
    text = F.col(text_col).cast("string")
    row_key = F.sha2(F.concat_ws("\x00", F.coalesce(F.col(id_col).cast("string"), F.lit("\x01")), text), 256)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Suspected(filter_.value)
        for batch in slices(batches, 1024):
            found = list(_suspected_keys(batch, seen, min_chars))
            at = pa.array([i for i, _, _ in found], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([_digest(k) for _, k, _ in found], pa.binary())], ["row_key", "doc_id", "digest"])

    occur = docs.select(row_key.alias("row_key"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(pairs, "row_key string, doc_id long, digest binary")
    occur = occur.join(frequent.select("digest"), "digest")
    if keep_first:
        occur = materialise(occur, "linepairs")
        first = occur.groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("first"))
        occur = occur.join(first, "digest").where(F.coalesce("doc_id", F.lit(-(1 << 63))) != F.col("first"))
    own = occur.groupBy("row_key").agg(F.collect_set("digest").alias("digests")).withColumnRenamed("row_key", "__entwyne_key")

    def drop(col: pa.Array, digests: pa.Array) -> pa.Array:
        rows = []
        for t, d in zip(col.cast(pa.binary()).to_pylist(), digests.to_pylist(), strict=True):
            lines = (t or b"").split(b"\n")
            have = set(d or ())
            kept = [x for x in lines if not (have and (k := line_key(x)) and _digest(k) in have)]
            rows.append((t if len(kept) == len(lines) else b"\n".join(kept), len(lines), len(lines) - len(kept)))
        return _lines_struct(rows)

    joined = docs.withColumn(_TEXT, row_key).join(own, F.col(_TEXT) == F.col("__entwyne_key"), "left")
    return joined.withColumn(_ROW, F.arrow_udf(drop, _STRUCT)(text, F.col("digests"))).select(*[docs[c] for c in docs.columns], _ROW)


def line_report(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, **kw) -> DataFrame:
    """Per document: lines before, lines dropped, digest of what stays."""
    out = drop_frequent_lines(docs.select("doc_id", "text"), min_docs, min_chars, **kw)
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", F.col(f"{_ROW}.n_lines").alias("n_lines"), F.col(f"{_ROW}.n_dropped").alias("n_dropped"), kept.alias("kept_sha256"))
