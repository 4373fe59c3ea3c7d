"""Passages that several documents share, by content-defined chunks.

A gear hash rolls over the UTF-8 bytes: each step shifts it left by one bit and adds a random number for the byte, so
that in 16 bits it knows the last 16 bytes. A chunk ends between code points where the hash's upper ``CUT_BITS`` bits are
zero, but not before ``LEAST`` bytes. Where none is found for ``MOST`` bytes, it ends at the last place whose upper
``LOOSE_BITS`` bits are zero, and only in text without such a place after ``MOST`` bytes. Where two texts share a passage, their ends
fall together soon after its start, whatever was inserted before it. Chunks are compared by digest.

A chunk is repeated if documents of different doc_id hold it; a run is a series of adjacent repeated chunks of at least
``min_run`` code points. Of a repeated chunk the document with the smallest doc_id keeps it; in the runs of the others it
is dropped.

Two Bloom filters of a fixed size (those of line dedup) first mark chunks that occur twice at all, and tasks pass on only
chunks in long enough series of marked ones; those are then counted exactly by a 128-bit digest.

Defined results: null and empty texts have no chunks; a null doc_id takes no part and keeps its whole text; rows of one
doc_id are one document, whose spans are those of all its texts; repeats within one document alone stay; an empty table
gives no rows; columns other than doc_id and text are not read by the report and stay as they are in ``drop_repeats``.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entwyne.llm.common import keyed_text, materialise, raw_texts, slices
from entwyne.llm.linedup import Suspected, slots_for, suspects

LEAST, MOST, CUT_BITS, LOOSE_BITS = 16, 128, 4, 2
#: Code points of the shortest run: a passage of 50 words has about 280, of which chunks cover all but some 60.
MIN_RUN = 140
SLOTS_PER_ROW = 256
#: Repeated chunks that are sent to all executors (some 60 bytes each); more are joined by a shuffle.
BROADCAST_CHUNKS = 300_000

_GEAR = np.random.Generator(np.random.PCG64(41)).integers(0, 1 << 16, 256, dtype=np.uint16)


def boundaries(text: bytes) -> list[int]:
    """Ends of the chunks of a text, in bytes."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    raw = np.frombuffer(text, np.uint8)
    h = _GEAR[raw]
    for step in (1, 2, 4, 8):
        more = h.copy()
        more[step:] += h[:-step] << np.uint16(step)
        h = more
    inner = (raw[1:] & 0xC0) != 0x80
    top = h[:-1] >> np.uint16(16 - CUT_BITS)
    found = (np.flatnonzero((top == 0) & inner) + 1).tolist()
    loose = (np.flatnonzero(((top >> np.uint16(CUT_BITS - LOOSE_BITS)) == 0) & inner) + 1).tolist()
    ends, last = [], 0
    for at in [*found, n]:
        while at - last > MOST:
            k = bisect_right(loose, last + MOST) - 1
            if k >= 0 and loose[k] - last >= LEAST:
                last = loose[k]
            else:
                last += MOST
                while last < n and text[last] & 0xC0 == 0x80:
                    last += 1
            if last < n:
                ends.append(last)
        if at - last >= LEAST or at == n > last:
            ends.append(at)
            last = at
    return ends


def chunks(text: bytes | None) -> list[bytes]:
    ends = boundaries(text or b"")
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _distinct(text: bytes | None) -> set[bytes]:
    return set(chunks(text))


def _marked(filter_, min_run: int):
    """(digest, doc_id, start, end) in code points of chunks in long enough series of marked chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Suspected(filter_.value)
        for batch in slices(batches, 256):
            digest, doc, start, end = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), raw_texts(batch), strict=True):
                own = chunks(text)
                if not own:
                    continue
                hit = seen(np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)))
                if not hit.any():
                    continue
                ends = np.cumsum([len(c) for c in own])
                places = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)[ends - 1]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    first = int(places[a - 1]) if a else 0
                    if int(places[b - 1]) - first >= min_run:
                        for k in range(a, b):
                            digest.append(blake2b(own[k], digest_size=16).digest())
                            doc.append(doc_id)
                            start.append(int(places[k - 1]) if k else 0)
                            end.append(int(places[k]))
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["digest", "doc_id", "start", "end"])

    return run


def _join_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


_SPANS = T.StructType([T.StructField(c, T.ArrayType(T.ArrayType(T.LongType()))) for c in ("repeats", "dropped")])


def _runs(min_run: int):
    def run(col: pa.Array) -> pa.Array:
        repeats, dropped = [], []
        for own in col.to_pylist():
            own = sorted((x["start"], x["end"], x["later"]) for x in own)
            runs = [(a, b) for a, b in _join_spans([x[:2] for x in own]) if b - a >= min_run]
            gone = [(a, b) for a, b, later in own if later and any(x <= a and b <= y for x, y in runs)]
            repeats.append([list(x) for x in runs])
            dropped.append([list(x) for x in _join_spans(gone)])
        kind = pa.list_(pa.list_(pa.int64()))
        return pa.StructArray.from_arrays([pa.array(repeats, kind), pa.array(dropped, kind)], ["repeats", "dropped"])

    return F.arrow_udf(run, _SPANS)


def repeated_spans(docs: DataFrame, min_run: int = MIN_RUN, slots: int | None = None, broadcast_chunks: int = BROADCAST_CHUNKS) -> DataFrame:
    """(doc_id, repeats, dropped) of each document with a run: lists of [start, end) in code points."""
    spark = docs.sparkSession
    texts = keyed_text(docs).where("doc_id is not null and text is not null")
    filter_ = spark.sparkContext.broadcast(suspects(texts, slots or slots_for(texts.count(), SLOTS_PER_ROW), _distinct))
    found = materialise(texts.mapInArrow(_marked(filter_, min_run), "digest binary, doc_id long, start long, end long"), "chunks")
    shared = found.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    shared = materialise(shared, "shared")
    small = shared.count() <= broadcast_chunks
    own = found.join(F.broadcast(shared) if small else shared, "digest").groupBy("doc_id").agg(F.collect_set(F.struct("start", "end", (F.col("doc_id") != F.col("first")).alias("later"))).alias("spans"))
    return own.select("doc_id", _runs(min_run)("spans").alias("s")).select("doc_id", "s.repeats", "s.dropped").where(F.size("repeats") > 0)


def _total(spans: str):
    return F.coalesce(F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0]), F.lit(0).cast("long"))


def _text(spans: str):
    return F.coalesce(F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x[0].cast("string"), x[1].cast("string"))), ","), F.lit(""))


def report(docs: DataFrame, min_run: int = MIN_RUN, slots: int | None = None) -> DataFrame:
    """Per row: whether its document shares a passage with another, and where; what of it is dropped."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.char_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_chars"))
    both = rows.join(repeated_spans(docs, min_run, slots), "doc_id", "left")
    return both.select("doc_id", "n_chars", F.col("repeats").isNotNull().alias("has_repeat"), _total("repeats").alias("n_repeat_chars"), _total("dropped").alias("n_dropped_chars"), _text("repeats").alias("repeat_spans"), _text("dropped").alias("dropped_spans"))


def drop_repeats(docs: DataFrame, min_run: int = MIN_RUN, slots: int | None = None) -> DataFrame:
    """``docs`` without the dropped spans."""
    own = repeated_spans(docs, min_run, slots).select(F.col("doc_id").alias("__entwyne_id"), F.col("dropped").alias("__entwyne_spans"))
    joined = docs.join(own, docs["doc_id"].cast("long") == F.col("__entwyne_id"), "left")
    edges = F.flatten(F.concat(F.array(F.array(F.lit(0).cast("long"))), F.col("__entwyne_spans"), F.array(F.array(F.char_length("text").cast("long")))))
    # Edges are 0, start, end, start, end, ..., length: what stays lies between each even place and the next.
    kept = F.transform(F.sequence(F.lit(0), F.size("__entwyne_spans")), lambda i: F.substr(F.col("text"), (edges[2 * i] + 1).cast("int"), F.greatest(F.lit(0).cast("long"), edges[2 * i + 1] - edges[2 * i]).cast("int")))
    text = F.when(F.size("__entwyne_spans") > 0, F.array_join(kept, "")).otherwise(F.col("text"))
    return joined.withColumn("text", text).drop("__entwyne_id", "__entwyne_spans")
