"""Near-duplicate documents: MinHash bands find candidates, odd sketches screen them, whole shingle sets confirm.

1. Each text gets its shingle set (runs of ``shingle`` words, A-Z lower-cased), a digest of the set, ``BANDS * ROWS``
   MinHash samples folded into band keys, and an odd sketch: of the hashes in each of ``BINS`` ranges the least is a
   further MinHash sample, and sample i with value v toggles bit h(i, v) of a bitmap. A sample that two sets don't share
   toggles one bit or two, so the population count of two sketches' XOR tells how many they don't share.
2. Equal sets are one class, with a number of its own; only classes go on.
3. In each bucket of a band the first class is the pivot and every other member is paired with it: as many pairs as
   members. Pairs that sketch and set sizes don't rule out are confirmed on whole sets; links make components.
4. A bucket whose members are still in several components may hide links between members that are no pivot. Members
   outside its largest component are compared with all members of other components, within blocks of the bucket: sketches
   rule pairs out, digests of all their shingles confirm the others, and a link joins their components for the rest of
   the task. A task puts out only such links, so fewer than it has components; a pair is compared in the first band that
   its classes share.

No step puts out all pairs of a bucket, gathers a bucket in a task, or brings links or components to the driver.

A link is missed only if its classes share no band key (one in seven million at similarity 0.8, one in three hundred
million at 0.85) or their sketches differ in over ``DEVIATIONS`` standard deviations more bits than expected.

Defined results: a text without words has an empty set, its own component and no links; fewer words than a shingle make
one shingle of all; of rows that share a doc_id each gets the component of its own set, and ``keep_one`` judges each; a row with a null doc_id is linked
with nothing, its component is null and it is kept; an empty table gives no rows; columns other than doc_id and text are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entwyne.llm.common import discard, keyed_text, materialise, raw_texts, slices

BANDS, ROWS = 30, 4
SAMPLES = BANDS * ROWS
BINS, SKETCH_BITS = 2048, 4096
DEVIATIONS = 5.0
#: Classes of a bucket, and shingles of these, that are compared within one task.
BLOCK, BLOCK_SHINGLES = 8192, 8_000_000
#: Ids that go to all executors to thin a scan (8 bytes each); more are joined by shuffles.
BROADCAST_IDS = 1_000_000

_RNG = np.random.Generator(np.random.PCG64(20240229))
_MUL = _RNG.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def shingles(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    if len(words) < size:
        return {tuple(words)}
    return set(zip(*(words[i:] for i in range(size)), strict=False))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _P[1]
    return x ^ (x >> np.uint64(29))


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """64-bit hashes of the distinct shingles, sorted."""
    if not words:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    h = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        h = _mix(h * _P[0] + own[k : len(words) - width + 1 + k])
    return np.unique(h)


def samples(hashes: np.ndarray) -> np.ndarray:
    out = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(out, (hashes[at : at + 2048, None] * _MUL + _ADD).min(axis=0), out=out)
    return out


def bands(sample: np.ndarray) -> np.ndarray:
    grid = sample.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key * _P[2] + grid[:, k])
    return key.view(np.int64)


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """From sorted hashes: the first of each range is its sample."""
    own = (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.zeros(0, bool)
    place = (_mix(hashes[first] ^ (own[first].astype(np.uint64) * _P[2])) % np.uint64(SKETCH_BITS)).astype(np.int64)
    bits = np.bincount(place, minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def _toggles(similarity: float, total, exp):
    """Ranges with one hash of the union and with more, of sets whose sizes add up to ``total``."""
    load = total / ((1 + similarity) * BINS)
    alone = BINS * load * exp(-load)
    return alone, BINS * (1 - exp(-load)) - alone


def most_bits(percent: int, total, exp=np.exp, sqrt=np.sqrt):
    """Bits in which sketches of sets this similar differ at most. Two samples that meet in a bit only make it fewer."""
    q = 1 - percent / 100
    alone, several = _toggles(percent / 100, total, exp)
    # Samples that are alone in their range are drawn without replacement: the more of the union they are, the less they vary.
    spread = alone * (1 - alone * (1 + percent / 100) / total) + 4 * several
    return q * (alone + 2 * several) + DEVIATIONS * sqrt(q * (1 - q) * spread) + 1


def similarity_estimate(differing_bits: int, total: int) -> float:
    """Jaccard similarity from the population count of two sketches' XOR, for sets whose sizes add up to ``total``."""
    low, high = 0.0, 1.0
    for _ in range(40):
        mid = (low + high) / 2
        alone, several = _toggles(mid, total, np.exp)
        expected = SKETCH_BITS / 2 * (1 - np.exp(-2 * (1 - mid) * (alone + 2 * several) / SKETCH_BITS))
        low, high = (mid, high) if expected > differing_bits else (low, mid)
    return low


def _sign(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            n, digest, keys, sketch = [], [], [], []
            for text in raw_texts(batch):
                hashes = shingle_hashes(tokens(text), shingle)
                n.append(len(hashes))
                if len(hashes):
                    sample = samples(hashes)
                    digest.append(blake2b(hashes.tobytes(), digest_size=16).digest())
                    keys.append(bands(sample))
                    sketch.append(odd_sketch(hashes).view(np.int64))
                else:
                    digest.append(None)
                    keys.append(None)
                    sketch.append(None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, longs), pa.array(sketch, longs)], ["doc_id", "h", "n_shingles", "digest", "bands", "sketch"])

    return run


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text and h, a digest of the text: with the doc_id it tells rows apart."""
    return keyed_text(docs).withColumn("h", F.xxhash64("text"))


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    return _hashed(docs).mapInArrow(_sign(shingle), "doc_id long, h long, n_shingles long, digest binary, bands array<long>, sketch array<long>")


def classes(signed: DataFrame) -> DataFrame:
    """Written table of one row per set: a number, its smallest doc_id (with that text's digest), size and sketches."""
    own = signed.where("doc_id is not null and digest is not null").groupBy("digest")
    own = own.agg(F.min(F.struct("doc_id", "h")).alias("doc"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    return materialise(own.select(F.monotonically_increasing_id().alias("id"), "digest", "doc.doc_id", "doc.h", "n", "bands", "sketch"), "classes")


def _screened(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that set sizes and odd sketches don't rule out."""
    own = reps.select("id", "n", "sketch")
    left = own.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = own.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    differ = reduce(Column.__add__, [F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(SKETCH_BITS // 64)])
    sized = F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")
    return pairs.join(left, "a").join(right, "b").where(sized & (differ <= most_bits(percent, F.col("na") + F.col("nb"), F.exp, F.sqrt))).select("a", "b").distinct()


def _confirm(percent: int, shingle: int):
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        out, known = [], ("", set())
        for a, b in zip(left.cast(pa.binary()).to_pylist(), right.cast(pa.binary()).to_pylist(), strict=True):
            if known[0] != b:
                known = b, shingles(tokens(b), shingle)
            own, other = shingles(tokens(a), shingle), known[1]
            same = len(own & other)
            out.append(100 * same >= percent * (len(own) + len(other) - same))
        return pa.array(out, pa.bool_())

    return F.arrow_udf(run, T.BooleanType())


def _texts(ids: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, text) of the classes whose ``id`` is in the written table ``ids``; a row that is repeated comes once."""
    small = ids.count() <= BROADCAST_IDS
    wanted = reps.select("id", "doc_id", "h").join(F.broadcast(ids) if small else ids, "id", "left_semi")
    rows = _hashed(docs).where("doc_id is not null and text is not null")
    return rows.join(F.broadcast(wanted) if small else wanted, ["doc_id", "h"]).groupBy("id").agg(F.first("text").alias("text"))


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Pairs whose whole sets are similar enough. ``pairs`` is a written table."""
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    texts = _texts(ids, reps, docs)
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    met = pairs.hint("merge").join(left, "a").hint("merge").join(right.hint("merge"), "b")
    links = materialise(met.where(_confirm(percent, shingle)("ta", "tb")).select("a", "b"), "links")
    discard(ids)
    return links


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every linked id, component being the smallest id it reaches: alternating large and small stars.

    Each step takes a minimum per id, summed up within tasks first, and joins it back; all of it is written between steps.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        big = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        joined = big.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, materialise(small, "edges")
        discard(before)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    out = edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
    out._entwyne_path = edges._entwyne_path  # all that it reads
    return out


def _compare(percent: int, shingle: int):
    """Within a block: links between components, one for each time that two of them become one."""

    def run(batch: pa.Table) -> pa.Table:
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        matrix = lambda c: batch.column(c).combine_chunks().flatten().to_numpy().reshape(batch.num_rows, -1)
        ids, comp, n, probe, home = (column(c) for c in ("id", "comp", "n", "probe", "home"))
        comp, keys, sketch = comp.copy(), matrix("bands"), matrix("sketch").view(np.uint64)  # bits of negative numbers are not counted as they are
        band = int((keys[0] == batch.column("key")[0].as_py()).argmax())
        texts = batch.column("text").cast(pa.large_binary())
        sets: dict[int, np.ndarray] = {}

        def own(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingle_hashes(tokens(texts[k].as_py()), shingle)
            return sets[k]

        out: list[tuple[int, int]] = []
        for i in np.flatnonzero(probe).tolist():
            j = np.flatnonzero(home & (comp != comp[i]) & (~probe | (ids < ids[i])) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
            if len(j):
                j = j[(keys[j, : band + 1] == keys[i, : band + 1]).argmax(axis=1) == band]
            if not len(j):
                continue
            far = np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1, dtype=np.int64)
            close = far <= most_bits(percent, n[j] + n[i])
            j = j[close][np.argsort(far[close], kind="stable")]
            for k in j.tolist():
                if comp[k] != comp[i]:
                    same = len(np.intersect1d(own(i), own(k), assume_unique=True))
                    if 100 * same >= percent * (int(n[i]) + int(n[k]) - same):
                        comp[comp == comp[k]] = comp[i]
                        out.append((int(max(ids[i], ids[k])), int(min(ids[i], ids[k]))))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _hidden(buckets: DataFrame, comps: DataFrame, reps: DataFrame, docs: DataFrame, percent: int, shingle: int, block: int) -> DataFrame:
    """Step 4: links that join components which share a bucket, enough of them to join all that are linked there."""
    known = buckets.join(comps, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    mixed = known.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("size")).where("x <> y and size > 2").select("key", "size")
    own = materialise(known.join(mixed, "key"), "mixed")
    ids = materialise(own.select("id").distinct(), "ids")
    each = reps.select("id", "n", "bands", "sketch").join(_texts(ids, reps, docs), "id")
    sizes = own.join(reps.select("id", "n"), "id").groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    sizes = sizes.groupBy("key").agg(F.max_by("comp", F.struct("k", "comp")).alias("top"), F.sum("n").alias("total"))
    n_blocks = F.ceil(F.greatest(F.col("size") / block, F.col("total") / BLOCK_SHINGLES)).cast("int")
    rows = own.join(sizes, "key").withColumn("blocks", n_blocks).withColumn("probe", F.col("comp") != F.col("top")).withColumn("at", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    to = F.when(F.col("probe"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("at"))
    rows = rows.withColumn("block", F.explode(to)).withColumn("home", F.col("block") == F.col("at")).select("key", "id", "comp", "probe", "home", "block").join(each, "id")
    links = materialise(rows.groupBy("key", "block").applyInArrow(_compare(percent, shingle), "a long, b long"), "links")
    discard(own, ids)
    return links


def link(docs: DataFrame, percent: int = 85, shingle: int = 3, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows, and (digest, component) of every set."""
    signed = materialise(signatures(docs, shingle), "signed")
    reps = classes(signed)
    keyed = reps.select("id", F.explode("bands").alias("key"))
    pivots = keyed.groupBy("key").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = materialise(keyed.join(pivots, "key"), "buckets")
    pairs = materialise(_screened(buckets.where("id <> b").select(F.col("id").alias("a"), "b").distinct(), reps, percent), "pairs")
    links = _confirmed(pairs, reps, docs, percent, shingle)
    comps = components(links)
    more = _hidden(buckets.where("size > 2").select("key", "id"), comps, reps, docs, percent, shingle, block)
    if not more.isEmpty():
        comps = components(links.unionByName(more))
    # A component is known by its smallest doc_id.
    own = reps.select("digest", "id", "doc_id").join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    first = own.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = materialise(own.join(first, "component").select("digest", "component_id"), "components")
    discard(reps, buckets, pairs, links, comps, more)
    return signed, found


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = 3, block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, size of its set, component, and whether it is the one that stays."""
    return _judged(docs, percent, shingle, block).drop("h")


def _judged(docs: DataFrame, percent: int, shingle: int, block: int) -> DataFrame:
    signed, comps = link(docs, percent, shingle, block)
    merged = signed.select("doc_id", "h", "n_shingles", "digest").join(comps, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return merged.select("doc_id", "h", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 85, shingle: int = 3, block: int = BLOCK) -> DataFrame:
    """``docs`` without all but the first document of each component; rows that share a doc_id are judged one by one."""
    gone = materialise(_judged(docs, percent, shingle, block).where("not kept").select(F.col("doc_id").alias("__entwyne_gone"), F.col("h").alias("__entwyne_h")).distinct(), "gone")
    small = gone.count() <= BROADCAST_IDS
    met = (docs["doc_id"].cast("long") == F.col("__entwyne_gone")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__entwyne_h"))
    return docs.join(F.broadcast(gone) if small else gone, met, "left_anti")


__all__ = ["components", "keep_one", "near_duplicates", "odd_sketch", "similarity_estimate"]
