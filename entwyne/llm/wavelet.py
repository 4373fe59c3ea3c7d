"""Token ids as wavelet matrices, one compressed file per shard.

A shard holds consecutive documents in ascending doc_id order. Its token sequence is kept as bit-planes, most
significant first; each plane is ordered by a stable partition on the planes above (the wavelet matrix of Claude,
Navarro and Ordonez). Planes are cut into blocks that are compressed on their own, with the count of ones before each
block beside them, so that access, rank, select and occurrence lookup touch one block of each plane.

Shards travel as one row of one Parquet file each: Spark's commit protocol then makes a lost task harmless, and any
store that Spark writes to will do. ``WaveletShard.to_bytes`` is the format itself and needs no Spark.

Defined results: a null text is empty; an empty text is the end id alone; rows with a null doc_id come first; rows of
one doc_id follow each other in order of their texts; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from entwyne.llm.common import keyed_text, new_path, slices

MAGIC = b"EWM1"
#: Bits of a plane that are compressed together; a multiple of 8.
BLOCK_BITS = 1 << 17
#: A shard is closed at the first document end after so many tokens.
SHARD_TOKENS = 2_000_000
#: Words of a generation of a worker's memory; about 200 bytes each, two generations at most.
CACHE_WORDS = 1_600_000

_HEAD = struct.Struct("<4sIQQI")
SHARD_SCHEMA = "part int, seq int, n_docs long, n_tokens long, shard binary"
DOC_SCHEMA = "part int, seq int, pos int, doc_id long, rel_start long, n_tokens long, ids_crc32 long"


class WaveletShard:
    """A wavelet matrix over the tokens of some documents, with their ids and lengths."""

    def __init__(self, doc_ids, doc_null, lengths, n_bits, zeros, ranks, blocks):
        self.doc_ids, self.doc_null, self.lengths = doc_ids, doc_null, lengths
        self.n_bits, self.zeros, self.ranks, self.blocks = n_bits, zeros, ranks, blocks
        self.n = int(lengths.sum()) if len(lengths) else 0
        self._open: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def build(cls, tokens: np.ndarray, doc_ids: list[int | None], lengths: list[int], n_bits: int) -> WaveletShard:
        dtype = np.uint16 if n_bits <= 16 else np.uint32
        seq = np.ascontiguousarray(tokens, dtype=dtype)
        zeros, ranks, blocks = [], [], []
        packer = zstandard.ZstdCompressor(level=1)
        for level in range(n_bits):
            ones = (seq & dtype(1 << (n_bits - 1 - level))) != 0
            zeros.append(len(seq) - int(np.count_nonzero(ones)))
            packed = np.packbits(ones)
            step = BLOCK_BITS // 8
            parts = [packed[i : i + step] for i in range(0, len(packed), step)]
            counts = [int(np.bitwise_count(x).sum()) for x in parts]
            ranks.append(np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32))
            blocks.append([packer.compress(x.tobytes()) for x in parts])
            seq = np.concatenate([seq[~ones], seq[ones]])
        null = np.array([x is None for x in doc_ids], dtype=np.uint8)
        ids = np.array([0 if x is None else x for x in doc_ids], dtype=np.int64)
        return cls(ids, null, np.array(lengths, dtype=np.int64), n_bits, zeros, ranks, blocks)

    def to_bytes(self) -> bytes:
        out = [_HEAD.pack(MAGIC, self.n_bits, self.n, len(self.doc_ids), BLOCK_BITS)]
        out += [self.doc_ids.tobytes(), self.doc_null.tobytes(), self.lengths.tobytes()]
        for level in range(self.n_bits):
            sizes = np.array([len(b) for b in self.blocks[level]], dtype=np.uint32)
            out += [struct.pack("<Q", self.zeros[level]), self.ranks[level].tobytes(), sizes.tobytes(), *self.blocks[level]]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletShard:
        magic, n_bits, n, docs, block_bits = _HEAD.unpack_from(data, 0)
        if magic != MAGIC or block_bits != BLOCK_BITS:
            raise ValueError("not a wavelet shard of this version")
        at = _HEAD.size

        def take(dtype, count):
            nonlocal at
            got = np.frombuffer(data, dtype=dtype, count=count, offset=at)
            at += got.nbytes
            return got

        ids, null, lengths = take(np.int64, docs), take(np.uint8, docs), take(np.int64, docs)
        n_blocks = -(-n // BLOCK_BITS)
        zeros, ranks, blocks = [], [], []
        for _ in range(n_bits):
            zeros.append(struct.unpack_from("<Q", data, at)[0])
            at += 8
            ranks.append(take(np.uint32, n_blocks + 1))
            sizes = take(np.uint32, n_blocks)
            own = []
            for size in sizes.tolist():
                own.append(data[at : at + size])
                at += size
            blocks.append(own)
        return cls(ids, null, lengths, n_bits, zeros, ranks, blocks)

    def _bits(self, level: int, block: int) -> np.ndarray:
        key = (level, block)
        if key not in self._open:
            if len(self._open) > 64:
                self._open.clear()
            raw = zstandard.ZstdDecompressor().decompress(self.blocks[level][block], max_output_size=BLOCK_BITS // 8)
            self._open[key] = np.frombuffer(raw, dtype=np.uint8)
        return self._open[key]

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, rest = divmod(i, BLOCK_BITS)
        got = int(self.ranks[level][block])
        if rest:
            bits = self._bits(level, block)
            got += int(np.bitwise_count(bits[: rest // 8]).sum())
            if rest % 8:
                got += (int(bits[rest // 8]) >> (8 - rest % 8)).bit_count()
        return got

    def _bit(self, level: int, i: int) -> int:
        block, rest = divmod(i, BLOCK_BITS)
        return (int(self._bits(level, block)[rest // 8]) >> (7 - rest % 8)) & 1

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of this value in a plane."""
        ranks = self.ranks[level].astype(np.int64)
        if not bit:
            ranks = np.minimum(np.arange(len(ranks)) * BLOCK_BITS, self.n) - ranks
        block = int(np.searchsorted(ranks, k, side="right")) - 1
        bits = np.unpackbits(self._bits(level, block))[: self.n - block * BLOCK_BITS]
        return block * BLOCK_BITS + int(np.flatnonzero(bits == bit)[k - ranks[block]])

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level in range(self.n_bits):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            token = token << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return token

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        for level in range(self.n_bits):
            a, b = self._rank1(level, start), self._rank1(level, end)
            if token >> (self.n_bits - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of a token between two places (rank)."""
        if token < 0 or token >> self.n_bits:
            return 0
        low, high = self._range(token, start, self.n if end is None else end)
        return high - low

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of a token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, 0, self.n)[0] + k
        for level in reversed(range(self.n_bits)):
            bit = token >> (self.n_bits - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def tokens(self) -> np.ndarray:
        """The whole sequence, by undoing the partitions from the last plane up."""
        dtype = np.uint16 if self.n_bits <= 16 else np.uint32
        seq = np.zeros(self.n, dtype=dtype)
        opener = zstandard.ZstdDecompressor()
        for level in reversed(range(self.n_bits)):
            raw = b"".join(opener.decompress(b, max_output_size=BLOCK_BITS // 8) for b in self.blocks[level])
            ones = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=self.n).view(bool)
            up = np.empty_like(seq)
            up[~ones] = seq[: self.zeros[level]]
            up[ones] = seq[self.zeros[level] :] | dtype(1 << (self.n_bits - 1 - level))
            seq = up
        return seq


class WordTable:
    """Ids of words, found by two 64-bit digests of their bytes, with all look-ups of a batch at once.

    A word's digests are differences of prefix sums over the bytes of the text, moved to the same place and mixed.
    """

    SLOTS = 1 << 22

    def __init__(self, dtype: np.dtype):
        rng = np.random.Generator(np.random.PCG64(20031))
        self.letters = rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64)
        self.bases = [int(x) * 2 + 1 for x in rng.integers(1 << 60, 1 << 62, 2)]
        self.powers: list[tuple[np.ndarray, np.ndarray]] = []
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.first, self.second = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.uint64)
        self.word = np.full(self.SLOTS, -1, np.int32)
        self.n, self.n_ids = 0, 0
        self.ids, self.begin, self.length = np.zeros(1 << 16, self.dtype), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def digests(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.powers or len(self.powers[0][0]) < len(raw):
            self.powers = []
            for base in self.bases:
                pair = []
                for b in (base, pow(base, -1, 1 << 64)):
                    steps = np.full(max(1 << 16, 2 * len(raw)), b, np.uint64)
                    steps[0] = 1
                    pair.append(np.cumprod(steps))
                self.powers.append((pair[0], pair[1]))
        out = []
        for letters, (power, inverse) in zip(self.letters, self.powers, strict=True):
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(letters[raw] * power[: len(raw)], out=sums[1:])
            h = (sums[end] - sums[start]) * inverse[np.minimum(start, max(0, len(raw) - 1))] + (end - start).astype(np.uint64)
            for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
                h = (h ^ (h >> np.uint64(33))) * np.uint64(by)
            out.append(h ^ (h >> np.uint64(33)))
        return out[0], out[1]

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of each word, or -1."""
        out, mask = np.full(len(a), -1, np.int64), np.uint64(self.SLOTS - 1)
        rest, at = np.arange(len(a)), (a & mask).astype(np.int64)
        while len(rest):
            there = self.word[at]
            same = (there >= 0) & (self.first[at] == a[rest]) & (self.second[at] == b[rest])
            out[rest[same]] = there[same]
            on = (there >= 0) & ~same
            rest, at = rest[on], (at[on] + 1) & int(mask)
        return out

    def add(self, a: np.ndarray, b: np.ndarray, ids: list[bytes]) -> None:
        """Further words, all different and new, with their ids; those without digests can only be known by number."""
        flat = np.frombuffer(b"".join(ids), self.dtype)
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        number = np.arange(self.n, self.n + len(ids), dtype=np.int32)
        while self.n + len(ids) > len(self.begin):
            self.begin, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length))
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.begin[self.n : self.n + len(ids)] = self.n_ids + np.cumsum(length) - length
        self.length[self.n : self.n + len(ids)] = length
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.n, self.n_ids = self.n + len(ids), self.n_ids + len(flat)
        rest, at = np.arange(len(a)), (a & np.uint64(self.SLOTS - 1)).astype(np.int64)
        while len(rest):
            free = self.word[at] < 0
            self.word[at[free]] = number[rest[free]]  # of several for one slot the last one has it
            won = free & (self.word[at] == number[rest])
            self.first[at[won]], self.second[at[won]] = a[rest[won]], b[rest[won]]
            rest, at = rest[~won], (at[~won] + 1) & (self.SLOTS - 1)

    def gather(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these words one after the other, and where each word's end."""
        own = self.length[number]
        end = np.cumsum(own)
        return self.ids[np.repeat(self.begin[number] - (end - own), own) + np.arange(int(end[-1]) if len(end) else 0)], end


class WordEncoder:
    """Whole texts to ids, with a memory of words that a worker keeps between tasks.

    The byte-level pre-tokenizer never joins what stands on both sides of a U+0020 that a non-space character follows,
    nor a letter with the full stop or comma behind it, so a text may be cut there and equal pieces encoded once.
    """

    _kept: dict[str, WordEncoder] = {}
    #: A space that may not be cut at, and all other reasons to give a text to the library as a whole.
    _odd = re.compile(r" (?=\s|\Z)")
    #: Words that are one piece whatever version of Unicode the pattern knows.
    _plain = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Texts that hold one of these go whole to the library.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.n_bits = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self.dtype = np.dtype("<u2" if self.n_bits <= 16 else "<u4")
        self.code = "H" if self.n_bits <= 16 else "I"
        self.table = WordTable(self.dtype)
        self.stops = {c: self._ask([c])[0] for c in ".,"}
        self._forget()
        # The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.alphabet = {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}

    @classmethod
    def at(cls, path: str) -> WordEncoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _forget(self) -> None:
        """Words 0 and 1 are the full stop and the comma; no digest leads to them."""
        self.table.clear()
        self.table.add(np.zeros(0, np.uint64), np.zeros(0, np.uint64), list(self.stops.values()))

    def _ask(self, words: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for at in range(0, len(words), 4096) for e in self.tokenizer.encode_batch_fast(words[at : at + 4096], add_special_tokens=False)]

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of words with a space in front."""
        # A word of plain letters is one piece, for which the vocabulary's model can be asked without the steps around it.
        plain, code, alphabet, tokenize = self._plain, self.code, self.alphabet, self.tokenizer.model.tokenize
        out, asked = [], []
        for k, w in enumerate(words):
            stop = b""
            if len(w) > 1 and w[-1] in ".," and w[-2].isalpha():
                w, stop = w[:-1], self.stops[w[-1]]
            if plain(w):
                out.append(array(code, [t.id for t in tokenize((" " + w).encode().decode("latin-1").translate(alphabet))]).tobytes() + stop)
            else:
                asked.append((k, w, stop))
                out.append(b"")
        for (k, _, stop), ids in zip(asked, self._ask([" " + w for _, w, _ in asked]), strict=True):
            out[k] = ids + stop
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of the shard's width."""
        odd = [self._odd.search(t) is not None or any(a in t for a in self.added) for t in texts]
        whole = iter(self._ask([t for t, o in zip(texts, odd, strict=True) if o]))
        cut = iter(self._encode_cut([t for t, o in zip(texts, odd, strict=True) if not o]))
        return [next(whole if o else cut) for o in odd]

    def _encode_cut(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        # One row of bytes: each text's first word, which has no space in front, is asked for by itself.
        heads = [t.split(" ", 1) for t in texts]
        data = [b" " + h[1].encode("utf-8", "surrogatepass") if len(h) > 1 else b"" for h in heads]
        raw = np.frombuffer(b"".join(data), np.uint8)
        start = np.flatnonzero(raw == 32) + 1
        end = np.concatenate([start[1:] - 1, [len(raw)]]) if len(start) else start
        if self.table.n > CACHE_WORDS:
            self._forget()
        # A full stop or comma behind an ASCII letter, with nothing behind it, is a piece of its own.
        last = raw[np.maximum(end - 1, 0)]
        before = raw[np.maximum(end - 2, 0)] | 32
        stop = ((last == 46) | (last == 44)) & (end - start > 1) & (before >= 97) & (before <= 122)
        end = end - stop
        a, b = self.table.digests(raw, start, end)
        number = self.table.find(a, b)
        miss = np.flatnonzero(number < 0)
        if len(miss):
            _, one = np.unique(a[miss] ^ (b[miss] * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
            new = miss[one]
            buffer = raw.tobytes()
            self.table.add(a[new], b[new], self._learn([buffer[i:j].decode("utf-8", "surrogatepass") for i, j in zip(start[new].tolist(), end[new].tolist(), strict=True)]))
            number[miss] = self.table.find(a[miss], b[miss])
        unit = np.arange(len(number) + 1) + np.concatenate([[0], np.cumsum(stop)])
        units = np.empty(unit[-1], np.int64)
        units[unit[:-1]] = number
        units[unit[:-1][stop] + 1] = last[stop] == 44
        ids, ends = self.table.gather(units)
        ends = np.concatenate([[0], ends])
        edge = ends[unit[np.searchsorted(start, np.cumsum([0, *map(len, data)]), side="right")]]
        return [h + ids[i:j].tobytes() for h, i, j in zip(self._ask([h[0] for h in heads]), edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def _encode(path: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        encoder = WordEncoder.at(path)
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        part, seq, ids, data, held = TaskContext.get().partitionId(), 0, [], [], 0

        def close():
            nonlocal seq, ids, data, held
            tokens = np.frombuffer(b"".join(data), dtype=encoder.dtype)
            lengths = [len(x) // encoder.dtype.itemsize for x in data]
            blob = WaveletShard.build(tokens, ids, lengths, encoder.n_bits).to_bytes()
            row = [[part], [seq], [len(ids)], [len(tokens)], [blob]]
            seq, ids, data, held = seq + 1, [], [], 0
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], ["part", "seq", "n_docs", "n_tokens", "shard"])

        for batch in slices(batches, 256):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, got in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                ids.append(doc_id)
                data.append(got + end)
                held += len(data[-1]) // encoder.dtype.itemsize
                if held >= shard_tokens:
                    yield close()
        if ids:
            yield close()

    return run


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode documents into shards of ascending doc_id at ``path``; returns the written shards."""
    spark = docs.sparkSession
    # Rows of one doc_id (or none) may go to several tasks, dealt by a digest of the text and their place in the input.
    rows = keyed_text(docs).withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    placed = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "h", "row").drop("h", "row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    placed.mapInArrow(_encode(tokenizer, end_id, shard_tokens), SHARD_SCHEMA).write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(path)
    return read_shards(spark, path)


def read_shards(spark, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("pos", pa.int32()), ("doc_id", pa.int64()), ("rel_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in slices(batches, 1):
        part, seq, blob = (batch.column(batch.schema.get_field_index(c))[0].as_py() for c in ("part", "seq", "shard"))
        shard = WaveletShard.from_bytes(blob)
        wide = shard.tokens().astype("<u4").tobytes()
        ends = np.cumsum(shard.lengths)
        starts = ends - shard.lengths
        crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        n = len(crc)
        ids = pa.array(shard.doc_ids, pa.int64(), mask=shard.doc_null.astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(np.arange(n, dtype=np.int32)), ids, pa.array(starts), pa.array(shard.lengths), pa.array(crc, pa.int64())], schema=schema)


def document_index(shards: DataFrame) -> DataFrame:
    """Per document, read from the shards: its start among all ids, its length and the checksum of its ids.

    Starts are summed in three short steps: parts (as many as the writer had tasks), shards of a part, documents of a shard.
    """
    sizes = shards.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "seq", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("shard_start")).join(parts, "part")
    rows = shards.select("part", "seq", "shard").mapInArrow(_decode, DOC_SCHEMA)
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("part_start") + F.col("shard_start") + F.col("rel_start")).alias("start"), "n_tokens", "ids_crc32")


def token_shards(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards of ``docs`` and index what was written."""
    return document_index(write_shards(docs, path or new_path(docs.sparkSession, "wavelet"), tokenizer, end_id, shard_tokens))


__all__ = ["WaveletShard", "WordEncoder", "document_index", "read_shards", "token_shards", "write_shards"]
