"""Byte-level BPE on padded numpy matrices.

Pieces of similar length share a matrix, one row each, with ids of single bytes and padding behind. In each round every
row merges its leftmost pair of least rank: a hash table over (left id, right id) gives ranks of pairs, an index shifts
the rest of the row left, the two pairs beside the merge are looked up anew, and rows without a pair leave the matrix.
Rounds stop when no row is left. Pieces of more than ``MATRIX_BYTES`` bytes, for which so many rounds would be slow, go
through a heap over a linked list, which makes the same merges in the same order.

Defined results: a null text is empty; the empty text has no ids; text of any length is encoded whole; decoding gives the
text's UTF-8 back. Repeated rows each get their answer; other columns stay; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MATRIX_BYTES = 256
#: Words of a generation of a worker's memory; about 350 bytes each, two generations at most.
CACHE_WORDS = 120_000
_NONE = np.int32(2**31 - 1)

#: The white space that the pattern means by \s: Unicode's White_Space.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class PairTable:
    """Open addressing over left << 32 | right, probed for whole arrays at once."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        size = 1 << max(4, (len(pairs) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - size.bit_length() + 1), np.int64(size - 1)
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32)
        keys = np.array([a << 32 | b for a, b in pairs], dtype=np.int64)
        ranks = np.array(list(pairs.values()), dtype=np.int32)
        at = self._home(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]], self.ranks[at[free]] = keys[free], ranks[free]  # of several, the last stays
            left = self.keys[at] != keys
            keys, ranks, at = keys[left], ranks[left], (at[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        out = np.full(keys.shape, _NONE, np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        keys = keys.ravel()[open_]
        at, flat = self._home(keys), out.reshape(-1)
        while len(open_):
            there = self.keys[at]
            hit = there == keys
            flat[open_[hit]] = self.ranks[at[hit]]
            go = ~hit & (there != -1)
            open_, keys, at = open_[go], keys[go], (at[go] + 1) & self.mask
        return out


class BytePairs:
    """Ranks of byte strings, with encoding of pieces and decoding of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.single = np.array([ranks[bytes([c])] for c in range(256)], dtype=np.int32)
        self.table = PairTable(self._pairs())
        self._by_pair: dict[tuple[int, int], int] | None = None

    def _pairs(self) -> dict[tuple[int, int], int]:
        """Rank by (left id, right id) of every way to cut a token into two tokens."""
        ranks, pairs = self.ranks, {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        return pairs

    @classmethod
    def read(cls, path: str) -> BytePairs:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece."""
        out: list[list[int]] = [[] for _ in pieces]
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if p in self.ranks:
                out[i] = [self.ranks[p]]
            elif len(p) > MATRIX_BYTES:
                out[i] = self._long(p)
            elif p:
                width = 1 << (len(p) - 1).bit_length() if len(p) > 4 else 4
                buckets.setdefault(width if len(p) > width * 3 // 4 or width <= 4 else width * 3 // 4, []).append(i)
        for width, rows in buckets.items():
            step = max(1, 65_536 // width)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[list[int]]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        length = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width) < length[:, None], self.single[raw], -1).astype(np.int32)
        done = np.full_like(ids, -1)
        row = np.arange(len(pieces))
        rank = self.table(ids[:, :-1], ids[:, 1:])
        while True:
            at = rank.argmin(axis=1)
            least = rank[np.arange(len(row)), at]
            going = least != _NONE
            if not going.all():
                done[row[~going], : ids.shape[1]] = ids[~going]
                ids, rank, row, at, least = ids[going], rank[going], row[going], at[going], least[going]
            if not len(row):
                break
            lines, w = np.arange(len(row)), ids.shape[1]
            ids[lines, at] = least
            take = np.arange(w - 1) + (np.arange(w - 1) > at[:, None])
            ids = np.take_along_axis(ids, take, axis=1)
            if w == 2:
                done[row, 0] = ids[:, 0]
                break
            rank = np.take_along_axis(rank, np.minimum(np.arange(w - 2) + (np.arange(w - 2) >= at[:, None]), w - 2), axis=1)
            for side in (at - 1, at):
                ok = (side >= 0) & (side < w - 2)
                r, c = lines[ok], side[ok]
                rank[r, c] = self.table(ids[r, c], ids[r, c + 1])
        used = (done >= 0).sum(axis=1).tolist()
        return [x[:n] for x, n in zip(done.tolist(), used, strict=True)]

    def _long(self, piece: bytes) -> list[int]:
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        if self._by_pair is None:  # only long pieces need it
            self._by_pair = self._pairs()
        pairs = self._by_pair
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or ids[i] != left or ids[j] != right:
                continue
            ids[i], alive[j], after[i] = rank, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := pairs.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return [x for x, ok in zip(ids, alive, strict=True) if ok]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class TextCoder:
    """Whole texts by a rank file and a pattern. A worker keeps it, and the words it has met, between tasks.

    Patterns of this kind never join what stands on both sides of a U+0020 that a non-space character follows, so a text
    may be cut there and equal pieces encoded once.
    """

    _kept: dict[tuple[str, str], TextCoder] = {}
    _odd = re.compile(r" (?=\s|\Z)")

    def __init__(self, path: str, pattern: str):
        import regex

        self.pairs = BytePairs.read(path)
        self.pattern = regex.compile(pattern.replace(r"[^\s", rf"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))
        #: Words of this generation and of the one before; a word of the older one that is met again moves up.
        self.words: dict[str, tuple[bytes, int, bytes]] = {}
        self.older: dict[str, tuple[bytes, int, bytes]] = {}

    @classmethod
    def at(cls, path: str, pattern: str) -> TextCoder:
        if (path, pattern) not in cls._kept:
            cls._kept[path, pattern] = cls(path, pattern)
        return cls._kept[path, pattern]

    @classmethod
    def cut(cls, text: str) -> list[str]:
        parts = text.split(" ")
        if cls._odd.search(text):
            out = [parts[0]]
            for w in parts[1:]:
                if not w or w[0].isspace():
                    out[-1] += " " + w
                else:
                    out.append(" " + w)
            return out
        return [parts[0], *[" " + w for w in parts[1:]]]

    def learn(self, words: list[str]) -> None:
        """Ids of new words, all their distinct pieces at once."""
        split = [[m.encode() for m in self.pattern.findall(w)] for w in words]
        pieces = list({p for s in split for p in s})
        ids = dict(zip(pieces, self.pairs.encode(pieces), strict=True))
        for w, s in zip(words, split, strict=True):
            own = [i for p in s for i in ids[p]]
            self.words[w] = (b",".join(b"%d" % i for i in own), len(own), self.pairs.decode(own))

    def look_up(self, texts: list[str]) -> list[list[tuple[bytes, int, bytes]]]:
        if len(self.words) > CACHE_WORDS:
            self.older, self.words = self.words, {}
        cut = [self.cut(t) for t in texts]
        known, older, new = self.words, self.older, []
        for w in {w for c in cut for w in c if w not in known}:
            got = older.get(w)
            if got is None:
                new.append(w)
            else:
                known[w] = got
        self.learn(new)
        return [[known[w] for w in c] for c in cut]

    def encode(self, text: str) -> list[int]:
        return [int(i) for part, n, _ in self.look_up([text])[0] if n for i in part.split(b",")]


def encode_column(tokenizer: str, pattern: str):
    """A column function: text to array of ids."""

    def run(col: pa.Array) -> pa.Array:
        coder = TextCoder.at(tokenizer, pattern)
        return pa.array([coder.encode(t or "") for t in col.to_pylist()], pa.list_(pa.int32()))

    return F.arrow_udf(run, T.ArrayType(T.IntegerType()))


def decode_column(tokenizer: str, pattern: str):
    """A column function: array of ids to bytes."""

    def run(col: pa.Array) -> pa.Array:
        pairs = TextCoder.at(tokenizer, pattern).pairs
        return pa.array([None if ids is None else pairs.decode(ids) for ids in col.to_pylist()], pa.binary())

    return F.arrow_udf(run, T.BinaryType())


_DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def round_trip(docs: DataFrame, tokenizer: str, pattern: str) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the bytes they decode to."""

    def run(col: pa.Array) -> pa.Array:
        coder, out = TextCoder.at(tokenizer, pattern), []
        for at in range(0, len(col), 256):
            for own in coder.look_up([t or "" for t in col.slice(at, 256).to_pylist()]):
                ids = b",".join([x[0] for x in own if x[1]])
                out.append((sum(x[1] for x in own), hashlib.sha256(ids).hexdigest(), hashlib.sha256(b"".join([x[2] for x in own])).hexdigest()))
        n, ids, decoded = zip(*out, strict=True) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    got = docs.select("doc_id", F.arrow_udf(run, _DIGESTS)(F.col("text").cast("string")).alias("r"))
    return got.select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")
