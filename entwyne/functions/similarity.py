"""String similarity. Set, n-gram, length and Levenshtein measures are column expressions; those that Spark can't express
run over Arrow batches, each distinct pair of a batch once, with all pairs side by side in numpy lanes.

Indel similarity is 2 LCS / (|a| + |b|); LCS goes by bit-parallel addition (Hyyro 2004) on one 64-bit word a pair, or on
several with carries where strings are longer. The scalar functions say what the lanes compute.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entwyne.functions.text import char_ngrams, tokens

#: Words of match tables held at a time, over all pairs of a step.
_TABLE_WORDS = 4_000_000
_ONE, _PAD = np.uint64(1), 0xFFFFFFFF


def lcs(a: str, b: str) -> int:
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    """1 for equal strings (two empty ones too), 0 for strings without a letter in common."""
    total = len(a) + len(b)
    return 2 * lcs(a, b) / total if total else 1.0


def token_sort(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """Best of comparing what is shared with what each side adds to it."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 1.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    best = indel(one, two)
    if both:
        best = max(best, indel(both, one), indel(both, two))
    return best


def partial(a: str, b: str) -> float:
    """Best Indel similarity of the shorter string with a window of its length in the longer; windows may hang over an end."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 1.0 if not long else 0.0
    if short in long:
        return 1.0
    m, best, letters = len(short), 0.0, set(short)
    for end in range(1, len(long) + m):
        low, high = max(0, end - m), min(end, len(long))
        # A window that doesn't end (or, hanging over the right, start) in a letter of the shorter is beaten by another.
        if long[high - 1] in letters if end <= len(long) else long[low] in letters:
            best = max(best, indel(short, long[low:high]))
            if best == 1.0:
                break
    return best


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, first = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                first.append(c)
                break
    if not first:
        return 0.0
    second = [c for c, t in zip(b, taken, strict=True) if t]
    swaps = sum(x != y for x, y in zip(first, second, strict=True)) // 2
    m = len(first)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * weight * (1 - jaro)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, one row a text, padded; and lengths."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    width = max(1, int(lengths.max(initial=0)))
    out = np.full((len(texts), width), _PAD, np.uint32)
    out[np.arange(width) < lengths[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, lengths


def _steps(a: list[str], b: list[str]) -> Iterator[slice]:
    """Slices of pairs whose match tables fit the bound."""
    longest = max(1, max(map(len, a), default=1))
    letters = len(set().union(*a)) + 1 if a else 1
    rows = max(1, _TABLE_WORDS // (letters * -(-longest // 64)))
    for at in range(0, len(a), rows):
        yield slice(at, at + rows)


def _table(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per pair, letter and word the places of ``a`` that hold the letter; and ``b`` as numbers of letters."""
    top = int(max(a[a != _PAD].max(initial=0), b[b != _PAD].max(initial=0))) + 1
    present = np.zeros(top + 1, bool)
    present[np.minimum(a, top)] = True
    present[top] = False
    letters = int(present.sum())
    number = np.where(present, np.cumsum(present) - 1, letters).astype(np.int32)
    own, other = number[np.minimum(a, top)], number[np.minimum(b, top)]
    table = np.zeros((-(-a.shape[1] // 64), len(a), letters + 1), np.uint64)
    rows = np.arange(len(a))
    for i in range(a.shape[1]):
        table[i // 64, rows, own[:, i]] |= _ONE << np.uint64(i % 64)
    table[:, :, letters] = 0
    return table, other


def _scan(table: np.ndarray, pair: np.ndarray, text: np.ndarray, every: bool = False) -> np.ndarray:
    """LCS of each lane's text with the string behind its pair's table; with ``every``, of all beginnings of the text."""
    words = [t.reshape(-1) for t in table]
    rest = [np.full(len(pair), 0xFFFFFFFFFFFFFFFF, np.uint64) for _ in words]
    base = pair * table.shape[2]
    places = np.ascontiguousarray(text.T)
    out = []
    for letter in places:
        at = base + letter
        carry = None
        for w, own in enumerate(words):
            v = rest[w]
            hit = own.take(at)
            hit &= v
            total = v + hit
            if len(words) > 1:
                over = total < v
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64)
            v ^= hit
            total |= v
            rest[w] = total
        if every:
            out.append(sum(64 - np.bitwise_count(v).astype(np.int64) for v in rest))
    return np.stack(out, axis=1) if every else sum(64 - np.bitwise_count(v).astype(np.int64) for v in rest)


def lcs_many(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs."""
    out = np.zeros(len(a), np.int64)
    for part in _steps(a, b):
        one, _ = _codes(a[part])
        two, _ = _codes(b[part])
        table, text = _table(one, two)
        out[part] = _scan(table, np.arange(len(one)), text)
    return out


def _ratio(common: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.where(total > 0, 2 * common / np.maximum(total, 1), 1.0)


def _lengths(texts: list[str]) -> np.ndarray:
    return np.fromiter(map(len, texts), np.int64, len(texts))


def indel_many(a: list[str], b: list[str]) -> np.ndarray:
    return _ratio(lcs_many(a, b), _lengths(a) + _lengths(b))


def token_sort_many(a: list[str], b: list[str]) -> np.ndarray:
    known = {t: " ".join(sorted(t.split())) for t in {*a, *b}}
    return indel_many([known[t] for t in a], [known[t] for t in b])


def token_set_many(a: list[str], b: list[str]) -> np.ndarray:
    known = {t: frozenset(t.split()) for t in {*a, *b}}
    out = np.zeros(len(a))
    rows, one, two, shared = [], [], [], []
    for k, (s, t) in enumerate(zip(a, b, strict=True)):
        x, y = known[s], known[t]
        if not x or not y:
            continue
        both = x & y
        if both and (len(both) == len(x) or len(both) == len(y)):
            out[k] = 1.0
            continue
        begin = sorted(both)
        rows.append(k)
        one.append(" ".join(begin + sorted(x - both)))
        two.append(" ".join(begin + sorted(y - both)))
        shared.append(" ".join(begin))
    if rows:
        n, n1, n2 = _lengths(shared), _lengths(one), _lengths(two)
        # What is shared begins both strings, so its LCS with either is its length.
        best = np.maximum(_ratio(n, n + n1), _ratio(n, n + n2))
        out[rows] = np.maximum(_ratio(lcs_many(one, two), n1 + n2), np.where(n > 0, best, 0.0))
    return out


def partial_many(a: list[str], b: list[str]) -> np.ndarray:
    short = [x if len(x) <= len(y) else y for x, y in zip(a, b, strict=True)]
    long = [y if len(x) <= len(y) else x for x, y in zip(a, b, strict=True)]
    out = np.array([(0.0 if y else 1.0) if not x else 1.0 if x in y else -1.0 for x, y in zip(short, long, strict=True)])
    todo = np.flatnonzero(out < 0)
    todo = todo[np.argsort(_lengths([short[k] for k in todo]), kind="stable")]
    own, other = [short[k] for k in todo], [long[k] for k in todo]
    best = np.zeros(len(todo))
    for part in _steps(own, other):
        for turned in (False, True):
            # Windows over an end are beginnings of the longer string, or of it turned round.
            one, n = _codes([x[::-1] for x in own[part]] if turned else own[part])
            two, m = _codes([x[::-1] for x in other[part]] if turned else other[part])
            table, text = _table(one, two)
            common = _scan(table, np.arange(len(one)), text[:, : one.shape[1]], every=True)
            size = np.arange(1, common.shape[1] + 1)
            inside = (size < n[:, None]) & (size <= m[:, None])
            best[part] = np.maximum(best[part], np.where(inside, _ratio(common, n[:, None] + size), 0.0).max(axis=1))
            if not turned:
                windows = m - n + 1
                pair = np.repeat(np.arange(len(one)), windows)
                start = np.arange(len(pair)) - np.repeat(np.cumsum(windows) - windows, windows)
                for at in range(0, len(pair), 65536):
                    p, first = pair[at : at + 65536], start[at : at + 65536]
                    place = first[:, None] + np.arange(int(n[p].max()))
                    lane = np.where(np.arange(place.shape[1]) < n[p][:, None], text[p[:, None], np.minimum(place, text.shape[1] - 1)], table.shape[2] - 1)
                    full = _scan(table, p, lane) / n[p]
                    np.maximum.at(best, np.arange(len(best))[part][p], full)
    out[todo] = best
    return out


def jaro_winkler_many(a: list[str], b: list[str], weight: float = 0.1) -> np.ndarray:
    out = np.array([1.0 if x == y else 0.0 if not x or not y else -1.0 if max(len(x), len(y)) <= 64 else jaro_winkler(x, y, weight) for x, y in zip(a, b, strict=True)])
    todo = np.flatnonzero(out < 0)
    own, other = [a[k] for k in todo], [b[k] for k in todo]
    made = []
    for part in _steps(other, own):
        one, n = _codes(own[part])
        two, m = _codes(other[part])
        table, text = _table(two, one)
        table = table[0]
        rows, reach = np.arange(len(one)), np.maximum(0, np.maximum(n, m) // 2 - 1)
        taken = np.zeros(len(one), np.uint64)
        matched = np.zeros(one.shape, bool)
        below = lambda k: np.where(k >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (_ONE << np.minimum(k, 63).astype(np.uint64)) - _ONE)
        for i in range(one.shape[1]):
            window = below(np.minimum(i + reach + 1, 64)) & ~below(np.maximum(0, i - reach))
            free = table[rows, text[:, i]] & window & ~taken
            first = free & (~free + _ONE)
            taken |= first
            matched[:, i] = first != 0
        at = ((taken[:, None] >> np.arange(two.shape[1], dtype=np.uint64)) & _ONE).astype(bool)
        k = matched.sum(axis=1)
        swaps = np.bincount(np.nonzero(matched)[0], weights=one[matched] != two[at], minlength=len(one)) // 2
        some = np.maximum(k, 1)
        jaro = np.where(k > 0, (k / n + k / m + (k - swaps) / some) / 3, 0.0)
        width = min(4, one.shape[1], two.shape[1])
        same = (one[:, :width] == two[:, :width]) & (one[:, :width] != _PAD)
        prefix = np.cumprod(same, axis=1).sum(axis=1) if width else np.zeros(len(one))
        made.append(np.where(jaro > 0.7, jaro + prefix * weight * (1 - jaro), jaro))
    if made:
        out[todo] = np.concatenate(made)
    return out


KERNELS: dict[str, Callable[[list[str], list[str]], np.ndarray]] = {"indel": indel_many, "token_sort": token_sort_many, "token_set": token_set_many, "partial": partial_many, "jaro_winkler": jaro_winkler_many}


def kernels(wanted: list[tuple[str, str, Column, Column]]) -> Column:
    """A struct of several kernels, (field, kernel, left, right) each, in one pass over the Arrow batches."""
    struct = T.StructType([T.StructField(name, T.DoubleType()) for name, *_ in wanted])
    picked = [KERNELS[kernel] for _, kernel, *_ in wanted]
    names = [name for name, *_ in wanted]

    def run(*cols: pa.Array) -> pa.Array:
        out = []
        for k, f in enumerate(picked):
            number: dict[tuple, int] = {}
            pairs = zip(cols[2 * k].to_pylist(), cols[2 * k + 1].to_pylist(), strict=True)
            row = np.array([-1 if x is None or y is None else number.setdefault((x, y), len(number)) for x, y in pairs], np.int64)
            values = np.append(f([x for x, _ in number], [y for _, y in number]) if number else np.zeros(0), 0.0)
            out.append(pa.array(values[row], pa.float64(), mask=row < 0))
        return pa.StructArray.from_arrays(out, names)

    return F.arrow_udf(run, struct)(*[c for _, _, a, b in wanted for c in (a, b)])


def kernel(name: str, a: Column, b: Column) -> Column:
    return kernels([("v", name, a, b)])["v"]


def levenshtein_similarity(a: Column, b: Column) -> Column:
    return F.when((a == "") & (b == ""), F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common beginning."""
    places = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    return F.array_max(F.filter(places, lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))


def prefix_similarity(a: Column, b: Column) -> Column:
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(common_prefix(a, b) / most)


def postfix_similarity(a: Column, b: Column) -> Column:
    return prefix_similarity(F.reverse(a), F.reverse(b))


def set_counts(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Sizes of two distinct arrays and of what they share."""
    return F.size(a).cast("double"), F.size(b).cast("double"), F.size(F.array_intersect(a, b)).cast("double")


def set_ratios(na: Column, nb: Column, shared: Column) -> tuple[Column, Column, Column]:
    """Jaccard, containment in the smaller, coverage of the larger; no denominator is below one."""
    one = F.lit(1.0)
    return shared / F.greatest(na + nb - shared, one), shared / F.greatest(F.least(na, nb), one), shared / F.greatest(na, nb, one)


def token_array(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def ngram_jaccard(a: Column, b: Column, n: int) -> Column:
    x, y = char_ngrams(a, n), char_ngrams(b, n)
    shared = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), shared / (F.size(x) + F.size(y) - shared)).otherwise(F.lit(0.0))


def length_ratio(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))
