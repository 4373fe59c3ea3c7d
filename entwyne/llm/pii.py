"""Personal data, and terms that give it away, with DataFrame functions alone.

Base spans are e-mail addresses, IPv4 addresses, payment cards and phone numbers by pattern and check. Each distinct value
is a protected entity, and so are, since most values are rare, its pools: the domain of an address and the kind of value.
With N documents, n(e) that mention entity e, n(t) that hold term t (a word of three letters or more), n(e, t) both,

    disclosure(t, e) = ln(n(e, t) N / (n(e) n(t))) / ln(N / n(e)),

the share of the entity's information that the term gives away (pointwise mutual information over self-information).
A term is supported if so many of its documents would mention the entity by chance with probability ``RISK`` over the
number of pairs at most (Chernoff's bound). A supported term is generalised in the documents that mention the entity from
``generalise`` on and removed from ``remove`` on.

Matches keep to what the plain patterns say but are written so that no text takes more than linear time: runs are matched
possessively and only from their start.

Defined results: a null text is empty; spans count code points, end exclusive; repeated rows are counted each, and
share their result; a null doc_id is a document like others; an entity in every document has no information to give away, so no terms; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entwyne.llm.common import discard, materialise

RISK, GENERALISE, REMOVE = 0.05, 0.75, 0.9
KINDS = ("email", "ip", "card", "phone", "term")
_STEP = 64
#: Entities, terms or pairs of both that are sent to all executors (some 50 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 200_000

_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TERM = r"\p{L}{3,}+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def located(text: Column, pattern: str) -> Column:
    """All matches as structs of value, start and end: places are sums over what lies between and in matches before.

    Sums go by blocks of matches, so their cost is about linear in the number of matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def places(f: Column, b: Column) -> Column:
        steps = F.transform(f, lambda x, i: F.char_length(x) + F.char_length(F.get(b, i)))
        return let(steps, lambda s: let(
            F.transform(F.sequence(F.lit(0), F.floor(F.size(f) / _STEP).cast("int")), lambda k: _sum(F.slice(s, k * _STEP + 1, F.lit(_STEP)))),
            lambda blocks: let(
                F.transform(blocks, lambda _, k: _sum(F.slice(blocks, F.lit(1), k))),
                lambda base: F.transform(f, lambda x, i: let(
                    F.get(base, F.floor(i / _STEP).cast("int")) + _sum(F.slice(s, F.floor(i / _STEP).cast("int") * _STEP + 1, i % _STEP)) + F.char_length(F.get(b, i)),
                    lambda start: F.struct(x.alias("value"), start.cast("int").alias("start"), (start + F.char_length(x)).cast("int").alias("end")),
                )),
            ),
        ))

    return let(found, lambda f: F.when(F.size(f) > 0, let(between, lambda b: places(f, b))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)
    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.char_length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.char_length(_digits(value)).between(9, 15)
    return F.lit(True)


def _entity(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), _digits(value) if kind in ("card", "phone") else F.lower(value))


def _spans_of(text: Column, number: int) -> Column:
    kind = KINDS[number]
    good = F.filter(located(text, _PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
    return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end"), _entity(kind, m["value"]).alias("entity")))


def base_spans(text: Column) -> Column:
    """Structs of start, kind number, end and entity of all base matches, in order of start and kind."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,entity:string>>")
    worth = (F.contains(text, F.lit("@")), text.rlike(r"[0-9]\.[0-9]"), text.rlike(r"[0-9][\x20-]?[0-9]"), text.rlike(r"\+[0-9]"))
    return F.array_sort(F.concat(*[F.coalesce(F.when(w, _spans_of(text, k)), none) for k, w in enumerate(worth)]))


def free_terms(text: Column, spans: Column) -> Column:
    """Structs of term, start and end for the words that lie in no base span."""
    words = F.coalesce(located(text, _TERM), F.array().cast("array<struct<value:string,start:int,end:int>>"))
    free = F.filter(words, lambda w: ~F.exists(spans, lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    return F.transform(free, lambda w: F.struct(F.lower(w["value"]).alias("term"), w["start"].alias("start"), w["end"].alias("end")))


def entities(spans: Column) -> Column:
    """The values mentioned, the domains of addresses (with their @) and the kinds."""
    values = F.transform(spans, lambda s: s["entity"])
    domains = F.transform(F.filter(values, lambda e: e.startswith("email:")), lambda e: F.regexp_replace(e, "^.*@", "@"))
    return F.array_distinct(F.concat(values, domains, F.transform(values, lambda e: F.regexp_replace(e, ":.*$", ""))))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table of all rows: doc_id, h (digest of the text), base spans, and where it has any, entities and words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), "text", base_spans(F.col("text")).alias("base"))
    some = F.size("base") > 0
    return materialise(rows.select("doc_id", "h", "base", F.when(some, entities(F.col("base"))).alias("entities"), F.when(some, free_terms(F.col("text"), F.col("base"))).alias("words")), "pii")


def _spread(rows: DataFrame, most: int) -> DataFrame:
    """Written rows, sent to all executors where they are few."""
    return F.broadcast(rows) if rows.count() <= most else rows


def disclosures(docs: DataFrame, found: DataFrame, risk: float = RISK, text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Written table of (entity, term, disclosure) of supported terms. All rows are counted, and each whole.

    n(t) KL(n(e, t) / n(t), n(e) / N) is at most n(e, t) ln(N / n(e)): only pairs for which that is enough can be
    supported, so only their terms are counted over all documents.
    """
    total = docs.count()
    some = found.where(F.size("base") > 0).select("entities", F.array_distinct("words.term").alias("terms"))
    each = some.select(F.explode("entities").alias("entity"), "terms")
    per_entity = materialise(each.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")), "entities")
    together = materialise(each.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et")), "together")
    needed = math.log(max(1, together.count()) / risk)
    chance = F.col("n_e") / F.lit(float(total))
    near = together.join(_spread(per_entity, broadcast_rows), "entity").where((F.col("n_e") < total) & (F.col("n_et") * -F.log(chance) >= needed * (1 - 1e-9)))
    near = materialise(near.select("entity", "term", "n_e", "n_et"), "near")
    terms = materialise(near.select("term").distinct(), "terms")
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.col(text_col).cast("string")), r"\P{L}+"))).alias("term"))
    per_term = words.join(_spread(terms, broadcast_rows), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    n_t = F.greatest("n_t", "n_et")
    share = F.col("n_et") / n_t
    distance = share * F.log(share / chance) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - chance))).otherwise(0.0)
    supported = near.join(per_term, "term", "left").where((share > chance) & (n_t * distance >= needed))
    out = materialise(supported.select("entity", "term", (F.log(share / chance) / -F.log(chance)).alias("disclosure")), "disclosures")
    discard(per_entity, together, near, terms)
    return out


def all_spans(docs: DataFrame, risk: float = RISK, generalise: float = GENERALISE, remove: float = REMOVE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row: doc_id, h, base spans, and the term spans (start, end, whether to remove)."""
    found = find(docs)
    telling = materialise(disclosures(docs, found, risk, broadcast_rows=broadcast_rows).where(F.col("disclosure") >= generalise), "telling")
    uses = found.where(F.size("words") > 0).select("doc_id", "h", "words", F.explode("entities").alias("entity")).select("doc_id", "h", "entity", F.explode("words").alias("c")).select("doc_id", "h", "entity", "c.term", "c.start", "c.end")
    hit = uses.join(_spread(telling, broadcast_rows), ["entity", "term"]).groupBy("doc_id", "h", "start", "end").agg(F.max("disclosure").alias("most"))
    terms = hit.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "end", (F.col("most") >= remove).alias("removed")))).alias("terms"))
    terms = terms.select(F.col("doc_id").alias("t_id"), F.col("h").alias("t_h"), "terms")
    return found.join(terms, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("h") == F.col("t_h")), "left").select("doc_id", "h", "base", "terms")


def _kind(number: Column) -> Column:
    return reduce(lambda rest, i: F.when(number == i, F.lit(KINDS[i])).otherwise(rest), range(len(KINDS)), F.lit(""))


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _kind(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, **kw) -> DataFrame:
    """Per row: counts by kind, digest of the base spans, all spans."""
    rows = all_spans(docs, **kw)
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    own = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), F.lit(4).alias("kind"), s["end"].alias("end")))
    whole = F.array_sort(F.concat(plain, F.coalesce(own, F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{KINDS[k]}") for k in range(4)]
    return rows.select("doc_id", *counts, F.sha2(_line(F.col("base")).cast("binary"), 256).alias("base_sha256"), _line(whole).alias("spans"), F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_terms"))


def sanitise(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with base spans as ``[kind]``, telling terms as ``[term]`` or gone."""
    spans = all_spans(docs, **kw)
    cuts = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), _kind(s["kind"]), F.lit("]")).alias("by"))),
        F.coalesce(F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["removed"], F.lit("")).otherwise(F.lit("[term]")).alias("by"))), F.array().cast("array<struct<start:int,end:int,by:string>>")),
    )
    spans = spans.select(F.col("doc_id").alias("__entwyne_id"), F.col("h").alias("__entwyne_h"), F.array_sort(cuts).alias("__entwyne_cuts")).where(F.size("__entwyne_cuts") > 0).dropDuplicates(["__entwyne_id", "__entwyne_h"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = docs.join(spans, docs["doc_id"].cast("long").eqNullSafe(F.col("__entwyne_id")) & (F.xxhash64(text) == F.col("__entwyne_h")), "left")
    # Spans of two kinds may overlap; the one that starts first wins. Places are walked once, from left to right.
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    walked = F.aggregate(
        "__entwyne_cuts", start,
        lambda acc, c: F.when(c["start"] < acc["at"], acc).otherwise(F.struct(c["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, c["start"] - acc["at"]), c["by"])).alias("out"))),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text))),
    )
    return joined.withColumn("text", F.coalesce(walked, F.col("text"))).drop("__entwyne_id", "__entwyne_h", "__entwyne_cuts")
