"""The whole way from records to matches as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entwyne.functions.text import normalise
from entwyne.functions.vocabulary import Vocabulary
from entwyne.operators import blocking, decision, model, pairs
from entwyne.schemas import CONTEXT
from entwyne.sources.shared import materialise


def sides(views: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reference records, and the pool of the others."""
    s1 = F.col("entity_id").startswith("S1-")
    return views.where(s1), views.where(~s1)


def candidates(records: DataFrame, vocabulary: Vocabulary | None = None, config: blocking.BlockingConfig = blocking.BlockingConfig(), k: int = 80) -> DataFrame:
    """(source1_entity_id, cand_id, n_keys, rr_score): reranked candidates of every S1 record."""
    queries, pool = sides(materialise(normalise(records, vocabulary), "views"))
    return pairs.rerank_top(blocking.candidates(queries, pool, config), queries, pool, k)


def featurise(found: DataFrame, views: DataFrame) -> tuple[DataFrame, list[str]]:
    """Pairs with context and pair features, and the names of all 71 in order."""
    queries, pool = sides(views)
    rows, names = pairs.features(pairs.attach(pairs.add_context(found), queries, pool))
    return rows, names + list(CONTEXT)


def simple_score(score: str = "rr_score") -> Column:
    """A probability for use without labels: a fixed logistic curve of the lexical score."""
    return 1 / (1 + F.exp(-20 * (F.col(score) - 0.72)))


def train(found: DataFrame, views: DataFrame, truth: DataFrame, kind: str = "logistic", n_hard: int = 8, n_random: int = 4):
    """A model from labelled candidates, hard negatives first; context is taken before sampling."""
    labelled = pairs.sample_negatives(pairs.label(pairs.add_context(found), truth), n_hard, n_random)
    queries, pool = sides(views)
    rows, names = pairs.features(pairs.attach(labelled, queries, pool))
    names = names + list(CONTEXT)
    return model.fit(rows, names, kind), names


def decide(found: DataFrame, views: DataFrame, rule: decision.Rule = decision.PRODUCTION, fitted=None, names=None) -> DataFrame:
    """Accepted pairs of reranked candidates. Without a model the fixed curve of the lexical score decides."""
    if fitted is None:
        scored = found.withColumn("p", simple_score())
    else:
        scored = model.score(featurise(found, views)[0], fitted, names).select("source1_entity_id", "cand_id", "rr_score", "p")
    return decision.apply(scored, rule)


def resolve(records: DataFrame, rule: decision.Rule = decision.PRODUCTION, fitted=None, names=None, vocabulary: Vocabulary | None = None, config: blocking.BlockingConfig = blocking.BlockingConfig(), k: int = 80) -> tuple[DataFrame, DataFrame]:
    """(matches, candidates) as pairs. Views and candidates are written tables, as several steps read them."""
    views = materialise(normalise(records, vocabulary), "views")
    queries, pool = sides(views)
    found = materialise(pairs.rerank_top(blocking.candidates(queries, pool, config), queries, pool, k), "candidates")
    return decide(found, views, rule, fitted, names), found.select("source1_entity_id", "cand_id")
