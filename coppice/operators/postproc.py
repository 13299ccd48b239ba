"""What follows retrieval: folding of passes, reranking, contradiction labels, groups, citations, measures."""

from __future__ import annotations

import re
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens, tokens_py
from .retrieval import CONTRADICTION_HINTS, SUPPORT_HINTS, any_hint


class Reranker(Protocol):
    def score(self, query: str, contents: list[str]) -> list[float]: ...


class Detector(Protocol):
    def predict(self, query: str, contents: list[str]) -> list[dict]:
        """{label, score, rationale} of each text, label one of supports, contradicts, uncertain."""


class TextModel(Protocol):
    def generate(self, prompt: str) -> str: ...


def parse_score(answer: str) -> float:
    """The number a text model answered: the whole answer or its first number that begins with 0 or 1, from 0 to 1; 0 where there is none."""
    try:
        value = float(answer.strip())
    except ValueError:
        m = re.search(r"(?<![0-9.])[01](?:\.[0-9]+)?", answer)
        value = float(m.group()) if m else 0.0
    return min(max(value, 0.0), 1.0) if value == value else 0.0


class ModelReranker:
    """Reranker that asks a text model for a number from 0 to 1; a failing model gives 0."""

    def __init__(self, model: TextModel):
        self.model = model

    def score(self, query: str, contents: list[str]) -> list[float]:
        def ask(text: str) -> float:
            try:
                return parse_score(self.model.generate(f"How relevant is the text to the query, from 0 to 1? Answer with a number.\nQuery: {query}\nText: {text}"))
            except Exception:  # noqa: BLE001 - whatever a model's client raises
                return 0.0

        return [ask(c) for c in contents]


def dedupe(scored: DataFrame, stages: list[str], keep: list[str] | None = None) -> DataFrame:
    """One row per span (doc_id, char_start, char_end): the highest score wins, the later pass on ties; each stage is the last pass's that has it.

    keep: further columns of the winning row.
    """
    order = F.struct(F.round("score", 9), "pass_ix")
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pass_ix"))).alias(c) for c in stages]
    why = F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("pass_ix", "pass_name"))), lambda x: x["pass_name"]), " + ").alias("why")
    return scored.groupBy("doc_id", "char_start", "char_end").agg(F.max("score").alias("score"), F.max_by("unit_ix", order).alias("unit_ix"), F.max_by("verdict", order).alias("verdict"), why, *last, *[F.max_by(F.struct(c), order)[c].alias(c) for c in keep or ()])


def overlap(query: str, content: Column) -> Column:
    """Share of the query's distinct tokens that a text has; 0 for an empty query."""
    q = sorted(set(tokens_py(query)))
    if not q:
        return F.lit(0.0)
    return F.size(F.array_intersect(tokens(content), F.array(*[F.lit(t) for t in q]))) / float(len(q))


def rerank_score(query: str, content: Column) -> Column:
    return 0.85 * overlap(query, content) + 0.15 * F.least(F.size(F.array_distinct(tokens(content))) / 32.0, F.lit(1.0))


def rerank(rows: DataFrame, query: str, cap: int) -> DataFrame:
    """score becomes .35 first + .65 rerank for the cap best rows; the others keep theirs. The cap is applied before scoring."""
    top = rows.orderBy(F.desc(F.round("score", 9)), "unit_ix").limit(cap)
    judged = top.select("unit_ix", rerank_score(query, F.col("content")).alias("rerank"))
    return rows.join(judged, "unit_ix", "left").withColumn("score", F.coalesce(0.35 * F.col("score") + 0.65 * F.col("rerank"), F.col("score")))


def contradiction(query: str, content: Column) -> Column:
    """STRUCT<label, score, rationale> by hints and overlap."""
    o = overlap(query, content)
    against = any_hint(content, [*CONTRADICTION_HINTS, "not", "never", "cannot"])
    for_it = any_hint(content, [*SUPPORT_HINTS, "improve", "support"])
    label = F.when(against, "contradicts").when(for_it, "supports").otherwise("uncertain")
    score = F.when(against, F.least(0.55 + 0.45 * o, F.lit(0.99))).when(for_it, F.least(0.5 + 0.45 * o, F.lit(0.95))).otherwise(F.greatest(F.lit(0.15), 0.5 * o))
    why = F.when(against, "contradiction_hint+overlap").when(for_it, "support_hint+overlap").otherwise("weak_semantic_signal")
    return F.struct(label.alias("label"), score.alias("score"), why.alias("rationale"))


def entity_groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("canonical_entity_id", F.lit("null")).alias("entity")).agg(F.count("*").alias("n"), F.max("score").alias("max_score"), F.count_distinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def trusted(rows: DataFrame, domains: list[str], url: Column) -> DataFrame:
    """Local rows, and web rows whose host with port is a trusted domain or under one; without domains no web rows."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    good = F.lit(False)
    for d in domains:
        good |= (host == d) | host.endswith("." + d)
    return rows.where(~F.col("source_type").isin("web_snippet", "web_page_text") | (good & (host != "")))


def web_prior(rank: Column, passes: Column) -> Column:
    """Weight of a web result by its rank (0 or null counts as 999) and the number of passes that found it."""
    r = F.when(F.coalesce(rank, F.lit(0)) == 0, 999).otherwise(rank)
    return F.greatest(F.lit(0.55), 1 - 0.05 * (r - 1)) * (1 + F.least(F.lit(0.18), 0.06 * (passes - 1)))


def web_fallback(base: float, rank: Column) -> Column:
    """Score of a web result that no channel scored: the mode's base, less for each later rank, never negative."""
    r = F.when(F.coalesce(rank, F.lit(0)) == 0, 999).otherwise(rank)
    return F.greatest(F.lit(0.0), F.lit(min(max(base, 0.0), 1.0)) - 0.06 * (r - 1))


def url_dedupe(results: DataFrame, most: int | None = None) -> DataFrame:
    """One row per url: the lowest rank (then lowest id), and how many providers found it."""
    order = F.struct(F.coalesce("web_rank", F.lit(999)), "result_id")
    out = results.groupBy("url").agg(F.min_by("result_id", order).alias("result_id"), F.min(F.coalesce("web_rank", F.lit(999))).alias("web_rank"), F.count_distinct("provider").alias("n_providers"))
    return out if most is None else out.orderBy("web_rank", "url").limit(most)


def ir_metrics(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, hit, mrr, ndcg) per query. ranked: query_id, doc_id, rank; qrels: query_id, doc_id. The ideal gain is that of the relevant rows retrieved."""
    rel = ranked.join(qrels.select("query_id", "doc_id").distinct().withColumn("rel", F.lit(1)), ["query_id", "doc_id"], "left").na.fill(0, ["rel"])
    w = Window.partitionBy("query_id").orderBy(F.desc("rel"), "rank")
    rel = rel.withColumn("ideal", F.row_number().over(w))
    gain = lambda at: F.sum(F.col("rel") / F.log2(F.col(at) + 1))
    return rel.groupBy("query_id").agg(
        F.max("rel").cast("double").alias("hit"), F.coalesce(1.0 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.coalesce(gain("rank") / F.nullif(gain("ideal"), F.lit(0.0)), F.lit(0.0)).alias("ndcg"),
    )


def stage_summary(rows: DataFrame, stages: list[str]) -> DataFrame:
    """(stage, n, mean): how many rows have a stage score and its mean over all rows, missing ones as 0."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("v")) for s in stages])).alias("x")
    return rows.select(pairs).groupBy("x.stage").agg(F.count("x.v").alias("n"), (F.sum(F.coalesce("x.v", F.lit(0.0))) / F.count("*")).alias("mean"))
