"""Hybrid retrieval as one lazy plan: BM25, lexical overlap and dense similarity, fused and weighed by quality.

Units carry unit_ix (their identity), shard_id and the columns of schema.UNIT. Statistics are those of the rows given, so filters
go before. Query terms are a handful of rows from the driver; they prune the exploded tokens before anything shuffles.
Ranking windows are per (pass, shard): choose the number of shards with the corpus, so that no window grows with it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import shard, tokens, tokens_py
from ..plans.dsl import expansions, timestamp_column
from ..schema import CONTRADICTS, SUPPORTS, UNCERTAIN, citation_id

K1, B = 1.5, 0.75
WEIGHTS = {"bm25": 0.42, "dense": 0.33, "lexical": 0.15, "rrf": 0.10}
RRF_K = 60


def with_shard(units: DataFrame, shards: int = 1) -> DataFrame:
    return units.withColumn("shard_id", shard(F.col("doc_id"), shards))


def postings(units: DataFrame) -> DataFrame:
    """(shard_id, unit_ix, term, tf, dl) of all units."""
    t = units.select("shard_id", "unit_ix", tokens(F.col("content")).alias("ts"))
    return t.select("shard_id", "unit_ix", F.size("ts").alias("dl"), F.explode("ts").alias("term")).groupBy("shard_id", "unit_ix", "dl", "term").agg(F.count("*").alias("tf"))


def term_df(units: DataFrame) -> DataFrame:
    t = units.select("shard_id", F.explode(F.array_distinct(tokens(F.col("content")))).alias("term"))
    return t.groupBy("shard_id", "term").agg(F.count("*").alias("df"))


def corpus_stats(units: DataFrame) -> DataFrame:
    """(shard_id, n, avgdl) of each shard."""
    return units.groupBy("shard_id").agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col("content")))).alias("avgdl"))


def query_terms(spark: SparkSession, passes: list[tuple[str, str]], *, aliases: bool = False, boosts: dict[str, float] | None = None) -> DataFrame:
    """(pass_ix, pass_name, exp_ix, penalty, q_weight, term, mult, w): the terms of each expansion of each pass."""
    weigh = lambda t: 1.0 + max(0.0, min(float((boosts or {}).get(t, 0.0)), 2.0))
    rows = []
    for p, (name, text) in enumerate(passes):
        for e, (alias, penalty) in enumerate(expansions(text) if aliases else [(text, 0.0)]):
            counts = Counter(tokens_py(alias))
            q = sum(map(weigh, counts))
            rows += [(p, name, e, float(penalty), float(q), t, n, weigh(t)) for t, n in counts.items()]
    return spark.createDataFrame(rows, "pass_ix int, pass_name string, exp_ix int, penalty double, q_weight double, term string, mult int, w double")


@dataclass(frozen=True)
class Index:
    """Saved postings (shard_id, unit_ix, term, tf, dl), frequencies (shard_id, term, df) and statistics (shard_id, n, avgdl) of all units."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def term_scores(units: DataFrame, terms: DataFrame, index: Index | None = None) -> DataFrame:
    """(pass_ix, exp_ix, penalty, shard_id, unit_ix, bm25, lexical) of units with any term of an expansion.

    With an index only the postings of the query's terms are read; without one (as under filters, whose statistics are those of the rows that are left)
    the texts are tokenised: once for the few query terms, which alone are shuffled, and once for the lengths.
    """
    q = F.broadcast(terms)  # the words of one query
    wanted = [r.term for r in terms.select("term").distinct().collect()]
    if index is not None:
        tf, df, stats = index.postings.where(F.col("term").isin(wanted)), index.terms.where(F.col("term").isin(wanted)), index.stats
    else:
        t = units.select("shard_id", "unit_ix", tokens(F.col("content")).alias("ts"))
        hits = t.select("shard_id", "unit_ix", F.size("ts").alias("dl"), F.filter("ts", lambda x: x.isin(wanted)).alias("hits"))
        tf = hits.select("shard_id", "unit_ix", "dl", F.explode("hits").alias("term")).groupBy("shard_id", "unit_ix", "dl", "term").agg(F.count("*").alias("tf"))
        df = tf.groupBy("shard_id", "term").agg(F.count("*").alias("df"))
        stats = corpus_stats(units)
    rows = tf.join(df, ["shard_id", "term"]).join(stats, "shard_id").join(q, "term")
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    avgdl = F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)
    part = F.col("mult") * F.col("w") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
    return rows.groupBy("pass_ix", "pass_name", "exp_ix", "penalty", "shard_id", "unit_ix").agg(F.sum(part).alias("bm25"), (F.sum("w") / F.first("q_weight")).alias("lexical"))


def bm25_topk(units: DataFrame, terms: DataFrame, k: int, index: Index | None = None) -> DataFrame:
    """(pass_ix, shard_id, unit_ix, score, rank): the k best of each pass and shard, ties by unit_ix."""
    s = term_scores(units, terms, index).where(F.col("exp_ix") == 0).select("pass_ix", "shard_id", "unit_ix", F.col("bm25").alias("score"))
    w = Window.partitionBy("pass_ix", "shard_id").orderBy(F.desc(F.round("score", 9)), "unit_ix")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dense_scores(vectors: DataFrame, queries: list[list[float]], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(pass_ix, key, score): inner products of each query with its k best vectors of every batch, by one matrix product a batch; ties are all kept.

    Null vectors and those of another length have no score.
    """
    q = np.array(queries, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pa.compute.fill_null(pa.compute.list_value_length(b.column(1)), -1).to_numpy(zero_copy_only=False)
            fits = pa.array(size == q.shape[1])
            ids, rows = b.column(0).filter(fits), b.column(1).filter(fits)
            if not len(ids):
                continue
            s = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.float64) @ q.T
            least = np.partition(s, max(len(s) - k, 0), axis=0)[max(len(s) - k, 0)]
            at, p = np.nonzero(s >= least - 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), ids.take(pa.array(at)), pa.array(s[at, p])], names=["pass_ix", key, "score"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, vector).mapInArrow(run, f"pass_ix int, `{key}` {kind}, score double")


def dense_topk(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, score): exact inner products, the k largest."""
    return dense_scores(vectors, [query], k, key, vector).select(key, "score").orderBy(F.desc(F.round("score", 9)), key).limit(k)


def quality_prior(*, min_ocr: float = 0.35, short_len: int = 4, short_factor: float = 0.88, now: str | None = None, half_life: float = 30.0, max_boost: float = 0.12) -> Column:
    """Weight of a unit by confidence, type and, with `now`, recency; 0 for scans below min_ocr. A null confidence counts as 0."""
    conf = F.least(F.greatest(F.coalesce(F.col("confidence"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    kind = F.col("source_type")
    factor = (
        F.when((kind == "ocr_text") & (conf < min_ocr), 0.0).when(kind == "ocr_text", 0.78)
        .when(kind == "table_cell", 0.94 * F.when(F.length(F.trim("content")) < short_len, short_factor).otherwise(1.0)).when(kind == "caption", 0.97).otherwise(1.0)
    )
    p = F.pow(conf, F.lit(0.7)) * factor
    if now:
        age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(timestamp_column(F.col("timestamp")))) / 86400e6
        decay = F.pow(F.lit(0.5), age / max(half_life, 1.0))
        p = p * (1 + F.when(age >= 0, F.least(F.lit(max_boost), decay * max_boost)).otherwise(0.0))
        p = F.coalesce(p, F.pow(conf, F.lit(0.7)) * factor)
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.5))


# Hints in a text, found as parts of it.
CONTRADICTION_HINTS = ["아니다", "없다", "제한", "예외", "반면", "불가"]
SUPPORT_HINTS = ["가능", "효과", "충족", "성공", "개선"]


def any_hint(c: Column, hints: list[str]) -> Column:
    p = F.lit(False)
    for h in hints:
        p |= F.contains(c, F.lit(h))
    return p


def verdict(pass_name: Column, content: Column) -> Column:
    return F.when((pass_name == "pass_b_contradict") | any_hint(content, CONTRADICTION_HINTS), CONTRADICTS).when(any_hint(content, SUPPORT_HINTS), SUPPORTS).otherwise(UNCERTAIN)


def retrieve(units: DataFrame, terms: DataFrame, k: int, *, dense: DataFrame | None = None, weights: dict[str, float] | None = None, rrf_k: int = RRF_K, prior: Column | None = None, dense_factor: int = 6, candidate_factor: int = 8, index: Index | None = None) -> DataFrame:
    """Scored evidence, the k best of each pass and shard.

    dense: optional (unit_ix, score) of the query's nearest units, with pass_ix where each pass has its own. Adds score, the stage scores, verdict and citation_id to the units' columns. Ties
    go to the lower unit_ix. An empty corpus or query gives no rows.
    """
    w = weights or WEIGHTS
    base = term_scores(units, terms, index)
    per_exp = Window.partitionBy("pass_ix", "exp_ix", "shard_id").orderBy(F.desc(F.round("bm25", 9)), "unit_ix")
    base = base.withColumn("r", F.row_number().over(per_exp))
    cut = max(k * max(dense_factor, 1), 12)
    ids = ["pass_ix", "pass_name", "shard_id", "unit_ix"]
    bm25 = F.max(F.when(F.col("r") <= cut, F.col("bm25") * (1 - F.col("penalty"))))
    rows = base.groupBy(*ids).agg(bm25.alias("bm25"), F.max(F.col("lexical") * (1 - F.col("penalty"))).alias("lexical"), F.min_by("penalty", F.struct(F.col("lexical") * F.col("penalty"), "exp_ix")).alias("alias_penalty"))
    if dense is not None:
        names = sorted(tuple(r) for r in terms.select("pass_ix", "pass_name").distinct().collect())  # a handful of passes
        each = F.explode(F.array(*[F.struct(F.lit(p).alias("pass_ix"), F.lit(n).alias("pass_name")) for p, n in names])) if names else F.explode(F.expr("cast(array() as array<struct<pass_ix:int,pass_name:string>>)"))
        own = F.col("d_pass").isNull() | (F.col("d_pass") == F.col("p.pass_ix"))
        near = dense.select("unit_ix", F.col("score").alias("dense"), (F.col("pass_ix") if "pass_ix" in dense.columns else F.lit(None).cast("int")).alias("d_pass"), each.alias("p")).where(own)
        near = near.select("unit_ix", "dense", "p.pass_ix", "p.pass_name").join(units.select("unit_ix", "shard_id"), "unit_ix")
        rows = rows.join(near, ids, "full")
    else:
        rows = rows.withColumn("dense", F.lit(None).cast("double"))
    part = Window.partitionBy("pass_ix", "shard_id")
    fused, rrf, best = F.lit(0.0), F.lit(0.0), F.lit(False)
    limit = max(k * max(candidate_factor, 1), 20)
    for c in ("bm25", "dense", "lexical"):
        lo, hi = F.min(c).over(part), F.max(c).over(part)
        rows = rows.withColumn(f"{c}_norm", F.when(F.col(c).isNotNull(), F.when(hi == lo, (hi > 0).cast("double")).otherwise((F.col(c) - lo) / (hi - lo))))
        rows = rows.withColumn(f"{c}_rank", F.when(F.col(c).isNotNull(), F.row_number().over(part.orderBy(F.desc_nulls_last(F.round(c, 9)), "unit_ix"))))
        fused = fused + w[c] * F.coalesce(f"{c}_norm", F.lit(0.0))
        rrf = rrf + F.coalesce(1.0 / (rrf_k + F.col(f"{c}_rank")), F.lit(0.0))
        best = best | F.coalesce(F.col(f"{c}_rank") <= limit, F.lit(False))
    rows = rows.withColumn("rrf", rrf).where(best)
    full = units.join(rows, ["unit_ix", "shard_id"])  # candidates: at most three limits for each pass and shard
    full = full.withColumn("quality_prior", quality_prior() if prior is None else prior)
    full = full.withColumn("score", (fused + w["rrf"] * F.col("rrf")) * F.col("quality_prior")).where(F.col("score") > 0)
    top = part.orderBy(F.desc(F.round("score", 9)), "unit_ix")
    full = full.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    return full.withColumns({"verdict": verdict(F.col("pass_name"), F.col("content")), "citation_id": citation_id()})
