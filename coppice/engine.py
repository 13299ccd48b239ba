"""Facade: a search from query text to answer, evidence, sources and diagnostics."""

from __future__ import annotations

import json
import re
import time
from collections import OrderedDict
from dataclasses import asdict, dataclass, field
from typing import Any
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import tokens_py
from .operators import osint, postproc, retrieval
from .plans import dsl
from .plans.learning import Learner
from .schema import CONTRADICTS, SUPPORTS, UNIT, WEB_TYPES
from .sources import documents as docs
from .sources import web
from .sources.library import Library

NO_EVIDENCE = "No evidence was found."
STAGES = ["bm25", "dense", "lexical", "rrf", "quality_prior"]


@dataclass
class Result:
    answer: str
    evidence: list[dict]
    contradictions: list[dict]
    sources: list[dict]
    diagnostics: dict[str, Any] = field(default_factory=dict)


class Engine:
    """units: schema.UNIT columns. Plans stay lazy; a search collects at most k rows for each pass.

    index: the saved index of units, read where no filter changes the statistics. vectors (unit_ix, embedding) with an encoder add the dense channel.
    Rerankers, detectors, search and fetch providers and a text model are protocols; without them the built-in rules judge.
    """

    def __init__(self, units: DataFrame, *, shards: int = 1, learner: Learner | None = None, library: Library | None = None, search_provider: web.SearchProvider | None = None, fetch_provider: web.FetchProvider | None = None, trusted_domains: list[str] | None = None, cache_size: int = 128, cache_ttl: float = 90.0, build_id: str = "", index: retrieval.Index | None = None, vectors: DataFrame | None = None, encoder: docs.Encoder | None = None, reranker: postproc.Reranker | None = None, detector: postproc.Detector | None = None, model: postproc.TextModel | None = None, crawl_depth: int = 0, web_always: bool = False, fetch_options: dict | None = None):
        if (vectors is None) != (encoder is None):
            raise ValueError("vectors and an encoder go together")
        self.units = units if index is not None and "shard_id" in units.columns else retrieval.with_shard(units, shards)
        self.shards, self.learner, self.library, self.provider, self.fetcher = shards, learner, library, search_provider, fetch_provider
        self.trusted_domains, self.cache_size, self.cache_ttl, self.build_id = trusted_domains or [], cache_size, cache_ttl, build_id
        self.index, self.vectors, self.encoder, self.reranker, self.detector, self.model = index, vectors, encoder, reranker, detector, model
        self.crawl_depth, self.web_always, self.fetch_options = crawl_depth, web_always, fetch_options or {}
        self.cache: OrderedDict[tuple, tuple[float, Result]] = OrderedDict()

    def search(self, query: str, k: int = 5, mode: str | None = None, *, aliases: bool = True, now: str | None = None, time_budget: float = 120.0) -> Result:
        """time_budget in seconds: when it is used up only the first pass runs; under 45 % of it fewer candidates are looked at, and the rerank is left out where it would exceed it."""
        began = time.time()
        profile = dsl.mode(mode)
        k = 1 if profile.name == "sniper" else max(k, profile.min_k) if profile.name != "investigation" else k
        key = (query, k, profile.name, aliases, now)
        if (hit := self.cache.get(key)) and time.time() - hit[0] < self.cache_ttl:
            self.cache.move_to_end(key)
            return Result(**{**asdict(hit[1]), "diagnostics": {**hit[1].diagnostics, "cache": "hit"}})
        parsed = dsl.parse_query(query)
        every = dsl.passes(parsed.clean, profile.name)
        passes = every if time_budget > 0 else every[:1]
        prior = retrieval.quality_prior(min_ocr=profile.min_ocr, now=now if profile.recency else None)
        filtered = parsed.filters != dsl.Filters()
        live = dsl.apply_filters(self.units, parsed.filters) if filtered else self.units
        ask = lambda rows, index, dense: self._hits(rows, parsed.clean, passes, max(k, 2), aliases, prior, index, dense, left() >= 0.45)
        left = lambda: 1.0 if time_budget <= 0 else max(0.05, 1 - (time.time() - began) / time_budget)
        rows = ask(live, None if filtered else self.index, self.encoder is not None)
        about = {"used": False, "reason": "disabled" if self.provider is None else "enough_local_hits"}
        found: DataFrame | None = None
        if self.provider is not None and (self.web_always or len(rows) < k):
            extra, about, found = self._web(parsed, passes, profile, ask)
            rows += extra
        needed = 0.015 * max(len(rows), 1)
        skipped = "empty_candidates" if not rows else "time_budget_exceeded" if time_budget - (time.time() - began) <= needed + 0.01 else None
        if not skipped:
            rows.sort(key=_order)
            top = rows[: profile.rerank_cap]
            scores = self.reranker.score(parsed.clean, [r["content"] for r in top]) if self.reranker else [r["rerank"] for r in top]
            for r, x in zip(top, scores):
                r |= {"first_score": r["score"], "rerank": float(x), "score": 0.35 * r["score"] + 0.65 * float(x)}
        if self.detector and rows:
            for r, c in zip(rows, self.detector.predict(parsed.clean, [r["content"] for r in rows])):
                r["c"] = c
        for r in rows:
            if r["c"]["score"] >= 0.55:
                r["verdict"] = r["c"]["label"]
            r["citation_id"] = f"{r['doc_id']}:{r['section_path'] or ''}:{r['char_start']}-{r['char_end']}"
        if profile.trusted_only:
            rows = [r for r in rows if r["source_type"] not in WEB_TYPES or any((h := urlparse(r["doc_id"]).netloc.lower()) == d or h.endswith("." + d) for d in self.trusted_domains)]
        rows = sorted(rows, key=_order)[: max(k, 3)]
        best = rows[:1] if profile.name == "sniper" else rows
        supports, against = [r for r in best if r["verdict"] == SUPPORTS], [r for r in best if r["verdict"] == CONTRADICTS]
        answer = (supports or best)[0]["content"] if best else NO_EVIDENCE
        if profile.name == "llm" and self.model and best:
            answer = self._written(parsed.clean, best, answer)
        sources = list({r["citation_id"]: {x: r[x] for x in ("citation_id", "doc_id", "source_type", "section_path", "char_start", "char_end")} for r in best}.values())
        result = Result(format_answer(profile.name, answer, best, supports, against), best, against, sources, {
            "mode": profile.name, "passes": [n for n, _ in passes], "skipped_passes": [n for n, _ in every[len(passes):]], "filters": parsed.filters.as_dict(), "clean_query": parsed.clean, "cache": "miss", "build_id": self.build_id,
            "entity_groups": entity_groups(best), "stages": {s: sum(r.get(s) or 0.0 for r in best) / len(best) for s in STAGES} if best else {},
            "shards": {str(r["shard_id"]): r["shard_hits"] for r in rows}, "web": about, "rerank": {"skipped": bool(skipped), "reason": skipped or "applied", "budget_needed_sec": round(needed, 4)},
        })
        report = osint_report(found, parsed.clean) if found is not None else None
        if report:
            result.diagnostics["osint"] = report
        if self.learner:
            self.learner.learn(parsed.clean, best)
        if self.library:
            flat = json.loads(json.dumps(asdict(result), default=str))
            sid = self.library.save_session(mode=profile.name, raw_query=query, clean_query=parsed.clean, filters=parsed.filters.as_dict(), result=flat, extra={"graph": report} if report else None)
            result.diagnostics["session_id"] = sid
            if report:
                self.library.save_artifacts(sid, report)
            web_rows = [json.loads(json.dumps(r, default=str)) for r in rows if r["source_type"] in WEB_TYPES]
            if web_rows:
                self.library.append_rows(web_rows, f"web_{sid}")
        self.cache[key] = (time.time(), result)
        while len(self.cache) > self.cache_size:
            self.cache.popitem(last=False)
        return result

    def _hits(self, units: DataFrame, query: str, passes: list[tuple[str, str]], k: int, aliases: bool, prior, index, dense: bool, ample: bool) -> list[dict]:
        """The k best rows of each pass over all shards, folded by span, with what the built-in reranker and detector say of them."""
        weights = self.learner.state.weights if self.learner else None
        boosts = self.learner.state.boosts if self.learner else None
        dense_factor, candidate_factor = (6, 8) if ample else (4, 5)
        near = None
        if dense:
            most = max(k * dense_factor, 12)
            near = retrieval.dense_scores(self.vectors, self.encoder.encode([q for _, q in passes], query=True), most, "unit_ix")
            w = Window.partitionBy("pass_ix").orderBy(F.desc(F.round("score", 9)), "unit_ix")
            near = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")
        terms = retrieval.query_terms(units.sparkSession, passes, aliases=aliases, boosts=boosts)
        hits = retrieval.retrieve(units, terms, k, dense=near, weights=weights, prior=prior, dense_factor=dense_factor, candidate_factor=candidate_factor, index=index)
        # at most k rows a pass and shard are left; the passes' best over all shards are merged
        hits = hits.withColumn("shard_hits", F.count("*").over(Window.partitionBy("shard_id")))
        hits = hits.withColumn("r", F.row_number().over(Window.partitionBy("pass_ix").orderBy(F.desc(F.round("score", 9)), "unit_ix"))).where(F.col("r") <= k)
        kept = [c for c in (*UNIT.names, "shard_id", "shard_hits", "web_rank", "n_passes") if c in hits.columns and c not in ("unit_ix", "doc_id", "char_start", "char_end")]
        folded = postproc.dedupe(hits, STAGES, kept)
        out = folded.withColumn("rerank", postproc.rerank_score(query, F.col("content"))).withColumn("c", postproc.contradiction(query, F.col("content")))
        return [r.asDict(recursive=True) for r in out.collect()]

    def _web(self, parsed: dsl.Query, passes: list[tuple[str, str]], profile: dsl.Mode, ask) -> tuple[list[dict], dict, DataFrame | None]:
        """(rows, what happened, results): evidence of the provider's results and of their pages, weighed by rank and number of passes; where no channel scores any, by rank alone."""
        if not parsed.filters.allows_web():
            return [], {"used": False, "reason": "filtered_out_by_query_dsl"}, None
        spark, rows, failed = self.units.sparkSession, [], 0
        for name, q in passes:
            try:
                rows += [(r.get("title"), r["url"], r.get("snippet"), r.get("rank", r.get("web_rank")), r.get("provider", ""), name) for r in self.provider.search(q, profile.web_max)]
            except Exception:  # noqa: BLE001 - a failing provider must not fail the search
                failed += 1
        if not rows:
            return [], {"used": False, "reason": "error" if failed else "no_results"}, None
        found = spark.createDataFrame(rows, "title string, url string, snippet string, web_rank int, provider string, pass string").withColumn("result_id", -F.abs(F.xxhash64("url")))
        rank = F.coalesce("web_rank", F.lit(999))
        one = found.groupBy("url").agg(*[F.min_by(c, F.struct(rank, "title", "snippet")).alias(c) for c in ("title", "snippet", "result_id")], F.min(rank).alias("web_rank"), F.array_sort(F.collect_set("pass")).alias("passes"))
        one = one.withColumn("n_passes", F.size("passes")).orderBy("web_rank", "url").limit(profile.web_max * len(passes))
        units = web.snippet_units(one).join(one.select(F.col("url").alias("doc_id"), "web_rank", "n_passes"), "doc_id")
        if self.fetcher is not None and profile.fetch_pages:
            seeds = one.orderBy("web_rank", "url").limit(profile.fetch_pages).coalesce(1).select(F.monotonically_increasing_id().alias("pos"), "url")
            pages = web.crawl(seeds, self.fetcher, depth=self.crawl_depth, max_pages=profile.fetch_pages, **self.fetch_options)
            units = units.unionByName(web.page_units(web.with_result(pages, one)), allowMissingColumns=True)
        units = dsl.apply_filters(retrieval.with_shard(units, self.shards), parsed.filters)
        hits = ask(units, None, False)
        for r in hits:
            r["web_rank_prior"] = max(0.55, 1 - 0.05 * ((r["web_rank"] or 999) - 1)) * (1 + min(0.18, 0.06 * (max(r["n_passes"] or 1, 1) - 1)))
            r["score"] *= r["web_rank_prior"]
        if not hits:
            c = postproc.contradiction(parsed.clean, F.col("content"))
            plain = units.withColumn("score", postproc.web_fallback(profile.web_base, F.col("web_rank"))).withColumns({"verdict": F.lit("uncertain"), "c": c, "rerank": postproc.rerank_score(parsed.clean, F.col("content")), "shard_hits": F.lit(0)})
            hits = [r.asDict(recursive=True) | {"why": "web_fallback"} for r in plain.orderBy(F.desc("score"), "unit_ix").limit(profile.web_max * len(passes)).collect()]
        return hits, {"used": True, "reason": "applied" if hits else "no_results", "failed_passes": failed, "results": len({r[1] for r in rows}), "candidates": len(hits)}, one

    def _written(self, query: str, best: list[dict], plain: str) -> str:
        """The text model's answer from the evidence; the plain one where it fails or says nothing."""
        lines = "\n".join(f"[{i}] {r['content']}" for i, r in enumerate(best[:8], 1))
        try:
            return self.model.generate(f"Answer the query from the evidence only and cite its numbers.\nQuery: {query}\nEvidence:\n{lines}").strip() or plain
        except Exception:  # noqa: BLE001 - whatever a model's client raises
            return plain

    def learning_snapshot(self) -> dict | None:
        return asdict(self.learner.state) if self.learner else None

    def clear_cache(self) -> None:
        self.cache.clear()

    def delete_user_data(self, library: bool = False) -> None:
        self.clear_cache()
        if self.learner:
            self.learner.clear(delete_file=True)
        if library and self.library:
            self.library.delete_all()


def _order(r: dict) -> tuple:
    return (-round(r["score"], 9), r["unit_ix"])


def entity_groups(rows: list[dict]) -> dict[str, dict]:
    out: dict[str, dict] = {}
    for r in rows:
        g = out.setdefault(r.get("canonical_entity_id") or "null", {"count": 0, "max_score": 0.0, "doc_ids": set()})
        g["count"] += 1
        g["max_score"] = max(g["max_score"], r["score"])
        g["doc_ids"].add(r["doc_id"])
    return {k: v | {"doc_ids": sorted(v["doc_ids"])} for k, v in out.items()}


def format_answer(mode: str, answer: str, best: list[dict], supports: list[dict], against: list[dict]) -> str:
    """The answer as the mode presents it; headings are fixed values."""
    lines = lambda title, rows: [title, *(f"- {r['content']}" for r in rows[:3])] if rows else []
    if mode == "rumor":
        body = lines("지지 근거:", supports) + lines("반대/예외 근거:", against)
        return "\n".join(["[UNVERIFIED] 다양한 주장/관측을 요약합니다 (진위 미확인).", *(body or lines("참고 근거:", best))])
    if mode in ("reporter", "fbi", "llm"):
        return "\n".join(["요약:", f"- {answer}", *lines("주요 근거:", supports), *lines("주의/반례:", against)]) if mode != "llm" else answer
    if mode == "collection" and best:
        return "\n".join(["자료/링크 후보:", *(f"- {r.get('section_path')} ({r['doc_id']})" for r in best[:6])])
    return answer


def explain(result: Result, most: int = 5) -> dict:
    keep = ("citation_id", "score", "verdict", "why", *STAGES)
    return {"answer": result.answer, "evidence": [{k: r.get(k) for k in keep} for r in result.evidence[:most]], "diagnostics": result.diagnostics}


def highlight(text: str, query: str, most: int = 220) -> str:
    """The query's words marked [[so]], longest first, cut to a length."""
    for w in sorted({w for w in tokens_py(query, grams=False) if len(w) >= 2}, key=lambda w: (-len(w), w)):
        text = re.sub(re.escape(w), lambda m: f"[[{m.group(0)}]]", text, flags=re.IGNORECASE)
    text = text.strip()
    return text if len(text) <= most else text[: most - 1].rstrip() + "…"


def payload(result: Result, query: str, most: int = 10) -> dict:
    """JSON-ready result, lists cut to a length with their totals."""
    cut = lambda rows: {"total": len(rows), "items": json.loads(json.dumps(rows[:most], default=str))}
    return {"query": query, "answer": result.answer, "evidence": cut(result.evidence), "contradictions": cut(result.contradictions), "sources": cut(result.sources), "diagnostics": json.loads(json.dumps(result.diagnostics, default=str))}


def render(result: Result, query: str, most: int = 10) -> str:
    out = [f"Answer: {result.answer}", ""]
    for n, r in enumerate(result.evidence[:most], 1):
        out += [f"{n}. [{r['verdict']}] {r['score']:.3f} {highlight(r['content'], query)}", f"   {r['citation_id']}"]
    return "\n".join(out)


def evaluate(engine: Engine, cases: list[dict]) -> dict:
    """Hit rate, MRR, nDCG and contradiction hits over cases {query, doc_ids, k, expect_contradiction?}; measures are computed in Spark."""
    spark: SparkSession = engine.units.sparkSession
    ranked, qrels, contra = [], [], []
    for i, c in enumerate(cases):
        r = engine.search(c["query"], c.get("k", 5))
        ranked += [(i, x["doc_id"], n) for n, x in enumerate(r.evidence[: c.get("k", 5)], 1)]
        qrels += [(i, d) for d in c["doc_ids"]]
        if c.get("expect_contradiction") is not None:
            contra.append(float(bool(r.contradictions) == c["expect_contradiction"]))
    m = postproc.ir_metrics(spark.createDataFrame(ranked, "query_id int, doc_id string, rank int"), spark.createDataFrame(qrels, "query_id int, doc_id string"))
    s = m.agg(*[F.sum(c).alias(c) for c in ("hit", "mrr", "ndcg")]).first()
    n = max(len(cases), 1)
    return {"query_count": len(cases), "recall_at_k": (s.hit or 0) / n, "mrr": (s.mrr or 0) / n, "ndcg_at_k": (s.ndcg or 0) / n, "contradiction_hit_rate": sum(contra) / len(contra) if contra else 0.0}


def compare(a: dict, b: dict) -> dict:
    return {k: b.get(k, 0.0) - a.get(k, 0.0) for k in ("contradiction_hit_rate", "mrr", "ndcg_at_k", "recall_at_k")}


def osint_report(results: DataFrame, query: str, most: int = 400) -> dict:
    """Graph and timeline of a query's results as the driver shows them."""
    nodes = [r.asDict() for r in osint.graph_nodes(results, query).orderBy("node_type", "node_id").limit(most).collect()]
    edges = [r.asDict() for r in osint.graph_edges(results, query).orderBy("source", "target").limit(2 * most).collect()]
    return {"nodes": nodes, "edges": edges, "timeline": [r.asDict() for r in osint.timeline(results, 30).collect()]}
