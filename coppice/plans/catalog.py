"""Named queries of the core over the test tables, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..engine import highlight as mark
from ..functions import text
from ..operators import osint, postproc, retrieval, timestamps
from ..runtime import shared_folder, table
from ..schema import citation_id
from ..sources import documents as docs
from ..sources import web
from ..sources.library import listing
from . import dsl
from .learning import Learner

Q = "clinical surgeon vaccine review of the clinic"
NOW = "2025-07-01 00:00:00+00:00"
STAGES = ["bm25", "lexical", "rrf", "quality_prior"]


def units(spark: SparkSession, d: str, shards: int = 1, filters: str = "") -> DataFrame:
    """The evidence table as units; copies of a row count once. Filters of a query go below the removal of copies, to the scan."""
    rows = table(spark, d, "evidence_units").where(F.col("content").isNotNull()).withColumnsRenamed({"unit_id": "unit_ix", "timestamp_text": "timestamp"}).drop("collector_id", "received_at")
    if filters:
        rows = dsl.apply_filters(rows, dsl.parse_query(filters).filters)
    return retrieval.with_shard(rows.distinct(), shards)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every record whose written time names one instant, once."""
    rows = table(spark, d, "evidence_units").select(F.lit("evidence_units").alias("source_table"), F.col("unit_id").cast("string").alias("record_key"), F.col("timestamp_text").alias("written"), "collector_id", "received_at")
    sessions = table(spark, d, "library_sessions").select(F.lit("library_sessions").alias("source_table"), F.col("session_id").alias("record_key"), F.col("created_at").alias("written"), "collector_id", "received_at")
    out = timestamps.normalise_timestamps(rows.unionByName(sessions), table(spark, d, "collectors"), text="written")
    return out.where(F.col("instant_us").isNotNull()).select("source_table", "record_key", "instant_us").distinct()


def p3_zones(spark: SparkSession, d: str) -> DataFrame:
    """Zones estimated for all collectors as if none were declared, from all local times of both tables; the date orders are known."""
    rows = table(spark, d, "evidence_units").select("collector_id", F.col("timestamp_text").alias("written"), "received_at").unionByName(table(spark, d, "library_sessions").select("collector_id", F.col("created_at").alias("written"), "received_at"))
    dim = table(spark, d, "collectors")
    named = sorted(r.time_zone for r in dim.select("time_zone").distinct().collect() if r.time_zone)  # a dimension table
    rows = rows.join(dim.select("collector_id", "date_order"), "collector_id").withColumn("__recv_us", F.unix_micros("received_at"))
    local = timestamps.parse(rows, "written", F.col("date_order"), keep=("__recv_us",)).where(F.col("__local_us").isNotNull() & F.col("__offset_us").isNull())
    zones = [*timestamps.CANDIDATES, *(z for z in named if z not in timestamps.CANDIDATES)]
    return timestamps.estimate_zones(local.select("collector_id", "__local_us", F.col("__recv_us").alias("received_us")), "collector_id", zones).select("collector_id", "estimated_zone")


# ---- texts and corpus


def units_sentences(spark, d):
    return docs.sentence_units(table(spark, d, "documents")).select("doc_id", "pos", "content", "char_start", "char_end")


def lang_detect(spark, d):
    return table(spark, d, "documents").select("doc_id", text.language(F.col("text")).alias("detected"))


def tokens_tf(spark, d):
    return retrieval.postings(units(spark, d)).select("unit_ix", "term", "tf", "dl")


def term_df(spark, d):
    return retrieval.term_df(units(spark, d)).select("term", "df")


def corpus_stats(spark, d):
    return retrieval.corpus_stats(units(spark, d, 4)).select("shard_id", "n", F.round("avgdl", 6).alias("avgdl"))


def char_ngrams(spark, d):
    return units(spark, d).select("unit_ix", F.array_join(text.tokens(F.col("content")), " ").alias("tokens"))


def shard_assign(spark, d):
    return units(spark, d, 4).select("unit_ix", "shard_id")


def masked_entity(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.masked_entity(F.concat("c_name", F.lit(" mail "), F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", ".")), F.lit("@example.com 010-xxxx1234 홍길동"))).alias("masked"))


def short_hash(spark, d):
    return table(spark, d, "web_search_results").where(F.col("url").isNotNull()).select("url").distinct().select("url", text.short_hash(F.col("url")).alias("h"))


# ---- retrieval


def _bm25(spark, d, shards=1, boosts=None, filters=""):
    u = units(spark, d, shards, filters)
    top = retrieval.bm25_topk(u, retrieval.query_terms(spark, [("pass_a_support", Q)], boosts=boosts), 10)
    return top.select("shard_id", "rank", "unit_ix", F.round("score", 6).alias("score"))


def _indexed(spark, d):
    """The units and their saved index, written to the shared folder and read again."""
    out = shared_folder(spark)
    u = units(spark, d)
    docs.save_index(u, out)
    return u, docs.load_index(spark, out)


def bm25_topk_indexed(spark, d):
    u, index = _indexed(spark, d)
    top = retrieval.bm25_topk(u, retrieval.query_terms(spark, [("pass_a_support", Q)]), 10, index)
    return top.select("shard_id", "rank", "unit_ix", F.round("score", 6).alias("score"))


def hybrid_indexed(spark, d):
    u, index = _indexed(spark, d)
    return _hybrid_columns(retrieval.retrieve(u, retrieval.query_terms(spark, [("pass_a_support", Q)]), 10, index=index))


def lexical_overlap(spark, d):
    s = retrieval.term_scores(units(spark, d), retrieval.query_terms(spark, [("pass_a_support", Q)]))
    return s.select("unit_ix", F.round("lexical", 6).alias("lexical"))


def dense_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = [float(x) for x in e.orderBy("vec_id").first().embedding]
    return retrieval.dense_topk(e, q, 20).select("vec_id", F.round("score", 5).alias("score"))


def _hybrid(spark, d, passes=None, k=10, shards=1, aliases=False, query=Q):
    return retrieval.retrieve(units(spark, d, shards), retrieval.query_terms(spark, passes or [("pass_a_support", query)], aliases=aliases), k)


def _hybrid_columns(rows):
    return rows.select("rank", "unit_ix", *[F.round(c, 6).alias(c) for c in ("score", "bm25", "lexical", "bm25_norm", "lexical_norm", "rrf", "quality_prior")], "verdict", "citation_id")


def hybrid_retrieve(spark, d):
    return _hybrid_columns(_hybrid(spark, d))


def hybrid_aliases(spark, d):
    return _hybrid(spark, d, aliases=True, query="처리 속도개선 백신").select("pass_ix", "rank", "unit_ix", F.round("score", 6).alias("score"))


def hybrid_dense(spark, d):
    """Units whose id is a vector's id stand for embedded units."""
    e = table(spark, d, "embeddings")
    q = [float(x) for x in e.orderBy("vec_id").first().embedding]
    near = retrieval.dense_topk(e, q, 60).select(F.col("vec_id").alias("unit_ix"), "score")
    out = retrieval.retrieve(units(spark, d), retrieval.query_terms(spark, [("pass_a_support", Q)]), 10, dense=near)
    return out.select("rank", "unit_ix", *[F.round(c, 5).alias(c) for c in ("score", "bm25", "dense", "lexical")])


def multi_pass_dedupe(spark, d):
    out = postproc.dedupe(_hybrid(spark, d, dsl.passes(Q), 30), STAGES)
    return out.select("unit_ix", "verdict", "why", F.round("score", 6).alias("score"), *[F.round(c, 6).alias(c) for c in STAGES])


def quality_prior(spark, d):
    return units(spark, d).select("unit_ix", F.round(retrieval.quality_prior(), 6).alias("prior"))


def recency_boost(spark, d):
    return units(spark, d).select("unit_ix", F.round(retrieval.quality_prior(now=NOW, half_life=365.0), 6).alias("prior"))


def _filtered(query):
    return lambda spark, d: units(spark, d, 1, query).select("unit_ix")


# ---- after retrieval


def rerank_overlap(spark, d):
    return units(spark, d).select("unit_ix", F.round(postproc.rerank_score(Q, F.col("content")), 6).alias("rerank"))


def rerank_blend(spark, d):
    """The ten best of thirty hits reranked, the others as they are."""
    return postproc.rerank(_hybrid(spark, d, k=30), Q, 10).select("unit_ix", F.round("score", 6).alias("score"))


def verdict_classify(spark, d):
    return units(spark, d).select("unit_ix", retrieval.verdict(F.lit("pass_a_support"), F.col("content")).alias("verdict"))


def contradiction_label(spark, d):
    c = postproc.contradiction(Q, F.col("content"))
    return units(spark, d).select("unit_ix", c.alias("c")).select("unit_ix", F.col("c.label").alias("label"), F.round("c.score", 6).alias("score"), F.col("c.rationale").alias("rationale"))


def entity_groups(spark, d):
    return postproc.entity_groups(units(spark, d).withColumn("score", F.coalesce("confidence", F.lit(0.0)))).withColumn("max_score", F.round("max_score", 6))


def source_citations(spark, d):
    return units(spark, d).select("unit_ix", citation_id().alias("citation_id"))


def stage_summary(spark, d):
    return postproc.stage_summary(_hybrid(spark, d, k=50), STAGES).select("stage", "n", F.round("mean", 6).alias("mean"))


def ir_metrics(spark, d):
    """A subject is a query; it ranks its labelled documents by id, those with even ids count as relevant."""
    lab = table(spark, d, "subject_labels").select("doc_id", "subject").distinct()
    qrels = lab.select(F.col("subject").alias("query_id"), "doc_id")
    every = lab.groupBy("doc_id").agg(F.min("subject").alias("query_id"))
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))).where(F.col("rank") <= 10)
    return postproc.ir_metrics(ranked, qrels.where(F.col("doc_id") % 2 == 0)).select("query_id", F.round("hit", 6).alias("hit"), F.round("mrr", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"))


# ---- web


def _results(spark, d):
    return table(spark, d, "web_search_results").distinct()


def web_rank_prior(spark, d):
    return _results(spark, d).select("result_id", F.round(postproc.web_prior(F.col("web_rank"), F.lit(3)), 6).alias("prior"))


def web_fallback(spark, d):
    return _results(spark, d).select("result_id", F.round(postproc.web_fallback(0.65, F.col("web_rank")), 6).alias("score"))


def crawl_frontier(spark, d):
    """Links of all pages that are no page's address."""
    p = table(spark, d, "web_fetched_pages")
    return web.frontier(p, p.select("url").unionByName(p.select(F.col("final_url").alias("url"))).where(F.col("url").isNotNull()))


def page_chunks(spark, d):
    p = table(spark, d, "web_fetched_pages").where(F.col("text").isNotNull()).select("page_id", "text").distinct()
    return web.page_chunks(p, "page_id").select("page_id", "chunk_no", "char_start", "char_end")


def web_page_units(spark, d):
    """Chunks of all readable pages as units."""
    p = table(spark, d, "web_fetched_pages").distinct().withColumn("pos", F.col("page_id"))
    return web.page_units(p).select("unit_ix", "doc_id", "content", "char_start", "char_end")


def url_dedupe(spark, d):
    return postproc.url_dedupe(_results(spark, d)).select("url", "result_id", "web_rank", "n_providers")


def osint_graph_nodes(spark, d):
    return osint.graph_nodes(_results(spark, d), Q)


def osint_graph_edges(spark, d):
    return osint.graph_edges(_results(spark, d), Q)


def timeline(spark, d):
    rows = units(spark, d).select(F.col("timestamp").alias("title"), F.lit("").alias("snippet"), F.col("doc_id").alias("url"), F.col("unit_ix").alias("web_rank"))
    return osint.timeline(rows).select("date", "url", "web_rank")


def trusted_filter(spark, d):
    return postproc.trusted(units(spark, d), ["my-por-archive.example", "open-nir.example"], F.col("doc_id")).select("unit_ix")


def session_list(spark, d):
    s = table(spark, d, "library_sessions").distinct().withColumnRenamed("search_mode", "mode")
    return listing(s, mode="sniper", contains="doc:").select("session_id", "created_at", "raw_query")


def incremental_reuse(spark, d):
    """Units of even ids were encoded before; the rest is missing."""
    u = units(spark, d)
    old = u.where(F.col("unit_ix") % 2 == 0).select(docs.content_key().alias("key"), F.array(F.lit(0.0)).alias("embedding"))
    kept, missing = docs.reuse(u, old)
    return kept.select("unit_ix", F.lit("kept").alias("state")).unionByName(missing.select("unit_ix", F.lit("missing").alias("state")))


def minmax_norm(spark, d):
    return _hybrid(spark, d, k=30).select("unit_ix", F.round("bm25_norm", 6).alias("bm25_norm"), F.round("lexical_norm", 6).alias("lexical_norm"))


def rrf_fusion(spark, d):
    return _hybrid(spark, d, k=30).select("unit_ix", F.round("rrf", 8).alias("rrf"))


def highlight(spark, d):
    """The facade's highlighting over all units."""

    def run(batches):
        for b in batches:
            yield b.assign(marked=[mark(t, Q) for t in b.pop("content")])

    return units(spark, d).select("unit_ix", "content").mapInPandas(run, "unit_ix bigint, marked string")


def _as_html(spark, d):
    """Fetched pages written as HTML again, a null title as an empty one."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    rows = table(spark, d, "web_fetched_pages").distinct().where(F.col("text").isNotNull())
    links = F.array_join(F.transform("discovered_links", lambda u: F.concat(F.lit("<a href='"), u, F.lit("'>x</a>"))), " ")
    body = F.concat(F.lit("<html><head><title> "), F.coalesce(esc(F.col("title")), F.lit("")), F.lit(" </title><script>var a = '</p>';</script></head><body><p>"), F.regexp_replace(esc(F.col("text")), "\n", "<br>"), F.lit("</p>"), F.coalesce(links, F.lit("")), F.lit("</body></html>"))
    return rows.select("page_id", F.col("final_url").alias("url"), body.alias("html"))


def html_title(spark, d):
    return web.parse_pages(_as_html(spark, d)).select("page_id", "title")


def html_links(spark, d):
    return web.parse_pages(_as_html(spark, d)).select("page_id", F.explode("discovered_links").alias("link"))


def html_text(spark, d):
    return web.parse_pages(_as_html(spark, d)).select("page_id", "text")


def snippet_units(spark, d):
    return web.snippet_units(_results(spark, d)).select("unit_ix", "doc_id", "content", "char_end", "confidence")


def alias_expand(spark, d):
    """Expansions of the clean queries of all sessions in a mode; a query's aliases are made in tasks."""
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = [(s, i, t, p) for s, q in zip(b.session_id, b.clean_query) for i, (t, p) in enumerate(dsl.expansions(q))]
            yield pd.DataFrame(rows, columns=["session_id", "exp_ix", "expansion", "penalty"])

    s = table(spark, d, "library_sessions").distinct().where(F.trim("clean_query") != "")
    return s.select("session_id", "clean_query").mapInPandas(run, "session_id string, exp_ix int, expansion string, penalty double")


def learning_fold(spark, d):
    """Weights after learning from the evidence of one query."""
    rows = [r.asDict() for r in _hybrid(spark, d).orderBy("rank").collect()]
    state = Learner().learn(Q, rows)
    return spark.createDataFrame(sorted(state.weights.items()), "channel string, weight double")


def mode_passes(spark, d):
    """The passes for the clean queries of all sessions, each in its session's mode; unknown modes and null are investigation, as in dsl.mode."""
    s = table(spark, d, "library_sessions").distinct().where(F.col("clean_query").isNotNull())
    names = spark.createDataFrame([(m, n, w.get("en", ""), w.get("mixed", w["ko"]), w["ko"]) for m in dsl.MODES for n, w in [("pass_a_support", {"en": "", "ko": ""}), *((k, dsl.PASS_WORDS[k]) for k, _ in dsl.passes("x", m)[1:])]], "mode string, pass string, en string, mixed string, ko string")
    lang = text.language(F.col("clean_query"))
    words = F.when(lang == "en", F.col("en")).when((lang == "mixed"), F.col("mixed")).otherwise(F.col("ko"))
    known = F.create_map(*[F.lit(x) for name in [*dsl.MODES, *dsl.MODE_NAMES] for x in (name, dsl.mode(name).name)])
    key = F.regexp_replace(F.lower("search_mode"), r"(?U)\s+", "")
    mode = F.coalesce(F.try_element_at(known, key), F.try_element_at(known, F.regexp_replace(key, "모드$", "")), F.lit(dsl.mode(None).name))
    return s.withColumn("mode", mode).join(F.broadcast(names), "mode").select("session_id", "pass", F.trim(F.concat_ws(" ", "clean_query", words)).alias("query"))


QUERIES = {
    "minmax_norm": minmax_norm, "rrf_fusion": rrf_fusion, "highlight": highlight, "html_title": html_title, "html_links": html_links, "html_text": html_text, "snippet_units": snippet_units,
    "alias_expand": alias_expand, "learning_fold": learning_fold, "mode_passes": mode_passes,
    "bm25_topk_indexed": bm25_topk_indexed, "hybrid_indexed": hybrid_indexed, "rerank_blend": rerank_blend, "web_fallback": web_fallback, "crawl_frontier": crawl_frontier, "page_chunks": page_chunks, "web_page_units": web_page_units,
    "p3_found": p3_found, "p3_zones": p3_zones, "units_sentences": units_sentences, "lang_detect": lang_detect, "tokens_tf": tokens_tf, "term_df": term_df, "corpus_stats": corpus_stats,
    "char_ngrams": char_ngrams, "shard_assign": shard_assign, "masked_entity": masked_entity, "short_hash": short_hash,
    "bm25_topk": _bm25, "bm25_topk_sharded": lambda s, d: _bm25(s, d, 4), "bm25_boosted": lambda s, d: _bm25(s, d, boosts={"vaccine": 0.8, "review": 5.0}),
    "bm25_filtered": lambda s, d: _bm25(s, d, filters="-source:ocr after:2023-06-01 x"), "lexical_overlap": lexical_overlap, "dense_topk": dense_topk, "hybrid_retrieve": hybrid_retrieve,
    "hybrid_aliases": hybrid_aliases, "hybrid_dense": hybrid_dense, "multi_pass_dedupe": multi_pass_dedupe, "quality_prior": quality_prior, "recency_boost": recency_boost,
    "dsl_filter_doc": _filtered("doc:scan-0000004 x"), "dsl_filter_source": _filtered("source:ocr source:caption x"), "dsl_filter_not_source": _filtered("-source:web -source:page x"),
    "dsl_filter_section": _filtered("section:page/1 section:body x"), "dsl_filter_time": _filtered("after:2023-01-01 before:2024-06-30T12:00:00Z x"),
    "rerank_overlap": rerank_overlap, "verdict_classify": verdict_classify, "contradiction_label": contradiction_label, "entity_groups": entity_groups, "source_citations": source_citations,
    "stage_summary": stage_summary, "ir_metrics": ir_metrics, "web_rank_prior": web_rank_prior, "url_dedupe": url_dedupe, "osint_graph_nodes": osint_graph_nodes, "osint_graph_edges": osint_graph_edges,
    "timeline": timeline, "trusted_filter": trusted_filter, "session_list": session_list, "incremental_reuse": incremental_reuse,
}

# ---- the same in SQL

_U = "u as (select distinct on (unit_id) unit_id as unit_ix, doc_id, source_type, content, section_path, char_start, char_end, timestamp_text as timestamp, confidence, canonical_entity_id from evidence_units where content is not null)"
_SHARD = "(('0x' || substr(sha1(doc_id), 1, 8))::ubigint % {n})::int"


def _lang(c: str) -> str:
    ko, en = f"len(regexp_extract_all({c}, '[가-힣]'))", f"len(regexp_extract_all({c}, '[a-zA-Z]'))"
    return f"case when {c} is null or ({ko} = 0 and {en} = 0) then 'unknown' when {en} = 0 then 'ko' when {ko} = 0 then 'en' when {ko} / {en} > 1.6 then 'ko' when {ko} / {en} < 0.6 then 'en' else 'mixed' end"


_SQ = r"trim(regexp_replace(lower(content), '[\s\p{Z}\x0b\x{85}]+', ' ', 'g'))"
_TOK = rf"""t0 as (select unit_ix, {{shard}} as shard_id, regexp_extract_all({_SQ}, '[a-z0-9가-힣]+') as ws, {_lang('content')} as lg from {{src}}),
t as (select unit_ix, shard_id, case when lg in ('ko', 'mixed') then list_concat(ws, flatten(list_transform(list_filter(ws, lambda x: regexp_matches(x, '[가-힣]') and length(x) >= 2),
  lambda x: list_concat(list_transform(range(1, length(x)), lambda i: 'cg:' || substr(x, i::int, 2)), list_transform(range(1, greatest(length(x) - 1, 1)), lambda i: 'cg:' || substr(x, i::int, 3)))))) else ws end as ts from t0)"""


def _tok(src: str = "u", n: int = 1) -> str:
    return _TOK.replace("{src}", src).replace("{shard}", _SHARD.format(n=n))


def _terms(passes: list[tuple[str, str]], boosts: dict | None = None, aliases: bool = False) -> str:
    from collections import Counter

    w = lambda t: 1.0 + max(0.0, min(float((boosts or {}).get(t, 0.0)), 2.0))
    rows = []
    for p, (name, q) in enumerate(passes):
        for e, (alias, penalty) in enumerate(dsl.expansions(q) if aliases else [(q, 0.0)]):
            c = Counter(text.tokens_py(alias))
            rows += [f"({p}, '{name}', {e}, {penalty!r}::double, '{t}', {n}, {w(t)}::double, {sum(map(w, c))}::double)" for t, n in c.items()]
    return f"q(pass_ix, pass_name, ex, pen, term, mult, w, qw) as (values {', '.join(rows)})"


def _scores(passes: list[tuple[str, str]] | None = None, src: str = "u", n: int = 1, boosts: dict | None = None, aliases: bool = False) -> str:
    return f"""{_tok(src, n)}, {_terms(passes or [("pass_a_support", Q)], boosts, aliases)},
st as (select shard_id, count(*) as n, avg(len(ts)) as avgdl from t group by 1),
tf as (select shard_id, unit_ix, len(ts) as dl, term, count(*) as tf from (select shard_id, unit_ix, ts, unnest(ts) as term from t) group by all),
dfs as (select shard_id, term, count(*) as df from tf group by all),
sc as (select pass_ix, pass_name, ex, pen, shard_id, unit_ix, sum(mult * w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as bm25, sum(w) / min(qw) as lexical
  from tf join dfs using (shard_id, term) join st using (shard_id) join q using (term) group by all)"""


def _bm25_sql(n: int = 1, boosts: dict | None = None, src: str = "u", extra: str = "") -> str:
    return f"""with {_U}{extra}, {_scores(None, src, n, boosts)}, r as (select shard_id, unit_ix, bm25, row_number() over (partition by shard_id order by round(bm25, 9) desc, unit_ix) as rank from sc)
select shard_id, rank::int as rank, unit_ix, round(bm25, 6) as score from r where rank <= 10"""


_CONF = "least(greatest(coalesce(confidence, 0.0), 0.0), 1.0)"
_PRIOR = f"least(greatest(pow({_CONF}, 0.7) * case when source_type = 'ocr_text' and {_CONF} < 0.35 then 0.0 when source_type = 'ocr_text' then 0.78 when source_type = 'table_cell' then 0.94 * case when length(trim(content)) < 4 then 0.88 else 1.0 end when source_type = 'caption' then 0.97 else 1.0 end, 0.0), 1.5)"
_ANY = lambda hints: "(" + " or ".join(f"contains(content, '{h}')" for h in hints) + ")"
_VERDICT = f"case when pass_name = 'pass_b_contradict' or {_ANY(retrieval.CONTRADICTION_HINTS)} then 'contradicts' when {_ANY(retrieval.SUPPORT_HINTS)} then 'supports' else 'uncertain' end"
_CITE = "doc_id || ':' || coalesce(section_path, '') || ':' || char_start || '-' || char_end"


def _hybrid_sql(passes: list[tuple[str, str]] | None = None, k: int = 10, aliases: bool = False, dense: str = "select null::bigint as unit_ix, null::double as dense where false") -> str:
    cut, limit = max(6 * k, 12), max(8 * k, 20)
    rank = lambda c: f"case when {c} is not null then row_number() over (partition by pass_ix, shard_id order by round({c}, 9) desc nulls last, unit_ix) end"
    norm = lambda c, lo, hi: f"case when {c} is not null then case when {hi} = {lo} then ({hi} > 0)::int::double else ({c} - {lo}) / ({hi} - {lo}) end end"
    return f"""{_scores(passes, aliases=aliases)}, dn as ({dense}),
b0 as (select *, row_number() over (partition by pass_ix, ex, shard_id order by round(bm25, 9) desc, unit_ix) as r from sc),
b1 as (select pass_ix, pass_name, shard_id, unit_ix, max(lexical * (1 - pen)) as lexical, max(case when r <= {cut} then bm25 * (1 - pen) end) as bm25 from b0 group by all),
pn as (select distinct pass_ix, pass_name from q), d1 as (select pass_ix, pass_name, 0 as shard_id, unit_ix, dense from dn join u using (unit_ix), pn),
b as (select * from b1 full join d1 using (pass_ix, pass_name, shard_id, unit_ix)),
m as (select *, min(bm25) over p as blo, max(bm25) over p as bhi, min(lexical) over p as llo, max(lexical) over p as lhi, min(dense) over p as dlo, max(dense) over p as dhi, {rank('bm25')} as br, {rank('lexical')} as lr, {rank('dense')} as dr
  from b window p as (partition by pass_ix, shard_id)),
c as (select *, {norm('bm25', 'blo', 'bhi')} as bn, {norm('lexical', 'llo', 'lhi')} as ln, {norm('dense', 'dlo', 'dhi')} as den, coalesce(1.0::double / (60 + br), 0) + coalesce(1.0::double / (60 + lr), 0) + coalesce(1.0::double / (60 + dr), 0) as rrf
  from m where br <= {limit} or lr <= {limit} or dr <= {limit}),
f as (select c.*, u.doc_id, u.char_start, u.char_end, {_PRIOR} as quality_prior, (0.42 * coalesce(bn, 0) + 0.33 * coalesce(den, 0) + 0.15 * coalesce(ln, 0) + 0.10 * rrf) * {_PRIOR} as score, {_VERDICT} as verdict, {_CITE} as citation_id from c join u using (unit_ix)),
h as (select *, row_number() over (partition by pass_ix, shard_id order by round(score, 9) desc, unit_ix) as rank from f where score > 0)"""


_ISO = r"regexp_replace(regexp_replace(regexp_replace(trim(timestamp), '[zZ]$', 'Z'), '(:\d{2}(?:\.\d+)?[+-]\d{2})$', '\1:00'), '([+-]\d{2})(\d{2})$', '\1:\2')"
_TS = rf"case when regexp_full_match({_ISO}, '\d{{4}}-\d{{2}}-\d{{2}}([T ]\d{{2}}:\d{{2}}(:\d{{2}}(\.\d+)?)?(Z|[+-]\d{{2}}:\d{{2}})?)?') then try_cast(case when length(trim(timestamp)) = 10 then trim(timestamp) || 'T00:00:00Z' when regexp_matches({_ISO}, '(Z|:\d{{2}}(\.\d+)?[+-]\d{{2}}:\d{{2}})$') then {_ISO} else trim(timestamp) || 'Z' end as timestamptz) end"
_OV = lambda q: f"(len(list_intersect(list_distinct(ts), [{', '.join(repr(t) for t in sorted(set(text.tokens_py(q))))}])) / {float(len(set(text.tokens_py(q))))})"
_SENT = r"list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])[\s\p{Z}\x0b\x{85}]+', '\1' || chr(10), 'g'), '\n+'), lambda s: regexp_replace(s, '^[\s\p{Z}\x0b\x{85}]+|[\s\p{Z}\x0b\x{85}]+$', '', 'g')), lambda s: s <> '')"
_WEB = "r as (select distinct on (result_id) * from web_search_results)"
_HASH = "printf('%08x', list_reduce(list_concat([0::bigint], list_transform(string_split({c}, ''), lambda x: unicode(x)::bigint)), lambda a, b: (a * 131 + b) & 4294967295))"
_AUTH = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1))"
_AGE = f"((epoch_us(timestamptz '{NOW}') - epoch_us({_TS})) / 86400e6)"
_BM25_FILTER = f", v as (select * from u where source_type <> 'ocr_text' and coalesce({_TS} >= timestamptz '2023-06-01 00:00:00+00', true))"

_MARK = "content"
for _w in sorted({w for w in text.tokens_py(Q, grams=False) if len(w) >= 2}, key=lambda w: (-len(w), w)):
    _MARK = rf"regexp_replace({_MARK}, '(?i){_w}', '[[\0]]', 'g')"
_PG = "p as (select distinct on (page_id) * from web_fetched_pages where text is not null)"
_STRIP = lambda c: rf"regexp_replace({c}, '^[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+|[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+$', '', 'g')"
_NEAR = "select vec_id as unit_ix, list_sum(list_transform(list_zip(embedding, e), lambda x: x[1]::double * x[2]::double)) as dense from embeddings, (select embedding as e from embeddings order by vec_id limit 1) order by round(dense, 9) desc, vec_id limit 60"


def _text_sql() -> str:
    line, three = _STRIP(r"regexp_replace(l, '[ \t\r\f\x0b\x{a0}]+', ' ', 'g')"), _STRIP(r"regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g')")
    return f"""with {_PG}, x as (select page_id, string_split(' ' || coalesce(title, '') || ' ' || text || chr(10) || repeat('x ', coalesce(len(discovered_links), 0)::int), chr(10)) as a from p),
y as (select page_id, array_to_string(list_transform(a, lambda l: {line}), chr(10)) as t from x) select page_id, {three} as text from y"""


def _modes_sql() -> str:
    """The passes of each mode and the words they add, as values; modes by all their names."""
    words = [f"('{m}', '{n}', '{w.get('en', '')}', '{w.get('mixed', w.get('ko', ''))}', '{w.get('ko', '')}')" for m in dsl.MODES for n, w in [("pass_a_support", {}), *((k, dsl.PASS_WORDS[k]) for k, _ in dsl.passes("x", m)[1:])]]
    names = [f"('{x}', '{dsl.mode(x).name}')" for x in [*dsl.MODES, *dsl.MODE_NAMES]]
    return rf"""with v(mode, pass, en, mixed, ko) as (values {', '.join(words)}), nm(name, mode) as (values {', '.join(names)}), s as (select distinct session_id, search_mode, clean_query, regexp_replace(lower(search_mode), '\s+', '', 'g') as k from library_sessions where clean_query is not null),
x as (select s.*, coalesce((select mode from nm where name = k), (select mode from nm where name = regexp_replace(k, '모드$', '')), 'investigation') as mode, {_lang('clean_query')} as lg from s)
select session_id, pass, trim(clean_query || ' ' || case lg when 'en' then en when 'mixed' then mixed else ko end, ' ') as query from x join v using (mode)"""

ORACLES = {
    "minmax_norm": f"with {_U}, {_hybrid_sql(None, 30)} select unit_ix, round(bn, 6) as bm25_norm, round(ln, 6) as lexical_norm from h where rank <= 30",
    "rrf_fusion": f"with {_U}, {_hybrid_sql(None, 30)} select unit_ix, round(rrf, 8) as rrf from h where rank <= 30",
    "highlight": f"with {_U}, m as (select unit_ix, {_STRIP(_MARK)} as x from u) select unit_ix, case when length(x) <= 220 then x else {_STRIP('left(x, 219)')} || '…' end as marked from m",
    "html_title": rf"with {_PG} select page_id, trim(regexp_replace(coalesce(title, ''), '[\s\p{{Z}}]+', ' ', 'g')) as title from p",
    "html_text": _text_sql(),
    "mode_passes": _modes_sql(),
    "crawl_frontier": "select distinct l as url from (select unnest(discovered_links) as l from web_fetched_pages) where l not in (select url from web_fetched_pages where url is not null union select final_url from web_fetched_pages where final_url is not null)",
    "web_fallback": f"with {_WEB} select result_id, round(greatest(0.0, 0.65 - 0.06 * (case when coalesce(web_rank, 0) = 0 then 999 else web_rank end - 1)), 6)::double as score from r",
    "p3_zones": "select collector_id, case when time_zone in ('Asia/Seoul', 'Asia/Tokyo') then 'Asia/Seoul' else time_zone end as estimated_zone from collectors",
    "hybrid_dense": f"with {_U}, {_hybrid_sql(dense=_NEAR)} select rank::int as rank, unit_ix, round(score, 5) as score, round(bm25, 5) as bm25, round(dense, 5) as dense, round(lexical, 5) as lexical from h where rank <= 10",
    "hybrid_aliases": f"with {_U}, {_hybrid_sql([('pass_a_support', '처리 속도개선 백신')], aliases=True)} select pass_ix, rank::int as rank, unit_ix, round(score, 6) as score from h where rank <= 10",
    "rerank_blend": f"""with {_U}, {_hybrid_sql(None, 30)}, k as (select unit_ix, score, row_number() over (order by round(score, 9) desc, unit_ix) as n from h where rank <= 30)
select unit_ix, round(case when n <= 10 then 0.35 * score + 0.65 * (0.85 * {_OV(Q)} + 0.15 * least(len(list_distinct(ts)) / 32.0, 1.0)) else score end, 6) as score from k join t using (unit_ix)""",
    "html_links": rf"with {_PG}, x as (select page_id, final_url, unnest(discovered_links) as l from p) select distinct page_id, l as link from x where lower(regexp_extract(l, '^https?://(?:[^@/?#]*@)?([^/?#:]*)', 1)) = lower(regexp_extract(final_url, '^[A-Za-z]+://(?:[^@/?#]*@)?([^/?#:]*)', 1))",
    "snippet_units": f"with {_WEB} select result_id as unit_ix, url as doc_id, trim(snippet, ' ') as content, length(trim(snippet, ' '))::bigint as char_end, 0.62::double as confidence from r where url is not null and trim(coalesce(snippet, ''), ' ') <> ''",
    "units_sentences": f"""with a as (select doc_id::varchar as doc_id, {_SENT} as ss from documents where text is not null), b as (select doc_id, ss, unnest(range(1, len(ss) + 1)) as i from a)
select doc_id, (i - 1)::int as pos, ss[i] as content, coalesce(list_sum(list_transform(ss[1:i - 1], lambda s: length(s) + 1)), 0)::bigint as char_start, (coalesce(list_sum(list_transform(ss[1:i - 1], lambda s: length(s) + 1)), 0) + length(ss[i]))::bigint as char_end from b""",
    "lang_detect": f"select doc_id, {_lang('text')} as detected from documents",
    "tokens_tf": f"with {_U}, {_tok()} select unit_ix, term, count(*) as tf, dl::int as dl from (select unit_ix, len(ts) as dl, unnest(ts) as term from t) group by all",
    "term_df": f"with {_U}, {_tok()} select term, count(*) as df from (select unit_ix, unnest(list_distinct(ts)) as term from t) group by 1",
    "corpus_stats": f"with {_U}, {_tok(n=4)} select shard_id, count(*) as n, round(avg(len(ts)), 6) as avgdl from t group by 1",
    "char_ngrams": f"with {_U}, {_tok()} select unit_ix, array_to_string(ts, ' ') as tokens from t",
    "shard_assign": f"with {_U} select unit_ix, {_SHARD.format(n=4)} as shard_id from u",
    "masked_entity": r"""select c_custkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(c_name || ' mail ' || lower(regexp_replace(c_name, '[^A-Za-z0-9]', '.', 'g')) || '@example.com 010-xxxx1234 홍길동')),
 '([a-z0-9._%+-]{1,3})[a-z0-9._%+-]*(@[a-z0-9.-]+\.[a-z]{2,})', '\1***\2', 'g'), '([a-z])[a-z*]{1,}([a-z])', '\1*\2', 'g'), '([가-힣])[가-힣*]{1,}([가-힣])', '\1*\2', 'g'), '(\d{2,})[-_]?[*xX]{2,}(\d{0,})', '\1***\2', 'g'), '\s+', ' ', 'g') as masked from customer""",
    "short_hash": f"select url, {_HASH.format(c='url')} as h from (select distinct url from web_search_results where url is not null)",
    "bm25_topk": _bm25_sql(),
    "bm25_topk_sharded": _bm25_sql(4),
    "bm25_boosted": _bm25_sql(boosts={"vaccine": 0.8, "review": 5.0}),
    "bm25_filtered": _bm25_sql(src="v", extra=_BM25_FILTER),
    "lexical_overlap": f"with {_U}, {_scores()} select unit_ix, round(lexical, 6) as lexical from sc",
    "dense_topk": "with q as (select embedding as e from embeddings order by vec_id limit 1), s as (select vec_id, list_sum(list_transform(list_zip(embedding, e), lambda x: x[1]::double * x[2]::double)) as score from embeddings, q) select vec_id, round(score, 5) as score from s order by round(score, 9) desc, vec_id limit 20",
    "hybrid_retrieve": f"with {_U}, {_hybrid_sql()} select rank::int as rank, unit_ix, round(score, 6) as score, round(bm25, 6) as bm25, round(lexical, 6) as lexical, round(bn, 6) as bm25_norm, round(ln, 6) as lexical_norm, round(rrf, 6) as rrf, round(quality_prior, 6) as quality_prior, verdict, citation_id from h where rank <= 10",
    "multi_pass_dedupe": f"""with {_U}, {_hybrid_sql(dsl.passes(Q), 30)} select arg_max(unit_ix, (round(score, 9), pass_ix)) as unit_ix, arg_max(verdict, (round(score, 9), pass_ix)) as verdict, string_agg(distinct pass_name, ' + ' order by pass_name) as why, round(max(score), 6) as score,
round(arg_max(bm25, pass_ix) filter (bm25 is not null), 6) as bm25, round(arg_max(lexical, pass_ix), 6) as lexical, round(arg_max(rrf, pass_ix), 6) as rrf, round(arg_max(quality_prior, pass_ix), 6) as quality_prior from h where rank <= 30 group by doc_id, char_start, char_end""",
    "quality_prior": f"with {_U} select unit_ix, round({_PRIOR}, 6) as prior from u",
    "recency_boost": f"with {_U} select unit_ix, round(least({_PRIOR} * (1 + case when {_AGE} >= 0 then least(0.12, pow(0.5, {_AGE} / 365.0) * 0.12) else 0 end), 1.5), 6) as prior from u",
    "dsl_filter_doc": f"with {_U} select unit_ix from u where doc_id = 'scan-0000004'",
    "dsl_filter_source": f"with {_U} select unit_ix from u where source_type in ('ocr_text', 'caption')",
    "dsl_filter_not_source": f"with {_U} select unit_ix from u where source_type not in ('web_snippet', 'web_page_text')",
    "dsl_filter_section": f"with {_U} select unit_ix from u where starts_with(section_path, 'page/1') or starts_with(section_path, 'body')",
    "dsl_filter_time": f"with {_U} select unit_ix from u where coalesce({_TS} >= timestamptz '2023-01-01 00:00:00+00', true) and coalesce({_TS} <= timestamptz '2024-06-30 12:00:00+00', true)",
    "rerank_overlap": f"with {_U}, {_tok()} select unit_ix, round(0.85 * {_OV(Q)} + 0.15 * least(len(list_distinct(ts)) / 32.0, 1.0), 6) as rerank from t",
    "verdict_classify": f"with {_U} select unit_ix, {_VERDICT.replace(chr(112) + 'ass_name', chr(39) + 'pass_a_support' + chr(39), 1)} as verdict from u",
    "contradiction_label": f"""with {_U}, {_tok()}, x as (select unit_ix, {_OV(Q)} as o, {_ANY([*retrieval.CONTRADICTION_HINTS, 'not', 'never', 'cannot'])} as a, {_ANY([*retrieval.SUPPORT_HINTS, 'improve', 'support'])} as s from t join u using (unit_ix))
select unit_ix, case when a then 'contradicts' when s then 'supports' else 'uncertain' end as label, round(case when a then least(0.55 + 0.45 * o, 0.99) when s then least(0.5 + 0.45 * o, 0.95) else greatest(0.15, 0.5 * o) end, 6) as score, case when a then 'contradiction_hint+overlap' when s then 'support_hint+overlap' else 'weak_semantic_signal' end as rationale from x""",
    "entity_groups": f"with {_U} select coalesce(canonical_entity_id, 'null') as entity, count(*) as n, round(max(coalesce(confidence, 0.0)), 6) as max_score, count(distinct doc_id) as n_docs, min(doc_id) as first_doc from u group by 1",
    "source_citations": f"with {_U} select unit_ix, {_CITE} as citation_id from u",
    "stage_summary": f"with {_U}, {_hybrid_sql(None, 50)}, k as (select * from h where rank <= 50), s as (select unnest([{{'stage': 'bm25', 'v': bm25}}, {{'stage': 'lexical', 'v': lexical}}, {{'stage': 'rrf', 'v': rrf}}, {{'stage': 'quality_prior', 'v': quality_prior}}]) as x from k) select x.stage as stage, count(x.v) as n, round(sum(coalesce(x.v, 0)) / count(*), 6) as mean from s group by 1",
    "ir_metrics": """with l as (select distinct doc_id, subject from subject_labels), e as (select doc_id, min(subject) as query_id from l group by 1), r as (select *, row_number() over (partition by query_id order by doc_id) as rank from e qualify rank <= 10),
x as (select r.*, exists (select 1 from l where l.doc_id = r.doc_id and l.subject = r.query_id and l.doc_id % 2 = 0)::int as rel from r), y as (select *, row_number() over (partition by query_id order by rel desc, rank) as ideal from x)
select query_id, max(rel)::double as hit, round(coalesce(1.0::double / min(rank) filter (rel = 1), 0), 6) as mrr, round(coalesce(sum(rel / log2(rank + 1)) / nullif(sum(rel / log2(ideal + 1)), 0), 0), 6) as ndcg from y group by 1""",
    "web_rank_prior": f"with {_WEB} select result_id, round(greatest(0.55, 1 - 0.05 * (case when coalesce(web_rank, 0) = 0 then 999 else web_rank end - 1)) * 1.12, 6)::double as prior from r",
    "url_dedupe": f"with {_WEB} select url, arg_min(result_id, (coalesce(web_rank, 999), result_id)) as result_id, min(coalesce(web_rank, 999))::int as web_rank, count(distinct provider) as n_providers from r group by 1",
    "osint_graph_nodes": f"with {_WEB} select 'q:' || {_HASH.format(c=repr(Q))} as node_id, 'query' as node_type, '{Q}' as label union all select 'url:' || {_HASH.format(c='url')}, 'url', min(url) from r where url is not null group by 1 union all select distinct 'domain:' || {_AUTH}, 'domain', {_AUTH} from r where {_AUTH} <> ''",
    "osint_graph_edges": f"with {_WEB}, x as (select 'url:' || {_HASH.format(c='url')} as n, {_AUTH} as d from r where url is not null) select 'q:' || {_HASH.format(c=repr(Q))} as source, n as target, 'query_hits' as edge_type from x union all select n, 'domain:' || d, 'hosted_on' from x where d <> ''",
    "timeline": rf"""with {_U}, s as (select unit_ix, doc_id, timestamp as t from u where timestamp is not null), e as (select unit_ix, doc_id, t, unnest(list_concat(regexp_extract_all(t, '(?:^|[^0-9A-Za-z_가-힣])(20\d\d[-/]0?\d{{1,2}}[-/]0?\d{{1,2}})(?:$|[^0-9A-Za-z_가-힣])', 1), regexp_extract_all(t, '(?:^|[^0-9A-Za-z_가-힣])(20\d\d\.0?\d{{1,2}}\.0?\d{{1,2}})(?:$|[^0-9A-Za-z_가-힣])', 1),
 regexp_extract_all(t, '(?:^|[^0-9A-Za-z_가-힣])(20\d\d년\s*0?\d{{1,2}}월\s*0?\d{{1,2}}일)(?:$|[^0-9A-Za-z_가-힣])', 1))) as g from s), p as (select unit_ix, doc_id, regexp_extract_all(g, '\d+') as a from e)
select distinct a[1] || '-' || lpad(a[2]::int::varchar, 2, '0') || '-' || lpad(a[3]::int::varchar, 2, '0') as date, doc_id as url, unit_ix as web_rank from p where a[2]::int between 1 and 12 and a[3]::int between 1 and 31""",
    "trusted_filter": rf"with {_U}, h as (select *, lower(regexp_extract(doc_id, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)) as host from u) select unit_ix from h where source_type not in ('web_snippet', 'web_page_text') or host = 'my-por-archive.example' or host like '%.my-por-archive.example' or host = 'open-nir.example' or host like '%.open-nir.example'",
    "session_list": "select distinct session_id, created_at, raw_query from library_sessions where search_mode = 'sniper' and contains(lower(concat_ws(' ', raw_query, clean_query)), 'doc:')",
    "incremental_reuse": rf"with {_U}, k as (select unit_ix, doc_id || chr(31) || coalesce(section_path, '') || chr(31) || content as key from u) select unit_ix, case when key in (select key from k where unit_ix % 2 = 0) then 'kept' else 'missing' end as state from k",
}
ORACLES |= {"bm25_topk_indexed": ORACLES["bm25_topk"], "hybrid_indexed": ORACLES["hybrid_retrieve"]}
