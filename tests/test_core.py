import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from coppice.engine import Engine, compare, evaluate, explain, highlight, payload, render
from coppice.functions import text
from coppice.operators import osint, postproc, retrieval
from coppice.plans import dsl
from coppice.plans.learning import Learner
from coppice.sources import documents, web
from coppice.sources.library import Library, dot

U = "unit_ix bigint, doc_id string, source_type string, content string, section_path string, char_start bigint, char_end bigint, timestamp string, confidence double, canonical_entity_id string"
ROWS = [
    (1, "doc-1", "text_sentence", "새 규칙을 적용하자 처리 속도 개선 효과가 나타났다.", "A/1", 0, 25, "2024-01-01T00:00:00Z", 0.9, "e-1"),
    (2, "doc-2", "text_sentence", "다만 예외 구역에서는 적용이 불가하다.", "A/2", 26, 53, "2024-01-01T00:00:00Z", 0.8, None),
    (3, "doc-3", "text_sentence", "시점과 대상 범위를 바꾸면 성능이 달라진다.", "A/3", 54, 86, "2024-01-01T00:00:00Z", 0.7, "e-1"),
]
Q = "처리 속도 개선"


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame(ROWS, U).cache()


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_scalars(spark):
    assert [one(spark, text.short_hash, x) for x in ("abc", "가나", "https://example.com/a")] == ["001998f2", "0058b498", "5b3a4280"]
    assert [one(spark, text.masked_entity, x) for x in ("홍길동", "010-xxxx1234", "처리 속도개선", "ab", "abcdef@example.com")] == ["홍*동", "010***1234", "처리 속*선", "ab", "a*c***@e*e.c*m"]
    assert [one(spark, lambda c: text.shard(c, 4), x) for x in ("doc-1", "doc-2", "doc-3", "https://example.com/a")] == [0, 0, 0, 1]
    assert [one(spark, text.language, x) for x in ("처리 speed", "network", "처리", "1 2", None)] == ["en", "en", "ko", "unknown", "unknown"]
    assert one(spark, text.dates, "on 2024-1-02, 2024.13.01 and 2023년 3월 4일 발생") == ["2023-03-04", "2024-01-02"]
    assert one(spark, text.sentences, "One. Two!\nThree ") == ["One.", "Two!", "Three"]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="aB1 가나다-é\n", max_size=25), min_size=1, max_size=12))
def test_tokens_like_python(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", text.tokens(F.col("x")).alias("t"), text.language(F.col("x")).alias("l")).collect()
    for r in rows:
        assert Counter(r.t) == Counter(text.tokens_py(texts[r.i]))
        assert r.l == text.language_py(texts[r.i])


def brute_bm25(query, rows):
    docs = {r[0]: text.tokens_py(r[3]) for r in rows}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for i, ts in docs.items():
        c, s = Counter(ts), 0.0
        for t, m in Counter(text.tokens_py(query)).items():
            df = sum(t in d for d in docs.values())
            if c[t]:
                s += m * math.log(1 + (n - df + 0.5) / (df + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * len(ts) / avg))
        if s:
            out[i] = s
    return out


def test_bm25_and_lexical_like_brute_force(spark, units):
    u = retrieval.with_shard(units)
    got = retrieval.term_scores(u, retrieval.query_terms(spark, [("p", Q)])).collect()
    want = brute_bm25(Q, ROWS)
    assert {r.unit_ix: round(r.bm25, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    q = set(text.tokens_py(Q))
    assert {r.unit_ix: round(r.lexical, 9) for r in got} == {r[0]: round(len(q & set(text.tokens_py(r[3]))) / len(q), 9) for r in ROWS if q & set(text.tokens_py(r[3]))}


def test_priors(spark, units):
    assert {r.unit_ix: round(r.p, 6) for r in units.select("unit_ix", retrieval.quality_prior().alias("p")).collect()} == {1: 0.928902, 2: 0.855388, 3: 0.779056}
    rows = [(1, "d", "table_cell", "ab", None, 0, 2, None, 0.86, None), (2, "d", "ocr_text", "x", None, 3, 4, None, 0.72, None), (3, "d", "ocr_text", "x", None, 5, 6, None, 0.1, None), (4, "d", "caption", "x", None, 5, 6, "bad", 0.9, None), (5, "d", "caption", "x", None, 5, 6, None, None, None)]
    got = {r.unit_ix: round(r.p, 6) for r in spark.createDataFrame(rows, U).select("unit_ix", retrieval.quality_prior(now="2024-01-01 00:00:00+00:00").alias("p")).collect()}
    assert got == {1: 0.74432, 2: 0.619765, 3: 0.0, 4: 0.901035, 5: 0.0}
    assert abs(spark.range(1).select(postproc.web_prior(F.lit(2), F.lit(3)).alias("p")).first().p - 1.064) < 1e-9


def test_retrieve_fuses_and_breaks_ties(spark, units):
    got = retrieval.retrieve(retrieval.with_shard(units), retrieval.query_terms(spark, dsl.passes(Q)), 5).collect()
    first = [r for r in got if r.pass_ix == 0]
    assert first[0].unit_ix == 1 and round(first[0].rrf, 6) == round(2 / 61, 6)
    assert all(0 <= r.bm25_norm <= 1 for r in got if r.bm25_norm is not None)
    assert retrieval.retrieve(retrieval.with_shard(units.limit(0)), retrieval.query_terms(spark, [("p", Q)]), 5).count() == 0


def test_filtering_is_retrieval_over_the_rest(spark, units):
    f = dsl.parse_query('doc:doc-1 doc:doc-3 "' + Q + '"')
    assert f.clean == Q and f.filters.doc_ids == {"doc-1", "doc-3"}
    terms = retrieval.query_terms(spark, [("p", Q)])
    a = retrieval.bm25_topk(retrieval.with_shard(dsl.apply_filters(units, f.filters)), terms, 5).collect()
    assert {r.unit_ix: round(r.score, 9) for r in a} == {k: round(v, 9) for k, v in brute_bm25(Q, [ROWS[0], ROWS[2]]).items()}


def test_query_language():
    q = dsl.parse_query('source:ocr -source:web section:A/1 after:2024-01-01 doc:x "two words" it')
    assert (q.filters.include, q.filters.exclude, q.filters.sections, q.filters.after, q.clean) == ({"ocr_text"}, {"web_snippet"}, {"A/1"}, "2024-01-01", "two words it")
    assert not q.filters.allows_web() and dsl.parse_query("-source:web_snippet x").filters.allows_web()
    assert dsl.parse_query("don't stop").clean == "don't stop" and dsl.parse_query("source:nonsense x").filters.include == frozenset()
    assert dsl.mode("OSINT 모드").name == "fbi" and dsl.mode("심층분석").name == "llm" and dsl.mode("??").name == "investigation"
    assert len(dsl.passes("network", "fbi")) == 7
    assert dsl.aliases("ab")[0] == ("ab", 0.0, "original_normalized")
    assert dsl.expansions(Q)[0] == (Q, 0.0) and all(p <= 0.65 for _, p in dsl.expansions("처리 속도개선"))


def test_time_filters(spark):
    rows = [(i, "d", "caption", "x", None, 0, 1, t, 0.5, None) for i, t in enumerate(["2024-01-01", "2024-01-01T05:00:00+0900", "bad", None, "2023-12-31T23:00:00-02"])]
    got = dsl.apply_filters(spark.createDataFrame(rows, U), dsl.parse_query("after:2024-01-01T00:30:00Z x").filters)
    assert {r.unit_ix for r in got.collect()} == {2, 3, 4}


def test_dedupe_keeps_last_stage_and_best_row(spark):
    rows = spark.createDataFrame([("d", 0, 5, 1, 0.5, 0, "a", "supports", 1.0, None), ("d", 0, 5, 2, 0.5, 1, "b", "uncertain", None, 3.0), ("e", 0, 5, 3, 0.1, 0, "a", "uncertain", 2.0, 2.0)], "doc_id string, char_start int, char_end int, unit_ix bigint, score double, pass_ix int, pass_name string, verdict string, x double, y double")
    got = {r.doc_id: r for r in postproc.dedupe(rows, ["x", "y"]).collect()}
    assert (got["d"].unit_ix, got["d"].x, got["d"].y, got["d"].why) == (2, 1.0, 3.0, "a + b")
    assert got["e"].unit_ix == 3


def test_measures(spark):
    ranked = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (1, "b", 3), (2, "x", 1)], "query_id int, doc_id string, rank int")
    got = {r.query_id: r for r in postproc.ir_metrics(ranked, spark.createDataFrame([(1, "a"), (1, "b")], "query_id int, doc_id string")).collect()}
    assert round(got[1].ndcg, 6) == 0.693426 and got[1].mrr == 0.5 and got[2].hit == 0.0 and got[2].ndcg == 0.0


def test_spans_and_builds(spark, tmp_path):
    docs = spark.createDataFrame([("a", "One. Two two.\nThree"), ("b", None), ("c", "  ")], "doc_id string, text string")
    got = documents.sentence_units(docs).orderBy("pos").collect()
    assert [(r.content, r.char_start, r.char_end) for r in got] == [("One.", 0, 4), ("Two two.", 5, 13), ("Three", 14, 19)]
    u = documents.sentence_units(docs).withColumn("unit_ix", F.col("pos").cast("bigint"))
    m = documents.write_build(u, str(tmp_path / "b"), corpus="c", shards=2)
    back, index, manifest = documents.load_build(spark, str(tmp_path / "b"))
    assert manifest == m and back.count() == 3 and index.postings.count() > 0
    with pytest.raises(ValueError):
        documents.write_build(u.limit(0), str(tmp_path / "e"), corpus="c")
    old = u.where("pos = 0").select(documents.content_key("m1").alias("key"), F.array(F.lit(1.0)).alias("embedding"))
    kept, missing = documents.reuse(u, old, "m1")
    assert (kept.count(), missing.count()) == (1, 2) and documents.reuse(u, old, "m2")[0].count() == 0
    (tmp_path / "t.txt").write_text("A b. C d.")
    assert documents.read_texts(spark, [str(tmp_path / "t.txt")]).first().doc_id == "t"
    with pytest.raises(ValueError):
        documents.read_texts(spark, ["x.exe"])


def test_html(spark):
    page = '<html><head><title>T &amp; t</title><script>var t="</p>"</script></head><body><p>after travel fast</p><a href="/x?y=1#z">x</a><a href="https://other.example/">o</a><a href="mailto:q@q">m</a></body></html>'
    r = web.parse_pages(spark.createDataFrame([(page, "https://h.example/a"), (None, None)], "html string, url string")).collect()
    assert r[0].title == "T & t" and "after travel fast" in r[0].text and "var t" not in r[0].text and r[0].discovered_links == ["https://h.example/x?y=1"]
    assert r[1].title == "" and r[1].discovered_links == []
    assert web.decode("가".encode("cp949"), "text/html; charset=cp949") == "가" and web.decode(b"\xff\xfe\xfa", "") != ""
    chunks = web.chunk_text("\n\n".join(["word " * 60] * 9))
    assert all(len(c) <= 900 for c, _, _ in chunks) and len(chunks) >= 3
    seen = spark.createDataFrame([("https://h.example/a",)], "url string")
    links = spark.createDataFrame([(["https://h.example/a", "https://h.example/b"],)], "discovered_links array<string>")
    assert [x.url for x in web.frontier(links, seen).collect()] == ["https://h.example/b"]

    class P:
        def fetch(self, url):
            if "bad" in url:
                raise OSError
            return {"status": 200, "text": "ok"}

    got = web.fetch(spark.createDataFrame([(0, "https://a.example/"), (1, "ftp://x"), (2, "https://bad.example/"), (3, "")], "pos int, url string"), P(), public=lambda h: True).orderBy("pos").collect()
    assert [x.error for x in got] == [None, "unsupported_scheme", "fetch_error:OSError", "empty_url"]


def test_graph_and_timeline(spark):
    rows = spark.createDataFrame([("on 2024-01-02", "https://a.example/1", "and 2024-01-03", 1), ("x", "https://a.example/2", None, 2), ("x", "https://a.example/2", None, 3)], "title string, url string, snippet string, web_rank int")
    assert osint.graph_nodes(rows, "q").count() == 4 and osint.graph_edges(rows, "q").count() == 6
    assert [r.date for r in osint.timeline(rows, 5).collect()] == ["2024-01-02", "2024-01-03"]


def test_engine(spark, units, tmp_path):
    lib = Library(str(tmp_path / "lib"))
    e = Engine(units, learner=Learner(path=str(tmp_path / "s.json")), library=lib)
    r = e.search(Q, aliases=False)
    assert r.evidence[0]["unit_ix"] == 1 and r.answer == ROWS[0][3] and r.sources[0]["citation_id"] == "doc-1:A/1:0-25" and r.contradictions[0]["unit_ix"] == 2
    assert e.search(Q, aliases=False).diagnostics["cache"] == "hit"
    assert e.search("sniper " + Q, mode="sniper", aliases=False).evidence[0]["unit_ix"] == 1
    assert e.search("doc:doc-2 적용", aliases=False).evidence[0]["doc_id"] == "doc-2"
    assert e.search("zzzxxyyqq", aliases=False).evidence == []
    assert "[[처리]]" in render(r, Q) and payload(r, Q, 1)["evidence"]["total"] == len(r.evidence) and explain(r)["evidence"]
    assert abs(sum(e.learner.state.weights.values()) - 1) < 1e-9 and e.learner.state.boosts
    m = evaluate(Engine(units), [{"query": Q, "doc_ids": ["doc-1"], "expect_contradiction": True}])
    assert m["mrr"] == 1.0 and compare(m, m)["mrr"] == 0.0
    assert lib.sessions(spark, contains="sniper").count() == 1 and lib.sessions(spark, mode="sniper").count() == 1
    with open(tmp_path / "lib/sessions.jsonl", "a") as f:
        f.write("{broken\n")
    n = lib.sessions(spark).count()
    assert lib.export(str(tmp_path / "x"), "markdown")["exported_sessions"] == n == len(lib.ids())
    assert lib.publish(str(tmp_path / "x.zip")).endswith("zip") and "->" in dot({"nodes": [], "edges": [{"source": "a", "target": "b", "edge_type": "t"}]})
    e.learner.save()
    assert Learner(path=str(tmp_path / "s.json")).state.boosts == e.learner.state.boosts
    e.delete_user_data(library=True)
    assert not e.cache


def test_web_results_join_the_search(spark, units):
    class P:
        def search(self, query, most):
            return [{"title": "t", "url": "https://w.example/1", "snippet": "unique walrus report", "rank": 1}][:most]

    e = Engine(units, search_provider=P())
    assert e.search("walrus report", aliases=False).evidence[0]["doc_id"] == "https://w.example/1"
    assert all(x["source_type"] != "web_snippet" for x in e.search("section:A walrus 처리", aliases=False).evidence)
    assert highlight("Walrus walrus", "walrus") == "[[Walrus]] [[walrus]]"


def test_stream_folds_searches(spark, tmp_path):
    from coppice.streaming.queries import learn_from, windowed_counts

    (tmp_path / "in").mkdir()
    spark.createDataFrame([("walrus",), ("seal",)], "query string").write.parquet(str(tmp_path / "in/a"))
    learner = Learner()
    stream = spark.readStream.schema("query string").parquet(str(tmp_path / "in/a"))
    q = learn_from(stream, learner, lambda t: [{"score": 0.5, "content": t, "bm25": 1.0}], str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert learner.state.searches == 2 and set(learner.state.boosts) == {"walrus", "seal"}
    ev = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0)], "t string, event_type string, value double").withColumn("ts", F.to_timestamp("t"))
    assert windowed_counts(ev).first().total == 3.0


def test_command_line(spark, tmp_path, capsys, units):
    from coppice.cli import main

    documents.write_build(units, str(tmp_path / "b"), corpus="c")
    assert main(["search", Q, "--build", str(tmp_path / "b")]) == 0
    assert "Answer" in capsys.readouterr().out
    Library(str(tmp_path / "l"))
    assert main(["delete", str(tmp_path / "l")]) == 2 and main(["delete", str(tmp_path / "l"), "--yes"]) == 0


def test_search_parsers():
    page = '<div><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.example%2Fx&amp;rut=1">A <b>b</b></a><a class="result__snippet" href="#">S &amp; s</a></div><a class="result__a" href="https://b.example/">B</a>'
    got = web.parse_search_page(page)
    assert [(r["url"], r["title"], r["snippet"], r["web_rank"]) for r in got] == [("https://a.example/x", "A b", "S & s", 1), ("https://b.example/", "B", "", 2)]
    got = web.parse_search_json({"results": [{"title": "", "url": "u"}, {"title": "t", "url": "https://c.example/", "content": None}]})
    assert [(r["web_rank"], r["snippet"]) for r in got] == [(2, "")] and web.parse_search_json({}) == []
    assert web.parse_snapshots([["timestamp", "original", "statuscode"], ["2020", "http://a.example/", "200"]])[0]["url"] == "https://web.archive.org/web/2020/http://a.example/"
    assert web.parse_snapshots([]) == [] and not web.is_public_host("127.0.0.1")


def test_binaries(spark, tmp_path):
    from coppice.sources.binaries import read_binaries

    class X:
        def pages(self, raw, path):
            return [{"text": raw.decode(), "tables": [[["a", ""], ["b", "c"]]]}, {"text": " ", "ocr": "read"}, {}]

    (tmp_path / "f.pdf").write_bytes(b"hello")
    got = read_binaries(spark, [str(tmp_path / "f.pdf")], X()).orderBy("pos").collect()
    assert [(r.source_type, r.content, r.section_path) for r in got] == [("text_sentence", "hello", "page/1/text"), ("table_cell", "a", "page/1/table/1/r1c1"), ("table_cell", "b", "page/1/table/1/r2c1"), ("table_cell", "c", "page/1/table/1/r2c2"), ("ocr_text", "read", "page/2/ocr")]


def test_index_gives_what_texts_give(spark, units, tmp_path):
    out = str(tmp_path / "b")
    enc = documents.HashEncoder(16)
    first = documents.write_build(units.limit(2), out + "0", corpus="c", shards=2, encoder=enc, model="h")
    m = documents.write_build(units, out, corpus="c", shards=2, encoder=enc, model="h", previous=out + "0")
    assert first["reused_vectors"] == 0 and m["reused_vectors"] == 2 and set(m["sha256"]) == {"units", "postings", "terms", "stats", "vectors"}
    rows, index, _ = documents.load_build(spark, out)
    terms = retrieval.query_terms(spark, dsl.passes(Q))
    cold = {tuple(r) for r in retrieval.retrieve(retrieval.with_shard(units, 2), terms, 5).select("pass_ix", "unit_ix", F.round("score", 9)).collect()}
    warm = retrieval.retrieve(rows, terms, 5, index=index).select("pass_ix", "unit_ix", F.round("score", 9))
    assert {tuple(r) for r in warm.collect()} == cold
    e = Engine(rows, shards=2, index=index, vectors=documents.load_vectors(spark, out), encoder=enc)
    r = e.search(Q, aliases=False)
    assert r.evidence[0]["unit_ix"] == 1 and any(x["dense"] is not None for x in r.evidence) and sum(r.diagnostics["shards"].values()) > 0


def test_plug_ins_and_time_budget(spark, units):
    class Last:
        def score(self, query, contents):
            return [float("예외" in c) for c in contents]

    class Against:
        def predict(self, query, contents):
            return [{"label": "contradicts", "score": 0.99, "rationale": "x"} for _ in contents]

    e = Engine(units, reranker=Last(), detector=Against())
    r = e.search(Q, aliases=False)
    assert r.evidence[0]["unit_ix"] == 2 and len(r.contradictions) == len(r.evidence)
    late = e.search(Q + " ", aliases=False, time_budget=0.0)
    assert late.diagnostics["passes"] == ["pass_a_support"] and late.diagnostics["skipped_passes"] and late.diagnostics["rerank"]["reason"] == "time_budget_exceeded"
    assert [postproc.parse_score(x) for x in ("0.7", "score: 1", "about 0.25.", "none", "nan")] == [0.7, 1.0, 0.25, 0.0, 0.0]

    class Model:
        def generate(self, prompt):
            return "written [1]" if "Answer the query" in prompt else "0.5"

    assert Engine(units, model=Model()).search(Q, mode="llm", aliases=False).answer == "written [1]"
    assert postproc.ModelReranker(Model()).score("q", ["a"]) == [0.5]
    with pytest.raises(ValueError):
        Engine(units, vectors=units)


def test_pages_join_the_search(spark, units, tmp_path):
    long = "The walrus report names the harbour and the date of 2024-01-02 in each of its many parts. " * 4

    class P:
        def search(self, query, most):
            return [{"title": "Walrus 2024-01-03", "url": "https://w.example/1", "snippet": "a walrus snippet", "rank": 1, "provider": "p"}, {"title": "t", "url": "https://v.example/2", "snippet": "qqq", "rank": 2}][:most]

    class F2:
        def fetch(self, url):
            link = "<a href='/next'>n</a>" if url.endswith("1") else ""
            return {"raw": f"<html><title>T</title><body><p>{long}</p>{link}</body></html>".encode(), "content_type": "text/html", "status": 200}

    lib = Library(str(tmp_path / "l"))
    e = Engine(units, search_provider=P(), fetch_provider=F2(), library=lib, crawl_depth=1, fetch_options={"public": lambda h: True})
    r = e.search("walrus report", aliases=False)
    kinds = {x["source_type"] for x in r.evidence}
    assert "web_page_text" in kinds and r.diagnostics["web"]["used"] and r.diagnostics["osint"]["timeline"][0]["date"] == "2024-01-03"
    saved = lib.load(r.diagnostics["session_id"])
    assert saved["extra"]["graph"]["nodes"] and (tmp_path / "l/osint").iterdir() and any((tmp_path / "l/evidence").iterdir())
    far = Engine(units, search_provider=P()).search("zzzxxyyqq", aliases=False)
    assert far.evidence and far.evidence[0]["why"] == "web_fallback" and far.evidence[0]["verdict"] == "uncertain"
    blocked = web.fetch(spark.createDataFrame([(0, "http://127.0.0.1/x"), (1, "ftp://a.example/"), (2, "")], "pos bigint, url string"), F2()).orderBy("pos").collect()
    assert [x.error for x in blocked] == ["blocked_hostname", "unsupported_scheme", "empty_url"]
    assert web.read_answer({"raw": b"x" * 50, "content_type": "text/plain"}, "u", max_bytes=10)["truncated"] and web.read_answer({"raw": b"", "content_type": "application/pdf"}, "u")["error"] == "pdf_no_text"


def test_documents_to_build_and_service(spark, tmp_path, capsys):
    from coppice.cli import answer, load_engine, main

    (tmp_path / "a.txt").write_text("The walrus sleeps. The seal swims.")
    (tmp_path / "b.md").write_text("A walrus wakes.")
    with pytest.raises(ValueError):
        documents.parse_documents(spark, [str(tmp_path / "a.txt"), "x.exe"])
    assert main(["build", str(tmp_path / "a.txt"), str(tmp_path / "b.md"), "--out", str(tmp_path / "o"), "--vectors"]) == 0
    (tmp_path / "cases.json").write_text('[{"query": "seal swims", "doc_ids": ["a"]}]')
    assert main(["evaluate", str(tmp_path / "cases.json"), "--build", str(tmp_path / "o")]) == 0
    assert '"mrr": 1.0' in capsys.readouterr().out
    e = load_engine(str(tmp_path / "o"))
    status, out = answer(e, b'{"query": "seal", "k": 2}')
    assert status == 200 and out["evidence"]["items"][0]["doc_id"] == "a" and answer(e, b"{}")[0] == 400 and answer(e, b" " * 1_000_001)[0] == 413
