from collections import Counter

import __spark_entry__ as e
from coppice.engine import highlight
from coppice.functions import text
from coppice.plans import catalog, dsl
from coppice.runtime import table

SMALL = "/root/testdata/sf0.001"


def test_queries_have_sql_only_for_known_names():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_runs(spark):
    assert e.entry(spark).limit(1).count() == 1


def test_each_session_has_the_passes_of_its_mode(spark):
    rows = table(spark, SMALL, "library_sessions").dropDuplicates(["session_id"]).where("clean_query is not null").collect()
    want = {(r.session_id, n, q.strip(" ")) for r in rows for n, q in dsl.passes(r.clean_query, dsl.mode(r.search_mode).name)}
    got = catalog.mode_passes(spark, SMALL).collect()
    assert {r.search_mode for r in rows} > {"reporter", None} and len(got) == len(want) and {tuple(r) for r in got} == want


def test_whole_tables(spark):
    units = {r.unit_ix: r.content for r in catalog.units(spark, SMALL).collect()}
    got = {r.unit_ix: r.tokens for r in catalog.char_ngrams(spark, SMALL).collect()}
    assert got.keys() == units.keys() and all(Counter(t.split()) == Counter(text.tokens_py(units[i])) for i, t in got.items())
    marked = {r.unit_ix: r.marked for r in catalog.highlight(spark, SMALL).collect()}
    assert marked == {i: highlight(c, catalog.Q) for i, c in units.items()}
    rows = table(spark, SMALL, "web_fetched_pages").dropDuplicates(["page_id"]).where("text is not null")
    pages = {r.page_id: r.title for r in rows.collect()}
    titles = {r.page_id: r.title for r in catalog.html_title(spark, SMALL).collect()}
    assert None in pages.values() and titles == {i: " ".join((t or "").split()) for i, t in pages.items()}
    assert {r.page_id for r in catalog.html_text(spark, SMALL).collect()} == pages.keys()
