"""Queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import blocks, lines, neardup, packing, residue, scans, splitting, subjects, tokenizer


def page_records(spark: SparkSession, d: str) -> DataFrame:
    """record_id, url, text of the fetched pages and the page-text units."""
    pages = table(spark, d, "web_fetched_pages").select(F.col("page_id").alias("record_id"), F.col("final_url").alias("url"), "text")
    units = table(spark, d, "evidence_units").where(F.col("source_type") == "web_page_text")
    return pages.unionByName(units.select(F.col("unit_id").alias("record_id"), F.col("doc_id").alias("url"), F.col("content").alias("text")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_lines(page_records(spark, d))


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    return lines.without_repeated_lines(page_records(spark, d))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(*neardup.near_duplicates(_snippets(spark, d), "id", "text", width=3, threshold=0.5, least=24))


def _long_texts(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "web_fetched_pages").select(F.col("page_id").alias("record_id"), "text")
    return pages.unionByName(table(spark, d, "evidence_units").select(F.col("unit_id").alias("record_id"), F.col("content").alias("text")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that the splitter cuts into more than one piece: a first piece that is not the whole text."""
    cut = _long_texts(spark, d).where(F.length("text") > 900).select("record_id", F.size(splitting.pieces(F.col("text"))).alias("n"))
    return cut.where(F.col("n") > 1).select("record_id").distinct()


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(_long_texts(spark, d), "record_id", "text").distinct()


def _snippets(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "evidence_units").where(F.col("source_type").isin("text_sentence", "web_snippet"))
    return units.select(F.col("unit_id").alias("id"), F.col("content").alias("text")).unionByName(table(spark, d, "web_search_results").select(F.col("result_id").alias("id"), F.col("snippet").alias("text")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.record_pairs(*neardup.near_duplicates(_snippets(spark, d), "id", "text", width=3, threshold=0.5, least=24))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_documents(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_areas(table(spark, d, "documents"), table(spark, d, "subject_labels")).select("doc_id", "subject").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_pages(table(spark, d, "web_fetched_pages").select("page_id", "final_url", "text")).select("page_id")


def _trusted(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "evidence_units").where(F.col("source_type") != "ocr_text").select(F.col("content").alias("t"))
    return units.unionByName(table(spark, d, "documents").select(F.col("text").alias("t")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.scan_defects(table(spark, d, "evidence_units"), _trusted(spark, d))


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.scan_defects(table(spark, d, "evidence_units"), _trusted(spark, d), repair=True)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return blocks.main_body(table(spark, d, "web_fetched_pages"), page_records(spark, d))


QUERIES = {"p6_found": p6_found, "p1_found": p1_found, "p1_repaired": p1_repaired, "p4_found": p4_found, "p10_found": p10_found, "p8_ids": p8_ids, "p9_containers": p9_containers, "p2_found": p2_found, "p2_groups": p2_groups, "p5_found": p5_found, "p5_clean": p5_clean, "p7_found": p7_found, "p7_pieces": p7_pieces}

_SITE = r"""regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^.*@', ''), ':\d*$', ''), '^www\.', '')"""
_PAGES = "select page_id as record_id, final_url as url, text from web_fetched_pages union select unit_id, doc_id, content from evidence_units where source_type = 'web_page_text'"
_LINES = rf"""r as ({_PAGES}), x as (select record_id, url, {_SITE} as site, string_split(text, chr(10)) as a from r where text is not null),
l as (select record_id, url, site, i::int as line_no, trim(regexp_replace(regexp_replace(lower(a[i]), '[0-9]+', '0', 'g'), '[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+', ' ', 'g')) as line from x, unnest(generate_series(1, len(a))) t(i))"""
_SHINGLES = """r as (select unit_id as id, content as t from evidence_units where source_type in ('text_sentence', 'web_snippet') union select result_id, snippet from web_search_results),
w as (select id, regexp_extract_all(lower(t), '[0-9a-z가-힣]+') as a from r where t is not null),
s as (select distinct id, concat_ws(' ', a[i], a[i + 1], a[i + 2]) as g from w, unnest(generate_series(1, len(a) - 2)) x(i)),
n as (select id, count(*) as n from s group by 1 having count(*) >= 24)"""
ORACLES = {
    "p2_found": rf"""with {_SHINGLES}, c as (select x.id as record_a, y.id as record_b, count(*) as k from s x join s y on x.g = y.g and x.id < y.id group by 1, 2)
select record_a, record_b from c join n na on na.id = record_a join n nb on nb.id = record_b where 2 * k >= na.n + nb.n - k""",
    "p5_found": rf"""with {_LINES}, often as (select site, line from l where line <> '' and site <> '' group by 1, 2 having count(distinct url) >= 5)
select distinct record_id, line_no from l join often using (site, line)""",
    "p5_clean": rf"""with {_LINES}, often as (select site, line from l where line <> '' and site <> '' group by 1, 2 having count(distinct url) >= 5), g as (select record_id, list(distinct line_no) as gone from l join often using (site, line) group by 1)
select record_id, url, case when gone is null then text else array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: not list_contains(gone, i::int)), chr(10)) end as text, coalesce(len(gone), 0)::int as removed from r left join g using (record_id)""",
    "p2_groups": rf"""with recursive {_SHINGLES}, c as (select x.id as a, y.id as b, count(*) as k from s x join s y on x.g = y.g and x.id < y.id group by 1, 2), e as materialized (select a, b from c join n na on na.id = a join n nb on nb.id = b where 2 * k >= na.n + nb.n - k),
f as materialized (select a, b from e union all select b, a from e), reach(id, root) as (select id, id from n union select f.b, reach.root from reach join f on f.a = reach.id),
root as (select id, min(root) as root from reach group by 1), links as (select a as id, count(*) as k from f group by 1) select id as record_id, root as group_id, coalesce(k, 0) as links from root left join links using (id)""",
    "p7_found": "select page_id as record_id from web_fetched_pages where length(text) > 900 union select unit_id from evidence_units where length(content) > 900",
}
