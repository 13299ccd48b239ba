"""Star graph of a query's results and the timeline of the dates they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dates, short_hash


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def graph_nodes(results: DataFrame, query: str) -> DataFrame:
    """(node_id, node_type, label): the query, each url and each host once."""
    q = results.sparkSession.createDataFrame([(query,)], "label string").select(F.concat(F.lit("q:"), short_hash(F.col("label"))).alias("node_id"), F.lit("query").alias("node_type"), "label")
    urls = results.where(F.col("url").isNotNull()).select(F.concat(F.lit("url:"), short_hash(F.col("url"))).alias("node_id"), F.lit("url").alias("node_type"), F.col("url").alias("label")).groupBy("node_id", "node_type").agg(F.min("label").alias("label"))
    hosts = results.select(authority(F.col("url")).alias("label")).where(F.col("label") != "").distinct().select(F.concat(F.lit("domain:"), F.col("label")).alias("node_id"), F.lit("domain").alias("node_type"), "label")
    return q.unionByName(urls).unionByName(hosts)


def graph_edges(results: DataFrame, query: str) -> DataFrame:
    """(source, target, edge_type): query to url and url to host, one of each per result (edges repeat with results)."""
    rows = results.where(F.col("url").isNotNull()).select(F.concat(F.lit("url:"), short_hash(F.col("url"))).alias("u"), authority(F.col("url")).alias("d"))
    q = F.concat(F.lit("q:"), short_hash(F.lit(query)))
    hosted = rows.where(F.col("d") != "").select(F.col("u").alias("source"), F.concat(F.lit("domain:"), "d").alias("target"), F.lit("hosted_on").alias("edge_type"))
    return rows.select(q.alias("source"), F.col("u").alias("target"), F.lit("query_hits").alias("edge_type")).unionByName(hosted)


def timeline(results: DataFrame, limit: int | None = None) -> DataFrame:
    """(date, url, title, snippet, web_rank), a row for each date in title and snippet, by date and rank."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")))
    rows = results.select(F.explode(dates(text)).alias("date"), "url", "title", "snippet", "web_rank")
    return rows if limit is None else rows.orderBy("date", "web_rank", "url").limit(limit)
