"""Lines repeated across one site's documents: found by distinct addresses per site and line, and taken out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def site(url: Column) -> Column:
    """The host in lower case without user, port and leading www.; null where there is none."""
    authority = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def normal_text(text: Column) -> Column:
    """The text with its lines trimmed, in lower case, each run of white space one blank and each run of digits 0."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), r"(?U)[\s\x1c-\x1f&&[^\n]]+", " ")
    return F.trim(F.regexp_replace(flat, " ?\n ?", "\n"))


def normal_lines(text: Column) -> Column:
    return F.split(normal_text(text), "\n")


def hashed_lines(records: DataFrame) -> DataFrame:
    """record_id, line_no (from 1), u (hash of the address), s, h (hashes of site and line) of each line that is not blank.

    records: record_id, url, text. Rows with a null text or without a host have no lines.
    """
    at = records.where(F.col("text").isNotNull()).withColumn("site", site(F.col("url"))).where(F.col("site").isNotNull())
    rows = at.select("record_id", F.xxhash64("url").alias("u"), F.xxhash64("site").alias("s"), F.posexplode(normal_lines(F.col("text"))).alias("pos", "line"))
    return rows.where(F.col("line") != "").select("record_id", (F.col("pos") + 1).cast("int").alias("line_no"), "u", "s", F.xxhash64("line").alias("h"))


def frequent(lines: DataFrame, min_urls: int, min_share: float = 0.0) -> DataFrame:
    """(s, h, n): the lines of a site under at least min_urls addresses and min_share of the site's addresses. Aggregations in steps with map-side parts, so that no hot line or site meets in one task."""
    often = lines.groupBy("s", "h", "u").agg(F.lit(1).alias("one")).groupBy("s", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_urls)
    if not min_share:
        return often
    every = lines.groupBy("s", "u").agg(F.lit(1).alias("one")).groupBy("s").agg(F.count("*").alias("urls"))
    return often.join(every, "s").where(F.col("n") >= min_share * F.col("urls") - 1e-9).select("s", "h", "n")


def repeated_lines(records: DataFrame, min_urls: int = 5, salts: int = 8, min_share: float = 0.0) -> DataFrame:
    """(record_id BIGINT, line_no INT) of each line that its site shows under at least min_urls addresses and, where given, min_share of all its addresses, each once.

    Exact copies of a row give their lines once. Null or empty texts, blank lines and rows without a host give none.
    The lines are joined with the frequent ones on (site, line, salt): salts part the lines of a hot site, more where adaptive execution finds them skewed.
    """
    lines = hashed_lines(records)
    often = frequent(lines, min_urls, min_share).select("s", "h", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = lines.select("record_id", "line_no", "s", "h", F.pmod(F.xxhash64("record_id"), F.lit(salts)).cast("int").alias("salt"))
    return salted.join(often, ["s", "h", "salt"]).dropDuplicates(["s", "h", "salt", "record_id", "line_no"]).select("record_id", "line_no")


def without_repeated_lines(records: DataFrame, min_urls: int = 5) -> DataFrame:
    """(record_id, url, text, removed INT): each distinct row once with its text rebuilt from the lines that its site does not repeat.

    A null text stays null with removed 0; a text of nothing but repeated lines becomes the empty text.
    """
    hits = repeated_lines(records, min_urls).groupBy("record_id").agg(F.collect_set("line_no").alias("__gone"))
    rows = records.distinct().join(hits, "record_id", "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains("__gone", i + 1))
    return rows.select(
        "record_id", "url", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("int").alias("removed"),
    )
