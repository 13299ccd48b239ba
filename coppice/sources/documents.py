"""Texts to evidence units, builds of units with postings and vectors, and their reuse."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import sentences, tokens_py
from ..operators import retrieval
from ..runtime import read_text, write_text
from .binaries import Extractor, read_binaries

CONFIDENCE = 0.92
TEXT_SUFFIXES = (".txt", ".md", ".log", ".csv")
BINARY_SUFFIXES = (".pdf", ".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp")


def read_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(doc_id, text) of text files, each read whole; doc_id is the file's name without suffix. Other suffixes are refused."""
    bad = [p for p in paths if not p.lower().endswith(TEXT_SUFFIXES)]
    if bad:
        raise ValueError(f"no parser for {bad[0]}")
    rows = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("doc_id"), "text")


def sentence_units(documents: DataFrame, section: str = "body") -> DataFrame:
    """(doc_id, pos, content, section_path, char_start, char_end, confidence, source_type): each sentence with its place on a running cursor."""
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", sentences(F.col("text")).alias("ss"))
    rows = rows.withColumn("s", _starts(F.transform("ss", F.length)))
    each = rows.select("doc_id", F.posexplode(F.arrays_zip(F.col("ss").alias("c"), F.col("s"))).alias("pos", "x"))
    return each.select(
        F.col("doc_id").cast("string").alias("doc_id"), "pos", F.col("x.c").alias("content"), F.lit(section).alias("section_path"),
        F.col("x.s").alias("char_start"), (F.col("x.s") + F.length("x.c")).alias("char_end"), F.lit(CONFIDENCE).alias("confidence"), F.lit("text_sentence").alias("source_type"),
    )


@F.pandas_udf(T.ArrayType(T.LongType()))
def _starts(lengths: pd.Series) -> pd.Series:
    """Where each sentence begins on the running cursor; only the lengths travel to Python, and no array grows step by step."""
    return lengths.map(lambda n: np.concatenate([[0], np.cumsum(n.astype(np.int64) + 1)[:-1]]).astype(np.int64) if len(n) else n)


def content_key(model: str = "") -> F.Column:
    """Identity of a unit's vector: what it was made of, with the model."""
    return F.sha2(F.concat_ws("\x1f", F.lit(model), "doc_id", F.coalesce("section_path", F.lit("")), "content"), 256)


def reuse(units: DataFrame, previous: DataFrame, model: str = "") -> tuple[DataFrame, DataFrame]:
    """(kept, missing): units whose vector the previous build (key, embedding) has, with it, and those to encode."""
    keyed = units.withColumn("key", content_key(model))
    old = previous.select("key", "embedding").dropDuplicates(["key"])
    return keyed.join(old, "key"), keyed.join(old, "key", "left_anti")


def build_id(corpus: str, parser: str, model: str) -> str:
    return hashlib.sha256("|".join((corpus, parser, model)).encode()).hexdigest()[:16]


def save_index(units: DataFrame, out: str) -> None:
    """Postings, frequencies and statistics of units with a shard_id, partitioned by shard; postings sorted by term, so that a query reads the row groups of its terms."""
    retrieval.postings(units).repartition("shard_id", "term").sortWithinPartitions("shard_id", "term").write.mode("overwrite").partitionBy("shard_id").parquet(f"{out}/postings")
    post = units.sparkSession.read.parquet(f"{out}/postings")
    post.groupBy("shard_id", "term").agg(F.count("*").alias("df")).sortWithinPartitions("shard_id", "term").write.mode("overwrite").partitionBy("shard_id").parquet(f"{out}/terms")
    retrieval.corpus_stats(units).coalesce(1).write.mode("overwrite").parquet(f"{out}/stats")


def load_index(spark: SparkSession, out: str) -> retrieval.Index:
    return retrieval.Index(*(spark.read.parquet(f"{out}/{t}") for t in ("postings", "terms", "stats")))


def digests(spark: SparkSession, out: str, names: list[str]) -> dict[str, str]:
    """SHA-256 of each artefact: of the sorted digests of its part files, taken in tasks."""
    got = {}
    for n in names:
        parts = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(f"{out}/{n}").select(F.sha2("content", 256).alias("h"))
        got[n] = parts.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h")).first().h  # one digest a file
    return got


def write_build(units: DataFrame, out: str, *, corpus: str, parser: str = "1", model: str = "none", shards: int = 1, encoder: Encoder | None = None, previous: str | None = None) -> dict:
    """Writes units, index and, with an encoder, vectors, partitioned by shard, and a manifest with digests; an empty corpus is refused.

    previous: an earlier build of the same model, whose vectors are used again for units that it had; only the others are encoded.
    """
    if units.isEmpty():
        raise ValueError("no evidence units to build from")
    spark = units.sparkSession
    parts = retrieval.with_shard(units, shards)
    parts.write.mode("overwrite").partitionBy("shard_id").parquet(f"{out}/units")
    parts = spark.read.parquet(f"{out}/units")
    save_index(parts, out)
    names, reused = ["units", "postings", "terms", "stats"], 0
    if encoder is not None:
        old = spark.read.parquet(f"{previous}/vectors") if previous and json.loads(read_text(spark, f"{previous}/manifest.json"))["model"] == model else None
        kept, missing = reuse(parts, old, model) if old is not None else (None, parts.withColumn("key", content_key(model)))
        columns = ["unit_ix", "shard_id", "key", "embedding"]
        fresh = encode(missing, encoder).select(*columns)
        reused = kept.count() if kept is not None else 0
        (fresh if kept is None else fresh.unionByName(kept.select(*columns))).write.mode("overwrite").partitionBy("shard_id").parquet(f"{out}/vectors")
        names.append("vectors")
    manifest = {"build_id": build_id(corpus, parser, model), "corpus": corpus, "parser": parser, "model": model, "shards": shards, "units": parts.count(), "reused_vectors": reused, "sha256": digests(spark, out, names)}
    write_text(spark, f"{out}/manifest.json", json.dumps(manifest, indent=1))
    return manifest


def load_build(spark: SparkSession, path: str) -> tuple[DataFrame, retrieval.Index, dict]:
    return spark.read.parquet(f"{path}/units"), load_index(spark, path), json.loads(read_text(spark, f"{path}/manifest.json"))


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/vectors").select("unit_ix", "embedding")


class Encoder(Protocol):
    def encode(self, texts: list[str], query: bool = False) -> list[list[float]]: ...


class HashEncoder:
    """Deterministic stand-in for a model: each token of a text adds a sign to one of `dim` places; unit length, the zero vector for no tokens."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str], query: bool = False) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dim)
            for w in tokens_py(t):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.dim] += 1 if h >> 63 else -1
            out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
        return out


def encode(units: DataFrame, encoder: Encoder) -> DataFrame:
    """units with an embedding of their content, made batch by batch in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = encoder.encode([t or "" for t in b.column(b.schema.get_field_index("content")).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.float32()))], names=[*b.schema.names, "embedding"])

    units = units.drop("embedding")
    return units.mapInArrow(run, T.StructType([*units.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def parse_documents(spark: SparkSession, paths: list[str], extractor: Extractor | None = None) -> DataFrame:
    """Units of all files by their kind, with spans on one running offset a document: texts by sentences, other files by the extractor. Without one other files are refused."""
    texts = [p for p in paths if p.lower().endswith(TEXT_SUFFIXES)]
    rest = [p for p in paths if p not in texts]
    if rest and (extractor is None or not all(p.lower().endswith(BINARY_SUFFIXES) for p in rest)):
        raise ValueError(f"no parser for {rest[0]}")
    columns = ["doc_id", "pos", "source_type", "content", "section_path", "confidence"]
    parts = ([sentence_units(read_texts(spark, texts)).select(*columns)] if texts else []) + ([read_binaries(spark, rest, extractor).select(*columns)] if rest else [])
    if not parts:
        raise ValueError("no files")
    rows = running_spans(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
    return rows.select(F.xxhash64("doc_id", "pos", "content").alias("unit_ix"), "doc_id", "source_type", "content", "section_path", F.col("char_start").cast("bigint").alias("char_start"), F.col("char_end").cast("bigint").alias("char_end"), F.lit(None).cast("string").alias("timestamp"), "confidence", F.lit(None).cast("string").alias("canonical_entity_id"))


def build_documents(spark: SparkSession, paths: list[str], out: str, *, extractor: Extractor | None = None, **options) -> dict:
    """Files to a build in one call."""
    return write_build(parse_documents(spark, paths, extractor), out, corpus="|".join(sorted(paths)), **options)


def running_spans(rows: DataFrame) -> DataFrame:
    """Spans by a window over (doc_id, pos), for units that come as rows rather than as one text."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("content") + 1).over(w), F.lit(0))
    return rows.withColumn("char_start", start).withColumn("char_end", start + F.length("content"))
