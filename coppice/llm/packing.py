"""Documents packed into containers of fixed token capacity, balanced by their estimated attention cost."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .tokenizer import DEFAULT_VOCABULARY, count_tokens


def balance(sizes: np.ndarray, capacity: int, quadratic: float, tail: float = 0.25) -> np.ndarray:
    """Container of each item: in descending size each goes to the cheapest container with room, the cost of an item being n + quadratic n^2.

    There are as many containers as the total needs at least; what fits nowhere opens further ones. The smallest items,
    with the share `tail` of the tokens, close the gaps: each goes to the tightest room that holds it.
    Ties go to the first item and the first container. Sizes must not exceed the capacity.
    """
    order = np.argsort(-sizes, kind="stable")
    k = max(1, -(-int(sizes.sum()) // capacity)) if len(sizes) else 0
    room, cost = np.full(k, capacity, np.int64), np.zeros(k)
    out = np.zeros(len(sizes), np.int64)
    done, bulk = 0, (1 - tail) * float(sizes.sum())
    for i in order:
        n = int(sizes[i])
        done += n
        at = int(np.argmin(np.where(room >= n, cost if done <= bulk else room, np.inf)))
        if room[at] < n:  # no room anywhere
            at = len(room)
            room, cost = np.append(room, capacity), np.append(cost, 0.0)
        out[i] = at
        room[at] -= n
        cost[at] += n + quadratic * n * n
    return out


def pack_documents(df: DataFrame, *, capacity: int = 2048, shard_tokens: int = 4_000_000, shard_items: int = 40_000, quadratic: float = 1 / 4096, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, piece_no INT, token_start BIGINT, n_tokens BIGINT, container_id BIGINT) with every row of df.

    A text is one piece unless it alone exceeds the capacity; then it is cut into full pieces and a rest. Empty and null
    texts are pieces of 0 tokens. Rows repeated with one doc_id are packed each. The pieces are dealt by hash to shards of
    at most about shard_tokens tokens and shard_items pieces, packed each in one task: no task grows with the corpus.
    """
    counted = cut(count_tokens(df, path=path))
    pieces = counted.select(
        "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / capacity) - 1, F.lit(0)).cast("int"))).alias("piece_no")
    ).select("doc_id", "piece_no", (F.col("piece_no").cast("bigint") * capacity).alias("token_start"), F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - F.col("piece_no").cast("bigint") * capacity).alias("n_tokens"))
    total = pieces.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    shards = max(1, -(-total.t // shard_tokens), -(-total.n // shard_items))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece_no"], kind="stable").reset_index(drop=True)
        at = balance(pdf.n_tokens.to_numpy(), capacity, quadratic)
        return pdf.assign(container_id=pdf.shard.to_numpy().astype(np.int64) * (1 << 32) + at).drop(columns="shard")

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(shards)).cast("bigint"))
    return dealt.groupBy("shard").applyInPandas(pack, "doc_id bigint, piece_no int, token_start bigint, n_tokens bigint, container_id bigint")
