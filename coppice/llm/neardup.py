"""Near-duplicate records: all pairs whose word-shingle sets have a Jaccard similarity of at least a threshold.

Fingerprint: each shingle flips one of 128 bits, so the Hamming distance of two fingerprints never exceeds the
symmetric difference of the sets. |A xor B| <= (1-t)/(1+t) (|A|+|B|) for a pair in scope, hence a Hamming ball of that radius
around a fingerprint holds all its partners. Distances between unrelated fingerprints concentrate, so one tree over a
whole corpus would prune nothing; the corpus is first cut into shards by prefix filtering (a pair in scope shares one of the
first |A| - ceil(t |A|) + 1 shingles in any common order; the order is by corpus counts, rare ones first), and each shard is searched by
a vantage-point tree: shells around vantage points, branches pruned by the triangle inequality, shell overlaps joined
across. Candidates are then verified on the sets themselves, so the result is exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

WORD = re.compile("[0-9a-z가-힣]+")
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values): the sorted distinct shingle hashes of each text, one after the other."""
    seen: dict[str, int] = {}
    words: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            found = WORD.findall(t.lower())
            counts[i] = len(found)
            for w in found:
                h = seen.get(w)
                if h is None:
                    h = seen[w] = xxhash.xxh64_intdigest(w)
                words.append(h)
    w = np.array(words, np.uint64)
    n = np.maximum(counts - width + 1, 0)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.repeat(starts, n) + np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    h = np.zeros(len(owner), np.uint64)
    for k in range(width):
        h = _mix(h * _M1 + w[at + k] + np.uint64(k)) if len(owner) else h
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    owner, h = owner[keep], h[keep]
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]), h


def folded(v: np.ndarray, owner: np.ndarray, n: int, width: int, low: int) -> np.ndarray:
    """Parity fingerprints of 2^width bits: the shingle v flips the bit that its hash bits from `low` on name."""
    bits = np.bincount(owner * (1 << width) + ((v >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64), minlength=n << width)
    return np.packbits((bits & 1).astype(np.uint8).reshape(n, 1 << width), axis=1).view(np.int64)


def _shingle_udf(width: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, val = shingle_sets(b.column(1).to_pylist(), width)
            size = np.diff(off)
            ok = size >= least
            take = np.repeat(ok, size)
            ids = b.column(0).filter(pa.array(ok))
            v = val[take]
            o = np.concatenate([[0], np.cumsum(size[ok])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(o), pa.array(v.view(np.int64)))
            keys = [xxhash.xxh3_128_digest(v[o[i] : o[i + 1]].tobytes()) for i in range(len(o) - 1)]
            g = folded(v, np.repeat(np.arange(len(o) - 1), size[ok]), len(o) - 1, 8, 49)
            yield pa.RecordBatch.from_arrays([ids, lists, pa.array(keys, pa.binary()), *(pa.array(g[:, k]) for k in range(4))], names=["id", "sh", "key", "g0", "g1", "g2", "g3"])

    return run


def shingled(df: DataFrame, key: str, text: str, width: int, least: int) -> DataFrame:
    """(id, sh, key, g0 to g3): rows with at least `least` distinct shingles; key identifies equal sets, g is a fingerprint of 256 bits."""
    return df.select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(_shingle_udf(width, least), "id bigint, sh array<bigint>, key binary, g0 bigint, g1 bigint, g2 bigint, g3 bigint")


def _count_udf(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            v = b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            total += np.bincount((v % np.uint64(buckets)).astype(np.int64), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return run


def _shard_udf(rank, threshold: float, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, hot_tokens, hot_counts = rank.value
        nb = np.uint64(len(counts))
        for b in batches:
            ids = b.column(0).to_numpy()
            sh = b.column(1)
            off = sh.offsets.to_numpy().astype(np.int64)
            v = sh.values.to_numpy()[off[0] : off[-1]].view(np.uint64)
            off = off - off[0]
            size = np.diff(off)
            owner = np.repeat(np.arange(len(ids)), size)
            fp = folded(v, owner, len(ids), 7, 57)
            c = counts[(v % nb).astype(np.int64)]
            order = np.lexsort((v, c, owner))
            pos = np.arange(len(v)) - np.repeat(off[:-1], size)
            prefix = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
            first = pos < np.repeat(prefix, size)
            at = order[first]
            o, tok = owner[at], v[at].view(np.int64)
            blocks = np.ones(len(tok), np.int64)
            if len(hot_tokens):
                place = np.minimum(np.searchsorted(hot_tokens, tok), len(hot_tokens) - 1)
                own_count = np.where(hot_tokens[place] == tok, hot_counts[place], 1)
                blocks = -(-own_count // hot)
            x = np.zeros(len(o), np.int32)
            y = np.zeros(len(o), np.int32)
            many = blocks > 1
            if many.any():  # a hot token: its rows meet block by block, each pair of blocks once
                o2, tok2, n2 = o[many], tok[many], blocks[many]
                own = (_mix(ids[o2].view(np.uint64)) % n2.astype(np.uint64)).astype(np.int64)
                r = np.repeat(np.arange(len(o2)), n2)
                other = np.arange(len(r)) - np.repeat(np.concatenate([[0], np.cumsum(n2)[:-1]]), n2)
                o = np.concatenate([o[~many], o2[r]])
                tok = np.concatenate([tok[~many], tok2[r]])
                x = np.concatenate([x[~many], np.minimum(own[r], other).astype(np.int32)])
                y = np.concatenate([y[~many], np.maximum(own[r], other).astype(np.int32)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(tok), pa.array(x), pa.array(y), pa.array(ids[o]), pa.array(size[o].astype(np.int32)), pa.array(fp[o, 0]), pa.array(fp[o, 1])],
                names=["token", "x", "y", "id", "size", "f0", "f1"],
            )

    return run


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1).astype(np.int32)


class VantageTree:
    """All pairs of a shard whose Hamming distance is at most allow * (size_a + size_b).

    A node halves its points by their distance from a vantage point; pairs across the halves need both points within
    the radius of the dividing shell, so only those are joined across, again around vantage points.
    """

    def __init__(self, fp: np.ndarray, size: np.ndarray, allow: float, leaf: int = 48):
        self.fp, self.size, self.allow, self.leaf = fp, size, allow, leaf
        self.radius = allow * 2 * float(size.max(initial=0))
        self.out: list[tuple[np.ndarray, np.ndarray]] = []

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        stack: list[tuple[np.ndarray, np.ndarray | None]] = [(np.arange(len(self.fp)), None)]
        while stack:
            a, b = stack.pop()
            if b is None:
                self._within(a, stack)
            elif len(a) and len(b):
                self._across(a, b, stack)
        if not self.out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in self.out]), np.concatenate([y for _, y in self.out])

    def _keep(self, i: np.ndarray, j: np.ndarray) -> None:
        # sizes first: the smaller set of a pair in scope can't be too small
        ok = hamming(self.fp[i], self.fp[j]) <= self.allow * (self.size[i] + self.size[j]) + 1e-9
        if ok.any():
            self.out.append((i[ok], j[ok]))

    def _within(self, a: np.ndarray, stack: list) -> None:
        if len(a) <= self.leaf:
            i, j = np.triu_indices(len(a), 1)
            self._keep(a[i], a[j])
            return
        v, rest = a[0], a[1:]
        d = hamming(self.fp[rest], self.fp[v])
        self._keep(np.full(len(rest), v), rest)
        mu = np.median(d)
        inner = d <= mu
        if inner.all():
            inner = d < mu
        if not inner.any() or inner.all():  # all at one distance: no shell divides them
            half = len(rest) // 2
            stack += [(rest[:half], None), (rest[half:], None), (rest[:half], rest[half:])]
            return
        stack += [(rest[inner], None), (rest[~inner], None)]
        stack.append((rest[inner & (d >= mu - self.radius)], rest[~inner & (d <= mu + self.radius)]))

    def _across(self, a: np.ndarray, b: np.ndarray, stack: list) -> None:
        if len(a) * len(b) <= self.leaf * self.leaf * 4:
            self._keep(np.repeat(a, len(b)), np.tile(b, len(a)))
            return
        if len(a) < len(b):
            a, b = b, a
        v = a[len(a) // 2]
        da, db = hamming(self.fp[a], self.fp[v]), hamming(self.fp[b], self.fp[v])
        mu = np.median(da)
        inner = da <= mu
        if inner.all() or not inner.any():
            half = len(a) // 2
            stack += [(a[:half], b), (a[half:], b)]
            return
        stack.append((a[inner], b[db <= mu + self.radius]))
        stack.append((a[~inner], b[db >= mu - self.radius]))


def _search_udf(allow: float):
    def group(ids, x, y, size, fp) -> tuple[np.ndarray, np.ndarray]:
        i, j = VantageTree(fp, size, allow).pairs()
        return ids[i], ids[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def solve(cols: list[np.ndarray]) -> pa.RecordBatch | None:
            tok, x, y, ids, size, f0, f1 = cols
            fp = np.stack([f0, f1], axis=1).view(np.uint64)
            start = np.flatnonzero(np.concatenate([[True], (tok[1:] != tok[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
            n = np.diff(np.concatenate([start, [len(tok)]]))
            left, right = [], []
            small = n <= 48
            member = np.repeat(small, n)
            last = np.repeat(start + n, n)
            at = np.flatnonzero(member)
            for k in range(1, 48):  # shards of one leaf, all at once
                at = at[at + k < last[at]]
                if not len(at):
                    break
                ok = hamming(fp[at], fp[at + k]) <= allow * (size[at] + size[at + k]) + 1e-9
                left.append(ids[at[ok]])
                right.append(ids[at[ok] + k])
            for g in np.flatnonzero(~small):
                s = slice(start[g], start[g] + n[g])
                i, j = group(ids[s], x[s], y[s], size[s], fp[s])
                left.append(i)
                right.append(j)
            a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (left, right))
            if not len(a):
                return None
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            pair = pair[pair[:, 0] != pair[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if not len(cols[0]):
                continue
            tok, x, y = cols[:3]
            change = np.flatnonzero((tok[1:] != tok[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            if held and (len(change) == 0):
                held.append(cols)
                continue
            cutoff = int(change[-1]) if len(change) else 0
            if cutoff or held:
                head = [c[:cutoff] for c in cols]
                parts = [*held, head] if held else [head]
                r = solve([np.concatenate([p[i] for p in parts]) for i in range(7)])
                if r is not None:
                    yield r
            held = [[c[cutoff:] for c in cols]]
        if held:
            r = solve([np.concatenate([p[i] for p in held]) for i in range(7)])
            if r is not None:
                yield r

    return run


def class_pairs(sets: DataFrame, threshold: float, buckets: int | None, hot: int) -> DataFrame:
    """(a, b), a < b: pairs of rows of sets (id, sh; no two sets equal) with Jaccard similarity >= threshold, each once.

    A token counts as hot when it is frequent itself: the tokens of buckets over `hot` are counted one by one, so that a bucket that is full
    of rare tokens parts nobody's rows into blocks.
    """
    spark = sets.sparkSession
    if buckets is None:
        total = sets.agg(F.coalesce(F.sum(F.size("sh")), F.lit(0)).alias("n")).first().n
        buckets = min(1 << 24, max(1 << 16, total // 256))
    buckets = 1 << max(buckets - 1, 1).bit_length()  # a power of two
    counts = np.zeros(buckets, np.int64)
    for r in sets.select("sh").mapInArrow(_count_udf(buckets), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.bucket] = r.n  # at most `buckets` rows, whatever the corpus
    full = np.flatnonzero(counts > hot)
    tokens: dict[int, int] = {}
    if len(full):  # a token over hot fills its bucket, so there are at most (all shingles) / hot of them
        wanted = spark.createDataFrame([(int(x),) for x in full], "bucket bigint")
        wanted = F.broadcast(wanted) if len(full) <= 1_000_000 else wanted  # the shingles need not be shuffled to meet them
        each = sets.select(F.explode("sh").alias("t")).withColumn("bucket", F.col("t").bitwiseAND(F.lit(buckets - 1)))
        tokens = {r.t: r.n for r in each.join(wanted, "bucket", "left_semi").groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") > hot).collect()}
    rank = spark.sparkContext.broadcast((counts.astype(np.int32 if counts.max(initial=0) < 1 << 31 else np.int64), np.array(sorted(tokens), np.int64), np.array([tokens[t] for t in sorted(tokens)], np.int64)))
    shards = sets.select("id", "sh").mapInArrow(_shard_udf(rank, threshold, hot), "token bigint, x int, y int, id bigint, size int, f0 bigint, f1 bigint")
    by = shards.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y")
    allow = (1 - threshold) / (1 + threshold)
    candidates = by.mapInArrow(_search_udf(allow), "a bigint, b bigint").distinct()
    # the longer fingerprints first, so that few sets travel; sets are compared by 32 bits of each shingle
    side = lambda k, *more: sets.select(F.col("id").alias(k), F.size("sh").alias(f"n{k}"), *[F.col(f"g{i}").alias(f"{k}{i}") for i in range(4)], *more)
    short = F.transform("sh", lambda x: F.shiftright(x, 32).cast("int"))
    near = candidates.join(side("a"), "a").join(side("b", short.alias("sb")), "b")
    apart = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(1, 4)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
    near = near.where(apart <= allow * (F.col("na") + F.col("nb")) + 1e-9).select("a", "b", "na", "nb", "sb")
    both = near.join(sets.select(F.col("id").alias("a"), short.alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= threshold * (F.col("na") + F.col("nb") - common) - 1e-9).select("a", "b")


def near_duplicates(df: DataFrame, key: str, text: str, *, width: int = 5, threshold: float = 0.8, least: int = 1, buckets: int | None = None, hot: int = 20000) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (id, class_id) of every row in scope, pairs (a, b) of class ids whose sets are similar.

    A class is the rows with one and the same set, named by its least id; rows repeated with one id count once. Rows with a
    null text, no words or fewer than `least` shingles are out of scope. buckets: counters that order the shingles; by default as many as keep
    their mean count at 256, from 65,536 to 16,777,216, so that the order stays one of rarity as the collection grows.
    """
    rows = shingled(df, key, text, width, least)
    payload = F.struct("sh", "g0", "g1", "g2", "g3")
    one = cut(rows.groupBy("key").agg(F.min("id").alias("id"), F.first(payload).alias("p")).select("key", "id", "p.*"))
    members = rows.select("id", "key").distinct().join(one.select("key", F.col("id").alias("class_id")), "key").select("id", "class_id")
    return members, class_pairs(one.drop("key"), threshold, buckets, hot)


def record_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(record_a, record_b): the pairs between members of similar classes and within classes, record_a < record_b."""
    m = lambda a, b: members.select(F.col("id").alias(a), F.col("class_id").alias(b))
    across = pairs.join(m("i", "a"), "a").join(m("j", "b"), "b").select("i", "j")
    within = m("i", "c").join(m("j", "c"), "c").where(F.col("i") < F.col("j")).select("i", "j")
    return across.unionByName(within).select(F.least("i", "j").alias("record_a"), F.greatest("i", "j").alias("record_b"))


def components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, root): for each id in pairs (a, b) the least id of its component, by alternating large and small stars.

    Edges stay pairs of ids; a round joins each with the least neighbour, found by a map-side aggregation, and its result is
    checkpointed in the shared folder. Rounds end when no edge changes, after about log^2 of the largest component; edges not settled by most_rounds are an error.
    """

    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small(e: DataFrame) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()

    edges = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct())
    mark = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.shiftright(F.xxhash64("u", "v"), 24)), F.lit(0))).first())
    before = mark(edges)
    for _ in range(most_rounds):
        edges = cut(small(large(edges)))
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("root"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)


def groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(record_id, group_id, links BIGINT) of every record in scope: the least class id of its component and how many records it is similar to."""
    pairs = cut(pairs)
    sizes = members.groupBy("class_id").agg(F.count("*").alias("size"))
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = ends.join(sizes.withColumnRenamed("class_id", "b"), "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("size").alias("others"))
    rows = members.join(sizes, "class_id").join(others, "class_id", "left").join(components(pairs).withColumnRenamed("id", "class_id"), "class_id", "left")
    return rows.select(F.col("id").alias("record_id"), F.coalesce("root", "class_id").alias("group_id"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
