"""Text of scanned pages: broken words, misread characters, running heads and page numbers, found and repaired.

A vocabulary of trusted words (words of the other units, counted over all of them) is kept as a trie. A word of a scanned
page that the vocabulary lacks is looked up by the intersection of the trie with a Levenshtein automaton, which reads
the word and the trie side by side and lists every entry within the bound: confusions, characters that scanners take for one another (also
one for two, rn for m), are cheap edits, any other edit is a dear one, and both may stand in one word. All candidates are ranked by
weighted edits, by how often the neighbouring words stand beside them and by frequency; a candidate behind a dear edit must outweigh the
chance that the word is one of its own. Heads are lines at a page's edge that come again on other pages of the document, or
whose word pairs are those of such lines. Repair drops the page furniture, joins broken words, replaces misread ones and reflows.

The most frequent words and pairs are broadcast, up to max_words and max_pairs; that is a cache. Where there are more, the words of scanned
pages that the cache lacks are looked up in the full tables by joins, against tries of the vocabulary's blocks.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

WORD = re.compile(r"[^\W_]+")
MARKS = "-‐‑¬=­"
BROKEN = re.compile(rf"[^\W\d_][{MARKS}]\s*$")
# What scanners read -> what may have stood there.
CONFUSIONS = {
    "0": ["o"], "1": ["l", "i"], "5": ["s"], "9": ["g"], "6": ["b"], "8": ["b"], "@": ["a"], "$": ["s"], "3": ["e"], "|": ["l", "i"],
    "c": ["e"], "e": ["c"], "l": ["i", "t"], "i": ["l"], "f": ["t"], "t": ["f"], "b": ["h"], "h": ["b"], "v": ["y"], "u": ["v"], "o": ["a"],
    "ri": ["n"], "rn": ["m"], "m": ["in", "rn"], "ii": ["u"], "cl": ["d"], "d": ["cl"], "vv": ["w"], "li": ["h"], "n": ["ri"],
    "디": ["다"], "익": ["의"], "기": ["가"], "븐": ["은"], "룰": ["를"], "듬": ["등"], "율": ["을"], "논": ["는"], "머": ["어"], "힌": ["한"], "지": ["자"], "뭐": ["위"],
}
PAGE_NUMBER = re.compile(r"^[\s\W]*(?:(?:p|pp|pg|page|seite|쪽|페이지)\.?\s*)?(?:[0-9lIOo|SB]{1,5}|[ivxlcdm]{1,9}|[IVXLCDM]{1,9})(?:\s*(?:쪽|페이지|면))?(?:\s*(?:of|/|von|중)\s*[0-9lIOo|SB]{1,5})?[\s\W]*$", re.IGNORECASE)


def is_page_number(line: str) -> bool:
    """Whether a line at a page's edge is only a page number; letters alone must be Roman numerals or read as digits."""
    s = line.strip()
    if not s or len(s) > 24 or not PAGE_NUMBER.match(s) or re.search(r"\d[.,]\d", s):
        return False
    core = re.sub(r"(?i)\b(?:pp?|pg|page|of|seite)\b\.?", " ", s)
    letters = re.sub(r"[^A-Za-z]", "", core)
    if not letters or re.search(r"\d", core):
        return True
    return bool(re.fullmatch(r"[lIOo|]+", letters)) and len(letters) >= 1 or bool(re.fullmatch(r"(?i)m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})", letters))


_BACKWARDS = {k[::-1]: [x[::-1] for x in v] for k, v in CONFUSIONS.items()}


class Trie:
    """Vocabulary trie, read forwards and backwards, and its intersection with the Levenshtein automaton of a word."""

    END = "\0"

    def __init__(self, words: Iterable[str]):
        self.root: dict = {}
        self.tail: dict = {}
        for w in words:
            for node, part in ((self.root, w), (self.tail, w[::-1])):
                for ch in part:
                    node = node.setdefault(ch, {})
                node[self.END] = w

    def within(self, word: str, cheap: int = 2, dear: int = 1) -> dict[str, tuple[int, int]]:
        """Every entry within `cheap` confusions, or `dear` (0 or 1) other edits and one confusion less: {entry: (dear, cheap)}, with the fewest dear ones.

        A dear edit is looked for in one half of the word only, after the other half was read: forwards in the second half, backwards
        in the first, so that the automaton branches where few entries are left.
        """
        out: dict[str, tuple[int, int]] = {}
        half = len(word) // 2
        self._walk(self.root, word, CONFUSIONS, cheap, dear, half, out)
        if dear:
            self._walk(self.tail, word[::-1], _BACKWARDS, cheap, dear, len(word) - half, out)
        return out

    def _walk(self, root: dict, word: str, confusions: dict, cheap: int, dear: int, first: int, out: dict) -> None:
        """Dear edits only at `first` and behind it."""
        seen: set[tuple[int, int, int, int]] = set()
        n, end = len(word), self.END
        stack = [(root, 0, 0, 0)]
        while stack:
            node, at, c, d = stack.pop()
            if c or d:
                state = (id(node), at, c, d)
                if state in seen:
                    continue
                seen.add(state)
            if at == n and (w := node.get(end)) is not None and (w not in out or (d, c) < out[w]):
                out[w] = (d, c)
            if at < n and (nxt := node.get(word[at])) is not None:
                stack.append((nxt, at + 1, c, d))
            if at < n and c + d < cheap:
                for k in (1, 2):
                    for to in confusions.get(word[at : at + k], ()) if at + k <= n else ():
                        nxt = node
                        for ch in to:
                            nxt = nxt.get(ch) if nxt is not None else None
                        if nxt is not None:
                            stack.append((nxt, at + k, c + 1, d))
            if d < dear and at >= first and c + d <= max(cheap - 1, 0):
                if at < n:
                    stack.append((node, at + 1, c, d + 1))
                for ch, nxt in node.items():
                    if ch != end:
                        stack.append((nxt, at, c, d + 1))
                        if at < n and ch != word[at]:
                            stack.append((nxt, at + 1, c, d + 1))


def candidates(trie: Trie, word: str) -> list[tuple[str, int, int]]:
    """(entry, dear, cheap) of a word in lower case: two confusions, one in short words; a dear edit from four characters on."""
    return [(w, d, c) for w, (d, c) in trie.within(word, cheap=2 if len(word) >= 5 else 1, dear=0 if len(word) < 4 else 1).items()]


class Reader:
    """Judges the words of a page. counts: trusted words in lower case; pairs: counts of hashed neighbouring words; total: all trusted words.

    page() adds what the full tables know of one page's words beyond these.
    """

    def __init__(self, counts: dict[str, int], pairs: dict[int, int], total: int):
        self.counts, self.pairs, self.total, self.trie = counts, pairs, total, Trie(counts)
        self.lookup = lru_cache(maxsize=200_000)(lambda word: candidates(self.trie, word))
        self.memo: dict[str, tuple[str, ...]] = {}
        self.page((), ())

    def page(self, words: Iterable[dict], pairs: Iterable[dict]) -> Reader:
        """words: {token, n, found: [{w, n, d, c}]}, n null for a word that no table has; pairs: {x, n}."""
        self.more = {r["token"]: r["n"] for r in words if r["n"] is not None}
        self.found = {r["token"]: r["found"] or () for r in words if r["n"] is None}
        self.beside = {r["x"]: r["n"] for r in pairs}
        return self

    def __contains__(self, word: str) -> bool:
        return word in self.counts or word in self.more

    def known(self, token: str) -> bool:
        return all(p in self for p in WORD.findall(token.lower()))

    def unknown(self, plain: str) -> tuple[str, ...]:
        """The parts of a written word, divided at hyphens and the like, that the vocabulary lacks."""
        got = self.memo.get(plain)
        if got is None:
            core = core_of(plain)
            cached = lambda t: all(p in self.counts for p in WORD.findall(t.lower()))
            got = () if not _LETTERED.search(core) or cached(core) else tuple(p for p in _JOINT.split(core) if len(p) >= 2 and _LETTERED.search(p) and not cached(p))
            if len(self.memo) > 500_000:
                self.memo.clear()
            self.memo[plain] = got
        return tuple(p for p in got if not self.known(p)) if got and self.more else got

    def options(self, word: str) -> list[tuple[str, int, int, int]]:
        """(entry, dear, cheap, count) of a word in lower case, from the cache and the full table."""
        return [(w, d, c, self.counts[w]) for w, d, c in self.lookup(word)] + [(r["w"], r["d"], r["c"], r["n"]) for r in self.found.get(word, ())]

    def correct(self, token: str, before: str, after: str) -> str | None:
        """The word that a misread token stands for; None for a word that is none.

        A confusion costs 4, a substitution 6, a missing or added character 9 and one in the last syllable of a Korean word, which may be
        another ending, 3 more. A candidate with a dear edit needs frequency and neighbours, in parts per million of all words, that outweigh its edits,
        where neighbours count less the six meetings that any two words may have by chance; one that is only longer or
        shorter, as other forms of a word are, needs a neighbour.
        """
        word = token.lower()
        best: tuple[float, str] | None = None
        for w, d, c, n in self.options(word):
            x, y = pair(before, w), pair(w, after)
            beside = self.pairs.get(x, 0) + self.pairs.get(y, 0) + self.beside.get(x, 0) + self.beside.get(y, 0)
            cost = 4.0 * c
            if d:
                swapped = c > 0 or len(w) == len(word)
                cost += (6 if swapped else 9) + 3 * (word[-1] >= "가" and w[-1] != word[-1])
                scale = 1e6 / self.total
                sure = max(beside - 6, 0)
                if not swapped and not beside or math.log1p(n * scale) + 2 * math.log1p(sure * scale) < cost - 2.5:
                    continue
            rank = (math.log1p(n) + 2 * math.log1p(beside) - cost, w)
            if best is None or rank > best:
                best = rank
        return best[1] if best else None


_LETTERED, _JOINT = re.compile(r"[^\W\d_]"), re.compile(r"[-–—'/]")


def core_of(plain: str) -> str:
    return re.sub(r"^[0-9][0-9.,]*(?=[가-힣])", "", plain).strip("-–—'")


_K1, _K2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_hash = lru_cache(maxsize=200_000)(xxhash.xxh64_intdigest)


def pair(a: str, b: str) -> int:
    """63 bits of two neighbouring words."""
    return ((_hash(a) * _K1 + _hash(b) * _K2) & 0xFFFFFFFFFFFFFFFF) >> 1


_DIGIT = str.maketrans("0159@|", "olsgal")


def flat(line: str) -> str:
    """Letters of a line in lower case, characters often taken for one another made equal."""
    s = line.lower().replace("rn", "m").replace("cl", "d").replace("ri", "n").replace("ii", "u").translate(_DIGIT)
    return re.sub(r"[^a-z가-힣]", "", s).translate(str.maketrans("ifecbh", "lteehh"))


def edge_lines(lines: list[str]) -> list[tuple[int, bool]]:
    """(index, at the very edge) of the lines where a head may stand: the first two and the last two that are no page numbers."""
    full = [i for i, l in enumerate(lines) if l.strip()]
    text = [i for i in full if not (i in full[:1] + full[-1:] and is_page_number(lines[i]))]
    out = {i: False for i in text[1:2] + text[-2:-1]}
    return sorted((out | {i: True for i in text[:1] + text[-1:]}).items())


def head_keys(line: str) -> list[int]:
    s = flat(line)
    if len(s) < 8:
        return []
    parts = {s[:14], s[-14:], s[len(s) // 2 - 7 : len(s) // 2 + 7]} if len(s) >= 24 else {s[:10], s[-10:]}
    return [xxhash.xxh64_intdigest(p) >> 1 for p in parts]


def shape_words(line: str, known) -> list[int]:
    """Hashed pairs of neighbouring words of a line, its ends marked, words that are names as one sign."""
    ws = ["^", *(w if w in known else "*" for w in WORD.findall(line.lower()) if not w.isdigit()), "$"]
    return [xxhash.xxh64_intdigest(f"{a}|{b}") >> 1 for a, b in zip(ws, ws[1:])]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, x, n): words, and pairs as hashes with a null word, counted in parts."""
    ids: dict[str, int] = {}
    parts: list[np.ndarray] = []
    held = 0

    def out() -> pa.RecordBatch:
        every = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        names = list(ids)
        n = np.bincount(every, minlength=len(names) + 1)[1:]
        words = [i for i, w in enumerate(names) if not w[0].isdigit()]
        h = np.array([0, *map(xxhash.xxh64_intdigest, names)], np.uint64)
        code = every[:-1] << 32 | every[1:]
        code, k = np.unique(code[(every[:-1] > 0) & (every[1:] > 0)], return_counts=True)
        x = (h[code >> 32] * np.uint64(_K1) + h[code & 0xFFFFFFFF] * np.uint64(_K2)) >> np.uint64(1)
        w = pa.array([names[i] for i in words] + [None] * len(code), pa.string())
        return pa.RecordBatch.from_arrays([w, pa.array(np.concatenate([np.zeros(len(words), np.int64), x.view(np.int64)])), pa.array(np.concatenate([n[words], k]).astype(np.int64))], names=["w", "x", "n"])

    for b in batches:
        for t in b.column(0).to_pylist():
            ws = WORD.findall(t.lower())
            for w in ws:
                if w not in ids:
                    ids[w] = len(ids) + 1
            parts.append(np.array([0, *map(ids.__getitem__, ws)], np.int64))  # 0 parts the texts
            held += len(ws)
            if held > 4_000_000:
                yield out()
                ids.clear()
                parts.clear()
                held = 0
    if parts:
        yield out()


class Vocabulary:
    """Trusted words and pairs. words, pairs: the broadcast cache; other_words (w, n) and other_pairs (x, n): the rest as tables, None where all fit."""

    def __init__(self, trusted: DataFrame, *, min_count: int, max_words: int, max_pairs: int):
        """Counted over all trusted texts: words seen min_count times, and every pair. The frequency levels that fit the bounds are cached."""
        counted = trusted.mapInArrow(_count_words, "w string, x bigint, n bigint").groupBy("w", "x").agg(F.sum("n").alias("n")).withColumn("two", F.col("w").isNull())
        counted = cut(counted.withColumn("level", F.when(F.col("two") | (F.col("n") >= min_count), F.floor(F.log2("n") * 8)).cast("int")))  # no level: counts in the total only
        levels: dict[bool, dict[int, int]] = {False: {}, True: {}}
        self.total = 1
        for r in counted.groupBy("two", "level").agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect():
            self.total += 0 if r.two else r.n
            if r.level is not None:
                levels[r.two][r.level] = r.k

        def floor(two: bool, most: int) -> int:
            total, at = 0, 1 << 20
            for lv in sorted(levels[two], reverse=True):
                total += levels[two][lv]
                if total > most:
                    break
                at = lv
            return at

        bound = F.when(F.col("two"), floor(True, max_pairs)).otherwise(floor(False, max_words))
        self.words, self.pairs = {}, {}
        for r in counted.where(F.col("level") >= bound).select("w", "x", "n").toLocalIterator():
            if r.w is None:
                self.pairs[r.x] = r.n
            else:
                self.words[r.w] = r.n
        rest = counted.where(F.col("level") < bound)
        self.n_other = sum(levels[False].values()) - len(self.words)
        self.other_words = rest.where(~F.col("two")).select("w", "n") if self.n_other else None
        self.other_pairs = rest.where("two").select("x", "n") if sum(levels[True].values()) > len(self.pairs) else None


_READERS: dict = {}


def reader_of(model) -> Reader:
    """The reader of a broadcast (name, words, pairs, total), built once a worker; the name tells runs apart that a worker serves one after the other."""
    name, *tables = model.value
    got = _READERS.get(name)
    if got is None:
        _READERS.clear()
        got = _READERS[name] = Reader(*tables)
    return got


def _missing_udf(model):
    """(unit_id, token): the words and parts of words of a page, in lower case, that the cache lacks, each once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of(model)
        for b in batches:
            ids, out = [], []
            for u, t in zip(*(c.to_pylist() for c in b.columns)):
                lines = t.split("\n")
                words = {w for w in WORD.findall(t.lower()) if not w.isdigit()}
                for body in (range(len(lines)), *bodies(lines)):
                    words.update(p.lower() for w, _ in tokens_of(lines, body, broken_lines(lines, body)) for p in (*reader.unknown(w.replace(SOFT, "")), core_of(w.replace(SOFT, ""))))
                words.update(w for k in list(words) for w in WORD.findall(k))
                fresh = [w for w in words if w and w not in reader.counts]
                ids += [u] * len(fresh)
                out += fresh
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["unit_id", "token"])

    return run


_FOUND = "array<struct<w:string,n:bigint,d:int,c:int>>"


def _block_udf(tokens: pa.Table, words: pa.Table) -> pa.Table:
    counts = dict(zip(words["w"].to_pylist(), words["n"].to_pylist()))
    trie, rows = Trie(counts), []
    for t in tokens["token"].to_pylist():
        rows += [(t, w, counts[w], d, c) for w, d, c in candidates(trie, t)]
    names = ["token", "w", "n", "d", "c"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32()]
    return pa.table({k: pa.array(c, t) for k, c, t in zip(names, zip(*rows) if rows else [[]] * 5, kinds)})


def words_beyond(scans: DataFrame, voc: Vocabulary, model, block: int) -> DataFrame | None:
    """(unit_id, words array<struct<token, n, found>>): what the words beyond the cache say of each page; None where there are none.

    Distinct unknown tokens meet the vocabulary in blocks of at most about `block` words and tokens, a trie for each.
    """
    if voc.other_words is None:
        return None
    missing = cut(scans.select("unit_id", "content").mapInArrow(_missing_udf(model), "unit_id bigint, token string").distinct())
    fresh = missing.select("token").distinct().join(voc.other_words.select(F.col("w").alias("token")), "token", "left_anti")
    rows, cols = max(1, -(-fresh.count() // block)), max(1, -(-voc.n_other // block))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = fresh.select("token", F.pmod(F.xxhash64("token"), F.lit(rows)).cast("int").alias("r"), spread(cols).alias("k"))
    right = voc.other_words.select("w", "n", F.pmod(F.xxhash64("w"), F.lit(cols)).cast("int").alias("k"), spread(rows).alias("r"))
    pairs = left.groupBy("r", "k").cogroup(right.groupBy("r", "k")).applyInArrow(_block_udf, "token string, w string, n bigint, d int, c int")
    found = pairs.groupBy("token").agg(F.collect_list(F.struct("w", "n", "d", "c")).alias("found"), F.lit(None).cast("bigint").alias("n"))
    known = voc.other_words.select(F.col("w").alias("token"), F.lit(None).cast(_FOUND).alias("found"), "n")
    return missing.join(known.unionByName(found), "token").groupBy("unit_id").agg(F.collect_list(F.struct("token", "n", "found")).alias("words"))


def _pairs_udf(model):
    """(unit_id, x): pairs of candidates with their neighbours that the cache lacks, each once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of(model)
        for b in batches:
            ids, out = [], []
            for u, t, more in zip(*(c.to_pylist() for c in b.columns)):
                lines, xs = t.split("\n"), set()
                reader.page(more or (), ())
                for body in bodies(lines):
                    for token, before, after, *_ in doubtful(lines, body, broken_lines(lines, body), reader):
                        xs.update(x for w, *_ in reader.options(token.lower()) for x in (pair(before, w), pair(w, after)) if x not in reader.pairs)
                ids += [u] * len(xs)
                out += xs
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.int64())], names=["unit_id", "x"])

    return run


def _edge_udf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[], [], []]
        for u, d, t in zip(*(c.to_pylist() for c in b.columns)):
            lines = t.split("\n")
            for i, _ in edge_lines(lines):
                for k in head_keys(lines[i]):
                    for c, x in zip(cols, (u, d, k)):
                        c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["unit_id", "doc_id", "k"])


def edge_keys(scans: DataFrame) -> DataFrame:
    """(unit_id, doc_id, k): keys of each page's edge lines, at most twelve a page."""
    return scans.select("unit_id", F.coalesce("doc_id", F.lit("")).alias("doc_id"), "content").mapInArrow(_edge_udf, "unit_id bigint, doc_id string, k bigint").distinct()


def repeated_edges(keys: DataFrame, min_pages: int = 2) -> DataFrame:
    """(unit_id, keys): those of a page's edge keys that stand on at least min_pages pages of its document and, over all documents, mostly there."""
    per = keys.groupBy("doc_id", "k").agg(F.count("*").alias("n"))
    every = per.groupBy("k").agg(F.sum("n").alias("total"))
    again = per.where(F.col("n") >= min_pages).join(every, "k").where(2 * F.col("n") >= F.col("total")).select("doc_id", "k")
    return keys.join(again, ["doc_id", "k"]).groupBy("unit_id").agg(F.collect_set("k").alias("keys"))


SOFT = "\xad"


def broken_lines(lines: list[str], body: Iterable[int]) -> set[int]:
    """The lines of body that end inside a word which goes on in the next line of body."""
    live = set(body)
    return {i for i in live if BROKEN.search(lines[i]) and i + 1 in live and re.match(r"\s*[^\W_]", lines[i + 1])}


def bodies(lines: list[str]) -> list[list[int]]:
    """The bodies a page can have, whichever lines at its very edges turn out to be heads; of those with the same tokens the longest.

    What is gone stands at the ends, so other tokens come about only where a word is broken at a line that goes.
    """
    full = [i for i, l in enumerate(lines) if l.strip()]
    numbers = {i for i in full[:1] + full[-1:] if is_page_number(lines[i])}
    most = [i for i in range(len(lines)) if i not in numbers]
    joined = broken_lines(lines, most)
    outer = [i for i, edge in edge_lines(lines) if edge]
    out = [most]
    for heads in ([i] for i in outer) if len(outer) < 2 else ([outer[0]], [outer[1]], outer):
        if any(i in heads or i + 1 in heads for i in joined):
            out.append([i for i in most if i not in heads])
    return out


def tokens_of(lines: list[str], body: Iterable[int], joined: set[int]) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The words of body and their places (line, start, end); a broken word is one, with a soft hyphen where it was."""
    tokens: list[tuple[str, list[tuple[int, int, int]]]] = []
    for i in body:
        for m in _TOKEN.finditer(lines[i]):
            w = m.group()
            if i - 1 in joined and tokens and tokens[-1][1][-1][0] == i - 1 and not lines[i][: m.start()].strip():
                tokens[-1] = (tokens[-1][0].rstrip(MARKS) + SOFT + w, [*tokens[-1][1], (i, m.start(), m.end())])
            else:
                tokens.append((w, [(i, m.start(), m.end())]))
    return tokens


_TOKEN = re.compile(r"[^\s\"“”‘’(),.;:!?\[\]…]+(?:[.,][0-9]+)*")


def doubtful(lines: list[str], body: list[int], joined: set[int], reader: Reader) -> Iterator[tuple[str, str, str, str, list[tuple[int, int, int]]]]:
    """(part, word before, word after, written word, its places) of the parts of words that the vocabulary lacks."""
    tokens = tokens_of(lines, body, joined)
    for j, (w, places) in enumerate(tokens):
        plain = w.replace(SOFT, "")
        parts = reader.unknown(plain)
        if not parts:
            continue
        if len(places) > 1:
            core = core_of(plain)
            parts = () if reader.known(core) or reader.known(w.replace(SOFT, "-")) else (core,)
        near = lambda k: tokens[k][0].replace(SOFT, "").lower() if 0 <= k < len(tokens) else ""
        for p in parts:
            yield p, near(j - 1), near(j + 1), w, places


def examine(lines: list[str], keys: set[int], reader: Reader, shapes: dict[int, float], rest: dict[int, float], scanned: bool) -> tuple[list[tuple[int, str]], dict[int, list[tuple[int, int, str]]]]:
    """The defects (line_no from 1, kind) of a unit, and the replacements by line: (start, end, word). rest: log-odds of pairs that shapes lacks."""
    found: list[tuple[int, str]] = []
    gone: set[int] = set()
    if scanned:
        full = [i for i, l in enumerate(lines) if l.strip()]
        for i in {*full[:1], *full[-1:]}:
            if is_page_number(lines[i]):
                found.append((i + 1, "page_number"))
                gone.add(i)
        for i, outer in edge_lines(lines):
            line = lines[i].strip()
            letters = [c for c in line if c.isalpha()]
            big = sum(c.isupper() for c in letters)
            gap = re.match(r"^[\dlIO]{1,4}\s{2,}\S.*|.*\S\s{2,}[\dlIO]{1,4}$", line)
            head = outer and (len(letters) >= 8 and big >= 0.8 * len(letters) or bool(gap))
            if not head and not line.endswith((".", "?", "!")):
                again = any(k in keys for k in head_keys(line))
                s = shape_words(line, reader)
                score = sum(shapes[x] if x in shapes else rest.get(x, 0.0) for x in s) / len(s)
                head = outer and (again and score > -0.5 or len(letters) >= 8 and score > 1.0)
            if head:
                found.append((i + 1, "running_head"))
                gone.add(i)
    fixes: dict[int, list[tuple[int, int, str]]] = {}
    body = [i for i in range(len(lines)) if i not in gone]
    joined = broken_lines(lines, body)
    found += [(i + 1, "split_word") for i in sorted(joined)]
    if scanned:
        for part, before, after, w, places in doubtful(lines, body, joined, reader):
            better = reader.correct(part, before, after)
            if better is None:
                continue
            at = next((k for k in range(min(len(part), len(better))) if part[k].lower() != better[k]), 0)
            at += w.replace(SOFT, "").find(part)
            line = places[0][0] if len(places) == 1 or at < len(w.split(SOFT)[0]) else places[-1][0]
            found.append((line + 1, "wrong_char"))
            if len(places) == 1:
                start = places[0][1] + w.find(part)
                shown = better.capitalize() if part[:1].isupper() else better
                fixes.setdefault(line, []).append((start, start + len(part), shown))
    return found, fixes


def reflow(text: str, found: list[tuple[int, str]], fixes: dict[int, list[tuple[int, int, str]]], known) -> str:
    """The text without page furniture, words replaced and joined, lines run on; blank lines part paragraphs."""
    lines = text.split("\n")
    drop = {n - 1 for n, kind in found if kind in ("running_head", "page_number")}
    broken = {n - 1 for n, kind in found if kind == "split_word"}
    out: list[str] = [""]
    join = False
    for i, line in enumerate(lines):
        if i in drop:
            continue
        for start, end, w in sorted(fixes.get(i, ()), reverse=True):
            line = line[:start] + w + line[end:]
        line = line.strip()
        if not line:
            if out[-1]:
                out.append("")
            continue
        out[-1] = out[-1] + line if join else f"{out[-1]} {line}".strip()
        join = i in broken
        if join:
            left, mark = out[-1][:-1], out[-1][-1]
            nxt = WORD.match(lines[i + 1].strip())
            whole = WORD.findall(left)[-1] + (nxt.group() if nxt else "")
            keeps = mark in "-‐‑" and not known(whole.lower()) and known(WORD.findall(left)[-1].lower()) and nxt is not None and known(nxt.group().lower())
            out[-1] = left + "-" * keeps
    return "\n\n".join(p for p in out if p)


def _shape_udf(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of(model)
        inside: Counter = Counter()
        head: Counter = Counter()
        for b in batches:
            for t, keys, words in zip(*(c.to_pylist() for c in b.columns)):
                lines, ks = t.split("\n"), set(keys or ())
                reader.page(words or (), ())
                edges = dict(edge_lines(lines))
                for i, l in enumerate(lines):
                    if i not in edges:
                        inside.update(shape_words(l, reader)) if l.strip() else None
                    elif edges[i] and ks.intersection(head_keys(l)):
                        head.update(shape_words(re.sub(r"^\d+\s{2,}|\s{2,}\d+$", "", l), reader))
        every = list({*inside, *head})
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.int64()), pa.array([head[x] for x in every], pa.int64()), pa.array([inside[x] for x in every], pa.int64())], names=["x", "h", "b"])

    return run


def _outer_udf(model, shape):
    """(unit_id, x): the pairs that shape lacks, of the lines at a page's very edge, each once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, shapes = reader_of(model), shape.value
        for b in batches:
            ids, xs = [], []
            for u, t, words in zip(*(c.to_pylist() for c in b.columns)):
                lines = t.split("\n")
                reader.page(words or (), ())
                for x in {x for i, outer in edge_lines(lines) if outer for x in shape_words(lines[i].strip(), reader) if x not in shapes}:
                    ids.append(u)
                    xs.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(xs, pa.int64())], names=["unit_id", "x"])

    return run


def shape_odds(counts: DataFrame, max_shapes: int) -> tuple[dict[int, float], DataFrame | None]:
    """Log-odds of the pairs seen at least five times, at a head against inside a page: those of the max_shapes most frequent, and a table (x, o) of the rest.

    counts: x, h, b. The rest is None where all fit. Without heads or inner lines there are none.
    """
    totals = counts.agg(F.sum("h").alias("h"), F.sum("b").alias("b")).first()
    if not totals.h or not totals.b:
        return {}, None
    odds = F.log(((F.col("h") + 0.5) / float(totals.h)) / ((F.col("b") + 0.5) / float(totals.b)))
    scored = counts.select("x", (F.col("h") + F.col("b")).alias("n"), odds.alias("o")).where(F.col("n") >= 5)
    top = scored.orderBy(F.desc("n"), "x").limit(max_shapes + 1).collect()
    shapes = {r.x: r.o for r in top[:max_shapes]}
    if len(top) <= max_shapes:
        return shapes, None
    first = top[max_shapes]
    return shapes, scored.where((F.col("n") < first.n) | ((F.col("n") == first.n) & (F.col("x") >= first.x))).select("x", "o")


_WORDS = f"array<struct<token:string,n:bigint,found:{_FOUND}>>"


def scan_defects(units: DataFrame, trusted_texts: DataFrame, *, min_count: int = 3, max_words: int = 300_000, max_pairs: int = 300_000, max_shapes: int = 100_000, block: int = 200_000, repair: bool = False) -> DataFrame:
    """(unit_id, line_no, defect) or, with repair, (unit_id, content): scanned units with their furniture gone and words mended.

    units: unit_id, doc_id, source_type, content. trusted_texts: one column t, texts not from scans. Broken words are found in units of all types,
    the rest in scanned ones. Null and empty contents have no defects; exact copies of a row give theirs once, and of rows with one unit_id
    and different contents each gives its own defects and, repaired, its own row. max_words, max_pairs and max_shapes bound what is broadcast, not what counts.
    """
    spark = units.sparkSession
    scans = units.where((F.col("source_type") == "ocr_text") & F.col("content").isNotNull())
    voc = Vocabulary(trusted_texts.where(F.col("t").isNotNull()), min_count=min_count, max_words=max_words, max_pairs=max_pairs)
    model = spark.sparkContext.broadcast((uuid.uuid4().hex, voc.words, voc.pairs, voc.total))

    def side(df: DataFrame, more: DataFrame | None, name: str, kind: str) -> DataFrame:
        return df.withColumn(name, F.lit(None).cast(kind)) if more is None else df.join(more, "unit_id", "left")

    pages = side(scans.select("unit_id", "doc_id", "content"), words_beyond(scans, voc, model, block), "words", _WORDS)
    pages = pages.join(cut(repeated_edges(cut(edge_keys(scans)))), "unit_id", "left")
    counts = pages.select("content", "keys", "words").mapInArrow(_shape_udf(model), "x bigint, h bigint, b bigint").groupBy("x").agg(F.sum("h").alias("h"), F.sum("b").alias("b"))
    shapes, others = shape_odds(cut(counts), max_shapes)
    shape = spark.sparkContext.broadcast(shapes)
    rest = beside = None
    if others is not None:  # the pairs that are not broadcast are looked up by a join, for the lines at the edge only
        missing = pages.select("unit_id", "content", "words").mapInArrow(_outer_udf(model, shape), "unit_id bigint, x bigint").distinct()
        rest = missing.join(others, "x").groupBy("unit_id").agg(F.collect_list(F.struct("x", "o")).alias("rest"))
    if voc.other_pairs is not None:
        missing = pages.select("unit_id", "content", "words").mapInArrow(_pairs_udf(model), "unit_id bigint, x bigint").distinct()
        beside = missing.join(voc.other_pairs, "x").groupBy("unit_id").agg(F.collect_list(F.struct("x", "n")).alias("beside"))
    read = side(side(pages, rest, "rest", "array<struct<x:bigint,o:double>>"), beside, "beside", "array<struct<x:bigint,n:bigint>>")
    read = read.select("unit_id", "content", "keys", "words", "rest", "beside", F.lit(True).alias("scanned"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of(model)
        for b in batches:
            ids, nos, kinds = [], [], []
            for u, t, ks, words, more, beside, scanned in zip(*(c.to_pylist() for c in b.columns)):
                lines = t.split("\n")
                reader.page(words or (), beside or ())
                found, fixes = examine(lines, set(ks or ()), reader, shape.value, {r["x"]: r["o"] for r in more or ()}, scanned)
                if repair:
                    ids.append(u)
                    kinds.append(reflow(t, found, fixes, reader.known))
                    continue
                for n, kind in dict.fromkeys(found):
                    ids.append(u)
                    nos.append(n)
                    kinds.append(kind)
            if repair:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string())], names=["unit_id", "content"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32()), pa.array(kinds, pa.string())], names=["unit_id", "line_no", "defect"])

    if repair:
        return read.mapInArrow(run, "unit_id bigint, content string").distinct()
    plain = units.where((F.col("source_type") != "ocr_text") & F.col("content").rlike(rf"[\p{{L}}][{MARKS}]\s*\n"))
    none = [F.lit(None).cast(read.schema[c].dataType).alias(c) for c in ("keys", "words", "rest", "beside")]
    read = read.unionByName(plain.select("unit_id", "content", *none, F.lit(False).alias("scanned")))
    return read.mapInArrow(run, "unit_id bigint, line_no int, defect string").distinct()
