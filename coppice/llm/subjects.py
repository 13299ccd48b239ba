"""Subject areas of documents by class-association rules.

Labelled documents are cut into sentences; a transaction is a sentence's words with the subjects of its document.
Parallel frequent-pattern growth mines word sets that come with a subject: each group of words gets the beginnings of the
transactions, most frequent words first, that end in one of its words, keeps them in a tree with counts by subject and grows sets from
the end. Rules that a more general rule explains as well are pruned, and so are branches in which no other rule can stand. A sentence's subject is the one with the most evidence of matching rules, each
weighed by its calibrated log odds against the subject's share; a sentence without enough evidence has none. A document treats
the subjects of at least `share` of its sentences.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BREAK = re.compile(r"\n+|(?<=[.!?。])[\"'”’)\]]*\s+")
_ABBREVIATED = re.compile(r"(?:\b[A-Z]|\be\.g|\bi\.e|\betc|\bvs|\bcf|\bMr|\bMrs|\bDr|\bNo)\.$")
_WORD = re.compile(r"[a-z]+|[가-힣]+")
_LETTER = re.compile("[A-Za-z가-힣]")
# Korean particles that follow a noun.
PARTICLES = ("에서", "으로", "부터", "까지", "은", "는", "이", "가", "을", "를", "과", "와", "의", "로", "에", "도", "만")


def sentences(text: str | None) -> list[str]:
    """Sentences of a text: ends at line breaks and at marks followed by white space, not at initials and abbreviations."""
    out, begun = [], ""
    if not text:
        return out
    at = 0
    for m in _BREAK.finditer(text):
        part = text[at : m.end()]
        at = m.end()
        begun += part
        if "\n" not in m.group() and (_ABBREVIATED.search(begun.rstrip()) or text[at : at + 1].islower()):
            continue
        out.append(begun)
        begun = ""
    out.append(begun + text[at:])
    return [s for s in map(str.strip, out) if _LETTER.search(s)]


def stem(word: str) -> str:
    if word[0] >= "가":
        for p in PARTICLES:
            if word.endswith(p) and len(word) - len(p) >= 2:
                return word[: -len(p)]
        return word
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word


def words(sentence: str) -> set[str]:
    return {stem(w) for w in _WORD.findall(sentence.lower())}


def _transactions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(subjects, ws): the words of each sentence with the subjects of its document."""
    for b in batches:
        subs, ws = [], []
        for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for x in sentences(t):
                subs.append(s)
                ws.append(sorted(words(x)))
        yield pa.RecordBatch.from_arrays([pa.array(subs, pa.list_(pa.string())), pa.array(ws, pa.list_(pa.string()))], names=["subjects", "ws"])


class Rules(dict):
    """Matching and scoring; the rules are a bounded list on the driver (see mine). As a mapping: what each written word brings, found once."""

    def __init__(self, rules: list[tuple[tuple[str, ...], str, float, float]], least: float):
        # (antecedent, subject, confidence, share of the subject)
        super().__init__()
        self.least, self.rules = least, rules
        self.single: dict[str, list[tuple[str, float]]] = {}
        self.longer: dict[str, list[tuple[tuple[str, ...], str, float]]] = {}
        for ante, subject, conf, prior in rules:
            w = math.log(conf / (1 - conf)) - math.log(prior / (1 - prior))
            if len(ante) == 1:
                self.single.setdefault(ante[0], []).append((subject, w))
            else:
                self.longer.setdefault(ante[0], []).append((ante[1:], subject, w))
        self.used = {w for ante, *_ in rules for w in ante}

    def __reduce__(self):
        return (Rules, (self.rules, self.least))

    def __missing__(self, word: str) -> str | None:
        s = stem(word)
        if len(self) > 300_000:
            self.clear()
        got = self[word] = s if s in self.used else None
        return got

    def subject(self, sentence: str) -> str | None:
        """The subject with the most evidence, if it is at least `least`; ties go to the first by name."""
        ws = {*map(self.__getitem__, _WORD.findall(sentence.lower()))}
        ws.discard(None)
        if not ws:
            return None
        score: dict[str, float] = {}
        for w in ws:
            for s, x in self.single.get(w, ()):
                score[s] = score.get(s, 0.0) + x
            for others, s, x in self.longer.get(w, ()):
                if ws.issuperset(others):
                    score[s] = score.get(s, 0.0) + x
        best = max(sorted(score), key=score.__getitem__, default=None)
        return best if best is not None and score[best] >= self.least else None


class Tree:
    """Frequent-pattern tree: transactions as paths of ranks, each node with its count and the counts by subject."""

    def __init__(self, width: int):
        self.width = width
        self.item, self.parent, self.counts = [-1], [-1], [[0] * width]
        self.children: list[dict[int, int]] = [{}]
        self.header: dict[int, list[int]] = {}

    def insert(self, path: Iterable[int], counts: list[int]) -> None:
        at = 0
        for i in path:
            nxt = self.children[at].get(i)
            if nxt is None:
                nxt = self.children[at][i] = len(self.item)
                self.item.append(i)
                self.parent.append(at)
                self.counts.append([0] * self.width)
                self.children.append({})
                self.header.setdefault(i, []).append(nxt)
            at, own = nxt, self.counts[nxt]
            for k, c in enumerate(counts):
                own[k] += c

    def total(self, item: int) -> list[int]:
        return [sum(c) for c in zip(*(self.counts[v] for v in self.header[item]))]

    def before(self, item: int) -> list[tuple[list[int], list[int]]]:
        """The conditional pattern base: what stands before the item, with the item's counts."""
        out = []
        for v in self.header[item]:
            path, at = [], self.parent[v]
            while at:
                path.append(self.item[at])
                at = self.parent[at]
            out.append((path[::-1], self.counts[v]))
        return out


class Growth:
    """Grows word sets of any length from a tree; no rule that stands after pruning is missed.

    alone: for each rank, the confidences by subject of the word itself; prior: shares of the subjects.
    A set as frequent as a part of it says the same as that part, and so does all that contains it. A subject is given up in a branch
    where even the confidence of as many cases without an exception would not exceed that of a more general set by `gain`.
    """

    def __init__(self, alone: list[list[float]], prior: list[float], least: int, min_confidence: float, gain: float):
        self.alone, self.prior, self.least, self.min_confidence, self.gain = alone, prior, least, min_confidence, gain

    def grow(self, tree: Tree, items: Iterable[int], tail: tuple[int, ...] = (), tail_n: int = -1, alive: dict[int, float] | None = None) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """(ranks, subject, count, count with the subject) of sets of two words or more that are surer than their known parts. alive: the subjects to look for, with the best confidence of a part."""
        alive = dict.fromkeys(range(len(self.prior)), 0.0) if alive is None else alive
        for i in items:
            n, *ks = tree.total(i)
            if n == tail_n:
                continue
            ranks, go = (i, *tail), {}
            for s, best in alive.items():
                k, p = ks[s], 2 * self.prior[s]
                if k < self.least:
                    continue
                best, c = max(best, self.alone[i][s]), (k + p) / (n + 2)
                if tail and c > best and c >= self.min_confidence - self.gain:
                    yield ranks, s, n, k
                best, most = max(best, c), (k + p) / (k + 2)
                if most >= self.min_confidence and most > best + self.gain:
                    go[s] = best
            if go:
                base = tree.before(i)
                seen: dict[int, list[int]] = {}
                for path, counts in base:
                    for j in path:
                        own = seen.setdefault(j, [0] * tree.width)
                        for k, c in enumerate(counts):
                            own[k] += c
                often = {j for j, own in seen.items() if own[0] < n and any(own[s + 1] >= self.least for s in go)}
                if often:
                    part = Tree(tree.width)
                    for path, counts in base:
                        part.insert([j for j in path if j in often], counts)
                    yield from self.grow(part, sorted(often), ranks, n, go)


_GROUPS = 48


def frequent_sets(sent: DataFrame, words_kept: list[str], subjects: list[str], growth: Growth) -> dict[tuple[tuple[str, ...], str], tuple[int, int]]:
    """{(words, subject): (count, count with the subject)} of sets of two words or more, see Growth.grow. words_kept: by rank, most frequent first."""
    known = sent.sparkSession.sparkContext.broadcast(({w: i for i, w in enumerate(words_kept)}, {x: i for i, x in enumerate(subjects)}))

    def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(g, ranks, cs, n): for each group the longest beginning of a transaction that ends in a word of the group."""
        rank, number = known.value
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            cols = list(zip(*((g, list(r), list(c), n) for (g, r, c), n in held.items()))) or [(), (), (), ()]
            kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["g", "ranks", "cs", "n"])

        for b in batches:
            for subs, ws in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ranks = tuple(sorted(rank[w] for w in ws if w in rank))
                cs, given = tuple(sorted(number[x] for x in subs)), set()
                for end in range(len(ranks), 0, -1):  # lone words too: they count in what a set is compared with
                    g = ranks[end - 1] % _GROUPS
                    if g not in given:
                        given.add(g)
                        held[g, ranks[:end], cs] += 1
            if len(held) > 200_000:
                yield out()
                held.clear()
        yield out()

    def mined(part: pa.Table) -> pa.Table:
        tree = Tree(1 + len(growth.prior))
        for ranks, cs, n in zip(*(part[c].to_pylist() for c in ("ranks", "cs", "n"))):
            counts = [n] + [0] * len(growth.prior)
            for c in cs:
                counts[c + 1] = n
            tree.insert(ranks, counts)
        g = part["g"][0].as_py()
        rows = list(growth.grow(tree, [i for i in sorted(tree.header) if i % _GROUPS == g]))
        kinds = (pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int64())
        return pa.table({name: pa.array(c, t) for name, c, t in zip(("ranks", "s", "n", "k"), list(zip(*rows)) or [()] * 4, kinds)})

    parts = sent.select("subjects", "ws").mapInArrow(beginnings, "g int, ranks array<int>, cs array<int>, n bigint")
    found = parts.groupBy("g").applyInArrow(mined, "ranks array<int>, s int, n bigint, k bigint").collect()  # bounded as the rules are
    return {(tuple(sorted(words_kept[i] for i in r.ranks)), subjects[r.s]): (r.n, r.k) for r in found}


def mine(documents: DataFrame, labels: DataFrame, *, max_labelled: int = 20_000, min_count: int = 4, min_confidence: float = 0.5, gain: float = 0.05) -> list[tuple[tuple[str, ...], str, float, float]]:
    """Rules (words, subject, calibrated confidence, the subject's share of labelled sentences).

    Fitted on at most max_labelled labelled documents, chosen by hash (the documented bound). Words are kept if they come
    with one subject at least min_confidence of the time; antecedents have as many words as make them surer by `gain` (above 0) than all
    their parts. Supports are relative, so the number of rules is bounded by the words a sentence can have and 1 / minimum support, not by the corpus.
    """
    lab = labels.where(F.col("subject").isNotNull()).groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    near = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) < int(2.0**53 * min(1.0, 2.0 * max_labelled / max(lab.count(), 1)))
    lab = lab.where(near).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    text = documents.where(F.col("text").isNotNull()).select("doc_id", "text").join(lab, "doc_id").dropDuplicates(["doc_id"])
    sent = text.select("subjects", "text").mapInArrow(_transactions, "subjects array<string>, ws array<string>").cache()
    n = sent.count()
    if not n:
        return []
    prior = {r.s: r.n / n for r in sent.select(F.explode("subjects").alias("s")).groupBy("s").agg(F.count("*").alias("n")).collect()}
    per = sent.select(F.explode("ws").alias("w"), "subjects").groupBy("w").agg(F.count("*").alias("n"), *[F.sum(F.array_contains("subjects", s).cast("int")).alias(f"s{i}") for i, s in enumerate(sorted(prior))])
    least = max(min_count, n // 20_000)
    best = F.greatest(*[F.col(f"s{i}") for i in range(len(prior))], F.lit(0))
    kept = per.where((F.col("n") >= least) & (best >= min_confidence * F.col("n"))).orderBy(F.desc("n"), "w").collect()
    if not kept:
        return []
    subjects = sorted(prior)
    shares = [prior[x] for x in subjects]
    # calibrated: shrunk to the subject's share
    alone = [[(r[f"s{i}"] + 2 * p) / (r.n + 2) if r[f"s{i}"] >= least else 0.0 for i, p in enumerate(shares)] for r in kept]
    conf = {((r.w,), x): c for r, cs in zip(kept, alone) for x, c in zip(subjects, cs) if c}
    sets = frequent_sets(sent, [r.w for r in kept], subjects, Growth(alone, shares, least, min_confidence, gain))
    sent.unpersist()
    conf |= {(ante, x): (k + 2 * prior[x]) / (n + 2) for (ante, x), (n, k) in sets.items()}
    out = []
    for (ante, cls), c in sorted(conf.items()):
        if c < min_confidence:
            continue
        if any(conf.get((part, cls), 0) + gain >= c for k in range(1, len(ante)) for part in combinations(ante, k)):
            continue  # a more general rule says as much
        out.append((ante, cls, min(c, 0.995), prior[cls]))
    return out


def subject_areas(documents: DataFrame, labels: DataFrame, *, share: float = 0.2, evidence: float = 1.5, **mining) -> DataFrame:
    """(doc_id, subject, share DOUBLE): the subjects that at least `share` of a document's sentences treat.

    Null, empty and blank texts, and texts without evidence, have no rows. Repeated rows with one doc_id count once per text.
    """
    rules = documents.sparkSession.sparkContext.broadcast(Rules(mine(documents, labels, **mining), evidence))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = rules.value
        for b in batches:
            ids, subs, shares = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ss = sentences(t)
                n = Counter(map(judge.subject, ss))
                for s, k in n.items():
                    if s is not None and k >= share * len(ss) - 1e-9:
                        ids.append(i)
                        subs.append(s)
                        shares.append(k / len(ss))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(subs, pa.string()), pa.array(shares, pa.float64())], names=["doc_id", "subject", "share"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, subject string, share double")
