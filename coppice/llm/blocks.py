"""Main body of pages by a recurrent block labeller: a bidirectional LSTM over a page's lines, in numpy.

A leaf of the sequence is a line. Its vector joins a path of layout marks (bullets, brackets, separators, length, end mark,
place in the page, repeats) in the place of a tag path, and the mean of learned vectors of its hashed words; words too rare to
learn share signs by their script and case. Every line is judged with the context of the whole page on both sides.

The labeller is fitted on a bounded sample of pages (max_pages, chosen by hash) whose lines a set of labelling rules marks:
lines that recur over addresses of a site or over sites, counted over all pages, are furniture, sentences and figures are body, a title before, between
or behind them is a headline, a heading or a link. Rules see whole pages with their sites; the labeller then judges any run
of lines, also in fragments, on which it is trained too.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from . import residue

_WORDS = re.compile(r"[a-z]+|[가-힣]+|[0-9]+|[^\w\s]")
_SENTENCE = re.compile(r"[.!?。][\"'”’)\]]*\s*$")
_SEPARATED = re.compile(r"\s[|·•/»>–—-]\s|\s{2,}")
_BULLET = re.compile(r"^(?:[*\-•]|\d{1,3}[.)])\s")
_DATE = re.compile(r"(?i)^\W*(?:published|updated|posted|last updated|입력|수정|등록|작성)?\W*(?:\d{4}[-./년]\s*\d{1,2}[-./월]\s*\d{1,2}일?|\d{1,2}[-./]\d{1,2}[-./]\d{4}|\d{1,2} [a-z]{3,9}\.? \d{4}|[a-z]{3,9}\.? \d{1,2}, \d{4})\W*(?:\d{1,2}:\d{2}(?::\d{2})?)?\W*$")
_BYLINE = re.compile(r"^(?:(?:By|Reported by|Written by|Text:)\s+[A-Z].{1,60}|[A-Z]\. ?\w+(?: \w+)?(?:\s*[|·,–-]\s*.{2,40})?|.{1,30}\s기자)$")
_ERRORS = re.compile("|".join(residue.PHRASES))
_STRICT = re.compile("^(?:" + "|".join(residue.STRICT) + ")$")
_SHAPE = re.compile(residue.FURNITURE)
_RELATED = re.compile(r"(?i)^\W*(?:read next|related(?: stories| articles)?|more from .*|you may also like|see also|관련 기사|많이 본 기사|추천 기사)\W*$")
_LATIN = frozenset(residue.LATIN)
BUCKETS, WIDTH, DENSE, HIDDEN = 4096, 16, 24, 24


def normal(line: str, name: str = "") -> str:
    """The line trimmed, in lower case, white space and digits reduced and the site's own name masked."""
    n = re.sub(r"[0-9]+", "0", " ".join(line.split()).lower())
    return n.replace(name, "<site>") if len(name) > 3 else n


def site_name(host: str) -> str:
    """The name that a host spells: my-site for data.my-site.example, its hyphens blanks."""
    labels = host.split(".")
    return labels[-2].replace("-", " ") if len(labels) > 1 else ""


def own_lines(lines: list[str]) -> list[str]:
    """Lines without the links to other articles, so that an article's headline doesn't recur by being linked."""
    out, links = [], False
    for l in lines:
        if _RELATED.match(l):
            links = True
        elif links and l.strip() and not (15 <= len(l.strip()) and not _SENTENCE.search(l)):
            links = False
        if not links or _RELATED.match(l):
            out.append(l)
    return out


def latin(line: str) -> bool:
    ws = re.findall("[a-z]+", line.lower())
    return len(ws) >= 4 and sum(w in _LATIN for w in ws) >= 0.7 * len(ws)


def mark(lines: list[str], frequent, name: str = "") -> list[int]:
    """Labels of a whole page's lines by rule: 1 main body, 0 not, -1 blank. frequent: whether a normalised line recurs; name: the site's."""
    out = [-1 if not l.strip() else 0 for l in lines]
    kind = [""] * len(lines)
    for i, raw in enumerate(lines):
        l = raw.strip()
        if not l:
            continue
        n = normal(l, name)
        if frequent(n) or _DATE.match(l) or _BYLINE.match(l) or _STRICT.match(n) or latin(l) or len(n) < 90 and _ERRORS.search(n) or _SHAPE.search(n) and not re.search(r"\d.*,", l):
            kind[i] = "furniture"
        elif _SENTENCE.search(l) and len(l) >= (14 if re.search("[가-힣]", l) else 40):
            kind[i] = "text"
        elif re.search(r"\d", l) and "," in l and len(l) < 120 and not _SENTENCE.search(l) and not re.search(r"\s[/>|]\s", l):
            kind[i] = "item"
        elif re.search(r"\s[/>»|]\s", l):
            kind[i] = "furniture"
        else:
            kind[i] = "title"
    body = [i for i, k in enumerate(kind) if k in ("text", "item")]
    if not body:
        return out
    related = next((i for i, l in enumerate(lines) if i > body[0] and _RELATED.match(l)), len(lines))
    last = max((i for i in body if i < related), default=body[-1])
    before = [i for i in range(body[0]) if kind[i] == "title"]
    for i, k in enumerate(kind):
        if i > last:
            break
        if k in ("text", "item") or k == "title" and (i > body[0] or before and i == before[0]):
            out[i] = 1
    return out


class Features:
    def __init__(self, known: frozenset[str]):
        self.known = known
        self.cache: dict[str, int] = {}

    def bucket(self, w: str) -> int:
        b = self.cache.get(w)
        if b is None:
            if w in self.known:
                b = 16 + zlib.crc32(w.encode()) % (BUCKETS - 16)
            elif w[0].isdigit():
                b = min(len(w), 4)
            elif w[0] >= "가":
                b = 5 + min(len(w), 5) // 2
            else:
                b = 9 if w.isalpha() else 10
            if len(self.cache) > 500_000:
                self.cache.clear()
            self.cache[w] = b
        return b

    def page(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """(dense, word buckets, words per line, line indices) of the lines that are not blank."""
        at = [i for i, l in enumerate(lines) if l.strip()]
        n = len(at)
        dense = np.zeros((n, DENSE), np.float32)
        ids: list[int] = []
        sizes = np.zeros(n, np.int64)
        seen: dict[str, int] = defaultdict(int)
        for i in at:
            seen[lines[i].strip()] += 1
        bucket = self.bucket
        for k, i in enumerate(at):
            raw = lines[i]
            l = raw.strip()
            ws = _WORDS.findall(l.lower())
            sizes[k] = len(ws)
            ids += map(bucket, ws)
            c = len(l)
            digits = sum(map(str.isdigit, l)) if c < 400 else 0
            hangul = "가" <= max(l) <= "힣"
            d = dense[k]
            d[0] = min(c, 400) / 200
            d[1] = min(len(ws), 60) / 30
            d[2] = c < 16
            d[3] = 16 <= c < 40
            d[4] = 40 <= c < 90
            d[5] = c >= 90
            d[6] = bool(_SENTENCE.search(l))
            d[7] = digits / c
            d[8] = digits > 0
            d[9] = bool(_BULLET.match(l))
            d[10] = l[0] == "[" and l[-1] == "]"
            d[11] = min(len(_SEPARATED.findall(l)), 6) / 3
            d[12] = raw[0].isspace()
            d[13] = hangul
            d[14] = l[0].isupper()
            d[15] = l[0] in "\"“'"
            d[16] = seen[l] > 1
            d[17] = k / max(n - 1, 1)
            d[18] = k == 0
            d[19] = k == n - 1
            d[20] = i > 0 and not lines[i - 1].strip()
            d[21] = "," in l
            d[22] = bool(_DATE.match(l)) if c < 60 else 0
            d[23] = ":" in l
        return dense, np.array(ids, np.int64), sizes, at


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Hashed-word table, two LSTMs and a logistic output; float32 numpy."""

    def __init__(self, known: frozenset[str], seed: int = 7):
        r = np.random.default_rng(seed)
        d = DENSE + WIDTH
        self.features = Features(known)
        self.p = {"E": r.normal(0, 0.3, (BUCKETS, WIDTH)), "o": r.normal(0, 0.2, 2 * HIDDEN + d), "ob": np.zeros(1)}
        for k in "fb":
            self.p[f"W{k}"] = r.normal(0, 1 / np.sqrt(d + HIDDEN), (d + HIDDEN, 4 * HIDDEN))
            self.p[f"c{k}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def inputs(self, dense: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        e = np.zeros((len(sizes), WIDTH), np.float32)
        if len(ids):
            ok = sizes > 0
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            e[ok] = np.add.reduceat(self.p["E"][ids], starts[ok], axis=0) / sizes[ok, None]
        return np.concatenate([dense, e], axis=1)

    def run(self, x: np.ndarray, mask: np.ndarray, k: str, keep: bool = False, state: tuple[np.ndarray, np.ndarray] | None = None):
        """x (T, B, d), mask (T, B): hidden states (T, B, H) of one direction, what back() needs, and the last state; padded steps leave the state as it is."""
        t_max, b, _ = x.shape
        w, c0 = self.p[f"W{k}"], self.p[f"c{k}"]
        d = x.shape[2]
        xw = x.reshape(-1, d) @ w[:d] + c0
        xw = xw.reshape(t_max, b, -1)
        u = w[d:]
        h, c = state or (np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32))
        hs = np.zeros((t_max, b, HIDDEN), np.float32)
        trace = []
        for t in range(t_max) if k == "f" else range(t_max - 1, -1, -1):
            z = xw[t] + h @ u
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            if keep:
                trace.append((t, h, c, i, f, o, g, tc, m))
            c = m * c2 + (1 - m) * c
            h = m * (o * tc) + (1 - m) * h
            hs[t] = h
        return hs, trace, (h, c)

    def back(self, dhs: np.ndarray, trace: list, x: np.ndarray, k: str, grads: dict) -> np.ndarray:
        d = x.shape[2]
        w = self.p[f"W{k}"]
        dx = np.zeros_like(x)
        dh = np.zeros_like(trace[0][1])
        dc = np.zeros_like(dh)
        dw, dbias = np.zeros_like(w), np.zeros_like(self.p[f"c{k}"])
        for t, h, c, i, f, o, g, tc, m in reversed(trace):
            dht = dh + dhs[t]
            live = dht * m
            dct = dc * m + live * o * (1 - tc * tc)
            dz = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), live * tc * o * (1 - o), dct * i * (1 - g * g)], axis=1)
            dw[:d] += x[t].T @ dz
            dw[d:] += h.T @ dz
            dbias += dz.sum(0)
            back = dz @ w.T
            dx[t] = back[:, :d]
            dh = back[:, d:] + dht * (1 - m)
            dc = dct * f + dc * (1 - m)
        grads[f"W{k}"], grads[f"c{k}"] = dw, dbias
        return dx

    def pad(self, xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        t = max(len(x) for x in xs)
        x = np.zeros((t, len(xs), DENSE + WIDTH), np.float32)
        mask = np.zeros((t, len(xs)), np.float32)
        for j, v in enumerate(xs):
            x[: len(v), j] = v
            mask[: len(v), j] = 1
        return x, mask

    def scores(self, xs: list[np.ndarray]) -> list[np.ndarray]:
        x, mask = self.pad(xs)
        f = self.run(x, mask, "f")[0]
        b = self.run(x, mask, "b")[0]
        z = np.concatenate([f, b, x], axis=2) @ self.p["o"] + self.p["ob"]
        return [z[: len(v), j] for j, v in enumerate(xs)]

    def long_scores(self, x: np.ndarray, window: int = 400) -> np.ndarray:
        """Scores of one long page: both directions go through it window by window and carry their states on, so every line has the whole page as context."""
        z = x @ self.p["o"][2 * HIDDEN :] + self.p["ob"]
        starts = list(range(0, len(x), window))
        for k, order, o in (("f", starts, self.p["o"][:HIDDEN]), ("b", starts[::-1], self.p["o"][HIDDEN : 2 * HIDDEN])):
            state = None
            for s in order:
                part = x[s : s + window, None, :]
                hs, _, state = self.run(part, np.ones(part.shape[:2], np.float32), k, state=state)
                z[s : s + window] += hs[:, 0] @ o
        return z

    def fit(self, pages: list[tuple], labels: list[np.ndarray], epochs: int, batch: int = 48, rate: float = 0.006, seed: int = 3) -> None:
        """Adam on the logistic loss. pages: what Features.page gives; labels: 0 or 1 per line."""
        r = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        order = np.arange(len(pages))
        lengths = np.array([len(p[2]) for p in pages])
        for e in range(epochs):
            r.shuffle(order)
            lr = rate * (0.5 * (1 + np.cos(np.pi * e / epochs)) * 0.95 + 0.05)
            for some in batches_of(order, lengths, batch, r):
                part = [pages[j] for j in some]
                xs = [self.inputs(*p[:3]) for p in part]
                x, mask = self.pad(xs)
                y = np.zeros_like(mask)
                for c, j in enumerate(some):
                    y[: len(labels[j]), c] = labels[j]
                f, tf, _ = self.run(x, mask, "f", True)
                b, tb, _ = self.run(x, mask, "b", True)
                hx = np.concatenate([f, b, x], axis=2)
                dz = (_sigmoid(hx @ self.p["o"] + self.p["ob"]) - y) * mask / mask.sum()
                g = {"o": np.einsum("tbk,tb->k", hx, dz), "ob": np.array([dz.sum()], np.float32)}
                dh = dz[:, :, None] * self.p["o"]
                dx = dh[:, :, 2 * HIDDEN :] + self.back(dh[:, :, :HIDDEN], tf, x, "f", g) + self.back(dh[:, :, HIDDEN : 2 * HIDDEN], tb, x, "b", g)
                de = np.zeros_like(self.p["E"])
                hit, val = [], []
                for c, p in enumerate(part):
                    per = dx[: len(p[2]), c, DENSE:] / np.maximum(p[2], 1)[:, None]
                    hit.append(p[1])
                    val.append(np.repeat(per, p[2], axis=0))
                at, v = np.concatenate(hit), np.concatenate(val)
                by = np.argsort(at, kind="stable")
                rows, first = np.unique(at[by], return_index=True)
                if len(rows):
                    de[rows] = np.add.reduceat(v[by], first, axis=0)
                g["E"] = de
                step += 1
                for k in self.p:
                    m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                    m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
                    self.p[k] = (self.p[k] - lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def main_lines(self, texts: list[str | None], window: int = 400, batch: int = 128) -> list[list[int]]:
        """Numbers, from 1, of the main body's lines of each text; none for null and blank ones. Pages of up to `window` lines are read in batches, longer ones each by itself."""
        out: list[list[int]] = [[] for _ in texts]
        jobs: list[tuple[int, np.ndarray, list[int]]] = []
        for j, t in enumerate(texts):
            if not t:
                continue
            dense, ids, sizes, at = self.features.page(t.split("\n"))
            if not at:
                continue
            x = self.inputs(dense, ids, sizes)
            if len(at) > window:
                out[j] = [i + 1 for i, z in zip(at, self.long_scores(x, window)) if z > 0]
            else:
                jobs.append((j, x, at))
        jobs.sort(key=lambda q: len(q[1]))
        for s in range(0, len(jobs), batch):
            some = jobs[s : s + batch]
            for (j, _, at), z in zip(some, self.scores([q[1] for q in some])):
                out[j] = [i + 1 for i, v in zip(at, z) if v > 0]
        return out


def batches_of(order: np.ndarray, lengths: np.ndarray, batch: int, r: np.random.Generator) -> list[np.ndarray]:
    """Batches of a shuffled order, in random order, each of pages of like length, so that little is padded."""
    out = []
    for s in range(0, len(order), batch * 16):
        some = order[s : s + batch * 16]
        some = some[np.argsort(lengths[some], kind="stable")]
        out += [some[k : k + batch] for k in range(0, len(some), batch)]
    return [out[k] for k in r.permutation(len(out))]


def page_lines(s: str, text: str) -> set[str]:
    """The normalised lines of a page of site s, without links to other articles."""
    return {normal(l, site_name(s)) for l in own_lines(text.split("\n")) if l.strip()}


def recurrent_lines(pages: DataFrame, rows: list[tuple[str | None, str]], *, own_urls: int = 3, sites: int = 3) -> tuple[set[str], set[tuple[str, str]]]:
    """(lines of at least `sites` sites, (site, line) under at least own_urls addresses of the site), counted over all pages.

    pages: s, final_url, text, s a site. rows: the pages whose lines are asked for; only lines of theirs are counted, so what comes
    back is bounded by them: a line that is not on several sites has at most sites - 1 of its own.
    """
    names = sorted(set().union(*(page_lines(s or "", t) for s, t in rows)))
    wanted = pages.sparkSession.sparkContext.broadcast({n: i for i, n in enumerate(names)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = wanted.value
        for b in batches:
            found = [[ids[n] for n in page_lines(s, t) if n in ids] for s, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
            at = np.repeat(np.arange(b.num_rows), np.array([len(f) for f in found], np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array([i for f in found for i in f], pa.int32())], names=["s", "u", "n"])

    seen = pages.where(F.col("text").isNotNull()).select(F.coalesce("s", F.lit("")).alias("s"), F.xxhash64("final_url").alias("u"), "text").mapInArrow(run, "s string, u bigint, n int")
    per_site = seen.groupBy("n", "s", "u").agg(F.lit(1).alias("one")).groupBy("n", "s").agg((F.count("*") >= own_urls).alias("own"))
    per_site = cut(per_site)
    wide = {r.n for r in per_site.groupBy("n").agg(F.count("*").alias("k")).where(F.col("k") >= sites).select("n").collect()}
    few = per_site.groupBy("n").agg(F.count("*").alias("k")).where(F.col("k") < sites).select("n")
    own = per_site.where("own").join(few, "n").select("s", "n").collect()
    return {names[i] for i in wide}, {(r.s, names[r.n]) for r in own}


def fit_labeller(rows: list[tuple[str | None, str]], wide: set[str], own: set[tuple[str, str]], *, epochs: int = 8, seed: int = 11) -> Labeller:
    """A labeller fitted on pages (site, text) that the rules mark, on each page as a whole and on a run of its lines.

    wide, own: the lines that recur over sites and, as (site, line), over addresses of a site.
    """
    words: dict[str, int] = defaultdict(int)
    split = [(s or "", t.split("\n")) for s, t in rows]
    for _, lines in split:
        for w in {w for l in lines for w in _WORDS.findall(l.lower())}:
            words[w] += 1
    known = frozenset(sorted(w for w, n in words.items() if n >= max(4, len(split) // 400) and not w.isdigit()))
    lab = Labeller(known)
    r = np.random.default_rng(seed)
    pages, labels = [], []
    for s, lines in split:
        y = mark(lines, lambda n: n in wide or (s, n) in own, site_name(s))
        runs = [(0, len(lines))]
        if len(lines) > 6:
            a = int(r.integers(0, len(lines) - 3))
            runs.append((a, min(len(lines), a + int(r.integers(2, 16)))))
        for a, b in runs:
            if b - a > 300:
                b = a + 300
            p = lab.features.page(lines[a:b])
            if p[3]:
                pages.append(p)
                labels.append(np.array([y[a + i] for i in p[3]], np.float32))
    if pages:
        lab.fit(pages, labels, max(epochs, -(-450 * 48 // len(pages))))  # at least 450 steps, however few the pages
    return lab


def hash_sample(df: DataFrame, h: Column, most: int, total: int) -> DataFrame:
    """At most `most` rows, those of the least hashes; of a larger table only about twice as many reach the sort."""
    near = F.shiftrightunsigned(h, 11) < int(2.0**53 * min(1.0, 2.0 * most / max(total, 1)))
    return df.where(near).orderBy(h).limit(most)


def main_body(pages: DataFrame, records: DataFrame, *, max_pages: int = 1600, max_chars: int = 20_000) -> DataFrame:
    """(record_id, line_no INT) of the main body's lines, each once.

    pages: final_url, text. At most max_pages of them of less than max_chars characters, chosen by hash, are read by the driver to fit on (the bound of the sample); what recurs is counted over all of them. records: record_id, text to judge,
    null and blank texts have no lines, exact copies of a row give theirs once.
    """
    from .lines import site

    every = pages.where(F.col("text").isNotNull()).select(site(F.col("final_url")).alias("s"), "final_url", "text")
    rows = [(r.s, r.text) for r in hash_sample(every.where(F.length("text") < max_chars).select("s", "text"), F.xxhash64("text"), max_pages, pages.count()).collect()]
    model = pages.sparkSession.sparkContext.broadcast(fit_labeller(rows, *recurrent_lines(every, rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lab = model.value
        for b in batches:
            found = lab.main_lines(b.column(1).to_pylist())
            ids = np.repeat(b.column(0).to_numpy(), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([n for f in found for n in f], pa.int32())], names=["record_id", "line_no"])

    return records.select("record_id", "text").mapInArrow(run, "record_id bigint, line_no int").distinct()
