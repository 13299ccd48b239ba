"""Fetched pages: HTML to title, text and links, chunks, snippets as units, crawl frontier; providers are protocols."""

from __future__ import annotations

import html
import ipaddress
import re
import socket
from collections.abc import Callable, Iterator
from typing import Protocol
from urllib.parse import parse_qs, urldefrag, urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

PAGE = "url string, final_url string, status int, content_type string, title string, text string, bytes_read bigint, truncated boolean, discovered_links array<string>, error string"
SEARCH_RESULT = "title string, url string, snippet string, web_rank int, provider string"


class SearchProvider(Protocol):
    def search(self, query: str, max_results: int) -> list[dict]: ...


class FetchProvider(Protocol):
    def fetch(self, url: str) -> dict: ...


def clean_html(text: str) -> str:
    """Visible text: scripts, styles and tags gone, block ends as line breaks, entities resolved, white space reduced."""
    t = re.sub(r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " ", text or "")
    t = re.sub(r"(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6]|section|article|ul|ol|table)\s*>", "\n", t)
    t = html.unescape(re.sub(r"<[^>]+>", " ", t))
    lines = (re.sub(r"[ \t\r\f\v\xa0]+", " ", l).strip() for l in t.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def html_title(text: str) -> str:
    m = re.search(r"(?is)<title[^>]*>(.*?)</title>", text or "")
    return " ".join(html.unescape(m.group(1)).split()) if m else ""


def html_links(text: str, base: str, most: int = 24) -> list[str]:
    """Distinct http(s) links to the page's own host without fragment and parameters, in order, at most `most`."""
    host, out = urlparse(base).hostname, []
    for href in re.findall(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)""", text or ""):
        if href.lower().startswith(("javascript:", "mailto:", "tel:", "#")):
            continue
        u = urlparse(urldefrag(urljoin(base, html.unescape(href)))[0])._replace(params="")
        if u.scheme in ("http", "https") and u.hostname == host and u.geturl() not in out:
            out.append(u.geturl())
    return out[:most]


def decode(raw: bytes, content_type: str = "") -> str:
    m = re.search(r"charset=([\w-]+)", content_type or "", re.I)
    for codec in filter(None, [m and m.group(1), "utf-8", "cp949", "euc-kr", "latin-1"]):
        try:
            return raw.decode(codec)
        except (UnicodeDecodeError, LookupError):
            continue
    return raw.decode("utf-8", "ignore")


def chunk_text(text: str, max_chars: int = 900, overlap: int = 120, min_chars: int = 160) -> list[tuple[str, int, int]]:
    """Paragraphs packed into chunks of at most max_chars; long paragraphs are sliced with overlap; short leftovers are dropped unless alone."""
    out: list[tuple[str, int, int]] = []
    begun: tuple[int, int] | None = None
    spans = [(m.start(), m.end()) for m in re.finditer(r"(?s)\S.*?(?=\n\s*\n|\Z)", text or "")]
    for s, e in [*spans, (None, None)]:
        if s is not None and begun and e - begun[0] <= max_chars:
            begun = (begun[0], e)
            continue
        if begun and begun[1] - begun[0] >= min_chars:
            at, end = begun
            while end - at > max_chars:
                out.append((text[at : at + max_chars], at, at + max_chars))
                at += max_chars - overlap
            out.append((text[at:end], at, end))
        begun = (s, e) if s is not None else None
    return out


def is_public_host(host: str) -> bool:
    """Whether all addresses of a host are public; unresolvable hosts are not."""
    try:
        return all(ipaddress.ip_address(a[4][0]).is_global for a in socket.getaddrinfo(host, None))
    except (OSError, ValueError):
        return False


def parse_pages(pages: DataFrame, html_col: str = "html", url: str = "url") -> DataFrame:
    """Adds title, text and discovered_links to rows with raw HTML; null HTML gives empty ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h, u = b[html_col].fillna(""), b[url].fillna("")
            yield b.assign(title=h.map(html_title), text=h.map(clean_html), discovered_links=[html_links(x, y) for x, y in zip(h, u)])

    rest = [f for f in pages.schema.fields if f.name not in ("title", "text", "discovered_links")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", title string, text string, discovered_links array<string>"
    return pages.select(*[f.name for f in rest]).mapInPandas(run, schema)


def fetch(urls: DataFrame, provider: FetchProvider, *, max_pages: int | None = None, max_bytes: int = 2_500_000, max_chars: int = 180_000, public: Callable[[str], bool] = is_public_host) -> DataFrame:
    """Fetches a column url in tasks; pos keeps the order of the input, max_pages its first rows. Errors become rows with error set.

    provider.fetch gives the columns of PAGE or, as raw bytes with a content_type, an answer that is cut to max_bytes and read here. Hosts
    that are not public are refused before the fetch and after a redirect.
    """
    if max_pages is not None:
        urls = urls.orderBy("pos").limit(max_pages)

    def refusal(u: str) -> str | None:
        p = urlparse(u or "")
        return "empty_url" if not u else "unsupported_scheme" if p.scheme not in ("http", "https") else "missing_hostname" if not p.hostname else None if public(p.hostname) else "blocked_hostname"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for pos, u in zip(b["pos"], b["url"]):
                base = {"pos": pos, "url": u, "final_url": u, "status": None, "content_type": "", "title": "", "text": "", "bytes_read": 0, "truncated": False, "discovered_links": [], "error": refusal(u)}
                if not base["error"]:
                    try:
                        got = provider.fetch(u)
                        base |= read_answer(got, u, max_bytes, max_chars) if "raw" in got else got
                        if base["final_url"] != u and (late := refusal(base["final_url"])):
                            base |= {"title": "", "text": "", "discovered_links": [], "error": late}
                    except Exception as e:  # noqa: BLE001 - one bad page must not fail the task
                        base["error"] = f"fetch_error:{type(e).__name__}"
                rows.append(base)
            yield pd.DataFrame(rows)

    return urls.select("pos", "url").mapInPandas(run, "pos bigint, " + PAGE)


def read_answer(got: dict, url: str, max_bytes: int = 2_500_000, max_chars: int = 180_000) -> dict:
    """Columns of PAGE from {raw, content_type, final_url, status}: HTML, other text, or an error for PDFs and pictures, which need an extractor."""
    raw, kind, final = got["raw"][:max_bytes], (got.get("content_type") or "").lower(), got.get("final_url") or url
    out = {"final_url": final, "status": got.get("status"), "content_type": kind, "bytes_read": len(raw), "truncated": len(got["raw"]) > max_bytes, "error": None}
    if "pdf" in kind or kind.startswith("image/"):
        return out | {"error": "pdf_no_text" if "pdf" in kind else "image_no_text"}
    text = decode(raw, kind)
    if "html" in kind or re.search(r"(?i)<html|<body|<p\b", text[:2000]):
        out |= {"title": html_title(text), "discovered_links": html_links(text, final)}
        text = clean_html(text)
    text = text.strip()
    return out | {"text": text[:max_chars], "truncated": out["truncated"] or len(text) > max_chars, "error": None if text else "empty_text"}


def crawl(seeds: DataFrame, provider: FetchProvider, *, depth: int = 0, max_pages: int = 4, **options) -> DataFrame:
    """Pages of PAGE with crawl_depth: the seeds (pos, url), then the links of what was fetched that were not visited yet, depth by depth (at most 2), at most max_pages each."""
    done, live, visited = None, seeds, None
    for level in range(min(max(depth, 0), 2) + 1):
        pages = cut(fetch(live, provider, max_pages=max_pages, **options).withColumn("crawl_depth", F.lit(level)))
        done = pages if done is None else done.unionByName(pages)
        seen = pages.select("url").unionByName(pages.select(F.col("final_url").alias("url"))).where(F.col("url").isNotNull())
        visited = seen if visited is None else visited.unionByName(seen)
        if level < depth:
            fresh = frontier(pages, visited)
            live = fresh.orderBy("url").limit(max_pages).withColumn("pos", F.monotonically_increasing_id())
    return done


def page_chunks(pages: DataFrame, key: str, *, most: int = 10, **options) -> DataFrame:
    """(key, chunk_no, content, char_start, char_end): the chunks of each page's text, at most `most` of a page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, t, s, e) for k, text in zip(b[key], b["text"]) for i, (t, s, e) in enumerate(chunk_text(text or "", **options)[:most])]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "content", "char_start", "char_end"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, "text").mapInPandas(run, f"`{key}` {kind}, chunk_no int, content string, char_start bigint, char_end bigint")


def page_units(pages: DataFrame, confidence: float = 0.60) -> DataFrame:
    """Chunks of readable pages as evidence units; other columns of the pages' first row with a final_url are kept: web_rank, n_passes where given."""
    kept = [c for c in ("web_rank", "n_passes") if c in pages.columns]
    ok = pages.where(page_ok()).groupBy(F.coalesce("final_url", "url").alias("doc_id")).agg(F.min_by("text", "pos").alias("text"), F.min_by("title", "pos").alias("title"), *[F.min(c).alias(c) for c in kept])
    rows = page_chunks(ok, "doc_id").join(ok.drop("text"), "doc_id")
    return rows.select(
        F.xxhash64("doc_id", "chunk_no").alias("unit_ix"), "doc_id", F.lit("web_page_text").alias("source_type"), "content", F.col("title").alias("section_path"), "char_start", "char_end",
        F.lit(None).cast("string").alias("timestamp"), F.lit(confidence).alias("confidence"), F.lit(None).cast("string").alias("canonical_entity_id"), *kept,
    )


def page_ok() -> Column:
    return F.col("error").isNull() & (F.trim(F.coalesce("text", F.lit(""))) != "")


def frontier(pages: DataFrame, visited: DataFrame) -> DataFrame:
    """(url): links of pages that were not visited yet, each once."""
    links = pages.select(F.explode("discovered_links").alias("url")).distinct()
    return links.join(visited.select("url").distinct(), "url", "left_anti")


def with_result(pages: DataFrame, results: DataFrame) -> DataFrame:
    """pages with web_rank and n_passes of the search result they came from, by url or else by final_url; pages found by crawling have none."""
    r = lambda k: results.select(F.col("url").alias(k), F.struct("web_rank", "n_passes").alias(f"{k}_r"))
    both = pages.drop("web_rank", "n_passes").join(r("url"), "url", "left").join(r("final_url"), "final_url", "left")
    hit = F.coalesce("url_r", "final_url_r")
    return both.select(*pages.columns, hit["web_rank"].alias("web_rank"), F.coalesce(hit["n_passes"], F.lit(1)).alias("n_passes"))


def snippet_units(results: DataFrame, confidence: float = 0.62) -> DataFrame:
    """Search results as evidence units; those without url or text are left out."""
    text = F.trim(F.coalesce("snippet", F.lit("")))
    return results.where(F.col("url").isNotNull() & (text != "")).select(
        F.col("result_id").alias("unit_ix"), F.col("url").alias("doc_id"), F.lit("web_snippet").alias("source_type"), text.alias("content"), F.col("title").alias("section_path"),
        F.lit(0).cast("bigint").alias("char_start"), F.length(text).cast("bigint").alias("char_end"), F.lit(None).cast("string").alias("timestamp"), F.lit(confidence).alias("confidence"), F.lit(None).cast("string").alias("canonical_entity_id"),
    )


def parse_search_page(raw: str, provider: str = "duckduckgo", most: int = 10) -> list[dict]:
    """Results of a search engine's HTML page: links of class result__a with the snippets behind them; redirects are unwrapped, rank is the link's place."""
    out = []
    parts = re.split(r'(?i)(?=<a\b[^>]*class="[^"]*result__a)', raw or "")[1:]
    for rank, part in enumerate(parts, 1):
        href = re.search(r'(?is)href="([^"]+)"', part)
        title = re.search(r"(?is)<a\b[^>]*>(.*?)</a>", part)
        snippet = re.search(r'(?is)class="[^"]*result__snippet[^"]*"[^>]*>(.*?)</', part)
        url = unwrap(html.unescape(href.group(1))) if href else ""
        if url and title:
            out.append({"title": clean_html(title.group(1)), "url": url, "snippet": clean_html(snippet.group(1)) if snippet else "", "web_rank": rank, "provider": provider})
    return out[:most]


def unwrap(url: str) -> str:
    """The target of a redirect link (its uddg parameter), else the link itself with a scheme."""
    if url.startswith("//"):
        url = "https:" + url
    target = parse_qs(urlparse(url).query).get("uddg")
    return target[0] if target else url


def parse_search_json(payload: dict, provider: str = "searxng", most: int = 10) -> list[dict]:
    """Results of a JSON search service; rows without title or url are left out, ranks stay those of the answer."""
    rows = [{"title": (r.get("title") or "").strip(), "url": (r.get("url") or "").strip(), "snippet": (r.get("content") or "").strip(), "web_rank": i, "provider": provider} for i, r in enumerate(payload.get("results") or [], 1)]
    return [r for r in rows if r["title"] and r["url"]][:most]


def parse_snapshots(rows: list[list[str]], most: int = 10) -> list[dict]:
    """Archive snapshots (a header row, then timestamp, original, status ...) as results."""
    if not rows:
        return []
    names = rows[0]
    out = []
    for i, r in enumerate(rows[1:], 1):
        x = dict(zip(names, r))
        out.append({"title": f"{x.get('original', '')} {x.get('timestamp', '')}", "url": f"https://web.archive.org/web/{x.get('timestamp', '')}/{x.get('original', '')}", "snippet": f"status {x.get('statuscode', '')}", "web_rank": i, "provider": "wayback"})
    return out[:most]
