"""Search language, modes, passes and aliases: what the driver makes of a query before any plan is built."""

from __future__ import annotations

import re
import shlex
from dataclasses import dataclass, field
from datetime import datetime, timezone
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import language_py, masked_entity_py
from ..schema import SOURCE_TYPES

# Spellings of source types in queries.
SOURCE_NAMES = {
    "text": "text_sentence", "sentence": "text_sentence", "table": "table_cell", "caption": "caption", "ocr": "ocr_text",
    "web": "web_snippet", "snippet": "web_snippet", "page": "web_page_text", "web_page": "web_page_text",
}


@dataclass(frozen=True)
class Filters:
    doc_ids: frozenset[str] = frozenset()
    include: frozenset[str] = frozenset()
    exclude: frozenset[str] = frozenset()
    sections: frozenset[str] = frozenset()
    after: str | None = None
    before: str | None = None

    def as_dict(self) -> dict:
        return {"doc_ids": sorted(self.doc_ids), "include_source_types": sorted(self.include), "exclude_source_types": sorted(self.exclude), "section_prefixes": sorted(self.sections), "after": self.after, "before": self.before}

    def allows_web(self) -> bool:
        """Whether web evidence may answer: its types are asked for or not all excluded, and no section is named."""
        web = {"web_snippet", "web_page_text"}
        return not self.sections and (not self.include or bool(self.include & web)) and not web <= self.exclude


@dataclass(frozen=True)
class Query:
    raw: str
    clean: str
    filters: Filters
    phrases: tuple[str, ...] = ()
    terms: tuple[str, ...] = ()


def parse_query(text: str) -> Query:
    """doc:, source:, -source:, section:, after: and before: become filters, everything else is searched for."""
    try:
        parts = shlex.split(text)
    except ValueError:  # unbalanced quotes stay in the words
        parts = re.findall(r"\"[^\"]+\"|\S+", text)
    values: dict[str, list[str]] = {k: [] for k in ("doc", "source", "-source", "section", "after", "before")}
    terms = []
    for p in parts:
        key, colon, value = p.partition(":")
        if colon and key.lower() in values:
            if value.strip():
                values[key.lower()].append(value.strip())
        else:
            terms.append(p)

    def types(vs: list[str]) -> frozenset[str]:
        names = (v.strip("\"'").lower() for v in vs)
        return frozenset(t for n in names if (t := SOURCE_NAMES.get(n, n)) in SOURCE_TYPES)

    phrases = tuple(re.findall(r'"([^"]+)"', text))
    clean = " ".join(t for t in terms if t).strip() or " ".join(phrases).strip() or text.strip()
    last = lambda k: values[k][-1] if values[k] else None
    return Query(text, clean, Filters(frozenset(values["doc"]), types(values["source"]), types(values["-source"]), frozenset(values["section"]), last("after"), last("before")), phrases, tuple(terms))


def instant(text: str | None) -> datetime | None:
    try:
        at = datetime.fromisoformat((text or "").strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).astimezone(timezone.utc)


def timestamp_column(c: Column) -> Column:
    """An ISO text as a timestamp, without a zone UTC; null where it is none."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(c), "[zZ]$", "Z"), r"(:\d{2}(?:\.\d+)?[+-]\d{2})$", "$1:00"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    zoned = F.when(s.rlike(r"(Z|:\d{2}(\.\d+)?[+-]\d{2}:\d{2})$"), s).otherwise(F.concat(s, F.lit("Z")))
    iso = s.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$")
    return F.when(iso & (F.length(s) == 10), F.concat(s, F.lit("T00:00:00Z"))).when(iso, zoned).try_cast("timestamp")


def predicate(f: Filters, ts: Column | None = None) -> Column:
    """All filters as one predicate. Rows without a readable time pass the bounds; unreadable bounds don't filter."""
    p = F.lit(True)
    if f.doc_ids:
        p &= F.col("doc_id").isin(sorted(f.doc_ids))
    if f.include:
        p &= F.col("source_type").isin(sorted(f.include))
    if f.exclude:
        p &= ~F.col("source_type").isin(sorted(f.exclude))
    if f.sections:
        starts = F.lit(False)
        for s in sorted(f.sections):
            starts |= F.coalesce(F.col("section_path"), F.lit("")).startswith(s)
        p &= starts
    ts = timestamp_column(F.col("timestamp")) if ts is None else ts
    bound = lambda t: F.lit(t.strftime("%Y-%m-%d %H:%M:%S.%f+00:00")).cast("timestamp")
    if (a := instant(f.after)) is not None:
        p &= F.coalesce(ts >= bound(a), F.lit(True))
    if (b := instant(f.before)) is not None:
        p &= F.coalesce(ts <= bound(b), F.lit(True))
    return p


def apply_filters(units: DataFrame, f: Filters) -> DataFrame:
    return units.where(predicate(f))


# ---- modes and passes

# The knobs of each mode.
@dataclass(frozen=True)
class Mode:
    name: str
    min_k: int
    rerank_cap: int
    web_max: int
    web_base: float
    fetch_pages: int
    recency: bool = False
    min_ocr: float = 0.35
    trusted_only: bool = False


MODES = {m.name: m for m in (
    Mode("investigation", 5, 32, 3, 0.25, 2), Mode("sniper", 1, 12, 4, 0.58, 0), Mode("reporter", 8, 64, 6, 0.55, 4, True),
    Mode("fbi", 10, 80, 10, 0.65, 6, True), Mode("llm", 10, 80, 10, 0.65, 6, True), Mode("collection", 8, 32, 12, 0.60, 5),
    Mode("rumor", 10, 48, 10, 0.50, 4), Mode("library", 6, 32, 5, 0.62, 2, False, 0.55, True),
)}
# Other names of the modes.
MODE_NAMES = {
    "journalist": "reporter", "osint": "fbi", "assets": "collection", "gossip": "rumor", "rag": "llm",
    "조사": "investigation", "기자": "reporter", "자료": "collection", "자료수집": "collection", "스나이퍼": "sniper",
    "찌라시": "rumor", "도서관": "library", "심층": "llm", "심층분석": "llm",
}


def mode(name: str | None) -> Mode:
    key = re.sub(r"\s+", "", (name or "investigation").lower())
    short = key.removesuffix("모드")
    return MODES.get(key) or MODES.get(MODE_NAMES.get(key, "")) or MODES.get(short) or MODES.get(MODE_NAMES.get(short, ""), MODES["investigation"])


# Words that the passes add to a query, by its language.
PASS_WORDS = {
    "pass_b_contradict": {"en": "however exception limitation counter evidence unless not", "mixed": "하지만 예외 제한 반대 근거 however exception limitation", "ko": "하지만 예외 제한 반대 근거 단 only if unless limitation"},
    "pass_c_boundary": {"en": "condition timeline scope boundary edge case only if", "mixed": "조건 시점 대상 변경 condition timeline scope", "ko": "조건 시점 대상 변경 경계 사례 edge case boundary"},
    "pass_d_background": {"en": "overview background context history", "ko": "개요 배경 맥락 경과 정리"},
    "pass_e_sources": {"en": "report analysis data evidence", "ko": "리포트 분석 데이터 근거 출처"},
    "pass_f_assets": {"en": "dataset github arxiv pdf repository figures", "ko": "데이터셋 깃허브 arxiv 논문 pdf 리포지토리 이미지"},
    "pass_f_osint": {"en": "metadata robots sitemap cache archive", "ko": "메타데이터 robots sitemap 캐시 아카이브"},
    "pass_g_security_docs": {"en": "security advisory vulnerability disclosure cve", "ko": "보안 권고 취약점 공지 cve"},
}


def passes(query: str, mode_name: str = "investigation") -> list[tuple[str, str]]:
    """(name, text) of the passes of a query in a mode."""
    names = ["pass_b_contradict", "pass_c_boundary"]
    if mode_name in ("reporter", "fbi", "collection", "rumor", "llm"):
        names += ["pass_d_background", "pass_e_sources"]
    if mode_name == "collection":
        names.append("pass_f_assets")
    if mode_name in ("fbi", "llm"):
        names += ["pass_f_osint", "pass_g_security_docs"]
    lang = language_py(query)
    words = lambda n: PASS_WORDS[n].get(lang, PASS_WORDS[n]["ko"])
    return [("pass_a_support", query), *((n, f"{query} {words(n)}".strip()) for n in names)]


# ---- aliases

# The rows of a keyboard; a key's neighbours in its own and the next rows.
KEYBOARD = {
    "q": "wa", "w": "qase", "e": "wsdr", "r": "edft", "t": "rfgy", "y": "tghu", "u": "yhji", "i": "ujko", "o": "iklp", "p": "ol",
    "a": "qwsz", "s": "qweadzx", "d": "wersfxc", "f": "ertdgcv", "g": "rtyfhvb", "h": "tyugjbn", "j": "yuihknm", "k": "uiojlm", "l": "iopk",
    "z": "asx", "x": "zsdc", "c": "xdfv", "v": "cfgb", "b": "vghn", "n": "bhjm", "m": "njk",
}


def aliases(entity: str) -> list[tuple[str, float, str]]:
    """(alias, penalty, reason), best first: the normalised name, its n-grams, keyboard slips, deletions and swaps."""
    name = masked_entity_py(entity)
    if not name:
        return []
    made: list[tuple[str, float, str]] = []
    for token in re.findall(r"[a-zA-Z0-9가-힣@._+-]+", name):
        for n, penalty in ((2, 0.08), (3, 0.12)):
            grams = [token[i : i + n] for i in range(len(token) - n + 1)] if len(token) > n else [token]
            made += [(" ".join(grams), penalty, "ngram"), ("".join(grams), penalty, "ngram")]
        made += [(token[:i] + near + token[i + 1 :], 0.18, "keyboard_typo") for i, ch in enumerate(token) for near in KEYBOARD.get(ch, "")]
    if len(name) >= 3:
        made += [(name[:i] + name[i + 1 :], 0.22, "edit_distance") for i in range(len(name))]
        made += [(name[:i] + name[i + 1] + name[i] + name[i + 2 :], 0.22, "edit_distance") for i in range(len(name) - 1)]
    best = {name: (0.0, "original_normalized")}
    for alias, penalty, reason in made:
        a = masked_entity_py(alias)
        if len(a) >= 2 and penalty < best.get(a, (9.0, ""))[0]:
            best[a] = (penalty, reason)
    return sorted(((a, p, r) for a, (p, r) in best.items()), key=lambda x: (x[1], -len(x[0]), x[0]))


def expansions(query: str, most: int = 5) -> list[tuple[str, float]]:
    """(text, penalty): the query itself and its first aliases, those less like it at a higher penalty."""
    out = [(query, 0.0)]
    for alias, penalty, _ in aliases(query)[:most]:
        if alias != query:
            like = max(SequenceMatcher(None, query, alias).ratio() - 0.2 * abs(len(query) - len(alias)) / max(len(query), 1), 0.0)
            out.append((alias, min(penalty + 0.15 * (1 - like), 0.65)))
    return out
