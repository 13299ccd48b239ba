"""Scalar text functions as Columns, with Python twins for the few texts that the driver handles."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_HANGUL = "[가-힣]"


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def language(c: Column) -> Column:
    """ko, en, mixed or unknown by the counts of Hangul and Latin letters; null counts as unknown."""
    ko = F.regexp_count(c, F.lit(_HANGUL))
    en = F.regexp_count(c, F.lit("[a-zA-Z]"))
    ratio = ko / en
    return (
        F.when(c.isNull() | ((ko == 0) & (en == 0)), "unknown").when(en == 0, "ko").when(ko == 0, "en")
        .when(ratio > 1.6, "ko").when(ratio < 0.6, "en").otherwise("mixed")
    )


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(squeezed(c), F.lit("[a-z0-9가-힣]+"), F.lit(0))


def tokens(c: Column, sizes: tuple[int, ...] = (2, 3)) -> Column:
    """Words and, for Korean and mixed texts, the character n-grams (marked cg:) of words with Hangul; repeats kept."""
    words = word_tokens(c)
    grams = lambda t: F.flatten(F.array(*[_grams(t, n) for n in sizes]))
    extra = F.flatten(F.transform(F.filter(words, lambda t: t.rlike(_HANGUL) & (F.length(t) >= 2)), grams))
    return F.when(language(squeezed(c)).isin("ko", "mixed"), F.concat(words, extra)).otherwise(words)


def _grams(t: Column, n: int) -> Column:
    starts = F.when(F.length(t) >= n, F.sequence(F.lit(1), F.length(t) - (n - 1))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda i: F.concat(F.lit("cg:"), t.substr(i, F.lit(n))))


def tokens_py(text: str, grams: bool = True) -> list[str]:
    s = re.sub(r"\s+", " ", (text or "").strip().lower())
    words = re.findall("[a-z0-9가-힣]+", s)
    if grams and language_py(s) in ("ko", "mixed"):
        words += [f"cg:{w[i:i + n]}" for w in words if re.search(_HANGUL, w) for n in (2, 3) for i in range(len(w) - n + 1)]
    return words


def language_py(text: str) -> str:
    ko, en = len(re.findall(_HANGUL, text or "")), len(re.findall("[a-zA-Z]", text or ""))
    if not ko or not en:
        return "ko" if ko else "en" if en else "unknown"
    return "ko" if ko / en > 1.6 else "en" if ko / en < 0.6 else "mixed"


def sentences(c: Column) -> Column:
    """Trimmed sentences: ends at .!? before white space and at line breaks; a text without any is one sentence if not blank."""
    parts = F.filter(F.transform(F.split(c, r"(?U)(?<=[.!?])\s+|\n+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")
    return F.coalesce(parts, F.expr("cast(array() as array<string>)"))


def short_hash(c: Column) -> Column:
    """Eight hex digits of h = h * 131 + code point modulo 2^32."""
    h = F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0).cast("bigint"), lambda a, x: (a * 131 + F.ascii(x)).bitwiseAND(F.lit(4294967295)))
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def masked_entity(c: Column) -> Column:
    """Partly masked identifiers in one form: mail addresses cut, runs of letters reduced to their ends, masked digits marked."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"([a-z0-9._%+-]{1,3})[a-z0-9._%+-]*(@[a-z0-9.-]+\.[a-z]{2,})", "$1***$2")
    s = F.regexp_replace(s, r"([a-z])[a-z*]{1,}([a-z])", "$1*$2")
    s = F.regexp_replace(s, r"([가-힣])[가-힣*]{1,}([가-힣])", "$1*$2")
    s = F.regexp_replace(s, r"(\d{2,})[-_]?[*xX]{2,}(\d{0,})", "$1***$2")
    return F.regexp_replace(s, r"\s+", " ")


def masked_entity_py(text: str) -> str:
    s = text.strip().lower()
    for p, to in (
        (r"([a-z0-9._%+-]{1,3})[a-z0-9._%+-]*(@[a-z0-9.-]+\.[a-z]{2,})", r"\1***\2"), (r"([a-z])[a-z*]{1,}([a-z])", r"\1*\2"),
        (r"([가-힣])[가-힣*]{1,}([가-힣])", r"\1*\2"), (r"(\d{2,})[-_]?[*xX]{2,}(\d{0,})", r"\1***\2"), (r"\s+", " "),
    ):
        s = re.sub(p, to, s)
    return s


_DATES = (r"(?U)\b(20\d{2})[-/](0?\d{1,2})[-/](0?\d{1,2})\b", r"(?U)\b(20\d{2})\.(0?\d{1,2})\.(0?\d{1,2})\b", r"(?U)\b(20\d{2})년\s*(0?\d{1,2})월\s*(0?\d{1,2})일\b")


def dates(c: Column) -> Column:
    """Distinct sorted dates YYYY-MM-DD that a text names; months over 12 and days over 31 are left out."""
    def found(p: str) -> Column:
        part = lambda g: F.regexp_extract_all(c, F.lit(p), F.lit(g))
        return F.transform(F.arrays_zip(part(1).alias("y"), part(2).alias("m"), part(3).alias("d")), lambda x: F.struct(x["y"].alias("y"), x["m"].cast("int").alias("m"), x["d"].cast("int").alias("d")))

    every = F.concat(*[found(p) for p in _DATES])
    fine = F.filter(every, lambda x: x["m"].between(1, 12) & x["d"].between(1, 31))
    return F.sort_array(F.array_distinct(F.transform(fine, lambda x: F.format_string("%s-%02d-%02d", x["y"], x["m"], x["d"]))))


def shard(doc_id: Column, shards: int) -> Column:
    """The shard of a document: the first four bytes of its SHA-1 as a number, modulo the number of shards."""
    return F.pmod(F.conv(F.substring(F.sha1(doc_id), 1, 8), 16, 10).cast("bigint"), F.lit(shards)).cast("int")
