"""Texts cut into overlapping pieces of limited length at natural boundaries, by one bounded-quantifier regex.

Each step of the regex takes at most (limit - overlap) characters, the first at most limit: up to the end of the
text, else the last paragraph break in reach, else the last line break, sentence end, clause end or white space,
else just as many characters. A piece is a step with the overlap characters before it. All lengths are in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# boundaries by strength; each is what a step may end behind
BOUNDARIES = [r"\n\s*\n", r"\n", r"[.!?。？！]['\"”’)\]]*[ \t]+|다\.[ \t]+", r"[,;:，、][ \t]+", r"\s"]


def pattern(limit: int, overlap: int, least: float = 0.4) -> str:
    def steps(reach: int) -> list[str]:
        low = max(1, int(reach * least))
        ends = [rf".{{1,{reach}}}\z"]
        for i, b in enumerate(BOUNDARIES):
            m = low if i < len(BOUNDARIES) - 1 else max(1, low // 4)
            ends.append(rf".{{{m},{reach}}}(?<=" + "|".join(_behind(x) for x in [b]) + ")")
        return [*ends, rf".{{1,{reach}}}"]

    first = "|".join(steps(limit))
    rest = "|".join(steps(limit - overlap))
    return rf"(?s)\A(?:{first})|(?:{rest})"


def _behind(boundary: str) -> str:
    """A lookbehind of bounded length for a boundary."""
    return {BOUNDARIES[0]: r"\n[ \t]{0,8}\n", BOUNDARIES[1]: r"\n", BOUNDARIES[2]: r"[.!?。？！]['\"”’)\]]{0,3}[ \t]{1,4}", BOUNDARIES[3]: r"[,;:，、][ \t]{1,4}", BOUNDARIES[4]: r"\s"}[boundary]


def pieces(text: Column, limit: int = 900, overlap: int = 120) -> Column:
    """ARRAY<STRUCT<char_start: INT, char_end: INT>> of the pieces of a text, offsets from 0, end exclusive; empty for an empty text, null for null."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    lengths = F.transform(F.regexp_extract_all(text, F.lit(pattern(limit, overlap)), F.lit(0)), F.length)
    none = F.expr("cast(array() as array<struct<char_start:int,char_end:int>>)")

    def add(acc: Column, n: Column) -> Column:
        at = acc["at"]
        piece = F.struct(F.greatest(at - overlap, F.lit(0)).alias("char_start"), (at + n).alias("char_end"))
        return F.struct((at + n).alias("at"), F.concat(acc["done"], F.array(piece)).alias("done"))

    return F.aggregate(lengths, F.struct(F.lit(0).alias("at"), none.alias("done")), add, lambda acc: acc["done"])


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 900, overlap: int = 120) -> DataFrame:
    """(key, piece_no INT, char_start BIGINT, char_end BIGINT, piece STRING) of the texts longer than limit.

    Texts of at most limit code points, empty and null ones give no rows; exact copies of a row give the same rows
    again. Each piece is text[char_start:char_end] in code points, and all pieces without their overlaps join to the text.
    """
    long = df.where(F.length(text) > limit)
    rows = long.select(F.col(key).alias(key), F.col(text).alias("__text"), F.posexplode(pieces(F.col(text), limit, overlap)).alias("__no", "__p"))
    return rows.select(
        key, (F.col("__no") + 1).alias("piece_no"), F.col("__p.char_start").cast("bigint").alias("char_start"), F.col("__p.char_end").cast("bigint").alias("char_end"),
        F.substring("__text", F.col("__p.char_start") + 1, F.col("__p.char_end") - F.col("__p.char_start")).alias("piece"),
    )
