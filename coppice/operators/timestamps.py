"""Timestamps in many notations and zones to one UTC instant.

A text is parsed into local calendar fields and, where it has one, an explicit zone. A text without a zone is
local to its collector: the zone the collectors table declares or, where that is missing, the zone estimated by
aligning the local times with their ingestion times (`estimate_zones`): of the candidate offset histories the one
with the fewest violations, a violation being an instant after ingestion or one much before it.

Everything is a Column expression; the collectors are joined as a dimension table. Instants are microseconds
since 1970-01-01 UTC as BIGINT, so the session's zone has no influence.

Defined results: null, empty, unparseable or impossible texts, dates alone, local times that never occur, local
times without a collector and numeric dates without a known order give a null instant. A local time that occurs
twice is the later of its instants not after ingestion (null when neither is; without an ingestion time the later).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Zone abbreviations and their offsets in minutes.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "IST": 330, "SGT": 480, "HKT": 480, "AWST": 480, "KST": 540, "JST": 540, "ACST": 570, "ACDT": 630,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "AKST": -540, "AKDT": -480, "HST": -600, "EST": -300, "EDT": -240,
    "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
# zones that are tried by default, offsets all over the day; of zones with one and the same offsets the first stands for all
CANDIDATES = ["UTC", "Asia/Seoul", "Asia/Kolkata", "Europe/London", "Europe/Berlin", "America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles", "Australia/Sydney", "Europe/Athens", "Europe/Moscow", "Asia/Dubai", "Asia/Shanghai", "Asia/Bangkok", "America/Sao_Paulo", "Pacific/Auckland", "Asia/Tokyo"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_AMPM = r"(?:\s*([AaPp]\.?[Mm]\.?))?"
_ZONE = r"\s*([Zz]|[+\-−]\d{2}(?::?\d{2})?|(?:UTC|GMT)[+\-]\d{1,2}(?::?\d{2})?|[A-Z]{2,5})?"
_MON = r"(jan|feb|mar|apr|may|jun|jul|aug|sept?|oct|nov|dec)[a-z]*\.?"
_DAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"

# kind|a|b|c|hour|minute|second|fraction|half of day|zone, fields separated by \u0001
_SEP = "\u0001"


def _to(*parts: str) -> str:
    return _SEP.join(parts)


_FAMILIES = [
    # year first, numeric
    (rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:[Tt]|,?\s+){_TIME}{_AMPM}{_ZONE}$", _to("Y", "$1", "$3", "$4", "$5", "$6", "$7", "$8", "$9", "$10")),
    # compact
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt ](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?{_ZONE}$", _to("Y", "$1", "$2", "$3", "$4", "$5", "$6", "$7", "", "$8")),
    # Korean
    (rf"^(\d{{4}})년\s*(\d{{1,2}})월\s*(\d{{1,2}})일\s+(오전|오후)?\s*(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d+))?)?{_ZONE}$", _to("Y", "$1", "$2", "$3", "$5", "$6", "$7", "$8", "$4", "$9")),
    (rf"^(\d{{4}})년\s*(\d{{1,2}})월\s*(\d{{1,2}})일\s+(오전|오후)?\s*(\d{{1,2}})시(?:\s*(\d{{1,2}})분)?(?:\s*(\d{{1,2}})초)?{_ZONE}$", _to("Y", "$1", "$2", "$3", "$5", "$6", "$7", "", "$4", "$8")),
    # day, month's name, year
    (rf"(?i)^{_DAY}(\d{{1,2}})[\s-]+{_MON}[\s-]+(\d{{4}}),?(?:\s+at)?\s+{_TIME}{_AMPM}(?-i:{_ZONE})$", _to("D", "$3", "$2", "$1", "$4", "$5", "$6", "$7", "$8", "$9")),
    (rf"(?i)^{_DAY}{_MON}\s+(\d{{1,2}}),?\s+(\d{{4}}),?(?:\s+at)?\s+{_TIME}{_AMPM}(?-i:{_ZONE})$", _to("D", "$3", "$1", "$2", "$4", "$5", "$6", "$7", "$8", "$9")),
    # numeric, the order is the collector's
    (rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}|\d{{2}})(?:[Tt]|,?\s+){_TIME}{_AMPM}{_ZONE}$", _to("N", "$1", "$3", "$4", "$5", "$6", "$7", "$8", "$9", "$10")),
    # seconds, milli-, micro- and nanoseconds since 1970
    (r"^(\d{10})(?:[.,](\d+))?$", _to("E", "$1", "", "", "", "", "", "$2", "", "")),
    (r"^(\d{10})(\d{3}|\d{6}|\d{9})$", _to("E", "$1", "", "", "", "", "", "$2", "", "")),
]


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days from 1970-01-01 of a Gregorian date whose year begins in March (January and February belong to y - 1)."""
    leaps = F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400)
    return (y * 365 + leaps + F.floor((F.pmod(m + 9, F.lit(12)) * 153 + 2) / 5) + d - 719469).cast("long")


def parse(df: DataFrame, text: str, order: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds __local_us (local or, for epochs, UTC microseconds) and __offset_us (null: no zone in the text).

    order: the collector's date order, dmy, mdy or ymd; null where unknown. Rows that name no time have a null __local_us.
    """
    s = F.regexp_replace(F.col(text), r"(?U)^\s+|\s+$", "")
    for pattern, to in _FAMILIES:
        s = F.regexp_replace(s, pattern, to)
    # step by step: a column that is used more than once stays a column of its own, so that no expression is written out again
    df = df.withColumn("__s", s)
    df = df.withColumn("__f", F.split(F.when(F.contains("__s", F.lit(_SEP)), F.col("__s")), _SEP))
    f = lambda k: F.col("__f")[k]
    c = F.col
    year = lambda k: F.when(F.length(f(k)) == 2, _int(f(k)) + 2000).when(F.length(f(k)) == 4, _int(f(k)))
    z = F.upper(F.regexp_replace(F.regexp_replace(f(9), "^(?:UTC|GMT)(?=[+-])", ""), "−", "-"))
    df = df.withColumns({
        "__kind": f(0), "__ord": order, "__1": _int(f(1)), "__2": _int(f(2)), "__3": _int(f(3)), "__h": _int(f(4)),
        "__mi": F.when(f(5) == "", 0).otherwise(_int(f(5))), "__sec": F.when(f(6) == "", 0).otherwise(_int(f(6))),
        "__frac": F.rpad(F.substring(f(7), 1, 6), 6, "0").cast("long"), "__half": F.lower(F.substring(f(8), 1, 2)), "__z": z,
        "__mon": F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(f(2), 1, 3))).cast("int"),
        "__y1": year(1), "__y3": year(3), "__short": F.length(f(3)) == 2,
    })
    # a four-digit year stands last, whatever place the order gives it; an order that begins with the year then leaves day and month open
    df = df.withColumns({
        "__y": F.when(c("__kind").isin("Y", "D"), c("__1")).when(c("__ord").isin("dmy", "mdy"), c("__y3")).when((c("__ord") == "ymd") & c("__short"), c("__y1")),
        "__m": F.when(c("__kind") == "D", c("__mon")).when(c("__kind") == "Y", c("__2")).when(c("__ord") == "mdy", c("__1")).otherwise(c("__2")),
        "__d": F.when(c("__kind") != "N", c("__3")).when(c("__ord") == "mdy", c("__2")).when(c("__ord") == "dmy", c("__1")).otherwise(c("__3")),
        "__hour": F.when(c("__half") == "", c("__h")).when(c("__h").between(1, 12), c("__h") % 12 + F.when(c("__half").startswith("p") | (c("__half") == "오후"), 12).otherwise(0)).when((c("__h") == 0) & ~(c("__half").startswith("p") | (c("__half") == "오후")), F.lit(0)),
        "__zh": F.nullif(F.regexp_extract("__z", r"^[+-](\d{1,2}):?(?:\d{2})?$", 1), F.lit("")), "__zm": F.nullif(F.regexp_extract("__z", r"^[+-]\d{1,2}:?(\d{2})$", 1), F.lit("")),
    })
    names = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    df = df.withColumns({
        "__leap": ((c("__y") % 4 == 0) & (c("__y") % 100 != 0)) | (c("__y") % 400 == 0),
        "__off": F.coalesce((_int(c("__zh")) * 60 + F.coalesce(_int(c("__zm")), F.lit(0))) * F.when(c("__z").startswith("-"), -1).otherwise(1), F.try_element_at(names, c("__z"))),
        "__march": F.when(c("__m") <= 2, c("__y") - 1).otherwise(c("__y")),
    })
    last = F.when(c("__m").isin(4, 6, 9, 11), 30).when(c("__m") == 2, F.when(c("__leap"), 29).otherwise(28)).otherwise(31)
    ok = c("__m").between(1, 12) & (c("__d") >= 1) & (c("__d") <= last) & c("__hour").between(0, 23) & c("__mi").between(0, 59) & c("__sec").between(0, 59) & (c("__y") >= 1)
    zone_ok = (c("__z") == "") | (c("__off").between(-18 * 60, 18 * 60) & (F.coalesce(_int(c("__zm")), F.lit(0)) <= 59))
    df = df.withColumns({"__ok": ok & zone_ok, "__days": _days(c("__march"), c("__m"), c("__d"))})
    clock = ((c("__days") * 24 + c("__hour")) * 60 + c("__mi")) * 60 + c("__sec")
    kept = [x for x in df.columns if not x.startswith("__") or x in keep]
    local = F.when(c("__kind") == "E", f(1).try_cast("long") * 1000000 + c("__frac")).when(c("__ok"), clock * 1000000 + c("__frac"))
    offset = F.when(c("__kind") == "E", F.lit(0)).when(c("__z") != "", c("__off")).cast("long") * 60000000
    return settled(df, kept, __local_us=local, __offset_us=offset)


def settled(df: DataFrame, kept: list[str], **made: Column) -> DataFrame:
    """kept and made columns. Predicates on the made ones stay above this point: pushed down, they would write out the whole parse for each use."""
    row = F.struct(*[v.alias(k) for k, v in made.items()])
    return df.select(*[F.col(f"`{x}`") for x in kept], F.inline(F.array(row)))


def _shift(us: Column, zone: Column) -> Column:
    """The local clock of a UTC instant, both in microseconds; independent of the session's zone."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def resolve(df: DataFrame, local: str, zone: str, received_us: str, to: str) -> DataFrame:
    """Adds the instant of a local time: the offsets a day before and after give the two candidates at a change of offset."""
    day = 86_400_000_000
    at = lambda shift: F.col(local) - (_shift(F.col(local) + shift, F.col(zone)) - (F.col(local) + shift))
    df = df.withColumns({"__a": at(-day), "__b": at(day)})
    df = df.withColumns({"__early": F.when(_shift(F.least("__a", "__b"), F.col(zone)) == F.col(local), F.least("__a", "__b")), "__late": F.when(_shift(F.greatest("__a", "__b"), F.col(zone)) == F.col(local), F.greatest("__a", "__b"))})
    fits = lambda c: F.col(received_us).isNull() | (F.col(c) <= F.col(received_us))
    twice = F.col("__early") != F.col("__late")
    kept = [x for x in df.columns if x not in ("__a", "__b", "__early", "__late", to)]
    return settled(df, kept, **{to: F.when(twice, F.when(fits("__late"), F.col("__late")).when(fits("__early"), F.col("__early"))).otherwise(F.coalesce("__late", "__early"))})


def estimate_zones(local_rows: DataFrame, key: str, candidates: list[str], slack_minutes: int = 90, most_bad: float = 0.8) -> DataFrame:
    """(key, estimated_zone, violations, n): the candidate zone that aligns a key's local times best with ingestion.

    local_rows: key, __local_us, received_us. A violation is an instant after its ingestion, more than slack_minutes
    before it, or a local time that never occurs. Ties go to the zone with the least time to ingestion, then to the first candidate.
    The zone is null where more than most_bad of the rows violate even the best one: none of the candidates is it. One shuffle of keys x candidates rows.
    Empty input or no candidates: no rows; keys that are null are left out.
    """
    zones = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(z).alias("zone")) for i, z in enumerate(candidates)]) if candidates else F.expr("cast(array() as array<struct<rank:int,zone:string>>)")
    tried = local_rows.where(F.col(key).isNotNull() & F.col("received_us").isNotNull()).select(key, "__local_us", "received_us", F.explode(zones).alias("z"))
    tried = resolve(tried.withColumn("__zone", F.col("z.zone")), "__local_us", "__zone", "received_us", "__at")
    lag = F.col("received_us") - F.col("__at")
    bad = F.when(lag.between(0, slack_minutes * 60_000_000), 0).otherwise(1)
    per = tried.groupBy(key, "z.rank", "z.zone").agg(F.sum(bad).alias("violations"), F.coalesce(F.sum(F.when(bad == 0, lag)), F.lit(0)).alias("lag"), F.count("*").alias("n"))
    best = F.min(F.struct("violations", "lag", "rank", "zone", "n")).alias("b")
    return per.groupBy(key).agg(best).select(key, F.when(F.col("b.violations") <= most_bad * F.col("b.n"), F.col("b.zone")).alias("estimated_zone"), F.col("b.violations").alias("violations"), F.col("b.n").alias("n"))


def normalise_timestamps(df: DataFrame, collectors: DataFrame, *, text: str, collector: str = "collector_id", received: str = "received_at", candidates: list[str] | None = None) -> DataFrame:
    """df with instant_us BIGINT. collectors: collector_id, time_zone, date_order (a dimension table).

    Zones that the collectors declare are used as they are; the zones of collectors without one are estimated over
    all of the table's zoneless rows. Columns of df are kept, the added names are instant_us and zone_source
    ('text', 'declared', 'estimated', null without an instant); columns of these names are replaced.
    """
    df = df.drop("instant_us", "zone_source")
    dim = collectors.select(F.col("collector_id").alias("__cid"), F.col("time_zone").alias("__tz"), F.col("date_order").alias("__order"))
    dim = dim.where(F.col("__cid").isNotNull()).groupBy("__cid").agg(F.min("__tz").alias("__tz"), F.min("__order").alias("__order"))
    rows = df.join(dim, df[collector] == dim["__cid"], "left")
    rows = rows.withColumn("__recv_us", F.unix_micros(F.col(received)))
    rows = parse(rows, text, F.col("__order"), keep=("__cid", "__tz", "__recv_us"))
    if candidates is None:
        candidates = CANDIDATES
    open_rows = rows.where(F.col("__local_us").isNotNull() & F.col("__offset_us").isNull() & F.col("__cid").isNotNull() & F.col("__tz").isNull())
    est = estimate_zones(open_rows.select("__cid", "__local_us", F.col("__recv_us").alias("received_us")), "__cid", candidates)
    rows = rows.join(est.select(F.col("__cid").alias("__eid"), "estimated_zone"), F.col("__cid") == F.col("__eid"), "left")
    rows = rows.withColumn("__zone", F.when(F.col("__offset_us").isNull(), F.coalesce("__tz", "estimated_zone")))
    rows = resolve(rows, "__local_us", "__zone", "__recv_us", "__resolved")
    instant = F.when(F.col("__offset_us").isNotNull(), F.col("__local_us") - F.col("__offset_us")).otherwise(F.col("__resolved"))
    source = F.when(F.col("__offset_us").isNotNull(), "text").when(F.col("__tz").isNotNull(), "declared").otherwise("estimated")
    out = rows.withColumn("instant_us", instant).withColumn("zone_source", F.when(F.col("instant_us").isNotNull(), source))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "instant_us", "zone_source")
