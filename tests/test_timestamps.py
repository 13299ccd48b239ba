import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from coppice.operators.timestamps import estimate_zones, normalise_timestamps

COLLECTORS = [(1, "Asia/Seoul", "ymd"), (3, "Europe/Berlin", "dmy"), (4, "America/New_York", "mdy"), (9, None, "dmy")]
ROWS = "k int, written string, collector_id int, received_at timestamp, zone_source string"


def run(spark, rows):
    df = spark.createDataFrame([(i, w, c, r, "clash") for i, (w, c, r) in enumerate(rows)], ROWS)
    dim = spark.createDataFrame(COLLECTORS, "collector_id int, time_zone string, date_order string")
    out = {r.k: r for r in normalise_timestamps(df, dim, text="written").collect()}
    return [out[i].instant_us for i in range(len(rows))], out


def us(*a, **k):
    return int((datetime(*a, tzinfo=timezone.utc, **k) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


def test_notations(spark):
    late = datetime(2030, 1, 1, tzinfo=timezone.utc)
    cases = [
        ("2024-02-29T16:11:28.752975+00:00", 1, us(2024, 2, 29, 16, 11, 28, 752975)), (" 2024-02-29T16:11:28z ", None, us(2024, 2, 29, 16, 11, 28)), ("2023-03-01T07:17:39.112-05", None, us(2023, 3, 1, 12, 17, 39, 112000)),
        ("20240613T031418Z", None, us(2024, 6, 13, 3, 14, 18)), ("2025년 2월 11일 오전 10:40", 1, us(2025, 2, 11, 1, 40)), ("2022년 11월 21일 5시 16분 50초", 1, us(2022, 11, 20, 20, 16, 50)), ("2023년 1월 6일 오후 12:05", 1, us(2023, 1, 6, 3, 5)),
        ("Sun, 06 Nov 2022 04:15:26 +0900", None, us(2022, 11, 5, 19, 15, 26)), ("Aug 24, 2024 16:34:25", 3, us(2024, 8, 24, 14, 34, 25)), ("13 Dec 2024 04:18:30 JST", None, us(2024, 12, 12, 19, 18, 30)), ("04/10/2024 23:56:01", 4, us(2024, 4, 11, 3, 56, 1)),
        ("04/10/2024 23:56", 3, us(2024, 10, 4, 21, 56)), ("28/02/24 08:52:32 PM", 3, us(2024, 2, 28, 19, 52, 32)), ("22/03/27 01:00", 1, us(2022, 3, 26, 16)), ("1714385430.96", None, us(2024, 4, 29, 10, 10, 30, 960000)),
        ("1734827846887249", None, 1734827846887249), ("1704927489677", None, 1704927489677000), ("2025-01-28T20:11:29.641540351Z", None, us(2025, 1, 28, 20, 11, 29, 641540)), ("2024-01-31T13:53:04,069+01:00", None, us(2024, 1, 31, 12, 53, 4, 69000)),
    ]
    got, _ = run(spark, [(w, c, late) for w, c, _ in cases])
    assert got == [x for _, _, x in cases]


def test_no_instant(spark):
    late = datetime(2030, 1, 1, tzinfo=timezone.utc)
    bad = [(None, 1), ("", 1), ("yesterday", 1), ("2023-10-14", 1), ("2025-01", 1), ("2024-08-23T25:61:00Z", 1), ("0000-00-00 00:00:00", 1), ("2023-02-30 10:00:00", 1), ("2024-01-01 10:00:00", None), ("04/10/2024 23:56:01Z", None), ("13/13/2024 10:00", 3),
           ("2024-01-01 10:00:00 QQQ", 1), ("2024-03-31 02:30:00", 3), ("2024-01-01 13:00:00 PM", 1), ("2024-01-01 10:00:00", 77), ("x" * 20000, 1)]
    got, _ = run(spark, [(w, c, late) for w, c in bad])
    assert got == [None] * len(bad)


def test_twice_in_autumn(spark):
    early, later = us(2024, 10, 27, 0, 30), us(2024, 10, 27, 1, 30)
    at = lambda t: datetime.fromtimestamp(t / 1e6, timezone.utc)
    got, _ = run(spark, [("2024-10-27 02:30:00", 3, at(later + 1)), ("2024-10-27 02:30:00", 3, at(later - 1)), ("2024-10-27 02:30:00", 3, at(early - 1)), ("2024-10-27 02:30:00", 3, None)])
    assert got == [later, early, None, later]


def test_random_local_times_against_zoneinfo(spark):
    r = random.Random(4)
    rows, want = [], []
    for _ in range(300):
        c, zone = r.choice([(1, "Asia/Seoul"), (3, "Europe/Berlin"), (4, "America/New_York")])
        local = datetime(r.randint(1999, 2035), r.randint(1, 12), r.randint(1, 28), r.randint(0, 23), r.randint(0, 59), r.randint(0, 59))
        both = {int(local.replace(tzinfo=ZoneInfo(zone), fold=f).timestamp()) for f in (0, 1)}
        real = [t for t in both if datetime.fromtimestamp(t, ZoneInfo(zone)).replace(tzinfo=None) == local]
        rows.append((local.strftime("%Y-%m-%d %H:%M:%S"), c, None))
        want.append(max(real) * 1_000_000 if real else None)
    got, _ = run(spark, rows)
    assert got == want


def test_missing_zone_is_estimated(spark):
    zone, rows = ZoneInfo("Asia/Kolkata"), []
    for d in range(1, 25):
        at = datetime(2024, 5, d, 6, 7, 8, tzinfo=timezone.utc)
        rows.append((at.astimezone(zone).strftime("%Y-%m-%d %H:%M:%S"), 9, at + timedelta(minutes=7 + d)))
    rows.append(("2024-05-01 00:00:00", 9, datetime(2024, 7, 1, tzinfo=timezone.utc)))
    got, out = run(spark, rows)
    assert got[0] == us(2024, 5, 1, 6, 7, 8)
    assert out[0].zone_source == "estimated"


def test_empty_table(spark):
    got, _ = run(spark, [("2024-01-01T00:00:00Z", 1, None)])
    assert got == [us(2024, 1, 1)]
    df = spark.createDataFrame([], ROWS)
    dim = spark.createDataFrame([], "collector_id int, time_zone string, date_order string")
    assert normalise_timestamps(df, dim, text="written").count() == 0
    assert estimate_zones(spark.createDataFrame([], "c int, __local_us bigint, received_us bigint"), "c", []).count() == 0
