import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from redloom.operators.timestamps import ABBREVIATIONS, normalise_timestamps
from redloom.session import path_exists, table

US = timedelta(microseconds=1)
EPOCH = datetime(1970, 1, 1)

CASES = [
    ("2024-03-21T03:11:50Z", None, "2024-03-21 03:11:50"),
    ("  2024-03-21t03:11:50.1234567z\xa0", "Asia/Tokyo", "2024-03-21 03:11:50.123456"),
    ("2024-03-05T23:25:54+05:30", "UTC", "2024-03-05 17:55:54"),
    ("2021-05-19T12:46:52−04:00", None, "2021-05-19 16:46:52"),
    ("2024-04-21 07:50:16", "Europe/Berlin", "2024-04-21 05:50:16"),
    ("2024-04-21 07:50:16", None, None),
    ("2024-04-21 07:50:16", "No/Where", None),
    ("2024-04-21 07:50:16 CEST", "Asia/Tokyo", "2024-04-21 05:50:16"),
    ("2024-04-21 07:50:16 QQQ", "Asia/Tokyo", None),
    ("2022-04-02T23:07:47+05:30[Asia/Kolkata]", None, "2022-04-02 17:37:47"),
    ("2022-09-23 16:48:27 America/New_York", "UTC", "2022-09-23 20:48:27"),
    ("3/9/2024 5:30 am", "UTC", "2024-03-09 05:30:00"),
    ("3/9/2024 12:30 AM", "UTC", "2024-03-09 00:30:00"),
    ("12/31/2024 12:05 PM", "UTC", "2024-12-31 12:05:00"),
    ("3.9.2024, 05:30", "UTC", "2024-09-03 05:30:00"),
    ("Apr 7, 2024 at 7:59 PM", "UTC", "2024-04-07 19:59:00"),
    ("Wed, 29 Sep 2021 21:30:40 +0545", None, "2021-09-29 15:45:40"),
    ("31 October 2023 12:06", "UTC", "2023-10-31 12:06:00"),
    ("20240229T215709", "UTC", "2024-02-29 21:57:09"),
    ("1761610452", "Asia/Tokyo", "2025-10-28 00:14:12"),
    ("1761610452123", None, "2025-10-28 00:14:12.123000"),
    ("1761610452123456", None, "2025-10-28 00:14:12.123456"),
    ("2023-11-05 01:30:00", "America/New_York", "2023-11-05 05:30:00"),  # occurs twice: the earlier
    ("2023-03-12 02:30:00", "America/New_York", "2023-03-12 07:30:00"),  # skipped: the offset before
    ("2023-02-29 10:00:00", "UTC", None),
    ("2024-13-04T08:00:00Z", None, None),
    ("0000-00-00T00:00:00Z", None, None),
    ("2024-03-29T14:61:00Z", None, None),
    ("2024-09-12T25:10:00Z", None, None),
    ("13:00 pm", "UTC", None),
    ("2024-06-17", "UTC", None),
    ("2024-07", "UTC", None),
    ("n/a", "UTC", None),
    ("", "UTC", None),
    (None, "UTC", None),
]


def test_notations(spark):
    df = spark.createDataFrame([(i, r, z) for i, (r, z, _) in enumerate(CASES)], "k int, raw string, zone string")
    got = {r["k"]: r["utc_us"] for r in normalise_timestamps(df, "raw", "zone", "t", spread="k").collect()}
    want = {i: None if w is None else (datetime.fromisoformat(w) - EPOCH) // US for i, (_, _, w) in enumerate(CASES)}
    assert {CASES[k][0]: v for k, v in got.items()} == {CASES[k][0]: v for k, v in want.items()}


def test_clashing_columns_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "2024-01-01T00:00:00Z", None, "a", 7)] * 3, "k int, raw string, zone string, `n.m` string, utc_us int")
    rows = normalise_timestamps(df, "raw", "zone", "t", spread="k").collect()
    assert len(rows) == 3 and rows[0]["n.m"] == "a" and rows[0]["utc_us"] == 1704067200000000
    assert normalise_timestamps(df.where("false"), "raw", "zone", "t", spread="k").count() == 0


def test_dictionary_grows_only_by_new_values(spark, tmp_path):
    kept = "file://" + str(tmp_path / "dict")
    one = spark.createDataFrame([(1, "2024-01-01T00:00:00Z", None)], "k int, raw string, zone string")
    two = spark.createDataFrame([(1, "2024-01-01T00:00:00Z", None), (2, "2024-01-02T00:00:00Z", None)], "k int, raw string, zone string")
    assert normalise_timestamps(one, "raw", "zone", "t", spread="k", dictionary=kept).count() == 1
    assert normalise_timestamps(two, "raw", "zone", "t", spread="k", dictionary=kept).where("utc_us is not null").count() == 2
    assert path_exists(spark, kept + "/v1") and spark.read.parquet(kept + "/v1").count() == 2


def test_hot_value(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "2024-01-01T00:00:00Z").otherwise(F.concat(F.lit("17000000"), F.lpad("id", 5, "0"))).alias("raw"), F.lit(None).cast("string").alias("zone"))
    from redloom.operators import skew

    old, skew.HOT_ROWS = skew.HOT_ROWS, 100
    try:
        assert normalise_timestamps(df, "raw", "zone", "t", spread="k").where("utc_us is not null").count() == 3000
    finally:
        skew.HOT_ROWS = old


MONTH = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}


def brute(raw, zone):
    """Another parser: by pieces, with Python's own zones."""
    if raw is None:
        return None
    t = " ".join(raw.replace("\xa0", " ").replace(" ", " ").replace("−", "-").split())
    if t.isdigit():
        return int(t) * {10: 1_000_000, 13: 1000, 16: 1}[len(t)]
    date = re.search(r"(\d{4})-(\d\d)-(\d\d)", t) or re.match(r"(\d{4})(\d\d)(\d\d)(?=[Tt])", t)
    if date:
        y, m, d = map(int, date.groups())
    elif x := re.match(r"(\d+)/(\d+)/(\d{4})", t):
        m, d, y = map(int, x.groups())
    elif x := re.match(r"(\d+)\.(\d+)\.(\d{4})", t):
        d, m, y = map(int, x.groups())
    elif x := re.search(r"(\d+) ([A-Za-z]+) (\d{4})", t):
        d, m, y = int(x[1]), MONTH[x[2][:3].lower()], int(x[3])
    elif x := re.search(r"([A-Za-z]{3}) (\d+), (\d{4})", t):
        d, m, y = int(x[2]), MONTH[x[1].lower()], int(x[3])
    else:
        return None
    clock = re.search(r"(\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d+))?)?(.*)$", t) or re.search(r"[Tt](\d\d)(\d\d)(\d\d)()(.*)$", t)
    if not clock:
        return None
    h, mi, s, f, rest = int(clock[1]), int(clock[2]), int(clock[3] or 0), (clock[4] or "0")[:6].ljust(6, "0"), clock[5].strip()
    if x := re.match(r"([ap])m$", rest, re.I):
        h, rest = h % 12 + 12 * (x[1].lower() == "p"), ""
    try:
        wall = datetime(y, m, d, h, mi, s, int(f))
    except ValueError:
        return None
    if x := re.match(r"([+-])(\d\d):?(\d\d)?(?:\[.*\])?$", rest):
        minutes = (int(x[2]) * 60 + int(x[3] or 0)) * (-1 if x[1] == "-" else 1)
        return (wall - timedelta(minutes=minutes) - EPOCH) // US
    if rest.upper() in ABBREVIATIONS:
        return (wall - timedelta(minutes=ABBREVIATIONS[rest.upper()]) - EPOCH) // US
    name = rest or zone
    if not name:
        return None
    return (wall.replace(tzinfo=ZoneInfo(name), fold=0).astimezone(timezone.utc).replace(tzinfo=None) - EPOCH) // US


@pytest.mark.parametrize("name", ["comment_labels", "revision_labels"])
def test_against_brute_force(spark, name):
    df = table(spark, "/root/testdata/sf0.01", name).select("date_raw", "tz_name")
    rows = normalise_timestamps(df.withColumn("k", F.monotonically_increasing_id()), "date_raw", "tz_name", name, spread="k").collect()
    wrong = [(r["date_raw"], r["tz_name"], r["utc_us"], w) for r in rows if r["utc_us"] != (w := brute(r["date_raw"], r["tz_name"]))]
    assert not wrong, wrong[:5]
