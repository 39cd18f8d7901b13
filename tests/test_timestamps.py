import datetime as dt

import pytest
from pyspark.sql import functions as F

from sluice.functions.timestamps import iso_text, timestamp_of

CASES = [
    ("auto", "2024-01-02T03:04:05.6Z", "2024-01-02 03:04:05.600"), ("auto", "1700000000123 x", "2023-11-14 22:13:20.123"), ("auto", "17000000001", "2023-11-14 22:13:20.100"),
    ("auto", "2024-13-45", "2025-02-14 00:00:00.000"), ("auto", "Mon, 02 Jan 2006 15:04:05 -0700", "2006-01-02 15:04:05.000"), ("auto", "nothing", None), ("auto", "id 123456789", None),
    ("auto", "x1700000000", None), ("auto", "2024-01-02 1700000000", "2023-11-14 22:13:20.000"), ("iso8601", "2024-1-2 3:4:5.1234", "2024-01-02 03:04:05.123"), ("iso8601", "2024-01-02 25:61:61", "2024-01-03 02:02:01.000"),
    ("rfc2822", "mon, 02 Jan 2006 15:04:05 -0700", None),
]


def test_kinds(spark):
    for kind in ("auto", "iso8601", "rfc2822"):
        own = [c for c in CASES if c[0] == kind]
        df = spark.createDataFrame([(k, c[1]) for k, c in enumerate(own)], "k int, s string")
        got = [r[0] for r in df.orderBy("k").select(F.date_format(timestamp_of(F.col("s"), kind), "yyyy-MM-dd HH:mm:ss.SSS")).collect()]
        assert got == [c[2] for c in own]


@pytest.mark.parametrize("pattern, line, want", [("%d/%m/%Y", "2024/05/06 07:08", "2024-05-06 07:08:00.000"), ("%d/%m/%Y", "06/05/2024", None), ("%H", "2024-05-06", None), ("%Y-%m-%d %H:%M:%S", "2024-05-06", "2024-05-06 00:00:00.000"), ("%Y.%m.%d", "2024.5.6 1:2:3.12", "2024-05-06 01:02:03.000")])
def test_custom(spark, pattern, line, want):
    df = spark.createDataFrame([(line,)], "s string")
    assert df.select(F.date_format(timestamp_of(F.col("s"), "custom", pattern=pattern), "yyyy-MM-dd HH:mm:ss.SSS")).first()[0] == want


def test_column_zone_and_text(spark):
    df = spark.createDataFrame([("a, 2024-01-02 ,b", "Mon, 02 Jan 2006 15:04:05 -0730", dt.datetime(2024, 1, 2, 3, 4, 5, 60000))], "s string, r string, t timestamp")
    row = df.select(timestamp_of(F.col("s"), "auto", 1).cast("string"), timestamp_of(F.col("s"), "auto", 9).cast("string"), timestamp_of(F.col("r"), "rfc2822", honor_tz=True).cast("string"), timestamp_of(F.lit("1700000000999"), "unix", epoch_ms=False).cast("string"), iso_text(F.col("t")), iso_text(F.lit("2024-01-02").cast("timestamp"))).first()
    assert tuple(row) == ("2024-01-02 00:00:00", None, "2006-01-02 22:34:05", "2023-11-14 22:13:20", "2024-01-02T03:04:05.060Z", "2024-01-02T00:00:00Z")
