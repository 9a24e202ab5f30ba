from datetime import datetime, timezone

import pytest

from tidemill.operators.timestamps import normalise_timestamps, parse_instant, read_dictionary

NY, BERLIN, IN, CN = "America/New_York", "Europe/Berlin", "Asia/Kolkata", "Asia/Shanghai"


def us(*a, micro=0):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000 + micro


@pytest.mark.parametrize(
    ("raw", "zone", "order", "want"),
    [
        ("2024-10-19T08:02:14.578143985Z", NY, "MDY", us(2024, 10, 19, 8, 2, 14, micro=578143)),
        ("20240928T171235Z", None, None, us(2024, 9, 28, 17, 12, 35)),
        ("Sat, 19 Oct 2024 08:29:00 +0800", CN, "YMD", us(2024, 10, 19, 0, 29)),
        ("Fri, 19 Oct 2024 08:29:00 +0800", CN, "YMD", None),
        ("2024-10-27 02:30:00", BERLIN, "DMY", us(2024, 10, 27, 0, 30)),  # twice: the first
        ("2024-03-31 02:30:00", BERLIN, "DMY", us(2024, 3, 31, 1, 30)),  # never: offset before
        ("2024-11-03 01:30", NY, "MDY", us(2024, 11, 3, 5, 30)),
        ("2024-11-03T01:29:55-05:00[America/New_York]", NY, "MDY", us(2024, 11, 3, 6, 29, 55)),
        ("2024-10-06", NY, "MDY", us(2024, 10, 6, 4)),
        ("10/05/2024 3:24 PM", NY, "MDY", us(2024, 10, 5, 19, 24)),
        ("10/05/2024 3:24 PM", BERLIN, "DMY", us(2024, 5, 10, 13, 24)),
        ("12:30", NY, "MDY", None),
        ("2024/11/13 08:14", CN, "YMD", us(2024, 11, 13, 0, 14)),
        ("2024-11-01 10:00:00 CST", CN, "YMD", us(2024, 11, 1, 2)),
        ("2024-11-01 10:00:00 CST", NY, "MDY", us(2024, 11, 1, 16)),
        ("2024-11-01 10:00:00 IST", IN, "DMY", us(2024, 11, 1, 4, 30)),
        ("2024-11-20 11:55:08 UTC+01:00", BERLIN, "DMY", us(2024, 11, 20, 10, 55, 8)),
        ("2024-286T05:37:29Z", NY, "MDY", us(2024, 10, 12, 5, 37, 29)),
        ("2023-366T05:37:29Z", NY, "MDY", None),
        ("October 8, 2024 12:05 am", NY, "MDY", us(2024, 10, 8, 4, 5)),
        ("1728216036", NY, "MDY", 1_728_216_036_000_000),
        ("1731037959820", NY, "MDY", 1_731_037_959_820_000),
        ("1728587765947888", NY, "MDY", 1_728_587_765_947_888),
        ("1728587765947888123", NY, "MDY", 1_728_587_765_947_888),
        ("12", NY, "MDY", None),
        ("  2024-10-07\n", BERLIN, "DMY", us(2024, 10, 6, 22)),
        ("0000-00-00 00:00:00", NY, "MDY", None),
        ("2024-13-44T03:12:32Z", NY, "MDY", None),
        ("2024-02-30", NY, "MDY", None),
        ("2024-10-10 25:00:00", NY, "MDY", None),
        ("2024-10-10 13:00 PM", NY, "MDY", None),
        ("2024-10-10 10:00:00", None, None, None),
        ("2024-10-10 10:00:00 XYZ", NY, "MDY", None),
        ("see notice", NY, "MDY", None),
        ("", NY, "MDY", None),
        (None, NY, "MDY", None),
        ("x" * 100_000, NY, "MDY", None),
    ],
)
def test_parse(raw, zone, order, want):
    assert parse_instant(raw, zone, order) == want


def test_rows_come_out_once_and_clashing_names_stay(spark, tmp_path):
    rows = [(1, "2024-10-06", NY, "MDY", 7), (1, "2024-10-06", NY, "MDY", 7), (2, None, NY, "MDY", 8), (3, "", None, None, 9), (4, "2024-10-06", None, None, 9), (5, "1728216036", None, None, 9)]
    df = spark.createDataFrame(rows, "id int, t string, z string, o string, raw int")
    kept = f"file://{tmp_path}/dictionary"
    for _ in range(2):  # the second run finds every text in the kept dictionary
        got = sorted(((r.id, r.raw, r.us) for r in normalise_timestamps(df, "t", "z", "o", "us", kept).collect()), key=str)
        assert got == [(1, 7, us(2024, 10, 6, 4)), (1, 7, us(2024, 10, 6, 4)), (2, 8, None), (3, 9, None), (4, 9, None), (5, 9, 1_728_216_036_000_000)]
    assert read_dictionary(spark, kept).count() == 4
    more = spark.createDataFrame([(6, "2024-10-07", NY, "MDY", 1)], df.schema)
    assert normalise_timestamps(more, "t", "z", "o", "us", kept).first().us == us(2024, 10, 7, 4)
    assert read_dictionary(spark, kept).count() == 5
    with pytest.raises(ValueError):
        normalise_timestamps(df, "t", "z", "o", "raw")


def test_empty_table(spark):
    df = spark.createDataFrame([], "t string, z string, o string")
    assert normalise_timestamps(df, "t", "z", "o").collect() == []
