"""Problem 6: time texts of mixed format, precision and zone become instants.

The parser works on a dictionary of distinct (text, zone, date order) keys: every
key is parsed once however often it occurs, the dictionary can be kept and extended
run by run, and the instants are joined back to the rows.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.session import fresh_path

#: Part of the dictionary's path: entries parsed under another grammar are not reused.
GRAMMAR_VERSION = 1

#: Years that a bare number may stand for.
PLAUSIBLE_YEARS = (1990, 2099)

_EPOCH = dt.datetime(1970, 1, 1)
_DAY_US = 86_400_000_000
_UNITS = (1_000_000, 1_000, 1, 0.001)  # microseconds in a second, millisecond, microsecond, nanosecond

_MONTHS = {m: i for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1)}
_MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
_DAY_NAMES = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

#: Hours of abbreviations that a jurisdiction's own zone does not define.
_ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "MSK": 3,
    "IST": 5.5, "SGT": 8, "HKT": 8, "AWST": 8, "JST": 9, "KST": 9, "ACST": 9.5, "AEST": 10, "ACDT": 10.5, "AEDT": 11,
    "AST": -4, "ADT": -3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
}

_NUMBER = re.compile(r"([+-]?)(\d+)(?:\.(\d+))?")
_BRACKET = re.compile(r"\s*\[([A-Za-z_]+(?:/[A-Za-z0-9_+\-]+)*)\]$")
_OFFSET = re.compile(r"(?<=[\d\sMm.TCt])\s*(?:UTC|GMT)?\s*([+-])(\d{2})(?::?(\d{2}))?$")
_ZULU = re.compile(r"(?<=[\d\s])\s*[Zz]$")
_ABBR = re.compile(r"(?<=[\d\sMm.])\s*([A-Z]{2,5})$")
_CLOCK = re.compile(r"(?:^|[\sTt,])\s*(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*([AaPp]\.?[Mm]\.?)?$")
_CLOCK_12 = re.compile(r"(?:^|[\s,])\s*(\d{1,2})\s*([AaPp]\.?[Mm]\.?)$")
_BASIC_CLOCK = re.compile(r"[Tt](\d{2})(?:(\d{2})(?:(\d{2})(?:[.,](\d+))?)?)?$")
_WEEKDAY = re.compile(r"^([A-Za-z]{3,9})\.?,?\s+")
_Y_FIRST = re.compile(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})")
_BASIC_DATE = re.compile(r"(\d{4})(\d{2})(\d{2})")
_ORDINAL = re.compile(r"(\d{4})-(\d{3})")
_WEEK = re.compile(r"(\d{4})-?W(\d{2})(?:-?(\d))?")
_NUMERIC = re.compile(r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})")
_CJK = re.compile(r"(\d{4})年(\d{1,2})月(\d{1,2})日")
_D_MON_Y = re.compile(r"(\d{1,2})(?:st|nd|rd|th)?[\s\-]+([A-Za-z]{3,9})\.?,?[\s\-]+(\d{4})")
_MON_D_Y = re.compile(r"([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})")


@lru_cache(maxsize=256)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


@lru_cache(maxsize=256)
def _own_abbreviations(name: str) -> dict[str, int]:
    """Abbreviation → offset in microseconds, as the zone itself has used them since 1990."""
    out: dict[str, int] = {}
    z = _zone(name)
    if z is not None:
        for year in range(2035, 1989, -1):
            for month in range(1, 13):
                t = dt.datetime(year, month, 15, 12, tzinfo=z)
                out.setdefault(t.tzname() or "", int(t.utcoffset() / dt.timedelta(microseconds=1)))
    return out


def _month(word: str) -> int | None:
    w = word.lower()
    if w[:3] in _MONTHS and (len(w) == 3 or w == _MONTH_NAMES[_MONTHS[w[:3]] - 1] or w == "sept"):
        return _MONTHS[w[:3]]
    return None


def _date(text: str, order: str | None) -> dt.date | None:
    if m := _Y_FIRST.fullmatch(text):
        return dt.date(int(m[1]), int(m[3]), int(m[4]))
    if m := _BASIC_DATE.fullmatch(text):
        return dt.date(int(m[1]), int(m[2]), int(m[3]))
    if m := _ORDINAL.fullmatch(text):
        d = dt.date(int(m[1]), 1, 1) + dt.timedelta(days=int(m[2]) - 1)
        return d if d.year == int(m[1]) and int(m[2]) else None
    if m := _WEEK.fullmatch(text):
        return dt.date.fromisocalendar(int(m[1]), int(m[2]), int(m[3] or 1))
    if m := _CJK.fullmatch(text):
        return dt.date(int(m[1]), int(m[2]), int(m[3]))
    if m := _NUMERIC.fullmatch(text):
        a, b, c = int(m[1]), int(m[3]), int(m[4])
        if len(m[4]) == 4:  # the year stands last, so a YMD office can only mean day, month or month, day
            if order == "MDY":
                return dt.date(c, a, b)
            return dt.date(c, b, a) if order == "DMY" else None
        if order == "YMD":
            return dt.date(2000 + a, b, c)
        if order == "MDY":
            return dt.date(2000 + c, a, b)
        return dt.date(2000 + c, b, a) if order == "DMY" else None
    if (m := _D_MON_Y.fullmatch(text)) and (mon := _month(m[2])):
        return dt.date(int(m[3]), mon, int(m[1]))
    if (m := _MON_D_Y.fullmatch(text)) and (mon := _month(m[1])):
        return dt.date(int(m[3]), mon, int(m[2]))
    return None


def _micros_of_number(m: re.Match) -> int | None:
    if m[1] == "-":
        return None
    whole, frac = int(m[2]), m[3] or ""
    for unit in _UNITS:
        us = whole * unit if unit >= 1 else whole // 1000
        if unit > 1 and frac:
            us += int((frac + "0" * 6)[:6]) * unit // 1_000_000
        if 0 <= us < 253_402_300_800_000_000 and PLAUSIBLE_YEARS[0] <= (_EPOCH + dt.timedelta(microseconds=int(us))).year <= PLAUSIBLE_YEARS[1]:
            return int(us)
    return None


def parse_instant(raw: str | None, zone: str | None, date_order: str | None) -> int | None:
    """Microseconds since 1970-01-01 UTC that ``raw`` states, or None.

    ``zone`` is the IANA zone of texts that name none (without it they state no
    instant), ``date_order`` one of DMY, MDY, YMD for all-number dates.
    """
    try:
        return _parse(raw, zone, date_order)
    except (ValueError, OverflowError):  # no such day, hour or offset
        return None


def _parse(raw: str | None, zone: str | None, order: str | None) -> int | None:
    if raw is None:
        return None
    s = " ".join(raw.split()).strip("​﻿\"'")
    if not s:
        return None
    if m := _NUMBER.fullmatch(s):
        if (us := _micros_of_number(m)) is not None:
            return us
        if len(s) not in (8, 12, 14):
            return None
        if len(s) > 8:  # a basic date and clock written together
            s = s[:8] + "T" + s[8:]
    offset: int | None = None
    local = zone
    if m := _BRACKET.search(s):
        s = s[: m.start()]
        if _zone(m[1]) is None:
            return None
        local = m[1]
    clocked = ":" in s or re.search(r"\d[Tt]\d", s) or re.search(r"\d\s*[AaPp]\.?[Mm]", s)
    if m := _ZULU.search(s):
        offset, s = 0, s[: m.start()]
    elif clocked and (m := _OFFSET.search(s)):
        hours, minutes = int(m[2]), int(m[3] or 0)
        if hours > 15 or minutes > 59:
            return None
        offset = (hours * 60 + minutes) * 60_000_000 * (-1 if m[1] == "-" else 1)
        s = s[: m.start()]
    elif (m := _ABBR.search(s)) and m[1] not in ("AM", "PM"):
        own = _own_abbreviations(zone) if zone else {}
        if m[1] in own:
            offset = own[m[1]]
        elif m[1] in _ABBREVIATIONS:
            offset = int(_ABBREVIATIONS[m[1]] * 3_600_000_000)
        else:
            return None
        s = s[: m.start()]
    s = s.rstrip()
    h = mi = sec = us = 0
    if m := _CLOCK.search(s):
        h, mi, sec = int(m[1]), int(m[2]), int(m[3] or 0)
        us = int(((m[4] or "") + "000000")[:6])
        s, half = s[: m.start()], m[5]
    elif m := _CLOCK_12.search(s):
        h, half, s = int(m[1]), m[2], s[: m.start()]
    elif m := _BASIC_CLOCK.search(s):
        h, mi, sec = int(m[1]), int(m[2] or 0), int(m[3] or 0)
        us = int(((m[4] or "") + "000000")[:6])
        s, half = s[: m.start()], None
    else:
        half = None
    if half:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if half[0] in "Pp" else 0)
    carry = 0
    if h == 24 and mi == sec == us == 0:  # the end of the day
        h, carry = 0, 1
    s = s.strip().rstrip(",").strip()
    weekday = None
    if (m := _WEEKDAY.match(s)) and (m[1].lower() in _DAYS or m[1].lower() in _DAY_NAMES):
        weekday, s = m[1].lower()[:3], s[m.end() :]
    day = _date(s, order)
    if day is None or day.year < 1600:
        return None
    if weekday and _DAYS[day.weekday()] != weekday:
        return None
    at = dt.datetime(day.year, day.month, day.day, h, mi, sec, us) + dt.timedelta(days=carry)
    if offset is None:
        z = _zone(local) if local else None
        if z is None:
            return None
        # fold 0: the first of two equal local times; before a gap, the offset still in force
        offset = int(at.replace(tzinfo=z, fold=0).utcoffset() / dt.timedelta(microseconds=1))
    since = at - _EPOCH
    return since.days * _DAY_US + since.seconds * 1_000_000 + since.microseconds - offset


_DICT_SCHEMA = T.StructType(
    [
        T.StructField("raw", T.StringType()),
        T.StructField("zone", T.StringType()),
        T.StructField("date_order", T.StringType()),
        T.StructField("instant_us", T.LongType()),
    ]
)


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        none = lambda x: None if x is None or x != x else x
        out = [parse_instant(none(r), none(z), none(o)) for r, z, o in zip(b["raw"], b["zone"], b["date_order"])]
        yield b.assign(instant_us=pd.array(out, dtype="Int64"))


def _committed(spark: SparkSession, path: str) -> list[str]:
    """The batches of the dictionary at ``path``; what is still being written begins with _."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return sorted(f.getPath().toString() for f in fs.listStatus(p) if not f.getPath().getName().startswith(("_", ".")))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """The dictionary as it is now, each key once.

    Two runs at a time may both have parsed a key: they parsed it alike, so one is taken.
    """
    batches = _committed(spark, f"{path}/v{GRAMMAR_VERSION}")
    if not batches:
        return spark.createDataFrame([], _DICT_SCHEMA)
    d = spark.read.schema(_DICT_SCHEMA).parquet(*batches)
    if len(batches) == 1:
        return d
    return d.groupBy("raw", "zone", "date_order").agg(F.min("instant_us").alias("instant_us"))


def extend_dictionary(keys: DataFrame, path: str) -> DataFrame:
    """Parse the distinct (raw, zone, date_order) of ``keys`` that the dictionary at
    ``path`` lacks, add them to it, and return the whole dictionary.

    The new entries are written beside the dictionary and join it by one rename, so a
    reader sees all of a batch or nothing, and a run that breaks off leaves it as it was.
    """
    spark = keys.sparkSession
    new = keys.select("raw", "zone", "date_order").distinct()
    if _committed(spark, f"{path}/v{GRAMMAR_VERSION}"):
        new = new.alias("n").join(read_dictionary(spark, path).alias("k"), _same("n", "k"), "left_anti")
    name = uuid.uuid4().hex
    beside, batch = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{GRAMMAR_VERSION}/{n}") for n in (f"_{name}", name))
    fs = beside.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        new.mapInPandas(_parse_batches, _DICT_SCHEMA).write.parquet(beside.toString())
        if not spark.read.schema(_DICT_SCHEMA).parquet(beside.toString()).isEmpty() and not fs.rename(beside, batch):
            raise OSError(f"{batch.toString()} could not be published")
    finally:
        fs.delete(beside, True)
    return read_dictionary(spark, path)


def _same(a: str, b: str) -> Column:
    on = [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in ("raw", "zone", "date_order")]
    return on[0] & on[1] & on[2]


def normalise_timestamps(rows: DataFrame, raw: str, zone: str, date_order: str, out: str = "instant_us", dictionary: str | None = None) -> DataFrame:
    """``rows`` with the column ``out``: the instant that the text column ``raw`` states.

    ``zone`` and ``date_order`` are columns too. Texts that state no instant, null and
    blank texts give null; every row comes out once, repeated rows included, other
    columns unchanged (``out`` must be a new name). ``dictionary`` is the path of a
    kept dictionary that later runs extend; without it a new one is written to the
    shared folder.
    """
    if out in rows.columns:
        raise ValueError(f"column {out} exists already")
    key = lambda c, n: F.col(f"`{c}`").cast("string").alias(n)
    keys = rows.where(F.col(f"`{raw}`").isNotNull()).select(key(raw, "raw"), key(zone, "zone"), key(date_order, "date_order"))
    d = extend_dictionary(keys, dictionary or fresh_path(rows.sparkSession, "instants"))
    d = d.where("instant_us IS NOT NULL").select(*(F.col(c).alias(f"__d_{c}") for c in d.columns))
    on = F.col(f"`{raw}`") == F.col("__d_raw")
    for c, n in ((zone, "zone"), (date_order, "date_order")):
        on = on & F.col(f"`{c}`").eqNullSafe(F.col(f"__d_{n}"))
    return rows.join(d, on, "left").select(*(F.col(f"`{c}`") for c in rows.columns), F.col("__d_instant_us").alias(out))
