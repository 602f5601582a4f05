"""Time texts of mixed formats, precisions and zones as one UTC instant.

A text is reduced to its shape (digits to 9, letters to a); each distinct shape is mapped to a parser once per worker, and all texts of one
shape are cut at the same places and converted together. Wall times go through a table of zone transitions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from pathlib import Path
from re import _parser
from zoneinfo import TZPATH, ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Zone abbreviations and their offsets from UTC in minutes.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "SGT": 480, "HKT": 480, "JST": 540, "AEST": 600, "AEDT": 660,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
# Month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

DATE = r"(?:a{3,9},? )?(?:(?P<y>9999)(?P<s1>[-./])(?P<mo>99?)(?P=s1)(?P<d>99?)|(?P<cy>9999)(?P<cmo>99)(?P<cd>99)|(?P<p1>99?)(?P<s2>[-./])(?P<p2>99?)(?P=s2)(?P<py>9999)|(?P<nd>99?)[ -](?P<nm>aaa)[ -](?P<ny>9999))"
TIME = r"(?:(?P<h>99?):(?P<mi>99)(?::(?P<s>99)(?:[.,](?P<f>9{1,9}))?)?|(?P<ch>99)(?P<cmi>99)(?:(?P<cs>99)(?P<cf>9{0,9}))?)"
ZONE = r"(?:(?P<zulu>a)| (?P<half>aa)|(?: (?P<half2>aa))? ?(?P<sign>[+-])(?P<oh>99)(?::?(?P<om>99))?|(?: (?P<half3>aa))? (?P<abbr>aa{2,4}))?"
SHAPE = re.compile(rf"{DATE}(?P<t> |a|, ){TIME}{ZONE}")
EPOCH = re.compile(r"(?P<whole>9{10}|9{13}|9{16}|9{19}|9)(?:\.(?P<part>9{1,9}))?")
# The longest text that any shape of the grammar fits.
LONGEST = max(_parser.parse(p.pattern).getwidth()[1] for p in (SHAPE, EPOCH))
# Zone tables hold the transitions of these years; a wall time outside them is no instant.
YEARS = (1900, 2200)
# A day's length and an epoch's unit by its number of digits, in microseconds (19 digits: nanoseconds).
DAY_US = 86_400_000_000


@dataclass
class ZoneTable:
    """Offsets of zones by instant: rows (zone, from_us, offset_us), under the version of the zone database they came from."""

    version: str
    starts: dict[str, np.ndarray] = field(default_factory=dict)
    offsets: dict[str, np.ndarray] = field(default_factory=dict)

    def offset_at(self, zone: str, instant: np.ndarray) -> np.ndarray:
        return self.offsets[zone][np.searchsorted(self.starts[zone], instant, "right")]

    def to_utc(self, zone: str, wall: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(earlier, later, exists) instants of wall times; both equal where the wall time occurs once."""
        a, b = (wall - self.offset_at(zone, wall + s * DAY_US) for s in (-1, 1))
        ok_a, ok_b = (u + self.offset_at(zone, u) == wall for u in (a, b))
        one, two = np.where(ok_a, a, b), np.where(ok_b, b, a)
        inside = (wall >= _year_us(YEARS[0])) & (wall < _year_us(YEARS[1]))
        return np.minimum(one, two), np.maximum(one, two), (ok_a | ok_b) & inside


def database_version() -> str:
    for folder in TZPATH:
        listing = Path(folder, "tzdata.zi")
        if listing.exists():
            return listing.open().readline().rpartition(" ")[2].strip()
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


def _year_us(year: int) -> int:
    return (datetime(year, 1, 1) - datetime(1970, 1, 1)).days * DAY_US


@lru_cache(maxsize=1024)
def _transitions(zone: str) -> tuple[np.ndarray, np.ndarray]:
    """Transitions in YEARS (and two days around them), found by weekly samples that are then halved to the second."""
    z, origin = ZoneInfo(zone), datetime(1970, 1, 1, tzinfo=timezone.utc)
    offset = lambda s: int((origin + timedelta(seconds=s)).astimezone(z).utcoffset().total_seconds())
    at, end = (_year_us(y) // 1_000_000 + d * 172_800 for y, d in zip(YEARS, (-1, 1)))
    starts, offsets, week = [], [offset(at)], 7 * 86_400
    while at < end:
        lo, hi, last = at, at + week, offsets[-1]
        if offset(hi) != last:
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if offset(mid) == last else (lo, mid)
            starts.append(hi * 1_000_000)
            offsets.append(offset(hi))
        at = hi
    return np.array(starts, np.int64), np.array(offsets, np.int64) * 1_000_000


def zone_table(zones: list[str]) -> ZoneTable:
    """The table for the named zones; names the database doesn't have are left out."""
    table = ZoneTable(database_version())
    for zone in sorted(set(zones)):
        try:
            table.starts[zone], table.offsets[zone] = _transitions(zone)
        except (KeyError, ValueError, OSError):
            continue
    return table


def shape_of(text: Column) -> Column:
    digits, letters = "0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, digits + letters, "9" * len(digits) + "a" * len(letters))


def _number(codes: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(codes), np.int64)
    for i in range(*span):
        out = out * 10 + (codes[:, i].astype(np.int64) - 48)
    return out


def _words(codes: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    part = np.ascontiguousarray(codes[:, span[0] : span[1]])
    return part.view(f"<U{span[1] - span[0]}").ravel()


def _micros(codes: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    digits = span[1] - span[0]
    value = _number(codes, span)
    return value * 10 ** (6 - digits) if digits <= 6 else value // 10 ** (digits - 6)


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(days since 1970-01-01, whether the date exists) of the proleptic Gregorian calendar."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    lengths = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(m, 0, 12)] + (leap & (m == 2))
    good = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= lengths)
    safe = lambda a, low: np.where(good, a, low)
    yy, mm, dd = safe(y, 1970), safe(m, 1), safe(d, 1)
    months = (yy - 1970) * 12 + mm - 1
    return months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + dd - 1, good


class Parser:
    """Converts all texts of one shape. None of its work depends on the texts except through their characters."""

    def __init__(self, shape: str) -> None:
        self.epoch, self.civil = EPOCH.fullmatch(shape), SHAPE.fullmatch(shape)

    def __bool__(self) -> bool:
        return bool(self.epoch or self.civil)

    def read(self, texts: np.ndarray, month_first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(value, explicit, good): the instant where the text says its zone, else the wall time, in microseconds."""
        n = len(texts)
        codes = np.ascontiguousarray(texts.astype(str)).view(np.uint32).reshape(n, -1)
        if self.epoch:
            span, unit = self.epoch.span("whole"), self.epoch.end("whole") - self.epoch.start("whole")
            whole = _number(codes, span)
            value = whole // 1000 if unit == 19 else whole * {1: 1_000_000, 10: 1_000_000, 13: 1000, 16: 1}[unit]
            if self.epoch["part"] and unit <= 10:
                value = value + _micros(codes, self.epoch.span("part"))
            return value, np.ones(n, bool), value != 0
        m = self.civil
        num = lambda name: _number(codes, m.span(name))
        if m["y"]:
            y, mo, d = num("y"), num("mo"), num("d")
        elif m["cy"]:
            y, mo, d = num("cy"), num("cmo"), num("cd")
        elif m["py"]:
            one, two, y = num("p1"), num("p2"), num("py")
            mo, d = np.where(month_first, one, two), np.where(month_first, two, one)
        else:
            y, d = num("ny"), num("nd")
            names = np.char.lower(_words(codes, m.span("nm")))
            mo = np.zeros(n, np.int64)
            for i, name in enumerate(MONTHS):
                mo[names == name] = i + 1
        days, good = _days(y, mo, d)
        if m["t"] == "a":
            good &= np.isin(_words(codes, m.span("t")), ["T", "t"])
        pre = "" if m["h"] else "c"
        h, mi = num(pre + "h"), num(pre + "mi")
        s = num(pre + "s") if m[pre + "s"] else np.zeros(n, np.int64)
        us = _micros(codes, m.span(pre + "f")) if m[pre + "f"] else 0
        for half in ("half", "half2", "half3"):
            if m[half]:
                word = np.char.upper(_words(codes, m.span(half)))
                good &= np.isin(word, ["AM", "PM"]) & (h >= 1) & (h <= 12)
                h = h % 12 + 12 * (word == "PM")
        good &= (h < 24) & (mi < 60) & (s < 60)
        wall = days * DAY_US + ((h * 60 + mi) * 60 + s) * 1_000_000 + us
        good &= wall != 0
        explicit, offset = np.zeros(n, bool), np.zeros(n, np.int64)
        if m["zulu"]:
            explicit[:] = True
            good &= np.isin(_words(codes, m.span("zulu")), ["Z", "z"])
        elif m["sign"]:
            explicit[:] = True
            oh, om = num("oh"), num("om") if m["om"] else np.zeros(n, np.int64)
            good &= (oh <= 18) & (om < 60)
            offset = (oh * 60 + om) * np.where(_words(codes, m.span("sign")) == "-", -1, 1)
        elif m["abbr"]:
            explicit[:] = True
            names = np.char.upper(_words(codes, m.span("abbr")))
            known = np.zeros(n, bool)
            for name, minutes in ABBREVIATIONS.items():
                hit = names == name
                known |= hit
                offset[hit] = minutes
            good &= known
        value = wall - offset * 60_000_000
        return value, explicit, good & (value != 0)


@lru_cache(maxsize=100_000)
def parser_for(shape: str) -> Parser | None:
    parser = Parser(shape) if len(shape) <= LONGEST else None
    return parser or None


def converter(table: ZoneTable):
    """A pandas UDF (text, shape, zone, shift_hours, month_first) -> struct(lo, hi): the first and last instant the text may denote, null if none."""

    @F.pandas_udf("lo long, hi long")
    def convert(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for text, shape, zone, shift, month_first in batches:
            n = len(text)
            lo, hi, have = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
            texts, zones = text.to_numpy(), zone.to_numpy()
            shifts = shift.fillna(0).to_numpy(np.int64) * 3_600_000_000
            first = month_first.fillna(False).to_numpy(bool)
            for mask, rows in shape.groupby(shape, sort=False).indices.items():
                parser = parser_for(mask)
                if parser is None:
                    continue
                value, explicit, good = parser.read(texts[rows], first[rows])
                take = good & explicit
                lo[rows[take]] = hi[rows[take]] = value[take]
                have[rows[take]] = True
                naive = good & ~explicit
                for name in pd.unique(zones[rows[naive]]):
                    if not isinstance(name, str) or name not in table.starts:
                        continue
                    at = rows[naive & (zones[rows] == name)]
                    wall = value[naive & (zones[rows] == name)] - shifts[at]
                    lo[at], hi[at], have[at] = table.to_utc(name, wall)
            yield pd.DataFrame({"lo": pd.array(lo, "Int64"), "hi": pd.array(hi, "Int64")}).where(pd.Series(have), pd.NA)

    return convert


def parse_texts(rows: DataFrame, table: ZoneTable) -> DataFrame:
    """rows (text, zone, shift_hours, month_first and any others) with lo and hi: equal for a certain instant, apart for a wall time that occurs twice, null for none.

    A text without zone is on the wall clock of its zone plus shift_hours; zone UTC for texts that are UTC as they stand. Surrounding
    white space and double quotes are ignored. Blank texts, placeholders, the clock's zero and dates or times that don't
    exist (in the calendar or on that clock) give null, as do texts of an unknown zone or shape.
    """
    clean = F.regexp_replace("text", r'^[\s\p{Z}"\x{FEFF}]+|[\s\p{Z}"\x{FEFF}]+\z', "")
    convert = converter(table)
    out = rows.withColumn("_clean", clean).where(F.length("_clean").between(1, LONGEST))
    return out.withColumn("_c", convert("_clean", shape_of(F.col("_clean")), "zone", "shift_hours", "month_first")).withColumn("lo", F.col("_c.lo")).withColumn("hi", F.col("_c.hi")).drop("_c", "_clean")
