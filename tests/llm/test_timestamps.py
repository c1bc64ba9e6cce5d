"""Mixed timestamps against a plain reading, and odd tables."""

import random
import re
import zoneinfo
from collections import Counter
from datetime import UTC, datetime, timedelta

import pytest

from stackloom.llm.timestamps import normalise, op11_timestamps, transitions
from tests.llm.util import same_as_sql

MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
SCHEMA = "stamp_id long, source string, zone string, raw string"
EPOCH = datetime(1970, 1, 1)


def micros(t):
    return (t - EPOCH) // timedelta(microseconds=1)


def one(y, m, d):
    try:
        return datetime(int(y), int(m), int(d))
    except ValueError:
        return None


def parse(raw, zone):
    """None if bad, ('epoch', us), or ('date', date, other date, voters, time of day, offset or None)."""
    t = (raw or "").strip(" \t\n\x0b\x0c\r")
    if re.fullmatch("[0-9]{10}", t):
        return "epoch", int(t) * 1_000_000
    if re.fullmatch("[0-9]{13}", t):
        return "epoch", int(t) * 1_000
    m = re.fullmatch(r"(.*?)(?:[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?(?: ?([AP]M))?(?: ?(Z|[+-][0-9]{2}:?[0-9]{2}))?)?", t, re.S)
    date, h, n, s, half, off = m.groups()
    first = other = None
    slashed = False
    if x := re.fullmatch("(20[0-9]{2})-([0-9]{2})-([0-9]{2})", date) or re.fullmatch("(20[0-9]{2})([0-9]{2})([0-9]{2})", date):
        first = one(*x.groups())
    elif x := re.fullmatch(r"([0-9]{2})\.([0-9]{2})\.(20[0-9]{2})", date):
        first = one(x[3], x[2], x[1])
    elif (x := re.fullmatch("([0-9]{2}) ([A-Z][a-z]{2}) (20[0-9]{2})", date)) and x[2] in MONTHS:
        first = one(x[3], MONTHS.index(x[2]) + 1, x[1])
    elif x := re.fullmatch("([0-9]{2})/([0-9]{2})/(20[0-9]{2})", date):
        slashed, first, other = True, one(x[3], x[2], x[1]), one(x[3], x[1], x[2])
    if first is None and other is None:
        return None
    day = timedelta()
    if h:
        h, n, s = int(h), int(n), int(s or 0)
        if n > 59 or s > 59 or (not 1 <= h <= 12 if half else h > 23):
            return None
        day = timedelta(hours=h % 12 + (half == "PM") * 12 if half else h, minutes=n, seconds=s)
    if off and off != "Z":
        a, b = int(off[1:3]), int(off[-2:])
        if a > 14 or b > 59:
            return None
        off = timedelta(hours=a, minutes=b) * (-1 if off[0] == "-" else 1)
    elif off:
        off = timedelta()
    if off is None and zone not in zoneinfo.available_timezones():
        return None
    vote = None if not slashed or (first and other) else "day" if first else "month"
    return "date", first or other, other if slashed and first else None, vote, day, off


def to_utc(wall, zone):
    """(utc, whether the zone skips or repeats this time): by trying both offsets around it."""
    z = zoneinfo.ZoneInfo(zone)
    at = lambda u: u.replace(tzinfo=UTC).astimezone(z).replace(tzinfo=None)
    around = [at(wall + timedelta(hours=k)) - (wall + timedelta(hours=k)) for k in (-26, 26)]
    fits = sorted({wall - o for o in around if at(wall - o) == wall})
    if len(fits) == 1:
        return fits[0], False
    return wall - around[1], True


def plain(rows):
    read = [(i, source, zone, parse(raw, zone)) for i, source, zone, raw in rows]
    votes = Counter((source, p[3]) for _, source, _, p in read if p and p[0] == "date" and p[3])
    out = []
    for i, source, zone, p in read:
        if p is None:
            out.append((i, None, "bad", False))
        elif p[0] == "epoch":
            out.append((i, p[1], "epoch", False))
        else:
            _, first, other, _, day, off = p
            rule = "plain"
            if other and other != first:
                a, b = votes[source, "day"], votes[source, "month"]
                rule = "default" if a == b else "votes"
                first = other if b > a else first
            utc, doubtful = (first + day - off, False) if off is not None else to_utc(first + day, zone)
            out.append((i, micros(utc), rule, rule != "plain" or doubtful))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.select("stamp_id", "utc_us", "rule", "ambiguous").collect()), key=repr)


EDGES = [
    "2024-03-10 02:30", "2024-03-10 02:00:00", "2024-03-10 03:00", "2024-03-10 01:59:59", "2024-11-03 01:30", "2024-11-03 01:00", "2024-11-03 02:00", "2024-11-03 00:59:59", "2024-03-31 02:15", "2024-10-27 02:15",
    "2024-02-30", "2023-02-29", "2024-02-29", "20240229", "2024022", "202402290", "1700000000", "1700000000123", "17000000001", "24:00", "2024-01-01 24:00", "2024-01-01 23:60", "2024-01-01 23:59:60", "2024-01-01 00:30 AM", "2024-01-01 12:30 AM",
    "2024-01-01 12:30PM", "2024-01-01 13:30 PM", "2024-01-01T10:00 PM +0530", "2024-01-01 10:00 +14:59", "2024-01-01 10:00 +15:00", "2024-01-01 10:00+05:60", "2024-01-01 10:00Z", "2024-01-01 10:00 z", "2024-01-01  10:00", "01.02.2024", "32.01.2024",
    "01 Feb 2024 10:11:12", "01 feb 2024", "1 Feb 2024", "01 FEB 2024", "\t 2024-01-01\x0b\r\n", "\x1f2024-01-01", "٢٠٢٤-01-01", "2024-01-01T", "2024-01-01 ", "05/05/2024", "05/06/2024", "13/05/2024", "05/13/2024", "13/13/2024", "29/02/2023", "02/29/2024 12:60",
    "", " ", None, "x" * 100_000, "1999-12-31", "2099-12-31 23:59:59", "2000-01-01", "2024-01-01 10:00:00 AM Z", "2024/01/01", "0000000000", "9999999999999",
]
ZONES = ["UTC", "America/New_York", "Europe/Berlin", "Asia/Kolkata", "Australia/Lord_Howe", "Pacific/Apia", "Nowhere/None", None]


def test_edges_equal_a_plain_reading(spark):
    rows = [(len(ZONES) * i + k, f"s{k}", zone, raw) for i, raw in enumerate(EDGES) for k, zone in enumerate(ZONES)]
    assert rows_of(normalise(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_random_stamps_equal_a_plain_reading(spark):
    r = random.Random(7)
    two = lambda n: f"{r.randrange(n):02d}"

    def stamp():
        y, m, d = f"20{two(100)}", two(14), two(34)
        date = r.choice([f"{y}-{m}-{d}", f"{y}{m}{d}", f"{d}.{m}.{y}", f"{d} {r.choice(MONTHS)} {y}", f"{d}/{m}/{y}", f"{m}/{d}/{y}", f"{m}/{d}/{y}"])
        if r.random() < 0.3:
            return date
        out = f"{date}{r.choice('T ')}{two(26)}:{two(62)}" + (f":{two(62)}" if r.random() < 0.5 else "") + r.choice(["", "", " AM", "PM", " PM"])
        return out + r.choice(["", "", "", "Z", " Z", f"+{two(16)}:{two(62)}", f" -{two(16)}{two(62)}"])

    rows = [(i, r.choice(["a", "b", "c", "d", "e", None]), r.choice(ZONES), stamp()) for i in range(6_000)]
    assert rows_of(normalise(spark.createDataFrame(rows, SCHEMA).repartition(5))) == plain(rows)


def test_ties_of_votes_take_the_day_first(spark):
    rows = [(1, "a", "UTC", "13/05/2024"), (2, "a", "UTC", "05/13/2024"), (3, "a", "UTC", "05/06/2024"), (4, "b", "UTC", "05/13/2024"), (5, "b", "UTC", "05/06/2024"), (6, "b", "UTC", "05/13/2024 99:00")]
    out = {r["stamp_id"]: (r["rule"], r["utc_us"]) for r in normalise(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[3] == ("default", micros(datetime(2024, 6, 5))) and out[5] == ("votes", micros(datetime(2024, 5, 6))) and out[6] == ("bad", None)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert normalise(empty).collect() == []
    rows = [(None, None, None, None), (1, "a", "UTC", "2024-01-01"), (1, "a", "UTC", "2024-01-01")]
    df = spark.createDataFrame([(*r, 7, "x", True) for r in rows], SCHEMA + ", kind int, rule string, by_day boolean")
    assert rows_of(normalise(df)) == plain(rows)


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata", "Africa/Casablanca", "Australia/Lord_Howe"])
def test_transitions_are_those_of_the_zone(zone):
    z, found = zoneinfo.ZoneInfo(zone), transitions(zone)
    t = datetime(2000, 1, 1, tzinfo=UTC)
    while t.year < 2040:
        wall = micros(t.astimezone(z).replace(tzinfo=None))
        _, _, off, until = [x for x in found if x[1] <= wall][-1]
        assert wall < until or off == t.astimezone(z).utcoffset().total_seconds()
        t += timedelta(hours=19)


def test_query_equals_its_sql(spark):
    same_as_sql(spark, "op11_timestamps", op11_timestamps)
