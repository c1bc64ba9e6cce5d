"""Mixed timestamps to UTC by DuckDB inside mapInArrow.

A first pass reads every stamp: one regexp_extract struct for each layout, guarded by the layout's whole pattern, and
try_strptime for what it holds. Slashed stamps that only one order can read vote for it in their source, counted by
Spark. A second pass takes the stamps with the votes of their sources as a table, picks the order, and finds the
offset of local times by an ASOF join against the exported transitions of the zones. Rows meet the votes in a join that
Spark may split at hot sources; what goes to the driver is the names of known zones alone, a few hundred at most.
"""

from __future__ import annotations

import functools
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm.common import materialise, ready
from stackloom.llm.repeats import ddl

#: Rows and bytes of stamps that DuckDB takes at once.
ROWS, BYTES = 50_000, 8 << 20
#: First and last day whose transitions are exported; stamps name the years 2000 to 2099.
FIRST, LAST = datetime(1999, 12, 1, tzinfo=UTC), datetime(2100, 2, 1, tzinfo=UTC)

_Y, _2 = "20[0-9][0-9]", "[0-9][0-9]"
_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_TIME = f"(?:[T ]({_2}):({_2})(?::({_2}))?(?: ?([AP]M))?(?: ?(Z|[+-]{_2}:?{_2}))?)?"
_PARTS = "'h', 'n', 's', 'half', 'off'"
# Layout: pattern of the date, its groups, format of the date put together again.
_LAYOUTS = {
    "dashed": (f"({_Y})-({_2})-({_2})", "'y', 'm', 'd'", "%Y-%m-%d", "p.y || '-' || p.m || '-' || p.d"),
    "packed": (f"({_Y})({_2})({_2})", "'y', 'm', 'd'", "%Y%m%d", "p.y || p.m || p.d"),
    "dotted": (rf"({_2})\.({_2})\.({_Y})", "'d', 'm', 'y'", "%d.%m.%Y", "p.d || '.' || p.m || '.' || p.y"),
    "named": (f"({_2}) ({_MONTHS}) ({_Y})", "'d', 'm', 'y'", "%d %b %Y", "p.d || ' ' || p.m || ' ' || p.y"),
    "slashed": (f"({_2})/({_2})/({_Y})", "'d', 'm', 'y'", "%d/%m/%Y", "p.d || '/' || p.m || '/' || p.y"),
}


def _read_sql() -> str:
    """SQL over rows (stamp_id, source, zone, raw): kind, us, other_us, off_s, votes_day, votes_month for each."""
    trimmed = "trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) t"
    layout = " ".join(f"when regexp_full_match(t, '{date}{_TIME}') then '{name}'" for name, (date, *_) in _LAYOUTS.items())
    part = " ".join(
        f"when '{name}' then struct_pack(y := x.y, m := x.m, d := x.d, h := x.h, n := x.n, s := x.s, half := x.half, off := x.off)".replace("x.", f"regexp_extract(t, '^{date}{_TIME}$', [{names}, {_PARTS}]).")
        for name, (date, names, *_) in _LAYOUTS.items()
    )
    # Minutes and seconds to 59; hours to 23, or 01 to 12 with a half of the day; offsets to 14 hours and 59 minutes.
    time = "p.h || ':' || p.n || ':' || case when p.s = '' then '00' else p.s end"
    clock = f"case when p.h = '' then try_strptime('00:00:00', '%H:%M:%S') when p.half = '' then try_strptime({time}, '%H:%M:%S') else try_strptime({time} || ' ' || p.half, '%I:%M:%S %p') end"
    sane = "p.n <= '59' and p.s <= '59' and (p.h = '' or case when p.half = '' then p.h <= '23' else p.h between '01' and '12' end)"
    sane += " and (p.off in ('', 'Z') or substr(p.off, 2, 2) <= '14' and right(p.off, 2) <= '59')"
    off = "case when p.off = '' then null when p.off = 'Z' then 0 else (case when p.off[1] = '-' then -1 else 1 end) * (try_cast(substr(p.off, 2, 2) as int) * 3600 + try_cast(right(p.off, 2) as int) * 60) end"
    date = " ".join(f"when '{name}' then try_strptime({text}, '{form}')" for name, (_, _, form, text) in _LAYOUTS.items())
    day_us = "(hour(clock) * 3600 + minute(clock) * 60 + second(clock)) * 1000000"
    known = "(off_s is not null or exists (select 1 from zones z where z.zone = rows_.zone))"
    return f"""
        with a as (select stamp_id, source, zone, {trimmed} from stamps),
        b as (select *, case when regexp_full_match(t, '[0-9]{{10}}') then 'seconds' when regexp_full_match(t, '[0-9]{{13}}') then 'millis' {layout} end layout from a),
        c as (select *, case layout {part} end p from b),
        d as (select *, case when {sane} then {clock} end clock, case when {sane} then {off} end off_s,
                case layout {date} end first, case layout when 'slashed' then try_strptime(p.m || '/' || p.d || '/' || p.y, '%d/%m/%Y') end other from c),
        rows_ as (select stamp_id, source, zone, layout, off_s, t, clock is not null ok, epoch_us(first) + {day_us} us, epoch_us(other) + {day_us} other_us from d)
        select stamp_id, source, zone, cast(off_s as int) off_s,
            case when layout in ('seconds', 'millis') then 'epoch'
                 when layout is null or not ok or coalesce(us, other_us) is null or not {known} then 'bad'
                 when us <> other_us then 'slashed' else 'plain' end kind,
            case layout when 'seconds' then try_cast(t as bigint) * 1000000 when 'millis' then try_cast(t as bigint) * 1000 else coalesce(us, other_us) end us,
            other_us, layout = 'slashed' and other_us is null votes_day, layout = 'slashed' and us is null votes_month
        from rows_"""


_RESOLVE_SQL = """
    with a as (select s.*, s.kind = 'slashed' and coalesce(v.by_month > v.by_day, false) month_first, s.kind = 'slashed' and coalesce(v.by_month <> v.by_day, false) voted
               from stamps s left join votes v on s.source is not distinct from v.source),
    b as (select *, case when month_first then other_us else us end at_us from a),
    c as (select b.*, z.zone_off, z.until_us from b asof left join zones z on b.zone = z.zone and b.at_us >= z.from_us)
    select stamp_id,
        case when kind = 'bad' then null when kind = 'epoch' then at_us else at_us - coalesce(off_s, zone_off) * 1000000 end utc_us,
        case when kind <> 'slashed' then kind when voted then 'votes' else 'default' end "rule",
        kind = 'slashed' or kind = 'plain' and off_s is null and coalesce(at_us < until_us, false) ambiguous
    from c"""

_READ = pa.schema([("stamp_id", pa.int64()), ("source", pa.string()), ("zone", pa.string()), ("off_s", pa.int32()), ("kind", pa.string()), ("us", pa.int64()), ("other_us", pa.int64()), ("votes_day", pa.bool_()), ("votes_month", pa.bool_())])
_OUT = pa.schema([("stamp_id", pa.int64()), ("utc_us", pa.int64()), ("rule", pa.string()), ("ambiguous", pa.bool_())])


@functools.cache
def known_zones() -> list[str]:
    import zoneinfo

    return sorted(zoneinfo.available_timezones())


def transitions(zone: str) -> list[tuple[str, int, int, int]]:
    """(zone, from_us, zone_off, until_us) of a zone's offsets: local times from from_us on have zone_off seconds.

    A change at the instant T from offset a to b makes the local times from T + min(a, b) to T + max(a, b) doubtful, for
    they are skipped or come twice; they take b, so b holds from the first of them, and until_us ends them.
    """
    import zoneinfo

    z = zoneinfo.ZoneInfo(zone)
    offset = lambda t: int(t.astimezone(z).utcoffset().total_seconds())
    least = -(1 << 62)
    now, old = FIRST, offset(FIRST)
    out = [(zone, least, old, least)]
    while now < LAST:
        then = now + timedelta(days=2)
        if (new := offset(then)) != old:
            low, high = int(now.timestamp()), int(then.timestamp())
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (low, mid) if offset(datetime.fromtimestamp(mid, UTC)) != old else (mid, high)
            new = offset(datetime.fromtimestamp(high, UTC))
            out.append((zone, (high + min(old, new)) * 1_000_000, new, (high + max(old, new)) * 1_000_000))
            old, then = new, datetime.fromtimestamp(high, UTC)
        now = then
    return out


def _chunks(batches):
    """Tables of several batches each: DuckDB plans a query once for many rows."""
    held, rows, size = [], 0, 0
    for b in batches:
        held, rows, size = [*held, b], rows + b.num_rows, size + b.nbytes
        if rows >= ROWS or size >= BYTES:
            yield pa.Table.from_batches(held)
            held, rows, size = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held)


def _duck(**tables: pa.Table):
    import duckdb

    con = duckdb.connect(config={"threads": "1"})
    con.execute("set timezone = 'UTC'")
    for name, rows in tables.items():
        con.register(f"{name}_given", rows)
        con.execute(f"create table {name} as select * from {name}_given")
    return con


def _reader(zones: list[str]):
    sql = _read_sql()

    def run(batches):
        con = _duck(zones=pa.table({"zone": pa.array(zones, pa.string())}))
        for rows in _chunks(batches):
            con.register("stamps", rows)
            yield from con.sql(sql).to_arrow_table().select(_READ.names).cast(_READ).to_batches()

    return run


def _resolver(changes: list[tuple[str, int, int, int]]):
    def run(batches):
        con = _duck(zones=pa.table(dict(zip(("zone", "from_us", "zone_off", "until_us"), (pa.array(x, t) for x, t in zip(zip(*changes) if changes else ([],) * 4, (pa.string(), pa.int64(), pa.int64(), pa.int64())))))))
        for rows in _chunks(batches):
            votes = rows.select(["source", "by_day", "by_month"]).group_by(["source", "by_day", "by_month"]).aggregate([])
            con.register("stamps", rows.drop_columns(["by_day", "by_month"]))
            con.register("votes", votes)
            yield from con.sql(_RESOLVE_SQL).to_arrow_table().select(_OUT.names).cast(_OUT).to_batches()

    return run


def normalise(stamps: DataFrame) -> DataFrame:
    """Per row of stamps (stamp_id, source, zone, raw): stamp_id, utc_us, rule, ambiguous.

    utc_us is in microseconds since 1970, null for bad stamps. rule is bad, epoch, votes, default or plain; ambiguous is
    true where votes or the default chose the order of day and month, and for local times that their zone skips or has
    twice. Null and empty stamps are bad, as are stamps without an offset whose zone is null or unknown; neither votes.
    Rows without a source vote together, as one source. Rows and ids may repeat or be null, each row is read by itself;
    further columns are ignored.
    """
    spark = ready(stamps.sparkSession)
    rows = stamps.select(F.col("stamp_id").cast("long").alias("stamp_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "zone", "raw")))
    names = known_zones()
    read = materialise(rows.mapInArrow(_reader(names), ddl(_READ)), "stamps")
    # Zones of the time-zone database alone, a few hundred at most.
    used = sorted(r[0] for r in read.where(F.col("kind").isin("plain", "slashed") & F.col("off_s").isNull()).select("zone").distinct().collect())
    changes = [x for zone in used for x in transitions(zone)]
    votes = read.where("votes_day or votes_month").groupBy("source").agg(F.count_if("votes_day").alias("by_day"), F.count_if("votes_month").alias("by_month"))
    none = F.lit(None).cast("long")
    asked = read.where("kind = 'slashed'").alias("s").join(votes.alias("v"), F.col("s.source").eqNullSafe(F.col("v.source")), "left").select("s.*", "by_day", "by_month")
    others = read.where("kind <> 'slashed'").withColumns({"by_day": none, "by_month": none})
    return asked.unionByName(others).drop("votes_day", "votes_month").mapInArrow(_resolver(changes), ddl(_OUT))


def op11_timestamps(spark, sf_dir: str) -> DataFrame:
    return normalise(spark.read.parquet(f"{sf_dir}/stamps.parquet"))


#: The same rows by SQL: integer arithmetic on the parts of a stamp, and the zone's own conversion of both possible instants.
SQL = r"""
with a as (select stamp_id, source, zone, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) t from stamps),
b as (select *, regexp_extract(t, '^([0-9-]+|[0-9.]+|[0-9/]+|[0-9]+ [A-Z][a-z]+ [0-9]+)(?:[T ]([0-9][0-9]):([0-9][0-9])(?::([0-9][0-9]))?(?: ?([AP]M))?(?: ?(Z|[+-][0-9][0-9]:?[0-9][0-9]))?)?$', ['date', 'h', 'n', 's', 'half', 'off']) p from a),
c as (select stamp_id, source, zone, t, p, regexp_full_match(p.date, '[0-9]{2}/[0-9]{2}/20[0-9]{2}') slashed, case
    when regexp_full_match(p.date, '20[0-9]{2}-[0-9]{2}-[0-9]{2}') then p.date
    when regexp_full_match(p.date, '20[0-9]{6}') then p.date[1:4] || '-' || p.date[5:6] || '-' || p.date[7:8]
    when regexp_full_match(p.date, '[0-9]{2}[.][0-9]{2}[.]20[0-9]{2}') then p.date[7:10] || '-' || p.date[4:5] || '-' || p.date[1:2]
    when regexp_full_match(p.date, '[0-9]{2} (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) 20[0-9]{2}') then p.date[8:11] || '-' || lpad(cast((position(p.date[4:6] in 'JanFebMarAprMayJunJulAugSepOctNovDec') + 2) // 3 as varchar), 2, '0') || '-' || p.date[1:2]
    when regexp_full_match(p.date, '[0-9]{2}/[0-9]{2}/20[0-9]{2}') then p.date[7:10] || '-' || p.date[4:5] || '-' || p.date[1:2] end one,
    case when regexp_full_match(p.date, '[0-9]{2}/[0-9]{2}/20[0-9]{2}') then p.date[7:10] || '-' || p.date[1:2] || '-' || p.date[4:5] end two from b),
d as (select stamp_id, source, zone, t, slashed, try_cast(one as date) one, try_cast(two as date) two, p.off off,
    case when p.h = '' then 0 when p.n > '59' or p.s > '59' or p.half = '' and p.h > '23' or p.half <> '' and p.h not between '01' and '12' then null
         else ((case p.half when '' then try_cast(p.h as int) when 'AM' then try_cast(p.h as int) % 12 else try_cast(p.h as int) % 12 + 12 end) * 60 + try_cast(p.n as int)) * 60 + coalesce(try_cast(p.s as int), 0) end day_s,
    case when p.off = '' then 0 when p.off = 'Z' then 0 when p.off[2:3] > '14' or right(p.off, 2) > '59' then null
         else (case p.off[1] when '-' then -1 else 1 end) * (try_cast(p.off[2:3] as int) * 60 + try_cast(right(p.off, 2) as int)) * 60 end off_s from c),
e as (select *, case when regexp_full_match(t, '[0-9]{10}') then try_cast(t as bigint) * 1000000 when regexp_full_match(t, '[0-9]{13}') then try_cast(t as bigint) * 1000 end epoch,
    coalesce(one, two) is not null and day_s is not null and off_s is not null and (off <> '' or zone in (select name from pg_timezone_names())) ok from d),
v as (select source, count(*) filter (two is null) by_day, count(*) filter (one is null) by_month from e where ok and slashed and epoch is null group by source),
f as (select e.*, one <> two both_ways, coalesce(v.by_month > v.by_day, false) month_first, coalesce(v.by_month <> v.by_day, false) voted from e left join v on e.source is not distinct from v.source),
g as (select *, cast(case when both_ways and month_first then two else coalesce(one, two) end as timestamp) + to_seconds(day_s) wall from f where ok and epoch is null),
h as (select *, wall - timezone(zone, (wall - interval 24 hour) at time zone 'UTC') + (wall - interval 24 hour) - wall old_less, wall - timezone(zone, (wall + interval 24 hour) at time zone 'UTC') + (wall + interval 24 hour) - wall new_less from g where off = ''),
i as (select *, wall + old_less old_utc, wall + new_less new_utc from h),
j as (select *, timezone(zone, old_utc at time zone 'UTC') = wall old_ok, timezone(zone, new_utc at time zone 'UTC') = wall new_ok from i),
k as (select stamp_id, epoch_us(case when old_ok and not new_ok then old_utc else new_utc end) utc_us, both_ways, voted, old_less <> new_less and old_ok = new_ok doubtful from j
    union all select stamp_id, epoch_us(wall) - cast(off_s as bigint) * 1000000, both_ways, voted, false from g where off <> '')
select stamp_id, utc_us, case when coalesce(both_ways, false) then case when voted then 'votes' else 'default' end else 'plain' end "rule", coalesce(both_ways, false) or coalesce(doubtful, false) ambiguous from k
union all select stamp_id, epoch, 'epoch', false from f where epoch is not null
union all select stamp_id, null, 'bad', false from f where epoch is null and not ok
"""
