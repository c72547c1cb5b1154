"""Balloon-shaped tables derived from the test tables, by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftspark.sources.spread import dealt

#: What the views number the rows of a large table by.
NUMBERED_BY = {"lineitem": "l_suppkey", "orders": "o_custkey"}
VIEWS = {
    # one flight per supplier, a frame every 10 s
    "frames_v": (("lineitem",), """
        select concat('S', cast(k as varchar(20))) as serial, n as frame, 1704067200 + (k % 24) * 3600 + nd * 10 as t,
               40 + k % 20 + cast(0.0004 as double) * nd + (l_discount - cast(0.05 as double)) * cast(0.0002 as double) as lat,
               -100 + (k * 7) % 60 + cast(0.001 as double) * nd + (l_tax - cast(0.04 as double)) * cast(0.0002 as double) as lon,
               alt, case k % 4 when 0 then 'RS41-SGP' when 1 then 'DFM09' when 2 then 'M20' else 'rs92' end as type,
               case when l_returnflag <> 'N' then greatest(cast(-56.5 as double), 15 - cast(0.0065 as double) * alt) end as temp,
               case when l_returnflag <> 'N' then cast(1013.25 as double) * exp(-alt / 7600) end as pressure
        from (select *, case when k % 10 = 9 then least(200 + 50 * nd, cast(15000 as double)) when nd <= nu then 200 + 50 * nd
                         else 200 + 50 * nu * fall * sqrt(fall) end + (l_quantity - cast(25.5 as double)) * cast(0.1 as double) as alt
              from (select *, greatest(cast(0 as double), 1 - (nd - nu) / 130) as fall
                    from (select *, cast(n as double) as nd, cast(420 + k % 40 as double) as nu
                          from (select l_suppkey as k, l_quantity, l_discount, l_tax, l_returnflag,
                                       row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 as n
                                from {lineitem}) a) b) c) d"""),
    # one flight per customer
    "flights_v": (("customer",), """
        select concat('C', cast(c_custkey as varchar(20))) as serial, launch_t, launch_t + 7200 as last_seen_t,
               case c_custkey % 4 when 0 then 'RS41-SGP' when 1 then 'DFM09' when 2 then 'M20' else 'rs92' end as type,
               case c_custkey % 5 when 0 then 'ASCENT' when 1 then 'DESCENT' else 'LANDED' end as state,
               case when c_custkey % 11 <> 0 then 40 + c_custkey % 20 + c_acctbal / 20000 end as launch_lat,
               case when c_custkey % 11 <> 0 then -100 + (c_custkey * 7) % 60 + c_acctbal / 20000 end as launch_lon,
               case when c_custkey % 6 <> 0 then 22000 + c_acctbal end as burst_alt,
               case when c_custkey % 9 <> 0 then 5 + c_acctbal / 10000 end as descent_b,
               24000 + c_acctbal as max_alt, 200 + abs(c_acctbal) / 10 as last_alt,
               cast(40.5 as double) + c_custkey % 20 + c_acctbal / 20000 as last_lat, cast(-99.5 as double) + (c_custkey * 7) % 60 + c_acctbal / 20000 as last_lon
        from (select *, cast(1704067200 + (c_custkey % 400) * 86400 as double) as launch_t from {customer}) a"""),
    "landings_v": (("flights_v",), """
        select serial, launch_t, last_lat as land_lat, last_lon as land_lon, last_alt as land_alt, last_seen_t as landed_t,
               case when last_alt < 500 then 'telemetry' else 'timeout' end as detected_by
        from {flights_v} where state = 'LANDED'"""),
    # one prediction per order
    "predictions_v": (("orders", "flights_v"), """
        select o.serial, f.launch_t, launch_t + 3600 + rn * 300 as predicted_t, launch_t + 7200 + rn * 10 as land_t,
               case when o_orderkey % 13 <> 0 then greatest(cast(0 as double), 24000 - rn * 2000) end as alt_at_pred,
               last_lat + (o_totalprice / 500000 - cast(0.5 as double)) * cast(0.2 as double) / rn as land_lat,
               last_lon + (cast(0.5 as double) - o_totalprice / 500000) * cast(0.3 as double) / rn as land_lon,
               case when o_orderpriority like '1%' or o_orderpriority like '2%' then 'gfs' else 'measured' end as source,
               cast(0.3 as double) + 8 / rn as uncertainty_radius_km
        from (select concat('C', cast(o_custkey as varchar(20))) as serial, o_orderkey, o_totalprice, o_orderpriority,
                     cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as double) as rn from {orders}) o
        join {flights_v} f on o.serial = f.serial"""),
    # what a fold over the customers' flights would say: some landings are refined, some retracted, some of these land again
    "changes_v": (("flights_v",), """
        select serial, launch_t, kind, launch_t + after_s as t, state, last_lat + shift as lat, last_lon + shift as lon, last_alt - 20000 * shift as alt,
               case when k % 10 = 3 then last_alt + 500 else max_alt end as max_alt, detected_by, launch_t + after_s - case when detected_by = 'timeout' then 180 else 0 end as seen_t
        from (select f.serial, f.launch_t, f.last_lat, f.last_lon, f.last_alt, f.max_alt, f.k, c.kind, c.state, cast(c.after_s as double) as after_s, cast(c.shift as double) as shift,
                     case when f.last_alt < 500 or c.shift > cast(0.002 as double) then 'telemetry' else 'timeout' end as detected_by
              from (select *, state as final, cast(substr(serial, 2) as bigint) as k from {flights_v}) f
              join (values ('NEW_FLIGHT', 'ASCENT', 0, 1, 0), ('BURST', 'DESCENT', 4050, 1, 0), ('REVERTED', 'ASCENT', 4650, 9, 0), ('BURST', 'DESCENT', 4950, 9, 0), ('LANDED', 'LANDED', 6000, 1, 0),
                           ('REFINED', 'LANDED', 6300, 3, 0.001), ('RESUMED', 'DESCENT', 6600, 4, 0), ('LANDED', 'LANDED', 7500, 8, 0.004)) c (kind, state, after_s, every, shift)
                on f.k % c.every = 0 and (c.after_s < 6000 or f.final = 'LANDED' and (c.after_s = 6000 or f.last_alt >= 500))) d"""),
    # every twentieth frame as the stored track of the customers' flights of the same number
    "track_v": (("frames_v",), """
        select concat('C', substr(serial, 2)) as serial, cast(t as double) as t, floor(lat * 10000) / 10000 as lat, floor(lon * 10000) / 10000 as lon, cast(floor(alt) as double) as alt from {frames_v} where frame % 20 = 0"""),
    # six points of each prediction's path, from the last fix to the landing
    "path_points_v": (("predictions_v", "flights_v"), """
        select p.serial, p.launch_t, p.predicted_t, i, floor((last_lat + (land_lat - last_lat) * i / 5) * 10000) / 10000 as lat, floor((last_lon + (land_lon - last_lon) * i / 5) * 10000) / 10000 as lon,
               cast(floor(last_alt * (5 - i) / 5) as double) as alt
        from {predictions_v} p join {flights_v} f on p.serial = f.serial cross join (values (0), (1), (2), (3), (4), (5)) c (i)"""),
    "subscribers_v": (("supplier",), """
        select s_suppkey as id, cast(40.5 as double) + s_suppkey % 20 as lat, cast(-99.5 as double) + (s_suppkey * 7) % 60 as lon, 20 + abs(s_acctbal) / 100 as radius_km,
               case when s_suppkey % 7 = 0 then '' else concat('topic-', cast(s_suppkey as varchar(20))) end as topic,
               case when s_suppkey % 2 = 0 then 'metric' else 'imperial' end as units, s_suppkey % 5 <> 0 as active
        from {supplier}"""),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a table itself."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs, sql = VIEWS[name]
    tables = {n: view(spark, sf_dir, n) for n in needs}
    return spark.sql(sql, **{n: dealt(t, NUMBERED_BY[n]) if n in NUMBERED_BY else t for n, t in tables.items()})


def duckdb(select: str, *names: str) -> str:
    """DuckDB SQL over derived views: the views as common table expressions, then ``select``, which may begin with more (``, x
    as (...) select ...``)."""
    out: dict[str, str] = {}

    def add(name):
        needs, sql = VIEWS[name]
        for n in needs:
            if n in VIEWS:
                add(n)
        out.setdefault(name, sql.format(**{n: n for n in needs}))

    for n in names:
        add(n)
    return "with recursive " + ", ".join(f"{k} as ({v})" for k, v in out.items()) + " " + select
