"""Views that stand in for survey data, over general tables of orders, events and embeddings.

Each view is one SQL text for Spark and for other engines; ``{name(...)}`` marks the few places where
dialects differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Survey years that the ship years stand for, in order.
YEARS = {1995: 2010, 1996: 2011, 1997: 2012, 1998: 2013, 1999: 2014, 2000: 2017}

_YEAR = "CASE extract(year FROM {d}) " + " ".join(f"WHEN {a} THEN {b}" for a, b in YEARS.items()) + " ELSE 2018 END"

VIEWS: dict[str, str] = {
    # one row per radar trace of a track, with ice content and likelihood
    "thickness": f"""
SELECT CAST(l_suppkey AS STRING) AS track,
       CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate, l_discount, l_quantity) - 1 AS BIGINT) AS trace,
       62 + (l_orderkey % 18000) / CAST(1000 AS DOUBLE) AS lat,
       -60 + (l_partkey * 7919 % 30000) / CAST(1000 AS DOUBLE) AS lon,
       l_quantity * CAST(0.4 AS DOUBLE) AS content,
       1 - l_discount AS likelihood,
       {_YEAR.replace("{d}", "l_shipdate")} AS year,
       CAST(800 + l_partkey * 13 % 1700 AS DOUBLE) AS elevation
FROM lineitem""",
    # aircraft positions along a track
    "coordinates": """
SELECT CAST(user_id AS STRING) AS track,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS trace,
       62 + (event_id % 18000) / CAST(1000 AS DOUBLE) AS lat,
       -60 + (event_id * 7919 % 30000) / CAST(1000 AS DOUBLE) AS lon,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE value % 20 END AS roll,
       value AS gps_time
FROM events""",
    # radar traces: one array of samples each
    "traces": """
SELECT CAST(label AS STRING) AS track,
       CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS trace,
       {doubles(embedding)} AS samples
FROM embeddings""",
    # names of radar files, with gaps
    "files": """
SELECT DISTINCT 'Data_' || {ymd(o_orderdate)} || '_' || lpad(CAST(o_custkey % 4 + 1 AS STRING), 2, '0') || '_' || lpad(CAST(o_orderkey % 400 AS STRING), 3, '0') || '.mat' AS name
FROM orders""",
    # names as they come, those of some years with one more prefix
    "raw_files": """
SELECT DISTINCT 'Data_' || CASE WHEN o_orderkey % 3 = 0 THEN 'img_01_' ELSE '' END || {ymd(o_orderdate)} || '_' || lpad(CAST(o_custkey % 4 + 1 AS STRING), 2, '0') || '_' || lpad(CAST(o_orderkey % 400 AS STRING), 3, '0') || '.mat' AS name
FROM orders""",
    # names of tracks
    "tracks": """
SELECT DISTINCT {ymd(o_orderdate)} || '_' || lpad(CAST(o_custkey % 4 + 1 AS STRING), 2, '0') || '_' || lpad(CAST(o_orderkey % 390 AS STRING), 3, '0') || '_' || lpad(CAST(o_orderkey % 390 + o_custkey % 6 AS STRING), 3, '0') AS track
FROM orders""",
    # hand-made exclusions: every form of interval token
    "exclusions": """
SELECT CAST(p_partkey % 100 AS STRING) AS track,
       CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN '-' || CAST(p_size % 9 AS STRING)
            WHEN 1 THEN CAST(p_size * 40 AS STRING) || '-'
            WHEN 2 THEN CAST(p_size * 3 AS STRING) || '-' || CAST(p_size * 3 + p_partkey % 7 AS STRING)
            ELSE CAST(p_size * 5 AS STRING) END AS token,
       CAST(p_partkey % 3 AS STRING) AS list
FROM part""",
    # GPS rows by whole second
    "gps_master": """
SELECT {days(o_orderdate)} AS second, o_orderkey AS index_gps,
       62 + (o_custkey % 18000) / CAST(1000 AS DOUBLE) AS lat, -60 + (o_orderkey % 30000) / CAST(1000 AS DOUBLE) AS lon
FROM orders""",
    # radar times by whole second, unlocated
    "radar_times": """
SELECT CAST(l_suppkey AS STRING) AS radargram, {days(l_shipdate)} AS second,
       CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_quantity) - 1 AS BIGINT) AS index_vector
FROM lineitem""",
    # outlines digitised by hand: pixel columns and a colour word
    "outlines": """
SELECT CAST(user_id AS STRING) AS track, CAST(event_id % 7 AS INT) AS outline, CASE WHEN event_id % 23 = 0 THEN NULL ELSE value * 3 END AS xcoord,
       CASE CAST(event_id % 7 AS INT) WHEN 0 THEN 'red' WHEN 1 THEN 'green' WHEN 2 THEN 'purple' WHEN 3 THEN 'maybe' WHEN 4 THEN 'orange' WHEN 5 THEN 'green_2' ELSE 'orange_edge' END AS colour
FROM events""",
    # hourly weather
    "station": """
SELECT CAST(2000 + user_id % 20 AS INT) AS year, value - 50 AS temperature FROM events""",
    # truth and prediction of each cell
    "truth": """
SELECT doc_id AS cell, quality = 1 AS truth, toxic = 1 AS predicted FROM labels""",
    # areas as rectangles in degrees, some of which overlap
    "areas": """
SELECT * FROM (VALUES
  (1, 'NO', CAST(-60 AS DOUBLE), CAST(76 AS DOUBLE), CAST(-30 AS DOUBLE), CAST(80 AS DOUBLE)),
  (2, 'NE', CAST(-42 AS DOUBLE), CAST(70 AS DOUBLE), CAST(-30 AS DOUBLE), CAST(76 AS DOUBLE)),
  (3, 'SE', CAST(-42 AS DOUBLE), CAST(62 AS DOUBLE), CAST(-30 AS DOUBLE), CAST(69 AS DOUBLE)),
  (4, 'SW', CAST(-60 AS DOUBLE), CAST(62 AS DOUBLE), CAST(-43 AS DOUBLE), CAST(66 AS DOUBLE)),
  (5, 'CW', CAST(-60 AS DOUBLE), CAST(65.5 AS DOUBLE), CAST(-42 AS DOUBLE), CAST(71 AS DOUBLE)),
  (6, 'NW', CAST(-60 AS DOUBLE), CAST(70.5 AS DOUBLE), CAST(-43 AS DOUBLE), CAST(76.5 AS DOUBLE))
) AS t(id, region, x0, y0, x1, y1)""",
    # elevation by grid cell of a tenth of a degree
    "dem": """
SELECT r AS row, c AS col, CAST(500 + (r * 37 + c * 11) % 2500 AS DOUBLE) AS elevation
FROM (SELECT DISTINCT CAST(floor((80 - (62 + (l_orderkey % 18000) / CAST(1000 AS DOUBLE))) * 10) AS BIGINT) AS r,
             CAST(floor((60 + (-60 + (l_partkey * 7919 % 30000) / CAST(1000 AS DOUBLE))) * 10) AS BIGINT) AS c FROM lineitem) AS g
WHERE (r + c) % 10 <> 3""",
}

#: Dialects: how each marked function is written.
SPARK = {"doubles": "CAST({} AS ARRAY<DOUBLE>)", "ymd": "date_format({}, 'yyyyMMdd')", "days": "CAST(datediff({}, DATE '1990-01-01') AS BIGINT)"}
OTHER = {"doubles": "CAST({} AS DOUBLE[])", "ymd": "strftime({}, '%Y%m%d')", "days": "CAST(date_diff('day', DATE '1990-01-01', CAST({} AS DATE)) AS BIGINT)"}


def text(sql: str, dialect: dict[str, str] = OTHER) -> str:
    """The SQL with its marks written out."""
    return re.sub(r"\{(\w+)\(([^()]*)\)\}", lambda m: dialect[m[1]].format(m[2]), sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in view as a DataFrame."""
    sql = text(VIEWS[name], SPARK)
    tables = set(re.findall(r"\bFROM (\w+)", sql)) & {"lineitem", "orders", "events", "part", "embeddings", "labels", "nation"}
    return spark.sql(re.sub(r"\bFROM (lineitem|orders|events|part|embeddings|labels|nation)\b", r"FROM {\1}", sql.replace("{", "{{").replace("}", "}}")), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def with_views(sql: str) -> str:
    """SQL over stand-in views as one statement for another engine."""
    used = [n for n in VIEWS if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)]
    ctes = ", ".join(f"{n} AS ({text(VIEWS[n])})" for n in used)
    sql = text(sql).strip()
    if not ctes:
        return sql
    if m := re.match(r"WITH (RECURSIVE )?", sql):
        return f"WITH {m[1] or ''}{ctes}, {sql[m.end():]}"
    return f"WITH {ctes} {sql}"
