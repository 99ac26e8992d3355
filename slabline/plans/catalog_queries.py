"""Queries of sources, the catalogue, positions and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import catalog, masks, pooled, track
from ..operators import regions as rg
from ..sources import files
from .registry import Inputs, longs, query, r, rounded

_PARTS = "CAST(substr(track, 1, 4) AS BIGINT) AS year, substr(track, 1, 8) AS date, CAST(substr(track, 10, 2) AS BIGINT) AS line, CAST(substr(track, 13, 3) AS BIGINT) AS start, CAST(substr(track, 17, 3) AS BIGINT) AS \"end\""
_FILE_PARTS = "substr(name, 6, 8) AS date, CAST(substr(name, 15, 2) AS BIGINT) AS line, CAST(substr(name, 18, 3) AS BIGINT) AS number, CAST(substr(name, 6, 8) || substr(name, 15, 2) AS BIGINT) AS line_id"
_FP = f"SELECT name, {_FILE_PARTS} FROM files"


def _files(v: Inputs):
    return catalog.file_parts(v("files"))


# Sources and sinks: what was written is read back.


@query("s1_read_thickness", 'SELECT track AS "Track_name", CAST(trace AS BIGINT) AS "Tracenumber", lat, lon, CAST(trace AS DOUBLE) AS alongtrack_distance_m, content AS "20m_ice_content_m", likelihood FROM thickness')
def s1(v):
    at = v.folder("thickness")
    t = v("thickness").select(F.col("track").alias("Track_name"), F.col("trace").alias("Tracenumber"), "lat", "lon", F.col("trace").cast("double").alias("alongtrack_distance_m"), F.col("content").alias("20m_ice_content_m"), "likelihood")
    files.write_thickness(t, at, as_csv=True)
    return longs(files.read_thickness(v.spark, at).withColumn("Track_name", F.col("Track_name").cast("string")), "Tracenumber")


@query("s2_ragged_lists", "SELECT track, token, count(*) AS n FROM exclusions GROUP BY track, token")
def s2(v):
    at = v.folder("ragged")
    lists = v("exclusions").groupBy("track").agg(F.concat_ws(" ", F.collect_list("token")).alias("t"))
    files.write_lines(lists.select(F.concat_ws(" ", "track", "t").alias("value")), at)
    return files.tokens(files.read_ragged(v.spark, at)).groupBy("track", "token").agg(F.count("*").alias("n"))


@query("s3_start_pixels", "SELECT CAST(p_partkey AS STRING) AS track, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) END AS pixel FROM part")
def s3(v):
    at = v.folder("starts")
    lines = v.table("part").select(F.concat_ws(" ", F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("string"))).alias("value"))
    files.write_lines(lines, at)
    return longs(files.read_starts(v.spark, at), "pixel")


@query("s4_cutoff_file", "SELECT unnest([0.65, 0.7, 0.75, 0.79]::DOUBLE[]) AS quantile, round(unnest(p), 9) AS cutoff FROM (SELECT quantile_cont(likelihood, [0.65, 0.7, 0.75, 0.79]) AS p FROM thickness) AS q")
def s4(v):
    at = v.folder("cutoffs")
    qs = [0.65, 0.7, 0.75, 0.79]
    cut = pooled.percentiles(v("thickness"), "likelihood", qs) or []
    text = v.spark.createDataFrame([(" ".join(map(str, qs)) + "\n" + " ".join(str(round(x, 9)) for x in cut),)], "value string")
    files.write_lines(text.coalesce(1), at)  # one row
    return files.read_cutoffs(v.spark, at)


@query("s5_weather_csv", "SELECT CAST(event_id AS DOUBLE) AS id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS temperature FROM events")
def s5(v):
    at = v.folder("weather")
    e = v.table("events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit("-999")).otherwise(F.regexp_replace(F.col("value").cast("string"), r"\.", ",")).alias("t"))
    e.select(F.col("event_id").alias("id"), F.col("t").alias("temperature")).write.option("header", True).option("sep", ";").csv(at)
    return files.read_weather(v.spark, at)


@query("s6_flight_lines", 'SELECT lat AS "LAT", lon AS "LON", \'00\' || track AS "FRAME" FROM thickness WHERE year >= 2017')
def s6(v):
    a, b = v.folder("lines17"), v.folder("lines18")
    t = v("thickness").select(F.col("lat").alias("LAT"), F.col("lon").alias("LON"), F.concat(F.lit("00"), "track").alias("FRAME"), "year")
    t.where("year = 2017").drop("year").write.option("header", True).csv(a)
    t.where("year = 2018").drop("year").write.option("header", True).csv(b)
    return files.read_flight_lines(v.spark, a, b)


@query("s8_thickness_by_year", "SELECT year, count(*) AS n, round(sum(content), 4) + 0 AS total FROM thickness WHERE year >= 2013 GROUP BY year")
def s8(v):
    at = v.folder("by_year")
    files.write_thickness(v("thickness"), at)
    t = v.spark.read.parquet(at).where("year >= 2013").groupBy("year").agg(F.count("*").alias("n"), r(F.sum("content"), 4).alias("total"))
    return t.withColumn("year", F.col("year").cast("int"))


@query("s9_parameters", "SELECT track, round(avg(content), 6) + 0 AS a FROM thickness GROUP BY track")
def s9(v):
    at = v.folder("parameters")
    files.write_parameters(v("thickness").groupBy("track").agg(r(F.avg("content")).alias("a")), at)
    return v.spark.read.option("header", True).schema("track string, a double").csv(at)


@query("s10_not_done", "SELECT DISTINCT track FROM thickness AS t WHERE NOT EXISTS (SELECT 1 FROM exclusions AS e WHERE e.track = t.track AND e.list = '1' AND e.token LIKE '%-')")
def s10(v):
    return files.not_done(v("thickness").select("track").distinct(), v("exclusions").where("list = '1' and token like '%-'"))


@query("s11_exclusion_lines", "SELECT CAST(p_partkey AS STRING) || ' ' || CASE WHEN p_size % 2 = 0 THEN '' ELSE CAST(p_size AS STRING) END || ' ' || p_brand AS value FROM part WHERE p_partkey % 5 <> 0")
def s11(v):
    at = v.folder("lines")
    log = v.table("part").select(F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey").cast("string")).alias("track"), F.when(F.col("p_size") % 2 != 0, F.col("p_size")).alias("size"), "p_brand")
    files.write_lines(files.exclusion_lines(log, ["size", "p_brand"]), at)
    return v.spark.read.text(at)


# Catalogue.


@query("t1_track_parts", f"SELECT track, {_PARTS} FROM tracks")
def t1(v):
    return longs(catalog.track_parts(v("tracks")), "year", "line", "start", "end")


@query("t2_track_files", f"""WITH p AS (SELECT track, {_PARTS} FROM tracks), n AS (SELECT track, date, line, unnest(range(start, "end" + 1)) AS k FROM p)
SELECT track, 'Data_' || date || '_' || lpad(CAST(line AS STRING), 2, '0') || '_' || lpad(CAST(k AS STRING), 3, '0') || '.mat' AS name FROM n""")
def t2(v):
    return catalog.track_files(v("tracks"))


@query("t3_file_parts", _FP)
def t3(v):
    return longs(_files(v), "line", "number")


@query("t4_normal_names", "SELECT name AS raw, replace(name, 'img_01_', '') AS name FROM raw_files")
def t4(v):
    return catalog.normal_name(v("raw_files").withColumn("raw", F.col("name")))


@query("t5_tracks_of_files", f"""WITH f AS ({_FP}), g AS (SELECT *, number - row_number() OVER (PARTITION BY date, line ORDER BY number) AS island FROM f)
SELECT date || '_' || lpad(CAST(line AS STRING), 2, '0') || '_' || lpad(CAST(min(number) AS STRING), 3, '0') || '_' || lpad(CAST(max(number) AS STRING), 3, '0') AS track, count(*) AS n_files
FROM g GROUP BY date, line, island""")
def t5(v):
    return catalog.tracks_of_files(_files(v))


@query("t6_file_ids", f"WITH f AS ({_FP}) SELECT name, date, line, number, line_id, row_number() OVER (PARTITION BY date, line ORDER BY number, name) AS file_id FROM f")
def t6(v):
    return longs(catalog.file_ids(_files(v)), "line", "number")


@query("t7_trace_numbers", f"""WITH f AS ({_FP}), s AS (SELECT *, number % 4 + 1 AS n, sum(number % 4 + 1) OVER (PARTITION BY line_id ORDER BY number, name) - (number % 4 + 1) AS before FROM f),
e AS (SELECT line_id, name, before, unnest(range(1, n + 1)) AS file_tracenum FROM s)
SELECT line_id, name, file_tracenum, CAST(file_tracenum + before AS BIGINT) AS flight_tracenum FROM e""")
def t7(v):
    return catalog.trace_numbers(_files(v).withColumn("n_traces", F.col("number") % 4 + 1))


@query("t8_coordinates", "SELECT track AS name, trace + 1 AS file_tracenum, lat, lon, roll, CAST(NULL AS DOUBLE) AS heading FROM coordinates")
def t8(v):
    sorted_ = F.sort_array(F.collect_list(F.struct("trace", "lat", "lon", "roll")))
    f = v("coordinates").groupBy("track").agg(sorted_.alias("s")).select(F.col("track").alias("name"), *[F.col(f"s.{c}").alias(c) for c in ("lat", "lon", "roll")])
    return longs(catalog.coordinate_rows(f, ["lat", "lon"], ["roll", "heading"]), "file_tracenum")


@query("t9_files_of_tracks", f"WITH f AS ({_FP}), t AS (SELECT track, {_PARTS} FROM tracks) SELECT t.track, f.name FROM t JOIN f ON t.date = f.date AND t.line = f.line AND f.number BETWEEN t.start AND t.\"end\"")
def t9(v):
    return catalog.files_of_tracks(v("tracks"), _files(v))


@query("t10_bounding_box", "SELECT track, trace, lon, lat FROM thickness WHERE lon BETWEEN -50 AND -40 AND lat BETWEEN 64 AND 70")
def t10(v):
    return catalog.in_box(v("thickness").select("track", "trace", "lon", "lat"), -40, 70, -50, 64)


@query("t11_listed_files", "SELECT name, name IN (SELECT name FROM raw_files) AS listed FROM files")
def t11(v):
    f, names = v("files"), v("raw_files")
    return catalog.listed(f, names).withColumn("listed", F.lit(True)).unionByName(catalog.listed(f, names, keep=False).withColumn("listed", F.lit(False)))


@query("t12_files_touching", "SELECT DISTINCT track || '_' || CAST(trace // 20 AS STRING) AS name FROM thickness WHERE lon >= -50 AND lon < -49.5 AND lat >= 66 AND lat < 67")
def t12(v):
    box = rg.rectangle(F.lit(-50), F.lit(66), F.lit(-49.5), F.lit(67))
    p = v("thickness").withColumns({"name": F.concat("track", F.lit("_"), F.floor(F.col("trace") / 20).cast("string")), "inside": geo.in_ring(F.col("lon"), F.col("lat"), box)})
    return catalog.files_touching(p, "inside")


# Positions.

_E = "0.0818191908426215"
_TS = f"(tan(pi() / 4 - radians(70) / 2) / pow((1 - {_E} * sin(radians(70))) / (1 + {_E} * sin(radians(70))), {_E} / 2))"
_RHO = f"(6378137 * cos(radians(70)) / sqrt(1 - {_E} * {_E} * pow(sin(radians(70)), 2)) / {_TS} * tan(pi() / 4 - radians(lat) / 2) / pow((1 - {_E} * sin(radians(lat))) / (1 + {_E} * sin(radians(lat))), {_E} / 2))"
POLAR = f"{_RHO} * sin(radians(lon + 45)) AS x, -{_RHO} * cos(radians(lon + 45)) AS y"
_XY = f"SELECT *, {POLAR} FROM thickness"
_STEP = "sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2))"


@query("c1_polar", f"SELECT track, trace, round(x, 3) + 0 AS x, round(y, 3) + 0 AS y FROM ({_XY}) AS p")
def c1(v):
    return rounded(track.with_polar(v("thickness")), "x", "y", digits=3).select("track", "trace", "x", "y")


@query("c2_polar_and_back", "SELECT track, trace, round(lon, 8) + 0 AS lon, round(lat, 8) + 0 AS lat FROM thickness")
def c2(v):
    p = track.with_polar(v("thickness"))
    lon, lat = geo.from_polar(F.col("x"), F.col("y"))
    return p.select("track", "trace", r(lon, 8).alias("lon"), r(lat, 8).alias("lat"))


@query("c3_utm", """WITH c AS (SELECT CAST(0.0066943799901413 AS DOUBLE) AS e2, CAST(0.0067394967422764 AS DOUBLE) AS ep), a AS (SELECT track, trace, radians(lat) AS p, radians(lon + 51) * cos(radians(lat)) AS a, e2, ep FROM thickness, c),
b AS (SELECT *, 6378137 / sqrt(1 - e2 * sin(p) * sin(p)) AS n, tan(p) * tan(p) AS t, ep * cos(p) * cos(p) AS k,
  6378137 * ((1 - e2/4 - 3*e2*e2/64 - 5*e2*e2*e2/256) * p - (3*e2/8 + 3*e2*e2/32 + 45*e2*e2*e2/1024) * sin(2*p) + (15*e2*e2/256 + 45*e2*e2*e2/1024) * sin(4*p) - 35*e2*e2*e2/3072 * sin(6*p)) AS m FROM a)
SELECT track, trace, round(500000 + 0.9996 * n * (a + (1 - t + k) * a*a*a / 6 + (5 - 18*t + t*t + 72*k - 58*ep) * a*a*a*a*a / 120), 3) AS east,
 round(0.9996 * (m + n * tan(p) * (a*a/2 + (5 - t + 9*k + 4*k*k) * a*a*a*a / 24 + (61 - 58*t + t*t + 600*k - 330*ep) * a*a*a*a*a*a / 720)), 3) AS north FROM b""")
def c3(v):
    e, n = geo.to_utm22(F.col("lon"), F.col("lat"))
    return v("thickness").select("track", "trace", r(e, 3).alias("east"), r(n, 3).alias("north"))


@query("c4_distance", f"SELECT track, trace, round(sum(coalesce(d, 0)) OVER (PARTITION BY track ORDER BY trace), 2) + 0 AS distance FROM (SELECT track, trace, {_STEP} AS d FROM ({_XY}) AS p WINDOW w AS (PARTITION BY track ORDER BY trace)) AS s")
def c4(v):
    return rounded(track.with_distance(track.with_polar(v("thickness"))), "distance", digits=2).select("track", "trace", "distance")


@query("c5_step_summary", f"SELECT track, round(sum(d), 1) + 0 AS total, round(avg(d), 3) + 0 AS mean_step FROM (SELECT track, {_STEP} AS d FROM ({_XY}) AS p WINDOW w AS (PARTITION BY track ORDER BY trace)) AS s GROUP BY GROUPING SETS ((track), ())")
def c5(v):
    s = track.step_summary(track.with_polar(v("thickness")))
    return s.select("track", r("total", 1).alias("total"), r("mean_step", 3).alias("mean_step"))


@query("c6_curvature", f"""WITH p AS ({_XY}), q AS (SELECT track, trace, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS b_y FROM p WINDOW w AS (PARTITION BY track ORDER BY trace)),
l AS (SELECT *, sqrt(ax*ax + ay*ay) AS la, sqrt(bx*bx + b_y*b_y) AS lb FROM q),
a AS (SELECT track, trace, la, lb, CASE WHEN la * lb > 0 THEN acos(greatest(-1, least(1, (ax*bx + ay*b_y) / (la*lb)))) END AS c FROM l)
SELECT track, trace, round(c, 5) + 0 AS curvature, round(1e6 * c / ((la + lb) / 2), 4) + 0 AS per_km FROM a""")
def c6(v):
    c = track.with_curvature(track.with_polar(v("thickness")))
    return c.select("track", "trace", r("curvature", 5).alias("curvature"), r(F.col("curvature_per_m") * 1e6, 4).alias("per_km"))


@query("c7_eastward", """WITH e AS (SELECT track, arg_min(lon, trace) AS a, arg_max(lon, trace) AS b, count(*) AS n FROM thickness GROUP BY track)
SELECT t.track, CASE WHEN b < a THEN n - 1 - trace ELSE trace END AS trace, lon FROM thickness AS t JOIN e ON e.track = t.track""")
def c7(v):
    return track.eastward(v("thickness")).select("track", "trace", "lon")


@query("c8_nearest_trace", "SELECT track, m.trace AS trace, m.lon AS lon FROM (SELECT track, min(struct_pack(off := abs(lon + 47.3), trace := trace, lon := lon)) AS m FROM thickness WHERE abs(lon + 47.3) <= 0.2 GROUP BY track) AS n")
def c8(v):
    return track.nearest_trace(v("thickness"), -47.3)


# Some points are far from every trace of their track.
_PTS = "SELECT p_partkey AS point, CAST(p_partkey % 100 AS STRING) AS track, -75 + (p_partkey % 600) / CAST(10 AS DOUBLE) AS px, CAST(p_size AS DOUBLE) * 0.7 AS depth FROM part"


def _outline_points(v: Inputs):
    return v.table("part").select(F.col("p_partkey").alias("point"), (F.col("p_partkey") % 100).cast("string").alias("track"), (-75 + (F.col("p_partkey") % 600) / F.lit(10.0)).alias("px"), (F.col("p_size").cast("double") * 0.7).alias("depth"))


@query("c9_nearest_on_track", f"""WITH pts AS ({_PTS}), d AS (SELECT point, t.track, trace, abs(lon - px) AS off FROM pts JOIN thickness AS t ON t.track = pts.track),
k AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY off, trace) AS k FROM d) SELECT point, track, trace, round(off, 6) + 0 AS off FROM k WHERE k = 1""")
def c9(v):
    return rounded(track.nearest_on_track(_outline_points(v).drop("depth"), v("thickness").select("track", "trace", F.col("lon").alias("x")), 0.25), "off")


@query("c9_nearest_depth", f"""WITH pts AS ({_PTS}), t AS (SELECT DISTINCT track FROM thickness), d AS (SELECT point, pts.track, i AS depth_idx, row_number() OVER (PARTITION BY point ORDER BY abs(i * 0.3 + length(pts.track) * 0.1 - depth), i) AS k
FROM pts JOIN t ON t.track = pts.track, (SELECT unnest(range(80)) AS i) AS n) SELECT point, track, CAST(depth_idx AS INT) AS depth_idx FROM d WHERE k = 1""")
def c9_depth(v):
    axes = v("thickness").select("track").distinct().withColumn("depths", F.transform(F.sequence(F.lit(0), F.lit(79)), lambda i: i * F.lit(0.3) + F.length("track") * F.lit(0.1)))
    return track.nearest_depth(_outline_points(v).drop("px"), axes).select("point", "track", "depth_idx")


@query("c10_clean_gps", "SELECT event_id, nullif(value, 0) AS lat, -nullif(CASE WHEN event_id % 9 = 0 THEN 0 ELSE value END, 0) AS lon FROM events")
def c10(v):
    e = v.table("events").select("event_id", F.col("value").alias("lat"), F.when(F.col("event_id") % 9 == 0, 0.0).otherwise(F.col("value")).alias("lon"))
    return track.clean_gps(e)


# Masks.

_LO = "CASE WHEN token LIKE '-%' THEN 0 WHEN strpos(token, '-') > 0 THEN CAST(substr(token, 1, strpos(token, '-') - 1) AS BIGINT) ELSE CAST(token AS BIGINT) END"
_HI = "CASE WHEN token LIKE '%-' THEN 2147483647 WHEN strpos(token, '-') > 0 THEN CAST(substr(token, strpos(token, '-') + 1) AS BIGINT) ELSE CAST(token AS BIGINT) END"
_SPANS = f"SELECT track, token, list, {_LO} AS lo, {_HI} AS hi FROM exclusions"


@query("m1_intervals", _SPANS)
def m1(v):
    return masks.intervals(v("exclusions"))


def _spans(v, which=None, single=True):
    e = v("exclusions")
    return masks.intervals((e if which is None else e.where(F.col("list") == which)).distinct(), single=single)


@query("m2_masked_out", f"WITH s AS ({_SPANS}) SELECT track, trace FROM thickness AS t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.list = '2' AND s.track = t.track AND t.trace BETWEEN s.lo AND s.hi)")
def m2(v):
    return masks.masked_out(v("thickness"), _spans(v, "2")).select("track", "trace")


@query("m3_porous_firn", f"WITH s AS ({_SPANS}) SELECT track, trace, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.list = '0' AND s.token LIKE '%-%' AND s.track = t.track AND t.trace >= s.lo AND t.trace < s.hi) THEN 0 ELSE likelihood END AS likelihood FROM thickness AS t")
def m3(v):
    return masks.with_porous_firn(v("thickness"), _spans(v, "0", single=False)).select("track", "trace", "likelihood")


@query("m4_complete_traces", "SELECT track, trace, trace % 7 NOT IN (2, 5) AS complete FROM traces")
def m4(v):
    gap = F.when(F.col("trace") % 7 == 5, F.lit(float("nan")))  # else null
    holed = F.transform("samples", lambda x, i: F.when((i == F.col("trace") % 64) & (F.col("trace") % 7).isin(2, 5), gap).otherwise(x))
    return v("traces").withColumn("samples", holed).select("track", "trace", masks.complete().alias("complete"))


@query("m5_mask_and_restore", f"WITH s AS ({_SPANS}) SELECT track, trace, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.list = '1' AND s.track = t.track AND t.trace BETWEEN s.lo AND s.hi) THEN NULL ELSE content END AS content FROM thickness AS t")
def m5(v):
    t = v("thickness")
    return masks.restored(masks.masked_out(t, _spans(v, "1")).select("track", "trace", "content"), t)


@query("m6_exclusion_shares", f"""WITH s AS ({_SPANS}), h AS (SELECT DISTINCT s.list, t.track, t.trace FROM thickness AS t JOIN s ON s.track = t.track AND t.trace BETWEEN s.lo AND s.hi)
SELECT list, count(*) AS n_excluded, round(100 * count(*) / CAST((SELECT count(*) FROM thickness) AS DOUBLE), 6) + 0 AS percent FROM h GROUP BY list""")
def m6(v):
    return rounded(masks.exclusion_shares(v("thickness"), _spans(v)), "percent")


@query("m7_distrusted_range", "SELECT track, trace, CASE WHEN track = '7' AND trace BETWEEN 10 AND 99 THEN 0 ELSE content END AS content, CASE WHEN track = '7' AND trace BETWEEN 10 AND 99 THEN NULL ELSE likelihood END AS likelihood, NOT (track = '7' AND trace BETWEEN 10 AND 99) AS mask FROM thickness")
def m7(v):
    return masks.with_rule(v("thickness").select("track", "trace", "content", "likelihood"), (("7", 10, 99),))


@query("m8_nulled", f"WITH s AS ({_SPANS}) SELECT track, trace, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.track = t.track AND t.trace BETWEEN s.lo AND s.hi) THEN NULL ELSE content END AS content FROM thickness AS t")
def m8(v):
    return masks.nulled(v("thickness").select("track", "trace", "content"), _spans(v), "content")
