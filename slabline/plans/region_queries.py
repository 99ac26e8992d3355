"""Queries of the GPS match, regions and transects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gpsmatch, track
from ..operators import regions as rg
from ..operators import transects as ts
from . import jobs
from .catalog_queries import POLAR
from .registry import Inputs, query, r, rounded

# Matching of 2002-2003.

_MATCH = """g AS (SELECT second, index_gps, lat, lon, row_number() OVER (PARTITION BY second ORDER BY index_gps) AS k, count(*) OVER (PARTITION BY second) AS n FROM gps_master),
a AS (SELECT *, row_number() OVER (PARTITION BY radargram, second ORDER BY index_vector) AS k, count(*) OVER (PARTITION BY radargram, second) AS same, min(second) OVER (PARTITION BY radargram) AS first FROM radar_times),
c AS (SELECT second, count(*) AS n FROM gps_master GROUP BY second),
b AS (SELECT a.radargram, a.second, a.index_vector, a.k + CASE WHEN a.second = first AND same = 1 AND c.n > 1 THEN 1 ELSE 0 END AS k FROM a LEFT JOIN c ON c.second = a.second),
m AS (SELECT b.radargram, b.second, b.index_vector, g.index_gps, coalesce(g.lat, 0) AS lat, coalesce(g.lon, 0) AS lon FROM b LEFT JOIN g ON g.second = b.second AND g.k = b.k)"""


def _matched(v: Inputs):
    return gpsmatch.matched(v("radar_times"), v("gps_master"))


@query("j1_matched", f"WITH {_MATCH} SELECT * FROM m")
def j1(v):
    return _matched(v).select("radargram", "second", "index_vector", "index_gps", "lat", "lon")


@query("j2_limited", "SELECT t.radargram, index_vector FROM radar_times AS t LEFT JOIN part AS p ON CAST(p.p_partkey AS STRING) = t.radargram AND p.p_size % 4 = 0 WHERE p.p_partkey IS NULL OR index_vector < p.p_size * 5")
def j2(v):
    limits = v.table("part").where("p_size % 4 = 0").select(F.col("p_partkey").cast("string").alias("radargram"), (F.col("p_size") * 5).alias("n"))
    return gpsmatch.limited(v("radar_times").select("radargram", "index_vector"), limits)


@query("j3_quality", f"""WITH {_MATCH}, q AS (SELECT radargram, index_gps IS NOT NULL AS ok, row_number() OVER (PARTITION BY radargram ORDER BY index_vector) AS a, row_number() OVER (PARTITION BY radargram ORDER BY index_vector DESC) AS b FROM m)
SELECT radargram, count(*) FILTER (WHERE a = 1 AND ok) AS first_match, count(*) FILTER (WHERE b = 1 AND ok) AS last_match, count(*) FILTER (WHERE a <= 3 AND ok) AS first_3, count(*) FILTER (WHERE b <= 3 AND ok) AS last_3, count(*) AS n_rows, count(*) FILTER (WHERE ok) AS n_matched, count(*) FILTER (WHERE ok) = count(*) AS length_match FROM q GROUP BY radargram""")
def j3(v):
    return gpsmatch.quality(_matched(v))


_CODES = "CASE substr(colour, 1, 3) WHEN 'red' THEN -1 WHEN 'ora' THEN 0 WHEN 'gre' THEN 1 WHEN 'pur' THEN 2 END"
_OUTLINES = f"""SELECT track, outline, trace, code FROM (SELECT *, max(trace) OVER (PARTITION BY track, outline) AS last FROM (SELECT DISTINCT track, outline, CAST(round_even(xcoord, 0) AS BIGINT) AS trace, {_CODES} AS code
FROM outlines WHERE xcoord IS NOT NULL) AS d WHERE code IS NOT NULL) AS o WHERE NOT (last >= 250 AND trace = last)"""


@query("j4_outline_traces", _OUTLINES)
def j4(v):
    return gpsmatch.outline_traces(v("outlines"), 250)


@query("j5_confident", f"SELECT * FROM ({_OUTLINES}) AS o WHERE code = 1")
def j5(v):
    return gpsmatch.confident(gpsmatch.outline_traces(v("outlines"), 250))


@query("s12_confident_csv", f"SELECT * FROM ({_OUTLINES}) AS o WHERE code = 1")
def s12(v):
    from ..sources import files

    at = v.folder("confident")
    files.write_confident(gpsmatch.outline_traces(v("outlines"), 250), at)
    return v.spark.read.option("header", True).schema("track string, outline int, trace long, code int").csv(at)


@query("j6_candidates", "SELECT radargram, count(*) AS n FROM radar_times WHERE radargram IN (SELECT CAST(p_partkey AS STRING) FROM part WHERE p_size > 25) GROUP BY radargram")
def j6(v):
    names = v.table("part").where("p_size > 25").select(F.col("p_partkey").cast("string").alias("radargram"))
    return gpsmatch.candidates(v("radar_times"), names).groupBy("radargram").agg(F.count("*").alias("n"))


# Regions.

_IN = "t.lon >= a.x0 AND t.lon < a.x1 AND t.lat >= a.y0 AND t.lat < a.y1"
_BEST = "arg_min(a.region, CASE a.region WHEN 'NO' THEN 1 WHEN 'NE' THEN 2 WHEN 'SE' THEN 3 WHEN 'SW' THEN 4 WHEN 'CW' THEN 5 ELSE 6 END)"
_REGION = f"SELECT t.*, coalesce((SELECT {_BEST} FROM areas AS a WHERE {_IN}), 'Out') AS region FROM thickness AS t"
_PERIOD = "CASE WHEN year BETWEEN 2002 AND 2003 THEN '2002-2003' WHEN year = 2010 THEN '2010' WHEN year BETWEEN 2011 AND 2012 THEN '2011-2012' WHEN year BETWEEN 2013 AND 2014 THEN '2013-2014' WHEN year BETWEEN 2017 AND 2018 THEN '2017-2018' END"


def _regions(v: Inputs):
    return jobs.named_points(v("thickness"), jobs.polygons(v("areas")))


@query("g1_within", "SELECT t.track, t.trace, a.region FROM thickness AS t JOIN (SELECT CAST('tri' AS STRING) AS region) AS a ON t.lat >= 64 AND t.lat < 70 AND t.lon + 55 >= 0 AND t.lon + 55 < (70 - t.lat) * 2")
def g1(v):
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    tri = v.spark.range(1).select(F.lit(1).alias("id"), F.lit("tri").alias("region"), F.array(corner(-55, 64), corner(-43, 64), corner(-55, 70)).alias("ring"))
    return rg.within(v("thickness"), tri, "lon", "lat").select("track", "trace", "region")


@query("g1_concave", "SELECT track, trace FROM thickness WHERE lat >= 64 AND lat < 70 AND lon >= -55 AND lon < CASE WHEN lat < 67 THEN -43 ELSE -49 END")
def g1_concave(v):
    corners = [(-55, 64), (-43, 64), (-43, 67), (-49, 67), (-49, 70), (-55, 70)]
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in corners])
    return rg.within(v("thickness"), v.spark.range(1).select(F.lit(1).alias("id"), F.lit("bend").alias("region"), ring.alias("ring")), "lon", "lat").select("track", "trace")


@query("g2_clipped", f"SELECT t.track, t.trace, min(a.id) AS id, arg_min(a.region, a.id) AS region FROM thickness AS t JOIN areas AS a ON {_IN} GROUP BY t.track, t.trace")
def g2(v):
    return rg.clipped(v("thickness").select("track", "trace", "lon", "lat"), jobs.polygons(v("areas")), ["track", "trace"], "lon", "lat").select("track", "trace", "id", "region")


@query("g3_region", f"SELECT track, trace, region FROM ({_REGION}) AS g")
def g3(v):
    return _regions(v).select("track", "trace", "region")


@query("g4_elevation", "SELECT t.track, t.trace, d.elevation AS dem FROM thickness AS t LEFT JOIN dem AS d ON d.row = CAST(floor((80 - t.lat) * 10) AS BIGINT) AND d.col = CAST(floor((60 + t.lon) * 10) AS BIGINT)")
def g4(v):
    t, d = v("thickness").select("track", "trace", "lat", "lon"), v("dem")
    return rg.with_elevation(t.withColumns({"x": (60 + F.col("lon")) * 10, "y": (80 - F.col("lat")) * -10}), d, 0.0, 0.0, 1.0).select("track", "trace", "dem")


_LENSES = f"""WITH t AS (SELECT r.* FROM radar_times AS r JOIN part AS p ON CAST(p.p_partkey AS STRING) = r.radargram WHERE p.p_size > 25 AND (p.p_size % 4 <> 0 OR index_vector < p.p_size * 5)), {_MATCH.replace("FROM radar_times", "FROM t")},
o AS ({_OUTLINES}), q AS (SELECT o.track, outline, o.trace, nullif(lat, 0) AS lat, nullif(lon, 0) AS lon FROM o JOIN m ON m.radargram = o.track AND m.index_vector = o.trace WHERE code = 1)"""


@query("flow_lens_points", f"""{_LENSES} SELECT t.track, outline, t.trace, round(lat, 9) AS lat, round(lon, 9) AS lon, coalesce((SELECT {_BEST} FROM areas AS a WHERE {_IN}), 'Out') AS region, d.elevation AS dem
FROM q AS t LEFT JOIN dem AS d ON d.row = CAST(floor((80 - t.lat) * 10) AS BIGINT) AND d.col = CAST(floor((60 + t.lon) * 10) AS BIGINT)""")
def flow_lenses(v):
    """The 2002-2003 flow: times to positions, outlines to traces, confident ice with region and elevation."""
    part, name = v.table("part"), F.col("p_partkey").cast("string").alias("radargram")
    limits = part.where("p_size % 4 = 0").select(name, (F.col("p_size") * 5).alias("n"))
    gps = v("gps_master").withColumn("lon", -F.col("lon"))
    at = jobs.lens_points(v("radar_times"), gps, part.where("p_size > 25").select(name), limits, v("outlines"), 250, jobs.polygons(v("areas")))
    grid = rg.with_elevation(at.withColumns({"x": (60 + F.col("lon")) * 10, "y": (80 - F.col("lat")) * -10}), v("dem"), 0.0, 0.0, 1.0)
    return grid.select("track", "outline", "trace", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "region", "dem")


@query("g5_year_and_period", f"WITH n AS (SELECT track, CAST(substr(track, 1, 4) AS INT) AS year FROM tracks UNION ALL SELECT 'may' || lpad(CAST(p_size AS STRING), 2, '0') || '_0' || CAST(p_partkey % 2 + 2 AS STRING) || '_' || CAST(p_partkey AS STRING), CAST(2002 + p_partkey % 2 AS INT) FROM part) SELECT track, year, {_PERIOD} AS period FROM n")
def g5(v):
    old = F.concat(F.lit("may"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("_0"), (F.col("p_partkey") % 2 + 2).cast("string"), F.lit("_"), F.col("p_partkey").cast("string"))
    n = v("tracks").unionByName(v.table("part").select(old.alias("track"))).withColumn("year", rg.year_of(F.col("track")))
    return n.withColumn("period", rg.period_of(F.col("year")))


@query("g6_union_years", "SELECT track, trace, CASE WHEN year > 2012 THEN likelihood END AS likelihood, year, CAST(year AS STRING) AS str_year FROM thickness WHERE year IN (2010, 2013, 2018)")
def g6(v):
    t = v("thickness")
    of = {y: t.where(F.col("year") == y).select("track", "trace", *(["likelihood"] if y > 2012 else [])) for y in (2010, 2013, 2018)}
    return rg.union_years(of).select("track", "trace", "likelihood", "year", "str_year")


@query("g7_detections", f"SELECT track, trace, round(x, 3) + 0 AS x, round(y, 3) + 0 AS y FROM (SELECT *, {POLAR} FROM thickness WHERE year IN (2010, 2013) AND lat < 75) AS p")
def g7(v):
    t = v("thickness")
    both = rg.union_years({y: t.where(F.col("year") == y).select("track", "trace", "lon", "lat") for y in (2010, 2013)}).where("lat < 75")
    return rounded(track.with_polar(both), "x", "y", digits=3).select("track", "trace", "x", "y")


@query("g8_cumulative", "WITH p AS (SELECT unnest(['2010', '2011-2012', '2013-2014', '2017-2018']) AS period, unnest([2010, 2012, 2014, 2018]) AS last) SELECT period, count(*) AS n, round(sum(content), 4) + 0 AS total FROM thickness JOIN p ON year <= last GROUP BY period")
def g8(v):
    return rg.by_period(v("thickness"), cumulative=True).groupBy("period").agg(F.count("*").alias("n"), r(F.sum("content"), 4).alias("total"))


_NORTH = f"SELECT region, {_PERIOD} AS period, CAST(floor((y + 3000000) / (CAST(1850000 AS DOUBLE) / 184)) AS BIGINT) + 1 AS slice, elevation FROM (SELECT *, {POLAR} FROM ({_REGION}) AS g) AS p WHERE y >= -3000000 AND CAST(floor((y + 3000000) / (CAST(1850000 AS DOUBLE) / 184)) AS BIGINT) + 1 <= 184 AND content BETWEEN 1 AND 16"
_EAST = f"SELECT region, {_PERIOD} AS period, CAST(floor((x + 600000) / (CAST(1250000 AS DOUBLE) / 124)) AS BIGINT) + 1 AS slice, elevation FROM (SELECT *, {POLAR} FROM ({_REGION}) AS g) AS p WHERE x >= -600000 AND CAST(floor((x + 600000) / (CAST(1250000 AS DOUBLE) / 124)) AS BIGINT) + 1 <= 124 AND content BETWEEN 1 AND 16"
_HIGH = f"SELECT region, period, slice, min(elevation) AS low, max(elevation) AS high FROM ({{}}) AS s GROUP BY region, period, slice"


@query("g9_northing_slices", _HIGH.format(_NORTH))
def g9(v):
    return rg.slice_limits(jobs.slab_points(v("thickness"), jobs.polygons(v("areas"))), rg.NORTHING, "y")


@query("g9_easting_slices", _HIGH.format(_EAST))
def g9_east(v):
    return rg.slice_limits(jobs.slab_points(v("thickness"), jobs.polygons(v("areas"))), rg.EASTING, "x")


_SUMMARY = f"""SELECT region, period, avg(high) AS mean_high, median(high) AS median_high, stddev_pop(high) AS sd_high, max(high) AS max_high FROM (SELECT * FROM ({_HIGH.format(_NORTH)}) AS a WHERE region <> 'NO' UNION ALL SELECT * FROM ({_HIGH.format(_EAST)}) AS b WHERE region = 'NO') AS u GROUP BY region, period"""


@query("g10_region_summary", f"SELECT region, period, round(mean_high, 4) AS mean_high, round(median_high, 4) AS median_high, round(sd_high, 4) + 0 AS sd_high, max_high FROM ({_SUMMARY}) AS q")
def g10(v):
    return rounded(jobs.elevation_limits(v("thickness"), jobs.polygons(v("areas"))), "mean_high", "median_high", "sd_high", digits=4)


_GRIDDED = f"""SELECT g.track, g.trace, g.lat, g.lon, g.content, g.year, g.region, d.elevation FROM ({_REGION}) AS g LEFT JOIN dem AS d ON d.row = CAST(floor((80 - g.lat) / 0.125) AS BIGINT) AND d.col = CAST(floor((g.lon + 60) / 0.125) AS BIGINT)
WHERE (g.lon >= -58 AND g.lon < -40 AND g.lat >= 63 AND g.lat < 79) OR (g.lon >= -45 AND g.lon < -32 AND g.lat >= 64 AND g.lat < 78)"""


@query("flow_points_to_summary", f"SELECT region, period, round(mean_high, 4) AS mean_high, round(median_high, 4) AS median_high, round(sd_high, 4) + 0 AS sd_high, max_high FROM ({_SUMMARY.replace(f'({_REGION})', f'({_GRIDDED})')}) AS q")
def flow_points(v):
    """The second flow whole: clipped to the ice sheet, named, with elevations from the grid, by slices."""
    corners = [(1, -58.0, 63.0, -40.0, 79.0), (2, -45.0, 64.0, -32.0, 78.0)]
    sheet = v.spark.createDataFrame(corners, "id int, x0 double, y0 double, x1 double, y1 double").withColumn("region", F.lit("sheet"))
    got = jobs.gridded_limits(v("thickness"), jobs.polygons(sheet), jobs.polygons(v("areas")), v("dem"), -60.0, 80.0, 0.125)
    return rounded(got, "mean_high", "median_high", "sd_high", digits=4)


@query("g11_period_change", f"WITH q AS ({_SUMMARY}), w AS (SELECT region, max(CASE WHEN period = '2011-2012' THEN median_high END) AS first, max(CASE WHEN period = '2017-2018' THEN median_high END) AS last FROM q GROUP BY region) SELECT region, first, last, last - first AS change FROM w")
def g11(v):
    return rg.period_change(jobs.elevation_limits(v("thickness"), jobs.polygons(v("areas"))), "2011-2012", "2017-2018")


@query("g12_group_limits", "SELECT CAST(s_suppkey % 9 AS BIGINT) AS grp, min(CASE WHEN s_suppkey % 3 > 0 THEN elevation END) AS low, max(CASE WHEN s_suppkey % 5 > 0 THEN elevation END) AS high FROM thickness JOIN supplier ON CAST(s_suppkey AS STRING) = track GROUP BY 1")
def g12(v):
    k = F.col("s_suppkey")
    groups = v.table("supplier").select(k.cast("string").alias("track"), (k % 9).alias("grp"), (k % 3 > 0).alias("low_ok"), (k % 5 > 0).alias("high_ok"))
    return rg.group_limits(v("thickness"), groups)


def _hulls(v: Inputs):
    return rg.hull_areas(jobs.slab_points(v("thickness"), jobs.polygons(v("areas"))))


@query("g13_hull_areas")
def g13(v):
    return _hulls(v)


@query("g13_hull_change")
def g13_change(v):
    return rg.area_change(_hulls(v), "2011-2012", "2017-2018")


def _masks(v: Inputs):
    """Rectangles of several sizes, five of which make a region's mask of one name; some overlap."""
    k = F.col("n_nationkey")
    of = lambda *values: F.element_at(F.array(*[F.lit(z) for z in values]), (k % 5 + 1).cast("int"))
    region, n = of("NO", "NE", "SW", "CW", "NW"), F.floor(k / 5)
    x, y = of(-390_000, 80_000, -790_000, -680_000, -530_000) + n * 100_000, of(-1_520_000, -2_180_000, -3_090_000, -2_690_000, -2_070_000) + n * 60_000
    ring = rg.rectangle(x, y, x + 250_000 + k * 9000, y + 200_000 + k * 11_000)
    return v.table("nation").select(F.concat(F.lit("m"), (k % 3).cast("string")).alias("mask"), region.alias("region"), ring.alias("ring"))


@query("g13_mask_areas")
def g13_masks(v):
    """Hulls of the points in each mask of their region, added by region and period."""
    points = rg.in_masks(jobs.slab_points(v("thickness"), jobs.polygons(v("areas"))), _masks(v))
    return rg.hull_areas(points, by=("mask",))


_SHAPES = "SELECT CAST(p_partkey AS INT) AS id, 'R' || CAST(p_size % 6 AS STRING) AS region, CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS period, CAST(p_size AS DOUBLE) AS w, p_retailprice / 100 AS h FROM part"


def _shapes(v: Inputs):
    """L-shaped rings whose size depends on the part."""
    w, h = F.col("p_size").cast("double"), F.col("p_retailprice") / 100
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0.0)
    ring = F.array(at(zero, zero), at(w, zero), at(w, h / 2), at(w / 2, h / 2), at(w / 2, h), at(zero, h))
    return v.table("part").select(F.col("p_partkey").cast("int").alias("id"), F.concat(F.lit("R"), (F.col("p_size") % 6).cast("string")).alias("region"), F.when(F.col("p_partkey") % 2 == 0, "a").otherwise("b").alias("period"), ring.alias("ring"))


@query("g14_polygon_areas", f"SELECT region, period, round(sum(w * h * 0.75), 2) AS area FROM ({_SHAPES}) AS s GROUP BY region, period")
def g14(v):
    s = _shapes(v)
    return rounded(rg.polygon_areas(s), "area", digits=2)


@query("g14_area_change", f"WITH s AS (SELECT region, sum(CASE WHEN period = 'a' THEN w * h * 0.75 END) AS first, sum(CASE WHEN period = 'b' THEN w * h * 0.75 END) AS last FROM ({_SHAPES}) AS s WHERE id NOT IN (10, 11) GROUP BY region) SELECT region, round(first, 3) AS first, round(last, 3) AS last, round(last - first, 3) + 0 AS change, round((last - first) / first * 100, 5) + 0 AS percent FROM s")
def g14_change(v):
    s = _shapes(v)
    return rounded(rounded(rg.area_change(rg.polygon_areas(s, (10, 11)), "a", "b"), "first", "last", "change", digits=3), "percent", digits=5)


# Transects.

_TR = """SELECT 'T' || CAST(s_suppkey % 4 AS STRING) AS transect, t.*, lon AS x, lat AS y FROM thickness AS t JOIN supplier ON CAST(s_suppkey AS STRING) = t.track
WHERE lon >= -58 + (s_suppkey % 4) AND lon <= -40 AND (s_suppkey % 4 = 1 OR lat <= 75)"""


def _transects(v: Inputs):
    k = F.col("s_suppkey")
    listed = v.table("supplier").select(
        F.concat(F.lit("T"), (k % 4).cast("string")).alias("transect"), k.cast("string").alias("track"), (-58 + k % 4).cast("double").alias("lon0"), F.lit(-40.0).alias("lon1"), F.lit(None).cast("double").alias("lat0"), F.when(k % 4 != 1, 75.0).alias("lat1")
    )
    return ts.of_transects(v("thickness"), listed).withColumns({"x": F.col("lon"), "y": F.col("lat")})


@query("p1_transect_points", f"SELECT transect, track, trace FROM ({_TR}) AS p")
def p1(v):
    return _transects(v).select("transect", "track", "trace")


@query("p2_capped", "SELECT track, trace, least(content, 16) AS content FROM thickness")
def p2(v):
    return ts.capped(v("thickness")).select("track", "trace", "content")


@query("p3_distance", f"""WITH p AS ({_TR}), o AS (SELECT *, CASE WHEN year = 2011 THEN y ELSE x END AS k FROM p), d AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM o WINDOW w AS (PARTITION BY transect, year ORDER BY k, track, trace)),
s AS (SELECT transect, min(x) AS sx FROM p GROUP BY transect), s2 AS (SELECT p.transect, sx, min(y) AS sy FROM p JOIN s ON s.transect = p.transect AND p.x = s.sx GROUP BY p.transect, sx)
SELECT d.transect, year, track, trace, round(sum(coalesce(d, 0)) OVER (PARTITION BY d.transect, year ORDER BY k, track, trace) + CASE WHEN year = 2010 THEN 0 ELSE sqrt(pow(fx - sx, 2) + pow(fy - sy, 2)) END, 4) + 0 AS distance FROM d JOIN s2 ON s2.transect = d.transect""")
def p3(v):
    d = ts.transect_distance(_transects(v), own_start=(2010,))
    return rounded(d, "distance", digits=4).select("transect", "year", "track", "trace", "distance")


_LINE = f"SELECT transect, year, track, trace, lon, content, (lon + 60) * 1000 AS distance FROM ({_TR}) AS p"
_BINS = f"""SELECT transect, year, CAST(floor(distance / 37) AS BIGINT) AS bin, avg(content) AS mean_value, median(content) AS median_value, quantile_cont(content, 0.25) AS q25, quantile_cont(content, 0.75) AS q75, stddev_samp(content) AS sd_value, count(content) AS n FROM ({_LINE}) AS l GROUP BY 1, 2, 3"""
_FULL = f"""b AS ({_BINS}), e AS (SELECT transect, year, min(bin) AS lo, max(bin) AS hi FROM b GROUP BY transect, year), g AS (SELECT transect, year, unnest(range(lo, hi + 1)) AS bin FROM e),
f AS (SELECT g.transect, g.year, g.bin, mean_value, median_value, q25, q75, sd_value, coalesce(n, 0) AS n FROM g LEFT JOIN b ON b.transect = g.transect AND b.year = g.year AND b.bin = g.bin)"""
_KEYS = ["transect", "year"]


def _line(v: Inputs):
    return _transects(v).withColumn("distance", (F.col("lon") + 60) * 1000)


def _bins(v: Inputs):
    return ts.binned(_line(v), _KEYS, 37.0)


@query("p4_binned", f"WITH {_FULL} SELECT transect, year, bin, round(mean_value, 6) AS mean_value, round(median_value, 6) AS median_value, round(q25, 6) AS q25, round(q75, 6) AS q75, round(sd_value, 6) + 0 AS sd_value, n FROM f")
def p4(v):
    return rounded(_bins(v), "mean_value", "median_value", "q25", "q75", "sd_value")


_ROLL = """r AS (SELECT transect, year, bin, median_value, CASE WHEN lag(median_value) OVER w IS NOT NULL AND median_value IS NOT NULL AND lead(median_value) OVER w IS NOT NULL THEN
 lag(median_value) OVER w + median_value + lead(median_value) OVER w - greatest(lag(median_value) OVER w, median_value, lead(median_value) OVER w) - least(lag(median_value) OVER w, median_value, lead(median_value) OVER w) END AS m FROM f WINDOW w AS (PARTITION BY transect, year ORDER BY bin))"""


@query("p5_rolling", f"WITH {_FULL}, {_ROLL} SELECT transect, year, bin, round(m, 6) AS roll_median_value FROM r")
def p5(v):
    return rounded(ts.rolling(_bins(v), _KEYS).select("transect", "year", "bin", "roll_median_value"), "roll_median_value")


@query("p6_gap_edges", f"WITH {_FULL}, {_ROLL}, x AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY transect, year) AS n, lag(m) OVER w AS b, lead(m) OVER w AS a FROM r WINDOW w AS (PARTITION BY transect, year ORDER BY bin)) SELECT transect, year, bin, round(CASE WHEN m IS NULL THEN median_value WHEN (k > 1 AND b IS NULL) OR (k < n AND a IS NULL) THEN m END, 6) AS edge FROM x")
def p6(v):
    return rounded(ts.gap_edges(ts.rolling(_bins(v), _KEYS), _KEYS).select("transect", "year", "bin", "edge"), "edge")


SECTORS = [("low", 0.0, 8000.0), ("middle", 8000.0, 14000.0), ("high", 14000.0, None)]
_SECTOR = "CASE WHEN distance >= 0 AND distance < 8000 THEN 'low' WHEN distance >= 8000 AND distance < 14000 THEN 'middle' WHEN distance >= 14000 THEN 'high' END"
_AREA = f"SELECT transect, sector, year, count(*) AS n, sum(content) * (max(distance) - min(distance)) / (count(*) - 1) AS area FROM (SELECT *, {_SECTOR} AS sector FROM ({_LINE}) AS l) AS s GROUP BY transect, sector, year"


def _areas(v: Inputs):
    return ts.sector_area(ts.with_sector(_line(v), SECTORS), ["transect", "sector", "year"])


@query("p7_sectors", f"SELECT transect, track, trace, {_SECTOR} AS sector FROM ({_LINE}) AS l")
def p7(v):
    return ts.with_sector(_line(v), SECTORS).select("transect", "track", "trace", "sector")


@query("p8_sector_area", f"SELECT transect, sector, year, n, round(area, 3) AS area FROM ({_AREA}) AS a")
def p8(v):
    return rounded(_areas(v), "area", digits=3)


@query("p8_area_change", f"WITH w AS (SELECT transect, sector, max(CASE WHEN year = 2012 THEN area END) AS first, max(CASE WHEN year = 2018 THEN area END) AS last FROM ({_AREA}) AS a GROUP BY transect, sector) SELECT transect, sector, round(first, 3) AS first, round(last, 3) AS last, round((last - first) / first * 100, 5) + 0 AS percent FROM w")
def p8_change(v):
    return rounded(rounded(ts.change(_areas(v), ["transect", "sector"], 2012, 2018), "first", "last", digits=3), "percent", digits=5)


@query("p9_summary", f"SELECT sector, year, count(content) AS n, round(avg(content), 6) AS mean_value, round(stddev_samp(content), 6) AS sd_value, min(content) AS low, max(content) AS high, round(quantile_cont(content, 0.25), 6) AS q25, round(quantile_cont(content, 0.5), 6) AS q50, round(quantile_cont(content, 0.75), 6) AS q75 FROM (SELECT *, {_SECTOR} AS sector FROM ({_LINE}) AS l) AS s GROUP BY sector, year")
def p9(v):
    return rounded(ts.summary(ts.with_sector(_line(v), SECTORS), ["sector", "year"]), "mean_value", "sd_value", "q25", "q50", "q75")


@query("p10_bin_difference", f"WITH b AS ({_BINS}), p AS (SELECT transect, bin, max(CASE WHEN year = 2012 THEN median_value END) AS a, max(CASE WHEN year = 2018 THEN median_value END) AS b FROM b WHERE bin * 37 BETWEEN 5000 AND 15000 GROUP BY transect, bin) SELECT transect, count(b - a) AS n, round(avg(b - a), 6) + 0 AS mean_change, round(median(b - a), 6) + 0 AS median_change FROM p GROUP BY transect")
def p10(v):
    d = ts.bin_difference(_bins(v), 2012, 2018, 5000.0, 15000.0, 37.0)
    return rounded(d, "mean_change", "median_change")


@query("p11_variability", f"WITH a AS (SELECT transect, year, sum(content) * (max(distance) - min(distance)) / (count(*) - 1) AS area FROM ({_LINE}) AS l WHERE lon BETWEEN -52 AND -45 GROUP BY transect, year), w AS (SELECT transect, max(CASE WHEN year = 2012 THEN area END) AS first, max(CASE WHEN year = 2018 THEN area END) AS last FROM a GROUP BY transect) SELECT transect, round(first, 3) AS first, round(last, 3) AS last, round((last - first) / first * 100, 5) + 0 AS percent FROM w")
def p11(v):
    return rounded(rounded(ts.variability(_line(v), -52, -45, 2012, 2018), "first", "last", digits=3), "percent", digits=5)


_PROFILE = "SELECT track AS transect, trace * CAST(100 AS DOUBLE) AS distance, elevation FROM thickness"


@query("p12_level_distances", f"""WITH p AS ({_PROFILE}), e AS (SELECT transect, min(elevation) AS lo, max(elevation) AS hi FROM p GROUP BY transect), l AS (SELECT transect, unnest(range(CAST(ceil(lo / 50) AS BIGINT), CAST(floor(hi / 50) AS BIGINT) + 1)) * CAST(50 AS DOUBLE) AS level FROM e),
k AS (SELECT p.transect, level, distance, elevation, row_number() OVER (PARTITION BY p.transect, level ORDER BY abs(elevation - level), distance) AS k FROM p JOIN l ON l.transect = p.transect) SELECT transect, level, distance, elevation FROM k WHERE k = 1""")
def p12(v):
    p = v("thickness").select(F.col("track").alias("transect"), (F.col("trace") * 100.0).alias("distance"), "elevation")
    return ts.level_distances(p)


@query("p12_every_5_km", f"WITH p AS (SELECT *, floor(distance / 5000 + 0.5) * 5000 AS mark FROM ({_PROFILE}) AS q), k AS (SELECT *, row_number() OVER (PARTITION BY transect, mark ORDER BY abs(distance - mark), distance) AS k FROM p) SELECT transect, mark, elevation FROM k WHERE k = 1")
def p12_marks(v):
    p = v("thickness").select(F.col("track").alias("transect"), (F.col("trace") * 100.0).alias("distance"), "elevation")
    return ts.every_distance(p)


@query("p13_degree_hours", "SELECT year, count(temperature) AS n_hours, count(*) FILTER (WHERE temperature > 0) AS n_positive, round(coalesce(sum(CASE WHEN temperature > 0 THEN temperature END), 0), 4) + 0 AS degree_hours FROM station WHERE year <= 2017 GROUP BY year")
def p13(v):
    return rounded(ts.degree_hours(v("station"), 2017), "degree_hours", digits=4)


@query("p14_accretion", "SELECT track, trace, CASE WHEN lon BETWEEN -48.1 AND -46.5 THEN 1 ELSE 0 END AS accretion FROM thickness")
def p14(v):
    t = v("thickness")
    return t.select("track", "trace", ts.accretion(t, -48.1, -46.5).alias("accretion"))


def _rolled(c: str) -> str:
    """The median of three neighbouring bins where all three have a value."""
    three = f"lag({c}) OVER w", c, f"lead({c}) OVER w"
    return f"CASE WHEN {' AND '.join(f'{x} IS NOT NULL' for x in three)} THEN {' + '.join(three)} - greatest({', '.join(three)}) - least({', '.join(three)}) END AS roll_{c}"


_VALUES = ("mean_value", "median_value", "q25", "q75", "sd_value", "roll_median_value", "roll_q25", "roll_q75", "edge")
_PROFILES = f"""WITH p AS (SELECT transect, year, track, trace, least(content, 16) AS content, {POLAR} FROM ({_TR}) AS t), o AS (SELECT *, CASE WHEN year = 2011 THEN y ELSE x END AS k FROM p),
d AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM o WINDOW w AS (PARTITION BY transect, year ORDER BY k, track, trace)),
s AS (SELECT transect, min(x) AS sx FROM p GROUP BY transect), s2 AS (SELECT p.transect, sx, min(y) AS sy FROM p JOIN s ON s.transect = p.transect AND p.x = s.sx GROUP BY p.transect, sx),
l AS (SELECT d.transect, year, content, sum(coalesce(d, 0)) OVER (PARTITION BY d.transect, year ORDER BY k, track, trace) + sqrt(pow(fx - sx, 2) + pow(fy - sy, 2)) AS distance FROM d JOIN s2 ON s2.transect = d.transect),
{_FULL.replace(f"({_LINE})", "l").replace("distance / 37", "distance / 300000").replace("FROM l AS l", "FROM l")},
r AS (SELECT *, {', '.join(map(_rolled, ('median_value', 'q25', 'q75')))} FROM f WINDOW w AS (PARTITION BY transect, year ORDER BY bin)),
x AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY transect, year) AS many, lag(roll_median_value) OVER w AS b, lead(roll_median_value) OVER w AS a FROM r WINDOW w AS (PARTITION BY transect, year ORDER BY bin)),
z AS (SELECT *, CASE WHEN roll_median_value IS NULL THEN median_value WHEN (k > 1 AND b IS NULL) OR (k < many AND a IS NULL) THEN roll_median_value END AS edge FROM x)"""


@query("flow_transect_profiles", f"{_PROFILES} SELECT transect, year, bin, n, {', '.join(f'round({c}, 6) + 0 AS {c}' for c in _VALUES)} FROM z")
def flow_transects(v):
    """Repeat transects to binned and smoothed thickness, by year."""
    k = F.col("s_suppkey")
    listed = v.table("supplier").select(F.concat(F.lit("T"), (k % 4).cast("string")).alias("transect"), k.cast("string").alias("track"), (-58 + k % 4).cast("double").alias("lon0"), F.lit(-40.0).alias("lon1"), F.lit(None).cast("double").alias("lat0"), F.when(k % 4 != 1, 75.0).alias("lat1"))
    return rounded(jobs.transect_profiles(v("thickness"), listed, 300_000.0), *_VALUES).select("transect", "year", "bin", "n", *_VALUES)


@query("flow_traces_to_thickness")
def flow_traces(v):
    """The main product on stand-in traces: corrections, 15 cutoffs, likelihood, thickness."""
    return jobs.traces_to_thickness(v("traces"), v("exclusions"), v("coordinates"))


@query("flow_radar_to_thickness")
def flow_radar(v):
    """The whole chain from raw traces: surface, cut, masks, roll, depth, rescaling, ice, thickness."""
    t = v("traces")
    k = F.col("track").cast("double")
    # positions of the traces themselves, as every trace of a flight has one; some tracks lack roll
    roll = F.when(k % 4 != 1, F.radians((F.col("trace") % 13).cast("double")))
    positions = t.select("track", "trace", (-50 + F.col("trace") / 2000).alias("lon"), (68 + k / 10 + F.sin(F.col("trace") / 50) / 100).alias("lat"), roll.alias("roll"))
    starts = t.select("track").distinct().withColumn("start", F.lit(4))
    return jobs.radar_to_thickness(t, starts, v("exclusions"), positions, t.where("track in ('1', '4')").select("track").distinct(), radius=8, search=12, logarithm=False)
