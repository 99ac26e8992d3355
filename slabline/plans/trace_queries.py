"""Queries of traces, corrections, identification and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correct, identify, validate
from ..operators import traces as tr
from .registry import Inputs, longs, query, r, rounded

STEP = 0.5  # metres between the stand-in's samples
_CELLS = "SELECT track, trace, CAST(unnest(range(64)) AS BIGINT) AS depth_idx, unnest(samples) AS value FROM traces"


def _cells(v: Inputs):
    return longs(tr.cells(v("traces")), "depth_idx")


def _axis(v: Inputs, times: int = 64):
    """One time axis per track: shifted by track, so that all cases of the reset occur."""
    t = v("traces").select("track").distinct()
    return t.select("track", (2010 + F.col("track").cast("int")).alias("year"), F.transform(F.sequence(F.lit(0), F.lit(times - 1)), lambda i: (i - F.col("track").cast("int") * 4 + 9) * F.lit(2e-9)).alias("times"))


@query("s7_cells", _CELLS)
def s7(v):
    return _cells(v)


@query("d1_speeds", """SELECT p_partkey, round(299792458 / (1.000293 + (1.3078 - 1.000293) * CAST(p_size * 18 AS DOUBLE) / 917), 2) AS standard, round(299792458 / (1 + 0.851 * CAST(p_size * 18 AS DOUBLE) / 1000), 2) AS robin,
 round(299792458 / (1 + 0.7 * CAST(p_size * 18 AS DOUBLE) / 1000), 2) AS adjusted, round(299792458 / (1 + 0.734 * CAST(p_size * 18 AS DOUBLE) / 1000), 2) AS modified FROM part""")
def d1(v):
    d = (F.col("p_size") * 18).cast("double")
    return v.table("part").select("p_partkey", *[r(tr.speed(d, k), 2).alias(k) for k in ("standard", "robin", "adjusted", "modified")])


@query("d2_depth_axis", """WITH t AS (SELECT DISTINCT track, CAST(track AS INT) AS k FROM traces), i AS (SELECT track, k, unnest(range(64)) AS i FROM t),
d AS (SELECT track, k, i, (i - k * 4 + 9) * 2e-9 * (299792458 / (1 + 0.734 * 0.873 / 1000)) / 2 AS d FROM i), e AS (SELECT *, max(CASE WHEN i = 10 THEN d END) OVER (PARTITION BY track) AS d10, max(CASE WHEN i = 0 THEN d END) OVER (PARTITION BY track) AS d0 FROM d)
SELECT track, i AS depth_idx, round(CASE WHEN d10 < 0 OR (d10 > 1 AND 2010 + k IN (2011, 2012, 2014, 2017, 2018)) THEN d - d0 ELSE d END, 6) + 0 AS depth FROM e""")
def d2(v):
    a = tr.depth_axis(_axis(v))
    return longs(a.select("track", F.posexplode("depths").alias("depth_idx", "d")), "depth_idx").select("track", "depth_idx", r("d").alias("depth"))


@query("d3_even_times", "SELECT p_partkey, i - 1 AS depth_idx, round(i * CAST(0.02 AS DOUBLE), 6) AS time FROM (SELECT p_partkey, unnest(range(1, p_size + 1)) AS i FROM part) AS n")
def d3(v):
    t = v.table("part").select("p_partkey", F.posexplode(tr.even_times(F.col("p_size"), 0.02)).alias("depth_idx", "t"))
    return longs(t, "depth_idx").select("p_partkey", "depth_idx", r("t").alias("time"))


@query("d4_metres_to_samples", "SELECT p_partkey, CAST(round_even(5 / (CAST(p_size AS DOUBLE) / 8), 0) AS BIGINT) AS above, CAST(round_even(10 / (CAST(p_size AS DOUBLE) / 8), 0) AS BIGINT) + 1 AS below FROM part")
def d4(v):
    a, b = tr.metres_to_samples(5.0, 10.0, F.col("p_size") / F.lit(8.0))
    return v.table("part").select("p_partkey", a.cast("long").alias("above"), b.cast("long").alias("below"))


@query("d5_shallow", f"SELECT track, trace, depth_idx, value FROM ({_CELLS}) AS c WHERE depth_idx < 41")
def d5(v):
    return longs(tr.cells(tr.shallow(v("traces"), 41)), "depth_idx")


@query("d6_axis_clashes", "SELECT track, count(DISTINCT length(track) + trace % 3) AS n_axes FROM thickness GROUP BY track")
def d6(v):
    files = v("thickness").select("track", F.array((F.length("track") + F.col("trace") % 3).cast("double"), F.lit(1.0)).alias("times"))
    return tr.axis_clashes(files)


@query("d7_log10", f"SELECT track, trace, depth_idx, round(CASE WHEN value > 0 THEN log10(value) END, 6) + 0 AS value FROM ({_CELLS}) AS c")
def d7(v):
    t = v("traces").withColumn("samples", tr.log10_samples())
    return rounded(longs(tr.cells(t), "depth_idx"), "value")


@query("d8_surface_sample", """WITH p AS (SELECT track, trace, abs(samples[1]) * 4e-7 AS pick, CAST(track AS INT) AS k FROM traces), o AS (SELECT track, trace, unnest(range(64)) AS i, pick, k FROM p),
m AS (SELECT *, row_number() OVER (PARTITION BY track, trace ORDER BY abs((i - k * 4 + 9) * 2e-9 - pick), i) AS n FROM o) SELECT track, trace, i AS surface FROM m WHERE n = 1""")
def d8(v):
    t = v("traces").select("track", "trace", (F.abs(F.get("samples", F.lit(0))) * 4e-7).alias("pick"))
    return longs(tr.surface_sample(t, _axis(v)), "surface").select("track", "trace", "surface")


@query("d9_first_after", """WITH p AS (SELECT track, trace, abs(samples[1]) * 4e-7 AS pick, CAST(track AS INT) AS k FROM traces), o AS (SELECT track, trace, unnest(range(64)) AS i, pick, k FROM p)
SELECT track, trace, min(CASE WHEN (i - k * 4 + 9) * 2e-9 > pick THEN i END) AS first FROM o GROUP BY track, trace""")
def d9(v):
    t = v("traces").select("track", "trace", (F.abs(F.get("samples", F.lit(0))) * 4e-7).alias("pick")).join(_axis(v), "track")
    return t.select("track", "trace", tr.first_after("times", "pick").cast("long").alias("first"))


@query("d10_start_pixel", """WITH t AS (SELECT track, min(trace) + 7 AS pick FROM thickness GROUP BY track), s AS (SELECT CAST(p_partkey AS STRING) AS track, p_size AS pixel FROM part WHERE p_size % 3 > 0)
SELECT t.track, CAST(coalesce(s.pixel, t.pick) AS BIGINT) AS start FROM t LEFT JOIN s ON s.track = t.track""")
def d10(v):
    t = v("thickness").groupBy("track").agg((F.min("trace") + 7).alias("pick"))
    s = v.table("part").where("p_size % 3 > 0").select(F.col("p_partkey").cast("string").alias("track"), F.col("p_size").alias("pixel"))
    return longs(tr.start_pixel(t, s), "start")


@query("d10_manual_surface", "SELECT track, trace, CASE WHEN trace < 40 AND track LIKE '%3' THEN trace + 100 ELSE trace % 17 END AS surface FROM thickness")
def d10_manual(v):
    s = v("thickness").select("track", "trace", (F.col("trace") % 17).alias("surface"))
    m = v("thickness").where("trace < 40 and track like '%3'").select("track", "trace", (F.col("trace") + 100).alias("pixel"))
    return tr.overridden(s, m)


@query("d11_d12_surface")
def d11(v):
    starts = v("traces").select("track").distinct().withColumn("start", F.lit(20))
    return tr.followed_surface(v("traces"), starts, radius=8, search=12)


@query("d13_cut_at_surface", """WITH s AS (SELECT track, trace, samples, CAST(abs(samples[2]) * 200 AS BIGINT) % 64 AS surface FROM traces)
SELECT track, trace, CAST(i AS BIGINT) AS depth_idx, round(samples[greatest(0, least(surface - 5, 49)) + 1 + i], 9) AS value FROM s, (SELECT unnest(range(15)) AS i) AS n""")
def d13(v):
    s = v("traces").withColumn("surface", F.round(F.abs(F.get("samples", F.lit(1))) * 200).cast("long") % 64)
    return rounded(longs(tr.cells(tr.cut_at_surface(s, 5, 10)), "depth_idx"), "value", digits=9)


@query("d14_mean_by_depth", f"SELECT track, depth_idx, round(avg(value), 6) + 0 AS mean_value FROM ({_CELLS}) AS c WHERE trace BETWEEN 2 AND 30 GROUP BY track, depth_idx")
def d14(v):
    return rounded(longs(tr.mean_by_depth(v("traces"), 2, 30), "depth_idx"), "mean_value")


#: Roll of the stand-in traces, in radians as in the files.
_ROLLED = "radians(CAST(trace % 13 AS DOUBLE) + 0.25D)"
_DEGREES = "degrees(radians(CAST(trace % 13 AS DOUBLE) + 0.25))"


def _roll_cells(v: Inputs):
    """Every trace's first samples with a roll: what roll_fit takes."""
    t = v("traces").withColumn("roll", F.expr(_ROLLED))
    return t.select("track", "trace", "roll", F.posexplode("samples").alias("depth_idx", "value"))


_ROLL = f"SELECT track, depth_idx, {_DEGREES} * {_DEGREES} AS x, value AS z FROM ({_CELLS}) AS c"


_FIT = f"""s AS (SELECT track, depth_idx, CAST(count(*) AS DOUBLE) AS n, sum(x) AS x1, sum(x*x) AS x2, sum(z) AS z1, sum(z*x) AS zx FROM ({_ROLL}) AS q GROUP BY track, depth_idx),
f AS (SELECT *, (n*zx - x1*z1) / (n*x2 - x1*x1) AS fa, (x2*z1 - x1*zx) / (n*x2 - x1*x1) AS fc, least(0, z1/n) AS ec, least(0, zx/x2) AS ea FROM s),
g AS (SELECT *, fa <= 0 AND fc <= 0 AS ok, n*ec*ec - 2*ec*z1 <= x2*ea*ea - 2*ea*zx AS first FROM f), h AS (SELECT track, depth_idx, CASE WHEN ok THEN fa WHEN first THEN 0 ELSE ea END AS a, CASE WHEN ok THEN fc WHEN first THEN ec ELSE 0 END AS c FROM g)"""


@query("r1_roll_fit", f"WITH {_FIT} SELECT track, depth_idx, round(a, 8) + 0 AS a, round(c, 6) + 0 AS c FROM h")
def r1(v):
    f = correct.roll_fit(_roll_cells(v), radians=True)
    return longs(f, "depth_idx").select("track", "depth_idx", r("a", 8).alias("a"), r("c").alias("c"))


def _fits(v: Inputs):
    fit = correct.roll_fit(_roll_cells(v), radians=True)
    arrays = F.sort_array(F.collect_list(F.struct("depth_idx", "a", "c")))  # as many as a trace has samples
    return fit.groupBy("track").agg(arrays.alias("s")).select("track", F.col("s.a").alias("a"), F.col("s.c").alias("c"))


@query("r2_roll_decay")
def r2(v):
    depths = v("traces").select("track", F.posexplode("samples").alias("depth_idx", "_")).select("track", "depth_idx", (F.col("depth_idx") * STEP).alias("depth")).distinct()
    return correct.roll_decay(correct.roll_fit(_roll_cells(v), radians=True), depths)


_CURVED = "SELECT track, trace, CASE WHEN CAST(track AS BIGINT) % 10 = 4 THEN NULL ELSE roll END AS roll, CASE WHEN trace = 0 OR trace = max(trace) OVER (PARTITION BY track) THEN NULL ELSE lat / 10 END AS curvature FROM coordinates"


def _curved(v: Inputs):
    from pyspark.sql import Window

    last = F.max("trace").over(Window.partitionBy("track"))
    c = v("coordinates").withColumn("_last", last)
    return c.select("track", "trace", F.when(F.col("track").cast("long") % 10 != 4, F.col("roll")).alias("roll"), F.when((F.col("trace") > 0) & (F.col("trace") < F.col("_last")), F.col("lat") / 10).alias("curvature"))


@query("r3_filled_roll", f"""WITH c AS ({_CURVED}), q AS (SELECT track, trace, CASE WHEN count(roll) OVER (PARTITION BY track) = 0 THEN curvature ELSE abs(roll) END AS q FROM c),
n AS (SELECT *, lag(q) OVER w AS b, lead(q) OVER w AS a, lag(trace) OVER w AS tb, lead(trace) OVER w AS ta FROM q WINDOW w AS (PARTITION BY track ORDER BY trace))
SELECT track, trace, round(degrees(coalesce(q, CASE WHEN tb IS NULL THEN a WHEN ta IS NULL THEN b END, (b + a) / 2)), 6) + 0 AS roll_filled FROM n""")
def r3(v):
    return rounded(correct.filled_roll(_curved(v)).select("track", "trace", "roll_filled"), "roll_filled")


@query("r4_roll_corrected", f"WITH {_FIT} SELECT q.track, q.trace, q.depth_idx, round(q.value * c / nullif(a * pow({_DEGREES}, 2) + c, 0), 6) + 0 AS value FROM ({_CELLS}) AS q JOIN h ON h.track = q.track AND h.depth_idx = q.depth_idx")
def r4(v):
    t = v("traces").withColumn("roll_filled", F.degrees(F.expr(_ROLLED)))
    return rounded(longs(tr.cells(correct.roll_corrected(t, _fits(v))), "depth_idx"), "value")


@query("r2_r4_smoothed_roll")
def r4_smoothed(v):
    """The correction by the smoothed A and C, as the product has it."""
    t = v("traces").withColumn("roll_filled", F.degrees(F.expr(_ROLLED)))
    depths = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i * F.lit(STEP))
    return longs(tr.cells(correct.roll_corrected(t, correct.roll_curves(r2(v), depths))), "depth_idx")


@query("r5_roll_summary", f"""WITH {_FIT}, m AS (SELECT track, avg(a) AS a, avg(c) AS c FROM h WHERE depth_idx < 40 GROUP BY track), k AS (SELECT t.track, {_DEGREES} AS roll, a, c FROM traces AS t JOIN m ON m.track = t.track)
SELECT track, round(max(roll), 6) AS max_roll, round(min(a), 6) + 0 AS mean_a, round(min(c), 6) + 0 AS mean_c, round(avg(CASE WHEN roll <= 5 THEN c / (a * roll * roll + c) END), 6) AS mean_below_5, round(avg(CASE WHEN roll > 5 THEN c / (a * roll * roll + c) END), 6) AS mean_above_5 FROM k GROUP BY track""")
def r5(v):
    t = v("traces").withColumn("roll_filled", F.degrees(F.expr(_ROLLED)))
    return rounded(correct.roll_summary(t, _fits(v), 40), "max_roll", "mean_a", "mean_c", "mean_below_5", "mean_above_5")


def _roll_curvature(v: Inputs):
    c = v("coordinates").select((F.col("roll") * 0.01).alias("roll"), (F.col("lat") / 1000).alias("curvature_per_m"))
    return correct.roll_curvature(c)


@query("r6_roll_curvature", """WITH c AS (SELECT degrees(abs(roll * 0.01)) AS x, degrees(lat / 1000) AS y FROM coordinates WHERE roll IS NOT NULL), k AS (SELECT unnest(range(0, CAST(ceil(m / 0.5) AS BIGINT))) * CAST(0.5 AS DOUBLE) AS cutoff FROM (SELECT max(x) AS m FROM c) AS m),
s AS (SELECT CAST(NULL AS DOUBLE) AS cutoff, 'all' AS side, x, y FROM c UNION ALL SELECT cutoff, CASE WHEN x < cutoff THEN 'below' ELSE 'above' END, x, y FROM c, k)
SELECT cutoff, side, round(CASE WHEN count(*) > 1 THEN regr_slope(y, x) END, 6) + 0 AS slope, round(CASE WHEN count(*) > 1 THEN regr_intercept(y, x) END, 5) + 0 AS intercept, round(CASE WHEN count(*) > 1 THEN corr(y, x) END, 6) + 0 AS r, count(*) AS n FROM s GROUP BY cutoff, side""")
def r6(v):
    return rounded(rounded(_roll_curvature(v), "slope", "r"), "intercept", digits=5).drop("p")


@query("r6_roll_p_values")
def r6_p(v):
    """The p-values of the same regressions, which SQL lacks the distribution for."""
    return _roll_curvature(v).select("cutoff", "side", "n", "p")


@query("r7_minus_surface", f"WITH m AS (SELECT track, avg(samples[1]) AS m FROM traces GROUP BY track) SELECT c.track, trace, depth_idx, round(value - m, 6) + 0 AS value FROM ({_CELLS}) AS c JOIN m ON m.track = c.track")
def r7(v):
    return rounded(longs(tr.cells(correct.minus_surface(v("traces"))), "depth_idx"), "value")


@query("r8_depth_sums", f"SELECT track, depth_idx, count(*) AS n, round(sum(value), 6) + 0 AS s FROM ({_CELLS}) AS c GROUP BY track, depth_idx")
def r8_sums(v):
    return rounded(longs(correct.depth_sums(v("traces")), "depth_idx"), "s")


def _depth_fit(v: Inputs):
    sums = correct.depth_sums(v("traces"))
    return correct.depth_fit(sums, sums.select("track", "depth_idx", (F.col("depth_idx") * STEP).alias("depth")))


@query("r8_depth_fit")
def r8(v):
    return _depth_fit(v)


# The fit is given, so that SQL can follow; r8_depth_fit has the fit itself.
@query("r9_depth_corrected", f"""SELECT track, trace, depth_idx, round(((value - c) / a * exp(-b * d) - 1) * exp(b * d), 6) + 0 AS value FROM (SELECT *, depth_idx * CAST(0.5 AS DOUBLE) AS d, -1 - CAST(track AS DOUBLE) / 4 AS a, -CAST(track AS DOUBLE) / 50 AS b, -CAST(track AS DOUBLE) / 10 AS c FROM ({_CELLS}) AS q) AS p""")
def r9(v):
    k = F.col("track").cast("double")
    fit = v("traces").select("track").distinct().select("track", (-1 - k / 4).alias("a"), (-k / 50).alias("b"), (-k / 10).alias("c"))
    depths = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i * F.lit(STEP))
    return rounded(longs(tr.cells(correct.depth_corrected(v("traces"), fit, depths)), "depth_idx"), "value")


@query("r10_by_deviation", f"WITH d AS (SELECT track, stddev_pop(value) AS d FROM ({_CELLS}) AS c GROUP BY track) SELECT c.track, trace, depth_idx, round(value / d, 6) + 0 AS value FROM ({_CELLS}) AS c JOIN d ON d.track = c.track")
def r10(v):
    return rounded(longs(tr.cells(correct.by_deviation(v("traces"))), "depth_idx"), "value")


@query("r11_rescaled", f"""WITH c AS ({_CELLS}), p AS (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM c WHERE track NOT IN ('1', '4')), m AS (SELECT *, min(value) OVER (PARTITION BY track, trace) AS a, max(value) OVER (PARTITION BY track, trace) AS b FROM c WHERE track IN ('1', '4'))
SELECT track, trace, depth_idx, round(lo + (value - a) / (b - a) * (hi - lo), 6) + 0 AS value FROM m, p""")
def r11(v):
    flagged = v("traces").where("track in ('1', '4')").select("track").distinct()
    return rounded(longs(tr.cells(correct.rescaled(v("traces"), flagged)), "depth_idx"), "value")


@query("r12_midpoint_percentiles", f"""WITH c AS ({_CELLS}), n AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY track) - 1 AS m FROM c), q AS (SELECT unnest([0.025, 0.5, 0.975]::DOUBLE[]) AS quantile)
SELECT track, quantile, round(avg(value), 7) + 0 AS value FROM n, q WHERE k = floor(m * quantile + 1e-9) OR k = ceil(m * quantile - 1e-9) GROUP BY track, quantile""")
def r12(v):
    return rounded(correct.midpoint_percentiles(_cells(v), "track", "value", [0.025, 0.5, 0.975]), "value", digits=7)


@query("r13_bytes", f"SELECT track, trace, depth_idx, CAST(greatest(0, least(255, round_even((value + 0.3) / 0.6 * 255, 0))) AS INT) AS byte FROM ({_CELLS}) AS c")
def r13(v):
    return _cells(v).select("track", "trace", "depth_idx", correct.to_bytes(F.col("value"), F.lit(-0.3), F.lit(0.3)).alias("byte"))


CUTS = {0.65: -0.05, 0.7: -0.02, 0.75: 0.0, 0.79: 0.03}


def _cutoffs(v: Inputs):
    return v.spark.createDataFrame(list(CUTS.items()), "quantile double, cutoff double")


_CUTS = "SELECT unnest([0.65, 0.7, 0.75, 0.79]::DOUBLE[]) AS quantile, unnest([-0.05, -0.02, 0, 0.03]::DOUBLE[]) AS cutoff"


@query("i1_below_cutoffs", f"WITH k AS ({_CUTS}), c AS ({_CELLS}) SELECT track, trace, quantile, CAST(count(CASE WHEN depth_idx >= 2 AND value <= cutoff THEN 1 END) AS BIGINT) AS n_ice FROM c, k GROUP BY track, trace, quantile")
def i1(v):
    b = identify.below_cutoffs(v("traces"), _cutoffs(v))
    return b.select("track", "trace", "quantile", F.size(F.filter("ice", lambda x: x)).cast("long").alias("n_ice"))


def _shrunk(of: str) -> str:
    return f"SELECT track, quantile, trace, depth_idx, m AND coalesce(lag(m) OVER a, true) AND coalesce(lead(m) OVER a, true) AND coalesce(lag(m) OVER d, true) AND coalesce(lead(m) OVER d, true) AS m FROM ({of}) AS s WINDOW a AS (PARTITION BY track, quantile, depth_idx ORDER BY trace), d AS (PARTITION BY track, quantile, trace ORDER BY depth_idx)"


def _grown(of: str) -> str:
    return f"SELECT track, quantile, trace, depth_idx, m OR coalesce(lag(m) OVER a, false) OR coalesce(lead(m) OVER a, false) OR coalesce(lag(m) OVER d, false) OR coalesce(lead(m) OVER d, false) AS m FROM ({of}) AS s WINDOW a AS (PARTITION BY track, quantile, depth_idx ORDER BY trace), d AS (PARTITION BY track, quantile, trace ORDER BY depth_idx)"


_ICE = f"SELECT track, quantile, trace, depth_idx, depth_idx >= 2 AND value <= cutoff AS m FROM ({_CELLS}) AS c, ({_CUTS}) AS k"


@query("i2_cleaned", f"SELECT track, quantile, trace, depth_idx FROM ({_shrunk(_grown(_grown(_shrunk(_ICE))))}) AS s WHERE m")
def i2(v):
    images = identify.below_cutoffs(identify.dense(v("traces")), _cutoffs(v)).withColumn("col", F.col("trace"))
    return longs(identify.cleaned_cells(images, "SG1"), "depth_idx").select("track", "quantile", F.col("col").alias("trace"), "depth_idx")


def _labelled(cells: str) -> str:
    """SQL of (track, quantile, id, label): every cell's least reachable cell number. Only cells without a
    smaller neighbour are followed, as the least one of a component is among them."""
    return f"""c AS (SELECT track, quantile, trace * 64 + depth_idx AS id FROM ({cells}) AS m),
n AS (SELECT a.track, a.quantile, a.id AS a, b.id AS b FROM (SELECT *, unnest([id - 64, id + 64, CASE WHEN id % 64 > 0 THEN id - 1 END, CASE WHEN id % 64 < 63 THEN id + 1 END]) AS other FROM c) AS a JOIN c AS b ON b.track = a.track AND b.quantile = a.quantile AND b.id = a.other),
r AS (SELECT track, quantile, id AS root, id FROM c WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.track = c.track AND n.quantile = c.quantile AND n.a = c.id AND n.b < c.id)
UNION SELECT r.track, r.quantile, r.root, n.b FROM r JOIN n ON n.track = r.track AND n.quantile = r.quantile AND n.a = r.id),
l AS (SELECT track, quantile, id, min(root) AS label FROM r GROUP BY track, quantile, id), z AS (SELECT track, quantile, label, count(*) AS size FROM l GROUP BY track, quantile, label)"""


_CLEAN = f"SELECT * FROM ({_shrunk(_grown(_grown(_shrunk(_ICE))))}) AS s WHERE m"


@query("i2_i3_components", f"WITH RECURSIVE {_labelled(_CLEAN)} SELECT track, quantile, label, size FROM z")
def i3(v):
    images = identify.below_cutoffs(identify.dense(v("traces")), _cutoffs(v)).withColumn("col", F.col("trace"))
    return identify.components(images, "SG1")


@query("i3_labels", f"WITH RECURSIVE {_labelled(f'SELECT track, 0.5 AS quantile, trace, depth_idx FROM ({_CELLS}) AS c WHERE depth_idx >= 2 AND value <= 0')} SELECT track, size, count(*) AS n FROM z GROUP BY track, size")
def i3_labels(v):
    one = v.spark.createDataFrame([(0.5, 0.0)], "quantile double, cutoff double")
    images = identify.below_cutoffs(v("traces"), one).withColumn("col", F.col("trace"))
    return identify.components(images, "orig").groupBy("track", "size").agg(F.count("*").alias("n"))


@query("i4_i5_likelihood", f"""WITH RECURSIVE {_labelled(_CLEAN)}, k AS (SELECT l.track, id, count(*) AS n FROM l JOIN z ON z.track = l.track AND z.quantile = l.quantile AND z.label = l.label WHERE size >= 20 GROUP BY l.track, id)
SELECT t.track, t.trace, t.depth_idx, coalesce(n, 0) / CAST(4 AS DOUBLE) AS likelihood FROM ({_CELLS}) AS t LEFT JOIN k ON k.track = t.track AND k.id = t.trace * 64 + t.depth_idx""")
def i5(v):
    counts = identify.ice_counts(v("traces"), list(CUTS.values()), least=20)
    return longs(identify.likelihood(counts, len(CUTS)).select("track", "trace", F.posexplode("likelihood").alias("depth_idx", "likelihood")), "depth_idx")


_LIKE = f"SELECT track, trace, depth_idx, count(CASE WHEN depth_idx >= 2 AND value <= cutoff THEN 1 END) / CAST(4 AS DOUBLE) AS likelihood FROM ({_CELLS}) AS c, ({_CUTS}) AS k GROUP BY track, trace, depth_idx"


@query("i5_likelihood_of_images", _LIKE)
def i5_images(v):
    return longs(identify.likelihood_of_images(identify.below_cutoffs(v("traces"), _cutoffs(v)), len(CUTS)), "depth_idx")


def _like(v: Inputs):
    """Likelihood arrays without the cleaning, so that SQL can follow."""
    l = identify.likelihood_of_images(identify.below_cutoffs(v("traces"), _cutoffs(v)), len(CUTS))
    a = F.transform(F.sort_array(F.collect_list(F.struct("depth_idx", "likelihood"))), lambda s: s["likelihood"])
    return l.groupBy("track", "trace").agg(a.alias("likelihood"))


@query("i6_i7_content", f"SELECT track, trace, count(CASE WHEN likelihood >= 0.0665 THEN 1 END) * CAST(0.5 AS DOUBLE) AS high_end, count(CASE WHEN likelihood >= 1 THEN 1 END) * CAST(0.5 AS DOUBLE) AS low_end, round(avg(CASE WHEN likelihood >= 0.0665 THEN likelihood END), 6) + 0 AS mean_likelihood FROM ({_LIKE}) AS l GROUP BY track, trace")
def i6(v):
    l = F.col("likelihood")
    return _like(v).select("track", "trace", identify.ice_content(l, STEP).alias("high_end"), identify.ice_content(l, STEP, identify.LOW_END).alias("low_end"), r(identify.mean_likelihood(l)).alias("mean_likelihood"))


@query("i8_thickness_table", "SELECT t.track, t.trace, t.content, c.lat, c.lon FROM thickness AS t JOIN coordinates AS c ON c.track = t.track AND c.trace = t.trace WHERE t.content BETWEEN 1 AND 16")
def i8(v):
    return identify.thickness(v("thickness").select("track", "trace", "content"), v("coordinates").select("track", "trace", "lat", "lon"))


@query("i9_product", f"SELECT l.track, l.trace, p.lon, p.lat, depth_idx, likelihood FROM ({_LIKE}) AS l JOIN coordinates AS p ON p.track = l.track AND p.trace = l.trace WHERE depth_idx * 0.5 < 20")
def i9(v):
    depths = v("traces").select("track").distinct().withColumn("depths", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i * F.lit(STEP)))
    p = identify.product(_like(v), v("coordinates"), depths)
    return longs(p.select("track", "trace", "lon", "lat", F.posexplode("likelihood").alias("depth_idx", "likelihood")), "depth_idx")


@query("i10_ice_bounds", f"SELECT track, trace, CAST(min(CASE WHEN likelihood > 0 THEN depth_idx END) AS DOUBLE) * 0.5 AS top, CAST(max(CASE WHEN likelihood > 0 THEN depth_idx END) AS DOUBLE) * 0.5 AS bottom FROM ({_LIKE}) AS l GROUP BY track, trace")
def i10(v):
    return identify.ice_bounds(_like(v), STEP).select("track", "trace", "top", "bottom")


@query("i10_bounds_summary", "SELECT track, round(avg(content), 6) + 0 AS mean_top, round(stddev_pop(content), 6) + 0 AS sd_top, round(avg(likelihood), 6) + 0 AS mean_bottom, round(stddev_pop(likelihood), 6) + 0 AS sd_bottom FROM thickness WHERE lon BETWEEN -48 AND -46 GROUP BY track")
def i10_summary(v):
    t = v("thickness").select("track", "lon", F.col("content").alias("top"), F.col("likelihood").alias("bottom"))
    return rounded(identify.bounds_summary(t, -48, -46), "mean_top", "sd_top", "mean_bottom", "sd_bottom")


@query("i11_range_thickness", "SELECT track, round(avg(content), 6) + 0 AS mean_thickness, round(median(content), 6) + 0 AS median_thickness FROM thickness WHERE lon BETWEEN -48 AND -47 GROUP BY track")
def i11(v):
    return rounded(identify.range_thickness(v("thickness"), -48, -47), "mean_thickness", "median_thickness")


@query("i12_smoothed", "SELECT track, CAST(floor(trace * CAST(100 AS DOUBLE) / 2500) AS BIGINT) AS bin, round(avg(content), 6) + 0 AS mean_value, round(stddev_pop(content), 6) + 0 AS sd_value, count(content) AS n, string_agg(CAST(CAST(round(lon * 1000) AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(round(lat * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY trace) AS line FROM thickness GROUP BY 1, 2")
def i12(v):
    s = identify.smoothed(v("thickness").withColumn("distance", F.col("trace") * 100.0))
    milli = lambda x: F.round(x * 1000).cast("long").cast("string")
    line = F.concat_ws(",", F.transform("line", lambda p: F.concat_ws(" ", milli(p["lon"]), milli(p["lat"]))))
    return rounded(s.withColumn("line", line), "mean_value", "sd_value")


_KIND = f"SELECT *, CASE WHEN depth_idx % 3 = 0 THEN 'ice' ELSE 'firn' END AS kind FROM ({_CELLS}) AS c"


def _split(v: Inputs):
    truth = _cells(v).select("track", "trace", "depth_idx", (F.col("depth_idx") % 3 == 0).alias("truth"))
    return validate.split_by_truth(_cells(v), truth, ["track", "trace", "depth_idx"])


@query("v1_split", f"SELECT kind, count(*) AS n, round(sum(value), 6) + 0 AS total FROM ({_KIND}) AS k GROUP BY kind")
def v1(v):
    return _split(v).groupBy("kind").agg(F.count("*").alias("n"), r(F.sum("value")).alias("total"))


_QS = ", ".join(f"0.{q}" for q in range(65, 80))


@query("v2_cutoffs", f"SELECT unnest([{_QS}]::DOUBLE[]) AS quantile, round(unnest(p), 7) + 0 AS cutoff FROM (SELECT quantile_cont(value, [{_QS}]) AS p FROM ({_KIND}) AS k WHERE kind = 'ice') AS q")
def v2(v):
    return rounded(validate.cutoffs(_split(v), [q / 100 for q in range(65, 80)]), "cutoff", digits=7)


@query("v3_histogram", f"""WITH b AS (SELECT kind, least(CAST(floor((value + 0.25) / 0.5 * 20) AS BIGINT), 19) AS bin, count(*) AS n FROM ({_KIND}) AS k WHERE value BETWEEN -0.25 AND 0.25 GROUP BY 1, 2)
SELECT kind, bin, n, round(n / (sum(n) OVER (PARTITION BY kind) * CAST(0.025 AS DOUBLE)), 6) AS density FROM b""")
def v3(v):
    return rounded(validate.histogram(_split(v), -0.25, 0.25, 20), "density")


@query("v4_confusion", """WITH t AS (SELECT quality = 1 AS truth, toxic = 1 AS predicted, doc_id % 4 AS quantile FROM labels), c AS (SELECT quantile, count(*) FILTER (WHERE predicted AND truth) AS tp, count(*) FILTER (WHERE predicted AND NOT truth) AS fp, count(*) FILTER (WHERE NOT predicted AND truth) AS fn, count(*) FILTER (WHERE NOT predicted AND NOT truth) AS tn FROM t GROUP BY quantile)
SELECT quantile, tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 AND fn + tn > 0 THEN (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) END, 6) AS overall, round(CASE WHEN tp + fp > 0 AND fn + tn > 0 AND tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) END, 6) AS producers, round(CASE WHEN tp + fp > 0 AND fn + tn > 0 THEN tp / CAST(tp + fp AS DOUBLE) END, 6) AS users FROM c""")
def v4(v):
    return rounded(validate.confusion(v("truth").withColumn("quantile", F.col("cell") % 4)), "overall", "producers", "users")


@query("v5_resampled", """WITH c AS (SELECT CAST(unnest(range(20)) AS BIGINT) AS j), e AS (SELECT j, CASE WHEN j = 0 THEN -0.5 ELSE (j - 1) END AS lo, CAST(j AS DOUBLE) AS hi FROM c), w AS (SELECT CAST(unnest(range(10)) AS BIGINT) AS i), f AS (SELECT value / 5 AS fx, CAST(user_id % 100 AS DOUBLE) / 10 AS fz, event_id % 3 = 0 AS truth FROM events)
SELECT i, j, round(avg(CASE WHEN truth THEN 1.0 ELSE 0 END), 6) AS fraction, count(*) AS n FROM f JOIN e ON fx >= lo AND fx < hi JOIN w ON fz >= i AND fz < i + 1 GROUP BY i, j""")
def v5(v):
    cols = v.spark.range(20).select(F.col("id").alias("j"), F.col("id").cast("double").alias("east"))
    rows = v.spark.range(10).select(F.col("id").alias("i"), F.col("id").cast("double").alias("depth"))
    fine = v.table("events").select((F.col("value") / 5).alias("fx"), ((F.col("user_id") % 100).cast("double") / 10).alias("fz"), (F.col("event_id") % 3 == 0).alias("truth"))
    return rounded(validate.resampled(fine, cols, rows), "fraction")


def _twice(step, of: str, n: int) -> str:
    return of if n == 0 else step(_twice(step, of, n - 1))


_VARIANTS = {"orig": _ICE, "S1": _shrunk(_ICE), "SG1": _shrunk(_grown(_grown(_shrunk(_ICE)))), "SG2": _twice(_shrunk, _twice(_grown, _twice(_shrunk, _ICE, 2), 4), 2)}
_OF_ALL = " UNION ALL ".join(f"SELECT track, '{name}/' || CAST(quantile AS STRING) AS quantile, trace, depth_idx FROM ({of}) AS s WHERE m" for name, of in _VARIANTS.items())


@query("v6_error_grid", f"""WITH RECURSIVE {_labelled(_OF_ALL)}, q AS ({_CELLS}), f AS (SELECT track, trace * 64 + depth_idx AS id FROM q WHERE value < -0.1),
y AS (SELECT l.track, l.quantile, label, count(*) AS size, count(f.id) AS hit FROM l LEFT JOIN f ON f.track = l.track AND f.id = l.id GROUP BY l.track, l.quantile, label),
g AS (SELECT algorithm, quantile, threshold FROM (SELECT unnest(['orig', 'S1', 'SG1', 'SG2']) AS algorithm) AS a, ({_CUTS}) AS k, (SELECT unnest([0, 10, 50, 350]) AS threshold) AS t),
s AS (SELECT algorithm, g.quantile, threshold, coalesce(sum(size - hit), 0) AS fp, coalesce(sum(hit), 0) AS tp FROM g LEFT JOIN y ON y.quantile = algorithm || '/' || CAST(g.quantile AS STRING) AND size >= threshold GROUP BY algorithm, g.quantile, threshold),
w AS (SELECT CAST(count(*) AS DOUBLE) AS cells, count(*) FILTER (WHERE value < -0.1) AS all_true FROM q) SELECT algorithm, quantile, threshold, round(fp / cells, 9) AS type_1, round((all_true - tp) / cells, 9) AS type_2 FROM s, w""")
def v6(v):
    images = identify.below_cutoffs(v("traces"), _cutoffs(v)).withColumn("col", F.col("trace"))
    truth = v("traces").select("track", F.col("trace").alias("col"), F.transform("samples", lambda x: x < -0.1).alias("reference"))
    return rounded(validate.error_grid(images, truth, ["orig", "S1", "SG1", "SG2"], [0, 10, 50, 350]), "type_1", "type_2", digits=9)


@query("v7_fractional_errors", "SELECT event_id % 5 AS quantile, round(coalesce(1 - avg(CASE WHEN user_id % 3 = 0 THEN value / 100 END), 0), 6) + 0 AS type_1, round(coalesce(avg(CASE WHEN user_id % 3 <> 0 THEN value / 100 END), 0), 6) + 0 AS type_2 FROM events GROUP BY 1")
def v7(v):
    cells = v.table("events").select((F.col("event_id") % 5).alias("quantile"), (F.col("user_id") % 3 == 0).alias("predicted"), (F.col("value") / 100).alias("fraction"))
    return rounded(validate.fractional_errors(cells), "type_1", "type_2")


@query("v8_best_settings", """WITH g AS (SELECT p_type AS algorithm, CAST(p_size AS DOUBLE) / 50 AS quantile, CAST(p_partkey % 46 AS INT) AS threshold, p_retailprice / 1000 AS type_1, CAST(p_size AS DOUBLE) / 60 AS type_2 FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY algorithm ORDER BY round(type_1 + type_2, 12), quantile, threshold) AS k FROM g), m AS (SELECT algorithm, min(type_1) AS min_type_1, max(type_1) AS max_type_1, min(type_2) AS min_type_2, max(type_2) AS max_type_2 FROM g GROUP BY algorithm)
SELECT k.algorithm, round(type_1 + type_2, 6) AS total, quantile, threshold, round(min_type_1, 6) AS min_type_1, round(max_type_1, 6) AS max_type_1, round(min_type_2, 6) AS min_type_2, round(max_type_2, 6) AS max_type_2 FROM k JOIN m ON m.algorithm = k.algorithm WHERE k.k = 1""")
def v8(v):
    g = v.table("part").select(F.col("p_type").alias("algorithm"), (F.col("p_size") / F.lit(50.0)).alias("quantile"), (F.col("p_partkey") % 46).cast("int").alias("threshold"), (F.col("p_retailprice") / 1000).alias("type_1"), (F.col("p_size") / F.lit(60.0)).alias("type_2"))
    return rounded(validate.best_settings(g), "total", "min_type_1", "max_type_1", "min_type_2", "max_type_2")

