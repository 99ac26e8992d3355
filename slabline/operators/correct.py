"""Corrections of the signal for aircraft roll, surface strength and depth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from . import pooled
from . import traces as tr


def roll_fit(cells: DataFrame, radians: bool = False) -> DataFrame:
    """Per (track, depth_idx): A and C of value = A roll^2 + C with A <= 0 and C <= 0, least squares.

    ``cells``: track, depth_idx, value, roll. The fit is in degrees; ``radians``: roll is in radians, as in the
    radar files. Five sums per group decide it: the free solution if it
    keeps the bounds, else the better of the two edges.
    """
    roll = F.degrees("roll") if radians else F.col("roll")
    x, z = roll * roll, F.col("value")
    sums = cells.where("roll is not null and value is not null").groupBy("track", "depth_idx").agg(
        F.count("*").cast("double").alias("n"), F.sum(x).alias("x1"), F.sum(x * x).alias("x2"), F.sum(z).alias("z1"), F.sum(z * x).alias("zx"), F.sum(z * z).alias("z2")
    )
    n, x1, x2, z1, zx = (F.col(c) for c in ("n", "x1", "x2", "z1", "zx"))
    det = n * x2 - x1 * x1
    free_a, free_c = F.try_divide(n * zx - x1 * z1, det), F.try_divide(x2 * z1 - x1 * zx, det)
    ok = (det > 1e-12 * n * x2) & (free_a <= 0) & (free_c <= 0)
    edge_c = F.least(F.lit(0.0), z1 / n)  # A = 0
    edge_a = F.least(F.lit(0.0), F.coalesce(F.try_divide(zx, x2), F.lit(0.0)))  # C = 0
    loss_c, loss_a = n * edge_c * edge_c - 2 * edge_c * z1, x2 * edge_a * edge_a - 2 * edge_a * zx
    first = loss_c <= loss_a
    a = F.when(ok, free_a).when(first, F.lit(0.0)).otherwise(edge_a)
    c = F.when(ok, free_c).when(first, edge_c).otherwise(F.lit(0.0))
    return sums.select("track", "depth_idx", a.alias("a"), c.alias("c"), F.col("n").cast("long").alias("n"))


def roll_decay(fit: DataFrame, depths: DataFrame) -> DataFrame:
    """Per track: A(depth) = R exp(S depth) and C(depth) = T exp(U depth) + V, with r and p of the
    fitted against the per-depth values. ``fit``: of roll_fit; ``depths``: track, depth_idx, depth.
    A few hundred rows per track go to the helper."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("depth_idx")
        d, one = pdf["depth"].to_numpy(float), np.ones(len(pdf))
        a, c = pdf["a"].to_numpy(float), pdf["c"].to_numpy(float)
        r_, s_, _ = kernels.fit_decay(d, one, a, a_bounds=(-np.inf, 0.0), c_bounds=(0.0, 0.0))
        t_, u_, v_ = kernels.fit_decay(d, one, c, a_bounds=(0.0, np.inf), c_bounds=(-np.inf, 0.0))
        row = {"track": pdf["track"].iloc[0], "a_r": r_, "a_s": s_, "c_t": t_, "c_u": u_, "c_v": v_}
        for k, seen, fitted in (("a", a, r_ * np.exp(s_ * d)), ("c", c, t_ * np.exp(u_ * d) + v_)):
            flat = len(d) < 3 or np.ptp(seen) == 0 or np.ptp(fitted) == 0
            r = float("nan") if flat else float(np.corrcoef(seen, fitted)[0, 1])
            row |= {f"{k}_rvalue": r, f"{k}_pvalue": kernels.regress_p(r, len(d))}
        return pd.DataFrame([row])

    return fit.join(depths, ["track", "depth_idx"]).groupBy("track").applyInPandas(run, "track string, a_r double, a_s double, c_t double, c_u double, c_v double, a_rvalue double, a_pvalue double, c_rvalue double, c_pvalue double")


def roll_curves(decay: DataFrame, depths: Column) -> DataFrame:
    """(track, a, c): the smoothed A and C of each depth as arrays, for roll_corrected. ``decay``: of
    roll_decay; ``depths``: the array of depths."""
    a = F.transform(depths, lambda d: F.col("a_r") * F.exp(F.col("a_s") * d))
    c = F.transform(depths, lambda d: F.col("c_t") * F.exp(F.col("c_u") * d) + F.col("c_v"))
    return decay.select("track", a.alias("a"), c.alias("c"))


def filled_roll(df: DataFrame, roll: str = "roll", curvature: str = "curvature", radians: bool = True) -> DataFrame:
    """roll_seen, the absolute roll in degrees, and roll_filled, the same without gaps: a track without any gets its curvature,
    its ends copied from their neighbours; inner gaps get the mean of the two neighbours. Both come in
    radians, unless said otherwise."""
    whole, w = Window.partitionBy("track"), Window.partitionBy("track").orderBy("trace")
    none = F.count(roll).over(whole) == 0
    rows = df.withColumn("_none", none).withColumn("_r", F.when(F.col("_none"), F.col(curvature)).otherwise(F.abs(roll)))
    before, after = F.lag("_r").over(w), F.lead("_r").over(w)
    ends = F.coalesce("_r", F.when(F.lag("trace").over(w).isNull(), after).when(F.lead("trace").over(w).isNull(), before), (before + after) / 2)
    scale = F.degrees if radians else lambda x: x
    return rows.withColumns({"roll_filled": scale(ends), "roll_seen": scale(F.col("_r"))}).drop("_r", "_none")


def roll_corrected(traces: DataFrame, fitted: DataFrame) -> DataFrame:
    """samples * C / (A roll^2 + C), roll in degrees. ``fitted``: track, a, c as arrays by depth, smoothed
    (roll_curves) or as fitted."""
    x = F.col("roll_filled") * F.col("roll_filled")
    scale = lambda a, c: F.try_divide(c, a * x + c)
    factors = F.zip_with("a", "c", scale)
    return traces.join(fitted, "track").withColumn("samples", F.zip_with("samples", factors, lambda z, k: z * k)).drop("a", "c")


def roll_summary(traces: DataFrame, fitted: DataFrame, shallow: int) -> DataFrame:
    """Per track: largest roll, mean A and C of the first ``shallow`` depths, and the mean correction
    at rolls up to and over 5 degrees (null without such)."""
    mean = lambda c: F.aggregate(F.slice(c, 1, shallow), F.lit(0.0), lambda s, v: s + v) / F.least(F.size(c), F.lit(shallow))
    tops = fitted.select("track", mean("a").alias("a20"), mean("c").alias("c20"))
    rows = traces.select("track", "roll_filled").join(tops, "track")
    k = F.try_divide("c20", F.col("a20") * F.pow("roll_filled", F.lit(2)) + F.col("c20"))
    return rows.groupBy("track").agg(
        F.max("roll_filled").alias("max_roll"), F.first("a20").alias("mean_a"), F.first("c20").alias("mean_c"), F.avg(F.when(F.col("roll_filled") <= 5, k)).alias("mean_below_5"), F.avg(F.when(F.col("roll_filled") > 5, k)).alias("mean_above_5")
    )


@F.pandas_udf(T.DoubleType())
def _p_values(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([kernels.regress_p(x, int(k)) for x, k in zip(r.astype(float), n, strict=True)])


def roll_curvature(df: DataFrame, step: float = 0.5) -> DataFrame:
    """Regression of curvature on absolute roll, both in degrees: overall (cutoff null), and below and
    from each cutoff 0, step, 2 step, ... under the largest roll.

    ``df``: roll and curvature_per_m in radians; rows with a null or NaN in either are left out. Returns
    cutoff, side, slope, intercept, r, p (two-sided, of Student's t with n - 2 degrees), n; sides without
    rows are absent, and what too few or equal rows don't define is null. ``step`` should be a power of
    two, so that bins end exactly at cutoffs.

    Rows are summed once per bin of one step; a side's sums are those of all bins below or from the cutoff.
    """
    x, y = F.degrees(F.abs(F.col("roll").cast("double"))), F.degrees(F.col("curvature_per_m").cast("double"))
    rows = df.select(x.alias("x"), y.alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    sums = {"n": F.lit(1.0), "sx": F.col("x"), "sy": F.col("y"), "xx": F.col("x") * F.col("x"), "xy": F.col("x") * F.col("y"), "yy": F.col("y") * F.col("y")}
    bins = rows.groupBy(F.floor(F.col("x") / step).alias("bin")).agg(F.max("x").alias("most"), *[F.sum(e).alias(k) for k, e in sums.items()])
    # from here on there is one row per step of roll, or per cutoff
    last = bins.agg(F.max("most").alias("most"))
    cutoffs = last.where("most > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("most") / step) - 1)).alias("k"))
    total = F.struct(*[F.sum(k).alias(k) for k in sums]).alias("s")
    sided = cutoffs.crossJoin(bins).groupBy((F.col("k") * step).alias("cutoff"), F.when(F.col("bin") < F.col("k"), "below").otherwise("above").alias("side")).agg(total)
    every = bins.agg(total).where("s.n > 0").select(F.lit(None).cast("double").alias("cutoff"), F.lit("all").alias("side"), "s")
    g = every.unionByName(sided).select("cutoff", "side", "s.*")
    vx, vy, cov = (F.col(a) - F.col(b) * F.col(c) / F.col("n") for a, b, c in (("xx", "sx", "sx"), ("yy", "sy", "sy"), ("xy", "sx", "sy")))
    some = F.col("n") > 1
    flat = lambda v, of: v <= 1e-12 * F.col(of)  # noqa: E731  what rounding leaves of equal values
    slope = F.when(some & ~flat(vx, "xx"), cov / vx)
    g = g.withColumns({"slope": slope, "r": F.when(some & ~flat(vx, "xx") & ~flat(vy, "yy"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(vx * vy))))})
    p = F.when(F.col("r").isNotNull() & (F.col("n") > 2), _p_values(F.coalesce("r", F.lit(0.0)), F.col("n").cast("long")))
    return g.select("cutoff", "side", "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).alias("intercept"), "r", p.alias("p"), F.col("n").cast("long").alias("n"))


def minus_surface(traces: DataFrame) -> DataFrame:
    """Subtracts each track's mean first sample from all its samples."""
    means = traces.groupBy("track").agg(F.avg(F.get("samples", F.lit(0))).alias("_m"))
    return traces.join(means, "track").withColumn("samples", F.transform("samples", lambda v: v - F.col("_m"))).drop("_m")


def depth_sums(traces: DataFrame) -> DataFrame:
    """Per (track, depth_idx): how many samples, and their sum; all that the depth fit needs."""
    cells = tr.cells(traces).where("value is not null and not isnan(value)")
    return cells.groupBy("track", "depth_idx").agg(F.count("*").alias("n"), F.sum("value").alias("s"))


def depth_fit(sums: DataFrame, depths: DataFrame) -> DataFrame:
    """Per track: A, B, C of value = A exp(B depth) + C with B <= 0 and C <= 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("depth_idx")
        a, b, c = kernels.fit_decay(pdf["depth"].to_numpy(float), pdf["n"].to_numpy(float), pdf["s"].to_numpy(float))
        return pd.DataFrame([{"track": pdf["track"].iloc[0], "a": a, "b": b, "c": c}])

    return sums.join(depths, ["track", "depth_idx"]).groupBy("track").applyInPandas(run, "track string, a double, b double, c double")


def depth_corrected(traces: DataFrame, fit: DataFrame, depths: Column) -> DataFrame:
    """((z - C) / A e^(-B d) - 1) e^(B d); ``depths``: the array of depths."""
    bent = lambda z, d: (F.try_divide(z - F.col("c"), F.col("a")) * F.exp(-F.col("b") * d) - 1) * F.exp(F.col("b") * d)
    return traces.join(fit, "track").withColumn("samples", F.zip_with("samples", depths, bent)).drop("a", "b", "c")


def by_deviation(traces: DataFrame) -> DataFrame:
    """Divides samples by their track's population standard deviation."""
    sd = tr.cells(traces).groupBy("track").agg(F.stddev_pop("value").alias("_sd"))
    return traces.join(sd, "track").withColumn("samples", F.transform("samples", lambda v: F.try_divide(v, F.col("_sd")))).drop("_sd")


def rescaled(traces: DataFrame, flagged: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Each trace of flagged tracks min-max scaled to the pooled percentiles of all other tracks.

    The exact percentiles over the others' samples are two numbers. Traces without any spread get the
    lower bound.
    """
    others = tr.cells(traces.join(flagged.select("track"), "track", "left_anti")).where("value is not null and not isnan(value)")
    bounds = pooled.percentiles(others, "value", [low, high]) or [None, None]
    rows = traces.join(flagged.select("track"), "track", "left_semi")
    lo, hi = (F.lit(x).cast("double") for x in bounds)
    # bounds as columns: within the lambda they would be looked for again at every sample
    rows = rows.withColumns({"_a": F.array_min("samples"), "_b": F.array_max("samples")})
    scaled = F.transform("samples", lambda v: lo + F.coalesce(F.try_divide(v - F.col("_a"), F.col("_b") - F.col("_a")), F.lit(0.0)) * (hi - lo))
    return rows.withColumn("samples", scaled).drop("_a", "_b")


def midpoint_percentiles(df: DataFrame, key: str, value: str, quantiles: list[float]) -> DataFrame:
    """Per key, percentiles by the midpoint rule: the mean of the two neighbouring ranks' values.

    The count gives the ranks; only the ranges of values that hold one are sorted. (key, quantile, value)
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(key, F.col(value).cast("double").alias("_v"))
    at = (F.col("_all") - 1) * F.col("quantile")
    ranks = rows.groupBy(key).agg(F.count("*").alias("_all")).select(key, "_all", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("quantile"))
    ranks = ranks.select(key, "quantile", F.explode(F.array(F.floor(at + 1e-9), F.ceil(at - 1e-9))).alias("_rank"))
    hit = pooled.at_ranks(rows, key, ranks)
    return hit.groupBy(key, "quantile").agg(F.avg("_v").alias(value))


def to_bytes(value: Column, low: Column, high: Column) -> Column:
    """0..255 between two bounds, rounded half to even and clamped; missing is 0."""
    scaled = F.bround(F.try_divide(value - low, high - low) * 255)
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(255), scaled)), F.lit(0)).cast("int")
