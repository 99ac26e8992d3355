"""Regions, elevation and area."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, kernels
from . import blocks

#: The regions from which a point gets its name, first match first.
PRIORITY = ("NO", "NE", "SE", "SW", "CW", "NW")
#: Slices are cut between these limits, by as many edges as there are 10 km in between.
NORTHING, EASTING = (-3000000.0, -1150000.0), (-600000.0, 650000.0)
#: First and last year of each period.
PERIODS = (("2002-2003", 2002, 2003), ("2010", 2010, 2010), ("2011-2012", 2011, 2012), ("2013-2014", 2013, 2014), ("2017-2018", 2017, 2018))
#: Side of a hull's tile, in units of its halo.
TILE = 6
#: Cells that surround one, by their distance from it in both directions.
AROUND = ((3, 0), (-3, 0), (0, 3), (0, -3), (2, 2), (2, -2), (-2, 2), (-2, -2))
#: Points that are few enough to take as they are.
LEAST_THINNED = 10_000
#: Corners that polygons may have together to travel as one broadcast row; beyond, they are joined by
#: grid cell.
MOST_CORNERS = 10_000


def year_of(name: Column) -> Column:
    """Year of a track: of names YYYYMMDD_..., or of 2002-2003 names such as may24_02_23."""
    return F.when(name.rlike(r"^\d{8}_"), F.substring(name, 1, 4).try_cast("int")).otherwise((F.regexp_extract(name, r"^[a-z]{3}\d{2}_(\d{2})", 1).try_cast("int") + 2000))


def period_of(year: Column) -> Column:
    """Label of the period, null outside all."""
    return F.coalesce(*[F.when(year.between(a, b), F.lit(p)) for p, a, b in PERIODS])


def boxed(polygons: DataFrame) -> DataFrame:
    """Adds each ring's bounding box."""
    side = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    return polygons.withColumns({"_x0": side(F.array_min, "x"), "_x1": side(F.array_max, "x"), "_y0": side(F.array_min, "y"), "_y1": side(F.array_max, "y")})


def _few(polygons: DataFrame) -> bool:
    return (polygons.agg(F.sum(F.size("ring"))).first()[0] or 0) <= MOST_CORNERS


def _in_box(p: Column | None, px: Column, py: Column) -> Column:
    side = (lambda c: F.col(c)) if p is None else (lambda c: p[c])
    return (px >= side("_x0")) & (px <= side("_x1")) & (py >= side("_y0")) & (py <= side("_y1"))


def _by_cell(points: DataFrame, boxes: DataFrame, px: Column, py: Column) -> DataFrame:
    """Points with the polygons that hold them, joined by grid cells as large as the mean box, so that a
    polygon is in few cells and a point in one."""
    mean = boxes.agg(F.avg(F.col("_x1") - F.col("_x0")), F.avg(F.col("_y1") - F.col("_y0"))).first()
    w, h = (F.lit(x or 1.0) for x in mean)
    cells = lambda lo, hi, by: F.explode(F.sequence(F.floor(F.col(lo) / by), F.floor(F.col(hi) / by)))
    dealt = boxes.withColumn("_i", cells("_x0", "_x1", w)).withColumn("_j", cells("_y0", "_y1", h))
    at = points.withColumns({"_i": F.floor(px / w), "_j": F.floor(py / h)})
    return at.join(dealt, ["_i", "_j"]).where(_in_box(None, px, py) & geo.in_ring(px, py, F.col("ring"))).drop("_i", "_j")


def within(points: DataFrame, polygons: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Points with every polygon that holds them: a bounding-box join, then the exact test.

    ``polygons``: id, region, ring. Their corners are counted before they are broadcast; beyond the
    limit points and boxes meet by grid cell.
    """
    p, px, py = boxed(polygons), F.col(x), F.col(y)
    held = points.join(F.broadcast(p), _in_box(None, px, py)).where(geo.in_ring(px, py, F.col("ring"))) if _few(polygons) else _by_cell(points, p, px, py)
    return held.drop("ring", "_x0", "_x1", "_y0", "_y1")


def _with_best(points: DataFrame, polygons: DataFrame, rank: Column, x: str, y: str, key: list[str]) -> DataFrame:
    """Adds _best (rank, id, region): the polygon of least rank that holds the point, or null.

    Few polygons travel as one broadcast row and are tested in the row, so that points aren't
    shuffled. Many meet the points by grid cell; the best match per key is joined back.
    """
    ranked = boxed(polygons).withColumn("_rank", rank).where("_rank is not null")
    px, py = F.col(x), F.col(y)
    if _few(polygons):
        one = ranked.agg(F.collect_list(F.struct("_rank", "id", "region", "ring", "_x0", "_x1", "_y0", "_y1")).alias("_all"))
        hit = F.filter("_all", lambda p: _in_box(p, px, py) & geo.in_ring(px, py, p["ring"]))
        best = F.array_min(F.transform(hit, lambda p: F.struct(p["_rank"].alias("rank"), p["id"].alias("id"), p["region"].alias("region"))))
        # made by a generator, so that what filters on it later doesn't test the polygons once more
        return points.crossJoin(F.broadcast(one)).withColumn("_best", F.explode(F.array(best))).drop("_all")
    hit = _by_cell(points, ranked, px, py)
    first = hit.groupBy(*key).agg(F.min(F.struct(F.col("_rank").alias("rank"), "id", "region")).alias("_best"))
    return points.join(first, key, "left")


def clipped(points: DataFrame, polygons: DataFrame, key: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """One row per point inside any polygon, with the one of the smallest id."""
    best = _with_best(points, polygons, F.col("id"), x, y, key).where("_best is not null")
    return best.withColumns({"id": F.col("_best.id"), "region": F.col("_best.region")}).drop("_best")


def with_region(points: DataFrame, polygons: DataFrame, key: list[str], x: str = "x", y: str = "y", order: tuple[str, ...] = PRIORITY) -> DataFrame:
    """Region of the first match in priority order, else Out."""
    rank = F.nullif(F.array_position(F.array(*[F.lit(r) for r in order]), F.col("region")), F.lit(0).cast("long"))
    return _with_best(points, polygons, rank, x, y, key).withColumn("region", F.coalesce("_best.region", F.lit("Out"))).drop("_best")


def with_elevation(points: DataFrame, dem: DataFrame, x0: float, y0: float, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """Elevation of the grid cell; null without coordinates or cell. Rows count down from y0, columns
    right from x0. An equi-join on the cell, so the grid may be any size."""
    row, col = F.floor((F.lit(y0) - F.col(y)) / size).cast("long"), F.floor((F.col(x) - F.lit(x0)) / size).cast("long")
    grid = dem.select(F.col("row").alias("_row"), F.col("col").alias("_col"), F.col("elevation").alias("dem"))
    return points.withColumns({"_r": row, "_c": col}).join(grid, (F.col("_r") == F.col("_row")) & (F.col("_c") == F.col("_col")), "left").drop("_r", "_c", "_row", "_col")


def union_years(yearly: dict[int, DataFrame]) -> DataFrame:
    """All years' points with year and its text; columns that a year lacks are null."""
    out = None
    for year, df in sorted(yearly.items()):
        df = df.withColumns({"year": F.lit(year), "str_year": F.lit(str(year))})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def by_period(points: DataFrame, cumulative: bool = False, periods: tuple[tuple[str, int, int], ...] = PERIODS) -> DataFrame:
    """Points under their period, or under each period that ends in or after their year."""
    if not cumulative:
        return points.withColumn("period", period_of(F.col("year"))).where("period is not null")
    labels = F.array(*[F.when(F.col("year") <= b, F.lit(p)) for p, _, b in periods])
    return points.withColumn("period", F.explode(F.array_compact(labels)))


def slice_edges(limits: tuple[float, float], width: float = 10_000.0) -> tuple[int, float]:
    """Number of edges, and the distance between them."""
    n = int(abs(limits[1] - limits[0]) / width)
    return n, (limits[1] - limits[0]) / (n - 1)


def slice_index(v: Column, limits: tuple[float, float]) -> Column:
    """Index of the slice by its upper edge, from 1; null outside."""
    n, step = slice_edges(limits)
    i = F.floor((v - F.lit(limits[0])) / step).cast("long") + 1
    return F.when((v >= limits[0]) & (i <= n - 1), i)


def slice_limits(points: DataFrame, limits: tuple[float, float], along: str) -> DataFrame:
    """Lowest and highest elevation by slice, region and period."""
    rows = points.withColumn("slice", slice_index(F.col(along), limits)).where("slice is not null")
    return rows.groupBy("region", "period", "slice").agg(F.min("elevation").alias("low"), F.max("elevation").alias("high"))


def own_slice_limits(points: DataFrame) -> DataFrame:
    """Lowest and highest elevation by region, period and slice in one pass over the points: NO goes by
    easting slices, the others by northing."""
    own = F.when(F.col("region") == "NO", slice_index(F.col("x"), EASTING)).otherwise(slice_index(F.col("y"), NORTHING))
    return points.withColumn("slice", own).where("slice is not null").groupBy("region", "period", "slice").agg(F.min("elevation").alias("low"), F.max("elevation").alias("high"))


def region_summary(northing: DataFrame, easting: DataFrame | None = None) -> DataFrame:
    """Mean, median, population deviation and maximum of the slices' highest elevations, by region and
    period; NO goes by easting slices, the others by northing. Of own_slice_limits, one input is enough."""
    rows = northing if easting is None else northing.where("region <> 'NO'").unionByName(easting.where("region = 'NO'"))
    return rows.groupBy("region", "period").agg(F.avg("high").alias("mean_high"), F.median("high").alias("median_high"), F.stddev_pop("high").alias("sd_high"), F.max("high").alias("max_high"))


def period_change(summary: DataFrame, first: str, last: str, value: str = "median_high") -> DataFrame:
    """Change of a value between two periods per region; null where one is missing."""
    wide = summary.groupBy("region").agg(F.max(F.when(F.col("period") == first, F.col(value))).alias("first"), F.max(F.when(F.col("period") == last, F.col(value))).alias("last"))
    return wide.withColumn("change", F.col("last") - F.col("first"))


def group_limits(points: DataFrame, groups: DataFrame) -> DataFrame:
    """Lowest and highest elevation per group of radargrams; flags say whether each counts.

    ``groups``: track, grp, low_ok, high_ok.
    """
    rows = points.join(groups, "track")
    return rows.groupBy("grp").agg(F.min(F.when(F.col("low_ok"), F.col("elevation"))).alias("low"), F.max(F.when(F.col("high_ok"), F.col("elevation"))).alias("high"))


def _tiled_areas(points: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """(keys, area): the Delaunay triangles with a circumradius under 1 / alpha, summed over tiles.

    A tile of TILE / alpha has the points up to 1 / alpha around it, which hold every such circle around a
    centre in the tile whole; so its triangles are those of all points, and each has one tile.
    """
    halo, tile = 1 / alpha, TILE / alpha
    of = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))
    dealt = points.withColumn("_i", F.explode(of("x"))).withColumn("_j", F.explode(of("y")))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = key[-2:]
        area = kernels.alpha_area(pdf[["x", "y"]].to_numpy(float), alpha, (i * tile, j * tile, (i + 1) * tile, (j + 1) * tile))
        return pd.DataFrame([(*key[:-2], area)], columns=[*keys, "area"])

    schema = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)
    dealt = blocks.spread(dealt, *keys, "_i", "_j")
    return dealt.groupBy(*keys, "_i", "_j").applyInPandas(run, f"{schema}, area double").groupBy(*keys).agg(F.sum("area").alias("area"))


def _thinned(rows: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """rows (keys, x, y) with one point in place of all of a cell that is surrounded."""
    at = rows.withColumns({"_i": F.floor(F.col("x") / cell), "_j": F.floor(F.col("y") / cell)})
    cells = at.groupBy(*keys, "_i", "_j").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    seen = F.explode(F.array(*[F.struct((F.col("_i") + i).alias("_i"), (F.col("_j") + j).alias("_j")) for i, j in AROUND])).alias("_of")
    inside = cells.select(*keys, seen).groupBy(*keys, "_of._i", "_of._j").count().where(F.col("count") == len(AROUND)).drop("count")
    inside = blocks.held(cells.join(inside, [*keys, "_i", "_j"], "left_semi"))
    return at.join(inside, [*keys, "_i", "_j"], "left_anti").unionByName(inside).select(*keys, "x", "y")


def _without_deep(points: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """Points with the same area, few of which are inside. ``points`` is kept, as it is read twice.

    A cell is surrounded if each of eight cells around it, three away by sides or two diagonally, has
    points. Whatever way a circle of 1 / alpha or more that reaches such a cell lies, it holds one of the
    eight whole, as cells are a fifth of 1 / alpha or less. So no empty circle of that size reaches the
    cell, whichever points it and the eight have; the empty ones, hence the triangles around a centre with
    1 / alpha or more, and the convex hull are those without its points, and so is what they leave of the
    hull, the area. Surrounded cells keep one place, (least x, least y), so that they still have a point.
    Cells are halved as long as they hold several points each: of dense areas a narrow seam stays, whose
    width follows the distance of the points.
    """
    cell, rows = 1 / (5 * alpha), points
    while True:
        n = rows.count()
        rows = blocks.held(_thinned(rows, keys, cell))
        left, cell = rows.count(), cell / 2
        if left > 0.8 * n or left < LEAST_THINNED:
            return rows


def hull_areas(points: DataFrame, alpha: float = 2e-5, by: tuple[str, ...] = (), thin: float | None = None, skip: tuple[str, ...] = ("SE", "Out")) -> DataFrame:
    """(region, period, area, n) of concave hulls; 2017-2018 also holds the points of 2011-2012.

    ``points``: region, period, x, y and columns ``by``, such as a mask's name: each of their values has
    a hull of its own, and a region's are added. Where no triangle is small enough, alpha is halved
    until some are; three points are a triangle. Points that can't change the area are left out first. With ``thin`` only the outermost points of each cell of
    that size are kept, in all four directions, which moves borders by less than a cell. n counts
    distinct points.
    """
    keys = ["region", "period", *by]
    later = F.when(F.col("period") == "2011-2012", F.array("period", F.lit("2017-2018"))).otherwise(F.array("period"))
    rows = points.where(~F.col("region").isin(list(skip))).withColumn("period", F.explode(later)).select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    rows = rows.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    if thin:
        cell = [F.floor(F.col(k) / thin) for k in "xy"]
        ends = [f(F.struct(a, b)) for f in (F.min, F.max) for a, b in (("x", "y"), ("y", "x"))]
        outer = rows.groupBy(*keys, *cell).agg(F.array(*[F.struct(e["x"].alias("x"), e["y"].alias("y")) for e in ends]).alias("p"))
        rows = outer.select(*keys, F.explode("p").alias("p")).select(*keys, "p.x", "p.y")
    every = blocks.held(rows.distinct())
    sizes = blocks.held(every.groupBy(*keys).agg(F.count("*").alias("n")))
    rows = _without_deep(every, keys, alpha)
    found, todo = None, sizes.where("n > 2")
    while True:
        areas = blocks.held(_tiled_areas(rows.join(todo.select(*keys), keys, "left_semi"), keys, alpha))
        some = areas.where("area > 0")
        found = some if found is None else found.unionByName(some)
        todo, alpha = areas.where("area = 0"), alpha / 2
        if todo.isEmpty() or alpha < 1e-12:
            break
    out = sizes.join(found, keys, "left").groupBy("region", "period")
    return out.agg(F.sum(F.coalesce("area", F.lit(0.0))).alias("area"), F.sum("n").alias("n"))


def in_masks(points: DataFrame, masks: DataFrame) -> DataFrame:
    """Points with each mask of their own region that holds them. ``masks``: mask, region, ring; a mask may
    have several rings. Points: region, x, y, ..."""
    rings = masks.select("mask", F.col("region").alias("_of"), "ring")
    return within(points, rings).where("region = _of").drop("_of")


def polygon_areas(polygons: DataFrame, without: tuple[int, ...] = ()) -> DataFrame:
    """Area by region and period, without some ids; shoelace sums."""
    return polygons.where(~F.col("id").isin(list(without)) if without else F.lit(True)).withColumn("_a", geo.ring_area(F.col("ring"))).groupBy("region", "period").agg(F.sum("_a").alias("area"))


def area_change(areas: DataFrame, first: str, last: str) -> DataFrame:
    wide = areas.groupBy("region").agg(F.sum(F.when(F.col("period") == first, F.col("area"))).alias("first"), F.sum(F.when(F.col("period") == last, F.col("area"))).alias("last"))
    return wide.withColumns({"change": F.col("last") - F.col("first"), "percent": F.try_divide(F.col("last") - F.col("first"), F.col("first")) * 100})


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A ring of four corners."""
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1))
