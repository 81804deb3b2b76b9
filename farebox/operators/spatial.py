"""Stations, venues and routes on the plane."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from farebox.functions.geo import EPSG_3116, TransverseMercator, point_segment_distance, project_tm
from farebox.functions.numeric import distance_class
from farebox.schemas import DISTANCE_CLASSES, VENUE
from farebox.session import materialize


def distance_to_point(df: DataFrame, lon: float = VENUE[0], lat: float = VENUE[1],
                      crs: TransverseMercator = EPSG_3116) -> DataFrame:
    """Planar metres to a point as ``dist_m``, and its distance class as ``grupo``."""
    px, py = crs.project(F.lit(lon), F.lit(lat))
    out = project_tm(df, crs=crs)
    out = out.withColumn("dist_m", F.sqrt((F.col("x") - px) ** 2 + (F.col("y") - py) ** 2))
    return out.withColumn("grupo", distance_class("dist_m", DISTANCE_CLASSES)).drop("x", "y")


def nearest_n_per_class(df: DataFrame, n: int = 5, group: str = "grupo") -> DataFrame:
    """The n nearest stations of every class (a report; ties by code)."""
    w = W.partitionBy(group).orderBy("dist_m", "codigo_estacion")
    return df.withColumn("orden", F.row_number().over(w)).where(F.col("orden") <= n)


def within_distance_of_lines(points: DataFrame, routes: DataFrame, metres: float = 500.0,
                             key: str = "codigo_estacion", crs: TransverseMercator = EPSG_3116) -> DataFrame:
    """Distance to the nearest route within reach, and whether it is at most ``metres``.

    Segments are laid on a square grid: each is listed in every cell that the segment,
    widened by ``metres``, can touch, column by column. A point has one cell, so an equality
    join on the cell finds every segment that could be near; the exact distance then decides.
    Points without a candidate keep a null distance and are outside.

    Projected points and the cells of the segments are stored before the join: the projection is
    a long series, which the optimizer would repeat in each later use of a coordinate, and the points
    are read again at the end.
    """
    cell = float(max(metres, 250.0))
    placed = project_tm(points.withColumn("_point", F.struct(*points.columns)), crs=crs)
    pts = materialize(placed.select(F.col(key).alias("_key"), "_point", "x", "y")).withColumns({
        "cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell),
    })
    planar = routes.select(
        F.transform("points", lambda p: F.struct(*[c.alias(n) for c, n in zip(crs.project(p["lon"], p["lat"]), "xy")])).alias("p")
    )
    segs = planar.where(F.size("p") >= 2).select(
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("p") - 1),
                lambda i: F.struct(F.get("p", i - 1).alias("a"), F.get("p", i).alias("b")),
            )
        ).alias("s")
    ).select(
        F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"),
        F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"),
    )

    def low(a, b):
        return F.least(a, b) - metres

    def high(a, b):
        return F.greatest(a, b) + metres

    by_column = segs.withColumn(
        "cx", F.explode(F.sequence(F.floor(low("ax", "bx") / cell), F.floor(high("ax", "bx") / cell)))
    )
    # The part of the segment whose widened x-range meets this grid column.
    dx = F.nullif(F.col("bx") - F.col("ax"), F.lit(0.0))
    t1 = F.coalesce((F.col("cx") * cell - metres - F.col("ax")) / dx, F.lit(0.0))
    t2 = F.coalesce(((F.col("cx") + 1) * cell + metres - F.col("ax")) / dx, F.lit(1.0))
    t_lo = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least(t1, t2)))
    t_hi = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(t1, t2)))
    y_at = lambda t: F.col("ay") + t * (F.col("by") - F.col("ay"))
    cells = by_column.withColumns({"_y1": y_at(t_lo), "_y2": y_at(t_hi)}).withColumn(
        "cy", F.explode(F.sequence(F.floor(low("_y1", "_y2") / cell), F.floor(high("_y1", "_y2") / cell)))
    ).drop("_y1", "_y2")
    cells = materialize(cells)
    dist = point_segment_distance(*[F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")])
    near = pts.join(cells, ["cx", "cy"]).groupBy("_key").agg(F.min(dist).alias("dist_m"))
    found = pts.select("_key", "_point.*").join(near.where(F.col("dist_m") <= metres), "_key", "left").drop("_key")
    return found.withColumn("cerca", F.col("dist_m").isNotNull().cast("int"))
