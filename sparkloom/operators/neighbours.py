"""Exact nearest neighbours in few dimensions by grid cells that grow until the answer is certain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from sparkloom.session import cut_lineage


def _cells(coords: list[str], width: float) -> list[Column]:
    return [F.floor(F.col(c) / F.lit(width)).cast("bigint").alias(f"_g{i}") for i, c in enumerate(coords)]


def _around(dims: int) -> Column:
    offsets = [()]
    for _ in range(dims):
        offsets = [o + (s,) for o in offsets for s in (-1, 0, 1)]
    return F.array(*[F.struct(*[F.lit(s).alias(f"o{i}") for i, s in enumerate(o)]) for o in offsets])


#: Rows that a query may meet in its own cell at the start, times k.
CROWD = 4


def _first_width(points: DataFrame, coords: list[str], width: float, spans: list[float], limit: int) -> float:
    """Half the width until a point shares its cell with `limit` points on average, so that the first round meets few pairs however the points are spread."""
    least = max(spans) / (1 << 40)
    while width > least:
        cells = points.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in coords])).groupBy(*_cells(coords, width)).agg(F.count("*").cast("double").alias("_n"))
        crowd = cells.agg(F.sum(F.col("_n") * F.col("_n")) / F.sum("_n")).first()[0]
        if crowd is None or crowd <= limit:
            break
        width /= 2
    return width


def knn(queries: DataFrame, donors: DataFrame, query_id: str, donor_id: str, coords: list[str], k: int,
        payload: list[str] = (), skip_self: bool = False) -> DataFrame:
    """(query_id, donor_id, distance, rank, payload) of the k nearest donors, ties by donor id.

    Donors at the same point are reduced to the k smallest ids first, which changes no answer. In
    each round a query looks into its cell and the cells around it; it is answered when the k-th
    distance found is within one cell width. The others go on with cells twice as wide, until the
    cells span the data. The first cells are so narrow that they hold few points where the points are,
    not on average over the box, so the pairs of a query do not grow with the table. Cells are joined by
    equality and the top k is limited on the map side.
    """
    spark = queries.sparkSession
    dims = len(coords)
    take = k + 1 if skip_self else k
    point = W.partitionBy(*coords).orderBy(donor_id)
    points = donors.select(donor_id, *coords, *payload).withColumn("_r", F.row_number().over(point)).where(F.col("_r") <= take).drop("_r")
    points = cut_lineage(points)
    box = points.agg(F.count("*").alias("n"), *[e for i, c in enumerate(coords) for e in (
        F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}"))]).first()
    reach = queries.agg(*[e for i, c in enumerate(coords) for e in (F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}"))]).first()
    if not box["n"] or reach["a0"] is None:
        return queries.limit(0).select(query_id).join(points.limit(0), F.lit(False)).withColumns({"distance": F.lit(0.0), "rank": F.lit(0)})
    spans = [max(box[f"b{i}"], reach[f"b{i}"]) - min(box[f"a{i}"], reach[f"a{i}"]) for i in range(dims)]
    area = reduce(lambda x, y: x * y, [s or 1.0 for s in spans])
    width = _first_width(points, coords, (area * take / box["n"]) ** (1 / dims), spans, CROWD * take)
    open_ = queries.select(query_id, *[F.col(c).alias(f"_q{i}") for i, c in enumerate(coords)], *coords)
    done = None
    while True:
        last = width >= max(spans)
        near = open_.withColumn("_o", F.explode(_around(dims))).select(
            query_id, *[f"_q{i}" for i in range(dims)],
            *[(F.floor(F.col(c) / F.lit(width)).cast("bigint") + F.col(f"_o.o{i}")).alias(f"_g{i}") for i, c in enumerate(coords)])
        placed = points.select("*", *_cells(coords, width))
        pairs = near.join(placed, [f"_g{i}" for i in range(dims)])
        if skip_self:
            pairs = pairs.where(F.col(query_id) != F.col(donor_id))
        dist = F.sqrt(reduce(lambda x, y: x + y, [(F.col(c) - F.col(f"_q{i}")) ** 2 for i, c in enumerate(coords)]))
        best = W.partitionBy(query_id).orderBy("distance", donor_id)
        top = pairs.withColumn("distance", dist).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
            query_id, donor_id, "distance", "rank", *payload)
        top = cut_lineage(top)
        if last:
            return top if done is None else done.unionByName(top)
        sure = top.groupBy(query_id).agg(F.count("*").alias("n"), F.max("distance").alias("d")).where((F.col("n") == k) & (F.col("d") <= width)).select(query_id)
        answered = top.join(sure, query_id, "left_semi")
        done = answered if done is None else done.unionByName(answered)
        open_ = cut_lineage(open_.join(sure, query_id, "left_anti"))
        if open_.isEmpty():
            return done
        width *= 2
