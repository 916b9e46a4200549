"""Density clusters (DBSCAN) on a grid, for any number of dimensions.

Cells have a diagonal of eps, so the points of one cell are neighbours of each
other: a cell with enough points is dense as a whole and needs no comparison.
Every cell knows the box of its points; only cells whose boxes come within eps are compared.  Points of
sparse cells are counted against the cells around them.  Two neighbouring cells are joined when any of their core points
are within eps: a bounded trial settles nearly all pairs, the rest is cut into ever smaller sub-cells, of which only
pairs of boxes nearer than eps go on, until one pair is surely within eps (the first hit) or few points are left.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, number
from ..session import durable
from .neighbors import BLOCK, distances, matrix, paired_blocks
from .ordering import first_per_group, with_position

OFFSET_DIMENSIONS = 3  # up to here the cells around a cell are listed; beyond, coarse cells of this many dimensions meet
TRIAL = 32  # points per cell of the cheap connection test
SALTS = 16
DIRECT = 1 << 14  # point pairs of two sub-cells that are compared without a further cut
DEEPEST = 24  # halvings of a cell's side, by which doubles are told apart


def _offsets(dims: int) -> list[list[int]]:
    """Neighbour cells that can hold a point within eps (cell side eps / sqrt(dims))."""
    far = math.ceil(math.sqrt(dims))
    out = []
    for step in itertools.product(range(-far, far + 1), repeat=dims):
        gap = sum(max(0, abs(s) - 1) ** 2 for s in step)
        if gap <= dims:
            out.append(list(step))
    return out


def _box(dims: int, prefix: str = "") -> list[Column]:
    """Aggregates: the lowest and highest coordinates of a group's vectors."""
    return [F.array(*[F.min(F.col("vector")[i]) for i in range(dims)]).alias(f"{prefix}low"),
            F.array(*[F.max(F.col("vector")[i]) for i in range(dims)]).alias(f"{prefix}high")]


def _sum_squares(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x * x)


def _least(low: str, high: str, low2: str, high2: str) -> Column:
    """Squared distance of two boxes."""
    apart = F.zip_with(F.zip_with(low, high2, lambda a, b: a - b), F.zip_with(low2, high, lambda a, b: a - b),
                       lambda a, b: F.greatest(a, b, F.lit(0.0)))
    return _sum_squares(apart)


def _most(low: str, high: str, low2: str, high2: str) -> Column:
    """Squared distance of the two most distant corners of two boxes."""
    apart = F.zip_with(F.zip_with(high2, low, lambda a, b: a - b), F.zip_with(high, low2, lambda a, b: a - b),
                       lambda a, b: F.greatest(a, b))
    return _sum_squares(apart)


def near_cells(cells: DataFrame, eps: float, dims: int) -> DataFrame:
    """``cell, other``: cells (with ``low`` and ``high``) whose boxes come within eps, each with itself, both ways."""
    limit = eps * eps * (1 + 1e-9)
    if dims <= OFFSET_DIMENSIONS:
        key, offsets = F.col("cell"), _offsets(dims)
    else:
        # the dimensions with most room, in coarse cells of side eps; a cell may straddle two of them
        spread = cells.agg(*[(F.max(F.col("high")[i]) - F.min(F.col("low")[i])).alias(f"s{i}") for i in range(dims)]).first()
        chosen = sorted(range(dims), key=lambda i: (-(spread[i] or 0.0), i))[:OFFSET_DIMENSIONS]
        side = eps / math.sqrt(dims)
        key = F.array(*[F.floor(F.col("cell")[i] * side / eps).cast("long") for i in sorted(chosen)])
        offsets = [list(o) for o in itertools.product(range(-2, 3), repeat=OFFSET_DIMENSIONS)]
    listed = F.array(*[F.array(*[F.lit(s).cast("long") for s in o]) for o in offsets])
    one = cells.select("cell", "low", "high", F.explode(F.transform(listed, lambda o: F.zip_with(o, key, lambda a, b: a + b))).alias("__key"))
    two = cells.select(F.col("cell").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"), key.alias("__key"))
    return durable(one.join(two, "__key").where(_least("low", "high", "low2", "high2") <= limit).select("cell", "other"))


def dbscan(df: DataFrame, columns: Sequence[str], eps: float = 0.5, min_points: int = 5, block: int = BLOCK) -> DataFrame:
    """Adds ``cluster`` (-1 = noise) and ``is_core``.

    A border point joins the cluster of its nearest core point.  Clusters are numbered
    by their smallest point.  Rows with a missing coordinate are noise.
    """
    if not columns:
        raise ValueError("at least one column is needed")
    coords = F.array(*[number(df, c) for c in columns])
    rows = df.withColumn("vector", F.when(~F.exists(coords, lambda x: x.isNull()), coords))
    out = rows.join(dbscan_vectors(rows, eps, min_points, block), "vector", "left")
    return out.withColumns(
        {"cluster": F.coalesce("cluster", F.lit(-1)), "is_core": F.coalesce("is_core", F.lit(False))}
    ).drop("vector")


def dbscan_vectors(rows: DataFrame, eps: float, min_points: int, block: int = BLOCK) -> DataFrame:
    """``vector, cluster, is_core`` of the distinct vectors of ``rows`` that belong to a cluster."""
    first = rows.where(F.col("vector").isNotNull()).select(F.size("vector")).first()
    dims = first[0] if first else 1
    side = eps / math.sqrt(dims)
    # Copies of a point collapse to one weighted row.
    points = rows.where(F.col("vector").isNotNull()).groupBy("vector").agg(F.count(F.lit(1)).alias("w"))
    points = durable(points.withColumn("cell", F.transform("vector", lambda x: F.floor(x / side).cast("long"))))
    cells = durable(points.groupBy("cell").agg(F.sum("w").alias("weight"), *_box(dims)))
    near = near_cells(cells, eps, dims)
    sized = points.join(cells.select("cell", "weight"), "cell")
    dense = sized.where(F.col("weight") >= min_points).select("vector", "cell")
    sparse = sized.where(F.col("weight") < min_points).select("vector", "cell")

    # Neighbours of points in sparse cells, counted block by block.
    asked = sparse.join(near, "cell").select("vector", "cell", F.col("other").alias("__cell"))
    held = points.select(F.col("vector").alias("point"), "w", F.col("cell").alias("__cell"))
    count_schema = T.StructType([T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("found", T.LongType())])

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"vector": [], "found": []})
        weight = a["w"].to_numpy()
        found = np.zeros(len(b), dtype=np.int64)
        for part, d in distances(matrix(b["vector"]), matrix(a["point"])):
            found[part] = ((d <= eps) * weight[None, :]).sum(axis=1)
        return pd.DataFrame({"vector": b["vector"].to_numpy(), "found": found})

    counted = paired_blocks(held, asked, "point", "vector", count, count_schema, block)
    lonely_cores = (
        counted.groupBy("vector").agg(F.sum("found").alias("found")).where(F.col("found") >= min_points).select("vector")
        .join(sparse, "vector")
    )
    cores = durable(dense.unionByName(lonely_cores.select("vector", "cell")))

    linked = _links(cores, near, eps, side, dims)
    labels = _components(cores.select("cell").distinct(), linked)
    core_points = cores.join(labels, "cell").select("vector", "label")

    # Border points: the nearest core point within eps.
    rest = points.join(cores.select("vector"), "vector", "left_anti").select("vector", "cell")
    seeking = rest.join(near, "cell").select("vector", F.col("other").alias("__cell"))
    targets = cores.join(labels, "cell").select(F.col("vector").alias("point"), "label", F.col("cell").alias("__cell"))
    label_type = labels.schema["label"].dataType
    border_schema = T.StructType([
        T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("distance", T.DoubleType()),
        T.StructField("point", T.ArrayType(T.DoubleType())), T.StructField("label", label_type),
    ])

    def closest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"vector": [], "distance": [], "point": [], "label": []})
        out = []
        a = a.assign(sort=[tuple(p) for p in a["point"]]).sort_values("sort")  # ties: the smaller point
        for part, d in distances(matrix(b["vector"]), matrix(a["point"])):
            near = d.argmin(axis=1)
            gap = d[np.arange(len(d)), near]
            keep = gap <= eps
            out.append(pd.DataFrame({
                "vector": b["vector"].to_numpy()[part][keep], "distance": gap[keep], "point": a["point"].to_numpy()[near][keep],
                "label": a["label"].to_numpy()[near][keep],
            }))
        return pd.concat(out)

    border = paired_blocks(targets, seeking, "point", "vector", closest, border_schema, block)
    border = border.groupBy("vector").agg(F.min(F.struct("distance", "point", "label")).alias("best")).select(
        "vector", F.col("best.label").alias("label")
    )
    found = core_points.withColumn("is_core", F.lit(True)).unionByName(border.withColumn("is_core", F.lit(False)))
    return _numbers(found)


def _links(cores: DataFrame, near: DataFrame, eps: float, side: float, dims: int) -> DataFrame:
    """Pairs of neighbouring cells with core points within eps.

    A bounded trial per cell settles nearly all pairs of full cells.  The others are refined: both cells are cut
    into sub-cells with boxes, pairs of boxes beyond eps are dropped, and a pair whose box corners or whose first points are within
    eps joins its cells.  Work grows with the points near the border of the two cells, not with their product.
    """
    few = first_per_group(cores, ["cell"], [F.xxhash64("vector")], TRIAL)
    trial = few.groupBy("cell").agg(F.collect_list("vector").alias("trial"))
    pairs = near.where(F.col("cell") < F.col("other")).join(trial, "cell")
    both = pairs.join(trial.select(F.col("cell").alias("other"), F.col("trial").alias("trial2")), "other")
    close = F.exists("trial", lambda a: F.exists("trial2", lambda b: _gap(a, b) <= eps * eps))
    tested = durable(both.select("cell", "other", close.alias("close")))
    joined = [tested.where("close").select("cell", "other")]
    # cells of no more than TRIAL points have been compared in full
    full = cores.groupBy("cell").agg((F.count(F.lit(1)) > TRIAL).alias("full"))
    unsure = tested.where(~F.col("close")).join(full, "cell").join(full.toDF("other", "full2"), "other").where("full or full2")
    unsure = durable(unsure.select("cell", "other"))
    listed = unsure.select("cell").union(unsure.select("other")).distinct()
    held = cores.join(listed, "cell")
    part = F.struct(F.lit(0).alias("level"), F.col("cell").alias("at"))
    open_pairs = unsure.select("cell", "other", F.struct(F.lit(0).alias("level"), F.col("cell").alias("at")).alias("one"),
                               F.struct(F.lit(0).alias("level"), F.col("other").alias("at")).alias("two"))
    level = 0
    while not open_pairs.isEmpty():
        level += 1

        def sub(depth: int) -> Column:
            width = side / (1 << depth)
            return F.struct(F.lit(depth).alias("level"), F.transform("vector", lambda x: F.floor(x / width).cast("long")).alias("at"))

        # sub-cells of the open cells, with box, first point and the sub-cell they were cut from
        parent = part if level == 1 else sub(level - 1)
        parts = held.select(parent.alias("parent"), sub(level).alias("sub"), "vector").groupBy("parent", "sub").agg(
            F.count(F.lit(1)).alias("n"), F.min("vector").alias("point"), *_box(dims))
        parts = durable(parts)
        one = parts.select(F.col("parent").alias("one"), F.col("sub").alias("sub1"), F.col("n").alias("n1"), F.col("point").alias("p1"), "low", "high")
        two = parts.select(F.col("parent").alias("two"), F.col("sub").alias("sub2"), F.col("n").alias("n2"), F.col("point").alias("p2"),
                           F.col("low").alias("low2"), F.col("high").alias("high2"))
        met = open_pairs.join(one, "one").join(two, "two").where(_least("low", "high", "low2", "high2") <= eps * eps * (1 + 1e-9))
        hit = (_most("low", "high", "low2", "high2") <= eps * eps) | (_gap(F.col("p1"), F.col("p2")) <= eps * eps)
        met = durable(met.select("cell", "other", "sub1", "sub2", "n1", "n2", hit.alias("hit")))
        sure = durable(met.where("hit").select("cell", "other").distinct())
        rest = met.where("not hit").join(sure, ["cell", "other"], "left_anti")
        small = (F.col("n1") * F.col("n2") <= DIRECT) if level < DEEPEST else F.lit(True)
        direct = _direct(rest.where(small), held.select(sub(level).alias("sub"), "vector"), eps)
        joined += [sure, direct]
        open_pairs = durable(rest.where(~small).join(direct, ["cell", "other"], "left_anti").select(
            "cell", "other", F.col("sub1").alias("one"), F.col("sub2").alias("two")))
        still = open_pairs.select(F.col("one").alias("sub")).union(open_pairs.select(F.col("two").alias("sub"))).distinct()
        held = durable(held.withColumn("sub", sub(level)).join(still, "sub", "left_semi").select("vector", "cell"))
    out = joined[0]
    for more in joined[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _direct(pairs: DataFrame, points: DataFrame, eps: float) -> DataFrame:
    """``cell, other`` of the pairs of small sub-cells in which two points are within eps."""
    small = pairs.select("sub1").union(pairs.select("sub2")).toDF("sub").distinct()
    lists = durable(points.join(small, "sub", "left_semi").groupBy("sub").agg(F.collect_list("vector").alias("points")))
    both = pairs.join(lists.toDF("sub1", "points1"), "sub1").join(lists.toDF("sub2", "points2"), "sub2")

    @F.pandas_udf("boolean")
    def touching(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([any(bool((d <= eps).any()) for _, d in distances(matrix(x), matrix(y))) for x, y in zip(a, b)], dtype=bool)

    return durable(both.where(touching("points1", "points2")).select("cell", "other").distinct())


def _gap(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _components(cells: DataFrame, links: DataFrame) -> DataFrame:
    """``cell, label``: the smallest cell of each connected group.

    Every round takes the smallest label around each cell and then the label of that
    label, so the number of rounds grows with the logarithm of a chain's length.
    """
    both = durable(links.unionByName(links.select(F.col("other").alias("cell"), F.col("cell").alias("other"))))
    labels = durable(cells.withColumn("label", F.col("cell")))
    while True:
        seen = both.join(labels.withColumnsRenamed({"cell": "other", "label": "near"}), "other").groupBy("cell").agg(F.min("near").alias("near"))
        lower = labels.join(seen, "cell", "left").select(
            "cell", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")
        )
        # Many cells share one label, so the look-up side is copied and the look-up salted.
        jump = labels.select(F.col("cell").alias("label"), F.col("label").alias("further")).withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        )
        salted = lower.withColumn("salt", F.pmod(F.xxhash64("cell"), F.lit(SALTS)).cast("int"))
        now = durable(salted.join(jump, ["label", "salt"]).select("cell", "old", F.col("further").alias("label")))
        labels = now.select("cell", "label")
        if now.where(F.col("old") != F.col("label")).isEmpty():
            return labels


def _numbers(found: DataFrame) -> DataFrame:
    """Cluster numbers 0, 1, ... in the order of each cluster's smallest point."""
    firsts = found.groupBy("label").agg(F.min("vector").alias("first"))
    numbers = with_position(firsts, [], ["first"], "cluster").select("label", F.col("cluster").cast("int").alias("cluster"))
    return found.join(numbers, "label").select("vector", "cluster", "is_core")


def noise_share(clustered: DataFrame) -> DataFrame:
    """``cluster, size, cores``."""
    return clustered.groupBy(col("cluster")).agg(F.count(F.lit(1)).alias("size"), F.count_if("is_core").alias("cores"))
