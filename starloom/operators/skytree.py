"""Nearest neighbours on the sky by nested cells that follow the density.

Positions are unit vectors in a cube whose sides are halved level by level, so
poles and ra = 0 are nothing special. Cells with more than a few positions are split; the
cells left whole, of whatever depth, cover both catalogs. Cells of the left one descend
through the right one's levels together: what is farther than the nearest
position known so far is dropped, what may hold a nearer one is split. Only rows of
cells that remain meet, so work follows the rows and not the pairs within a radius.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from starloom.functions.columns import ang_sep
from starloom.operators.stored import Stored, hot_join

#: Levels are two halvings apart; the deepest cells are 1.6 arcseconds wide and stay whole.
STEP, DEEPEST = 2, 18
#: Distances between unit vectors are exact to about 1e-15; ids decide between separations equal to 1e-9 degrees.
SLACK = 1e-10
AXES = ("x", "y", "z")


def _placed(t: DataFrame) -> DataFrame:
    """t(ra, dec, ...) with unit vectors and their cells on the finest level."""
    ra, dec = F.radians("ra"), F.radians("dec")
    t = t.withColumns({"x": F.cos(dec) * F.cos(ra), "y": F.cos(dec) * F.sin(ra), "z": F.sin(dec)})
    side = 1 << DEEPEST
    return t.withColumns({f"i{a}": F.least(F.floor((F.col(a) + 1) * (side / 2)), F.lit(side - 1)).cast("long") for a in AXES})


def _cell(depth: int) -> Column:
    """The cell at a depth, unique over all depths."""
    key = F.lit(depth).cast("long")
    for a in AXES:
        key = F.shiftleft(key, DEEPEST).bitwiseOR(F.shiftright(f"i{a}", DEEPEST - depth))
    return key


def _box() -> list[Column]:
    return [f(a).alias(f"{name}{a}") for a in AXES for name, f in (("lo_", F.min), ("hi_", F.max))]


def tree(stored: Stored, t: DataFrame, leaf: int) -> tuple[DataFrame, list[DataFrame]]:
    """(t with the ``cell`` that holds each row, levels): cells of more than ``leaf`` rows are split down to DEEPEST.

    A level has cell, the cell above, rows, whether it is whole, the box of
    its positions and one of them. t is stored.
    """
    levels, open_, done = [], t, None
    for depth in range(STEP, DEEPEST + 1, STEP):
        at = open_.withColumn("cell", _cell(depth)).withColumn("above", _cell(depth - STEP))
        whole = F.lit(True) if depth == DEEPEST else F.count(F.lit(1)) <= leaf
        level = stored.keep(at.groupBy("cell", "above").agg(F.count(F.lit(1)).alias("rows"), whole.alias("whole"), *_box(), F.min(F.struct(*AXES)).alias("one")))
        levels.append(level)
        # hot cells are split ones, of which there are at most rows / leaf; hot_join keeps their rows where they lie
        total, largest, split = level.agg(F.sum("rows"), F.max("rows"), F.count_if(~F.col("whole"))).first()
        marked = hot_join(at, level.select("cell", "whole", "rows"), ["cell"], "rows", seen=(total, largest))
        kept = marked.where("whole").select(*t.columns, "cell")
        done = kept if done is None else done.unionAll(kept)
        if not split:
            break
        open_ = stored.keep(marked.where("not whole").select(*t.columns))
    return done, levels


def _apart(axis: str) -> Column:
    """Between the boxes of a left and a right cell along an axis; 0 where they overlap."""
    return F.greatest(F.col(f"lo_{axis}") - F.col(f"l.hi_{axis}"), F.col(f"l.lo_{axis}") - F.col(f"hi_{axis}"), F.lit(0.0))


def _reach(axis: str) -> Column:
    """From the farther end of a left cell's box to the right cell's own position along an axis."""
    return F.greatest(F.abs(F.col(f"one.{axis}") - F.col(f"l.lo_{axis}")), F.abs(F.col(f"one.{axis}") - F.col(f"l.hi_{axis}")))


def _length(of) -> Column:
    return F.sqrt(sum((of(a) * of(a) for a in AXES[1:]), of(AXES[0]) * of(AXES[0])))


def nearest_in_tree(left: DataFrame, right: DataFrame, left_id: str, right_id: str, within: float | None = None, left_on=("ra", "dec"), right_on=("ra2", "dec2"), leaf: int = 32) -> DataFrame:
    """(left_id, right_id, sep): the nearest right row of each left row at any distance, or within a radius in degrees.

    Ties within 1e-9 degrees go to the smaller right id. Rows at one position
    are one entry of either tree. Rows without a position have no row, nor has any if right is empty.
    """
    spark = left.sparkSession
    stored = Stored(spark, "skytree")
    at = lambda t, on: t.where(F.col(on[0]).isNotNull() & F.col(on[1]).isNotNull() & ~F.isnan(on[0]) & ~F.isnan(on[1]))
    place = lambda on: [F.col(on[0]).cast("double").alias("ra"), F.col(on[1]).cast("double").alias("dec")]
    lefts = at(left, left_on).select(F.col(left_id).alias("_id"), *place(left_on))
    a = stored.keep(_placed(lefts.groupBy("ra", "dec").agg(F.count(F.lit(1)).alias("twins"))))
    b = stored.keep(_placed(at(right, right_on).select(F.col(right_id).alias("_other"), *place(right_on)).groupBy("ra", "dec").agg(F.min("_other").alias("_other"))))
    a, left_levels = tree(stored, a, leaf)
    b, levels = tree(stored, b, leaf)

    sides = [f"{e}_{x}" for x in AXES for e in ("lo", "hi")]
    cells = None
    for level in left_levels:
        whole = level.where("whole").select(F.struct("cell", "rows", *sides).alias("l"))
        cells = whole if cells is None else cells.unionAll(whole)
    farthest = 2.0 if within is None else 2 * math.sin(math.radians(min(within, 180.0)) / 2)
    top = levels[0].select("cell", "rows", "whole", *sides, "one").collect()  # the first level has at most 64 cells
    if not top:
        return spark.createDataFrame([], StructType([left.select(left_id).schema[0], right.select(right_id).schema[0], StructField("sep", DoubleType())]))
    first = F.array(*[F.struct(*[_literal(r[f]).alias(f) for f in r.__fields__]) for r in top])
    front = cells.withColumn("most", F.lit(farthest)).withColumn("c", F.explode(first)).select("l", "most", "c.*")
    waiting = None
    for depth in range(len(levels)):
        w = Window.partitionBy("l.cell")
        near = front.withColumn("apart", _length(_apart)).withColumn("most", F.least("most", F.min(_length(_reach)).over(w))).where(F.col("apart") <= F.col("most") + SLACK)
        near = stored.keep(near.select("l", "most", "cell", "rows", "whole", "apart"))
        ended = near.where("whole").select("l", "cell", "apart", "most")
        waiting = ended if waiting is None else waiting.unionAll(ended)
        if depth + 1 == len(levels):
            break
        below = levels[depth + 1].withColumnRenamed("cell", "sub").withColumn("cell", F.col("above")).drop("above")
        split = near.where("not whole").select("l", "most", "cell")
        front = split.join(below, "cell").drop("cell").withColumnRenamed("sub", "cell")
    # a bound found further down holds for the cells that waited
    bound = F.min("most").over(Window.partitionBy("l.cell"))
    pairs = stored.keep(waiting.withColumn("most", bound).where(F.col("apart") <= F.col("most") + SLACK).select(F.col("l.cell").alias("lcell"), "cell"))
    points = b.groupBy("cell").agg(F.collect_list(F.struct("_other", F.col("ra").alias("ra2"), F.col("dec").alias("dec2"))).alias("near"))  # whole cells only
    asked = pairs.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    met = hot_join(pairs, stored.keep(points.join(asked, "cell")), ["cell"], "n").select(F.col("lcell").alias("cell"), F.explode("near").alias("p"))
    found = a.join(met, "cell").select("ra", "dec", "p.*").withColumn("sep", ang_sep("ra", "dec", "ra2", "dec2"))
    if within is not None:
        found = found.where(F.col("sep") <= within)
    best = found.groupBy("ra", "dec").agg(F.min(F.struct(F.round("sep", 9).alias("s"), "_other", "sep")).alias("b"))
    best = stored.keep(best.join(a.select("ra", "dec", "twins"), ["ra", "dec"]).select("ra", "dec", "twins", F.col("b._other").alias(right_id), "b.sep"))
    return hot_join(lefts, best, ["ra", "dec"], "twins").select(F.col("_id").alias(left_id), right_id, "sep")


def _literal(v) -> Column:
    return F.struct(*[F.lit(x).alias(a) for a, x in zip(AXES, v, strict=True)]) if isinstance(v, tuple) else F.lit(v)
