"""Joins of catalogs: by key, by bin, by rank and by distance on the sky.

Sky joins turn a radius into an equi join on cells: one side is copied to the
cells that its circle touches, so no pair beyond neighbours is made, also
across ra = 0 and near the poles. Searches for the nearest count the cells and leave
overfull ones to nested cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.columns import ang_sep, hash_uniform
from starloom.operators.skytree import nearest_in_tree
from starloom.operators.stored import Stored
from starloom.operators.windows import numbered


def left_meta(fact: DataFrame, meta: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join that keeps the fact's copy of columns that both sides have."""
    shared = [c for c in meta.columns if c in fact.columns and c not in on]
    return fact.join(meta.drop(*shared), list(on), "left")


def unique_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """df, after a check that no key comes twice."""
    twice = df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1)
    if twice:
        raise ValueError(f"keys repeat, for example {twice[0].asDict()}")
    return df


def fill_counts(df: DataFrame, counts: DataFrame, on: str, value: str, area: str | None = None, floor: float = 1e-6, one_to_one: bool = False) -> DataFrame:
    """Left join of counts with 0 where there is none; with ``area``, also a density over at least ``floor``. With ``one_to_one``, repeated keys on either side raise."""
    if one_to_one:
        unique_keys(df, [on]), unique_keys(counts, [on])
    out = df.join(counts, on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))
    return out.withColumn("density", F.col(value) / F.greatest(F.col(area), F.lit(floor))) if area else out


def grid_cross(df: DataFrame, grid: DataFrame, replicates: int = 1) -> DataFrame:
    """Every row with every configuration of a small stated grid and every replicate number."""
    g = grid.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return df.crossJoin(F.broadcast(g))  # the grid is a parameter table, not data


def modulo_assign(df: DataFrame, grid: DataFrame, key: str, order: str, seed: int = 0) -> DataFrame:
    """One configuration per row: the hash of its key modulo the number of configurations is the configuration's rank."""
    n = grid.count()
    ranked = grid.withColumn("_rank", F.row_number().over(Window.orderBy(order)) - 1)
    pick = F.floor(hash_uniform(key, seed) * n).cast("int")
    return df.withColumn("_rank", pick).join(F.broadcast(ranked), "_rank").drop("_rank")


def sky_cells(ra: Column, dec: Column, size: float) -> tuple[Column, Column]:
    """(band, cell) of a position in declination bands of ``size`` degrees with cells at least as wide on the sky."""
    band = F.floor((dec + 90) / size)
    return band, F.floor(F.pmod(ra, F.lit(360.0)) / (F.lit(360.0) / _cells(band, size)))


def _cells(band: Column, size: float) -> Column:
    """Cells around a band: as many as fit where the band is narrowest."""
    low, high = band * size - 90, (band + 1) * size - 90
    narrow = F.cos(F.radians(F.least(F.greatest(F.abs(low), F.abs(high)), F.lit(90.0))))
    return F.greatest(F.floor(F.lit(360.0 / size) * narrow), F.lit(1))


def _sky_sides(left: DataFrame, right: DataFrame, radius: float, left_on, right_on) -> tuple[DataFrame, DataFrame]:
    """left with its cell (_band, _cell), and right once for each cell around it."""
    size = max(radius, 1e-3)
    band, cell = sky_cells(F.col(left_on[0]), F.col(left_on[1]), size)
    a = left.withColumn("_band", band).withColumn("_cell", cell)
    near = right.withColumn("_band", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda s: F.floor((F.col(right_on[1]) + 90) / size) + s)))
    near = near.where(F.col("_band").between(0, int(180 / size))).withColumn("_n", _cells(F.col("_band"), size))
    home = F.floor(F.pmod(F.col(right_on[0]), F.lit(360.0)) / (F.lit(360.0) / F.col("_n")))
    steps = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda s: F.pmod(home + s, F.col("_n"))))
    return a, near.withColumn("_cell", F.explode(steps)).drop("_n")


def _sky_join(a: DataFrame, near: DataFrame, radius: float, left_on, right_on) -> DataFrame:
    sep = ang_sep(left_on[0], left_on[1], right_on[0], right_on[1])
    return a.join(near, ["_band", "_cell"]).withColumn("sep", sep).where(F.col("sep") <= radius).drop("_band", "_cell")


def sky_pairs(left: DataFrame, right: DataFrame, radius: float, left_on=("ra", "dec"), right_on=("ra2", "dec2")) -> DataFrame:
    """Pairs within ``radius`` degrees, with ``sep``. right is copied to the cells around it; its columns must differ from left's."""
    return _sky_join(*_sky_sides(left, right, radius, left_on, right_on), radius, left_on, right_on)


def _sky_split(left: DataFrame, right: DataFrame, radius: float, busy: int, left_on=("ra", "dec"), right_on=("ra2", "dec2")) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """(pairs of ordinary cells, rows of overfull ones): a cell whose rows would make more than ``busy`` pairs goes to nested cells."""
    a, near = _sky_sides(left, right, radius, left_on, right_on)
    cell = ["_band", "_cell"]
    rows = lambda t, n: t.groupBy(*cell).agg(F.count(F.lit(1)).alias(n))
    over = rows(a, "_a").join(rows(near, "_b"), cell).where(F.col("_a") * F.col("_b") > busy).select(*cell)
    if not over.head(1):
        return _sky_join(a, near, radius, left_on, right_on), None
    over = Stored(left.sparkSession, "overfull").keep(over)
    calm = _sky_join(a.join(over, cell, "left_anti"), near.join(over, cell, "left_anti"), radius, left_on, right_on)
    return calm, (a.join(over, cell, "left_semi").drop(*cell), near.join(over, cell, "left_semi").drop(*cell).distinct())


def nearest(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, busy: int = 10_000_000, **on) -> DataFrame:
    """The nearest right row of each left row within the radius; ties to the smaller id. Ids are unique on either side.

    Cells are counted first; those of more than ``busy`` pairs, such as a
    cluster inside one radius, are searched by nested cells in place of all pairs.
    """
    pairs, dense = _sky_split(left, right, radius, busy, **on)
    w = Window.partitionBy(left_id).orderBy(F.round("sep", 9), right_id)
    out = pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    if dense:
        found = nearest_in_tree(*dense, left_id, right_id, within=radius, **on)
        out = out.unionByName(dense[0].join(found, left_id).join(dense[1], right_id).select(*out.columns))
    return out


def _near_ids(left: DataFrame, right: DataFrame, radius: float, left_id: str, busy: int, **on) -> DataFrame:
    """Distinct ids of left rows with a right row within the radius."""
    pairs, dense = _sky_split(left, right, radius, busy, **on)
    hits = pairs.select(left_id)
    if dense:
        hits = hits.unionAll(nearest_in_tree(dense[0], dense[1].withColumn("_any", F.lit(0)), left_id, "_any", within=radius, **on).select(left_id))
    return hits.distinct()


def near_flag(left: DataFrame, right: DataFrame, radius: float, left_id: str, busy: int = 10_000_000, **on) -> DataFrame:
    """left plus ``near``: whether any right row lies within the radius."""
    hits = _near_ids(left, right, radius, left_id, busy, **on).withColumn("near", F.lit(True))
    return left.join(hits, left_id, "left").withColumn("near", F.coalesce("near", F.lit(False)))


def away(left: DataFrame, right: DataFrame, radius: float, left_id: str, busy: int = 10_000_000, **on) -> DataFrame:
    """left rows with no right row within the radius."""
    return left.join(_near_ids(left, right, radius, left_id, busy, **on), left_id, "left_anti")


def bin_swap(controls: DataFrame, pool: DataFrame, bins: Sequence[str], key: str, pool_key: str, share: float, seed: int = 5) -> DataFrame:
    """controls plus ``swapped``: for a share of them, another target of the same bin, paired by hash order in the bin."""
    placed = lambda t, k: numbered(t.select(*bins, k, hash_uniform(k, seed).alias("_u")), [*bins, "_u", k], "_rn", bins)
    chosen = placed(controls.where(hash_uniform(key, seed + 1) < share), key)
    other = placed(pool, pool_key).select(*bins, "_rn", F.col(pool_key).alias("swapped"))
    got = chosen.join(other, [*bins, "_rn"], "left").select(key, "swapped")
    return controls.join(got, key, "left")


def pool_match(wanted: DataFrame, pool: DataFrame, bins: Sequence[str], key: str, seed: int = 9) -> DataFrame:
    """From the pool, as many rows per bin as ``wanted`` has; drawn again and again in hash order if the bin is short (``draw`` numbers them)."""
    need = wanted.groupBy(*bins).agg(F.count(F.lit(1)).alias("_need"))
    have = numbered(pool.withColumn("_u", hash_uniform(key, seed)), [*bins, "_u", key], "_i", bins).drop("_u").withColumn("_i", F.col("_i") - 1)
    size = pool.groupBy(*bins).agg(F.count(F.lit(1)).alias("_size"))
    j = have.join(need, list(bins)).join(size, list(bins)).where("_i < _need")
    turns = F.sequence(F.lit(0), F.floor((F.col("_need") - 1 - F.col("_i")) / F.col("_size")))
    return j.withColumn("draw", F.explode(turns)).withColumn("draw", F.col("draw").cast("int")).drop("_i", "_need", "_size")


def latest(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first in the given total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def region_map(fact: DataFrame, key: str, *maps: tuple[DataFrame, str, str]) -> DataFrame:
    """fact through a chain of small maps: each is (table, its key, the column that leads on); rows without a match go.

    The chain is joined among its small tables first, so the fact is shuffled or
    probed once.
    """
    place, first, on = maps[0]
    for table, k, nxt in maps[1:]:
        place = place.join(table, F.col(on) == F.col(k))
        on = nxt
    return fact.join(place, F.col(key) == F.col(first))


def nested(df: DataFrame, by: Sequence[str], fields: Sequence[str], name: str = "items") -> DataFrame:
    """One row per key with the sorted distinct structs of the fields; for small selection tables."""
    return df.groupBy(*by).agg(F.sort_array(F.collect_set(F.struct(*fields))).alias(name))


def expand(fact: DataFrame, lists: DataFrame, on: Sequence[str], name: str = "items") -> DataFrame:
    """fact once for every struct in its key's list, whose fields become columns."""
    return fact.join(lists, list(on)).withColumn("_x", F.explode(name)).select(*fact.columns, "_x.*")


def in_boxes(points: DataFrame, boxes: DataFrame, size: float, positions: tuple[str, str] = ("ra", "dec")) -> DataFrame:
    """Points with every box (ra1, ra2, dec1, dec2, ra1 < ra2 <= 360) that holds them; lower edges count, upper ones don't.

    Boxes are copied to the cells of ``size`` degrees that they touch, so the
    join is on cells.
    """
    cells = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size)))
    b = boxes.withColumn("_x", cells("ra1", "ra2")).withColumn("_y", cells("dec1", "dec2"))
    x, y = F.pmod(F.col(positions[0]), F.lit(360.0)), F.col(positions[1])
    a = points.withColumn("_x", F.floor(x / size)).withColumn("_y", F.floor(y / size))
    return a.join(b, ["_x", "_y"]).where((x >= F.col("ra1")) & (x < F.col("ra2")) & (y >= F.col("dec1")) & (y < F.col("dec2"))).drop("_x", "_y")


def footprint(points: DataFrame, centres: DataFrame, radius: float, key: str, centre: str, **on) -> DataFrame:
    """Points with a tile centre within the radius: the nearest one, its distance and how many there are."""
    p = sky_pairs(points, centres, radius, **on)
    return p.groupBy(key).agg(F.count_distinct(centre).alias("n_tiles"), F.min_by(centre, F.struct(F.round("sep", 9), F.col(centre))).alias("tile"), F.min("sep").alias("nearest"))


def condition_delta(a: DataFrame, b: DataFrame, on: Sequence[str], score: str) -> DataFrame:
    """(on, a, b, delta): the scores of two conditions of the same rows; keys are unique on each side."""
    return a.select(*on, F.col(score).alias("a")).join(b.select(*on, F.col(score).alias("b")), list(on)).withColumn("delta", F.col("b") - F.col("a"))


def common_cells(a: DataFrame, b: DataFrame, cells: Sequence[str], value: str) -> DataFrame:
    """(cells, v1, v2, delta, side): two grids on their cells; side says whether a cell is common or only in one."""
    x, y = a.select(*cells, F.col(value).alias("v1"), F.lit(True).alias("_a")), b.select(*cells, F.col(value).alias("v2"), F.lit(True).alias("_b"))
    side = F.when(F.col("_b").isNull(), "first").when(F.col("_a").isNull(), "second").otherwise("common")
    return x.join(y, list(cells), "full").select(*cells, "v1", "v2", (F.col("v2") - F.col("v1")).alias("delta"), side.alias("side"))


def undone(df: DataFrame, ledger: DataFrame, on: Sequence[str], status: str = "status", ok: str = "OK") -> DataFrame:
    """Rows whose key the ledger doesn't list as done; keys done several times count once."""
    return df.join(ledger.where(F.col(status) == ok).select(*on).distinct(), list(on), "left_anti")


def without_blocked(frames: dict[str, DataFrame], blocked: DataFrame, on: str) -> dict[str, DataFrame]:
    """Each table less the rows of blocked keys."""
    keys = blocked.select(on).distinct()
    return {name: f.join(keys, on, "left_anti") for name, f in frames.items()}


def split_flagged(df: DataFrame, flagged: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that aren't flagged, rows that are)."""
    keys = flagged.select(*on).distinct()
    return df.join(keys, list(on), "left_anti"), df.join(keys, list(on), "left_semi")


def position_lookup(df: DataFrame, table: DataFrame, size: float, positions: tuple[str, str] = ("ra", "dec")) -> DataFrame:
    """df with the columns of a table whose rounded position is the same, in cells of ``size`` degrees; other rows go."""
    cell = lambda t: t.withColumn("_x", F.round(F.col(positions[0]) / size)).withColumn("_y", F.round(F.col(positions[1]) / size))
    return cell(df).join(cell(table).drop(*positions), ["_x", "_y"]).drop("_x", "_y")


def grid_interpolate(df: DataFrame, grid: DataFrame, x: str, y: str, x0: float, dx: float, y0: float, dy: float, value: str = "value") -> DataFrame:
    """df plus ``interpolated``: bilinear value of a surface (ix, iy, value) on an even grid; 0 outside.

    A grid of up to 100,000 cells is broadcast, a larger one is shuffled.
    """
    small = F.broadcast if grid.count() <= 100_000 else (lambda g: g)
    fx, fy = (F.col(x) - x0) / dx, (F.col(y) - y0) / dy
    t = df.withColumn("_ix", F.floor(fx)).withColumn("_iy", F.floor(fy)).withColumn("_tx", fx - F.floor(fx)).withColumn("_ty", fy - F.floor(fy))
    sides = [(i, k) for i in (0, 1) for k in (0, 1)]
    # every grid point is a corner of four cells; a cell's corners are one row, so df is joined once
    corner = F.explode(F.array(*[F.struct((F.col("ix") - i).alias("_ix"), (F.col("iy") - k).alias("_iy"), F.lit(f"_v{i}{k}").alias("c")) for i, k in sides])).alias("s")
    cells = grid.select(F.col(value).alias("_v"), corner).groupBy("s._ix", "s._iy").agg(*[F.max(F.when(F.col("s.c") == f"_v{i}{k}", F.col("_v"))).alias(f"_v{i}{k}") for i, k in sides])
    t, total = t.join(small(cells), ["_ix", "_iy"], "left"), F.lit(0.0)
    for i, k in sides:
        wx = F.col("_tx") if i else 1 - F.col("_tx")
        wy = F.col("_ty") if k else 1 - F.col("_ty")
        total = total + wx * wy * F.coalesce(F.col(f"_v{i}{k}"), F.lit(0.0))
    return t.withColumn("interpolated", total).select(*df.columns, "interpolated")
