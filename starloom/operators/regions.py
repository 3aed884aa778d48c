"""Contiguous regions of sky tiles and their ranking."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from starloom.operators.sets import union_named
from starloom.operators.stored import Stored, hot_join
from starloom.operators.windows import numbered, stratified_topk, topk

log = logging.getLogger(__name__)


def adjacency(tiles: DataFrame, x: str, y: str, around: int) -> DataFrame:
    """(x, y, x2, y2): pairs of existing tiles that touch on a grid of ``around`` columns that wraps; one row per direction."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    near = tiles.select(x, y, F.explode(steps).alias("s")).select(x, y, F.pmod(F.col(x) + F.col("s.i"), F.lit(around)).alias("x2"), (F.col(y) + F.col("s.j")).alias("y2"))
    return near.join(tiles.select(F.col(x).alias("x2"), F.col(y).alias("y2")), ["x2", "y2"])


def adjacency_within(tiles: DataFrame, key: str, ra: str, dec: str, eps: float) -> DataFrame:
    """(a, b): pairs of tiles with |d dec| <= eps and |d ra| <= eps across ra = 0, in both directions.

    Tiles meet in buckets at least eps wide; one side is copied to the
    neighbouring buckets.
    """
    n = max(int(360 / eps), 1)
    bucket, band = F.floor(F.pmod(F.col(ra), F.lit(360.0)) * n / 360).cast("int"), F.floor(F.col(dec) / eps).cast("int")
    left = tiles.select(F.col(key).alias("a"), F.col(ra).alias("_ra1"), F.col(dec).alias("_dec1"), bucket.alias("_x"), band.alias("_y"))
    around = lambda c: F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), c)))
    right = tiles.select(F.col(key).alias("b"), F.col(ra).alias("_ra2"), F.col(dec).alias("_dec2"), bucket.alias("_bx"), band.alias("_by"))
    right = right.withColumn("_x", around(lambda s: F.pmod(F.col("_bx") + s, F.lit(n)))).withColumn("_y", around(lambda s: F.col("_by") + s))
    gap = F.abs(F.pmod(F.col("_ra1") - F.col("_ra2"), F.lit(360.0)))
    close = (F.least(gap, 360 - gap) <= eps) & (F.abs(F.col("_dec1") - F.col("_dec2")) <= eps)
    return left.join(right, ["_x", "_y"]).where(close & (F.col("a") != F.col("b"))).select("a", "b")


def degrees(tiles: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """tiles plus ``degree``: how many neighbours each has."""
    n = edges.groupBy(F.col("a").alias(key)).agg(F.count(F.lit(1)).alias("degree"))
    return tiles.join(n, key, "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def regions(tiles: DataFrame, key: str, ra: str, dec: str, eps: float) -> DataFrame:
    """(key, root, region_id) of each tile: contiguous regions numbered by their smallest tile.

    Tiles touch as in ``adjacency_within``, whose pairs grow with the square
    of the density and are not made here: all tiles of a cell half of eps
    wide touch, so regions are those of the cells. A tile without a position is a region.
    """
    stored = Stored(tiles.sparkSession, "regions")
    if eps > 45:  # a distance between cells would go both ways around
        roots = stored.keep(components(tiles.select(key), adjacency_within(tiles, key, ra, dec, eps).where("a < b"), key))
        return roots.join(region_ids(roots), "root").select(key, "root", "region_id")
    n, x, y = math.ceil(720 / eps), F.pmod(F.col(ra).cast("double"), F.lit(360.0)), F.col(dec).cast("double")
    x, known = F.when(x < 360, x).when(x < math.inf, 0.0), (x < math.inf) & (F.abs(y) < math.inf)
    cell = [F.when(known, F.least(F.floor(x * n / 360), F.lit(n - 1))).alias("_x"), F.when(known, F.floor(y * 2 / eps)).alias("_y")]
    t = stored.keep(tiles.select(key, x.alias("_ra"), y.alias("_dec"), *cell))
    placed, alone = t.where("_x IS NOT NULL"), t.where("_x IS NULL").select(F.col(key).alias("_tile"))
    cells = stored.keep(_cells(placed, key))
    roots = stored.keep(components(cells.select("_tile").unionAll(alone), _cell_links(cells, stored, n, eps), "_tile"))
    named = roots.join(region_ids(roots), "root")
    by_cell = stored.keep(cells.select("_x", "_y", "_n", "_tile").join(named, "_tile").drop("_tile"))
    out = hot_join(placed, by_cell, ["_x", "_y"], "_n").select(key, "root", "region_id")
    return out.unionAll(alone.join(named, "_tile").select(F.col("_tile").alias(key), "root", "region_id"))


def _cells(placed: DataFrame, key: str) -> DataFrame:
    """One row for each cell (_x, _y): its smallest tile, its tiles' number and ends, and its staircases.

    A staircase holds the tiles that no other one of the cell beats in both
    directions, such as ``right_up``: of larger ra and dec. They are sorted by ra.
    """
    lines = placed.groupBy("_x", "_y", "_ra").agg(F.min(key).alias("_tile"), F.count(F.lit(1)).alias("_n"), F.min("_dec").alias("d0"), F.max("_dec").alias("d1"))
    before = lambda o: Window.partitionBy("_x", "_y").orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
    steps = {}
    for side, o in (("left", F.asc("_ra")), ("right", F.desc("_ra"))):
        low, high = F.min("d0").over(before(o)), F.max("d1").over(before(o))
        steps |= {f"{side}_down": F.when(low.isNull() | (F.col("d0") < low), F.struct(F.col("_ra").alias("ra"), F.col("d0").alias("dec")))}
        steps |= {f"{side}_up": F.when(high.isNull() | (F.col("d1") > high), F.struct(F.col("_ra").alias("ra"), F.col("d1").alias("dec")))}
    ends = [F.min("_ra").alias("r0"), F.max("_ra").alias("r1"), F.min("d0").alias("d0"), F.max("d1").alias("d1")]
    return lines.withColumns(steps).groupBy("_x", "_y").agg(F.min("_tile").alias("_tile"), F.sum("_n").alias("_n"), *ends, *[F.array_sort(F.collect_list(s)).alias(s) for s in steps])


def _cell_links(cells: DataFrame, stored: Stored, n: int, eps: float) -> DataFrame:
    """(a, b): smallest tiles of two cells, of n around, that hold touching tiles; each pair of cells once.

    Such cells are at most three apart. Their nearest ends say no, or with the
    farthest ends of one direction yes; else the staircases that face each
    other are compared. Rounding keeps the order of differences, so all is as exact as comparing tiles.
    """
    gap = lambda p, q: F.abs(p - q)
    close_ra = lambda p, q: F.least(gap(p, q), 360 - gap(p, q)) <= eps
    close_dec = lambda p, q: gap(p, q) <= eps
    c = F.col
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k")) for i in range(4) for k in range(-3, 4) if i or k > 0])
    ends = cells.select("_x", "_y", "_tile", "r0", "r1", "d0", "d1")
    a = ends.select("*", F.explode(steps).alias("s")).withColumn("x2", F.pmod(c("_x") + c("s.i"), F.lit(n).cast("long"))).withColumn("y2", c("_y") + c("s.k"))
    b = ends.select(*[c(o).alias(w) for o, w in zip(ends.columns, ("x2", "y2", "b", "br0", "br1", "bd0", "bd1"), strict=True)])
    i, k = c("s.i"), c("s.k")
    near = ((i == 0) | close_ra(c("r1"), c("br0"))) & F.when(k == 0, True).when(k > 0, close_dec(c("d1"), c("bd0"))).otherwise(close_dec(c("d0"), c("bd1")))
    sure = (i == 0) | (k == 0) | close_ra(c("r0"), c("br1")) | F.when(k > 0, close_dec(c("d0"), c("bd1"))).otherwise(close_dec(c("d1"), c("bd0")))
    pairs = stored.keep(a.join(b, ["x2", "y2"]).where(near).select("_x", "_y", "x2", "y2", c("_tile").alias("a"), "b", (k > 0).alias("up"), sure.alias("sure")))

    def touch(p, q):
        """q's tiles in reach of one of p in ra are its first ones; the last of these is the nearest in dec. Their number is found bit by bit."""
        bits = F.array(*[F.lit(1 << s) for s in range(30, -1, -1)])

        def reached(u):
            return F.aggregate(bits, F.lit(0), lambda m, s: F.when(close_ra(u["ra"], F.get(q, m + s - 1)["ra"]), m + s).otherwise(m))

        return F.exists(p, lambda u: F.coalesce(close_dec(u["dec"], F.get(q, reached(u) - 1)["dec"]), F.lit(False)))

    right = cells.select("_x", "_y", "right_up", "right_down")
    left = cells.select(c("_x").alias("x2"), c("_y").alias("y2"), "left_up", "left_down")
    faced = pairs.where("NOT sure").join(right, ["_x", "_y"]).join(left, ["x2", "y2"])
    faced = faced.select("a", "b", F.when(c("up"), c("right_up")).otherwise(c("right_down")).alias("p"), F.when(c("up"), c("left_down")).otherwise(c("left_up")).alias("q"))
    return pairs.where("sure").select("a", "b").unionAll(faced.where(touch(c("p"), c("q"))).select("a", "b"))


def high_density_regions(tiles: DataFrame, key: str, density: str, ra: str, dec: str, eps: float, share: float = 0.9, accuracy: int | None = None) -> DataFrame:
    """(key, density, root, region_id) of the tiles at or above a quantile of the positive densities, with their regions."""
    some = F.when(F.col(density) > 0, F.col(density))
    edge = F.percentile(some, F.lit(share)) if accuracy is None else F.percentile_approx(some, share, accuracy)
    top = tiles.crossJoin(F.broadcast(tiles.agg(edge.alias("_edge")))).where(F.col(density) >= F.col("_edge")).drop("_edge")  # one row
    return top.select(key, density).join(regions(top, key, ra, dec, eps), key)


def parse_modes(text: str) -> list[tuple[str, int, int]]:
    """``mode:k_top:k_strat,...`` as tuples."""
    out = []
    for part in text.split(","):
        mode, top, strat = part.strip().split(":")
        out.append((mode, int(top), int(strat)))
    return out


def select_sets(df: DataFrame, modes: str, scores: dict[str, str], split: str, key: str, bin_: str, weights: Sequence[float], balanced: bool = True) -> DataFrame:
    """Labelled selections of every mode, one under another: the top k of each split, and per bin ceil(weight * k) of each split.

    scores: mode to score column. With ``balanced``, the stratified selection
    is repeated with equal weights.
    """
    parts = []
    named = lambda t, strategy, mode, k, score: t.select(F.lit(f"{strategy}_{mode}_k{k}").alias("selection_set_id"), F.lit(strategy).alias("selection_strategy"), F.lit(mode).alias("ranking_mode"), F.col(key), F.col(split), F.col("rank"), F.col(score).cast("double").alias("score"))
    for mode, top, strat in parse_modes(modes):
        score = scores[mode]
        if top:
            parts.append(named(topk(df, top, [split], score, key), "topk", mode, top, score))
        for name, w in (("custom", weights), ("balanced", [1 / len(weights)] * len(weights)))[: (2 if balanced else 1) if strat else 0]:
            quotas = {b: math.ceil(round(x * strat, 9)) for b, x in enumerate(w)}
            parts.append(named(stratified_topk(df, quotas, [split], bin_, score, key), f"strat_{name}", mode, strat, score))
    if not parts:
        raise ValueError("no mode selects anything")
    return union_named(*parts)


def parent_catalog(objects: DataFrame, tile_regions: DataFrame, selections: DataFrame, tile: str, region: str, flags: dict[str, Column], per_set: bool = False, most_tiles: int | None = None) -> DataFrame:
    """Objects of the selected regions with the cuts' flags: once each, or with ``per_set`` once for every selection that holds their region.

    tile_regions(tile, region) and selections(region, ...) are distinct rows.
    More than ``most_tiles`` selected tiles raise.
    """
    chosen = selections if per_set else selections.select(region).distinct()
    tiles = tile_regions.join(chosen, region)
    if most_tiles is not None and (n := tiles.select(tile).distinct().count()) > most_tiles:
        raise ValueError(f"{n} tiles are more than {most_tiles}")
    return objects.join(tiles, tile).withColumns(flags)


def _stars(most: int, schema: pa.Schema) -> Callable:
    """Links, ``most`` at a time, as links from each node to the smallest one that it reaches within those."""

    def contract(links: list[tuple]) -> pa.RecordBatch:
        up: dict = {}

        def top(x):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for a, b in links:
            up.setdefault(a, a), up.setdefault(b, b)
            a, b = top(a), top(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        ends = [(x, top(x)) for x in list(up)]
        return pa.RecordBatch.from_pydict({"u": [x for x, r in ends if x != r], "v": [r for x, r in ends if x != r]}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            if len(held) >= most:
                yield contract(held)
                held = []
        if held:
            yield contract(held)

    return run


def components(nodes: DataFrame, edges: DataFrame, node: str, most: int = 200_000) -> DataFrame:
    """(node, root): root is the smallest node that edges(a, b) can reach; one direction of each edge is enough.

    Rounds over a stored edge table. In each, tasks contract ``most`` links at
    a time to stars around the smallest node of their links. What is left beyond one such
    block goes through a large-star step (neighbours above a node are hung
    on its smallest neighbour) and a small-star step (those below it too), whose
    hubs are joined by broadcast of counted keys, so no task holds a hub. The
    rounds end when every node has one link, to a node that has none; each
    round's links are logged.
    """
    spark = nodes.sparkSession
    stored = Stored(spark, "components")
    links = edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    layout = links.schema
    stars = _stars(most, to_arrow_schema(layout))
    # keys compare in Spark's order, which is that of Python for numbers and texts
    e, turn = stored.keep(links.mapInArrow(stars, layout).distinct()), 0
    while True:
        n = e.count()
        log.info("components: round %d, %d links", turn, n)
        if n <= most:
            done = stored.keep(e.coalesce(1).mapInArrow(stars, layout))  # one block: its stars are the components
            break
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")))
        large = stored.keep(hot_join(both, low, ["u"], "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = stored.keep(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        small = hot_join(large, least, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        new = stored.keep(small.where("u <> v").mapInArrow(stars, layout).distinct())
        stored.drop(e, low, large, least)
        e, turn = new, turn + 1
        ends = e.select("u", F.lit(1).alias("links"), F.lit(0).alias("below")).unionAll(e.select("v", F.lit(0), F.lit(1)))
        if not ends.groupBy("u").agg(F.sum("links").alias("links"), F.max("below").alias("below")).where("links > 1 or links = 1 and below = 1").head(1):
            done = e
            break
    return nodes.select(node).join(done.select(F.col("u").alias(node), F.col("v").alias("_root")), node, "left").select(node, F.coalesce("_root", node).alias("root"))


def primary_backup(regions: DataFrame, area: str, score: str, key: str, low: float, high: float) -> DataFrame:
    """Best and second region inside the area window; if there is none, the three largest."""
    inside = F.col(area).between(low, high)
    a = regions.where(inside).orderBy(F.desc(score), key).limit(2).withColumn("role", F.lit("window"))
    none = regions.agg((F.count_if(inside) == 0).alias("_none"))
    b = regions.orderBy(F.desc(area), key).limit(3).withColumn("role", F.lit("largest"))
    return a.unionByName(b.crossJoin(none).where("_none").drop("_none"))  # one flag


def scores(df: DataFrame, density: str, area: str, psf: str, depth: str, ebv: str, alpha: float = 0.5) -> DataFrame:
    """Density, density * area^alpha, and density weighted by seeing, depth and extinction, each weight in [0, 1]."""
    unit = lambda x: F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)))
    w_psf = unit(F.exp(-(F.col(psf) - F.lit(1.2)) / F.lit(0.3)))
    w_depth = unit(F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col(depth) - F.lit(23.5)) / F.lit(0.3))))
    w_ebv = unit(F.exp(-F.col(ebv) / F.lit(0.1)))
    return df.withColumn("score_density", F.col(density).cast("double")).withColumn("score_area", F.col(density) * F.pow(F.col(area), F.lit(alpha))).withColumn("score_quality", F.col(density) * w_psf * w_depth * w_ebv)


def region_ids(roots: DataFrame) -> DataFrame:
    """(root, region_id): regions numbered from 1 by their smallest tile, by ranges."""
    return numbered(roots.select("root").distinct(), ["root"], "region_id")
