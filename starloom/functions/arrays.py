"""Expressions on stamps: one array of pixels per row, masks as fixed index lists."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from starloom.functions.columns import C, col, flux_to_mag


def ring(side: int, low: float, high: float) -> list[int]:
    """Indices of the pixels of a square stamp whose distance from the centre is in [low, high)."""
    mid = (side - 1) / 2
    return [y * side + x for y in range(side) for x in range(side) if low <= ((x - mid) ** 2 + (y - mid) ** 2) ** 0.5 < high]


def pick(a: C, mask: Sequence[int]) -> Column:
    """The masked pixels as doubles."""
    return F.transform(F.array(*map(F.lit, mask)), lambda i: F.get(col(a), i).cast("double"))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.nullif(F.size(a), F.lit(0))


def median(a: Column) -> Column:
    """Median of the finite elements; null if there is none."""
    s = F.array_sort(F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x)))
    n = F.size(s)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also inside a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def mad(a: Column) -> Column:
    """Median absolute deviation."""
    return let(median(a), lambda m: median(F.transform(a, lambda x: F.abs(x - m))))


def bad_share(a: C) -> Column:
    """Share of pixels that are null, NaN or infinite."""
    n = F.size(col(a))
    bad = F.size(F.filter(col(a), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    return F.when(n > 0, bad / n)


def robust_norm(a: C, outer: Sequence[int], clip: float = 10.0) -> Column:
    """(x - median) / (1.4826 MAD) of the outer pixels, clipped; null where the MAD is 0."""
    o = pick(a, outer)

    def norm(z: Column) -> Column:
        scaled = F.transform(col(a), lambda x: (x.cast("double") - z["m"]) / F.nullif(z["s"], F.lit(0.0)))
        return F.transform(scaled, lambda x: F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(clip)), F.lit(-clip))))

    return let(F.struct(median(o).alias("m"), (mad(o) * 1.4826).alias("s")), norm)


def laplacian(a: C, side: int, mask: Sequence[int]) -> Column:
    """Mean absolute five-point Laplacian over mask pixels that have four neighbours."""
    inner = [i for i in mask if 0 < i % side < side - 1 and 0 < i // side < side - 1]
    at = lambda i: F.get(col(a), i).cast("double")
    return mean(F.transform(F.array(*map(F.lit, inner)), lambda i: F.abs(4 * at(i) - at(i - 1) - at(i + 1) - at(i - side) - at(i + side))))


def moments(a: C, side: int) -> Column:
    """struct(flux, x, y, axis_ratio, angle, half_radius, fallback): flux-weighted second moments of the positive pixels.

    angle is the major axis in degrees from the x axis, in (-90, 90];
    half_radius is the distance from the centre of light within which half of
    the flux lies. Without positive flux, fallback is true and the shape is round.
    """
    p = F.transform(col(a), lambda v: F.greatest(F.when(F.isnan(v.cast("double")), 0.0).otherwise(v.cast("double")), F.lit(0.0)))
    mid = (side - 1) / 2
    places = F.array(*[F.struct(F.lit(i % side - mid).alias("x"), F.lit(i // side - mid).alias("y")) for i in range(side * side)])

    def shape(z: Column) -> Column:
        pixels = F.zip_with(z, places, lambda v, q: F.struct(v.alias("v"), q["x"].alias("x"), q["y"].alias("y")))
        weigh = lambda f: F.aggregate(pixels, F.lit(0.0), lambda s, q: s + q["v"] * f(q))
        first = F.struct(F.nullif(total(z), F.lit(0.0)).alias("f"), weigh(lambda q: q["x"]).alias("x"), weigh(lambda q: q["y"]).alias("y"), weigh(lambda q: q["x"] * q["x"]).alias("xx"), weigh(lambda q: q["y"] * q["y"]).alias("yy"), weigh(lambda q: q["x"] * q["y"]).alias("xy"))

        def finish(m: Column) -> Column:
            f = m["f"]
            x, y = m["x"] / f, m["y"] / f
            xx, yy, xy = m["xx"] / f - x * x, m["yy"] / f - y * y, m["xy"] / f - x * y
            half, root = (xx + yy) / 2, F.sqrt(F.pow((xx - yy) / 2, F.lit(2.0)) + xy * xy)
            ratio = F.sqrt(F.greatest(half - root, F.lit(0.0)) / F.nullif(half + root, F.lit(0.0)))
            rings = F.array_sort(F.transform(pixels, lambda q: F.struct(F.round(F.sqrt((q["x"] - x) * (q["x"] - x) + (q["y"] - y) * (q["y"] - y)), 9).alias("r"), q["v"].alias("v"))))
            run = F.aggregate(rings, F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("r")), lambda s, q: F.struct((s["sum"] + q["v"]).alias("sum"), F.coalesce(s["r"], F.when(s["sum"] + q["v"] >= f / 2, q["r"])).alias("r")), lambda s: s["r"])
            none = f.isNull()
            return F.struct(F.coalesce(f, F.lit(0.0)).alias("flux"), x.alias("x"), y.alias("y"), F.when(none, F.lit(1.0)).otherwise(ratio).alias("axis_ratio"), F.when(none, F.lit(0.0)).otherwise(F.degrees(F.atan2(2 * xy, xx - yy) / 2)).alias("angle"), run.alias("half_radius"), none.alias("fallback"))

        return let(first, finish)

    return let(p, shape)


def quality(bands: dict[str, C], side: int, centre: float, core: float, limit: float = 0.02) -> Column:
    """struct(size, present, bad, bad_centre, bad_core, <band>_bad, ok) of a stamp with several bands.

    Shares of non-finite pixels over all bands, in the centre and core, and per
    band; ok if every band is there in full size and no share passes the limit.
    """
    n = side * side
    part = lambda mask: sum((F.coalesce(bad_share(pick(a, mask)), F.lit(1.0)) for a in bands.values()), F.lit(0.0)) / len(bands)
    whole = {b: F.coalesce(bad_share(a), F.lit(1.0)) for b, a in bands.items()}
    full = F.lit(True)
    for a in bands.values():
        full = full & F.coalesce(F.size(col(a)) == n, F.lit(False))
    every, middle, inner = sum(whole.values(), F.lit(0.0)) / len(bands), part(ring(side, 0, centre)), part(ring(side, 0, core))
    ok = full & (every <= limit) & (middle <= limit) & (inner <= limit)
    return F.struct(F.lit(n).alias("size"), full.alias("present"), every.alias("bad"), middle.alias("bad_centre"), inner.alias("bad_core"), *[w.alias(f"{b}_bad") for b, w in whole.items()], ok.alias("ok"))


def deviation(a: Column) -> Column:
    """Population standard deviation of an array's elements."""
    return let(mean(a), lambda m: F.sqrt(mean(F.transform(a, lambda x: (x - m) * (x - m)))))


def region_stats(a: C, masks: dict[str, Sequence[int]]) -> Column:
    """struct(<mask>_median, <mask>_max, <mask>_std) over each named mask."""
    out = []
    for name, mask in masks.items():
        x = pick(a, mask)
        out += [median(x).alias(f"{name}_median"), F.array_max(x).alias(f"{name}_max"), deviation(x).alias(f"{name}_std")]
    return F.struct(*out)


def masked_stats(x: Column) -> Column:
    """struct(n, median, max, std) of the pixels that a row's own mask leaves."""
    return let(x, lambda v: F.struct(F.size(v).cast("long").alias("n"), median(v).alias("median"), F.array_max(v).alias("max"), deviation(v).alias("std")))


def wedge(side: int, low: float, high: float, number: int, count: int) -> list[int]:
    """Indices of ring pixels in the ``number``-th of ``count`` equal wedges, counted from the x axis."""
    mid = (side - 1) / 2
    inside = lambda i: int(math.atan2(i // side - mid, i % side - mid) % (2 * math.pi) / (2 * math.pi) * count) % count == number
    return [i for i in ring(side, low, high) if inside(i)]


def profile(a: C, side: int, edges: Sequence[float], wedges: int = 4, most: float = 10.0) -> Column:
    """struct(radial, gradient, wedges, wedge_std, asymmetry): medians per ring, the mean step from ring to ring outwards, medians per wedge, their deviation, and that over the absolute mean of the wedges, at most ``most``."""
    rings = F.array(*[median(pick(a, ring(side, low, high))) for low, high in zip(edges[:-1], edges[1:], strict=True)])
    parts = F.array(*[median(pick(a, wedge(side, edges[0], edges[-1], k, wedges))) for k in range(wedges)])

    def finish(z: Column) -> Column:
        step = (F.element_at(z["r"], -1) - F.get(z["r"], 0)) / (len(edges) - 2)
        spread, level = deviation(z["w"]), F.abs(mean(z["w"]))
        return F.struct(z["r"].alias("radial"), step.alias("gradient"), z["w"].alias("wedges"), spread.alias("wedge_std"), F.least(spread / F.greatest(level, F.lit(1e-10)), F.lit(most)).alias("asymmetry"))

    return let(F.struct(rings.alias("r"), parts.alias("w")), finish)


def quantile(a: Column, p: float) -> Column:
    """Interpolated quantile of the finite elements."""
    def at(s: Column) -> Column:
        place = (F.size(s) - 1) * F.lit(float(p))
        low = F.floor(place).cast("int")
        x, y = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
        return F.when(F.size(s) > 0, x + (y - x) * (place - low))

    return let(F.array_sort(F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x))), at)


def norm_stats(a: C, side: int, clip: float = 10.0, edge: int = 1) -> Column:
    """struct(p1, p50, p99, mad, clip_share, edge_score) of a band.

    clip_share counts pixels more than clip * 1.4826 MAD from the median;
    edge_score is the distance of the border's median from the median, in those units.
    """
    x = F.transform(col(a), lambda v: v.cast("double"))
    border = [i for i in range(side * side) if min(i % side, i // side, side - 1 - i % side, side - 1 - i // side) < edge]

    def finish(z: Column) -> Column:
        unit = F.nullif(z["s"] * 1.4826, F.lit(0.0))
        over = F.size(F.filter(x, lambda v: F.abs(v - z["m"]) > clip * 1.4826 * z["s"])) / F.nullif(F.size(x), F.lit(0))
        return F.struct(quantile(x, 0.01).alias("p1"), z["m"].alias("p50"), quantile(x, 0.99).alias("p99"), z["s"].alias("mad"), over.alias("clip_share"), (F.abs(median(pick(a, border)) - z["m"]) / unit).alias("edge_score"))

    return let(F.struct(median(x).alias("m"), mad(x).alias("s")), finish)


def band_colors(bands: dict[str, C], pairs: Sequence[tuple[str, str]], core: Sequence[int], annulus: Sequence[int], zero_point: float = 22.5) -> Column:
    """struct(core_<b>_<r>, annulus_<b>_<r>, delta_<b>_<r>): magnitude differences of the bands' sums in core and annulus, and core minus annulus; null unless both sums are positive."""
    mag = lambda b, mask: flux_to_mag(total(pick(bands[b], mask)), zero_point)
    out = []
    for b, r in pairs:
        inner, outer = mag(b, core) - mag(r, core), mag(b, annulus) - mag(r, annulus)
        out += [inner.alias(f"core_{b}_{r}"), outer.alias(f"annulus_{b}_{r}"), (inner - outer).alias(f"delta_{b}_{r}")]
    return F.struct(*out)


def compare(a: C, b: C, tolerance: float) -> Column:
    """struct(same_size, same_gaps, max_diff, mean_diff, rmse, correlation, identical) of two arrays, over pixels that are finite in both.

    same_gaps says whether non-finite pixels lie at the same places.
    """
    both = F.zip_with(col(a), col(b), lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    gaps = ~F.exists(both, lambda z: odd(z["x"]) != odd(z["y"]))
    same = F.size(col(a)) == F.size(col(b))

    def stats(z: Column) -> Column:
        x, y = F.transform(z, lambda v: v["x"]), F.transform(z, lambda v: v["y"])
        d = F.transform(z, lambda v: F.abs(v["x"] - v["y"]))
        worst = F.array_max(d)

        def correlated(m: Column) -> Column:
            cross = lambda p, q: total(F.transform(z, lambda v: (v[p] - m[p]) * (v[q] - m[q])))
            return cross("x", "y") / F.nullif(F.sqrt(cross("x", "x") * cross("y", "y")), F.lit(0.0))

        r = let(F.struct(mean(x).alias("x"), mean(y).alias("y")), correlated)
        return F.struct(same.alias("same_size"), gaps.alias("same_gaps"), worst.alias("max_diff"), mean(d).alias("mean_diff"), F.sqrt(mean(F.transform(d, lambda v: v * v))).alias("rmse"), r.alias("correlation"), (same & gaps & (F.coalesce(worst, F.lit(0.0)) <= tolerance)).alias("identical"))

    return let(F.filter(both, lambda z: ~odd(z["x"]) & ~odd(z["y"])), stats)


def snr(signal: C, sigma: C) -> Column:
    """struct(peak, integrated): largest signal over sigma, and summed signal over the root of summed variances, over pixels with positive sigma."""
    pairs = F.filter(F.arrays_zip(col(signal).alias("s"), col(sigma).alias("e")), lambda z: z["e"] > 0)
    s = F.transform(pairs, lambda z: z["s"].cast("double"))
    e = F.transform(pairs, lambda z: z["e"].cast("double"))
    peak = F.array_max(F.zip_with(s, e, lambda x, y: x / y))
    return F.struct(peak.alias("peak"), (total(s) / F.nullif(F.sqrt(total(F.transform(e, lambda x: x * x))), F.lit(0.0))).alias("integrated"))


def annulus_snr(a: C, side: int, inner: tuple[float, float], outer: tuple[float, float], aperture: float = 2.0, tiers: Sequence[tuple[float, str]] = ((5.0, "A"), (2.0, "B"))) -> Column:
    """struct(snr, aperture_mean, aperture_max, tier): excess of the annulus over the outer median, over 1.4826 MAD sqrt(n), the central aperture, and the first tier whose bound the snr reaches (else C)."""
    x, o, centre = pick(a, ring(side, *inner)), pick(a, ring(side, *outer)), pick(a, ring(side, 0, aperture))
    n = len(ring(side, *inner))

    def finish(snr: Column) -> Column:
        tier = F.lit("C")
        for bound, name in reversed(tiers):
            tier = F.when(snr >= bound, F.lit(name)).otherwise(tier)
        return F.struct(snr.alias("snr"), mean(centre).alias("aperture_mean"), F.array_max(centre).alias("aperture_max"), tier.alias("tier"))

    return let((total(x) - n * median(o)) / F.nullif(mad(o) * 1.4826 * F.sqrt(F.lit(float(n))), F.lit(0.0)), finish)


def row_ring(a: C, side: int, low: Column, high: Column) -> Column:
    """Pixels whose distance from the centre lies between two columns."""
    mid = (side - 1) / 2
    radius = F.array(*[F.lit(((x - mid) ** 2 + (y - mid) ** 2) ** 0.5) for y in range(side) for x in range(side)])
    both = F.filter(F.arrays_zip(col(a).alias("v"), radius.alias("r")), lambda z: (z["r"] >= low) & (z["r"] < high))
    return F.transform(both, lambda z: z["v"].cast("double"))
