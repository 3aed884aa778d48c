"""Column expressions for catalogs: photometry, masks, classes, hashes and identifiers.

Every function takes columns (or their names) and returns a Column made of
built-in functions, so it stays inside generated code and pushes down.
Missing values may be null or NaN; each function says what it does with them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = Column | str


def col(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: C) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    x = col(x).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))


def flux_to_mag(flux: C, zero_point: float = 22.5) -> Column:
    """Magnitude of a flux; null unless the flux is a positive number."""
    f = col(flux).cast("double")
    return F.when(finite(f) & (f > 0), F.lit(zero_point) - F.lit(2.5) * F.log10(f))


def mag_to_flux(mag: C, zero_point: float = 22.5) -> Column:
    m = col(mag).cast("double")
    return F.when(finite(m), F.pow(F.lit(10.0), F.lit(-0.4) * (m - F.lit(zero_point))))


def deredden(flux: C, transmission: C) -> Column:
    """Flux over transmission; null where the transmission is zero or not a number."""
    t = col(transmission).cast("double")
    return F.when(finite(t) & (t != 0), col(flux).cast("double") / F.when(t != 0, t))


def color(blue: C, red: C) -> Column:
    return col(blue) - col(red)


def depth_to_mag5(inverse_variance: C) -> Column:
    """Magnitude of a five-sigma source; null unless the inverse variance is positive."""
    d = col(inverse_variance).cast("double")
    return F.when(finite(d) & (d > 0), F.lit(22.5) - F.lit(2.5) * F.log10(F.lit(5.0) / F.sqrt(d)))


def variant_flags(z: C, rz: C, zw: C, cuts: dict[str, tuple[float, float, float]]) -> list[Column]:
    """One boolean per named cut (faintest z, least r-z, least z-W1); false where any of the three is missing."""
    ok = finite(z) & finite(rz) & finite(zw)
    return [(ok & (col(z) < a) & (col(rz) > b) & (col(zw) > c)).alias(name) for name, (a, b, c) in cuts.items()]


def within(bounds: dict[str, tuple[float | None, float | None]]) -> Column:
    """Conjunction of low <= column <= high; a bound of None is open."""
    out = F.lit(True)
    for name, (low, high) in bounds.items():
        if low is not None:
            out = out & (F.col(name) >= F.lit(low))
        if high is not None:
            out = out & (F.col(name) <= F.lit(high))
    return out


def bits(positions: Sequence[int]) -> int:
    return sum(1 << b for b in positions)


def clean_mask(mask: C, positions: Sequence[int]) -> Column:
    """True where none of the bits is set."""
    return col(mask).bitwiseAND(F.lit(bits(positions))) == 0


def masked_fraction(array: C, positions: Sequence[int]) -> Column:
    """Share of array elements with any of the bits set; null for an empty array."""
    m = bits(positions)
    n = F.size(col(array))
    return F.when(n > 0, F.size(F.filter(col(array), lambda x: x.bitwiseAND(F.lit(m)) != 0)) / n)


def clean_type(text: C, known: Sequence[str], drop: Sequence[str] = ("PSF",), other: str = "OTHER") -> Column:
    """Trimmed upper-case class; null for dropped classes, ``other`` for unknown ones."""
    t = F.upper(F.trim(col(text)))
    return F.when(t.isin(*drop), None).when(t.isin(*known), t).when(t.isNotNull(), F.lit(other))


def range_label(value: C, ranges: Sequence[tuple[int, int | None, str]], other: str = "invalid") -> Column:
    out = F.lit(other)
    for low, high, label in reversed(ranges):
        hit = col(value) >= low
        out = F.when(hit if high is None else hit & (col(value) <= high), F.lit(label)).otherwise(out)
    return out


def edge_bucket(value: C, edges: Sequence[float]) -> Column:
    """Index of the bin that holds the value; the last bin also takes its right edge and all that lies outside."""
    last = len(edges) - 2
    out = F.lit(last)
    for i in range(last - 1, -1, -1):
        out = F.when((col(value) >= edges[i]) & (col(value) < edges[i + 1]), F.lit(i)).otherwise(out)
    return out


def round_to(value: C, step: float) -> Column:
    return F.round(col(value) / F.lit(step)) * F.lit(step)


def digitize(value: C, first: float, step: float, count: int) -> Column:
    """Index of the bin around evenly spaced centres; -1 outside."""
    i = F.floor((col(value) - F.lit(first - step / 2)) / F.lit(step))
    return F.when((i >= 0) & (i < count), i).otherwise(-1).cast("int")


def snap(value: C, grid: Sequence[float]) -> Column:
    """Nearest grid value, the smaller at a tie."""
    g = F.array(*[F.lit(float(x)) for x in grid])
    return F.array_min(F.transform(g, lambda x: F.struct(F.round(F.abs(col(value) - x), 9).alias("d"), x.alias("x"))))["x"]


def first_match(rules: Sequence[tuple[str, Column]], default: str | None = None) -> Column:
    """Name of the first rule that holds."""
    out = F.lit(default).cast("string")
    for name, cond in reversed(rules):
        out = F.when(cond, F.lit(name)).otherwise(out)
    return out


def lookup(value: C, table: dict[str, float], default: float | None = None) -> Column:
    """Value of a small fixed table."""
    out = F.lit(default).cast("double")
    for k, v in reversed(list(table.items())):
        out = F.when(col(value) == F.lit(k), F.lit(float(v))).otherwise(out)
    return out


def tile_name(ra: C, dec: C) -> Column:
    """Ten arc-minute style tile name of a position: rrrr, p or m, ddd, in tenths of degrees."""
    return F.concat(F.lpad(F.floor(col(ra) * 10).cast("string"), 4, "0"), F.when(col(dec) >= 0, "p").otherwise("m"), F.lpad(F.floor(F.abs(col(dec)) * 10).cast("string"), 3, "0"))


def is_tile_name(name: C) -> Column:
    return F.rlike(col(name), F.lit(r"^[0-9]{4}[pm][0-9]{3}$"))


def tile_centre(name: C) -> tuple[Column, Column]:
    """Approximate (ra, dec) of a tile name."""
    n = col(name)
    ra = F.substring(n, 1, 4).cast("double") / 10
    dec = F.substring(n, 6, 3).cast("double") / 10
    return ra, F.when(F.substring(n, 5, 1) == "p", dec).otherwise(-dec)


def block_file(ra: C, dec: C, width: int = 5) -> Column:
    """Name of the width-degree block file that holds a position: sweep-RRRsDDD-RRRsDDD."""

    def signed(d: Column) -> Column:
        return F.concat(F.when(d >= 0, "p").otherwise("m"), F.lpad(F.abs(d).cast("string"), 3, "0"))

    r, d = (F.floor(col(ra) / width) * width).cast("int"), (F.floor(col(dec) / width) * width).cast("int")
    three = lambda x: F.lpad(x.cast("string"), 3, "0")
    return F.concat(F.lit("sweep-"), three(r), signed(d), F.lit("-"), three(r + width), signed(d + width))


def block_bounds(name: C) -> list[Column]:
    """ra1, dec1, ra2, dec2 out of a block file name."""
    pattern = r"sweep-([0-9]{3})([pm])([0-9]{3})-([0-9]{3})([pm])([0-9]{3})"
    part = lambda i: F.regexp_extract(col(name), pattern, i)
    dec = lambda i: F.when(part(i) == "m", -part(i + 1).cast("int")).otherwise(part(i + 1).cast("int"))
    return [part(1).cast("int").alias("ra1"), dec(2).alias("dec1"), part(4).cast("int").alias("ra2"), dec(5).alias("dec2")]


def first_with_prefix(text: C, prefix: str, separator: str = "|") -> Column:
    """First trimmed item of a separated list that begins with the prefix; null if none does."""
    items = F.transform(F.split(col(text), "\\" + separator), lambda x: F.trim(x))
    return F.get(F.filter(items, lambda x: F.startswith(x, F.lit(prefix))), F.lit(0))


def first_number(text: C, separator: str = "|") -> Column:
    """First item of a separated list that is a number once question marks are stripped; null if none is."""
    items = F.split(col(text), "\\" + separator)
    numbers = F.filter(items, lambda x: F.rlike(F.trim(F.translate(x, "?", "")), F.lit(r"^[+-]?[0-9]+(\.[0-9]+)?$")))
    return F.trim(F.translate(F.get(numbers, F.lit(0)), "?", "")).cast("double")


def box_area(ra1: C, ra2: C, dec1: C, dec2: C) -> Column:
    """Square degrees of a box; ra2 below ra1 wraps through zero."""
    width = F.when(col(ra2) < col(ra1), col(ra2) - col(ra1) + 360).otherwise(col(ra2) - col(ra1))
    return width * (F.sin(F.radians(col(dec2))) - F.sin(F.radians(col(dec1)))) * F.lit(180.0 / math.pi)


def hash_uniform(key: C | Sequence[C], seed: int | str) -> Column:
    """Uniform in [0, 1) that depends on the key's text and the seed only."""
    keys = [key] if isinstance(key, str | Column) else list(key)
    text = F.concat_ws("_", *[col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_normal(key: C, seed: int, clip: float = 3.0) -> Column:
    """Standard normal from two hash uniforms, clipped."""
    u1, u2 = F.greatest(hash_uniform(key, seed), F.lit(1e-12)), hash_uniform(key, seed + 1)
    z = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)
    return F.greatest(F.least(z, F.lit(clip)), F.lit(-clip))


def frozen_draws(key: C, control: C, radius: float = 1.0, salt: int = 101) -> list[Column]:
    """Ten draws per task that never change: an offset in a disc, angles, colours, shapes and sizes; zero for controls."""
    u = [hash_uniform(key, salt + i) for i in range(10)]
    on = ~col(control)
    values = {
        "dx": F.sqrt(u[0]) * F.cos(F.lit(2 * math.pi) * u[1]) * F.lit(radius),
        "dy": F.sqrt(u[0]) * F.sin(F.lit(2 * math.pi) * u[1]) * F.lit(radius),
        "angle": u[2] * F.lit(math.pi),
        "shear_angle": u[3] * F.lit(math.pi),
        "gr": F.lit(0.2) + u[4] * F.lit(0.6),
        "rz": F.lit(0.1) + u[5] * F.lit(0.4),
        "ellipticity": u[6] * F.lit(0.6),
        "index": F.lit(0.5) + u[7] * F.lit(3.5),
        "size": F.lit(0.1) + u[8] * F.lit(0.9),
        "phase": u[9],
    }
    return [F.when(on, v).otherwise(F.lit(0.0)).alias(k) for k, v in values.items()]


def content_id(fields: Sequence[C], separator: str = "|", missing: str = "NULL") -> Column:
    """SHA-256 of the fields' text."""
    return F.sha2(F.concat_ws(separator, *[F.coalesce(col(f).cast("string"), F.lit(missing)) for f in fields]), 256)


def content_md5(fields: Sequence[C], seed: int, separator: str = "||", missing: str = "NULL") -> Column:
    """MD5 of the fields' text and a seed."""
    return F.md5(F.concat_ws(separator, *[F.coalesce(col(f).cast("string"), F.lit(missing)) for f in fields], F.lit(str(seed))))


def compose_id(*parts: C, separator: str = "_") -> Column:
    """The parts' text joined; null if one of them is."""
    return F.concat(*[x for i, p in enumerate(parts) for x in ([F.lit(separator)] if i else []) + [col(p).cast("string")]])


def with_provenance(df: DataFrame, constants: dict[str, str], file: str | None = None) -> DataFrame:
    """df plus constant text columns and, for tables read from files, the name of each row's file."""
    out = df.withColumns({k: F.lit(v) for k, v in constants.items()})
    return out.withColumn(file, F.element_at(F.split("_metadata.file_path", "/"), -1)) if file else out


def ang_sep(ra1: C, dec1: C, ra2: C, dec2: C) -> Column:
    """Great-circle separation in degrees by the haversine formula."""
    d1, d2 = F.radians(col(dec1)), F.radians(col(dec2))
    h = F.pow(F.sin((d2 - d1) / 2), 2) + F.cos(d1) * F.cos(d2) * F.pow(F.sin(F.radians(col(ra2) - col(ra1)) / 2), 2)
    return F.when(h.isNotNull(), F.degrees(F.lit(2.0) * F.asin(F.least(F.sqrt(h), F.lit(1.0)))))


def inclination(axis_ratio: C) -> Column:
    """Degrees from the axis ratio, which is held within [0.01, 1]; null stays null."""
    return F.when(col(axis_ratio).isNotNull(), F.degrees(F.acos(F.greatest(F.least(col(axis_ratio), F.lit(1.0)), F.lit(0.01)))))


def prevalence_shift(p: C, old: float, new: float) -> Column:
    """Posterior after the class share moves from old to new."""
    ratio = (new / (1 - new)) / (old / (1 - old))
    x = F.when(col(p).isNotNull(), F.greatest(F.least(col(p), F.lit(1 - 1e-9)), F.lit(1e-9)))
    odds = x / (F.lit(1.0) - x) * F.lit(ratio)
    return odds / (F.lit(1.0) + odds)


def notes(rules: Sequence[tuple[str, Column]]) -> tuple[Column, Column]:
    """(valid, warnings): texts of all rules that hold, joined."""
    text = F.concat_ws("; ", *[F.when(cond, F.lit(name)) for name, cond in rules])
    return (text == ""), text


def healpix_nested(ra: C, dec: C, nside: int) -> Column:
    """Nested equal-area cell (Gorski et al. 2005) of a position in degrees; nside is a power of two."""
    order = nside.bit_length() - 1
    z = F.sin(F.radians(col(dec)))
    t = F.pmod(col(ra).cast("double"), F.lit(360.0)) / F.lit(90.0)
    n = F.lit(float(nside))
    a, b = n * (F.lit(0.5) + t), n * z * F.lit(0.75)
    jp, jm = F.floor(a - b), F.floor(a + b)
    fp, fm = F.floor(jp / nside), F.floor(jm / nside)
    face = F.when(fp == fm, fp.bitwiseAND(F.lit(3)) + 4).when(fp < fm, fp.bitwiseAND(F.lit(3))).otherwise(fm.bitwiseAND(F.lit(3)) + 8)
    ix, iy = jm.bitwiseAND(F.lit(nside - 1)), F.lit(nside - 1) - jp.bitwiseAND(F.lit(nside - 1))
    q = F.least(F.lit(3), F.floor(t))
    p, s = t - q, n * F.sqrt(F.lit(3.0) * (F.lit(1.0) - F.abs(z)))
    kp, km = F.least(F.floor(p * s), F.lit(nside - 1)), F.least(F.floor((F.lit(1.0) - p) * s), F.lit(nside - 1))
    north = z >= 0
    equator = F.abs(z) <= F.lit(2.0 / 3.0)
    face = F.when(equator, face).when(north, q).otherwise(q + 8)
    ix = F.when(equator, ix).when(north, F.lit(nside - 1) - km).otherwise(kp)
    iy = F.when(equator, iy).when(north, F.lit(nside - 1) - kp).otherwise(km)
    pix = face * (nside * nside)
    for i in range(order):
        pix = pix + F.shiftleft(F.shiftright(ix, i).bitwiseAND(F.lit(1)), 2 * i) + F.shiftleft(F.shiftright(iy, i).bitwiseAND(F.lit(1)), 2 * i + 1)
    return pix.cast("long")
