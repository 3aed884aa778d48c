"""Classes of objects from ordered rules: confusers by shape and colour, and graded selections with reasons."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from starloom.functions.columns import C, col, first_match

# Default thresholds of the confuser classes.
CONFUSERS: dict[str, dict] = {
    "ring_proxy": {"types": ("DEV", "SER"), "flux_r_min": 5.0, "sersic_min": 4.0},
    "edge_on_proxy": {"types": ("EXP", "SER", "DEV"), "ellipticity_min": 0.5, "shape_r_min": 0.6, "shape_r_min_legacy": 1.8},
    "blue_clumpy_proxy": {"g_minus_r_max": 0.4, "r_mag_max": 20.5},
    "large_galaxy_proxy": {"shape_r_min": 2.0, "flux_r_min": 3.0},
}


def confuser_class(kind: C, flux_r: C, shape_r: C, g_minus_r: C, mag_r: C, ellipticity: C | None = None, sersic: C | None = None, thresholds: dict[str, dict] | None = None) -> Column:
    """The first class that fits: ring_proxy, edge_on_proxy, blue_clumpy, large_galaxy; else null. thresholds change single defaults.

    A missing value fits no bound. Without an ellipticity a larger radius stands in for it.
    """
    t = {k: v | (thresholds or {}).get(k, {}) for k, v in CONFUSERS.items()}
    ring, edge, blue, large = t["ring_proxy"], t["edge_on_proxy"], t["blue_clumpy_proxy"], t["large_galaxy_proxy"]
    name = F.upper(F.trim(col(kind)))
    null = F.lit(None).cast("double")
    ell, index, radius = null if ellipticity is None else col(ellipticity), null if sersic is None else col(sersic), col(shape_r)
    steep = (name == "DEV") | ((name == "SER") & (index >= ring["sersic_min"]))
    long = ((ell >= edge["ellipticity_min"]) & (radius >= edge["shape_r_min"])) | (ell.isNull() & (radius >= edge["shape_r_min_legacy"]))
    rules = [
        ("ring_proxy", name.isin(*ring["types"]) & (col(flux_r) >= ring["flux_r_min"]) & steep),
        ("edge_on_proxy", name.isin(*edge["types"]) & long),
        ("blue_clumpy", (col(g_minus_r) <= blue["g_minus_r_max"]) & (col(mag_r) <= blue["r_mag_max"])),
        ("large_galaxy", (radius >= large["shape_r_min"]) & (col(flux_r) >= large["flux_r_min"])),
    ]
    return first_match([(n, F.coalesce(c, F.lit(False))) for n, c in rules])


class Check(NamedTuple):
    name: str
    value: Column
    passed: Column
    #: What a missing value does: exclude, second (tier) or pass.
    missing: str = "exclude"


def graded(checks: Sequence[Check], first: str = "A", second: str = "B") -> Column:
    """struct(passed, reason, tier): the first check that is not met names the reason with its value.

    Rows that meet all checks are of the first tier, others of the second; a
    missing value excludes (no tier), gives the second tier or passes, as its
    check says.
    """
    result = lambda ok, why, tier: F.struct(F.lit(ok).alias("passed"), why.alias("reason"), (F.lit(tier) if tier else F.lit(None).cast("string")).alias("tier"))
    out = result(True, F.lit("ok"), first)
    for c in reversed(checks):
        if c.missing not in ("exclude", "second", "pass"):
            raise ValueError(f"unknown policy for missing values: {c.missing}")
        unmet = F.concat_ws("=", F.lit(c.name), c.value.cast("string"))
        out = F.when(c.value.isNotNull() & ~F.coalesce(c.passed, F.lit(False)), result(False, unmet, second)).otherwise(out)
        if c.missing != "pass":
            out = F.when(c.value.isNull(), result(False, F.lit(f"{c.name} missing"), second if c.missing == "second" else None)).otherwise(out)
    return out
