"""Edge values of column expressions."""

import math

from pyspark.sql import functions as F

from starloom.functions import columns as c


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_magnitudes(spark):
    assert one(spark, c.flux_to_mag("f"), f=1.0) == 22.5
    for bad in (0.0, -1.0, float("nan"), float("inf")):
        assert one(spark, c.flux_to_mag("f"), f=bad) is None
    assert one(spark, c.flux_to_mag(F.lit(None))) is None
    assert math.isclose(one(spark, c.mag_to_flux("m"), m=20.0), 10.0)
    assert one(spark, c.deredden("f", "t"), f=1.0, t=0.0) is None


def test_cuts_at_thresholds_and_missing(spark):
    cuts = {"v": (20.4, 0.4, 0.8)}
    rows = spark.createDataFrame([(20.3, 0.5, 0.9), (20.4, 0.5, 0.9), (20.3, 0.4, 0.9), (None, 0.5, 0.9), (float("nan"), 0.5, 0.9)], "z double, a double, b double")
    assert [r.v for r in rows.select(*c.variant_flags("z", "a", "b", cuts)).collect()] == [True, False, False, False, False]


def test_masks_and_types(spark):
    assert one(spark, c.clean_mask("m", (1, 5)), m=1) and not one(spark, c.clean_mask("m", (1, 5)), m=34)
    kinds = spark.createDataFrame([(" psf ",), ("rex",), ("zzz",), (None,)], "t string")
    assert [r.x for r in kinds.select(c.clean_type("t", ("REX", "SER")).alias("x")).collect()] == [None, "REX", "OTHER", None]


def test_bins(spark):
    bins = ((1, 2, "1-2"), (3, 5, "3-5"), (6, 10, "6-10"), (11, None, "11+"))
    got = [one(spark, c.range_label("n", bins), n=n) for n in (0, 1, 2, 3, 5, 6, 10, 11)]
    assert got == ["invalid", "1-2", "1-2", "3-5", "3-5", "6-10", "6-10", "11+"]
    assert [one(spark, c.edge_bucket("v", (0.0, 1.0, 2.0)), v=v) for v in (0.0, 0.5, 1.0, 2.0, 9.0)] == [0, 0, 1, 1, 1]


def test_tiles_round_trip(spark):
    for ra, dec in ((359.99, -0.05), (0.0, 0.0), (12.34, 31.9)):
        name = one(spark, c.tile_name("a", "b"), a=ra, b=dec)
        assert one(spark, c.is_tile_name(F.lit(name)))
    assert one(spark, c.block_file("a", "b"), a=359.9, b=-3.0) == "sweep-355m005-360p000"


def test_healpix_has_equal_cells(spark):
    t = spark.range(200_000).select((F.rand(1) * 360).alias("ra"), F.degrees(F.asin(F.rand(2) * 2 - 1)).alias("dec"))
    cells = t.groupBy(c.healpix_nested("ra", "dec", 4).alias("p")).count().collect()
    assert sorted(r.p for r in cells) == list(range(192))
    chi2 = sum((r["count"] - 200_000 / 192) ** 2 / (200_000 / 192) for r in cells)
    assert chi2 < 270
    assert one(spark, c.healpix_nested(F.lit(0.0), F.lit(90.0), 4)) in range(192)


def test_uniform_is_stable(spark):
    a = one(spark, c.hash_uniform(F.lit("k"), 42))
    assert 0 <= a < 1 and a == one(spark, c.hash_uniform(F.lit("k"), 42)) != one(spark, c.hash_uniform(F.lit("k"), 43))


def test_missing_values_stay_missing(spark):
    none = F.lit(None).cast("double")
    for x in (c.inclination(none), c.prevalence_shift(none, 0.5, 0.1), c.ang_sep(none, F.lit(1.0), F.lit(1.0), F.lit(1.0)), c.deredden(none, F.lit(1.0))):
        assert one(spark, x) is None
