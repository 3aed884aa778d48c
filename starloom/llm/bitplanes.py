"""Centroid clustering of integer vectors on packed bit planes.

Each vector of whole numbers is stored as its two's complement bit planes: bit
b of up to 64 components is one uint64. A dot product is then the sum over
plane pairs of popcount(x_i AND c_j), weighted by 2^(i+j) and negative where one of the
two is a sign plane; it is exact, and so are distances, |x|^2 - 2xc + |c|^2.
Planes are packed once and read again in each round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import Scratch, table

#: Components below 2^27 in size: distances between 64 of them fit in 63 bits.
WIDEST = 27


def pack(v: np.ndarray) -> np.ndarray:
    """(vectors, planes, words of 64 components) as uint64, the sign plane last."""
    n, dims = v.shape
    reach = int(np.where(v < 0, ~v, v).max(initial=0)).bit_length()
    bits = np.zeros((n, reach + 1, -(-dims // 64) * 64), np.uint8)
    for b in range(reach + 1):
        bits[:, b, :dims] = (v >> b) & 1
    return np.packbits(bits, axis=2, bitorder="little").view("<u8")


def weights(planes: int) -> np.ndarray:
    w = np.int64(1) << np.arange(planes, dtype=np.int64)
    w[-1] *= -1
    return w


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Dot products of all packed vectors x with all packed c."""
    out = np.zeros((len(x), len(c)), np.int64)
    wx, wc = weights(x.shape[1]), weights(c.shape[1])
    for i in range(x.shape[1]):
        for j in range(c.shape[1]):
            out += wx[i] * wc[j] * np.bitwise_count(x[:, None, i] & c[None, :, j]).sum(axis=2, dtype=np.int64)
    return out


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each packed vector; ties go to the smaller number."""
    far = norms[:, None] - 2 * dots(x, pack(centroids)) + (centroids * centroids).sum(axis=1)[None]
    best = far.argmin(axis=1)
    return best, far[np.arange(len(x)), best]


def sums(x: np.ndarray, cluster: np.ndarray, k: int, dims: int) -> np.ndarray:
    """Component sums of the packed vectors of each cluster: bits set per plane, weighted."""
    bits = np.unpackbits(x.view(np.uint8), axis=2, bitorder="little")[:, :, :dims]
    chosen = (np.arange(k)[:, None] == cluster[None]).astype(np.float64)  # counts stay far below 2^53
    per_plane = (chosen @ bits.reshape(len(x), -1).astype(np.float64)).reshape(k, x.shape[1], dims).astype(np.int64)
    return np.einsum("kpd,p->kd", per_plane, weights(x.shape[1]))


def _packer(dims: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                x = pack(v)
                flat = pa.array(x.reshape(-1).view(np.int64))
                planes = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.shape[2])), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0), planes, pa.array((v * v).sum(axis=1))], schema=schema)

    return run


def _packed(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(keys, planes, norms) of vectors with the same number of planes."""
    for batch in batches:
        sizes = np.diff(batch.column(1).offsets.to_numpy())
        for size in np.unique(sizes):
            part = batch.filter(pa.array(sizes == size))
            x = part.column(1).flatten().to_numpy().view(np.uint64).reshape(part.num_rows, -1, words)
            yield part.column(0), x, part.column(2).to_numpy()


def _totals(centroids: np.ndarray):
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, x, norms in _packed(batches, -(-dims // 64)):
            cluster, _ = nearest(x, norms, centroids)
            total += sums(x, cluster, k, dims)
            n += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    return run


def _assigner(centroids: np.ndarray, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, x, norms in _packed(batches, -(-centroids.shape[1] // 64)):
            cluster, far = nearest(x, norms, centroids)
            yield pa.RecordBatch.from_arrays([key, pa.array(cluster.astype(np.int32)), pa.array(far)], schema=schema)

    return run


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((key, cluster, distance, cluster_inertia, inertia, centroid_sha256), centroids) after ``rounds`` rounds of k-means on floor(scale * x).

    Kept are vectors of exactly ``dims`` components, none null or non-finite;
    others have no row. The first centroids are the k kept vectors of smallest
    sha256 of '1:<key>', equal hashes by their components, null keys last; with
    fewer vectors there are fewer centroids, and no vectors give no rows. Ties
    go to the smaller number; an empty cluster keeps its centroid. Rows that
    repeat a key or a vector all count. A kept vector with a component of 2^27 or more
    has a row of nulls and no part in the centroids, and an inertia beyond a long is null. Other
    columns, whatever their names, are not returned.

    Only centroids, and per round one row of sums per cluster, pass the driver.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "bitplanes")
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    body = vectors.select(F.col(key).alias("key"), x.alias("x")).where((F.size(x) == dims) & fine)
    too_wide = F.exists("x", lambda c: F.abs(c * scale) >= float(1 << WIDEST))
    # cast to the long that floor gives, so that the comparison above decides first
    ints: Column = F.transform("x", lambda c: F.floor(c * scale))
    kept = body.where(~too_wide).select("key", ints.alias("v"))
    kind = vectors.select(key).schema[0].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = lambda ddl: to_arrow_schema(_parse_datatype_string(ddl))
    layout = f"key {kind}, planes array<bigint>, norm bigint"
    planes = scratch.keep(kept.mapInArrow(_packer(dims, arrow(layout)), layout), "planes")

    rank = F.sha2(F.concat(F.lit("1:"), F.col("key").cast("string")), 256)
    first = kept.orderBy(rank.asc_nulls_last(), "v").limit(k).select("v").collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        parts = planes.mapInArrow(_totals(centroids), "cluster int, n bigint, total array<bigint>")
        whole = lambda c: F.sum(c.cast("decimal(38,0)"))
        for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[whole(F.col("total")[i]) for i in range(dims)]).alias("total")).collect():
            centroids[r.cluster] = [int(t) // r.n for t in r.total]

    out = f"key {kind}, cluster int, distance bigint"
    if not len(centroids):
        assigned = spark.createDataFrame([], out)
        sums_of: list = []
    else:
        assigned = scratch.keep(planes.mapInArrow(_assigner(centroids, arrow(out)), out), "assigned")
        sums_of = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    fits = lambda s: int(s) if s < 1 << 63 else None
    total = fits(sum(r.s for r in sums_of))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    marks = spark.createDataFrame([(r.cluster, fits(r.s), total, names[r.cluster]) for r in sums_of], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    done = assigned.join(F.broadcast(marks), "cluster")  # one row per cluster
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string"))]
    wide = body.where(too_wide).select("key", *empty)
    rest = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return done.select("key", *rest).unionAll(wide).select(F.col("key").alias(key), *rest), centroids


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))[0]


def _sql(k: int = 16, rounds: int = 3) -> str:
    near = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [
        "k AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v"
        " FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS INTEGER) AS cluster, v AS c FROM k QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), v) <= {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS (SELECT rid, min(struct_pack(d := CAST({near} AS BIGINT), cluster := cluster)) AS best FROM k, c{r} GROUP BY rid)")
        if r < rounds:
            parts += [
                f"e{r} AS (SELECT best.cluster AS cluster, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a{r} JOIN k USING (rid))",
                f"s{r} AS (SELECT cluster, i, sum(CAST(x AS HUGEINT)) AS s, count(*) AS n FROM e{r} GROUP BY ALL)",
                f"m{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM s{r} GROUP BY cluster)",
                f"c{r + 1} AS (SELECT cluster, coalesce(m, c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))",
            ]
    return f"""WITH {", ".join(parts)}
SELECT vec_id, best.cluster AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia,
    CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN k USING (rid) JOIN c{rounds} ON c{rounds}.cluster = best.cluster"""


OP12_SQL = _sql()
