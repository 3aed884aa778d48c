"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes a set of word shingles (64-bit hashes), a signature and
   band keys. Equal sets fold into one class; only class representatives go on.
2. In each band bucket every member is paired with the smallest one. Pairs are
   pruned batch by batch of the signature, as soon as the posterior probability
   of reaching the threshold falls below ``miss``; the rest are verified on
   full sets.
3. Buckets that still hold several components are compared in blocks, inside
   tasks: members outside a bucket's largest component with all others of other
   components, first by signature and then on full sets. A pair that shares
   several buckets meets in the first one only. Only the links that join two components
   come out: pairs are never listed, and none inside one component is looked at.

Keys that may hold a large share of all rows (a class of copies, a bucket, a hub)
are counted first and joined by broadcast, see ``spread_join``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import Scratch, components, frugal, occupied, positions, spread_join, table, without
from starloom.llm.words import SPACED, mix, slices

#: Minima of a signature. 32 bands of 6 miss a pair of similarity 0.85 once in 4 million, 38 bands of 5 one of 0.8 as rarely.
MINIMA = 192
#: BLOCK is in shingles.
SIGNATURE, BATCH, BLOCK = 128, 32, 500_000

_rng = np.random.default_rng(7)
_A = _rng.integers(0, 2**31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, MINIMA, dtype=np.uint32)
_BAND = _rng.integers(1, 2**63, MINIMA, dtype=np.uint64) | np.uint64(1)
_SALT = _rng.integers(1, 2**63, MINIMA, dtype=np.uint64)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def _sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words than ``width`` has one, of all its words."""
    for w in slices(texts, SPACED):
        h, first = w.hashes, w.first
        wide = np.zeros(0, np.uint64)
        if len(h) >= width:
            wide = h[: len(h) - width + 1] * _STEP[0]
            for k in range(1, width):
                wide = wide + h[k : len(h) - width + 1 + k] * _STEP[k]
            wide = mix(wide)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= width:
                yield np.unique(wide[a : b - width + 1])
            elif b > a:
                yield mix((h[a:b] * _STEP[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield h[:0]


def _minima(x: np.ndarray) -> np.ndarray:
    x = (x >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 4096):
        np.minimum(out, (x[None, at : at + 4096] * _A[:, None] + _B[:, None]).min(axis=1), out=out)
    return out


SIGNED = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, sig binary"


def _signer(width: int, bands: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])
        for batch in batches:
            n = batch.num_rows
            size, d1, d2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            least = np.zeros((n, MINIMA), np.uint32)
            for i, s in enumerate(_sets(batch.column(1), width)):
                size[i] = len(s)
                if len(s):
                    d1[i], d2[i] = s.sum(), mix(s).sum()
                    least[i] = _minima(s)
            full = size > 0
            some = (least[:, : bands * rows].astype(np.uint64) * _BAND[: bands * rows]).reshape(n, bands, rows)
            keys = mix(some.sum(axis=2, dtype=np.uint64) + _SALT[:bands]).view(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]).astype(np.int32)
            short = ((least[:, :SIGNATURE] * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
            sig = [short[i].tobytes() if full[i] else b"" for i in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[full].reshape(-1))), pa.array(sig, pa.binary())], schema=schema)

    return run


def _lister(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])
        for batch in batches:
            ids = batch.column(0)
            some, size, row = [], 0, 0
            for i, s in enumerate(_sets(batch.column(1), width)):
                some.append(s.view(np.int64))
                size += len(s)
                if size > 1_000_000 or i == batch.num_rows - 1:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in some])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([ids.slice(row, len(some)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(some)))], schema=schema)
                    row, some, size = i + 1, [], 0

    return run


def least_matches(n: int, similarity: float, miss: float) -> int:
    """The fewest of n equal minima at which similarity or more still has a posterior probability of ``miss``, from a flat prior."""
    below = 0.0
    for m in range(n + 1):
        below += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        if below >= miss:
            return m
    return n


def _prune(needed: list[tuple[int, int]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SIGNATURE) for k in (2, 3)]
            alive, same, at = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for n, m in needed:
                same[alive] += (side[0][alive, at:n] == side[1][alive, at:n]).sum(axis=1)
                alive, at = alive[same[alive] >= m], n
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(alive)) for k in (0, 1)], names=["a", "b"])

    return run


def _block(needed: list[tuple[int, int]], percent: int) -> Callable:
    """Compares two blocks of a bucket: members of different components, likest first; a link joins their components at once."""

    def run(t: pa.Table) -> pa.Table:
        left = t.column("side").to_numpy() == 0
        ids, size, bucket = t.column("id").to_numpy(), t.column("n_shingles").to_numpy(), t.column("grp")[0].as_py()
        root = np.unique(t.column("comp").to_numpy(), return_inverse=True)[1]
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, SIGNATURE)
        lists, buckets = t.column("shingles").combine_chunks(), t.column("grps")
        at, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy().view(np.uint64)  # sorted as unsigned numbers
        i, j = np.flatnonzero(left), np.flatnonzero(~left)
        same_block = not len(j)
        links: list[tuple[int, int]] = []
        for n, x in enumerate(i):
            k = i[n + 1 :] if same_block else j
            k = k[(root[k] != root[x]) & (100 * np.minimum(size[k], size[x]) >= percent * np.maximum(size[k], size[x]))]
            same, done = np.zeros(len(k), np.int64), 0
            for m, least in needed:
                same += (sig[k, done:m] == sig[x, done:m]).sum(axis=1)
                keep = same >= least
                k, same, done = k[keep], same[keep], m
            own, k, some = flat[at[x] : at[x + 1]], k[np.argsort(-same, kind="stable")], 8
            mine = set(buckets[int(x)].as_py()) if len(k) else set()
            while len(k) and len(own):
                part, k, some = k[:some], k[some:], 256
                part = np.array([y for y in part if min(mine.intersection(buckets[int(y)].as_py())) == bucket], np.int64)
                if not len(part):
                    continue
                lens = at[part + 1] - at[part]
                begin = np.cumsum(lens) - lens
                other = flat[np.repeat(at[part] - begin, lens) + np.arange(lens.sum())]
                found = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
                common = np.add.reduceat(found.astype(np.int64), begin)
                for y in part[100 * common >= percent * (len(own) + lens - common)]:
                    if root[y] != root[x]:
                        links.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
                        root[root == root[y]] = root[x]
                k = k[root[k] != root[x]]
        return pa.table({"a": pa.array([int(a) for a, _ in links], pa.int64()), "b": pa.array([int(b) for _, b in links], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Texts with 100 * intersection >= percent * union of their shingle sets are
    linked; component_id is the smallest key reachable, and kept marks it.
    Null, empty and wordless texts have no shingles and link with nothing.
    Rows that repeat a key are one node, linked through each of their texts,
    and all of them carry its component. A null key links with nothing and is
    kept. Keys are integers. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    needed = [(n, least_matches(n, percent / 100, miss)) for n in range(BATCH, SIGNATURE + 1, BATCH)]
    body = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    bands, per_band = (32, 6) if percent >= 85 else (38, 5)
    sigs = scratch.keep(body.mapInArrow(frugal(_signer(width, bands, per_band)), SIGNED), "signatures")

    # classes of equal sets; rep is their smallest key and stands for them from here on
    have, one_class = sigs.where("n_shingles > 0 and doc_id is not null"), ["d1", "d2", "n_shingles"]
    classes = scratch.keep(have.groupBy(*one_class).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    both = have.groupBy("doc_id").agg(F.min(F.struct(*one_class)).alias("p"), F.max(F.struct(*one_class)).alias("q")).where("p <> q").select("doc_id")
    both = have.select("doc_id", *one_class).join(both, "doc_id", "left_semi").distinct().join(classes, one_class).select("doc_id", "rep").distinct()
    keyed = scratch.keep(both.join(both.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b")).where("a <> b").distinct(), "keyed")
    reps = have.join(classes.select("d1", "d2", F.col("rep").alias("doc_id")), ["d1", "d2", "doc_id"], "left_semi").dropDuplicates(["doc_id", "d1", "d2"])
    reps = scratch.keep(reps.select(F.col("doc_id").alias("id"), "n_shingles", "bands", "sig"), "reps")

    flat = reps.select("id", F.explode("bands").alias("band"))
    shared = scratch.keep(flat.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high").select("band", "low", "n"), "shared")
    buckets = scratch.keep(spread_join(flat, shared, ["band"], "n").distinct(), "buckets")

    def sets_of(ids: DataFrame) -> DataFrame:
        ids = scratch.keep(ids.distinct(), "ids")
        wanted = occupied(body, F.col("doc_id"), ids, F.col("id"))
        return scratch.keep(wanted.mapInArrow(frugal(_lister(width)), "id bigint, shingles array<bigint>"), "sets")

    one = lambda c, s: reps.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sig").alias(s))
    star = scratch.keep(buckets.where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct(), "star")
    hubs = scratch.keep(star.groupBy("a").agg(F.count(F.lit(1)).alias("n")).join(one("a", "sa"), "a"), "hubs")
    near = spread_join(star, hubs, ["a"], "n").join(one("b", "sb"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    pairs = scratch.keep(near.select("a", "b", "sa", "sb").mapInArrow(frugal(_prune(needed)), "a bigint, b bigint").distinct(), "pairs")
    sets = sets_of(pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")))
    hubs = scratch.keep(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a"), "hubs")
    sized = spread_join(pairs, hubs, ["a"], "n").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    links = scratch.keep(sized.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b").distinct(), "links")

    comp = scratch.keep(components(scratch, keyed.unionAll(links)), "components")
    placed = scratch.keep(buckets.select("band", "id").join(comp, "id", "left").select("band", "id", F.coalesce("component_id", "id").alias("comp")), "placed")
    hashed = lambda seed: F.xxhash64("id", F.lit(seed))
    mixed = placed.groupBy("band").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count(F.lit(1)).alias("n"), F.bit_xor(hashed(1)).alias("x"), F.bit_xor(hashed(2)).alias("y")).where("least <> most")
    mixed = scratch.keep(mixed.groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band", "n"), "mixed")  # buckets of the same members are one
    open_ = scratch.keep(spread_join(placed, mixed, ["band"], "n").select(F.col("band").alias("grp"), "id", "comp").join(reps.select("id", "n_shingles", "sig"), "id"), "open")
    parts = open_.groupBy("grp", "comp").agg(F.sum("n_shingles").alias("size"), F.count(F.lit(1)).alias("rows"))
    plan = parts.groupBy("grp").agg(F.max_by("comp", F.struct("size", "comp")).alias("big"), F.max("size").alias("_most"), F.sum("size").alias("_all"), F.sum("rows").alias("n"))
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    plan = scratch.keep(plan.select("grp", "big", blocks(F.col("_all") - F.col("_most")).alias("few"), blocks(F.col("_most")).alias("many"), "n"), "plan")
    of = open_.groupBy("id").agg(F.collect_set("grp").alias("grps"))  # at most one for each band
    # a pair of different components has a member outside the largest one, so its blocks meet no block of their own kind
    inside = F.col("comp") == F.col("big")
    own = F.when(inside, F.col("few") + F.pmod(F.xxhash64("id"), F.col("many"))).otherwise(F.pmod(F.xxhash64("id"), F.col("few"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(inside, F.col("few") - 1).otherwise(F.col("few") + F.col("many") - 1)))
    rows = spread_join(open_, plan, ["grp"], "n").join(of, "id").join(sets_of(open_.select("id")), "id").withColumn("own", own).withColumn("other", other)
    rows = rows.select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "id", "comp", "n_shingles", "grps", "sig", "shingles")
    more = scratch.keep(rows.groupBy("grp", "i", "j").applyInArrow(_block(needed, percent), "a bigint, b bigint").distinct(), "links")

    comp = scratch.keep(components(scratch, keyed.unionAll(links).unionAll(more)), "components")
    moved = classes.join(comp, F.col("rep") == F.col("id"), "left").withColumn("component_id", F.coalesce("component_id", "rep")).where("n > 1 or component_id <> rep")
    moved = scratch.keep(moved.select(*one_class, "component_id", "n"), "moved")
    slim = have.select("doc_id", *one_class)
    out = spread_join(slim, moved, one_class, "n", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    alone = sigs.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionAll(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without the rows that ``near_duplicates`` doesn't keep; only rows that may go are shuffled.

    Rows go by key: rows that repeat a kept key all stay, also with the same
    text. Of rows with a null key and equal texts one stays (any, if their other
    columns differ), and none if a row with a key has that text; without a word
    in the text, all stay. Columns come back as they are, whatever their names.
    """
    names = docs.columns
    docs, key, text = positions(docs, key, text)
    gone = near_duplicates(docs, key, text, **how).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    scratch = Scratch(docs.sparkSession, "kept")
    out = without(docs, key, scratch.keep(gone, "gone"), "_gone")
    digest, worded = F.sha2(F.col(text), 256), F.coalesce(F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    nameless = docs.where(F.col(key).isNull() & worded).select(digest.alias("_digest"), F.struct(*docs.columns).alias("_row"))
    if not nameless.head(1):
        return out.toDF(*names)
    one = scratch.keep(nameless.dropDuplicates(["_digest"]), "nameless")
    seen = occupied(docs.where(F.col(key).isNotNull()).select(digest.alias("_digest")), F.col("_digest"), one, F.col("_digest"))
    return out.where(F.col(key).isNotNull() | ~worded).unionAll(one.join(seen.distinct(), "_digest", "left_anti").select("_row.*")).toDF(*names)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
