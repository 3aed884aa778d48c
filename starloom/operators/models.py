"""Models and distances between populations, fitted with Spark ML or on d x d summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.columns import hash_uniform
from starloom.operators.metrics import auc
from starloom.operators.stored import Stored
from starloom.operators.windows import numbered


def balanced(df: DataFrame, label: str) -> DataFrame:
    """df plus ``weight``: both classes weigh the same in all."""
    n = df.agg(F.count(F.lit(1)).alias("_n"), F.sum(label).alias("_p"))
    w = F.when(F.col(label) == 1, F.col("_n") / (2 * F.nullif(F.col("_p"), F.lit(0)))).otherwise(F.col("_n") / (2 * F.nullif(F.col("_n") - F.col("_p"), F.lit(0))))
    return df.crossJoin(F.broadcast(n)).withColumn("weight", w).drop("_n", "_p")  # one row of counts


def logistic(train: DataFrame, test: DataFrame, features: Sequence[str] | str, label: str, key: str) -> DataFrame:
    """(key, label, score) of test rows from a balanced logistic regression, standardised while it is fitted, on columns or on an array column.

    The fitted line is applied as an expression.
    """
    x = F.transform(features, lambda v: v.cast("double")) if isinstance(features, str) else F.array(*[F.col(f).cast("double") for f in features])
    fit = balanced(train, label).select(array_to_vector(x).alias("x"), F.col(label).cast("double").alias("y"), "weight")
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", maxIter=50, regParam=1e-4).fit(fit)
    weights = F.array(*[F.lit(float(v)) for v in model.coefficients])
    z = F.aggregate(F.zip_with(x, weights, lambda v, k: v * k), F.lit(float(model.intercept)), lambda s, v: s + v)
    return test.select(key, label, (1 / (1 + F.exp(-z))).alias("score"))


def probe(df: DataFrame, vector: str, label: str, key: str, folds: int = 5) -> DataFrame:
    """Cross-validated scores of a linear probe between two populations of vectors; folds come from the key's hash."""
    t = df.withColumn("_f", F.floor(hash_uniform(key, "fold") * folds))
    out = None
    for i in range(folds):
        part = logistic(t.where(F.col("_f") != i), t.where(F.col("_f") == i), vector, label, key).withColumn("fold", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def entity_folds(df: DataFrame, entity: str, folds: int, seed: int | str = "fold") -> DataFrame:
    """(entity, fold): every entity in one fold, folds of nearly equal rows.

    Entities are numbered by size, the largest first, and dealt to the folds
    forwards and backwards in turn. A null entity is one entity.
    """
    t = df.groupBy(entity).agg((-F.count(F.lit(1))).alias("_m")).withColumn("_u", F.coalesce(hash_uniform(entity, seed), F.lit(-1.0)))
    place = F.pmod(F.col("_i") - 1, F.lit(2 * folds))
    return numbered(t, ["_m", "_u", entity], "_i").select(entity, F.least(place, 2 * folds - 1 - place).cast("int").alias("fold"))


def cross_validated(df: DataFrame, features: Sequence[str] | str, label: str, key: str, folds: int = 5, entity: str | None = None, seed: int | str = "fold") -> DataFrame:
    """(key, label, score, fold): scores of rows by a model fitted without their fold, on columns or on an array column.

    With ``entity``, no entity has rows on both sides of a fold; without, folds
    come from the key's hash. Each fold must leave both labels to fit on.
    """
    stored = Stored(df.sparkSession, "folds")
    if entity is None:
        t = df.withColumn("_f", F.floor(hash_uniform(key, seed) * folds).cast("int"))
    else:
        f = stored.keep(entity_folds(df, entity, folds, seed)).select(F.col(entity).alias("_e"), F.col("fold").alias("_f"))
        t = df.join(f, F.col(entity).eqNullSafe(F.col("_e"))).drop("_e")
    t, out = stored.keep(t.select(key, label, *([features] if isinstance(features, str) else features), "_f")), None
    for i in range(folds):
        part = logistic(t.where(F.col("_f") != i), t.where(F.col("_f") == i), features, label, key).withColumn("fold", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def probe_report(scores: DataFrame, label: str) -> DataFrame:
    """(fold, n, auc, accuracy, brier) of scores in [0, 1] for each fold and for all rows; accuracy at 0.5."""
    y = F.col(label).cast("double")
    t = scores.select("score", label, F.explode(F.array(F.col("fold").cast("string"), F.lit("all"))).alias("fold"))
    rest = t.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg(((F.col("score") >= 0.5) == (y == 1)).cast("double")).alias("accuracy"), F.avg(F.pow(F.col("score") - y, F.lit(2.0))).alias("brier"))
    area = auc(t, "score", F.col(label) == 1, ["fold"]).select("fold", "auc")
    return rest.join(area, "fold", "left").select("fold", "n", "auc", "accuracy", "brier")


def covariance(df: DataFrame, vector: str) -> DataFrame:
    """(i, j, n, mean_i, mean_j, cov): sample covariance; partial d x d sums per batch, added by index."""
    import pandas as pd

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for f in frames:
            if len(f):
                x = np.stack([v.astype("float64") for v in f[vector]])
                i, j = np.indices((x.shape[1], x.shape[1])).reshape(2, -1)
                yield pd.DataFrame({"i": i, "j": j, "n": len(x), "xy": (x.T @ x).ravel(), "x": x.sum(0)[i], "y": x.sum(0)[j]})

    t = df.select(vector).mapInPandas(sums, "i int, j int, n bigint, xy double, x double, y double")
    t = t.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "xy", "x", "y")])
    cov = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))
    return t.select("i", "j", "n", (F.col("x") / F.col("n")).alias("mean_i"), (F.col("y") / F.col("n")).alias("mean_j"), cov.alias("cov"))


def frechet(a: DataFrame, b: DataFrame, vector: str) -> float:
    """Frechet distance of Gaussian fits; only the d x d root is taken on the driver."""
    import numpy as np

    def load(df: DataFrame):
        r = covariance(df, vector).toPandas()
        d = int(r.i.max()) + 1
        c, m = np.zeros((d, d)), np.zeros(d)
        c[r.i, r.j] = r["cov"]
        m[r.i] = r.mean_i
        return m, c

    (m1, c1), (m2, c2) = load(a), load(b)
    w, v = np.linalg.eigh(c1)
    root = v @ np.diag(np.sqrt(np.clip(w, 0, None))) @ v.T
    mid = np.sqrt(np.clip(np.linalg.eigvalsh(root @ c2 @ root), 0, None)).sum()
    return float(((m1 - m2) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * mid)


def mmd(a: DataFrame, b: DataFrame, key: str, vector: str, gamma: float, block: int = 1024) -> DataFrame:
    """One row: unbiased squared maximum mean discrepancy with a Gaussian kernel, from all pairs of rows; keys are unique.

    Rows fall into hash blocks of about ``block`` rows. A task holds two
    blocks at a time and gives the sum of their kernel values and the number of
    pairs; the work is quadratic in the rows, as the statistic is.
    """
    import pandas as pd

    aa, bb, ab = range(3)
    most = a.agg(F.count(F.lit(1)).alias("n")).unionAll(b.agg(F.count(F.lit(1)).alias("n"))).agg(F.max("n")).first()[0]
    blocks = max(1, -(-most // block))
    at = F.pmod(F.xxhash64(F.col(key), F.lit("mmd")), F.lit(blocks)).cast("int")
    every = F.sequence(F.lit(0), F.lit(blocks - 1))

    def side(df: DataFrame, kind: int, first: bool, same: bool) -> DataFrame:
        """Rows of df once for each block that theirs is paired with; of a population's own pairs of blocks, each once."""
        other = F.filter(every, lambda k: k >= at if first else k <= at) if same else every
        t = df.select(F.lit(kind).alias("_kind"), at.alias("_at"), F.explode(other).alias("_other"), F.col(key).alias("_k"), F.transform(vector, lambda v: v.cast("double")).alias("_v"))
        own, far = ("_i", "_j") if first else ("_j", "_i")
        return t.withColumnsRenamed({"_at": own, "_other": far}).select("_kind", "_i", "_j", "_k", "_v")

    def kernel(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        if not len(x) or not len(y):
            return pd.DataFrame({"kind": [], "s": [], "n": []})
        kind, i, j = (x[c].iloc[0] for c in ("_kind", "_i", "_j"))
        q, total, n = np.stack(y["_v"]), 0.0, 0
        for k, v in zip(x["_k"].to_numpy(), x["_v"], strict=True):
            values = np.exp(-gamma * ((q - v) ** 2).sum(1))
            if kind != ab:
                values = values[y["_k"].to_numpy() != k]
            total, n = total + float(values.sum()), n + len(values)
        twice = 2 if kind != ab and i != j else 1
        return pd.DataFrame({"kind": [kind], "s": [twice * total], "n": [twice * n]})

    pairs = ((aa, a, a), (bb, b, b), (ab, a, b))
    left, right = None, None
    for kind, x, y in pairs:
        p, q = side(x, kind, True, x is y), side(y, kind, False, x is y)
        left, right = (p, q) if left is None else (left.unionAll(p), right.unionAll(q))
    sums = left.groupBy("_kind", "_i", "_j").cogroup(right.groupBy("_kind", "_i", "_j")).applyInPandas(kernel, "kind int, s double, n bigint")
    mean = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("s"))) / F.nullif(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    return sums.agg((mean(aa) + mean(bb) - 2 * mean(ab)).alias("mmd2"))


def mmd_blocks(a: DataFrame, b: DataFrame, key: str, vector: str, gamma: float, block: int = 1024, seed: int = 3) -> DataFrame:
    """One row: squared maximum mean discrepancy as the mean of unbiased estimates over hash blocks (the B-test), and the number of blocks.

    Every row falls into one of ceil(n / block) blocks, n being the rows of the
    larger side, and a block's estimate comes from all of its pairs. The work
    grows with the rows, not with their square; tables of one block give what
    ``mmd`` gives. Blocks without two rows of each side are left out. Keys are
    unique; a null vector is no row.
    """
    import pandas as pd

    both = a.select(F.lit(0).alias("_side"), F.col(key).alias("_k"), F.col(vector).alias("_v")).unionAll(b.select(F.lit(1), key, vector)).where("_v is not null")
    most = both.groupBy("_side").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = max(1, -(-most // block))

    def estimate(t: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        x, y = (np.array(t["_v"][t["_side"] == side].tolist(), float) for side in (0, 1))
        if min(len(x), len(y)) < 2:
            return pd.DataFrame({"estimate": []})

        def total(p, q) -> float:  # a row at a time, so that a block needs its vectors only
            return float(sum(np.exp(-gamma * ((q - v) ** 2).sum(1)).sum() for v in p))

        within = sum((total(z, z) - len(z)) / (len(z) * (len(z) - 1)) for z in (x, y))
        return pd.DataFrame({"estimate": [within - 2 * total(x, y) / (len(x) * len(y))]})

    t = both.select("_side", F.floor(hash_uniform("_k", seed) * blocks).cast("long").alias("_block"), F.transform("_v", lambda v: v.cast("double")).alias("_v"))
    out = t.groupBy("_block").applyInPandas(estimate, "estimate double")
    return out.agg(F.avg("estimate").alias("mmd2"), F.count(F.lit(1)).alias("blocks"))


def _greedy_range(va: Sequence[float], vb: Sequence[float], low: float, high: float, most: float) -> tuple[list[tuple[int, int, float]], list[int], list[int]]:
    """(pairs, a left open, b left open) of sorted values inside (low, high), outside of which more rows may lie.

    Closest pairs are neighbours in value order, so a heap of neighbours gives
    them in turn. A pair that is not closer than the range's ends is left open,
    and so is any pair not closer than an open row: what is paired here is
    what the greedy pass over all rows pairs.
    """
    from bisect import bisect_left, insort
    from heapq import heapify, heappop, heappush

    nodes: list[list] = []  # value, side, first row that is left, end of its rows
    for side, values in ((0, va), (1, vb)):
        for i, v in enumerate(values):
            if nodes and nodes[-1][:2] == [v, side]:
                nodes[-1][3] = i + 1
            else:
                nodes.append([v, side, i, i + 1])
    nodes.sort()
    n = len(nodes)
    prev, after, stuck = list(range(-1, n - 1)), [*range(1, n), -1], [False] * n
    walls = [min(low, nodes[0][0]), max(high, nodes[-1][0])]

    def edge(x: int, y: int):
        """Of neighbours x before y, if both are free and on two sides: (gap, row of a, row of b, x, y)."""
        if x < 0 or y < 0 or stuck[x] or stuck[y] or nodes[x][1] == nodes[y][1] or nodes[y][0] - nodes[x][0] > most:
            return None
        p, q = (x, y) if nodes[x][1] == 0 else (y, x)
        return nodes[y][0] - nodes[x][0], nodes[p][2], nodes[q][2], x, y

    heap = [e for x in range(n - 1) if (e := edge(x, x + 1))]
    heapify(heap)
    pairs = []
    while heap:
        e = heappop(heap)
        gap, i, j, x, y = e
        if after[x] != y or nodes[x][2] == nodes[x][3] or nodes[y][2] == nodes[y][3] or (now := edge(x, y)) is None:
            continue
        if now != e:
            heappush(heap, now)
            continue
        at = bisect_left(walls, nodes[x][0])
        left = nodes[x][0] - walls[at - 1] if at else float("inf")
        if at < len(walls) and walls[at] <= nodes[y][0]:
            left = 0.0
        at = bisect_left(walls, nodes[y][0])
        if gap >= left or at < len(walls) and gap >= walls[at] - nodes[y][0]:
            for k in (x, y):
                stuck[k] = True
                insort(walls, nodes[k][0])
            continue
        pairs.append((i, j, gap))
        for k in (x, y):
            nodes[k][2] += 1
            if nodes[k][2] == nodes[k][3]:
                u, v = prev[k], after[k]
                if u >= 0:
                    after[u] = v
                if v >= 0:
                    prev[v] = u
        free = [k for k in (x, y) if nodes[k][2] < nodes[k][3]]
        u, v = (x if x in free else prev[x]), (y if y in free else after[y])
        for e in {edge(u, v), *(edge(prev[k], k) for k in free), *(edge(k, after[k]) for k in free)} - {None}:
            heappush(heap, e)
    open_: tuple[list[int], list[int]] = ([], [])
    for k, (v, side, i, end) in enumerate(nodes):
        at = bisect_left(walls, v)
        near = min(v - walls[at - 1] if at else float("inf"), walls[at] - v if at < len(walls) else float("inf"))
        if stuck[k] or near <= most:
            open_[side].extend(range(i, end))
    return pairs, *open_


def greedy_pairs(a: DataFrame, b: DataFrame, bin_: str, key_a: str, key_b: str, value: str, most: float, rows: int = 20_000) -> DataFrame:
    """One-to-one pairs inside bins: the closest values first, ties by value and key; rows without a value stay alone.

    Bins are cut into value ranges of about ``rows`` rows. Pairs that rows
    beyond a range could change stay open for the next turn, with other and
    wider ranges, until none is left, so the ranges do not change the result.
    """
    import pandas as pd

    kinds = dict(a.dtypes) | dict(b.dtypes)
    schema = f"`{bin_}` {kinds[bin_]}, `{key_a}` {kinds[key_a]}, `{key_b}` {kinds[key_b]}, gap double, _v double"
    names = [bin_, key_a, key_b, "gap", "_v"]
    known = F.col("_v").isNotNull() & ~F.isnan("_v")
    a, b = (t.select(bin_, k, F.col(value).cast("double").alias("_v")).where(known) for t, k in ((a, key_a), (b, key_b)))
    found, width, turn, stored = None, 0.0, 0, Stored(a.sparkSession, "pairs")
    while True:
        both = a.select(bin_, "_v").unionAll(b.select(bin_, "_v"))
        n, lo, hi = both.groupBy(bin_).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).agg(F.max("n"), F.min("lo"), F.max("hi")).first()
        n, lo, hi = n or 0, lo or 0.0, hi or 0.0
        width = max(4 * width, (hi - lo) / max(1, -(-n // rows)) * 1.01, 1e-9)
        shift = 0.5 * (turn % 2) if width < 2 * (hi - lo) else 0.0
        place = F.floor((F.col("_v") - lo) / width + shift).cast("int")
        last = int((hi - lo) / width + shift)

        def match(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:  # run before the loop goes on
            x, y = x.sort_values(["_v", key_a]), y.sort_values(["_v", key_b])
            one = x if len(x) else y
            group, k = one[bin_].iloc[0], int(one["_at"].iloc[0])
            slack = 1e-6 * width  # the ends are not exact, so they lie a little inside
            low = lo + (k - shift) * width + slack if k > 0 else float("-inf")
            high = lo + (k + 1 - shift) * width - slack if k < last else float("inf")
            ka, kb, va, vb = x[key_a].tolist(), y[key_b].tolist(), x["_v"].tolist(), y["_v"].tolist()
            pairs, left_a, left_b = _greedy_range(va, vb, low, high, most)
            out = [(group, ka[i], kb[j], gap, None) for i, j, gap in pairs]
            out += [(group, ka[i], None, None, va[i]) for i in left_a] + [(group, None, kb[j], None, vb[j]) for j in left_b]
            return pd.DataFrame({c: pd.Series([r[i] for r in out], dtype=object) for i, c in enumerate(names)})

        x, y = (t.withColumn("_at", place) for t in (a, b))
        t = stored.keep(x.groupBy(bin_, "_at").cogroup(y.groupBy(bin_, "_at")).applyInPandas(match, schema))
        pairs = t.where("_v IS NULL").drop("_v")
        found = pairs if found is None else found.unionAll(pairs)
        a, b = t.where(F.col("_v").isNotNull() & F.col(key_b).isNull()).select(bin_, key_a, "_v"), t.where(F.col("_v").isNotNull() & F.col(key_a).isNull()).select(bin_, key_b, "_v")
        if t.where("_v IS NOT NULL").isEmpty():
            return found
        turn += 1


def mutual_nearest(a: DataFrame, b: DataFrame, bin_: str, key_a: str, key_b: str, value: str) -> DataFrame:
    """Pairs inside bins that are each other's nearest by value. Of rows as near, those not above come first; of these the smallest key at a gap of 0, else the largest; above, the smallest.

    Rows meet as distinct values with their end keys. Only equal values, or two with none between them, can be each other's nearest,
    so each value looks at the one below it, the last below of its own side and the next above of the other. Neighbours come from value
    ranges of a bin and the rows at their ends, in frames that grow from one end, so the work is a sort and no task takes a whole bin.
    """
    from pyspark.sql import Window

    def rows(t: DataFrame, key: str, side: str) -> DataFrame:
        k = F.col(key).cast("long")
        return t.where(F.col(bin_).isNotNull()).select(F.col(bin_).alias("_bin"), F.col(value).alias("v"), *[(k if s == side else F.lit(None).cast("long")).alias(s) for s in "ab"])

    ends = [f(s).alias(f"{s}{n}") for s in "ab" for n, f in ((0, F.min), (1, F.max))]
    t = Stored(a.sparkSession, "nearest").keep(rows(a, key_a, "a").unionAll(rows(b, key_b, "b")).groupBy("_bin", "v").agg(*ends))
    known = F.col("v").isNotNull() & ~F.isnan("v")
    odd = _odd_pairs(t, known, bin_, key_a, key_b)

    t = t.where(known)
    edges = t.groupBy("_bin").agg(F.percentile_approx("v", [i / 64 for i in range(1, 64)], 1000).alias("_e"))
    t = t.join(edges, "_bin").withColumn("_part", F.size(F.filter("_e", lambda x: x <= F.col("v")))).drop("_e")
    whole = F.struct("v", "a0", "a1", "b0", "b1")
    has = {s: F.when(F.col(f"{s}0").isNotNull(), F.col("v")) for s in "ab"}
    heads = t.groupBy("_bin", "_part").agg(F.max(whole).alias("_low"), *[f(has[s]).alias(f"_{n}{s}") for s in "ab" for n, f in (("low", F.max), ("high", F.min))])
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    up, down = (before(Window.partitionBy("_bin").orderBy(o)) for o in (F.asc("_part"), F.desc("_part")))
    heads = heads.select("_bin", "_part", *[F.max(c).over(up).alias(c) for c in ("_low", "_lowa", "_lowb")], *[F.min(c).over(down).alias(c) for c in ("_higha", "_highb")])
    up, down = (Window.partitionBy("_bin", "_part").orderBy(o) for o in (F.asc("v"), F.desc("v")))
    t = t.join(heads, ["_bin", "_part"]).withColumn("low", F.coalesce(F.lag(whole).over(up), "_low"))
    t = t.withColumns({f"low{s}": F.coalesce(F.max(has[s]).over(before(up)), f"_low{s}") for s in "ab"}).withColumns({f"high{s}": F.coalesce(F.min(has[s]).over(before(down)), f"_high{s}") for s in "ab"})

    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    near = gap("v", "low.v")

    def beside(own: str, other: str) -> Column:
        """The value is on one side only, the one below it on the other only, and none is nearer to either."""
        sides = F.col(f"{own}0").isNotNull() & F.col(f"{other}0").isNull() & F.col(f"low.{other}0").isNotNull() & F.col(f"low.{own}0").isNull()
        return sides & (F.col(f"low{own}").isNull() | (near < gap("low.v", f"low{own}"))) & (F.col(f"high{other}").isNull() | (near <= gap(f"high{other}", "v")))

    pair = lambda x, y, g: F.struct(F.col(x).alias("a"), F.col(y).alias("b"), g.alias("gap"))
    found = F.when(F.col("a0").isNotNull() & F.col("b0").isNotNull(), pair("a0", "b0", gap("v", "v"))).when(beside("b", "a"), pair("low.a1", "b0", near)).when(beside("a", "b"), pair("a0", "low.b1", near))
    t = t.select("_bin", found.alias("p")).where("p IS NOT NULL")
    return t.select(F.col("_bin").alias(bin_), F.col("p.a").alias(key_a), F.col("p.b").alias(key_b), F.col("p.gap").alias("gap")).unionAll(odd)


def _odd_pairs(t: DataFrame, known: Column, bin_: str, key_a: str, key_b: str) -> DataFrame:
    """Pairs of ``mutual_nearest`` without a gap, one a bin at most of either kind: rows without a value come last, before them those at NaN."""
    cols = []
    for s in "ab":
        there, nan = F.col(f"{s}0").isNotNull(), F.isnan("v")
        cols += [F.max(F.when(known, F.col(f"{s}1"))).alias(f"{s}_known"), F.min(F.when(nan, F.col(f"{s}0"))).alias(f"{s}_nan"), F.min(F.when(there, F.struct(f"{s}0", "v"))).alias(f"{s}_first")]
    t = t.groupBy("_bin").agg(F.max("v").alias("most"), *cols).where("a_first IS NOT NULL AND b_first IS NOT NULL")
    a, b = (F.coalesce(f"{s}_known", f"{s}_nan") for s in "ab")
    at_nan = a.isNotNull() & b.isNotNull() & (F.col("a_known").isNull() | F.col("b_known").isNull())
    none = a.isNull() | b.isNull() | (F.col("a_first.v").isNull() & F.col("b_first.v").isNull())
    pair = lambda x, y, v: F.struct(x.alias("a"), y.alias("b"), v.alias("gap"))
    both = F.array_compact(F.array(F.when(at_nan, pair(a, b, F.col("most"))), F.when(none, pair(F.col("a_first.a0"), F.col("b_first.b0"), F.when(F.lit(False), F.col("most"))))))  # NaN is the most
    return t.select("_bin", F.explode(both).alias("p")).select(F.col("_bin").alias(bin_), F.col("p.a").alias(key_a), F.col("p.b").alias(key_b), F.col("p.gap").alias("gap"))
