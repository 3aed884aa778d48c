"""Catalogs as committed snapshots: a version lists the files that live in it, and readers take no others.

Data files go to a folder of their own first; a version is one small list,
written aside and renamed into place, so half-written runs and stray folders are never
read and a version never changes. A rename that finds its number taken means that another
writer was first, and raises.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSIONS, DATA = "_versions", "data"


class DataFile(NamedTuple):
    name: str  # below the catalog's data folder
    bytes: int
    rows: int
    part: str | None  # value of the partition column


class Snapshot(NamedTuple):
    version: int
    schema: StructType
    by: str | None
    files: list[DataFile]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    where, fs = _fs(spark, f"{path}/{VERSIONS}")
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def load(spark: SparkSession, path: str, version: int | None = None) -> Snapshot | None:
    """The last version, or a given one; None before the first."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        if version is not None:
            raise ValueError(f"{path} has no version {version}")
        return None
    version = known[-1] if version is None else version
    lines = [r.value for r in spark.read.text(f"{path}/{VERSIONS}/{version:012d}.json").collect()]  # one line per live file
    head, *rest = sorted(map(json.loads, lines), key=lambda x: "schema" not in x)
    return Snapshot(version, StructType.fromJson(head["schema"]), head["by"], [DataFile(*x["file"]) for x in rest])


def _publish(spark: SparkSession, path: str, s: Snapshot) -> None:
    lines = [json.dumps({"schema": json.loads(s.schema.json()), "by": s.by}), *[json.dumps({"file": list(f)}) for f in s.files]]
    side, fs = _fs(spark, f"{path}/{VERSIONS}/.{uuid.uuid4().hex}")
    out = fs.create(side)
    out.write(bytearray(("\n".join(lines) + "\n").encode()))
    out.close()
    place, _ = _fs(spark, f"{path}/{VERSIONS}/{s.version:012d}.json")
    if fs.exists(place) or not fs.rename(side, place):
        fs.delete(side, False)
        raise RuntimeError(f"version {s.version} of {path} was written by another run")


def _place() -> Column:
    """The path of a row's file as it is named in its folder; a URL's plus sign is no space."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _written(spark: SparkSession, df: DataFrame, path: str, by: str | None) -> list[DataFile]:
    """df's rows in new files, counted as they are read back."""
    folder = uuid.uuid4().hex
    root = f"{path}/{DATA}/{folder}"
    writer = df.write
    (writer.partitionBy(by) if by else writer).parquet(root)
    where, fs = _fs(spark, root)
    sizes, files = {}, fs.listFiles(where, True)
    while files.hasNext():
        f = files.next()
        name = f.getPath().toUri().getPath().split(f"/{folder}/", 1)[1]
        if name.endswith(".parquet"):
            sizes[name] = f.getLen()
    name = F.regexp_extract(_place(), f"/{folder}/(.*)$", 1)
    part = F.col(by).cast("string") if by else F.lit(None).cast("string")
    counted = spark.read.schema(df.schema).parquet(root).select(name.alias("name"), part.alias("part")).groupBy("name", "part").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per file
    known = {c["name"]: (c.n, c.part) for c in counted}
    return [DataFile(f"{folder}/{n}", b, *known[n]) for n, b in sorted(sizes.items()) if n in known]


def commit(spark: SparkSession, df: DataFrame, path: str, by: str | None = None, replace: bool = False) -> Snapshot:
    """A new version with df's rows added, or in place of all others."""
    old = load(spark, path)
    if old and old.by != by:
        raise ValueError(f"the catalog is partitioned by {old.by}, not by {by}")
    new = _written(spark, df, path, by)
    s = Snapshot(old.version + 1 if old else 0, df.schema, by, new if replace or not old else [*old.files, *new])
    _publish(spark, path, s)
    return s


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Rows of a version's live files."""
    s = load(spark, path, version)
    if s is None:
        raise ValueError(f"{path} has no committed version")
    if not s.files:
        return spark.createDataFrame([], s.schema)
    if s.by is None:
        return spark.read.schema(s.schema).parquet(*[f"{path}/{DATA}/{f.name}" for f in s.files])
    # files of one folder share a base, from which the partition column's values are taken
    folders: dict[str, list[str]] = {}
    for f in s.files:
        folders.setdefault(f.name.split("/", 1)[0], []).append(f"{path}/{DATA}/{f.name}")
    out = None
    for folder, names in folders.items():
        t = spark.read.schema(s.schema).option("basePath", f"{path}/{DATA}/{folder}").parquet(*names).select(*s.schema.names)
        out = t if out is None else out.unionAll(t)
    return out


def pack_files(files: list[DataFile], target: int) -> list[list[DataFile]]:
    """Groups of small files of one partition value that fit ``target`` bytes, the largest first into the first group with room; lone files stay as they are."""
    groups: list[tuple[int, list[DataFile]]] = []
    for f in sorted((f for f in files if f.bytes < target), key=lambda f: (-f.bytes, f.name)):
        for i, (room, held) in enumerate(groups):
            if f.bytes <= room:
                groups[i] = (room - f.bytes, [*held, f])
                break
        else:
            groups.append((target - f.bytes, [f]))
    return [held for _, held in groups if len(held) > 1]


def compact(spark: SparkSession, path: str, target: int = 128 << 20) -> Snapshot | None:
    """A version in which small files are merged to about ``target`` bytes, per partition value; other files stay. None if nothing is to be merged.

    Planned from the sizes of the files alone. Each group becomes one file, whatever
    share of the rows its partition value has; rows are recounted before the version is published.
    """
    s = load(spark, path)
    by_part: dict[str | None, list[DataFile]] = {}
    for f in s.files if s else []:
        by_part.setdefault(f.part, []).append(f)
    groups = [g for files in by_part.values() for g in pack_files(files, target)]
    if not groups:
        return None
    merged = {f.name: i for i, g in enumerate(groups) for f in g}
    folders: dict[str, list[str]] = {}
    for n in merged:
        folders.setdefault(n.split("/", 1)[0], []).append(f"{path}/{DATA}/{n}")
    plan = spark.createDataFrame([(n, i) for n, i in merged.items()], "_name string, _group int")
    rows = None
    for folder, names in folders.items():
        name = F.regexp_extract(_place(), f"/({folder}/.*)$", 1)
        t = spark.read.schema(s.schema).option("basePath", f"{path}/{DATA}/{folder}").parquet(*names).select(*s.schema.names, name.alias("_name"))
        rows = t if rows is None else rows.unionAll(t)
    # names of files are as many as the plan's rows, which the driver holds anyway
    rows = rows.join(F.broadcast(plan), "_name").repartitionById(len(groups), F.col("_group")).select(*s.schema.names)
    new = _written(spark, rows, path, s.by)
    if sum(f.rows for f in new) != sum(f.rows for g in groups for f in g):
        raise RuntimeError("compaction changed the number of rows")
    out = Snapshot(s.version + 1, s.schema, s.by, [f for f in s.files if f.name not in merged] + new)
    _publish(spark, path, out)
    return out


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes versions before the last ``keep`` and data folders without a live file in those; returns the folders deleted. No writer may be at work."""
    known = versions(spark, path)
    live = {f.name.split("/", 1)[0] for v in known[-keep:] for f in load(spark, path, v).files}
    where, fs = _fs(spark, f"{path}/{DATA}")
    gone = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName() not in live] if fs.exists(where) else []
    for v in known[:-keep]:
        fs.delete(_fs(spark, f"{path}/{VERSIONS}/{v:012d}.json")[0], False)
    for p in gone:
        fs.delete(p, True)
    return len(gone)
