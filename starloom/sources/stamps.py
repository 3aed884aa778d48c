"""Small binary array files (NPZ) as a data source: ``spark.read.format("stamps")``.

    spark.dataSource.register(StampSource)
    spark.read.format("stamps").option("meta", "vec_id bigint, label int").load("file:/...")

Rows are path, data, shape, the stated ``meta_*`` fields and error. With a schema of
some of these columns, only those members of a file are decoded. A partition
holds files of about ``partitionBytes`` (64 MB), each counted with ``openCost`` (64 KB) more, so
thousands of files of a kilobyte are one task. A file that cannot be read is a row with its error.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


@dataclass
class Files(InputPartition):
    paths: list[str]


class StampReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.uri, self.array, self.schema = options["path"], options.get("array", "data"), schema
        self.target, self.open_cost = int(options.get("partitionBytes", 64 << 20)), int(options.get("openCost", 64 << 10))

    def partitions(self) -> list[Files]:
        from pyarrow.fs import FileSelector, FileSystem, FileType

        fs, root = FileSystem.from_uri(self.uri)
        out, size = [[]], 0
        for f in sorted(fs.get_file_info(FileSelector(root, recursive=True, allow_not_found=True)), key=lambda f: f.path):
            if f.type == FileType.File and f.path.endswith(".npz"):
                if out[-1] and size + f.size + self.open_cost > self.target:
                    out.append([])
                    size = 0
                out[-1].append(f.path)
                size += f.size + self.open_cost
        return [Files(x) for x in out]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, _ = FileSystem.from_uri(self.uri)
        arrow = to_arrow_schema(self.schema)
        for lo in range(0, len(partition.paths), 500):
            rows = [self.one(fs, p) for p in partition.paths[lo : lo + 500]]
            yield pa.RecordBatch.from_pylist(rows, arrow)

    def one(self, fs, path: str) -> dict:
        import numpy as np

        row = dict.fromkeys(self.schema.names)
        if "path" in row:
            row["path"] = path
        try:
            with fs.open_input_file(path) as f, np.load(io.BytesIO(f.read()), allow_pickle=False) as z:
                a = z[self.array] if {"data", "shape", "error"} & row.keys() else None
                if "data" in row:
                    row["data"] = a.astype("float32").ravel().tolist()
                if "shape" in row:
                    row["shape"] = list(a.shape)
                for c in row:
                    if c.startswith("meta_") and c in z.files:
                        row[c] = z[c].item() if z[c].ndim == 0 else z[c].tolist()
        except Exception as e:  # noqa: BLE001  reported in the row
            row = dict.fromkeys(row) | {k: v for k, v in (("path", path), ("error", f"{type(e).__name__}: {e}")) if k in row}
        return row


class StampSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stamps"

    def schema(self) -> str:
        meta = [x.strip() for x in self.options.get("meta", "").split(",") if x.strip()]
        return ", ".join(["path string", "data array<float>", "shape array<int>", *[f"meta_{x}" for x in meta], "error string"])

    def reader(self, schema: StructType) -> StampReader:
        return StampReader(self.options, schema)


def read_stamps(spark: SparkSession, path: str, meta: str = "", columns: str | None = None, **options: str) -> DataFrame:
    """Rows of all NPZ files below a folder; ``columns`` states the schema of the wanted columns alone."""
    spark.dataSource.register(StampSource)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    r = spark.read.format("stamps").options(meta=meta, **options)
    return (r.schema(columns) if columns else r).load(uri)
