"""A hierarchical container: groups and typed n-dimensional datasets under one folder.

The catalog is a table (path, parent, name, kind, dtype, dims, tag); every dataset is a Parquet table (idx, value).
Ranks go up to five; values are doubles, strings, bytes, or structs and arrays of them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG = "path string, parent string, name string, kind string, dtype string, dims array<long>, tag string, location string"
MAX_RANK = 5


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder under spark.checkpoint.dir, removed when the application ends; a folder of this machine where that
    is unset, as in tests."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}/gridloom"
    path = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


class Container:
    """Catalog changes are small writes of one JSON file by the driver; data go through Spark."""

    def __init__(self, spark: SparkSession, folder: str, overwrite: bool = False, readonly: bool = False):
        self.spark, self.folder, self.readonly = spark, folder.rstrip("/"), readonly
        self._entries: dict[str, dict] = {}
        self._open = True
        self._mounts: dict[str, Container] = {}
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/catalog.json")
        self._fs, self._file = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path
        if self._fs.exists(path) and not overwrite:
            text = spark.read.text(f"{self.folder}/catalog.json", wholetext=True).first()
            self._entries = json.loads(text["value"]) if text else {}
        elif not readonly:
            self.flush()

    def flush(self) -> None:
        if self.readonly:
            raise PermissionError("opened for reading")
        out = self._fs.create(self._file, True)
        out.write(bytearray(json.dumps(self._entries).encode()))
        out.close()

    def reopen(self) -> Container:
        return Container(self.spark, self.folder, readonly=self.readonly)

    def catalog(self) -> DataFrame:
        self._check()
        rows = [(p, p.rpartition("/")[0] or "/", p.rpartition("/")[2], e["kind"], e.get("dtype"), e.get("dims"), e.get("tag"), e.get("location")) for p, e in self._entries.items()]
        df = self.spark.createDataFrame(rows, CATALOG)
        for at, other in self._mounts.items():
            inner = other.catalog()
            df = df.unionByName(inner.withColumn("path", F.concat(F.lit(at), "path")).withColumn("parent", F.when(F.col("parent") == "/", F.lit(at)).otherwise(F.concat(F.lit(at), "parent"))))
        return df

    def create_group(self, path: str) -> None:
        parent = path.rpartition("/")[0]
        if parent and parent not in self._entries:
            raise KeyError(parent)
        if path in self._entries:
            raise FileExistsError(path)
        self._entries[path] = {"kind": "group", "id": self._next_id()}
        self.flush()

    def _next_id(self) -> int:
        return 1 + max((e.get("id", 0) for e in self._entries.values()), default=0)

    @classmethod
    def new(cls, spark: SparkSession, folder: str, overwrite: bool = False) -> Container:
        """A new container; raises where there is one, unless it may be overwritten."""
        found = cls(spark, folder, overwrite, readonly=not overwrite)
        if not overwrite and found._fs.exists(found._file):
            raise FileExistsError(folder)
        return cls(spark, folder, overwrite)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, mode: str = "rw") -> Container:
        """A container that exists; mode r or readonly forbids changes."""
        found = cls(spark, folder, readonly=True)
        if not found._fs.exists(found._file):
            raise FileNotFoundError(folder)
        found.readonly = mode in ("r", "readonly")
        return found

    def name(self) -> str:
        return self.folder.rpartition("/")[2]

    def id(self) -> int:
        return 0

    def is_open(self) -> bool:
        return self._open

    def close(self) -> bool:
        """Writes the catalog and ends the use of this object; its groups and datasets close with it."""
        if self._open and not self.readonly:
            self.flush()
        was, self._open = self._open, False
        return was

    def _check(self) -> None:
        if not self._open:
            raise ValueError("closed")

    def open_group(self, path: str) -> Group:
        return Group(self, path)

    def open_dataset(self, path: str) -> Dataset:
        return Dataset(self, path)

    def get_groups(self, path: str = "/") -> DataFrame:
        return list_children(self.catalog(), path, "group")

    def get_datasets(self, path: str = "/") -> DataFrame:
        return list_children(self.catalog(), path, "dataset")

    def get_all_groups(self, path: str = "/") -> DataFrame:
        return list_below(self.catalog(), path)

    def get_parent(self, path: str) -> str:
        return path.rpartition("/")[0] or "/"

    def write_data(self, path: str, df: DataFrame, dims: list[int], dtype: str = "float", tag: str | None = None) -> None:
        """A whole dataset (idx ARRAY<BIGINT>, value)."""
        if len(dims) > MAX_RANK:
            raise ValueError(f"at most {MAX_RANK} dimensions")
        location = f"{self.folder}/data/{uuid.uuid4().hex}"
        df.select("idx", "value").write.mode("overwrite").parquet(location)
        self._entries[path] = {"kind": "dataset", "id": self._next_id(), "dtype": dtype, "dims": list(dims), "tag": tag, "location": location}
        self.flush()

    def _entry(self, path: str) -> dict:
        for at, other in self._mounts.items():
            if path.startswith(f"{at}/"):
                return other._entry(path[len(at) :])
        return self._entries[path]

    def dims(self, path: str) -> list[int]:
        return self._entry(path)["dims"]

    def datatype(self, path: str) -> str:
        return self._entry(path)["dtype"]

    def tag(self, path: str, value: str | None = None) -> str | None:
        """The tag of a dataset, set first where one is given."""
        if value is not None:
            self._entry(path)["tag"] = value
            self.flush()
        return self._entry(path).get("tag")

    def read_data(self, path: str) -> DataFrame:
        self._check()
        return self.spark.read.parquet(self._entry(path)["location"])

    def read_data_slice(self, path: str, start: list[int], stride: list[int], count: list[int], block: list[int]) -> DataFrame:
        return hyperslab(self.read_data(path), start, stride, count, block)

    def move(self, path: str, group: str, name: str | None = None) -> str:
        """Moves a group with all below it, or a dataset."""
        target = f"{'' if group == '/' else group}/{name or path.rpartition('/')[2]}"
        if group != "/" and group not in self._entries or target in self._entries:
            raise KeyError(group if group not in self._entries else target)
        self._entries = {target + p[len(path) :] if p == path or p.startswith(f"{path}/") else p: e for p, e in self._entries.items()}
        self.flush()
        return target

    def rename(self, path: str, name: str) -> str:
        return self.move(path, self.get_parent(path), name)

    def mount(self, path: str, other: Container) -> None:
        self._mounts[path] = other

    def unmount(self, path: str) -> None:
        del self._mounts[path]


class Handle:
    """An open group or dataset of a container."""

    kind = ""

    def __init__(self, container: Container, path: str):
        if container._entry(path)["kind"] != self.kind:
            raise KeyError(path)
        self._container, self.path, self._open = container, path, True

    def file(self) -> Container:
        return self._container

    def name(self) -> str:
        return self.path.rpartition("/")[2]

    def id(self) -> int:
        return self._container._entry(self.path).get("id", 0)

    def is_open(self) -> bool:
        return self._open and self._container.is_open()

    def close(self) -> bool:
        was, self._open = self._open, False
        return was

    def _check(self) -> None:
        if not self.is_open():
            raise ValueError("closed")

    def get_parent(self) -> str:
        return self._container.get_parent(self.path)

    def move(self, group: str, name: str | None = None) -> str:
        self._check()
        self.path = self._container.move(self.path, group, name)
        return self.path

    def rename(self, name: str) -> str:
        self._check()
        self.path = self._container.rename(self.path, name)
        return self.path


class Group(Handle):
    kind = "group"

    def get_groups(self) -> DataFrame:
        self._check()
        return self._container.get_groups(self.path)

    def get_all_groups(self) -> DataFrame:
        self._check()
        return self._container.get_all_groups(self.path)

    def get_datasets(self) -> DataFrame:
        self._check()
        return self._container.get_datasets(self.path)

    def create_group(self, name: str) -> Group:
        self._container.create_group(f"{self.path}/{name}")
        return Group(self._container, f"{self.path}/{name}")

    def open_group(self, name: str) -> Group:
        return Group(self._container, f"{self.path}/{name}")

    def open_dataset(self, name: str) -> Dataset:
        return Dataset(self._container, f"{self.path}/{name}")


class Dataset(Handle):
    kind = "dataset"

    def group(self) -> Group | None:
        """The group that holds it; None at the top."""
        parent = self.get_parent()
        return None if parent == "/" else Group(self._container, parent)

    def dims(self) -> list[int]:
        return self._container.dims(self.path)

    def datatype(self) -> str:
        return self._container.datatype(self.path)

    def tag(self, value: str | None = None) -> str | None:
        return self._container.tag(self.path, value)

    def read_data(self) -> DataFrame:
        self._check()
        return self._container.read_data(self.path)

    def write_data(self, df: DataFrame) -> None:
        """Replaces the whole data; type, dimensions and tag stay."""
        self._check()
        self._container.write_data(self.path, df, self.dims(), self.datatype(), self.tag())

    def read_data_slice(self, start: list[int], stride: list[int], count: list[int], block: list[int]) -> DataFrame:
        self._check()
        return self._container.read_data_slice(self.path, start, stride, count, block)


def list_children(catalog: DataFrame, path: str, kind: str) -> DataFrame:
    return catalog.where((F.col("parent") == path) & (F.col("kind") == kind)).select("name")


def list_below(catalog: DataFrame, path: str = "/") -> DataFrame:
    """(path, depth) of all groups below a path."""
    prefix = "/" if path == "/" else f"{path}/"
    return catalog.where((F.col("kind") == "group") & F.col("path").startswith(prefix)).select("path", F.size(F.split("path", "/")).alias("depth"))


def in_slab(idx: Column, start: list[int], stride: list[int], count: list[int], block: list[int]) -> Column:
    """True for indices of a hyperslab; bounds come first, so that readers can skip by them."""
    inside = F.lit(True)
    for d, (s, t, c, b) in enumerate(zip(start, stride, count, block)):
        x = idx[d]
        inside = inside & (x >= s) & (x < s + (c - 1) * t + b) & (F.pmod(x - s, F.lit(t)) < b)
    return inside


def hyperslab(df: DataFrame, start: list[int], stride: list[int], count: list[int], block: list[int]) -> DataFrame:
    return df.where(in_slab(F.col("idx"), start, stride, count, block))
