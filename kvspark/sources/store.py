"""A table on Parquet: mutation files, a manifest log, an atomic pointer.

``path/data/`` holds the folders of mutation rows, one for each committed write;
``path/manifest/`` the manifest versions as JSON, ``path/CURRENT`` the name of the
newest one. A write is committed when CURRENT names a manifest that lists its
folder; readers go through the manifest, so that folders of failed writes are
never seen. Files are touched through Hadoop's file systems only.
"""

from __future__ import annotations

import json
import logging
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvspark.operators import compact, read
from kvspark.operators.log import Snapshot, sequenced

#: name -> kind, by the file's last part
KINDS = {"sst": "table", "log": "log", "json": "manifest", "dbtmp": "temp"}


@dataclass(frozen=True)
class Options:
    """Options of a store. Some are accepted without effect, since nothing reads them."""

    create_if_missing: bool = True
    error_if_exists: bool = False
    write_buffer_size: int = 4 << 20
    block_size: int = 4 << 10
    block_restart_interval: int = 16
    compression: str = "snappy"
    verify_checksums: bool = True
    comparator: str = "bytewise"
    paranoid_checks: bool = False  # no effect
    cache_size: int = 0  # no effect
    fill_cache: bool = True  # no effect
    sync: bool = False  # no effect: a committed write is always durable
    logger: logging.Logger = field(default_factory=lambda: logging.getLogger("kvspark"))


class Files:
    """The few file operations that the store needs."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def is_folder(self, name: str) -> bool:
        return self.exists(name) and self.fs.getFileStatus(self.path(name)).isDirectory()

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.exists(folder) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str, overwrite: bool) -> None:
        """Write beside the name, then rename: readers see all of it or nothing."""
        temp = f"{name}.{uuid.uuid4().hex}.dbtmp"
        stream = self.fs.create(self.path(temp), False)
        stream.write(bytearray(text.encode()))
        stream.hsync()
        stream.close()
        if not self.fs.rename(self.path(temp), self.path(name)):
            if not overwrite:
                self.fs.delete(self.path(temp), False)
                raise FileExistsError(name)
            self.fs.delete(self.path(name), False)
            self.fs.rename(self.path(temp), self.path(name))

    def create_new(self, name: str) -> bool:
        return self.fs.createNewFile(self.path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class KVTable:
    """An open store. Use it as a context manager, or call ``close``."""

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None, key: str = "binary", value: str = "binary"):
        self.spark, self.root, self.options = spark, path.rstrip("/"), options or Options()
        self.shape = f"uk {key}, seq long, vt int, val {value}"
        self.files, self.snapshots, self.closed = Files(spark, path), {}, False
        if self.files.exists(self.root) and not self.files.is_folder(self.root):
            raise ValueError(f"{path} is not a folder")
        there = self.files.exists(f"{self.root}/CURRENT")
        if there and self.options.error_if_exists:
            raise ValueError(f"{path} exists")
        if not there and not self.options.create_if_missing:
            raise ValueError(f"{path} does not exist")
        self.files.fs.mkdirs(self.files.path(self.root))
        if not self.files.create_new(f"{self.root}/LOCK"):
            raise ValueError(f"{path} is in use")
        try:
            if not there:
                self._commit({"version": 0, "comparator": self.options.comparator, "last_seq": 0, "folders": []})
            self.state = self._recover()
        except Exception:
            self.files.delete(f"{self.root}/LOCK")
            raise

    def __enter__(self) -> KVTable:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        if not self.closed:
            self.closed = True
            self.files.delete(f"{self.root}/LOCK")

    def _open(self) -> None:
        if self.closed:
            raise ValueError("the store is closed")

    def _commit(self, state: dict) -> None:
        name = f"manifest/{state['version']:06d}.json"
        self.files.write(f"{self.root}/{name}", json.dumps(state), overwrite=False)
        self.files.write(f"{self.root}/CURRENT", name, overwrite=True)
        self.state = state

    def _recover(self) -> dict:
        """The state that CURRENT names; the order must be the one that the store was made with."""
        state = json.loads(self.files.read(f"{self.root}/{self.files.read(f'{self.root}/CURRENT')}"))
        for needed in ("version", "comparator", "last_seq", "folders"):
            if needed not in state:
                raise ValueError(f"manifest without {needed}")
        if state["comparator"] != self.options.comparator:
            raise ValueError(f"made with order {state['comparator']}, opened with {self.options.comparator}")
        return state

    @property
    def last_seq(self) -> int:
        return self.state["last_seq"]

    def log(self) -> DataFrame:
        """All committed mutations."""
        self._open()
        folders = [f"{self.root}/data/{name}" for name in self.state["folders"]]
        if not folders:
            return self.spark.createDataFrame([], self.shape)
        return self.spark.read.schema(self.shape).parquet(*folders)

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.select("uk", "seq", "vt", "val").write.option("compression", self.options.compression).parquet(f"{self.root}/data/{name}")
        return name

    def write(self, batch: DataFrame) -> Snapshot:
        """Apply op_ordinal (from 1, without gaps), op (put, delete), uk, val as one atomic batch."""
        self._open()
        n = batch.count()
        if n == 0:  # takes no sequence number, writes nothing
            return self.snapshot(hold=False)
        vt = F.when(F.col("op") == "put", 1).when(F.col("op") == "delete", 0).otherwise(F.raise_error(F.lit("unknown op")))
        rows = sequenced(batch, self.last_seq, "op_ordinal").withColumn("vt", vt.cast("int"))
        if rows.where("uk IS NULL OR vt = 1 AND val IS NULL").limit(1).count():
            raise ValueError("null key or value")
        kind = self.spark.createDataFrame([], self.shape).schema
        rows = rows.withColumn("val", F.when(F.col("vt") == 1, F.col("val")).otherwise(F.lit("").cast(kind["val"].dataType)))
        name = self._write(rows)
        self._commit(self.state | {"version": self.state["version"] + 1, "last_seq": self.last_seq + n, "folders": [*self.state["folders"], name]})
        return self.snapshot(hold=False)

    def _rows(self, operations: list[tuple]) -> DataFrame:
        kind = self.spark.createDataFrame([], self.shape).schema
        shape = f"op_ordinal int, op string, uk {kind['uk'].dataType.simpleString()}, val {kind['val'].dataType.simpleString()}"
        return self.spark.createDataFrame([(i + 1, *o) for i, o in enumerate(operations)], shape)

    def put(self, key, value) -> Snapshot:
        return self.write(self._rows([("put", key, value)]))

    def delete(self, key) -> Snapshot:
        return self.write(self._rows([("delete", key, None)]))

    def write_batch(self, operations: list[tuple]) -> Snapshot:
        """[(op, key, value or None)] in order; the last one on a key wins."""
        return self.write(self._rows(operations))

    def snapshot(self, hold: bool = True) -> Snapshot:
        """The state as it is; held ones keep their versions from compaction until released."""
        self._open()
        taken = Snapshot(self.state["version"], self.last_seq)
        if hold:
            self.snapshots[taken] = self.snapshots.get(taken, 0) + 1
        return taken

    def release(self, taken: Snapshot) -> None:
        held = self.snapshots.get(taken, 0)
        if held > 1:
            self.snapshots[taken] = held - 1
        else:
            self.snapshots.pop(taken, None)

    def get(self, key, at: Snapshot | None = None):
        """The value, or None if the key is absent or deleted."""
        row = read.get(self.log(), key, at.seq if at else None).first()
        return None if row is None else row["val"]

    def scan(self, at: Snapshot | None = None, descending: bool = False) -> DataFrame:
        return read.scan(self.log(), at.seq if at else None, descending=descending)

    def range(self, start=None, limit=None, at: Snapshot | None = None) -> DataFrame:
        return read.key_range(self.log(), start, limit, at.seq if at else None).orderBy("uk")

    def compact_range(self, start=None, limit=None) -> None:
        """Rewrite the range without what neither a held snapshot nor a later reader can see."""
        self._open()
        oldest = min((s.seq for s in self.snapshots), default=self.last_seq)
        rows = compact.compact_range(self.log(), start, limit, oldest)
        parts = max(1, self.spark.sparkContext.defaultParallelism)
        name = self._write(rows.repartitionByRange(parts, "uk").sortWithinPartitions("uk", F.desc("seq")))
        self._commit(self.state | {"version": self.state["version"] + 1, "folders": [name]})

    def collect_garbage(self) -> list[str]:
        """Delete data folders and manifests that the state doesn't name; their names."""
        self._open()
        live = set(self.state["folders"])
        gone = [f"data/{n}" for n in self.files.names(f"{self.root}/data") if n not in live]
        current = self.files.read(f"{self.root}/CURRENT")
        gone += [f"manifest/{n}" for n in self.files.names(f"{self.root}/manifest") if f"manifest/{n}" != current]
        for name in gone:
            self.files.delete(f"{self.root}/{name}")
        return gone

    def stats(self) -> DataFrame:
        """property and value: what the store tells about itself."""
        rows = self.log().agg(F.count("*").alias("n"), F.countDistinct("uk").alias("k"), F.sum(F.octet_length("val")).alias("b")).first()
        told = {"versions": rows["n"], "keys": rows["k"], "value_bytes": rows["b"] or 0, "last_seq": self.last_seq,
                "folders": len(self.state["folders"])}
        return self.spark.createDataFrame(list(told.items()), "property string, value long")

    def get_property(self, name: str) -> int | None:
        row = self.stats().where(F.col("property") == name).first()
        return None if row is None else row["value"]


def destroy(spark: SparkSession, path: str) -> None:
    """Delete what a store made, and the folder if nothing else is in it."""
    files = Files(spark, path)
    for name in ("data", "manifest", "CURRENT", "LOCK"):
        files.delete(f"{path.rstrip('/')}/{name}")
    if files.exists(path) and not files.names(path):
        files.delete(path)


def repair(spark: SparkSession, path: str) -> None:
    raise NotImplementedError("stores can't be repaired")
