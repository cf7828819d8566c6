"""A folder of numbered commits, through the file system that Spark uses for its path."""

from __future__ import annotations

import json
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


_local: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a local one only on a local master without it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="lodestrata-"))
    return _local[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    files = Files(spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}")
    files.fs.deleteOnExit(files.at(""))
    return files.root


def written(rows: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder once and read back: every later pass sees the same
    rows in the same partitions, and a lost executor costs none of what came before."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


class Files:
    """Small files under a root."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.at(name))

    def names(self, folder: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.at(folder))) if self.exists(folder) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, self.jvm.java.nio.charset.StandardCharsets.UTF_8)
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that must not exist; False where it does."""
        if self.exists(name):
            return False
        # the text goes to a hidden file first, so that no reader meets half a commit; linking it to
        # its name is what only one writer can do
        hidden = f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        out = self.fs.create(self.at(hidden), False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at("").toUri())
        try:
            none = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
            options = self.jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
            options[0] = none
            context.rename(context.makeQualified(self.at(hidden)), context.makeQualified(self.at(name)), options)
        except Exception as e:
            self.delete(hidden)
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        return True

    def overwrite(self, path: str, data: bytes) -> None:
        """Replace a file, whose whole path is given."""
        out = self.fs.create(self.jvm.org.apache.hadoop.fs.Path(path), True)
        out.write(bytearray(data))
        out.close()

    def delete(self, name: str = "") -> None:
        self.fs.delete(self.at(name), True)

    def age(self, name: str) -> float:
        """Seconds since a file or folder was last changed."""
        return time.time() - self.fs.getFileStatus(self.at(name)).getModificationTime() / 1000

    def size(self, name: str = "") -> int:
        """Bytes of a file, or of all files below a folder."""
        return self.fs.getContentSummary(self.at(name)).getLength()


class CommitLog:
    """Commits 1, 2, ... of JSON objects, and now and then one that holds all before it."""

    FOLDER = "_manifest"

    def __init__(self, files: Files):
        self.files = files
        self._known: dict[int, dict] = {}

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(self.FOLDER) if n.endswith(".json") and n[0] != "."]

    def read(self, version: int) -> dict:
        if version not in self._known:
            self._known[version] = json.loads(self.files.read(f"{self.FOLDER}/{version:020d}.json"))
        return self._known[version]

    def commit(self, version: int, entry: dict) -> bool:
        """Whether this entry became the version; False where another writer's did."""
        return self.files.create(f"{self.FOLDER}/{version:020d}.json", json.dumps(entry, sort_keys=True))

    def forget(self, version: int) -> None:
        """Delete a commit that no version to be read needs."""
        self.files.delete(f"{self.FOLDER}/{version:020d}.json")
        self._known.pop(version, None)
