"""Folders: the shared scratch area and the few file operations Spark lacks."""

from __future__ import annotations

import contextlib
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder under the cluster's shared ``spark.checkpoint.dir``.

    Only a session whose driver does all work, as in tests, gets a folder of this
    machine without that setting; executors of their own could not reach it.  The
    folder is deleted when the application ends, if not before.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = _folder_of_this_machine()
    root = f"{shared.rstrip('/')}/newsloom/{label}-{uuid.uuid4().hex}"
    Folder(spark, root).delete_on_exit()
    return f"{root}/data"


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a scratch folder and read back: made once, whatever follows."""
    path = scratch_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What a query shuffles is deleted when it is done, and not when the JVM happens to
    collect its garbage: for queries that write, whose shuffles nothing reads again."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


def join_files(spark: SparkSession, parts: str, folder: str, name: str) -> None:
    """Join the files of ``parts``, by name, to one file of ``folder``: each is copied to its
    place by a task, a piece at a time.  For folders that are local paths."""
    source, target = Folder(spark, parts), Folder(spark, folder)
    sizes = source.file_sizes()
    n_bytes = sum(sizes.values())
    target.create()
    joined = target.local_path(name)
    with open(joined, "wb") as file:
        file.truncate(n_bytes)
    copies, start = [], 0
    for part in sorted(sizes):
        copies.append((source.local_path(part), joined, start))
        start += sizes[part]

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for row in batch.to_pylist():
                with open(row["part"], "rb") as part, open(row["joined"], "r+b") as file:
                    file.seek(row["start"])
                    shutil.copyfileobj(part, file, 1 << 20)
                    done += file.tell() - row["start"]
            yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["n_bytes"])

    if copies:
        places = spark.createDataFrame(copies, "part string, joined string, start bigint")
        dealt = places.repartition(len(copies), "start").mapInArrow(copy, "n_bytes bigint")
        if sum(row.n_bytes for row in dealt.collect()) != n_bytes:
            raise OSError(f"the files of {parts!r} have changed while they were joined")


@functools.cache
def _folder_of_this_machine() -> str:
    return tempfile.mkdtemp(prefix="newsloom-")


class Folder:
    """One folder of any file system Hadoop can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark = spark
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def within(self, name: str) -> Folder:
        return Folder(self._spark, f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def folders(self) -> list[str]:
        """Names of the direct sub-folders that are not private (``_x``, ``.x``)."""
        return self._names(folders=True)

    def files(self) -> list[str]:
        """Names of the direct files that are not private."""
        return self._names(folders=False)

    def file_sizes(self) -> dict[str, int]:
        """Bytes of the direct files that are not private, by name."""
        entries = {e.getPath().getName(): e.getLen() for e in self._listed() if e.isFile()}
        return {name: size for name, size in entries.items() if name[0] not in "_."}

    def is_local(self) -> bool:
        """Whether its files are files of the machines, which any program can open."""
        return self._fs.getUri().getScheme() == "file"

    def local_path(self, name: str) -> str:
        return self._local(name).toString()

    def size(self, name: str) -> int:
        """Bytes of all files below ``name``."""
        return self._fs.getContentSummary(self._path(name)).getLength()

    def _names(self, folders: bool) -> list[str]:
        entries = self._listed()
        names = (e.getPath().getName() for e in entries if e.isDirectory() == folders)
        return sorted(name for name in names if name[0] not in "_.")

    def _listed(self, attempts: int = 5) -> list:
        """Entries of the folder; none if there is none, or if it goes while it is listed."""
        try:
            return list(self._fs.listStatus(self._path("")))
        except Py4JJavaError:
            if not self.exists(""):
                return []
            if attempts == 1:
                raise
        return self._listed(attempts - 1)  # deleted and made again meanwhile

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def create(self) -> None:
        self._fs.mkdirs(self._path(""))

    def delete_on_exit(self) -> None:
        """Create the folder, and delete it when the application ends."""
        self.create()
        self._fs.deleteOnExit(self._path(""))

    def rename(self, old: str, new: str) -> None:
        """Move a folder to a name that is free; readers see all of it or nothing."""
        if self.exists(new):
            raise ValueError(f"{new!r} exists")
        target = self._path(new)
        self._fs.mkdirs(target.getParent())
        if not self._fs.rename(self._path(old), target):
            raise OSError(f"{old!r} cannot be renamed to {new!r}")

    def create_text(self, name: str, text: str) -> bool:
        """Create a small file with all of its text; False if it exists.

        Of several that create the same file at a time, one succeeds."""
        draft = self._draft(name, text)
        try:
            if self.is_local():
                # Renaming would replace a file of this machine; a link to it does not.
                links = self._jvm.java.nio.file.Files
                links.createLink(self._local(name), self._local(draft))
            else:
                self._move(draft, name, "NONE")
        except Py4JJavaError:
            if self.exists(name):
                return False
            raise
        finally:
            self.delete(draft)
        return True

    def _local(self, name: str):
        return self._jvm.java.io.File(self._path(name).toUri().getPath()).toPath()

    def _draft(self, name: str, text: str) -> str:
        """A private file next to ``name`` with this text."""
        parent, _, last = name.rpartition("/")
        draft = f"{parent}/_{last}.{uuid.uuid4().hex}" if parent else f"_{last}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(draft), False)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        return draft

    def _move(self, old: str, new: str, how: str) -> None:
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        flags = self._new_array(rename, getattr(rename, how))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._fs.getUri(), self._conf
        )
        context.rename(self._path(old), self._path(new), flags)

    def read_text(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        try:
            stream = self._fs.open(self._path(name))
        except Py4JJavaError:
            if self.exists(name):
                raise
            return None  # deleted since
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace_text(self, name: str, text: str) -> None:
        """Replace a small file in one step: readers see the old or the new text."""
        self._move(self._draft(name, text), name, "OVERWRITE")

    def _new_array(self, java_class, value):
        array = SparkContext._gateway.new_array(java_class, 1)
        array[0] = value
        return array
