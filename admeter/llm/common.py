"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that a task remembers the hashes of; beyond it, it starts afresh.
REMEMBERED = 300_000
#: Rows of a batch sent to Python.  Texts can be long, so batches are small.
BATCH_ROWS = 512
#: Whether Spark deletes the shuffle files of a query when it ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_folders: dict[str, str] = {}


def small_batches(spark: SparkSession) -> None:
    """Keep the batches sent to Python small: a batch of long texts must fit a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, a local one on a single machine, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = "file://" + tempfile.mkdtemp(prefix="admeter-")
    return _folders[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; Hadoop deletes it when the session ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


class Scratch:
    """Tables that are saved while it is open and deleted when it closes, but for those ``kept``; what it keeps is read from its own files.

    What is kept belongs to the scratch around it, if there is one.
    """

    _open: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        Scratch._open.append(self)
        return self

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        found, path, around = saved(df, name), self.paths.pop(), Scratch._open[:Scratch._open.index(self)]
        if around:
            around[-1].paths.append(path)
        return found

    def __exit__(self, *_: object) -> None:
        Scratch._open.remove(self)
        jvm, configuration = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(configuration).delete(target, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later jobs start from the files, not from its lineage.

    As nothing reads the shuffles of the write again, Spark deletes their files when it ends.
    """
    path = new_folder(df.sparkSession, name)
    if Scratch._open:
        Scratch._open[-1].paths.append(path)
    conf = df.sparkSession.conf
    before = conf.get(CLEANED, None)
    conf.set(CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANED) if before is None else conf.set(CLEANED, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class WordHashes(dict):
    """64-bit hashes of words given as bytes."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: bytes) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        words = text.split()  # bytes split at ASCII white space only: \x20 and \x09-\x0D
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


class Words:
    """The words of several texts in one array, each with its text, its place and how many follow."""

    def __init__(self, texts: list[bytes | None], hashes: WordHashes):
        each = [hashes.of(t) if t else np.empty(0, np.uint64) for t in texts]
        self.count = np.array([len(x) for x in each], np.int64)
        self.hash = np.concatenate(each) if each else np.empty(0, np.uint64)
        self.start = np.cumsum(self.count) - self.count
        self.text = np.repeat(np.arange(len(each)), self.count)
        self.place = np.arange(len(self.hash)) - np.repeat(self.start, self.count)
        self.left = np.repeat(self.count, self.count) - self.place

    def windows(self, size: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
        """A hash of the ``size`` words from each place on; only places with ``left >= size`` hold a window."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        base = np.uint64(seed | 5)  # odd; a sum over powers of it is taken modulo 2**64
        out = np.zeros(n, np.uint64)
        for i in range(size):
            out *= base
            out += self.hash[i:i + n]
        return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(29))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def without(df: DataFrame, name: str) -> DataFrame:
    """``df`` without a column of that name, in whatever case."""
    return df.drop(*[c for c in df.columns if c.lower() == name.lower()])


def packed(df: DataFrame, text: str) -> DataFrame:
    """(_text, _rest): the text, and a struct of all other columns, whose names can then clash with none."""
    others = [c for c in df.columns if c != text]
    rest = F.struct(*[df[f"`{c}`"].alias(c) for c in others]) if others else F.struct(F.lit(None).alias("_"))
    return df.select(F.col(f"`{text}`").cast("string").alias("_text"), rest.alias("_rest"))


def unpacked(df: DataFrame, columns: list[str], text: str, value: Column) -> DataFrame:
    """The ``columns`` of a table that was ``packed``, with ``value`` as the text."""
    return df.select(*[value.alias(c) if c == text else F.col("_rest").getField(c).alias(c) for c in columns])


def signed(x: np.ndarray) -> pa.Array:
    """64-bit values as the longs of Spark."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def repeats(value: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of one of each equal value, whether it is found again, and the places of the others."""
    if not len(value):
        return np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)
    order = np.argsort(value, kind="stable")
    new = np.append(True, value[order][1:] != value[order][:-1])
    if second is not None:
        new |= np.append(True, second[order][1:] != second[order][:-1])
    many = np.diff(np.append(np.flatnonzero(new), len(order))) > 1
    return order[new], many, order[~new]
