"""What the corpus operators share: the shared folder, table reading, words."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a class for Java and Python expressions.
SPACE = r"[\x20\x09-\x0D]"

WORD = re.compile(r"\w+")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only a local session that has none (as in tests) gets a local one; on a cluster that would be a folder of the
    driver's alone, and is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="ridgeline-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


_scratch: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder; inside a `scratch` block it goes when the block ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for own in _scratch[-1:]:
        own.append(at)
    return at


def drop(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What the block keeps in the shared folder is removed at its end; its results must be written by then. Without such
    a block intermediate data stay there, as a DataFrame that was returned may read them at any time."""
    _scratch.append([])
    try:
        yield
    finally:
        for at in _scratch.pop():
            drop(spark, at)


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """df, computed once, written to the shared folder and read from there: a short lineage, and sizes that Spark knows."""
    spark, at = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a small file that gives Spark fewer tasks than there are cores is dealt out evenly."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


_memos: list[dict] = []


class Memo(dict):
    """A dict that computes what it lacks and forgets everything at `most` entries, so that memory stays bounded."""

    def __init__(self, make, most: int = 1_000_000):
        super().__init__()
        self.make, self.most = make, most
        _memos.append(self)

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


_MULTIPLIERS = np.random.default_rng(20).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


word_hashes = Memo(xxhash.xxh3_64_intdigest, 150_000)


def forget(*but: dict) -> None:
    """Empties this worker's memos, but for some, and gives the memory back."""
    held = [m for m in _memos if m and not any(m is x for x in but)]
    for memo in held:
        memo.clear()
    if held:
        with suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def tidy(work: Callable) -> Callable:
    """work (a task's function over its batches), before and after which the worker forgets: Spark keeps workers between
    tasks, and an executor must hold them beside all that comes later."""

    def run(batches: Iterator) -> Iterator:
        forget()
        try:
            yield from work(batches)
        finally:
            forget()

    return run


def in_bytes(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes, or of one row."""
    for batch in batches:
        rows = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shingles(words: list[str], size: int = 5) -> np.ndarray:
    """Hashes of the runs of `size` words; of all words at once if there are fewer; of none if there are none."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h, size = np.fromiter((word_hashes[w] for w in words), np.uint64, n), min(size, n)
    total = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        total += h[k : n - size + 1 + k] * _MULTIPLIERS[k]
    return mix(total)


def packed_union(rows: DataFrame, bits: int, segments: int = 64) -> np.ndarray:
    """A packed bit array with a bit set for each value (long, below `bits`) in the single column of rows.

    Tasks mark their own bits, marks are merged by segment as they stream, and the driver gets bits / 8 bytes."""
    size = bits // segments
    schema = pa.schema([("segment", pa.int32()), ("marks", pa.binary())])

    def pack(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"segment": s, "marks": zlib.compress(m.tobytes(), 1)} for s, m in held.items()], schema=schema)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for batch in batches:
            own[batch.column(0).drop_null().to_numpy(zero_copy_only=False)] = True
        yield pack({s: np.packbits(own[s * size : (s + 1) * size]) for s in range(segments) if own[s * size : (s + 1) * size].any()})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, m in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                marks = np.frombuffer(zlib.decompress(m), np.uint8)
                held[s] = held[s] | marks if s in held else marks
        yield pack(held)

    kind = "segment int, marks binary"
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.mapInArrow(tidy(mark), kind).repartition("segment").mapInArrow(merge, kind).collect():
        out[r.segment * size // 8 : (r.segment + 1) * size // 8] = np.frombuffer(zlib.decompress(r.marks), np.uint8)
    return out


def frequent(counted: DataFrame, n: str = "n", share: int = 10_000, least: int = 1000) -> tuple[DataFrame | None, int]:
    """The rows of counted (keys with their numbers of rows, n) whose key has at least 1 / share of all rows, and that
    bound; None if there is none. There are at most `share` of them, however large the data, so they may be broadcast; no
    other key has more rows than the bound."""
    bound = max(least, -(-(counted.agg(F.sum(n)).first()[0] or 0) // share))
    hot = counted.where(F.col(n) >= bound)
    return (None if hot.isEmpty() else hot), bound


def join_skewed(rows: DataFrame, counted: DataFrame, key: str, n: str = "n") -> DataFrame:
    """rows joined to counted (one row a key; n: how many of rows have it). Frequent keys are joined where their rows are
    read, as no key's rows may have to meet in one task; the others are shuffled."""
    hot, bound = frequent(counted, n)
    if hot is None:
        return rows.join(counted, key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(counted.where(F.col(n) < bound), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def in_packed(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node it is linked to, however far) for the nodes of links (columns a, b).

    Each round every node takes the least label of its neighbours and then its label's own label; as labels also jump, the
    number of rounds grows with the logarithm of a component's width. A round is a file in the shared folder; the one before
    it goes."""
    spark, pairs = links.sparkSession, links.select("a", "b").where("a <> b")
    edges = settle(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node")
    last = None
    while True:
        at = new_path(spark, "labels")
        labels.write.parquet(at)
        rows = spark.read.schema(labels.schema).parquet(at)
        labels = rows.select("node", "component")
        if last:
            drop(spark, last)
            if rows.where("component <> old").isEmpty():
                return labels
        last = at
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels.node == near.a, "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("node").alias("at"), F.col("component").alias("jump"))
        labels = lower.join(up, lower.component == up["at"], "left").select("node", "old", F.least("component", "jump").alias("component"))
