"""What several operators share: words of a text batch, written tables, graph components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendweave.session import cut, prepare

#: Rows that one Arrow batch may hold, so that a batch of long texts fits a Python worker.
BATCH_ROWS = 2000


_SHIPPED: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for functions that run in their Python workers."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        package, folder = Path(__file__).resolve().parent.parent, tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, folder, True)  # the driver serves the file as long as it lives
        packed = Path(folder, f"{package.name}_{uuid.uuid4().hex}.zip")
        with zipfile.ZipFile(packed, "w") as file:
            for source in package.rglob("*.py"):
                file.write(source, source.relative_to(package.parent))
        context.addPyFile(str(packed))


def ready(spark: SparkSession) -> SparkSession:
    """Session settings that the operators rely on."""
    prepare(spark)
    _ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")


def store(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back, so that lost executors repeat nothing before this point."""
    return cut(df)[0]


def row_keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """128 bits that tell rows of different ids or texts apart, null ids included; rows that repeat both have the same."""
    text = F.col(text_col).cast("string")
    return F.xxhash64(F.col(id_col).cast("long"), text).alias("row"), F.xxhash64(F.lit("row"), text).alias("text_key")


def filter_bits(n: int, least: int) -> int:
    """Bits of a filter's slots for ``n`` keys, as a power of two: eight slots a key, at most 64 MB in all."""
    return min(29, max(least, int(8 * n).bit_length()))


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"_{name}_{uuid.uuid4().hex[:10]}"


def _give_back() -> None:
    """Return freed memory to the machine: workers live on between tasks, beside an executor that needs its own."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(scan: Callable) -> Callable:
    """``scan``, for ``mapInArrow``, giving memory back when a partition is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scan(batches)
        _give_back()

    return run


def lean_group(join: Callable) -> Callable:
    """``join``, for ``applyInArrow`` on two tables by key, giving memory back after each group."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return join(key, left, right)
        finally:
            _give_back()

    return run


def by_bytes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in their order, in batches of about ``size`` bytes; a longer row is a batch of its own.

    An empty partition gives nothing.
    """
    held: list[pa.RecordBatch] = []
    filled = 0
    for batch in batches:
        step = max(1, batch.num_rows * size // max(batch.nbytes, 1) // 8)  # looked at in small steps, as rows differ
        for k in range(0, batch.num_rows, step):
            part = batch.slice(k, step)
            if part.nbytes > size and part.num_rows > 1:
                parts = [part.slice(j, 1) for j in range(part.num_rows)]
            else:
                parts = [part]
            for part in parts:
                held.append(part)
                filled += part.nbytes
                if filled >= size:
                    yield pa.concat_batches(held)
                    held, filled = [], 0
    if held:
        yield pa.concat_batches(held)


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text, null counting as empty: row offsets and the flat words."""
    texts = pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    if lower:
        texts = pc.ascii_lower(texts)
    texts = pc.if_else(pc.equal(texts, ""), pa.scalar(None, pa.large_string()), texts)
    lists = pc.ascii_split_whitespace(texts)
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), lists.flatten()


def coded_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """As :func:`split_words`, with each word as its number in the batch's list of distinct words."""
    offsets, words = split_words(texts, lower)
    coded = words.dictionary_encode()
    return offsets, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, root)`` for every node but the roots, the smallest of each.

    Large-star and small-star rounds: each neighbourhood is hung on its smallest member until nothing changes, in a number of
    rounds that grows with the logarithm of the nodes. A neighbourhood is only ever aggregated to its minimum and joined
    back, so a node with very many neighbours is pre-aggregated, and its join is split by adaptive execution.
    """
    state = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    edges, seen = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        n=F.count(F.lit(1)), state=state,
    )
    while seen["n"]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")
        )
        before = seen
        edges, seen = cut(small.select("e.*").where("a <> b").distinct(), n=F.count(F.lit(1)), state=state)
        if (seen["n"], seen["state"]) == (before["n"], before["state"]):
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
