"""Files arriving over time: lines folded per batch, and each entity's totals held in the state store of a second stream."""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from spendweave.operators.aggregates import FOLD_TEXT, fold_lines
from spendweave.operators.merge import upsert_suppliers
from spendweave.params import Params
from spendweave.session import cut
from spendweave.sources.delimited import map_layouts, read_delimited
from spendweave.streaming.counters import latest

TEXT = [*FOLD_TEXT, "currency"]
#: What a batch of files adds to an entity: ``source`` is the lasting id of the stream that read it, ``batch`` its number.
ADDED = "key string, name string, line_count long, amount decimal(28,2), transaction_count long, row_no decimal(38,0), texts string, source string, batch long"
TOTALS = "key string, name string, line_count long, amount decimal(28,2), transaction_count long, row_no decimal(38,0), texts string"


def read_arriving(
    spark: SparkSession, path: str, added: str, checkpoint: str, params: Params,
    files_per_batch: int = 1000, comment: str | None = None, style: str = "auto", trigger: dict | None = None, aside: str | None = None,
) -> StreamingQuery:
    """Read each arriving set of files by its headers, fold its lines per entity, and write what they add below ``added``.

    The stream carries the paths of new files only. A replayed batch has the same files and writes the same rows once more;
    :func:`entity_totals` tells them by source and batch. Several streams can write below one folder. Rows without a name and
    rows with surplus fields are written below ``aside``, by default beside the checkpoint.
    """
    arriving = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_batch)
    arriving = arriving.schema("path string, modificationTime timestamp, length long, content binary").load(path).select("path")
    aside = aside or f"{checkpoint.rstrip('/')}-aside"

    def fold(batch: DataFrame, batch_id: int) -> None:
        paths = [row.path for row in batch.collect()]  # files_per_batch at most
        if not paths:
            return
        source = spark.sparkContext.getLocalProperty("sql.streaming.queryId")  # the same for all runs of a checkpoint
        read = read_delimited(spark, paths, comment)
        lines, rejects = map_layouts(read, style, params)
        rejects.write.mode("overwrite").parquet(f"{aside}/rejects/batch={batch_id}")
        read.shifted.select("_row", F.to_json(F.struct("*")).alias("fields")).write.mode("overwrite").parquet(f"{aside}/shifted/batch={batch_id}")
        folded = fold_lines(lines)
        texts = F.to_json(F.struct(*[c for c in TEXT if c in folded.columns]))
        rows = folded.select("key", "name", "line_count", "amount", "transaction_count", F.col("row_no").cast("decimal(38,0)").alias("row_no"), texts.alias("texts"), F.lit(source).alias("source"), F.lit(batch_id).cast("long").alias("batch"))
        rows.write.mode("append").parquet(added)

    writer = arriving.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


#: Groups of entities whose totals are held together, as a call for each entity would cost more than its work. Lasting: a
#: checkpoint keeps the number that it began with.
SHARDS = 4096


def _take(held: dict, row) -> bool:
    """Add a row to an entity's totals, unless its batch has been added; whether it was."""
    if row.batch <= held["seen"].get(row.source, -1):
        return False
    held["seen"][row.source] = int(row.batch)
    texts = json.loads(row.texts)
    if held["lines"] == 0:
        held |= {"name": row.name, "row_no": str(row.row_no), "texts": {"currency": texts.get("currency")}}
    held["lines"] += int(row.line_count)
    held["count"] += int(row.transaction_count)
    amounts = [x for x in (held["amount"], row.amount) if x is not None]
    held["amount"] = str(sum(map(Decimal, amounts))) if amounts else None
    for name, text in texts.items():
        if name != "currency":  # the first batch's stands
            held["texts"].setdefault(name, text)
    return True


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A shard's next totals; its state is, for each entity, the totals and the last batch of each source, however many files there were."""
    shard = json.loads(state.get[0]) if state.exists else {}
    given = pd.concat(list(batches)).sort_values(["batch", "source"])  # one row an entity, source and batch
    given["amount"] = given["amount"].astype(object).where(given["amount"].notna(), None)
    changed = {}
    for row in given.itertuples(index=False):
        held = shard.setdefault(row.key, {"seen": {}, "lines": 0, "count": 0, "amount": None})
        if _take(held, row):
            changed[row.key] = held
    if changed:
        state.update((json.dumps(shard),))
        amount = lambda x: Decimal(x["amount"]) if x["amount"] is not None else Decimal(0) if x["lines"] > 1 else None
        rows = [(k, x["name"], x["lines"], amount(x), x["count"], Decimal(x["row_no"]), json.dumps(x["texts"])) for k, x in changed.items()]
        yield pd.DataFrame(rows, columns=["key", "name", "line_count", "amount", "transaction_count", "row_no", "texts"])


def entity_totals(added: DataFrame) -> DataFrame:
    """Totals per entity of a stream of ``ADDED`` rows, held in the state store; each batch of each source counts once.

    A stream in update mode: an entity comes again whenever files add to it. First names and texts are those of the batch that
    came first. No watermark: a file counts however late it is. A hot entity has one row a batch and source here, as its lines
    are folded before. Entities are held in ``SHARDS`` groups by a hash of their key; a group's totals are written again when one of them changes.
    """
    placed = added.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(SHARDS)))
    return placed.groupBy("shard").applyInPandasWithState(_advance, TOTALS, "held string", "update", "NoTimeout")


def stream_totals(spark: SparkSession, added: str, updates: str, checkpoint: str) -> StreamingQuery:
    """Bring ``updates`` up to what lies below ``added``: each batch's changed entities as one folder, replaced if the batch is replayed."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{updates}/batch={batch_id}")

    rows = spark.readStream.schema(ADDED).parquet(added)
    return entity_totals(rows).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(updates: DataFrame) -> DataFrame:
    """The newest totals of every entity, with the columns of :func:`fold_lines`."""
    texts = F.from_json("texts", ", ".join(f"{c} string" for c in TEXT))
    return latest(updates, ["key"]).withColumn("_t", texts).select(
        "key", "name", "line_count", (F.col("line_count") - 1).alias("duplicates"), "amount", "transaction_count", "row_no", *[F.col(f"_t.{c}").alias(c) for c in TEXT]
    )


def registry(base: DataFrame, updates: DataFrame, params: Params) -> dict[str, DataFrame]:
    """The registry ``base``, as it was before the streams, with all that they have added; as from ``upsert_suppliers``."""
    return upsert_suppliers(base, cut(folded(updates))[0], params, "add")


def stream_ingest(spark: SparkSession, path: str, folder: str, checkpoint: str, params: Params, **reading) -> DataFrame:
    """Take in what has arrived below ``path`` and return all entities' updates so far; ``reading`` goes to :func:`read_arriving`.

    ``folder`` holds what files have added and the updates; streams of other paths, each with a checkpoint of its own, may share it, one run at a time.
    """
    held = f"{TOTALS}, batch_id long"
    for name, schema in (("added", ADDED), ("updates/batch=-1", held)):  # there to be read before anything arrives
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}")
    read_arriving(spark, path, f"{folder}/added", checkpoint, params, **reading).awaitTermination()
    stream_totals(spark, f"{folder}/added", f"{folder}/updates", f"{folder}/state").awaitTermination()
    return spark.read.schema(held).parquet(f"{folder}/updates")
