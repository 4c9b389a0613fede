"""Language identification by inference of a mixture of languages in each document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendweave.llm.common import fresh, lean

#: Letters of an n-gram and slots of the counting table. The model is languages x SLOTS numbers whatever the corpus size.
ORDER, SLOTS = 3, 65_536
#: Most languages that a model may hold, which bounds what is broadcast (50 MB).
MOST_LANGUAGES = 200
ROUNDS, SMOOTHING = 12, 0.5
#: Name of a text in which no letter is found.
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # slots x languages: log of the slot's share in the language, smoothed


def held_out(id_col: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % parts == part, F.lit(False))


def slots_of(text: str) -> np.ndarray:
    """Slots of a text's letter n-grams: lower case, anything but letters as one space between words."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return _slots(points)


def _slots(points: np.ndarray) -> np.ndarray:
    letter = (points >= 97) & (points <= 122) | (points >= 170)
    if not letter.any():
        return np.zeros(0, np.int64)
    shown = np.where(letter, points, 32).astype(np.uint64)
    shown = np.concatenate([[np.uint64(32)], shown, [np.uint64(32)]])
    kept = (shown[1:] != 32) | (shown[:-1] != 32)
    shown = np.concatenate([shown[:1], shown[1:][kept]])
    mixed = np.zeros(max(len(shown) - ORDER + 1, 0), np.uint64)
    for k in range(ORDER):
        mixed = (mixed + shown[k : k + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed >> np.uint64(48)).astype(np.int64)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts of letter n-grams per language over the whole texts of ``docs`` (rows with a null language or text add nothing).

    Each task adds its counts up before they are shuffled: at most languages x slots rows leave a task, and as many reach the
    driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in held:
                    held[lang] = np.zeros(SLOTS, np.int64)
                own = held[lang]
                for k in range(0, len(text), 1 << 20):  # a very long text in pieces that overlap
                    slots = slots_of(text[max(0, k - ORDER + 1) : k + (1 << 20)])
                    np.add.at(own, slots, 1) if len(slots) < 4096 else own.__iadd__(np.bincount(slots, minlength=SLOTS))
        for lang, own in held.items():
            slot = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slot), pa.string()), pa.array(slot.astype(np.int32)), pa.array(own[slot])], names=["lang", "slot", "n"])

    narrow = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    counted = narrow.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    rows = counted.select("lang", F.struct("slot", "n").alias("x")).groupBy("lang").agg(F.collect_list("x").alias("x")).orderBy("lang").limit(MOST_LANGUAGES + 1).toArrow()
    if rows.num_rows > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.zeros((SLOTS, rows.num_rows))
    for k, row in enumerate(rows["x"]):
        values = row.values
        counts[values.field("slot").to_numpy(), k] = values.field("n").to_numpy()
    shares = (counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * SLOTS)
    return Model(rows["lang"].to_pylist(), np.log(shares).astype(np.float32))


def infer(slots: np.ndarray, weights: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the languages of a text, and which of them are in its set.

    Expectation-maximisation over all languages gives an order; the best one, two, three ... of it are fitted again, and the
    set with the highest likelihood less half the logarithm of the number of n-grams per added language is taken.
    """
    own = logs[slots].astype(np.float64)
    top = own.max(axis=1, keepdims=True)
    odds = np.exp(own - top)
    total = weights.sum()

    def fit(columns: list[int]) -> tuple[np.ndarray, float]:
        part = odds[:, columns]
        share = np.full(len(columns), 1 / len(columns))
        for _ in range(ROUNDS if len(columns) > 1 else 0):
            share = share * ((weights / (part @ share)) @ part) / total
        return share, float(weights @ np.log(part @ share + 1e-300))

    first, _ = fit(list(range(odds.shape[1])))
    singles = weights @ own
    best = int(np.argmax(singles))
    order = [best, *(k for k in np.argsort(-first, kind="stable").tolist() if k != best)]
    columns, (share, score) = order[:1], fit(order[:1])
    for size in range(2, len(order) + 1):
        again, more = fit(order[:size])
        if more - score <= 0.5 * np.log(total + 1) + 1:
            break
        columns, share, score = order[:size], again, more
    shares, chosen = np.zeros(odds.shape[1]), np.zeros(odds.shape[1], bool)
    shares[columns], chosen[columns] = share, True
    return shares, chosen


def predict(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``carry`` and ``lang_pred, score, languages, proportions`` of each whole text, from nothing but the text.

    ``score`` is the proportion of the predicted language, the largest. A null text, one without a letter, or any text when no
    language was learned is ``und`` with score 0 and no languages.
    """
    shared: Broadcast = docs.sparkSession.sparkContext.broadcast((model.languages, model.logs))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, logs = shared.value
        names = np.array(languages, object)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch.column(0).to_pylist():
                slots = np.zeros(0, np.int64) if not text else slots_of(text)
                if not languages or not text or not has_letter(text):
                    found = (UNKNOWN, 0.0, [], [])
                else:
                    counts = np.bincount(slots, minlength=1)
                    at = np.flatnonzero(counts)
                    shares, chosen = infer(at, counts[at].astype(np.float64), logs) if len(at) else (np.full(len(names), 1 / len(names)), np.ones(len(names), bool))
                    order = [k for k in np.argsort(-shares, kind="stable") if chosen[k]]
                    found = (languages[order[0]], float(min(1.0, shares[order[0]])), names[order].tolist(), shares[order].tolist())
                for column, value in zip(out, found):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.list_(pa.string())), pa.array(out[3], pa.list_(pa.float64()))],
                names=schema.names,
            )

    told = T.StructType.fromDDL("lang_pred string, score double, languages array<string>, proportions array<double>")
    schema = T.StructType([*(docs.schema[c] for c in carry), *told.fields])
    return docs.select(F.col(text_col).cast("string").alias(fresh("text")), *carry).mapInArrow(lean(scan), schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 3, part: int = 1) -> DataFrame:
    """Learn from rows whose crc32 of the id leaves another remainder than ``part``, and predict every row.

    Adds ``held_out`` to what :func:`predict` returns. An empty table gives no rows; without a usable label all are ``und``.
    """
    model = train(docs.where(~held_out(F.col(id_col), parts, part)), text_col, lang_col)
    return predict(docs, model, [id_col], text_col).withColumn("held_out", held_out(F.col(id_col), parts, part))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, columns unchanged, whose text is mainly in one learned language.

    Rejected are null texts, texts without a letter, and texts of which no language has the share ``least``. Where the table
    has no usable label at all nothing can be learned, so nothing is rejected for its language.
    """
    model = train(docs.where(~held_out(F.col(id_col), 3, 1)), text_col, lang_col)
    if not model.languages:
        return docs.where(F.col(text_col).isNotNull() & F.col(text_col).rlike("\\p{L}"))
    named = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    kept = predict(named, model, named.columns, named.columns[docs.columns.index(text_col)]).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(named.columns).toDF(*docs.columns)


