"""Delimited input: supplier, transaction and taxonomy files."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendweave.functions.text import blank_to_null, has_text, sanitize_parent, title_case
from spendweave.functions.values import iso_date, money, once
from spendweave.params import Params
from spendweave.session import cut

DELIMITERS = [",", ";", "\t", "|"]

# Accepted headers per logical column; the first listed one present in a file is used.
ALIASES = {
    "name": ["name", "supplier", "supplier_name", "supplier name", "vendor", "vendor_name", "company"],
    "amount": ["amount", "spend", "total", "value", "invoice_amount", "transaction_amount"],
    "domain": ["domain", "website", "url", "web", "supplier_domain"],
    "industry": ["industry", "sector"],
    "naics": ["naics", "naics_code", "naics code"],
    "sic": ["sic", "sic_code", "sic code"],
    "description": ["description", "notes", "summary"],
    "country": ["country", "country_code", "region"],
    "parent_name": ["parent", "parent_name", "parent_company", "parent company", "ultimate_parent"],
    "parent_domain": ["parent_domain", "parent website"],
    "currency": ["currency", "ccy"],
    "date": ["date", "transaction_date", "invoice_date", "posted_date", "period"],
}
TAXONOMY_ALIASES = {
    "code": ["code", "commodity_code", "Commodity Code", "UNSPSC Code"],
    "commodity": ["commodity", "title", "Commodity Title", "title_en", "Commodity Name"],
    "segment": ["segment", "Segment Title", "segment_en", "Segment Name"],
    "family": ["family", "Family Title", "family_en", "Family Name"],
    "class": ["class", "Class Title", "class_en", "Class Name"],
    "description": ["description", "definition", "definition_en"],
}


@dataclass
class Layout:
    """Files that share a header line: their delimiter, header names and rows."""

    records: DataFrame
    headers: list[str]
    delimiter: str


@dataclass
class Delimited:
    """A file set read by layout; ``records``, ``headers`` and ``delimiter`` are those of the only layout."""

    layouts: list[Layout]
    shifted: DataFrame
    errors: DataFrame

    def _only(self) -> Layout:
        if len(self.layouts) != 1:
            raise ValueError(f"{len(self.layouts)} layouts in one file set: use layouts")
        return self.layouts[0]

    records = property(lambda self: self._only().records)
    headers = property(lambda self: self._only().headers)
    delimiter = property(lambda self: self._only().delimiter)


#: Header lines that a file set may have: each is read on its own.
MOST_LAYOUTS = 200


def sniff_delimiter(line: str) -> str:
    """Delimiter with the most splits in the header line, outside quotes; the first listed wins ties."""
    bare = re.sub(r'"[^"]*"', "", line)
    return max(DELIMITERS, key=lambda d: (bare.count(d), -DELIMITERS.index(d)))


def split_header(line: str, delimiter: str) -> list[str]:
    """Names of a header line by the rules for quoted fields; a name that is missing or repeated gets its place."""
    names = [h.strip() for h in next(csv.reader([line.lstrip("\ufeff")], delimiter=delimiter), [])]
    return [h if h and h not in names[:i] else f"{h or 'column'}_{i + 1}" for i, h in enumerate(names)]


def header_lines(spark: SparkSession, paths: str | list[str], comment: str | None = None) -> DataFrame:
    """``path, header``: the first line of each file that is not blank or a comment, found where the files are read."""
    lines = spark.read.text(paths).where(F.trim("value") != "")
    if comment:
        lines = lines.where(~F.col("value").startswith(comment))
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    # places are numbers, which a task holds for its files only; an aggregate of the lines themselves would sort all of them
    first, _ = cut(lines.groupBy("path", "block").agg(F.min("at").alias("at")).groupBy("path").agg(F.min("block").alias("block"), F.min_by("at", "block").alias("at")))
    return lines.join(first, ["path", "block", "at"]).select("path", F.col("value").alias("header"))


def _delimiters(text: Column, delimiter: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(delimiter), F.lit("")))


def _field_count(line: Column, delimiter: str) -> Column:
    """Fields in a raw line: delimiters outside quotes, plus one."""
    return once(F.regexp_replace(line, '"[^"]*"', ""), lambda bare: _delimiters(bare, delimiter) + 1)


def file_order() -> Column:
    """Row order as one number, so that "first row" aggregates stay on fixed-width buffers: 61 bits of the file's hash, the
    megabyte of the split's start, the position in the task. Two files never share a number but by a 61-bit chance."""
    wide = lambda c: c.cast("decimal(20,0)")
    file = F.pmod(F.xxhash64(F.col("_metadata.file_path")), F.lit(1 << 61))
    block = F.floor(F.col("_metadata.file_block_start") / (1 << 20)).cast("long")
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    inside = wide(F.shiftleft(block, 33).bitwiseOR(position))
    return (wide(file) * F.lit(str(1 << 64)).cast("decimal(20,0)") + inside).cast("decimal(38,0)")


def read_delimited(spark: SparkSession, path: str | list[str], comment: str | None = None, multi_line: bool = False) -> Delimited:
    """Read a file set. All values are text; blank rows are dropped.

    Files are grouped by their header line, found by one pass on the executors, and each group is read with its own delimiter
    and names. A row with more fields than the header is kept, and listed in ``shifted`` when the
    surplus is not blank; ``errors`` holds the first 25 rows whose field count differs from the header's. Files are
    split between tasks unless ``multi_line`` (line breaks inside quotes) is asked for.
    """
    heads, _ = cut(header_lines(spark, path, comment))
    kinds = [r.header for r in heads.select("header").distinct().orderBy("header").limit(MOST_LAYOUTS + 1).collect()]
    if len(kinds) > MOST_LAYOUTS:
        raise ValueError(f"more than {MOST_LAYOUTS} header lines in one file set")
    layouts, shifted, errors = [], None, None
    for line in kinds:
        # one layout is read by the given path; of several, each by its own files
        own = path if len(kinds) == 1 else [unquote(r.path) for r in heads.where(F.col("header") == line).select("path").toLocalIterator()]
        layout, moved, wrong = _read_layout(spark, own, line, comment, multi_line)
        layouts.append(layout)
        shifted, errors = (moved, wrong) if shifted is None else (shifted.unionByName(moved, allowMissingColumns=True), errors.unionByName(wrong))
    if not layouts:
        empty = spark.createDataFrame([], "_row decimal(38,0), _fields int, _raw string")
        layouts, shifted, errors = [Layout(empty.select("_row"), [], ",")], empty.select("_row"), empty
    return Delimited(layouts, shifted, errors.orderBy("_row").limit(25))


def _read_layout(spark: SparkSession, path: str | list[str], line: str, comment: str | None, multi_line: bool) -> tuple[Layout, DataFrame, DataFrame]:
    delimiter = sniff_delimiter(line)
    headers = split_header(line, delimiter)
    width = len(headers)
    # one column more than the header: ordinary rows then count as short, so their raw line is kept
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)] + [T.StructField("_extra", T.StringType()), T.StructField("_raw", T.StringType())])
    options = {"sep": delimiter, "header": True, "multiLine": multi_line, "columnNameOfCorruptRecord": "_raw", "quote": '"', "escape": '"'}
    if comment:
        options["comment"] = comment
    raw = spark.read.options(**options).schema(schema).csv(path)
    tail = F.regexp_replace("_raw", "[" + ("\\t" if delimiter == "\t" else "\\" + delimiter) + r"\s]+$", "")
    # a line with few delimiters has no more fields inside quotes
    many = F.coalesce(_delimiters(F.col("_raw"), delimiter) >= width, F.lit(False))
    surplus = (F.coalesce(F.trim("_extra"), F.lit("")) != "") | (many & F.coalesce(_field_count(tail, delimiter) > width, F.lit(False)))
    filled = reduce(lambda a, b: a | b, [has_text(F.col(c)) for c in schema.names[: width + 1]])
    rows = (
        raw.withColumn("_row", file_order())
        .withColumn("_shifted", surplus)
        .withColumn("_fields", F.coalesce(_field_count(F.col("_raw"), delimiter), F.lit(width + 1)))
        .where(filled)
        .select(*[F.col(f"c{i}").alias(h) for i, h in enumerate(headers)], "_extra", "_raw", "_row", "_shifted", "_fields")
    )
    shifted = rows.where("_shifted").drop("_raw", "_shifted", "_fields")
    errors = rows.where(F.col("_fields") != width).orderBy("_row").limit(25).select("_row", "_fields", "_raw")
    return Layout(rows.drop("_raw", "_shifted", "_fields", "_extra"), headers, delimiter), shifted, errors


def map_layouts(read: Delimited, style: str = "auto", params: Params | None = None) -> tuple[DataFrame, DataFrame]:
    """Logical supplier columns of all layouts of a file set; rows without a name go second."""
    mapped = [map_supplier_columns(x.records, x.headers, style, params or Params()) for x in read.layouts]
    return tuple(reduce(DataFrame.unionByName, side) for side in zip(*mapped))


def _find(headers: list[str], aliases: list[str], exact: bool = False) -> str | None:
    spelled = {(h if exact else h.strip().lower()): h for h in reversed(headers)}
    return next((spelled[a] for a in aliases if a in spelled), None)


def map_supplier_columns(records: DataFrame, headers: list[str] | None = None, style: str = "auto", params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Logical supplier columns of records under any accepted header; rows without a name go second.

    Headers are matched once per file, so the mapping is a single projection.
    """
    headers = headers or [c for c in records.columns if not c.startswith("_")]
    found = {name: _find(headers, aliases) for name, aliases in ALIASES.items()}

    def value(name: str) -> Column:
        return F.nullif(F.trim(F.col(f"`{found[name]}`")), F.lit("")) if found[name] else F.lit(None).cast("string")

    columns = [title_case(value("name")).alias("name"), money(value("amount"), style).alias("amount")]
    columns += [value(n).alias(n) for n in ("domain", "industry", "naics", "sic", "description", "country")]
    columns += [sanitize_parent(value("parent_name")).alias("parent_name"), value("parent_domain").alias("parent_domain")]
    columns += [F.coalesce(value("currency"), F.lit(params.currency)).alias("currency"), iso_date(value("date")).alias("date"), F.lit(1).cast("long").alias("transaction_count")]
    row_no = F.col("_row") if "_row" in records.columns else F.col("row_no")
    columns.append(row_no.alias("row_no"))
    named = has_text(value("name"))
    return records.where(named).select(*columns), records.where(~named).select(*columns)


def map_taxonomy(records: DataFrame, version: str) -> DataFrame:
    """Taxonomy rows from any accepted column spelling: exactly eight digits and a title are required."""
    headers = records.columns

    def value(name: str, limit: int | None = None) -> Column:
        present = [F.col(f"`{a}`") for a in TAXONOMY_ALIASES[name] if a in headers]
        first = F.coalesce(*present) if present else F.lit(None).cast("string")
        return blank_to_null(first) if limit is None else F.substring(blank_to_null(first), 1, limit)

    code = F.regexp_replace(value("code"), r"\D", "")
    out = records.select(
        code.alias("code"), value("segment", 500).alias("segment"), value("family", 500).alias("family"), value("class", 500).alias("class"),
        value("commodity", 500).alias("commodity"), value("description", 4000).alias("description"), F.lit(version).alias("version"),
        *([F.col("_row").alias("row_no")] if "_row" in headers else [F.col("row_no")]),
    ).where((F.length("code") == 8) & F.col("commodity").isNotNull())
    for name, digits in (("segment_code", 2), ("family_code", 4), ("class_code", 6)):
        out = out.withColumn(name, F.substring("code", 1, digits))
    return out


def load_taxonomy(records: DataFrame, version: str) -> DataFrame:
    """Mapped taxonomy with one row per code: the last one read wins."""
    mapped = map_taxonomy(records, version)
    fields = [c for c in mapped.columns if c not in ("code", "row_no")]
    return mapped.groupBy("code").agg(F.max_by(F.struct(*fields), "row_no").alias("r")).select("code", "r.*")


def upsert_taxonomy(stored: DataFrame, loaded: DataFrame) -> DataFrame:
    """Stored codes with those of a load put over them, all fields from the load; codes that it lacks stay. Both are unique on ``code``."""
    fields = [c for c in stored.columns if c != "code"]
    there = loaded.select("code", F.struct(*[F.col(c).cast(stored.schema[c].dataType).alias(c) for c in fields]).alias("_new"))
    both = stored.select("code", F.struct(*fields).alias("_old")).join(there, "code", "full")
    return both.select("code", F.coalesce("_new", "_old").alias("_row")).select("code", "_row.*").select(stored.columns)


def write_taxonomy(loaded: DataFrame, path: str) -> None:
    """Put a load over the taxonomy stored under ``path`` (which it creates): only segments that the load has are read and written again."""
    spark = loaded.sparkSession
    segments = [r[0] for r in loaded.select("segment_code").distinct().collect()]  # two digits: a hundred at most
    try:
        stored = spark.read.schema(loaded.schema).parquet(path).where(F.col("segment_code").isin(segments))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = loaded.limit(0)
    rows, _ = cut(upsert_taxonomy(stored, loaded))
    rows.repartition("segment_code").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment_code").parquet(path)


def write_template(spark: SparkSession, path: str) -> None:
    """Header-only upload template."""
    fields = ["name", "amount", "date", "domain", "industry", "naics", "parent"]
    spark.createDataFrame([], ", ".join(f"{f} string" for f in fields)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
