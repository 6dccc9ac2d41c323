"""Labelled flow tables from CSV."""

from __future__ import annotations

import csv
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodlens.schemas import FLOW_TYPES


def _names(record: list[str]) -> list[str]:
    """Column names of a header: trimmed, a repeated name with a number, as common readers do."""
    seen: Counter[str] = Counter()
    out = []
    for name in (n.strip() for n in record):
        out.append(f"{name}.{seen[name]}" if seen[name] else name)
        seen[name] += 1
    return out


def _first_record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The header of a partition's file, if the partition begins it. Nothing after it is read."""

    def lines() -> Iterator[str]:
        for batch in batches:
            if batch.num_rows and batch.column("start")[0].as_py():
                return
            if batch.num_rows and not files:
                files.append(batch.column("file")[0].as_py())
            yield from (f"{line}\n" for line in batch.column("value").to_pylist())

    files: list[str] = []
    record = next(csv.reader(lines()), None)
    if record:
        record[0] = record[0].lstrip("\ufeff")
        yield pa.RecordBatch.from_arrays([pa.array(files), pa.array([_names(record)])], ["file", "header"])


def headers(spark: SparkSession, path: str) -> list[tuple[list[str], list[str]]]:
    """(header, its files) for all CSV files of a path, read by one job with a task for each file, which
    stops at the end of the first record. Quoted names may hold line ends. Empty files have no header."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    found = lines.mapInArrow(_first_record, "file string, header array<string>")
    grouped = found.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))
    # Files whose opening costs a whole partition are not packed together.
    cost = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(cost)
    spark.conf.set(cost, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        rows = grouped.collect()
    finally:
        spark.conf.set(cost, before)
    return sorted(((r["header"], r["files"]) for r in rows), key=lambda x: x[1][0])


def _typed(name: str, kind: T.DataType) -> Column:
    """Text to the given type; whole numbers may be written as 3 or 3.0. NULL where it does not parse."""
    text = F.trim(f"`{name}`")
    number = text.try_cast("double")
    if isinstance(kind, T.IntegralType):
        return F.coalesce(text.try_cast(kind), F.when(number == F.floor(number), number.try_cast(kind)))
    return F.col(f"`{name}`") if isinstance(kind, T.StringType) else text.try_cast(kind)


def _may_parse(name: str, kind: T.DataType) -> Column:
    """False for texts that are no number by their first character; parsing those raises an exception each,
    which costs far more than a number."""
    if not isinstance(kind, T.NumericType):
        return F.lit(True)
    text = F.trim(f"`{name}`")
    # Digits, signs, points and blanks are all below a colon; letters begin a number in these words only.
    return (F.substring(text, 1, 1) < ":") | text.rlike(r"(?i)^(inf|infinity|nan)[\x00-\x20]*$")


def _as_text(spark: SparkSession, path: str) -> DataFrame:
    """All files of a path as text columns, matched by name: files are read in groups that share
    one header, so a column's place in a file does not matter."""
    groups = headers(spark, path)
    if not groups:
        raise ValueError(f"no CSV header below {path}")
    tables = [
        spark.read.option("header", True)
        .option("enforceSchema", True)
        .option("multiLine", any("\n" in n for n in header))
        .schema(T.StructType([T.StructField(n, T.StringType()) for n in header]))
        .csv(own)
        for header, own in groups
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_flows(spark: SparkSession, path: str, types: dict[str, T.DataType] | None = None) -> DataFrame:
    """CSV with a header in each file; column names are trimmed and types are explicit.

    Known flow columns get their documented type, all others are text unless ``types``
    says otherwise. 'Infinity', 'Inf' and 'NaN' are numbers and empty fields are NULL, as
    is a value that does not parse; ``parse_errors`` counts those. Files may have different
    orders of columns; a column that a file lacks is NULL there.
    """
    known = {**FLOW_TYPES, **(types or {})}
    raw = _as_text(spark, path)
    return raw.select(*[_typed(n, known.get(n, T.StringType())).alias(n) for n in raw.columns])


def parse_errors(spark: SparkSession, path: str, types: dict[str, T.DataType] | None = None) -> DataFrame:
    """Per typed column: values present, values that do not parse, and the least such text."""
    known = {**FLOW_TYPES, **(types or {})}
    raw = _as_text(spark, path)
    checked = [n for n in raw.columns if not isinstance(known.get(n, T.StringType()), T.StringType)]
    there = {n: F.col(f"`{n}`").isNotNull() & (F.trim(f"`{n}`") != "") for n in checked}
    # Each value is parsed once, and what does not parse is counted and compared below.
    wrong = {n: ~_may_parse(n, known[n]) | _typed(n, known[n]).isNull() for n in checked}
    parsed = raw.select(
        *[F.when(there[n], wrong[n]).alias(f"_wrong_{i}") for i, n in enumerate(checked)],
        *[F.col(f"`{n}`").alias(f"_text_{i}") for i, n in enumerate(checked)],
    )
    counts = parsed.agg(
        *[F.count(f"_wrong_{i}").alias(f"present_{i}") for i in range(len(checked))],
        *[F.count_if(f"_wrong_{i}").alias(f"wrong_{i}") for i in range(len(checked))],
        *[F.min(F.when(F.col(f"_wrong_{i}"), F.col(f"_text_{i}"))).alias(f"example_{i}") for i in range(len(checked))],
    )
    rows = [
        F.struct(
            F.lit(n).alias("column"),
            F.col(f"present_{i}").alias("present"),
            F.col(f"wrong_{i}").alias("unparsable"),
            F.col(f"example_{i}").alias("example"),
        )
        for i, n in enumerate(checked)
    ]
    return counts.select(F.inline(F.array(*rows)))


def load_report(flows: DataFrame, label: str = "Label") -> DataFrame:
    """Rows per label, with the column count: what a loader prints."""
    return (
        flows.groupBy(label)
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("columns", F.lit(len(flows.columns)))
        .orderBy(F.desc("rows"), label)
    )
