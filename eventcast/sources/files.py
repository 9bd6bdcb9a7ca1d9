"""File sources and sinks: raw CSV, stage tables, windows, predictions, metrics, fitted objects."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from eventcast import schema as S
from eventcast.operators.evaluate import metrics_long, prediction_pairs


# --- CSV whose quoted fields span lines -----------------------------------------------------

WHOLE, HEAD, TAIL, MIDDLE = range(4)  # a record, or its part at the start, the end or through a whole split


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of splits (file, block, open, quotes, line) grouped to records, in the order of the lines.

    A record ends with the line after which the number of quotes is even. Lines that are a record alone, nearly
    all, pass in bulk; only lines of longer records are looked at one by one.
    """
    layout = pa.schema([("file", pa.string()), ("block", pa.int64()), ("edge", pa.int32()), ("first", pa.bool_()), ("record", pa.binary())])

    def packed(key, rows) -> pa.RecordBatch:
        edges, firsts, records = zip(*rows)
        return pa.record_batch([pa.array([key[0]] * len(rows)), pa.array([key[1]] * len(rows), pa.int64()),
                                pa.array(edges, pa.int32()), pa.array(firsts), pa.array(records, pa.binary())], schema=layout)

    key, pending, parity, cut, fresh = None, [], 0, False, False
    for batch in batches:
        file, block = batch.column("file"), batch.column("block")
        n = batch.num_rows
        if not n:
            continue
        changed = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1]))
        edges = [0, *(np.flatnonzero(changed.to_numpy(zero_copy_only=False)) + 1).tolist(), n]
        for start, end in zip(edges, edges[1:]):
            here = (file[start].as_py(), block[start].as_py())
            if here != key:
                if pending:
                    yield packed(key, [(MIDDLE if cut else TAIL, fresh, b"\n".join(pending))])
                key, pending, parity = here, [], batch.column("open")[start].as_py()
                cut, fresh = parity == 1, here[1] == 0
            part = batch.slice(start, end - start)
            after = (parity + np.cumsum(part.column("quotes").to_numpy())) % 2
            before = np.append(parity, after[:-1])
            parity = int(after[-1])
            alone = (before == 0) & (after == 0)
            lines, rows = part.column("line"), []
            for i in np.flatnonzero(~alone).tolist():
                pending.append(lines[i].as_py())
                if after[i] == 0:
                    opened = fresh and (i < len(pending) or not alone[:i].any()) and not rows
                    rows.append((HEAD if cut else WHOLE, opened, b"\n".join(pending)))
                    pending, cut = [], False
            if rows:
                yield packed(key, rows)
            if alone.any():
                whole = lines.filter(pa.array(alone))
                first = np.zeros(len(whole), bool)
                first[0] = fresh and bool(alone[0])
                k = len(whole)
                yield pa.record_batch([pa.array([key[0]] * k), pa.array([key[1]] * k, pa.int64()), pa.array([WHOLE] * k, pa.int32()),
                                       pa.array(first), whole.cast(pa.binary())], schema=layout)
            fresh = fresh and not rows and not alone.any()
    if pending:
        yield packed(key, [(MIDDLE if cut else TAIL, fresh, b"\n".join(pending))])


def csv_records(spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """(first, record): the records of CSV files as text; ``first`` marks each file's first one.

    Files are read in splits like any line file. Quotes are counted per split; the parity of the splits before it
    tells every split whether it starts inside a quoted field. Records are then put together inside each split, and
    only the pieces at split ends, at most two per split, are brought together. A quote may only enclose a field or be
    doubled inside one. Lines end with a line feed; where a file's first line has a carriage return before it, all such
    pairs in that file are one line break.
    """
    text = spark.read.text(path, lineSep="\n")
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    raw = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      quotes.alias("quotes"), F.endswith("value", F.lit("\r")).alias("returned"),
                      F.col("value").cast("binary").alias("line"))
    counted = raw.withColumn("_at", F.monotonically_increasing_id()).groupBy("file", "block").agg(
        F.sum("quotes").alias("_quotes"), F.min_by("returned", "_at").alias("_returned"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = counted.select(
        "file", "block", F.pmod(F.coalesce(F.sum("_quotes").over(before), F.lit(0)), F.lit(2)).cast("int").alias("open"),
        F.first("_returned").over(Window.partitionBy("file").orderBy("block")).alias("returns"))
    line = F.when(F.col("returns") & F.col("returned"), F.substring("line", F.lit(1), F.octet_length("line") - 1)).otherwise(F.col("line"))
    parts = raw.join(F.broadcast(splits), ["file", "block"]).select("file", "block", "open", "quotes", line.alias("line")).mapInArrow(
        _records, "file string, block long, edge int, first boolean, record binary")
    ordered = Window.partitionBy("file").orderBy("block", "edge")
    ends = parts.filter(F.col("edge") != WHOLE).withColumn("_record", F.count_if(F.col("edge") == TAIL).over(ordered))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("block", "edge", "record"))), lambda x: x["record"])
    joined = F.aggregate(F.slice(pieces, 2, F.size(pieces)), F.element_at(pieces, 1),
                         lambda whole, x: F.concat(whole, F.lit(b"\n"), x))
    ends = ends.groupBy("file", "_record").agg(F.bool_or("first").alias("first"), joined.alias("record"))
    found = parts.filter(F.col("edge") == WHOLE).select("first", "record").unionByName(ends.select("first", "record"))
    plain = encoding.upper().replace("_", "-") in ("UTF-8", "UTF8")
    record = F.col("record").cast("string") if plain else F.decode("record", encoding)
    return found.select("first", record.alias("record")).filter("record <> ''")


def read_raw_csv(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType = S.RAW_INCIDENT_SCHEMA,
    encoding: str = "ISO-8859-1", null_value: str = "", multi_line: bool = True,
) -> DataFrame:
    """Header CSV with an explicit schema; every file is read by as many tasks as it has splits.

    ``multi_line`` lets quoted fields span lines, which free text may need; it costs one more pass, which counts quotes.
    Turn it off for files without such fields.
    """
    if not multi_line:
        return spark.read.csv(path, schema=schema, header=True, encoding=encoding, escape='"', nullValue=null_value,
                              enforceSchema=False)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    options = {"escape": '"', "nullValue": null_value, "multiLine": "true"}
    records = csv_records(spark, path, encoding).filter(~F.col("first"))
    return records.select(F.from_csv("record", fields, options).alias("_row")).select("_row.*")


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    df.write.mode("overwrite").csv(
        path, header=True, encoding=encoding, escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_windows(windows: DataFrame, path: str) -> None:
    """Sequence tables, one folder per split so that a split is read alone."""
    write_stage(windows, path, ["split"] if "split" in windows.columns else [])


def write_predictions(df: DataFrame, path: str, actual: str, predicted: str) -> None:
    prediction_pairs(df, actual, predicted).write.mode("overwrite").csv(path, header=True)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metric name and value lines; one small file since a metric table has few rows."""
    metrics_long(metrics).repartition(1).write.mode("overwrite").json(path)


def write_results(results: DataFrame, path: str) -> None:
    """Result tables (a row per model or setting) as one CSV file."""
    results.repartition(1).write.mode("overwrite").csv(path, header=True)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(model_class: type, path: str):
    return model_class.load(path)
