"""CSV exports with dirty cells: good rows, and a quarantine of the others.

Every cell is read as text and cast on its own (``try_cast``), so a cell that is
no number costs its row and not the job. A row with a bad cell, an empty cell in
a required column, or a wrong number of cells goes to the quarantine, once for
each such cell; blank cells are NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LINE = "_malformed_line"
WHOLE_ROW = "*"  # stands for the column where the row as such is malformed


@dataclass
class Quarantined:
    good: DataFrame      # the table's schema
    rejects: DataFrame   # file, record (its cells as JSON, or the line), column, raw


def _blank(cell: Column) -> Column:
    return cell.isNull() | (F.trim(cell) == "")


def read_csv_quarantined(spark: SparkSession, path: str, schema: T.StructType) -> Quarantined:
    """The table exported to ``path`` with a header row, and what of it does not
    fit ``schema``. One pass over the file for either output; each cell is cast
    once. Text is kept as it stands, other cells are trimmed by the cast. A quote
    inside a quoted cell is doubled, as spreadsheets write it."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField(_LINE, T.StringType())])
    rows = (spark.read.schema(text).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _LINE).option("escape", '"')
            .option("columnPruning", False)   # a row is malformed whatever columns are asked for
            .csv(path).withColumn("_file", F.col("_metadata.file_name")))

    def value(f: T.StructField) -> Column:
        cell = F.col(f.name)
        return F.when(~_blank(cell), cell if isinstance(f.dataType, T.StringType) else cell.try_cast(f.dataType))

    def fault(f: T.StructField) -> Column:
        cell = F.col(f.name)
        wrong = ~_blank(cell) & value(f).isNull()
        if not f.nullable:
            wrong = wrong | _blank(cell)
        return F.when(wrong, F.struct(F.lit(f.name).alias("column"), F.coalesce(cell, F.lit("")).alias("raw")))

    faults = F.filter(F.array(*[fault(f) for f in schema.fields]), lambda x: x.isNotNull())
    whole = F.array(F.struct(F.lit(WHOLE_ROW).alias("column"), F.col(_LINE).alias("raw")))
    judged = rows.withColumn("_faults", F.when(F.col(_LINE).isNotNull(), whole).otherwise(faults))
    good = judged.where(F.size("_faults") == 0).select(*[value(f).alias(f.name) for f in schema.fields])
    record = F.coalesce(F.col(_LINE), F.to_json(F.struct(*[F.coalesce(f.name, F.lit("")).alias(f.name) for f in schema.fields])))
    rejects = judged.where(F.size("_faults") > 0).select(F.col("_file").alias("file"), record.alias("record"), F.explode("_faults").alias("f")).select(
        "file", "record", "f.column", "f.raw")
    return Quarantined(good, rejects)
