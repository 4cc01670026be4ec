"""Readers for note, training, gold and prediction tables. All columns stay strings."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from staycoder.functions import fixed
from staycoder.functions.text import strip
from staycoder.operators.checks import require_columns


RECORD = "_record"  # the text of a CSV row whose number of fields is not the header's


def missing_as_null(value: Column) -> Column:
    """Text field with the usual spellings of a missing value turned into null."""
    return F.when(~value.isin(*fixed.NA_STRINGS), value)


def distinct_names(header: list[str | None]) -> list[str]:
    """Column names of a header: an empty one is named by its place, a repeated one gets a number."""
    names: list[str] = []
    for i, name in enumerate(header):
        name = name or f"Unnamed: {i}"
        numbered = (f"{name}.{k}" for k in itertools.count(1))
        names.append(next(n for n in itertools.chain([name], numbered) if n not in names and (n == name or n not in header)))
    return names


def _fields(record: Column) -> Column:
    """Number of fields of a CSV record; null if a quote is left open."""
    unquoted = F.regexp_replace(F.replace(record, F.lit('""'), F.lit("")), r'(?s)(^|,)"[^"]*"', "$1")
    commas = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit("")))
    return F.when(~F.rlike(unquoted, F.lit('(?s)(^|,)"')), commas + 1)


def read_table(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Read CSV (header, quoted line breaks, doubled quotes, all strings) or any columnar format.

    Nothing is lost or moved in silence: a CSV row with more fields than the header, empty ones included, or
    with a quote left open is an error that names the file; missing fields at a row's end are null. All files of a folder
    must have the same header in the same order. Empty and repeated column names get a name of their own,
    in single files only. Fields are counted for rows that do not fit, so good rows cost nothing more. A quote
    left open in the last column cannot be told from a long value: it runs to the end of the file.

    A CSV file with quoted line breaks is one task; large inputs should be many files, or be
    stored as parquet once (`with_row_key` does both the key and the storing).
    """
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    reader = (
        spark.read.option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("columnPruning", False)  # else only the selected fields of a row are counted
        .option("columnNameOfCorruptRecord", RECORD)
    )
    as_written = reader.option("header", False).csv(path).head()
    if as_written is None:
        raise ValueError(f"no header in {path}")
    names = distinct_names(list(as_written))
    renamed = names != list(as_written)
    schema = StructType([StructField(name, StringType()) for name in [*names, RECORD]])
    raw = reader.option("header", True).option("enforceSchema", renamed).schema(schema).csv(path)
    if renamed and len(raw.inputFiles()) > 1:
        raise ValueError(f"several files need a header with distinct names, not {list(as_written)}")
    # every column carries the check, so that no projection can prune it away
    record = F.col(RECORD)
    file = F.input_file_name()
    surplus = F.concat(F.lit("a row has more fields than the header: "), file)
    unclosed = F.concat(F.lit("a row opens a quote and does not close it: "), file)
    check = (
        F.when(_fields(record) > len(names), F.raise_error(surplus))
        .when(record.isNotNull() & _fields(record).isNull(), F.raise_error(unclosed))
    )
    return raw.select([check.otherwise(missing_as_null(F.col(f"`{c}`"))).alias(c) for c in names])


def as_documents(
    table: DataFrame,
    col_text: str = fixed.COL_TEXT,
    col_gold: str | None = None,
    col_patient: str = fixed.COL_PATIENT,
    col_stay: str = fixed.COL_STAY,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Project a table to (id_sejour, id_patient, text, gold_dp); optional columns may be absent."""
    require_columns(table, [col_text], "input table")
    missing = F.lit(None).cast("string")

    def optional(name: str | None) -> Column:
        return F.col(name).cast("string") if name in table.columns else missing

    return table.select(
        *keep,
        optional(col_stay).alias("id_sejour"),
        optional(col_patient).alias("id_patient"),
        F.coalesce(F.col(col_text).cast("string"), F.lit("")).alias("text"),
        strip(optional(col_gold)).alias("gold_dp"),
    )


def training_rows(
    table: DataFrame, text: str = fixed.COL_TEXT, label: str = fixed.COL_GOLD, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Text and label as strings, rows with either missing dropped."""
    require_columns(table, [text, label], "training table")
    rows = table.select(*keep, F.col(text).cast("string"), F.col(label).cast("string"))
    return rows.dropna(how="any", subset=[text, label])
