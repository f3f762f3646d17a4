"""CSV, parquet and catalog readers that end in the same typed columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.functions.columns import col, parse_timestamp
from martlens.sources.schemas import DATE_FORMATS, NULL_TOKENS, TableSpec, check_required
from martlens.sources.tables import materialize


def blank_to_null(c: str | Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    text = col(c)
    return F.when(~text.isin(*tokens), text)


def read_csv_text(
    spark: SparkSession, path: str | list[str], multiline: bool = False
) -> DataFrame:
    """Every column as text, named by the header, missing tokens as null.

    No type inference, hence no extra pass over the data.  Files stay
    splittable unless ``multiline`` asks for line breaks inside quotes.  A row
    with too many or too few fields stops the job, and so does a file whose header
    differs from the first one's: its columns would land under wrong names.
    """
    raw = spark.read.csv(
        path,
        header=True,
        enforceSchema=False,
        quote='"',
        escape='"',
        multiLine=multiline,
        mode="FAILFAST",
    )
    return raw.select(*[blank_to_null(c).alias(c) for c in raw.columns])


def _typed(c: Column, source_type: str, wanted: str, formats: Sequence[str]) -> Column:
    if wanted == "timestamp" and source_type == "string":
        return parse_timestamp(c, formats)
    if wanted == "timestamp" and source_type == "timestamp_ntz":
        return c
    if wanted == "bigint" and source_type.startswith(("string", "double", "float", "decimal")):
        # a count written as 3.0 is still the count 3; 2.9 is none
        number = c.cast("decimal(38,18)") if source_type == "string" else c
        complaint = F.raise_error(F.concat(F.lit("not a whole number: "), c.cast("string")))
        return F.when(number != F.floor(number), complaint.cast("bigint")).otherwise(
            number.cast("bigint")
        )
    return c.cast(wanted)


def conform(
    df: DataFrame, spec: TableSpec, date_formats: Sequence[str] = DATE_FORMATS
) -> DataFrame:
    """Rename headings to our names and cast; unknown columns pass unchanged.

    Casts are strict: a value that does not fit stops the job.
    """
    check_required(df, spec)
    types = dict(df.dtypes)
    by_name = {name: (name, kind) for name, kind in spec.columns.values()}
    out = []
    for c in df.columns:
        name, kind = spec.columns.get(c) or by_name.get(c) or (c, types[c])
        out.append(_typed(col(c), types[c], kind, date_formats).alias(name))
    return df.select(*out)


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    spec: TableSpec,
    date_formats: Sequence[str] = DATE_FORMATS,
    multiline: bool = False,
) -> DataFrame:
    return conform(read_csv_text(spark, path, multiline), spec, date_formats)


REASONS = "__reasons"
SOURCE = "__file"
LINE = "__line"


def _complaint(c: str, source: str, wanted: str, formats: Sequence[str]) -> Column:
    """What is wrong with a text as a value of its type; null if nothing is."""
    text = col(c)
    if wanted == "timestamp":
        fits = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).isNotNull()
    elif wanted == "bigint":
        number = text.try_cast("decimal(38,18)")
        fits = number.isNotNull() & (number == F.floor(number))
        fits = fits & number.cast("decimal(38,0)").try_cast("bigint").isNotNull()
    else:
        fits = text.try_cast(wanted).isNotNull()
    said = F.concat(F.lit(f"{source}: not a {wanted}: "), text)
    return F.when(text.isNotNull() & ~F.coalesce(fits, F.lit(False)), said)


def read_csv_checked(
    spark: SparkSession,
    path: str | list[str],
    spec: TableSpec,
    date_formats: Sequence[str] = DATE_FORMATS,
) -> tuple[DataFrame, DataFrame]:
    """The rows that fit, and the ones that do not as (file, line, reasons).

    Where :func:`read_csv` stops at the first bad row, this sets it aside: a row with too
    many or too few fields, or with a text that is no value of its column's type.  Each
    reason names the column as the file does.  The files are parsed once into a written
    copy that both results read, so their rows add up to the rows of the files.  A file
    whose header differs from the first one's still stops the job: all its rows would be
    wrong.  ``line`` is the row as the file has it if its fields do not add up, else its
    fields with missing tokens left out.
    """
    header = spark.read.csv(path, header=True, enforceSchema=False, quote='"', escape='"')
    check_required(header, spec)
    fields = [f"`{c}` string" for c in header.columns]
    raw = (
        spark.read.schema(", ".join([*fields, f"{LINE} string"]))
        .csv(path, header=True, enforceSchema=False, quote='"', escape='"', mode="PERMISSIVE",
             columnNameOfCorruptRecord=LINE)
        .withColumn(SOURCE, F.col("_metadata.file_path"))
    )
    values = raw.select(
        *[blank_to_null(c).alias(c) for c in header.columns], LINE, SOURCE
    )
    complaints = [F.when(F.col(LINE).isNotNull(), F.lit(f"not {len(header.columns)} fields"))]
    for c in header.columns:
        name, kind = spec.columns.get(c) or (c, "string")
        if kind != "string":
            said = _complaint(c, c, kind, date_formats)
            complaints.append(F.when(F.col(LINE).isNull(), said))
    checked = materialize(
        values.withColumn(REASONS, F.array_compact(F.array(*complaints))), "checked-rows"
    )
    good = checked.filter(F.size(REASONS) == 0).drop(REASONS, SOURCE, LINE)
    line = F.coalesce(
        F.col(LINE),
        F.to_csv(F.struct(*[col(c) for c in header.columns]), {"quote": '"', "escape": '"'}),
    )
    bad = checked.filter(F.size(REASONS) > 0).select(
        F.col(SOURCE).alias("file"), line.alias("line"), F.col(REASONS).alias("reasons")
    )
    return conform(good, spec, date_formats), bad


def read_parquet(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    return conform(spark.read.parquet(path), spec)


def read_table(spark: SparkSession, name: str, spec: TableSpec) -> DataFrame:
    return conform(spark.table(name), spec)
