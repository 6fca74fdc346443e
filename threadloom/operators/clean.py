"""Text cleaning: a normalised copy of the text, rows left blank dropped."""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from threadloom.constants import NULLABLE_COLUMNS
from threadloom.functions.text import normalized
from threadloom.sources.tables import write_table


def with_clean_text(df: DataFrame) -> DataFrame:
    return df.withColumn("text_clean", normalized(F.col("text")))


def kept_rows(normalised: DataFrame) -> DataFrame:
    """Repeated texts stay: they are separate messages."""
    return normalised.where(F.col("text_clean") != "")


def null_cells(df: DataFrame) -> DataFrame:
    """Total NULL cells outside the two link columns."""
    columns = [c for c in df.columns if c not in (*NULLABLE_COLUMNS, "text_clean")]
    per_row = sum((F.col(c).isNull().cast("bigint") for c in columns), F.lit(0).cast("bigint"))
    return df.agg(F.coalesce(F.sum(per_row), F.lit(0)).alias("unexpected_nulls_in_required_columns"))


def _report_columns(columns: list[str]) -> list[Column]:
    required = [c for c in columns if c not in (*NULLABLE_COLUMNS, "text_clean")]
    nulls = sum((F.col(c).isNull().cast("bigint") for c in required), F.lit(0).cast("bigint"))
    kept = F.count_if(F.col("text_clean") != "")
    return [
        F.count(F.lit(1)).alias("rows_in"),
        kept.alias("rows_out"),
        (F.count(F.lit(1)) - kept).alias("rows_dropped_empty_after_cleaning"),
        F.coalesce(F.sum(nulls), F.lit(0)).alias("unexpected_nulls_in_required_columns"),
    ]


def cleaning_report(normalised: DataFrame) -> DataFrame:
    """One pass: rows in and out, rows dropped, NULL cells."""
    return normalised.agg(*_report_columns(normalised.columns))


def clean(validated: DataFrame, processed_path: str) -> DataFrame:
    """Write the cleaned table, counting on the way; gives the report row."""
    counts = Observation("clean")
    columns = _report_columns(validated.columns)
    write_table(kept_rows(with_clean_text(validated).observe(counts, *columns)), processed_path)
    found = counts.get
    return validated.sparkSession.createDataFrame([tuple(found.values())], ", ".join(f"{n} bigint" for n in found))
