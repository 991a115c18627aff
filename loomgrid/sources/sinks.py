"""Sinks: named tables of a workbook, CSV, mapping tables, JSON by gene, FASTA and report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_sheets(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """A folder for each sheet. Empty tables are written too, so that a reader finds their schema."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).options(**({"header": True} if fmt == "csv" else {})).save(f"{path}/{name}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_mapping(df: DataFrame, path: str, key: str) -> None:
    """Tab-separated, sorted by key over all files."""
    df.orderBy(key).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_documents(df: DataFrame, path: str, key: str = "base_gene") -> None:
    df.write.mode("overwrite").partitionBy(key).json(path)


def write_fasta(df: DataFrame, path: str, name: str, sequence: str) -> None:
    df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(sequence))).write.mode("overwrite").text(path)


def fasta_names(features: DataFrame) -> DataFrame:
    """``name`` of each coding sequence: locus tag, else gene, else its number in the strain."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("strain").orderBy("start", "end"))
    return features.withColumn("name", F.coalesce("locus_tag", "gene", F.concat(F.lit("gene_"), number.cast("string"))))


def report_rows(section: str, one_row: DataFrame) -> DataFrame:
    """A row of metrics to report rows (section, metric, value)."""
    names = one_row.columns
    return one_row.select(*(F.col(c).cast("string") for c in names)).unpivot([], names, "metric", "value").select(F.lit(section).alias("section"), "metric", "value")
