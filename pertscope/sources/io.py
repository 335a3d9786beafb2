"""Readers and writers for the reference's file formats, as Spark sources and
sinks (S1, S2, S4, S6-S9).  Schemas are declared, never inferred at scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import clean_label_set
from ..operators.enrichment import load_gene_sets


def _read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Every column of a tab-separated file with a header, as strings, by the
    names in the header; the order of the columns in the file does not matter."""
    return spark.read.option("sep", "\t").option("header", True).option("inferSchema", False).csv(path)


def _need_columns(df: DataFrame, columns: list[str], path: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; its header is {', '.join(df.columns)}")


def read_metadata_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated metadata, every column read as a string; 'nan' -> NULL."""
    df = _read_tsv(spark, path)
    _need_columns(df, columns, path)
    return df.select(*[F.when(F.col(c) == "nan", None).otherwise(F.col(c)).alias(c) for c in columns])


def read_compound_info(spark: SparkSession, path: str, schema: T.StructType, key_cols: list[str],
                       sentinel: str = "restricted") -> DataFrame:
    """Compound table; rows missing a key column or carrying the sentinel dropped."""
    df = _read_tsv(spark, path)
    _need_columns(df, schema.names, path)
    df = df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields]).dropna(subset=key_cols)
    cond = F.lit(True)
    for c in key_cols:
        cond = cond & (F.col(c) != sentinel)
    return df.filter(cond)


def read_gmt(spark: SparkSession, paths_in_priority_order: list[tuple[str, str]]) -> DataFrame:
    """GMT libraries (term, description, genes...); later libraries override equal term names."""
    frames = []
    for prio, (library, path) in enumerate(paths_in_priority_order):
        frames.append(spark.read.text(path).select(F.lit(library).alias("library"), F.lit(prio).alias("priority"),
                                                   F.col("value")))
    lines = frames[0]
    for f in frames[1:]:
        lines = lines.unionByName(f)
    return load_gene_sets(lines)


def _finished(spark: SparkSession, path: str) -> bool:
    """Whether a job ended there: its mark is the last file it writes."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def write_neighbors(neighbors: DataFrame, path: str, block_col: str | None = None) -> None:
    """Write the neighbour table once; a finished output is left untouched,
    what a failed write left behind is replaced."""
    if _finished(neighbors.sparkSession, path):
        return
    w = neighbors.write.mode("overwrite")
    if block_col:
        w = w.partitionBy(block_col)
    w.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV export with a header (arrays joined with ';')."""
    cols = [F.array_join(F.col(f.name), ";").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
            for f in df.schema.fields]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def read_prior_results(spark: SparkSession, path: str, schema: T.StructType, list_cols: list[str]) -> DataFrame:
    """Re-read exported CSV by the names in its header, whatever their order;
    string-encoded label lists parsed back to arrays."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    _need_columns(df, schema.names, path)
    return df.select(*[clean_label_set(f.name).alias(f.name) if f.name in list_cols
                       else F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def write_roc(roc: DataFrame, path: str, partition_cols: tuple[str, ...] = ("label", "space")) -> None:
    """Persist ROC points and AUROC per run label and feature space."""
    roc.write.mode("overwrite").partitionBy(*partition_cols).parquet(path)
