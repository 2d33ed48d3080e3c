"""Transactions in files: CSV and Parquet in, CSV out."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txscreen import schema as S
from txscreen.sources.scratch import materialize


def _require(names: list[str], path: str) -> None:
    missing = [f.name for f in S.TRANSACTION_SCHEMA if f.name not in names]
    if missing:
        raise ValueError(f"{path}: not a transactions table, missing {', '.join(missing)}")


def _header_schema(spark: SparkSession, path: str) -> T.StructType:
    """Declared types in the order of the file's header; reads the header only."""
    names = spark.read.csv(path, header=True, inferSchema=False).columns
    _require(names, path)
    declared = {f.name: f.dataType for f in S.TRANSACTION_SCHEMA}
    return T.StructType([T.StructField(n, declared.get(n, T.StringType())) for n in names])


def read_csv(
    spark: SparkSession, path: str, *, infer_schema: bool = False, mode: str = "FAILFAST"
) -> DataFrame:
    """Scan delimited files with a header.

    Types are declared, so no pass over the data is spent on finding them. A
    value that does not fit its type fails the job: turned into null it would
    drop the row from every count of its label. With ``infer_schema`` Spark
    finds the types in an extra pass instead.
    """
    if infer_schema:
        return spark.read.csv(path, header=True, inferSchema=True)
    # enforceSchema off: every file's own header is held against the schema.
    return spark.read.csv(
        path, schema=_header_schema(spark, path), header=True, enforceSchema=False, mode=mode
    )


@dataclass(frozen=True)
class Account:
    """A delimited read with nothing lost: rows that fit, rows that don't, and how many per file."""

    rows: DataFrame
    refused: DataFrame
    files: DataFrame


def read_csv_with_account(spark: SparkSession, path: str, *, header: bool = True) -> Account:
    """Read on past malformed rows, and tell which and how many they are.

    Malformed is a row with too few or too many values, or one with a value
    that does not fit its type. ``refused`` has file and text of each, ``files``
    has file, line_count, row_count and refused_count of every file with a
    line, the header aside. Without ``header`` the columns come in the order of
    the schema. The lines are parsed once, and what they gave is stored; all
    three tables are scans of that.
    """
    declared = _header_schema(spark, path) if header else S.TRANSACTION_SCHEMA
    taken = {name.lower() for name in declared.names}
    text, file = (_free_name(n, taken) for n in ("line_text", "line_file"))
    schema = T.StructType([*declared, T.StructField(text, T.StringType())])
    # A file whose header has another order fails the read: all of its rows would be wrong.
    parsed = spark.read.csv(
        path,
        schema=schema,
        header=header,
        enforceSchema=not header,
        mode="PERMISSIVE",
        columnNameOfCorruptRecord=text,
    )
    named = parsed.withColumn(file, F.col("_metadata.file_path"))
    stored = materialize(named, "lines")
    bad = F.col(text).isNotNull()
    counts = stored.groupBy(F.col(file).alias("file")).agg(
        F.count(F.lit(1)).alias("line_count"),
        F.count_if(~bad).alias("row_count"),
        F.count_if(bad).alias("refused_count"),
    )
    refused = stored.filter(bad).select(F.col(file).alias("file"), F.col(text).alias("text"))
    return Account(stored.filter(~bad).select(*declared.names), refused, counts)


def _free_name(name: str, taken: set[str]) -> str:
    while name in taken:
        name += "_"
    return name


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Scan Parquet files as they are stored.

    A label kept as bigint, say, is not cast: the operators take any number,
    and a cast would keep filters on it from the scan.
    """
    df = spark.read.parquet(path)
    _require(df.columns, path)
    for field in S.TRANSACTION_SCHEMA:
        text = isinstance(df.schema[field.name].dataType, T.StringType)
        if text != isinstance(field.dataType, T.StringType):
            stored = df.schema[field.name].dataType.simpleString()
            raise ValueError(f"{path}: {field.name} is stored as {stored}")
    return df


def write_csv(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    df.write.csv(path, header=True, mode=mode)


def schema_profile(df: DataFrame) -> DataFrame:
    """One row per column: position, name and type."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    types = "position int, column_name string, column_type string"
    return df.sparkSession.createDataFrame(rows, types)
