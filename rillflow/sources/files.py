"""Flow files: tab-separated text with its data dictionary, JSON, Parquet by day, databases; and splitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a transaction.
BATCH = 40_000


def read_text(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Tab-separated flows whose first line names the columns after ``%``; all text unless there is a schema."""
    df = spark.read.csv(path, sep="\t", header=True, schema=schema) if schema else spark.read.csv(path, sep="\t", header=True)
    return df.withColumnRenamed(df.columns[0], df.columns[0].lstrip("%"))


def dictionary(df: DataFrame) -> DataFrame:
    """The data dictionary: number, type, name and description (from column metadata) of each column."""
    rows = [(i, f.dataType.simpleString(), f.name, f.metadata.get("desc", "")) for i, f in enumerate(df.schema, 1)]
    return df.sparkSession.createDataFrame(rows, "number int, type string, name string, description string")


def _flat(df: DataFrame) -> DataFrame:
    """Lists joined by ``;``, compound values by ``_``, as text files hold them."""

    def text(c, kind):
        if isinstance(kind, T.ArrayType):
            return F.array_join(F.transform(c, lambda x: text(x, kind.elementType)), ";", "")
        if isinstance(kind, T.StructType):
            return F.concat_ws("_", *(text(c[f.name], f.dataType) for f in kind))
        return c.cast("string")

    return df.select(*(text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType)) else F.col(f"`{f.name}`") for f in df.schema))


def write_text(df: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """Tab-separated flows, and their dictionary beside them; ``rows_per_file`` splits the output."""
    flat = _flat(df)
    first = flat.columns[0]
    flat.withColumnRenamed(first, f"%{first}").write.option("maxRecordsPerFile", rows_per_file).csv(f"{path}/flows", sep="\t", header=True)
    dictionary(df).coalesce(1).write.csv(f"{path}/headers", sep="\t", header=True)


def write_json(df: DataFrame, path: str, drop_empty: bool = True) -> None:
    """One object per flow; empty lists and texts are left out with ``drop_empty``."""
    if drop_empty:
        empty = lambda f: F.size(f.name) == 0 if isinstance(f.dataType, T.ArrayType) else F.col(f.name) == "" if isinstance(f.dataType, T.StringType) else F.lit(False)
        df = df.select(*(F.when(~F.coalesce(empty(f), F.lit(True)), F.col(f.name)).alias(f.name) for f in df.schema))
    df.write.option("ignoreNullFields", drop_empty).json(path)


def write_by_day(df: DataFrame, path: str, time_us: str) -> None:
    """Parquet partitioned by day, so that a report over a span reads its days alone."""
    df.withColumn("day", F.to_date(F.timestamp_micros(time_us))).write.partitionBy("day").parquet(path)


def write_database(df: DataFrame, url: str, name: str, **options: str) -> None:
    """Through JDBC, whatever driver is on the class path."""
    df.write.format("jdbc").options(url=url, dbtable=name, batchsize=BATCH, **options).mode("append").save()


def select_packets(packets: DataFrame, flows: DataFrame, on: Sequence[str] = ("flow_ind",), inside: bool = True) -> DataFrame:
    """The packets of listed flows, or all others (extraction by index)."""
    return packets.join(flows.select(*on).distinct(), list(on), "left_semi" if inside else "left_anti")
