"""Files and databases as DataFrames, and CSV results out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tideframe.functions.names import q

# The separators and encodings on offer.
SEPARATORS = (",", ";", "\t", "|")
ENCODINGS = ("utf-8", "utf-8-sig", "cp949", "euc-kr")
# Encodings Spark 4 reads only with the wider Java charset list switched on.
JAVA_ONLY = frozenset({"cp949", "euc-kr"})


def read_csv(spark: SparkSession, path: str | list[str], sep: str = ",", encoding: str = "utf-8",
             max_rows: int | None = None, schema: T.StructType | str | None = None,
             columns: list[str] | None = None) -> DataFrame:
    """A CSV table with a header. Give a schema for large files: inferring reads them twice."""
    if sep not in SEPARATORS:
        raise ValueError(f"separator must be one of {SEPARATORS}")
    if encoding.lower() not in ENCODINGS:
        raise ValueError(f"encoding must be one of {ENCODINGS}")
    if encoding.lower() in JAVA_ONLY:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    charset = "utf-8" if encoding.lower() == "utf-8-sig" else encoding
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", charset)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return _kept(reader.csv(path), columns, max_rows)


def sql_options(url: str, query: str, fetch_rows: int = 50_000, user: str | None = None, password: str | None = None,
                driver: str | None = None, partition_column: str | None = None, lower=None, upper=None,
                partitions: int | None = None) -> dict[str, str]:
    """Reader options for a SELECT. With a partition column the read is split into
    ranges of it, so many executors fetch at once."""
    options = {"url": url, "fetchsize": str(fetch_rows)}
    for k, v in (("user", user), ("password", password), ("driver", driver)):
        if v is not None:
            options[k] = v
    if partition_column is None:
        return {**options, "query": query}
    if lower is None or upper is None or not partitions:
        raise ValueError("a partitioned read needs lower, upper and partitions")
    return {**options, "dbtable": f"({query}) source_query", "partitionColumn": partition_column,
            "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions)}


def read_sql(spark: SparkSession, options: dict[str, str], max_rows: int | None = None,
             columns: list[str] | None = None) -> DataFrame:
    """The rows of a query over JDBC; use an account that may only read."""
    return _kept(spark.read.format("jdbc").options(**options).load(), columns, max_rows)


def read_table(spark: SparkSession, query: str, params: dict | None = None, max_rows: int | None = None) -> DataFrame:
    """The rows of a query against the session's catalog."""
    df = spark.sql(query, params) if params else spark.sql(query)
    return df.limit(max_rows) if max_rows else df


def preview(load: Callable[[int], DataFrame], rows: int = 100) -> DataFrame:
    """The first rows only, the limit handed to the reader."""
    return load(rows)


def _kept(df: DataFrame, columns: list[str] | None, max_rows: int | None) -> DataFrame:
    if columns:
        df = df.select(*[F.col(q(c)) for c in columns])
    return df.limit(max_rows) if max_rows else df


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
