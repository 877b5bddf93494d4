"""Sources and sinks of the catalogue."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hash_parts(column: str, parts: int) -> list[str]:
    """Predicates of which each row meets one, whatever sign its hash has, or none at all."""
    each = [f"mod(mod(hashtext({column}), {parts}) + {parts}, {parts}) = {k}" for k in range(parts)]
    return [f"({each[0]} OR {column} IS NULL)", *each[1:]]


def jdbc_offers(spark: SparkSession, url: str, table: str, columns: list[str], parts: int = 8, **options: str) -> DataFrame:
    """A projected scan of a database view; filters on it are pushed to the database. The
    read is split by a hash of the id, so that no executor reads all rows; rows without an
    id come with the first part."""
    predicates = hash_parts("id", parts)
    return spark.read.jdbc(url, table, predicates=predicates, properties=options).select(*columns)


def snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON snapshot, one row for each line, typed by the given schema."""
    return spark.read.schema(schema).json(path)


def csv_upload(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def first_source(*sources: Callable[[], DataFrame]) -> DataFrame:
    """The first source that can be read and has rows; an empty one counts as failed."""
    why: list[str] = []
    for source in sources:
        try:
            rows = source()
            if not rows.isEmpty():
                return rows
            why.append("no rows")
        except Exception as error:  # each failure is reported if no source is left
            why.append(str(error).splitlines()[0])
    raise ValueError(f"no source has rows: {why}")


def content_hash(df: DataFrame) -> int | None:
    """A hash of all rows in any order: the sum of row hashes."""
    return df.select(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()[0]


def write_if_changed(df: DataFrame, path: str, schema: str) -> bool:
    """Write the snapshot unless the one at path has the same rows; whether it was written.

    df is computed once, into a folder beside path that then takes its place, so df may read
    path itself, and a failed run leaves the old snapshot whole.
    """
    spark = df.sparkSession
    beside = f"{path.rstrip('/')}.next-{uuid.uuid4().hex}"
    df.write.json(beside)
    columns = [c for c in spark.createDataFrame([], schema).columns if c in df.columns]
    try:
        same = content_hash(snapshot(spark, path, schema).select(*columns)) == content_hash(snapshot(spark, beside, schema).select(*columns))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):  # one that cannot be read is not overwritten
            _remove(spark, beside)
            raise
        same = False
    if same:
        _remove(spark, beside)
    else:
        _take_place(spark, beside, path)
    return not same


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _remove(spark: SparkSession, name: str) -> None:
    fs, path = _path(spark, name)
    fs.delete(path, True)


def _take_place(spark: SparkSession, beside: str, path: str) -> None:
    """Rename: the old folder aside, the new one to its place, then the old one goes."""
    fs, new = _path(spark, beside)
    _, place = _path(spark, path)
    _, aside = _path(spark, f"{beside}-old")
    if fs.exists(place) and not fs.rename(place, aside):
        raise OSError(f"{path} cannot be moved")
    if not fs.rename(new, place):
        raise OSError(f"{beside} cannot take the place of {path}")
    if fs.exists(aside):
        fs.delete(aside, True)


def write_lines(df: DataFrame, path: str, line: str = "line") -> None:
    """A text sink, one file for each partition, lines sorted in each."""
    df.select(line).sortWithinPartitions(line).write.mode("overwrite").text(path)


def write_ordered(df: DataFrame, path: str, *order: str, line: str = "line") -> None:
    """A text sink whose files, by name, hold the lines in order: sorted by ranges, so no
    task sees all lines."""
    df.orderBy(*order).select(line).write.mode("overwrite").text(path)
