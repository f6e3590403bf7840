"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bounds of a folder package: files, bytes of one, bytes of all.
MOST_FILES, MOST_FILE_BYTES, MOST_BYTES = 2048, 8 << 20, 64 << 20


#: Functions that a program may read without binding them.
BUILTINS = ("len", "sum", "abs", "min", "max", "range")


def name_origins(names: DataFrame, scope: DataFrame) -> DataFrame:
    """(name, origin, maybe_unbound): value for a name of the scope, else builtin, else external; a plan that reads an external name that no table has fails at analysis."""
    own = scope.select("name", F.lit(True).alias("bound")).distinct()
    origin = F.when(F.col("bound"), "value").when(F.col("name").isin(*BUILTINS), "builtin").otherwise("external")
    return names.join(own, "name", "left").select("name", origin.alias("origin"), (origin == "external").alias("maybe_unbound"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """A file a program reads by path: parquet, csv, json, text, orc or binaryFile."""
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def number_range(spark: SparkSession, start: int, stop: int, step: int = 1, partitions: int | None = None) -> DataFrame:
    """``range(start, stop, step)`` as rows, split over the cluster."""
    return spark.range(start, stop, step, partitions) if step else spark.range(0)


def package_limits(files: DataFrame, by: str | None = None) -> DataFrame:
    """(by, files, bytes, refused) of files (bytes, ...), of each package if `by` names them; refused is the limit that is broken, if any."""
    refused = F.when(F.max("bytes") > MOST_FILE_BYTES, "file_too_large").when(F.count("*") > MOST_FILES, "too_many_files").when(F.sum("bytes") > MOST_BYTES, "too_large")
    return files.groupBy(*[by] * (by is not None)).agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), refused.alias("refused"))


def package(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files of a folder, with their paths in it, sizes and digests; contents are read once, where the files are hashed.

    A folder over a limit is refused as a whole, on its listing, before any content is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    broken = package_limits(files.select(F.col("length").alias("bytes"))).first().refused
    if broken:
        raise ValueError(f"the folder is refused: {broken}")
    inside = F.regexp_replace("path", r"^\w+:/*(?=/)", "")
    return files.select(inside.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def package_identity(files: DataFrame) -> DataFrame:
    """One digest of a folder: its sorted (path, size, digest) lines.  They are one row, so a folder over MOST_FILES files is refused."""
    if files.limit(MOST_FILES + 1).count() > MOST_FILES:
        raise ValueError("the folder is refused: too_many_files")
    line = F.concat_ws("\t", "path", F.col("bytes").cast("string"), "sha256")
    return files.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("identity"))


def write_report(frame: DataFrame, path: str) -> None:
    """A report is created once and never written over."""
    frame.write.mode("errorifexists").json(path)


def newest(frame: DataFrame, keep: int, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """Retention: the first `keep` rows in the given order, of each group if `by` is given.

    With groups a window ranks them (Spark limits each group before the shuffle); without, a top-k needs no single task for all rows.
    """
    if not by:
        return frame.orderBy(*order).limit(keep)
    return frame.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= keep).drop("__n")


def decode_json(column: str, schema: str) -> Column:
    """A control record: anything but the schema's JSON raises."""
    return F.from_json(column, schema, {"mode": "FAILFAST"})


def encode_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def bounded_text(column: str, most: int, tail: int) -> tuple[Column, Column]:
    """The end of captured output, and whether it was cut."""
    size = F.octet_length(F.col(column))
    return F.when(size > most, F.substring(F.col(column), -tail, tail)).otherwise(F.col(column)), size > most


def dot_lines(edges: DataFrame) -> DataFrame:
    """A graph in DOT, a line for each edge."""
    return edges.select(F.format_string('  "%s" -> "%s";', "source", "target").alias("line"))
