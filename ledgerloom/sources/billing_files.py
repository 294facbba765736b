"""Billing exports in Parquet, in either generation of column names."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, DataFrameReader, Row, SparkSession, functions as F, types as T

from ledgerloom.fixed_values import EXPORT_COLUMNS, MANDATORY_COLUMNS
from ledgerloom.model import LINE_ITEMS

#: Footers that the driver waits for at the same time.
FOOTER_THREADS = 32


def export_generation(columns: Iterable[str]) -> str:
    """``v1`` if any column name holds a slash, else ``v2``."""
    return "v1" if any("/" in c for c in columns) else "v2"


def column_map(generation: str) -> dict[str, str]:
    """Normalized column to source column of one generation."""
    return {name: v1 if generation == "v1" else v2 for name, v1, v2, _ in EXPORT_COLUMNS}


def missing_optional(columns: Iterable[str]) -> list[str]:
    """Optional normalized columns the export lacks; raises if a mandatory one is lacking."""
    present = set(columns)
    sources = column_map(export_generation(present))
    lacking = sorted(name for name, source in sources.items() if source not in present)
    mandatory = [name for name in lacking if name in MANDATORY_COLUMNS]
    if mandatory:
        raise ValueError(f"export has no column for mandatory {', '.join(mandatory)}")
    return lacking


def _instant(column: Column, kind: T.DataType) -> Column:
    """A zone-less UTC timestamp, whatever the session zone is."""
    if isinstance(kind, T.TimestampType):
        return F.convert_timezone(
            F.current_timezone(), F.lit("UTC"), column.cast("timestamp_ntz")
        )
    if isinstance(kind, T.StringType):
        zoned = F.convert_timezone(
            F.current_timezone(),
            F.lit("UTC"),
            column.try_cast("timestamp").cast("timestamp_ntz"),
        )
        has_offset = column.rlike(r"[0-9][+-]\d{2}:?\d{2}$") & column.contains("T")
        return F.when(has_offset, zoned).otherwise(column.try_cast("timestamp_ntz"))
    return column.cast("timestamp_ntz")


def normalize_export(df: DataFrame, source_file: Column | str) -> DataFrame:
    """An export in the columns of the line-item table.

    Absent optional columns become NULL, and so does a value that does not
    convert. ``source_file`` is recorded with the time of ingestion.
    """
    missing_optional(df.columns)
    sources = column_map(export_generation(df.columns))
    present = {field.name: field.dataType for field in df.schema}

    def converted(field: T.StructField) -> Column:
        source = sources[field.name]
        if source not in present:
            return F.lit(None).cast(field.dataType)
        column = F.col(f"`{source}`")
        if isinstance(field.dataType, T.TimestampNTZType):
            return _instant(column, present[source])
        if isinstance(field.dataType, T.DateType) and isinstance(present[source], T.StringType):
            return column.substr(1, 10).try_cast(field.dataType)
        return column.try_cast(field.dataType)

    source_file = F.lit(source_file) if isinstance(source_file, str) else source_file
    ingested = F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")
    )
    return df.select(
        *[converted(f).alias(f.name) for f in LINE_ITEMS if not f.name.startswith("_")],
        ingested.alias("_ingested_at"),
        source_file.alias("_source_file"),
    )


def relative_key(path: Column, root: str) -> Column:
    """The part of a file's path below ``root``."""
    plain = root.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    return F.substring_index(path, plain + "/", -1)


@dataclass(frozen=True)
class Footer:
    """What a file's footer says, or why the file is unusable."""

    generation: str | None = None
    missing: tuple[str, ...] = ()
    error: str | None = None


@dataclass(frozen=True)
class Group:
    """Files whose columns have one type each, to be read by one scan."""

    paths: tuple[str, ...]
    schema: T.StructType


VERDICT = "s3_key string, part int, generation string, rows long, error string"


def read_footers(spark: SparkSession, paths: Sequence[str]) -> dict[str, Footer]:
    """The footer of each Parquet file, fetched through Hadoop's file systems by threads of the driver.

    For the few files that `examine_exports` cannot judge by what tasks read. A path works here if it works for
    ``spark.read``, with the same credentials. A file gets an error if its footer is unreadable or a mandatory column is absent.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def footer(path: str) -> Footer:
        try:
            source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf)
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
            try:
                fields = reader.getFooter().getFileMetaData().getSchema().getFields()
                columns = [field.getName() for field in fields]
            finally:
                reader.close()
            if not columns:
                raise ValueError("no columns")
            missing = missing_optional(columns)
        except Py4JJavaError as problem:
            return Footer(error=str(problem.java_exception))
        except ValueError as problem:
            return Footer(error=f"{type(problem).__name__}: {problem}")
        return Footer(export_generation(columns), tuple(missing))

    with ThreadPoolExecutor(FOOTER_THREADS) as pool:
        return dict(zip(paths, pool.map(footer, paths)))


def _lenient(spark: SparkSession) -> DataFrameReader:
    return spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")


def group_by_types(spark: SparkSession, paths: Sequence[str]) -> list[Group]:
    """Files in as few groups as their columns' types allow, with each group's columns.

    Spark reads the footers in tasks and merges their schemas. Where two files give one column different types
    the files are halved, so there are as many jobs as changes of types among them, not as files. Files whose
    footer is unreadable are in a group without columns of their own.
    """
    if not paths:
        return []
    try:
        merged = _lenient(spark).option("mergeSchema", "true").parquet(*paths).schema
    except (PySparkException, Py4JJavaError) as problem:
        if "UNABLE_TO_INFER_SCHEMA" in str(problem):
            return []
        if len(paths) == 1 or "MERGE" not in str(problem):
            raise
        half = len(paths) // 2
        return group_by_types(spark, paths[:half]) + group_by_types(spark, paths[half:])
    mapped = {name for _, v1, v2, _ in EXPORT_COLUMNS for name in (v1, v2)}
    return [Group(tuple(paths), T.StructType([field for field in merged if field.name in mapped]))]


def examine_exports(
    spark: SparkSession, keys: DataFrame, root: str, groups: Sequence[Group]
) -> DataFrame:
    """Whether the files ``keys`` (s3_key) can be loaded: (s3_key, part, generation, rows, error), one row per file.

    ``part`` is the place in ``groups``. Tasks count each file's rows twice: by its footer, and by reading its mandatory
    columns with broken files passed over. A file whose mandatory columns hold values and give as many rows as
    the footer says is fine. ``error`` is set on a file that does not exist or gives fewer rows. Of what else there is
    (unreadable, empty, a mandatory column absent or without any value) generation and error are NULL.
    """
    file = file_key(root).alias("s3_key")
    present = list_files(spark, root).select(F.col("key").alias("s3_key"), F.lit(True).alias("exists"))
    verdicts = keys.select("s3_key").distinct().join(present, "s3_key", "left")
    found = None
    for part, group in enumerate(groups):
        names = set(group.schema.names)
        sources = {g: [column_map(g)[c] for c in MANDATORY_COLUMNS] for g in ("v1", "v2")}
        counts = {
            g: F.least(*[F.count(f"`{c}`") for c in columns]) if names >= set(columns) else F.lit(0)
            for g, columns in sources.items()
        }
        scan = _lenient(spark).schema(group.schema).parquet(*group.paths)
        footers = _lenient(spark).schema(group.schema).parquet(*group.paths).select(file).groupBy("s3_key").agg(F.count("*").alias("rows"))
        touched = [f"`{c}`" for columns in sources.values() for c in columns if c in names]
        read = scan.select(file, *touched).groupBy("s3_key").agg(
            (F.max(F.xxhash64(*touched)).isNotNull() if touched else F.lit(False)).alias("any"),
            F.count("*").alias("read"),
            *[count.alias(g) for g, count in counts.items()],
        )
        own = footers.join(read, "s3_key").withColumn("part", F.lit(part))
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = spark.createDataFrame([], "s3_key string, rows long, any boolean, read long, v1 long, v2 long, part int")
    error = F.when(F.col("exists").isNull(), "the file does not exist").when(
        F.col("read") < F.col("rows"), F.format_string("only %d of %d rows can be read", "read", "rows")
    )
    generation = F.when(error.isNotNull(), None).when(F.col("v1") > 0, "v1").when(F.col("v2") > 0, "v2")
    return verdicts.join(found, "s3_key", "left").select(
        "s3_key", "part", generation.alias("generation"), "rows", error.alias("error")
    )


def scan_exports(spark: SparkSession, groups: Sequence[Group], verdicts: Iterable[Row], root: str) -> DataFrame:
    """Line items of the accepted files: one multi-path scan per group of types and generation."""
    together: dict[tuple[int, str], list[str]] = defaultdict(list)
    for row in verdicts:
        if row["error"] is None:
            together[row["part"], row["generation"]].append(f"{root}/{row['s3_key']}")
    if not together:
        return spark.createDataFrame([], LINE_ITEMS)
    scans = []
    for (part, generation), paths in sorted(together.items()):
        own = set(column_map(generation).values())
        schema = T.StructType([field for field in groups[part].schema if field.name in own])
        scans.append(normalize_export(spark.read.schema(schema).parquet(*sorted(paths)), file_key(root)))
    united = scans[0]
    for scan in scans[1:]:
        united = united.unionByName(scan)
    return united


def count_readable(spark: SparkSession, group: Group, paths: Sequence[str], root: str) -> DataFrame:
    """(s3_key, read): rows of each file that can be read in every mapped column, broken files passed over."""
    scan = _lenient(spark).schema(group.schema).parquet(*paths)
    every = F.max(F.xxhash64(*[f"`{name}`" for name in group.schema.names])).alias("any")
    return scan.groupBy(file_key(root).alias("s3_key")).agg(every, F.count("*").alias("read"))


def file_key(root: str) -> Column:
    """Key below ``root`` of the file a row was read from; the metadata escapes it as a URI."""
    escaped = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return relative_key(F.url_decode(escaped), root)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Keys of all files below ``root``. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(relative_key(F.col("path"), root).alias("key"))
