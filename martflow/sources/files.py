"""File scans: by hour folder, by day folder, whole tables, text files, ledgers.

A range scan lists only the folders of its range and opens them in one read, so
its cost follows the range and not the age of the table, and the plan does not
grow with the number of folders.
"""

from __future__ import annotations

from datetime import datetime, time, timedelta
from itertools import groupby
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from martflow import storage
from martflow.functions.logs import LOG_LINE_SCHEMA

HOUR_PARTS = ("year", "month", "day", "hour")
# The zones of the landing.
LANDING_TZ, LOCAL_TZ = "UTC", "Asia/Seoul"
CSV_TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss"


class MissingFolders(FileNotFoundError):
    """Folders that a scan needs and did not find."""


def _schema(schema: StructType | str | None) -> StructType | None:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _first_of(hour: datetime) -> datetime:
    return hour.replace(minute=0, second=0, microsecond=0)


def hours_between(since: datetime, until: datetime) -> list[datetime]:
    """Every full hour from the hour of ``since`` to the hour of ``until``, both included."""
    start, end = _first_of(since), _first_of(until)
    count = int((end - start) / timedelta(hours=1)) + 1
    return [start + timedelta(hours=i) for i in range(max(count, 0))]


def _hour_of(folder: str) -> datetime:
    parts = dict(p.split("=", 1) for p in folder.split("/")[-4:])
    return datetime(*(int(parts[name]) for name in HOUR_PARTS))


def oldest_hour(spark: SparkSession, root: str) -> datetime | None:
    """The hour of the oldest hour folder; None if there is none.  A listing per level."""
    folder = root.rstrip("/")
    for part in HOUR_PARTS:
        found = storage.folders(spark, f"{folder}/{part}=*")
        numbered = [(int(f.rsplit("=", 1)[1]), f) for f in found if f.rsplit("=", 1)[1].isdigit()]
        if not numbered:
            return None
        folder = min(numbered)[1]
    return _hour_of(folder)


def newest_hour(spark: SparkSession, root: str, since: datetime, until: datetime) -> datetime | None:
    """The last hour of a range that has a folder: how far a scan of it has read."""
    hours = hours_between(since, until)
    wanted = set(hours)
    return max((h for h, _ in _hour_folders(spark, root.rstrip("/"), hours) if h in wanted), default=None)


def local_clock(utc: datetime, tz: str) -> datetime:
    """A UTC time on the clock that names a landing's folders."""
    return utc.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(tz)).replace(tzinfo=None)


def _hour_folders(spark: SparkSession, root: str, hours: list[datetime]) -> list[tuple]:
    """``(hour, folder)`` of every hour folder of the days in range; one listing per
    day.  Month, day and hour may be written with or without a leading zero."""
    found = []
    for day, _ in groupby(hours, key=lambda h: h.date()):
        month, date = (f"{{{n:02d},{n}}}" for n in (day.month, day.day))
        pattern = f"{root}/year={day.year}/month={month}/day={date}/hour=*"
        found += [(_hour_of(f), f) for f in storage.folders(spark, pattern)]
    return found


def _paths(found: list[tuple], wanted: set[datetime]) -> list[str]:
    """Folders to open: a day's own folder when all its hours are wanted, so a long
    range stays a short list."""
    paths = []
    for day, hours in groupby(found, key=lambda f: f[1].rsplit("/", 1)[0]):
        inside = [(h in wanted, folder) for h, folder in hours]
        if all(ok for ok, _ in inside):
            paths.append(day)
        else:
            paths += [folder for ok, folder in inside if ok]
    return paths


def scan_hours(
    spark: SparkSession,
    root: str,
    since: datetime,
    until: datetime,
    fmt: str = "json",
    schema: StructType | str | None = None,
    missing: str = "error",
) -> DataFrame:
    """All ``year=/month=/day=/hour=`` folders of a range of hours, both ends included.

    ``missing="error"`` fails if any hour has no folder, ``"skip"`` reads what is
    there.  A log scan (``fmt="json"``) has a default schema, so no inference job
    runs.  Columns are matched by name, whatever their order in a file.
    """
    root = root.rstrip("/")
    hours = hours_between(since, until)
    found = _hour_folders(spark, root, hours)
    there = {hour for hour, _ in found}
    absent = [h for h in hours if h not in there]
    if absent and missing == "error":
        raise MissingFolders(f"{len(absent)} hours missing under {root}, first {absent[0]}")
    declared = _schema(schema or (LOG_LINE_SCHEMA if fmt == "json" else None))
    paths = _paths(found, set(hours))
    if not paths:
        if declared is None:
            raise MissingFolders(f"no hour folder under {root} and no schema given")
        named = StructType(
            [f for f in declared.fields if f.name not in HOUR_PARTS]
            + [StructField(p, IntegerType()) for p in HOUR_PARTS]
        )
        return spark.createDataFrame([], named)
    reader = spark.read.format(fmt).option("basePath", root)
    if fmt == "parquet" and declared is None:
        reader = reader.option("mergeSchema", "true")
    return (reader.schema(declared) if declared is not None else reader).load(paths)


def prune_hours(table: DataFrame, since: datetime, until: datetime) -> DataFrame:
    """Keep the hours of a range of a table partitioned by ``year, month, day, hour``.
    The predicate uses partition columns only, so it prunes folders."""

    def packed(parts):
        year, month, day, hour = parts
        return ((year * 100 + month) * 100 + day) * 100 + hour

    stamp = packed([F.col(p) for p in HOUR_PARTS])
    low, high = (packed([getattr(t, p) for p in HOUR_PARTS]) for t in (since, until))
    # The bare year is the part a catalog can use when it lists folders.
    years = F.col("year").between(since.year, until.year)
    return table.where(years & stamp.between(low, high))


def day_folders(
    since: datetime | None,
    until: datetime,
    lookback: timedelta | None = None,
    source_tz: str = LANDING_TZ,
    local_tz: str = LOCAL_TZ,
) -> list[str]:
    """``yyyy/MM/dd`` of every day to read, the day of ``until`` included.

    Folders are stamped in ``source_tz`` and bookmarks in ``local_tz``, so the
    start moves to the source's clock.  Without a bookmark the start is
    ``until - lookback``, unshifted.
    """
    if since is None:
        if lookback is None:
            raise ValueError("without a start, a list of days needs a look-back")
        start = until - lookback
    else:
        local = since.replace(tzinfo=ZoneInfo(local_tz))
        start = local.astimezone(ZoneInfo(source_tz)).replace(tzinfo=None)
    last = datetime.combine(until.date(), time.max)
    days = (last - start).days + 1 if start <= last else 0
    return [f"{start + timedelta(days=i):%Y/%m/%d}" for i in range(days)]


def _day_paths(
    spark: SparkSession,
    root: str,
    since: datetime | None,
    until: datetime,
    lookback: timedelta | None,
    source_tz: str,
    local_tz: str,
) -> list[tuple[str, str]]:
    """``(yyyy/MM/dd, folder)`` of the days that are there; one listing per month."""
    if since is None and lookback is None:
        found = [(f[-10:], f) for f in storage.folders(spark, f"{root}/[0-9]*/[0-9]*/[0-9]*")]
        return [(d, f) for d, f in found if d <= f"{until:%Y/%m/%d}"]
    paths = []
    for month, days in groupby(
        day_folders(since, until, lookback, source_tz, local_tz), key=lambda d: d[:7]
    ):
        there = {f[-10:]: f for f in storage.folders(spark, f"{root}/{month}/*")}
        paths += [(d, there[d]) for d in days if d in there]
    return paths


def newest_day(
    spark: SparkSession,
    root: str,
    since: datetime | None,
    until: datetime,
    source_tz: str = LANDING_TZ,
    local_tz: str = LOCAL_TZ,
) -> datetime | None:
    """The last day of a range that has a folder, on the source's clock."""
    days = _day_paths(spark, root.rstrip("/"), since, until, None, source_tz, local_tz)
    return datetime.strptime(max(days)[0], "%Y/%m/%d") if days else None


def scan_days(
    spark: SparkSession,
    root: str,
    since: datetime | None,
    until: datetime,
    lookback: timedelta | None = None,
    source_tz: str = LANDING_TZ,
    local_tz: str = LOCAL_TZ,
    fmt: str = "parquet",
    schema: StructType | str | None = None,
) -> DataFrame:
    """All ``yyyy/MM/dd`` folders of a range; days without a folder are skipped.
    Without a bookmark the scan begins at the oldest folder, or ``lookback`` ago."""
    root = root.rstrip("/")
    paths = [f for _, f in _day_paths(spark, root, since, until, lookback, source_tz, local_tz)]
    declared = _schema(schema)
    if not paths:
        if declared is None:
            raise MissingFolders(f"no day folder under {root} and no schema given")
        return spark.createDataFrame([], declared)
    reader = spark.read.format(fmt)
    if declared is not None:
        return reader.schema(declared).load(paths)
    return (reader.option("mergeSchema", "true") if fmt == "parquet" else reader).load(paths)


def scan_full(
    spark: SparkSession,
    root: str,
    schema: StructType | str | None = None,
    fmt: str = "parquet",
    evolved: bool = False,
) -> DataFrame:
    """A whole table folder, with its partition columns.  ``evolved`` collects the
    columns of all files, for a table whose schema changed."""
    reader = spark.read.format(fmt).option("mergeSchema", evolved)
    return (reader.schema(schema) if schema is not None else reader).load(root)


def scan_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    header: bool = True,
    timestamp_format: str = CSV_TIMESTAMP,
    multiline: bool = False,
) -> DataFrame:
    """Delimited text with a declared schema.  A file is read by several tasks, unless
    ``multiline``: quoted fields may then span lines, and a file is one task."""
    return (
        spark.read.schema(schema)
        .option("header", header)
        .option("timestampFormat", timestamp_format)
        .option("timestampNTZFormat", timestamp_format)
        .option("enforceSchema", "false")
        .option("multiLine", multiline)
        .option("escape", '"')
        .csv(path)
    )


def seed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A small reference list kept as CSV.  Spark broadcasts it when the size of
    its file passes the broadcast check; nothing forces it."""
    return spark.read.schema(schema).option("header", True).csv(path)


def describe_files(spark: SparkSession, path: str, fmt: str = "parquet") -> StructType:
    """Schema of files, read from their footers."""
    return spark.read.format(fmt).load(path).schema


def _listed(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select(F.col("path").alias("file_name"), "modificationTime")
    )


def unprocessed_files(
    spark: SparkSession, root: str, ledger: str, pattern: str = "*.parquet"
) -> DataFrame:
    """Files under ``root`` that the ledger does not name.  Only names and times
    are listed; no content is read."""
    listed = _listed(spark, root, pattern)
    if not storage.exists(spark, ledger):
        return listed
    done = spark.read.parquet(ledger).select("file_name")
    return listed.join(done, "file_name", "left_anti")


def read_unprocessed(
    spark: SparkSession, files: DataFrame, schema: StructType | str, fmt: str = "parquet"
) -> DataFrame:
    """The rows of the files that ``unprocessed_files`` has listed; only these are
    opened.  Their paths are what the plan of any read holds on the driver."""
    paths = [r["file_name"] for r in files.select("file_name").toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], _schema(schema))
    return spark.read.format(fmt).schema(schema).load(paths)


def mark_processed(files: DataFrame, ledger: str, at: datetime) -> None:
    """Add files to the ledger with the time they were processed."""
    stamp = F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz").alias("processed_at")
    files.select("file_name", stamp).write.mode("append").parquet(ledger)
