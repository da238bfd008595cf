"""Which files of a stored table can hold a key: Bloom filters beside the table.

A batch of random keys spans the whole key range, so statistics skip nothing and a merge
would read the key column of every file to find the partitions it touches.  ``_key_index``
holds a filter of each file instead, two bytes a key, and only files whose filter admits a
key of the batch are opened.

A filter is cut into blocks of 8,192 keys on average; a key belongs to one block and sets one
bit in each of four bitmaps there, so a lookup is a join on the block.  The number of blocks
is a power of two that follows the file's rows: filters of small and large files are equally
exact (about 0.3 % of other keys pass).

The index is never trusted beyond what it knows.  A file that it does not hold in full (a
write by other means, a run that ended early, another key type) is read as before; entries
of files that are gone are ignored, and dropped once they outnumber the rest.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, IntegralType, StringType, StructType

from martflow import storage
from martflow.operators.relational import union_by_name
from martflow.sinks.writers import FILE, ROWS_OF, with_file

FOLDER = "_key_index"
BITMAPS, KEYS_A_BLOCK = 4, 8_192
_BITS = 15  # a bitmap of Spark's has 2^15 bits
_SCHEMA = ", ".join(
    ["file string, types string, rows long, own long, blocks long, block long"]
    + [f"bits_{i} binary" for i in range(BITMAPS)]
)


def _kind(kind: DataType) -> str | None:
    """The form in which a key is hashed; None for types whose equality a hash does not follow."""
    if isinstance(kind, IntegralType):
        return "bigint"
    return kind.simpleString() if isinstance(kind, (BooleanType, DateType)) or kind == StringType() else None


def _types(schema: StructType, keys: Sequence[str]) -> str | None:
    kinds = [_kind(schema[k].dataType) for k in keys]
    return None if None in kinds else ",".join(f"{k}:{kind}" for k, kind in zip(keys, kinds, strict=True))


def _hashes(schema: StructType, keys: Sequence[str]) -> list[Column]:
    cols = [F.col(k).cast(_kind(schema[k].dataType)) for k in keys]
    return [F.xxhash64(*cols).alias("_place"), F.xxhash64(F.lit(1), *cols).alias("_bits")]


def _bit(i: int) -> Column:
    return F.shiftright("_bits", _BITS * i).bitwiseAND(F.lit((1 << _BITS) - 1))


def _is_set(bitmap: str, bit: Column) -> Column:
    byte = F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("bigint"), (bit % 8).cast("int")) == 1


def _generations(spark: SparkSession, path: str) -> list[str]:
    """Complete sets of filters, oldest first."""
    found = storage.folders(spark, f"{path.rstrip('/')}/{FOLDER}/set-*")
    return [f for f in sorted(found, key=lambda f: int(f.rsplit("-", 1)[-1])) if storage.is_complete(spark, f)]


def _read(spark: SparkSession, path: str, types: str) -> DataFrame:
    sets = _generations(spark, path)
    if not sets:
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(_SCHEMA).parquet(sets[-1]).where(F.col("types") == types)


def _held(index: DataFrame) -> DataFrame:
    """Files whose blocks are all there: their rows add up to the file's."""
    blocks = index.groupBy("file", "block").agg(F.max("own").alias("_own"), F.max("rows").alias("_rows"))
    return blocks.groupBy("file").agg(F.sum("_own").alias("_own"), F.max("_rows").alias("_rows")).where("_own = _rows").select("file")


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """The table's files, from a listing; none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return files.load(path).select(F.col(FILE).alias("file"))


def in_files(target: DataFrame, files: DataFrame, most: int) -> DataFrame | None:
    """Rows of some files: their names are values in the plan, by which Spark's listing
    leaves out the others.  None if there are more than ``most``."""
    names = [r["file"] for r in files.select("file").distinct().limit(most + 1).toLocalIterator()]
    if len(names) > most:
        return None
    return target.where(F.col(FILE).isin(names)) if names else target.where(F.lit(False))


def rows_that_may_match(
    target: DataFrame, path: str, source: DataFrame, keys: Sequence[str], max_files: int = 10_000
) -> DataFrame:
    """Rows of those files of a stored ``target`` that can hold a key of ``source``.

    All rows come back if the key types differ, have no safe hash (fractions, times, nested
    values), or more than ``max_files`` files can hold a key: the index spares little then.
    """
    spark = target.sparkSession
    types = _types(target.schema, keys)
    if types is None or types != _types(source.schema, keys):
        return target
    index = _read(spark, path, types)
    # Powers of two: a few dozen values at most.
    levels = [r["blocks"] for r in index.select("blocks").distinct().toLocalIterator()]
    listed = listed_files(spark, path)
    files = listed.join(_held(index), "file", "left_anti")
    if levels:
        known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
        asked = source.where(known).select(*_hashes(source.schema, keys))
        asked = asked.select("*", F.explode(F.array(*map(F.lit, levels)).cast("array<long>")).alias("_blocks"))
        asked = asked.select("_bits", "_blocks", F.pmod("_place", "_blocks").alias("_block"))
        on = (F.col("blocks") == F.col("_blocks")) & (F.col("block") == F.col("_block"))
        for i in range(BITMAPS):
            on = on & _is_set(f"bits_{i}", _bit(i))
        hits = index.join(asked, on, "left_semi").select("file").distinct()
        files = union_by_name(files, listed.join(hits, "file", "left_semi"))
    found = in_files(target, files, max_files)
    return target if found is None else found


def index_keys(target: DataFrame, path: str, keys: Sequence[str], max_files: int = 10_000) -> None:
    """Add filters of the files of a stored ``target`` that the index does not hold.

    The first call reads the keys of the whole table, later ones those of new files."""
    spark = target.sparkSession
    types = _types(target.schema, keys)
    if types is None:
        raise ValueError(f"no index for the types of {list(keys)}")
    sets = _generations(spark, path)
    current = sets[-1] if sets else f"{path.rstrip('/')}/{FOLDER}/set-1"
    index = _read(spark, path, types)
    held, listed = _held(index), listed_files(spark, path)
    fresh = listed.join(held, "file", "left_anti")
    rows = in_files(target, fresh, max_files)
    if rows is None:
        rows = target.join(fresh.select(F.col("file").alias("_f")), F.col(FILE) == F.col("_f"), "left_semi")
    _filters(rows, keys, types).write.mode("append").parquet(current)
    state = held.join(listed.withColumn("_here", F.lit(True)), "file", "left")
    count = state.agg(F.count("_here").alias("here"), F.count(F.lit(1)).alias("all")).head()
    if count["all"] > 2 * count["here"] + 100:
        _drop_gone(spark, path, types, current, listed)


def _filters(rows: DataFrame, keys: Sequence[str], types: str) -> DataFrame:
    """One row for each block of each file."""
    sizes = rows.groupBy(F.col(FILE).alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    doublings = F.greatest(F.ceil(F.log2(F.col("rows") / KEYS_A_BLOCK)), F.lit(0)).cast("int")
    sizes = sizes.withColumn("blocks", F.call_function("shiftleft", F.lit(1).cast("long"), doublings))
    hashed = with_file(rows, *keys).select(F.col(ROWS_OF).alias("file"), *_hashes(rows.schema, keys))
    placed = hashed.join(sizes, "file").withColumn("block", F.pmod("_place", "blocks"))
    bitmaps = [F.bitmap_construct_agg(_bit(i)).alias(f"bits_{i}") for i in range(BITMAPS)]
    return placed.groupBy("file", F.lit(types).alias("types"), "rows", "blocks", "block").agg(
        F.count(F.lit(1)).alias("own"), *bitmaps
    ).select(*(part.split()[0] for part in _SCHEMA.split(", ")))


def _drop_gone(spark: SparkSession, path: str, types: str, current: str, listed: DataFrame) -> None:
    """Write the filters of files that are there as a new set, which counts when complete."""
    number = int(current.rsplit("-", 1)[-1]) + 1
    following = f"{path.rstrip('/')}/{FOLDER}/set-{number}"
    _read(spark, path, types).join(listed, "file", "left_semi").write.mode("overwrite").parquet(following)
    storage.delete(spark, current)
