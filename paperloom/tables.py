"""Written intermediate tables, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local_base: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, the warehouse on a cluster and a temporary
    folder on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir") + "/_paperloom"
    if not _local_base:
        _local_base.append(tempfile.mkdtemp(prefix="paperloom-"))
    return "file://" + _local_base[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """The frame, read back from Parquet: no lineage, and the same rows in the same partitions for every reader."""
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of input for each core below which a scan may leave cores idle: a file is read by at least such parts.
LITTLE = 4 << 20


def spread(rows: DataFrame) -> DataFrame:
    """Rows that cost much each, dealt over all cores where the input is small, as a file of one row group is read by
    one task; larger inputs stay where they are. Decided by the size that the plan knows; no job runs."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < LITTLE * cores else rows


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows that cost much each, by their keys in four parts a core at least, so that no core waits long for another.
    Merged by size, as parts are without a number, few bytes are few parts, and one more than there are cores takes
    twice the time. Decided by the size that the plan knows; no job runs."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(max(4 * cores, min(size // PART, MOST_PARTS)), *keys)


def parted(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a table by their keys, in parts that grow in number with the input and not in size, whatever number of
    shuffle partitions the session has: a part is sorted in the memory of one task. A task that writes for more parts than
    Spark's ``bypassMergeThreshold`` holds all rows of its split, so up to four times larger parts are taken before that
    number is passed. Decided as by ``dealt``."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(_parts(rows, size, SORTED), *keys)


def _parts(rows: DataFrame, size: int, most: int) -> int:
    """Parts of at most ``most``, four times that where more than a task streams would be needed."""
    context = rows.sparkSession.sparkContext
    streamed = int(context.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    return max(context.defaultParallelism, min(size // most, streamed), min(size // (4 * most), MOST_PARTS))


def same(keys: list[str], others: list[str]) -> Column:
    """Whether the keys are equal, null to null."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, others, strict=True)])


def split(rows: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows as ``parted`` deals them, and apart from them those of keys too large for one task (None without such): cut
    by ranges of keys and order into ``_piece``, which ascend with these, and written once. Inputs of some size are
    counted for that: by buckets of keys, which are as few however many keys there are, then the keys of full ones."""
    spark = rows.sparkSession
    if int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 4 * SORTED:
        return parted(rows, *keys), None
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    full = [r[0] for r in rows.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_rows")).where(F.col("_rows") > LARGE).collect()]
    if not full:
        return parted(rows, *keys), None
    named = [f"_k{i}" for i in range(len(keys))]
    counted = rows.where(bucket.isin(full)).groupBy(*(F.col(k).alias(n) for k, n in zip(keys, named, strict=True))).agg(F.count("*").alias("_rows"))
    large = written(counted.where(F.col("_rows") > LARGE), new_path(spark, "large"))
    total = large.agg(F.sum("_rows")).first()[0]
    if not total:
        return parted(rows, *keys), None
    large, on = F.broadcast(large.drop("_rows")), same(keys, named)
    cut = rows.join(large, on, "left_semi").repartitionByRange(_parts(rows, total, LARGE // 4), *keys, *order)
    return parted(rows.join(large, on, "left_anti"), *keys), written(cut.withColumn("_piece", F.spark_partition_id()), new_path(spark, "pieces"))


#: Bytes of input, packed and of the columns in use, of a part that is sorted: some thirty times that in memory.
SORTED = 2 << 20
#: Bytes of input of a part where there are more than four parts a core, and a bound on their number.
PART, MOST_PARTS = 32 << 20, 10_000
#: Rows of a key beyond which it is cut, into pieces of a quarter of that as ``parted`` has it; buckets to find such keys.
LARGE, BUCKETS = 1 << 20, 1 << 16
