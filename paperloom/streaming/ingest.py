"""Files as a stream: each new file is parsed once; the newest version of a path counts.

Parsing has no state, so the stream needs no watermark. A batch writes its own folder, which a repeated
batch overwrites: after a failure nothing is lost or doubled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.documents import parse

FILES = "path string, modificationTime timestamp, length long, content binary"


def document_stream(spark: SparkSession, path: str, glob: str = "*.{docx,doc}", files_per_batch: int = 1000, outputs: tuple[str, ...] = ("text", "markdown")) -> DataFrame:
    """New files under ``path``, parsed, with their modification times."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(path)
    keyed = files.select(F.struct("path", "modificationTime").alias("file"), "content")
    parsed = parse(keyed, "file", outputs=outputs)
    return parsed.select("file.path", F.col("file.modificationTime").alias("modified"), *[c for c in parsed.columns if c != "file"])


def ingest(stream: DataFrame, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The newest version of each path; of equal times the later batch."""
    newest = W.partitionBy("path").orderBy(F.desc("modified"), F.desc("batch"))
    return spark.read.parquet(out).withColumn("_k", F.row_number().over(newest)).where("_k = 1").drop("_k", "batch")
