"""New log files as a stream: each micro-batch of whole files goes through the batch index run.

A session log is one file, so a stream is complete inside its micro-batch and no state crosses
batches. A batch replaces its streams in the index like a run does, but prunes nothing, since it has not seen
the other files: delivered again, or with a file written anew, it leaves every stream there once. It
writes the buckets its streams fall in, so a batch should hold many files. A file without any line never
arrives; the next batch run finds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sessionlens.plans import manifest, sinks
from sessionlens.plans.index import IndexConfig, index_files, new_folder, settings
from sessionlens.session import materialise
from sessionlens.sources import logs


def index_stream(spark: SparkSession, root: str, path: str, checkpoint: str,
                 config: IndexConfig = IndexConfig(), files_per_batch: int = 1000,
                 buckets: int = sinks.BUCKETS) -> StreamingQuery:
    """Index files as they arrive under ``root``; runs over what is there, then stops."""
    arriving = (
        spark.readStream.schema("value string").format("text")
        .option("recursiveFileLookup", True).option("pathGlobFilter", logs.FILE_GLOB)
        .option("maxFilesPerTrigger", files_per_batch).load(root)
        .select("value", F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_size").alias("length"),
                F.col("_metadata.file_modification_time").alias("modified"))
    )

    def index_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        folder = new_folder(session)
        listed = logs.files_of(batch.groupBy("file", "length", "modified").agg(F.count("value")))
        files = materialise(manifest.described(listed, root, settings(config)), "listed", folder)
        rows = index_files(logs.lines_of(batch, F.col("file"), keyed=True), files, config, folder)
        base = sinks.open_index(session, path)
        old = files.select(*manifest.FILE, F.col("folder_id").alias("session_id"), "source_file").where("false")
        if base is not None:
            old = base.table(sinks.MANIFEST).join(files.select(*manifest.FILE), manifest.FILE, "left_semi")
        sinks.replace_in_index(session, path, rows, old, old.select(*manifest.FILE), base, buckets)

    return (arriving.writeStream.foreachBatch(index_batch)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
