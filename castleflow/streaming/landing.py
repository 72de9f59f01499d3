"""Incremental landing: new files of a folder are taken once each, in micro-batches."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from castleflow.operators import ingest
from castleflow.operators.archive import Archive


def land_stream(archive: Archive, folder: str, checkpoint: str, *, provider: str, endpoint_type: str, key: Column, fetched_at: Callable[[], float] = time.time, normalize: bool = True) -> StreamingQuery:
    """Land and normalize all files that ``folder`` has and earlier runs have not seen, then stop.

    The checkpoint remembers what was taken; landing is idempotent besides, so that a batch
    that runs again after a failure adds nothing twice.
    """
    files = archive.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)

    def take(batch: DataFrame, number: int) -> None:
        none = F.lit(None).cast("string")
        rows = batch.select(
            F.xxhash64("path").alias("seq"), F.lit(provider).alias("provider"), F.lit(endpoint_type).alias("endpoint_type"), F.col("path").alias("provider_url"), key.alias("canonical_source_key"), none.alias("request_params"), F.lit(200).cast("bigint").alias("response_status"),
            none.alias("response_headers"), F.lit("application/json").alias("content_type"), F.lit(int(fetched_at())).cast("bigint").alias("fetched_at"), F.col("content").alias("raw_body"),
        )
        if ingest.land(archive, rows) and normalize:
            ingest.normalize_pending(archive, int(fetched_at()))

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
