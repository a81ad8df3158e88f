"""Resumable extraction: new notes files go through the model once, in micro-batches with a checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tandem.operators.extract import TEMPLATE, KeywordClient, extract, prompts
from tandem.sources.files import NOTES, done_ids


def extract_new(
    spark: SparkSession,
    notes_folder: str,
    out: str,
    checkpoint: str,
    aliases: Mapping[str, str],
    factory: Callable[[], object] = KeywordClient,
    template: str = TEMPLATE,
) -> StreamingQuery:
    """Run all notes (JSON lines) that came since the last call; patients already in ``out`` are left out."""
    stream = spark.readStream.schema(NOTES).json(notes_folder)

    def batch(rows: DataFrame, _: int) -> None:
        fresh = rows.dropDuplicates(["patient_id"]).join(done_ids(rows.sparkSession, out), "patient_id", "left_anti")
        done = extract(prompts(fresh, aliases, template), factory)
        done.filter("error IS NULL").drop("error").write.mode("append").json(out)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
