"""Submissions scored as they arrive: each micro-batch joins the static corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillmesh.operators.similarity import sentence_sources


def score_stream(submissions: DataFrame, docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the sources of new (org_id, text) rows below `out`, one folder for each micro-batch.

    The corpus is a snapshot for the time of a batch. A batch that is run again overwrites its own
    folder, so results are exactly once; the checkpoint takes the place of a job's state column.
    """

    def score(batch: DataFrame, number: int) -> None:
        sentence_sources(batch, docs).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return submissions.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
