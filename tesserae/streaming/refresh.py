"""Pages that arrive as a stream, one sync a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tesserae.operators.chunking import Settings
from tesserae.sources.store import Store


def refresh(pages: DataFrame, store: Store, checkpoint: str, settings: Settings = Settings(), **trigger) -> StreamingQuery:  # noqa: B008
    """Start a query that syncs each micro-batch of a streaming fetched(pos, link_url, md_url, raw, error).

    A micro-batch is only part of the list, so a failure row is added to each: nothing is pruned. Syncing a batch again after a
    lost driver finds its pages unchanged.
    """

    def batch(rows: DataFrame, _: int) -> None:
        partial = rows.sparkSession.createDataFrame([(None, "", None, None, "a part of the list")], rows.schema)
        store.sync(rows.unionByName(partial), settings)

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
