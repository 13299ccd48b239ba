"""A query log as a stream: each micro-batch of searches folds into the learner's state. Windowed counts on events are an extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.learning import Learner


def learn_from(stream: DataFrame, learner: Learner, search: Callable[[str], list[dict]], checkpoint: str) -> StreamingQuery:
    """stream: a column query. A batch is at most what a trigger brings; searches of a batch run in the order of the queries' text."""

    def fold(batch: DataFrame, _: int) -> None:
        for r in batch.select("query").orderBy("query").toLocalIterator():
            learner.learn(r["query"], search(r["query"]))

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per type and window with a watermark; works on streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
