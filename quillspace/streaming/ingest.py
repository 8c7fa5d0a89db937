"""Documents that keep arriving: a folder watched into a library, and counts kept up as they come.

Counts of terms are sums, so they can be carried forward batch by batch; spaces are made by a new build,
which a library asks for through is_stale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import text as T
from ..library import Library
from ..sources.mapping import FieldMapping


def watch(lib: Library, records: DataFrame, checkpoint: str, mapping: FieldMapping | None = None, name: str = "stream", once: bool = False) -> StreamingQuery:
    """Add each batch of a stream of records to lib. A batch that runs again replaces what it had added.

    once: take what is there, in as many batches as it needs, and end. An empty batch adds nothing.
    """

    def add(batch: DataFrame, n: int) -> None:
        if batch.limit(1).count():
            lib.add_records(batch, mapping, source=f"{name}#{n}")

    writer = records.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def term_counts(records: DataFrame, text: str = "text") -> DataFrame:
    """token, n over all that came, for the update or complete mode. State: a number for each word."""
    return records.select(F.explode(T.portable_tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def windowed_term_counts(records: DataFrame, at: str, late: str = "10 minutes", width: str = "5 minutes", text: str = "text") -> DataFrame:
    """start, token, n by windows of event time; a window's state goes once it is `late` behind, and later rows are dropped."""
    rows = records.select(at, F.explode(T.portable_tokens(F.col(text))).alias("token")).withWatermark(at, late)
    return rows.groupBy(F.window(at, width), "token").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "token", "n")
