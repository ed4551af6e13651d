"""Questions as a stream: every micro-batch runs the batch plan, no state is carried."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from lorequery.plans.ask import ask


def ask_stream(questions: DataFrame, pages: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Start a query that answers a streaming DataFrame (q_id, question); sink(results, batch_id) takes each batch.

    A sink that overwrites by batch_id makes the whole exactly-once.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(ask(batch, pages), number)

    writer = questions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
