"""A stream of queries searched against a built lexicon."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from glossa.plans.search import SearchRun
from glossa.sources.tables import Lexicon


def search_stream(
    queries: DataFrame, lexicon: Lexicon, sink: Callable[[DataFrame, int], None], **options
) -> DataStreamWriter:
    """Ranks each micro-batch of queries(query_id, query, k) and hands it to ``sink(ranked, batch_id)``.

    ``batch_id`` lets the sink overwrite what a repeated batch had written. The
    tables of a batch are removed once its sink is done.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        with SearchRun(batch, lexicon, **options) as search:
            sink(search.ranked(), batch_id)

    return queries.writeStream.foreachBatch(run)
