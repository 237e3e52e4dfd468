"""How many results each step of a search session asks for.

A session is an ordered log of queries and presses of "more". The page size
starts at 12, doubles with every press, and falls back to 12 when the query
changes. An empty query clears the session.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glossa.functions import paging
from glossa.functions.paging import FIRST_PAGE, page_size, page_size_of
from glossa.session import cut

# Send the functions themselves to the executors, which need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(paging)


def page_of(presses: Column) -> Column:
    return page_size(FIRST_PAGE, presses)


def page_sizes(log: DataFrame, session: str, order: list[str]) -> DataFrame:
    """Adds ``presses`` and ``page_size`` to a log with ``query`` (null = "more").

    Sessions may be of any length: the log is range-partitioned in order, every
    task works on its own stretch, and what carries over from one stretch to
    the next is one row per session and stretch.
    """
    cols = [session, *order]
    log = cut(log.repartitionByRange(*cols).withColumn("_part", F.spark_partition_id()))
    here = Window.partitionBy(session, "_part").orderBy(*order)
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    stretches = Window.partitionBy(session).orderBy("_part")
    earlier = stretches.rowsBetween(Window.unboundedPreceding, -1)

    last_query = log.groupBy(session, "_part").agg(
        F.max_by("query", F.when(F.col("query").isNotNull(), F.struct(*order))).alias("_last")
    )
    carried = last_query.select(session, "_part", F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
    previous = F.coalesce(F.last("query", ignorenulls=True).over(before), F.col("_carry"), F.lit(""))
    steps = log.join(carried, [session, "_part"]).withColumn("_previous", previous)
    # An empty query always resets; the one after it differs from '' and so resets too.
    reset = F.col("query").isNotNull() & ((F.col("query") == "") | (F.col("query") != F.col("_previous")))
    steps = steps.withColumn("_reset", reset.cast("int")).withColumn("_island", F.sum("_reset").over(upto))
    island = Window.partitionBy(session, "_part", "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("_local", F.sum(F.col("query").isNull().cast("int")).over(island))

    # Presses left over at the end of each stretch, added up since the last stretch with a reset.
    tails = steps.groupBy(session, "_part").agg(
        F.max("_island").alias("_resets"), F.max_by("_local", F.struct(*order)).alias("_tail")
    )
    tails = tails.withColumn("_era", F.sum((F.col("_resets") > 0).cast("int")).over(stretches))
    era = Window.partitionBy(session, "_era").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    tails = tails.withColumn("_after", F.sum("_tail").over(era))
    tails = tails.select(session, "_part", F.coalesce(F.lag("_after").over(stretches), F.lit(0)).alias("_from"))
    presses = F.col("_local") + F.when(F.col("_island") == 0, F.col("_from")).otherwise(0)
    return (
        steps.join(tails, [session, "_part"])
        .withColumn("presses", presses.cast("bigint"))
        .withColumn("page_size", page_of(F.col("presses")))
        .drop("_part", "_carry", "_previous", "_reset", "_island", "_local", "_from")
    )


OUTPUT = "session bigint, ts timestamp, event_id bigint, query string, presses bigint, page_size bigint, late boolean"
STATE = "query string, presses bigint, last_ts timestamp, last_id bigint"
# Events more than this behind the newest one are dropped.
LATENESS = "1 day"
# A session without events for this long is forgotten.
IDLE_MS = 7 * 24 * 3600 * 1000


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    current, presses, last_ts, last_id = state.get if state.exists else ("", 0, None, None)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    out = []
    late = [last_ts is not None and key < (pd.Timestamp(last_ts), last_id) for key in zip(rows["ts"], rows["event_id"], strict=True)]
    for query in rows["query"]:
        if query is None or query is pd.NA or query != query:
            presses += 1
        elif query == "" or query != current:
            current, presses = query, 0
        out.append(presses)
    newest = max((t, i) for t, i in zip(rows["ts"], rows["event_id"], strict=True))
    if last_ts is None or newest > (pd.Timestamp(last_ts), last_id):
        last_ts, last_id = newest[0].to_pydatetime(), int(newest[1])
    state.update((current, presses, last_ts, last_id))
    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(newest[0].timestamp() * 1000)) + IDLE_MS)
    rows = rows.assign(
        session=key[0], late=late, presses=out, page_size=[page_size_of(FIRST_PAGE, p) for p in out]
    )
    yield rows[["session", "ts", "event_id", "query", "presses", "page_size", "late"]]


def page_size_stream(log: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """The same over a stream of (session, ts, event_id, query): state is one query, one count and one event per session.

    Events of a micro-batch are taken in their order. One that comes after a
    later event of its session has been told is applied on arrival and marked
    ``late``; one behind the watermark is dropped, and a session that stays
    silent for a week of event time is forgotten.
    """
    return (
        log.withWatermark("ts", lateness)
        .groupBy("session")
        .applyInPandasWithState(_advance, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )
