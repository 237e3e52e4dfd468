"""From ranked matches to highlight spans, rendered entries and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.costs import MATCH_DEFINITION, MATCH_HEADWORD, MATCH_SYLLABLE
from glossa.functions.paging import page_size
from glossa.functions.spans import (
    assign_syllables,
    char_spans_to_bytes,
    definition_spans,
    headword_spans,
    highlight,
    merge_spans,
    no_spans,
    syllable_spans,
)
from glossa.functions.text import display_reading, totals_before
from glossa.plans.search import COSTS, SearchRun
from glossa.sources.tables import Lexicon

__all__ = ["display", "hits", "page_size", "render", "results_json", "with_has_more", "write_json"]


def display(lexicon: Lexicon) -> DataFrame:
    """Readable entries."""
    return lexicon.entries.select(
        "entry_id",
        F.col("headword").alias("characters"),
        display_reading(F.col("syllables")).alias("jyutping"),
        F.col("definitions").alias("english_definitions"),
        F.col("static_cost").alias("cost"),
        F.col("source").alias("entry_source"),
    )


def write_json(lexicon: Lexicon, path: str, mode: str = "errorifexists") -> None:
    """The readable entries as JSON lines, one part file per partition."""
    display(lexicon).write.mode(mode).json(path)


def hits(run: SearchRun, rows: DataFrame | None = None) -> DataFrame:
    """Matches with their entries and merged spans; the ranked ones, or ``rows`` of ``run.matches()``.

    ``spans`` are byte spans of the reading, character spans of the headword;
    ``def_spans`` byte spans within each definition.
    """
    ranked = run.ranked() if rows is None else rows
    wanted = ranked.join(run.queries.select("query_id", "query", "terms", "chars"), "query_id")
    # At most k_max rows of each query, each with the query's own columns.
    if rows is None and run.query_bytes * run.k_max <= run.broadcast_bytes:
        wanted = F.broadcast(wanted)
    entries = run.lexicon.entries.drop("static_cost")
    rows = entries.join(wanted, "entry_id")
    kind = F.col("match_type")
    path = assign_syllables(F.col("terms"), F.col("syllables"), run.costs)
    spans = (
        F.when(kind == MATCH_SYLLABLE, merge_spans(syllable_spans(F.col("terms"), F.col("syllables"), F.col("path"))))
        .when(kind == MATCH_HEADWORD, merge_spans(headword_spans(F.col("headword"), F.col("chars"))))
        .otherwise(no_spans())
    )
    def_spans = F.transform(
        "definitions",
        lambda d: F.when(kind == MATCH_DEFINITION, merge_spans(definition_spans(d, F.col("terms")))).otherwise(no_spans()),
    )
    return (
        rows.withColumn("path", F.when(kind == MATCH_SYLLABLE, path))
        .withColumn("spans", spans)
        .withColumn("def_spans", def_spans)
    )


def render(run: SearchRun) -> DataFrame:
    """One row per hit with the highlighted strings in ``rendered``.

    Definitions are always escaped, headword and reading only where they were matched.
    """
    kind = F.col("match_type")
    reading = display_reading(F.col("syllables"))
    headword_bytes = char_spans_to_bytes(F.col("headword"), F.col("spans"))
    return hits(run).withColumn(
        "rendered",
        F.struct(
            F.when(kind == MATCH_HEADWORD, highlight(F.col("headword"), headword_bytes))
            .otherwise(F.col("headword"))
            .alias("characters"),
            F.when(kind == MATCH_SYLLABLE, highlight(reading, F.col("spans"))).otherwise(reading).alias("jyutping"),
            F.zip_with("definitions", "def_spans", highlight).alias("english_definitions"),
            F.col("static_cost").alias("cost"),
            F.col("source").alias("entry_source"),
        ),
    )


def results_json(run: SearchRun) -> DataFrame:
    """(query_id, json): the rendered hits of each query, best first; at most k per query."""
    starts = totals_before(F.transform("definitions", lambda d: F.octet_length(d)))
    in_block = F.flatten(
        F.zip_with(
            "def_spans", starts, lambda s, at: F.transform(s, lambda x: F.array(x["start"] + at, x["end"] + at))
        )
    )
    matched = F.when(F.col("match_type") == MATCH_DEFINITION, in_block).otherwise(
        F.transform("spans", lambda x: F.array(x["start"], x["end"]))
    )
    item = F.struct(
        F.struct(
            F.struct(
                F.struct(*COSTS, "static_cost").alias("cost_info"), "match_type", "entry_id"
            ).alias("match_obj"),
            matched.alias("matched_spans"),
        ).alias("match_obj"),
        F.col("rendered").alias("rendered_entry"),
        "query",
    )
    per_query = render(run).groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", item.alias("item")))).alias("items")
    )
    return run.queries.select("query_id").join(per_query, "query_id", "left").select(
        "query_id",
        F.to_json(
            F.struct(F.coalesce(F.transform("items", lambda x: x["item"]), F.array()).alias("results"))
        ).alias("json"),
    )


def with_has_more(ranked: DataFrame) -> DataFrame:
    """Adds ``has_more``: the query filled its page. Ranked rows already lie together, k per query; query_id is unique."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    return ranked.withColumn("has_more", n == F.col("k"))
