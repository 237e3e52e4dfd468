"""Readers for the four text sources. Lines that do not parse go to a rejects table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions.text import ordered_ci_distinct, parse_definitions

# The line formats.
BILINGUAL = r"(?s)\A([^ ]*) ([^ ]*) \[([^\]]*)\].(.*)\z"
ROMANISED = r"(?s)\A([^ ]*) ([^ ]*) \[([^\]]*)\].\{([^}]*)\}.(.*)\z"
READINGS = r"(?s)\A([^ ]*) ([^ ]*) \[([^\]]*)\].\{(.*).\z"
CHAR_FREQ = r"(?s)\A([+-]?[0-9]+)\t([^\t])[^\t]*\t([+-]?[0-9]+)\t([+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?)\t(.*)\z"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value, file) of every line that is neither empty nor a comment.

    Files are split between tasks. ``line_no`` only has to sort in file order:
    file, start of the split, row within it.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("line_no"),
        F.regexp_replace("value", r"\r\z", "").alias("value"),
        F.col("_metadata.file_path").alias("file"),
    )
    return data_lines(lines)


def data_lines(lines: DataFrame) -> DataFrame:
    return lines.filter((F.col("value") != "") & ~F.startswith("value", F.lit("#")))


def _matching(lines: DataFrame, pattern: str) -> DataFrame:
    return lines.filter(F.col("value").rlike(pattern))


def _group(pattern: str, n: int):
    return F.regexp_extract("value", pattern, n)


def _numbers_fit(lines: DataFrame) -> DataFrame:
    """Adds ``ok``: the form is right and both integers fit in 32 bits."""
    return lines.withColumn(
        "ok",
        F.col("value").rlike(CHAR_FREQ)
        & _group(CHAR_FREQ, 1).try_cast("int").isNotNull()
        & _group(CHAR_FREQ, 3).try_cast("int").isNotNull()
        & _group(CHAR_FREQ, 4).try_cast("float").isNotNull(),
    )


def rejects(lines: DataFrame, pattern: str, reason: str) -> DataFrame:
    """Lines that do not have the expected form."""
    lines = data_lines(lines)
    if pattern == CHAR_FREQ:
        lines = _numbers_fit(lines).filter(~F.col("ok"))
    else:
        lines = lines.filter(~F.col("value").rlike(pattern))
    keep = [c for c in ("line_no", "file") if c in lines.columns]
    return lines.select(
        *keep, F.col("value").alias("line"), F.lit(reason).alias("reason")
    )


def parse_bilingual(lines: DataFrame) -> DataFrame:
    return _matching(data_lines(lines), BILINGUAL).select(
        "line_no",
        _group(BILINGUAL, 1).alias("headword"),
        ordered_ci_distinct(parse_definitions(_group(BILINGUAL, 4))).alias("definitions"),
    )


def parse_romanised(lines: DataFrame) -> DataFrame:
    return _matching(data_lines(lines), ROMANISED).select(
        "line_no",
        _group(ROMANISED, 1).alias("headword"),
        _group(ROMANISED, 4).alias("reading"),
        ordered_ci_distinct(parse_definitions(_group(ROMANISED, 5))).alias("definitions"),
    )


def parse_readings(lines: DataFrame) -> DataFrame:
    return _matching(data_lines(lines), READINGS).select(
        "line_no", _group(READINGS, 1).alias("headword"), _group(READINGS, 4).alias("reading")
    )


def parse_char_freq(lines: DataFrame) -> DataFrame:
    return _numbers_fit(data_lines(lines)).filter("ok").select(
        "line_no",
        _group(CHAR_FREQ, 1).cast("int").alias("idx"),
        _group(CHAR_FREQ, 2).alias("ch"),
        _group(CHAR_FREQ, 3).cast("int").alias("count"),
        _group(CHAR_FREQ, 4).cast("float").alias("cum_pct"),
    )
