"""One registered query per operator, each over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, ShortType

from glossa import fixtures as fx
from glossa.costs import MATCH_DEFINITION, MATCH_HEADWORD, MATCH_SYLLABLE
from glossa.functions import distance, scoring, spans, text
from glossa.operators import ids, joins, lexicon as ops, terms as term_ops
from glossa.plans import build, render
from glossa.plans.search import SearchRun, match_terms_to_syllables, query_terms
from glossa.session import scratch_path
from glossa.sources import files
from glossa.sources.tables import Lexicon
from glossa.streaming.sessions import page_sizes

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

NEEDLES = ("the", "LA", "über", "é", "tion")
RULES = ((("the", "The"), "present", 700), (("und ", " que"), "absent", 40), (("é",), "present", 9))


def wide(df: DataFrame) -> DataFrame:
    """All integers as BIGINT."""
    return df.select(
        *[
            F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, (IntegerType, ShortType, LongType)) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = lambda spark, sf: wide(fn(spark, sf))
    return fn


def show_spans(s):
    return F.array_join(F.transform(s, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")


def words_of(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.explode(text.split_ascii_space(F.col(col))).alias("word"))


def part_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct words of part names and types and of event types."""
    part, events = fx.table(spark, sf, "part"), fx.table(spark, sf, "events")
    return (
        words_of(part, "p_name").union(words_of(part, "p_type")).union(words_of(events, "event_type")).distinct()
    )


def dvocab(spark: SparkSession, sf: str) -> DataFrame:
    return words_of(fx.table(spark, sf, "documents"), "text").distinct()


def lex_entries(spark, sf):
    return fx.entries(fx.lex(spark, sf))


def ldoc_entries(spark, sf):
    return fx.entries(fx.ldoc(spark, sf))


# --- scalar functions ------------------------------------------------------


@query
def defs_parse(spark, sf):
    docs = fx.table(spark, sf, "documents").select(F.lit("d").alias("src"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    pages = fx.table(spark, sf, "pages").select(F.lit("p").alias("src"), F.col("page_id").alias("id"), F.col("html").alias("body"))
    return docs.union(pages).select("src", "id", F.posexplode(text.parse_definitions(F.col("body"))).alias("pos", "definition"))


@query
def defs_dedup(spark, sf):
    return fx.ldoc(spark, sf).select(
        "entry_key", F.posexplode(text.ordered_ci_distinct(F.col("definitions"))).alias("pos", "definition")
    )


@query
def syllable_tokens(spark, sf):
    lex = fx.lex(spark, sf).select(F.lit("l").alias("src"), F.col("entry_key").alias("id"), F.col("reading").alias("s"))
    pages = fx.table(spark, sf, "pages").select(F.lit("p").alias("src"), F.col("page_id").alias("id"), F.col("html").alias("s"))
    return lex.union(pages).select("src", "id", F.posexplode(text.syllables(F.col("s"))).alias("pos", "x")).select(
        "src", "id", "pos", F.col("x.base").alias("base"), F.col("x.tone").alias("tone")
    )


@query
def tone_parse(spark, sf):
    toks = words_of(fx.lex(spark, sf), "reading").union(words_of(fx.table(spark, sf, "pages"), "html"))
    counts = toks.groupBy("word").agg(F.count("*").alias("n"))
    return counts.select("word", text.token_base(F.col("word")).alias("base"), text.token_tone(F.col("word")).alias("tone"), "n")


@query
def query_tokens(spark, sf):
    return fx.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.posexplode(text.split_ascii_space(F.col("text"))).alias("pos", "tok")
    )


@query
def char_explode(spark, sf):
    chars = fx.table(spark, sf, "documents").select("doc_id", F.posexplode(text.characters(F.col("text"))).alias("pos", "ch"))
    return chars.groupBy("ch").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query
def ci_equals(spark, sf):
    """Equality under folding is an equi-join on the folded words."""
    left = words_of(fx.table(spark, sf, "benchmark"), "text").distinct()
    right = words_of(fx.table(spark, sf, "documents"), "text").distinct()
    pairs = joins.salted_join(
        left.withColumn("f", text.fold(F.col("word"))),
        right.select(text.fold(F.col("word")).alias("f"), F.col("word").alias("other")),
        "f",
    )
    return pairs.filter(text.ci_equals(F.col("word"), F.col("other"))).select("word", "other")


@query
def ci_index_of(spark, sf):
    needles = F.array(*[F.lit(n) for n in NEEDLES])
    docs = fx.table(spark, sf, "documents").select("doc_id", "text", F.explode(needles).alias("needle"))
    return docs.select("doc_id", "needle", text.ci_index_of(F.col("needle"), F.col("text")).alias("off"))


@query
def local_levenshtein(spark, sf):
    names = fx.table(spark, sf, "part").select(F.col("p_name").alias("key")).distinct()
    terms = part_terms(spark, sf).withColumnRenamed("word", "needle")
    pairs = joins.local_levenshtein_pairs(terms, names, 1)
    part = fx.table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("key"))
    return joins.salted_join(part, pairs, "key", spread=F.xxhash64("p_partkey")).select("p_partkey", F.col("needle").alias("term"), "distance")


@query
def local_levenshtein_docs(spark, sf):
    lines = fx.ldoc(spark, sf).select(F.explode("definitions").alias("key")).distinct()
    terms = part_terms(spark, sf).withColumnRenamed("word", "needle")
    pairs = joins.local_levenshtein_pairs(terms, lines, 1)
    return pairs.select(F.col("needle").alias("term"), F.col("key").alias("line"), "distance")


def _fuzzy(spark, sf) -> DataFrame:
    """Prefix pairs and one-edit pairs of part terms and document words."""
    terms = part_terms(spark, sf).withColumnRenamed("word", "needle")
    vocab = dvocab(spark, sf).withColumnRenamed("word", "key")
    small, lengths = joins.measure(terms)
    prefix = vocab.withColumn("needle", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.left(F.col("key"), i))))
    near = joins.fuzzy_prefix_pairs(terms, vocab, small, lengths)
    starts = prefix.join(F.broadcast(terms), "needle") if small else joins.salted_join(prefix, terms, "needle")
    return starts.unionByName(near.select("needle", "key")).distinct()


@query
def fuzzy_prefix(spark, sf):
    d = scoring.fuzzy_prefix_distance(F.col("needle"), F.col("key"))
    return _fuzzy(spark, sf).select(F.col("needle").alias("term"), F.col("key").alias("word"), d.alias("distance"))


@query
def prefix_indel(spark, sf):
    """Distances of any size, of part terms and the document words that begin with the same two characters."""
    terms = part_terms(spark, sf).select(F.col("word").alias("needle"), F.left("word", F.lit(2)).alias("start"))
    vocab = dvocab(spark, sf).select(F.col("word").alias("key"), F.left("word", F.lit(2)).alias("start"))
    pairs = joins.salted_join(vocab, terms, "start", spread=F.xxhash64("key"))
    return pairs.select(F.col("needle").alias("term"), F.col("key").alias("word"), distance.prefix_indel(F.col("needle"), F.col("key")).alias("distance"))


@query
def cost_heuristic(spark, sf):
    d = F.col("definitions")
    both = fx.ldoc(spark, sf).select("entry_key", "source", "definitions").union(fx.lex(spark, sf).select("entry_key", "source", "definitions"))
    return both.select(
        "entry_key", "source", scoring.heuristic_cost(d).alias("default_cost"), scoring.heuristic_cost(d, RULES).alias("custom_cost")
    )


@query
def static_cost(spark, sf):
    lex = fx.lex(spark, sf).select("entry_key", "source", "reading", "definitions")
    ldoc = fx.ldoc(spark, sf).select("entry_key", "source", F.lit("").alias("reading"), "definitions")
    cost = ops.romanised_cost(F.col("reading"), F.col("definitions")) + ops.missing_reading_cost(F.col("reading"))
    return lex.union(ldoc).select("entry_key", "source", cost.alias("cost"))


@query
def english_cost(spark, sf):
    qs = F.array(*[F.struct(F.lit(i).cast("bigint").alias("query_id"), F.lit(q).alias("query")) for i, q, _ in fx.QDOC])
    rows = ldoc_entries(spark, sf).select(
        "entry_id", text.search_block(F.col("definitions")).alias("block"), F.explode(qs).alias("q")
    )
    score = scoring.definition_score(query_terms(F.col("q.query")), text.non_ascii_count(F.col("q.query")), F.col("block"))
    return rows.withColumn("s", score).filter("s is not null").select(
        F.col("q.query_id").alias("query_id"), "entry_id", "s.term_match_cost", "s.inversion_cost"
    )


def _needle_positions():
    folded = text.fold(F.col("text"))
    return F.filter(F.array(*[F.instr(folded, F.lit(n.lower())) for n in NEEDLES]), lambda p: p > 0)


@query
def inversion_cost(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", _needle_positions().alias("p"))
    return docs.select("doc_id", F.size("p").alias("n"), (scoring.inversion_count(F.col("p")) * 8000).alias("cost"))


@query
def unmatched_cost(spark, sf):
    docs = fx.ldoc(spark, sf).select("entry_key", F.size("definitions").alias("n"), F.filter(
        F.transform("definitions", lambda d, i: F.when(F.contains(d, F.lit("th")), i)), lambda x: x.isNotNull()
    ).alias("p"))
    return docs.select("entry_key", scoring.unmatched_cost(F.col("p"), F.col("n")).alias("cost"))


@query
def html_escape(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", text.escape_html(F.col("html")).alias("escaped"))


def _first_hits(spark, sf) -> DataFrame:
    """Byte spans of the first hit of every needle."""
    found = F.filter(
        F.array(*[
            F.struct(text.ci_index_of(F.lit(n), F.col("text")).alias("p"), F.lit(len(n.encode())).alias("n"))
            for n in NEEDLES
        ]),
        lambda x: x["p"].isNotNull(),
    )
    return fx.table(spark, sf, "documents").select(
        "doc_id", "text", F.transform(found, lambda x: spans.span(x["p"], x["p"] + x["n"])).alias("spans")
    )


@query
def merge_spans(spark, sf):
    return _first_hits(spark, sf).select("doc_id", show_spans(spans.merge_spans(F.col("spans"))).alias("spans"))


@query
def highlight(spark, sf):
    merged = _first_hits(spark, sf).withColumn("spans", spans.merge_spans(F.col("spans")))
    return merged.select("doc_id", spans.highlight(F.col("text"), F.col("spans")).alias("marked"))


# --- sources and sinks -----------------------------------------------------


def _as_files(lines: DataFrame, name: str) -> DataFrame:
    """Write the lines as text files and read them back through the source."""
    spark = lines.sparkSession
    path = scratch_path(spark, name)
    lines.select("value").write.text(path)
    return files.read_lines(spark, path)


def bilingual_lines(spark, sf) -> DataFrame:
    lex = fx.lex(spark, sf)
    return lex.select(
        F.col("entry_key").alias("line_no"),
        F.concat(
            "headword", F.lit(" "), "headword", F.lit(" [pin1 yin1] /"), F.array_join("definitions", "/"),
            F.when(F.col("source") == "A", "/ cut here # not kept/x").otherwise("/"),
        ).alias("value"),
    )


def romanised_lines(spark, sf) -> DataFrame:
    lex = fx.lex(spark, sf)
    return lex.select(
        F.col("entry_key").alias("line_no"),
        F.concat(
            "headword", F.lit(" x [pin1 yin1] {"), "reading", F.lit("} /"), F.array_join("definitions", " / "), F.lit("/ # note")
        ).alias("value"),
    )


def reading_lines(spark, sf) -> DataFrame:
    return fx.lex(spark, sf).select(
        F.col("entry_key").alias("line_no"), F.concat("headword", F.lit(" x [p1] {"), "reading", F.lit("}")).alias("value")
    )


def single_reading_lines(spark, sf) -> DataFrame:
    """One reading per headword, and none for headwords with a given character."""
    firsts = fx.lex(spark, sf).filter("headword not like '%一%'").groupBy("headword").agg(F.min("reading").alias("reading"))
    return firsts.select(F.concat("headword", F.lit(" x [p1] {"), "reading", F.lit("}")).alias("value"))


def char_freq_lines(spark, sf) -> DataFrame:
    return fx.cfreq(spark, sf).select(
        F.col("idx").cast("bigint").alias("line_no"),
        F.concat_ws("\t", F.col("idx").cast("string"), "ch", F.col("cnt").cast("string"), F.col("cum_pct").cast("string"), F.lit("pin"), F.lit("gloss")).alias("value"),
    )


@query
def src_bilingual(spark, sf):
    return files.parse_bilingual(_as_files(bilingual_lines(spark, sf), "bilingual")).select(
        "headword", F.array_join("definitions", "|").alias("definitions")
    )


@query
def src_romanised(spark, sf):
    return files.parse_romanised(_as_files(romanised_lines(spark, sf), "romanised")).select(
        "headword", "reading", F.array_join("definitions", "|").alias("definitions")
    )


@query
def src_readings(spark, sf):
    return files.parse_readings(_as_files(reading_lines(spark, sf), "readings")).select("headword", "reading")


@query
def src_char_freq(spark, sf):
    return files.parse_char_freq(_as_files(char_freq_lines(spark, sf), "freq")).select(
        "idx", "ch", "count", F.round(F.col("cum_pct").cast("double") * 1000).cast("bigint").alias("cum_milli")
    )


@query
def lexicon_roundtrip(spark, sf):
    path = scratch_path(spark, "lexicon")
    fx.lex_lexicon(spark, sf).save(path)
    return _flat(Lexicon.load(spark, path))


def _flat(lexicon: Lexicon) -> DataFrame:
    return render.display(lexicon).withColumn("english_definitions", F.array_join("english_definitions", "|"))


@query
def entries_display(spark, sf):
    return _flat(fx.lex_lexicon(spark, sf))


@query
def entries_json(spark, sf):
    """Readable entries written as JSON lines and read back."""
    lexicon, path = fx.lex_lexicon(spark, sf), scratch_path(spark, "entries")
    render.write_json(lexicon, path)
    back = spark.read.schema(render.display(lexicon).schema).json(path)
    return back.withColumn("english_definitions", F.array_join("english_definitions", "|"))


@query
def build_report(spark, sf):
    entries = lex_entries(spark, sf)
    named = entries.withColumn("source", F.when(F.col("source") == "A", "CEDict").otherwise("CCanto"))
    return build.build_report(Lexicon.from_entries(named))


@query
def build_lexicon(spark, sf):
    """All four sources from files, to the finished lexicon."""
    built = build.build_from_lines(
        _as_files(bilingual_lines(spark, sf), "bilingual"),
        _as_files(romanised_lines(spark, sf), "romanised"),
        _as_files(single_reading_lines(spark, sf), "readings"),
        _as_files(char_freq_lines(spark, sf), "freq"),
    )
    return _flat(built.lexicon).select("characters", "jyutping", "english_definitions", "cost", "entry_source")


# --- build steps -----------------------------------------------------------


def _cfreq_rows(spark, sf) -> DataFrame:
    return fx.cfreq(spark, sf).select(
        F.col("idx").cast("bigint").alias("line_no"), F.col("idx").cast("int").alias("idx"), "ch",
        F.col("cnt").cast("int").alias("count"), F.col("cum_pct").cast("float").alias("cum_pct"),
    )


@query
def freq_from_cumulative(spark, sf):
    rows = ops.char_frequencies(_cfreq_rows(spark, sf))
    return rows.select("ch", "idx", F.round(F.col("frequency").cast("double") * 1e6).cast("bigint").alias("freq_micro"))


@query
def freq_cost(spark, sf):
    return ops.char_frequencies(_cfreq_rows(spark, sf)).select("ch", "cost")


@query
def freq_last_wins(spark, sf):
    docs = fx.table(spark, sf, "documents")
    chars = F.array_distinct(text.characters(F.col("text")))
    rows = docs.select(F.col("doc_id").alias("line_no"), F.explode(chars).alias("ch"), F.col("n_chars").alias("count"), F.col("doc_id").alias("idx"))
    return ops.last_wins(rows)


@query
def freq_backfill(spark, sf):
    freq = ops.char_frequencies(_cfreq_rows(spark, sf))
    chars = fx.lex(spark, sf).select(F.explode(text.characters(F.col("headword"))).alias("ch"))
    return ops.backfill_frequencies(freq, chars).select("ch", "idx", "count", "cost")


@query
def char_static_cost(spark, sf):
    heads = words_of(fx.table(spark, sf, "conversations"), "text").withColumnRenamed("word", "headword").union(
        fx.lex(spark, sf).select("headword")
    )
    return ops.headword_char_costs(heads, ops.char_frequencies(_cfreq_rows(spark, sf)))


@query
def annotate_readings(spark, sf):
    lex = fx.lex(spark, sf)
    entries = lex.filter("source = 'A'").select("entry_key", "headword", F.lit("").alias("reading"))
    readings = lex.filter("source = 'B'").select("headword", "reading", F.col("entry_key").alias("line_no"))
    return ops.annotate(entries, readings).select("entry_key", "headword", "reading")


def _readings(spark, sf) -> DataFrame:
    """Readings in two spellings, so that folding has something to drop."""
    lex = fx.lex(spark, sf)
    odd = F.when(F.col("entry_key") % 3 == 0, F.upper("reading")).otherwise(F.col("reading"))
    return lex.select("headword", odd.alias("reading"), F.col("entry_key").alias("line_no"))


@query
def readings_grouped(spark, sf):
    return ops.grouped_ci(_readings(spark, sf), "headword", "reading", "readings").select(
        "headword", F.array_join("readings", "|").alias("readings")
    )


@query
def readings_reverse(spark, sf):
    return ops.grouped_ci(_readings(spark, sf), "reading", "headword", "headwords").select(
        "reading", F.array_join("headwords", "|").alias("headwords")
    )


@query
def vocab_chars(spark, sf):
    return fx.lex_lexicon(spark, sf).characters


@query
def vocab_syllables(spark, sf):
    return fx.lex_lexicon(spark, sf).syllables


@query
def encode_vocab(spark, sf):
    lexicon = fx.lex_lexicon(spark, sf)
    return ops.encode(
        lexicon.entries,
        ops.vocabulary_ids(lexicon.characters, "ch", "char_id"),
        ops.vocabulary_ids(lexicon.syllables, "base", "base_id"),
    )


def _both(spark, sf) -> DataFrame:
    cols = ["src", "entry_key", "static_cost", "source", "n_defs"]
    lex = fx.lex(spark, sf).withColumn("src", F.lit(0)).withColumn("n_defs", F.size("definitions"))
    ldoc = fx.ldoc(spark, sf).withColumn("src", F.lit(1)).withColumn("n_defs", F.size("definitions"))
    return lex.select(cols).unionByName(ldoc.select(cols))


@query
def lexicon_union(spark, sf):
    return _both(spark, sf)


@query
def entry_ids(spark, sf):
    return ids.dense_ids(_both(spark, sf), ["static_cost", "src", "entry_key"], "entry_id").select("src", "entry_key", "entry_id")


@query
def running_offsets(spark, sf):
    return ops.definition_offsets(fx.ldoc(spark, sf), ["static_cost", "entry_key"])


# --- search ----------------------------------------------------------------

MATCH_COLUMNS = (
    "query_id", "entry_id", "match_type", "term_match_cost", "unmatched_position_cost", "inversion_cost", "static_cost", "total_cost",
)


def lex_run(spark, sf, **options) -> SearchRun:
    return SearchRun(fx.qset(spark, sf), fx.lex_lexicon(spark, sf), **options)


def ldoc_run(spark, sf, **options) -> SearchRun:
    return SearchRun(fx.literal_queries(spark, fx.QDOC), fx.ldoc_lexicon(spark, sf), **options)


@query
def search_syllable(spark, sf):
    return lex_run(spark, sf, kinds=(MATCH_SYLLABLE,)).matches().select(*MATCH_COLUMNS)


@query
def search_english(spark, sf):
    return lex_run(spark, sf, kinds=(MATCH_DEFINITION,)).matches().select(*MATCH_COLUMNS)


@query
def search_english_docs(spark, sf):
    return ldoc_run(spark, sf, kinds=(MATCH_DEFINITION,)).matches().select(*MATCH_COLUMNS)


@query
def search_headword(spark, sf):
    return lex_run(spark, sf, kinds=(MATCH_HEADWORD,)).matches().select(*MATCH_COLUMNS)


@query
def search_all(spark, sf):
    return lex_run(spark, sf).matches().select(*MATCH_COLUMNS)


@query
def search_topk(spark, sf):
    return lex_run(spark, sf).ranked().select(*MATCH_COLUMNS, "rank")


@query
def search_docs_words(spark, sf):
    """Every distinct word of the benchmark texts as a query against the documents."""
    words = words_of(fx.table(spark, sf, "benchmark"), "text").distinct()
    numbered = ids.dense_ids(words, ["word"], "query_id")
    queries = numbered.select("query_id", F.col("word").alias("query"), F.lit(12).alias("k"))
    return SearchRun(queries, fx.ldoc_lexicon(spark, sf)).ranked().select(*MATCH_COLUMNS, "rank")


@query
def search_pages(spark, sf):
    """The first three pages of every query: the size doubles with each. The last one is searched, and begins with the others."""
    queries = fx.qset(spark, sf).select("query_id", "query", render.page_size(12, F.lit(2)).alias("k"))
    best = SearchRun(queries, fx.lex_lexicon(spark, sf)).ranked()
    pages = F.array(*[F.struct(F.lit(i).alias("page"), render.page_size(12, F.lit(i)).alias("k")) for i in range(3)])
    told = best.drop("k").withColumn("p", F.explode(pages)).filter(F.col("rank") <= F.col("p.k"))
    ranked = told.withColumn("query_id", F.col("query_id") * 10 + F.col("p.page")).withColumn("k", F.col("p.k"))
    return render.with_has_more(ranked).select("query_id", "k", "entry_id", "match_type", "total_cost", "rank", F.col("has_more").cast("int").alias("has_more"))


@query
def candidate_counts(spark, sf):
    return lex_run(spark, sf).candidate_counts()


@query
def term_syllable_match(spark, sf):
    """Query terms against all document words as the vocabulary."""
    terms = (
        fx.qset(spark, sf).select(F.explode(query_terms(F.col("query"))).alias("t")).select(F.col("t.base").alias("term_base")).distinct()
    )
    small, lengths = joins.measure(terms)
    vocab = dvocab(spark, sf).withColumnRenamed("word", "base")
    return match_terms_to_syllables(terms, vocab, small, lengths).select("term_base", "base", "match_cost")


@query
def best_term_position(spark, sf):
    lexicon = fx.lex_lexicon(spark, sf)
    terms = fx.qset(spark, sf).select("query_id", F.posexplode(query_terms(F.col("query"))).alias("term_idx", "t")).select(
        "query_id", "term_idx", F.col("t.base").alias("term_base"), F.col("t.tone").alias("tone")
    )
    distinct = terms.select("term_base").distinct()
    small, lengths = joins.measure(distinct)
    matches = match_terms_to_syllables(distinct, lexicon.syllables.select("base"), small, lengths)
    return term_ops.best_term_positions(terms, matches, lexicon.entries)


# --- spans and rendering ---------------------------------------------------


@query
def spans_english(spark, sf):
    qs = F.array(*[F.struct(F.lit(i).cast("bigint").alias("query_id"), query_terms(F.lit(q)).alias("terms")) for i, q, _ in fx.QDOC])
    rows = fx.ldoc(spark, sf).select("entry_key", F.posexplode("definitions").alias("def_idx", "d")).withColumn("folded", text.fold(F.col("d")))
    # A line has spans of the queries that it holds a term of; only these are paired with it.
    holds = lambda q: F.exists(q["terms"], lambda t: F.instr(F.col("folded"), t["tok_fold"]) > 0)
    pairs = rows.select("entry_key", "def_idx", "d", F.explode(F.filter(qs, holds)).alias("q"))
    merged = spans.merge_spans(spans.definition_spans(F.col("d"), F.col("q.terms")))
    return pairs.select(F.col("q.query_id").alias("query_id"), "entry_key", "def_idx", show_spans(merged).alias("spans"))


@query
def spans_headword(spark, sf):
    run = lex_run(spark, sf, kinds=(MATCH_HEADWORD,))
    return render.hits(run, run.matches()).select("query_id", "entry_id", show_spans(F.col("spans")).alias("spans"))


def _single_terms(spark, sf) -> DataFrame:
    words = words_of(fx.table(spark, sf, "part"), "p_name").distinct()
    toned = words.select(F.explode(F.array("word", F.concat("word", F.lit("3")), F.left("word", F.lit(2)), F.concat(F.left("word", F.lit(2)), F.lit("4")))).alias("query")).distinct()
    return ids.dense_ids(toned, ["query"], "query_id").select("query_id", "query", F.lit(1).alias("k"))


@query
def spans_syllable(spark, sf):
    run = SearchRun(_single_terms(spark, sf), fx.lex_lexicon(spark, sf), kinds=(MATCH_SYLLABLE,))
    return render.hits(run, run.matches()).select("query_id", "entry_id", "total_cost", show_spans(F.col("spans")).alias("spans"))


@query
def syllable_assignment(spark, sf):
    """Two-term queries: which syllable each term takes."""
    names = fx.table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("query_id"))
    queries = names.select("query_id", F.col("p_name").alias("query"), F.lit(1).alias("k"))
    run = SearchRun(queries, fx.lex_lexicon(spark, sf), kinds=(MATCH_SYLLABLE,))
    return render.hits(run, run.matches()).select("query_id", "entry_id", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query
def search_render(spark, sf):
    return render.render(lex_run(spark, sf)).select(
        "query_id", "rank", "entry_id", "match_type", "total_cost",
        F.col("rendered.characters").alias("characters"), F.col("rendered.jyutping").alias("jyutping"),
        F.array_join("rendered.english_definitions", "|").alias("english_definitions"),
        F.col("rendered.cost").alias("cost"), F.col("rendered.entry_source").alias("entry_source"),
    )


@query
def search_render_docs(spark, sf):
    return render.render(ldoc_run(spark, sf)).select(
        "query_id", "rank", "entry_id", "total_cost", F.array_join("rendered.english_definitions", "|").alias("english_definitions")
    )


@query
def search_json(spark, sf):
    return render.results_json(lex_run(spark, sf))


# --- sessions --------------------------------------------------------------


@query
def session_page_size(spark, sf):
    events = fx.table(spark, sf, "events")
    log = events.select(
        F.col("user_id").alias("session"), "ts", "event_id",
        F.when(~F.col("event_type").isin("view", "click"), F.col("event_type")).alias("query"),
    )
    return page_sizes(log, "session", ["ts", "event_id"]).select("session", "event_id", "presses", "page_size")
