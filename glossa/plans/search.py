"""Ranked search of a table of queries against a lexicon.

Plan: match the distinct query terms with the lexicon's vocabularies and pick
for each query its rarest term as anchor. A saved lexicon is then searched
through its posting tables (``glossa.plans.indexed``), which alone tell what
matches and at what cost.

A lexicon that was not saved is scanned: its entries meet the queries through
equi-joins on the anchor's keys, and each (query, entry) pair is scored within
its row. Anchors and queries are broadcast when their measured size allows, so
that the lexicon is scanned without a shuffle and only the best k rows per
query and task move; beyond that size the same keys are joined by a salted
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.costs import DEFAULT_COSTS, MATCH_DEFINITION, MATCH_HEADWORD, MATCH_SYLLABLE, CostModel
from glossa.functions.scoring import COSTS, definition_score, syllable_score, term_syllable_cost
from glossa.functions.text import (
    block_words,
    characters,
    fold,
    non_ascii_count,
    search_block,
    split_ascii_space,
    token_base,
    token_tone,
)
from glossa.operators.ids import top_k
from glossa.operators.joins import containment_pairs, fuzzy_prefix_pairs, gram_sizes_for, hot_from_counts, salted_join
from glossa.operators.lexicon import headword_keys, syllable_keys
from glossa.plans import indexed
from glossa.session import cut, drop
from glossa.sources.tables import Lexicon

KINDS = (MATCH_SYLLABLE, MATCH_DEFINITION, MATCH_HEADWORD)
# Rank of the kinds among equal costs of one entry.
KIND_RANK = {MATCH_SYLLABLE: 0, MATCH_DEFINITION: 1, MATCH_HEADWORD: 2}
# Definitions are searched only for queries of more than this many bytes.
MIN_DEFINITION_QUERY_BYTES = 2
BROADCAST_BYTES = 64 << 20


def query_terms(query: Column) -> Column:
    """ARRAY of (tok, tok_fold, base, base_fold, tone), split on ASCII whitespace."""
    return F.transform(
        split_ascii_space(query),
        lambda t: F.struct(
            t.alias("tok"),
            fold(t).alias("tok_fold"),
            token_base(t).alias("base"),
            fold(token_base(t)).alias("base_fold"),
            token_tone(t).alias("tone"),
        ),
    )


def match_terms_to_syllables(
    terms: DataFrame,
    vocabulary: DataFrame,
    small: bool,
    lengths: list[int],
    costs: CostModel = DEFAULT_COSTS,
) -> DataFrame:
    """(term_base, base, match_cost, ...) for distinct ``terms(term_base)`` and ``vocabulary(base, ...)``.

    Candidates share a folded gram or a deletion key; the cost expression then
    decides, and its order gives the first matching tier the say. ``lengths``
    are the term lengths that occur.
    """
    folded_terms = terms.select("term_base", fold(F.col("term_base")).alias("needle"))
    folded_vocab = vocabulary.withColumn("key", fold(F.col("base")))
    contained = containment_pairs(folded_terms, folded_vocab, small, gram_sizes_for(lengths))
    near = fuzzy_prefix_pairs(
        terms.withColumn("needle", F.col("term_base")), vocabulary.withColumn("key", F.col("base")), small, lengths
    )
    cost = term_syllable_cost(F.col("term_base"), fold(F.col("term_base")), F.col("base"), costs)
    return (
        contained.unionByName(near)
        .drop("needle", "key")
        .dropDuplicates(["term_base", "base"])
        .withColumn("match_cost", cost)
        .filter(F.col("match_cost").isNotNull())
    )


class SearchRun:
    """One table of queries against one lexicon; the small tables are computed once.

    An entry may match by its definitions and by its headword; ``dedup`` keeps
    the headword's match only. Characters that no headword has are ignored;
    with ``strict`` a query that has one, blanks aside, matches no headword.
    Close the run, or use it in a ``with`` block, to remove its tables.
    """

    def __init__(
        self,
        queries: DataFrame,
        lexicon: Lexicon,
        k: int | None = None,
        kinds: tuple[str, ...] = KINDS,
        costs: CostModel = DEFAULT_COSTS,
        broadcast_bytes: int = BROADCAST_BYTES,
        dedup: bool = False,
        strict: bool = False,
    ):
        self.lexicon, self.kinds, self.costs = lexicon, kinds, costs
        self.broadcast_bytes = broadcast_bytes
        self.dedup, self.strict = dedup, strict
        self.made: list[str] = []
        self.parsed = self._cut(
            queries.select(
                "query_id",
                "query",
                (F.lit(k) if k is not None else F.col("k")).cast("bigint").alias("k"),
                query_terms(F.col("query")).alias("terms"),
                non_ascii_count(F.col("query")).alias("non_ascii"),
            )
        )
        sizes = self.parsed.agg(
            F.count("*").alias("n"),
            F.coalesce(F.max("k"), F.lit(0)).alias("k_max"),
            # Terms, folded terms and characters: a few copies of the query text, and what each token's fields take.
            F.coalesce(F.sum(F.octet_length("query") * 8 + F.size("terms") * 160 + F.length("query") * 24 + 256), F.lit(0)).alias("bytes"),
        ).first()
        self.n_queries, self.k_max, self.query_bytes = sizes["n"], sizes["k_max"], sizes["bytes"]
        small = sizes["bytes"] <= broadcast_bytes
        # Lengths are folded to distinct ones before they meet: as many rows as there are lengths.
        lengths = self.parsed.select(F.explode(F.transform("terms", lambda t: F.length(t["base"]))).alias("n")).union(
            self.parsed.select(F.explode(F.transform("terms", lambda t: -F.least(F.length(t["tok"]), F.lit(3)))).alias("n"))
        )
        found = [r["n"] for r in lengths.distinct().collect()]
        postings = self._postings(small, [n for n in found if n >= 0], [-n for n in found if n < 0])
        self.queries = self._cut(self.parsed.join(self._choices(postings), "query_id", "left"))
        self.by_syllable = syllable_score(F.col("terms"), F.col("syllables"), costs)
        self.index = None
        if lexicon.postings is not None:
            self.index = indexed.Asked(self, postings)
            return
        used = self.queries.select(F.explode("anchors").alias("kind", "anchor")).distinct()
        self.keys = postings.withColumnRenamed("term", "anchor").join(used, ["kind", "anchor"], "left_semi")
        kept = {
            r["kind"]: r["b"]
            for r in self.keys.groupBy("kind")
            .agg(F.sum(F.octet_length("key") + F.octet_length("anchor") + 32).alias("b"))
            .collect()
        }
        self.present = set(kept)
        self.fits = small and sum(kept.values()) <= broadcast_bytes

    def _cut(self, df: DataFrame) -> DataFrame:
        return cut(df, self.made)

    def close(self) -> None:
        drop(self.parsed.sparkSession, self.made)

    def __enter__(self) -> "SearchRun":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # --- anchors -----------------------------------------------------------

    def _query_terms(self) -> DataFrame:
        """(query_id, kind, term): everything a query can be anchored by."""

        def tagged(kind: str, terms: Column) -> Column:
            return F.transform(terms, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term")))

        parts = []
        if MATCH_SYLLABLE in self.kinds:
            parts.append(tagged(MATCH_SYLLABLE, F.transform("terms", lambda t: t["base"])))
        if MATCH_DEFINITION in self.kinds:
            long_enough = F.octet_length("query") > MIN_DEFINITION_QUERY_BYTES
            folded = F.when(long_enough, F.transform("terms", lambda t: t["tok_fold"]))
            parts.append(tagged(MATCH_DEFINITION, F.coalesce(folded, F.array().cast("array<string>"))))
        if MATCH_HEADWORD in self.kinds:
            parts.append(tagged(MATCH_HEADWORD, F.array_distinct(characters(F.col("query")))))
        return self.parsed.select("query_id", F.explode(F.concat(*parts)).alias("t")).select(
            "query_id", "t.kind", "t.term"
        )

    def _postings(self, small: bool, base_lengths: list[int], tok_lengths: list[int]) -> DataFrame:
        """(kind, term, key, n_entries): the vocabulary keys that each distinct query term matches."""
        terms = self._query_terms().select("kind", "term").distinct()
        lex, out = self.lexicon, None
        for kind in self.kinds:
            mine = terms.filter(F.col("kind") == kind).select("term")
            if kind == MATCH_SYLLABLE:
                pairs = match_terms_to_syllables(
                    mine.withColumnRenamed("term", "term_base"), lex.syllables, small, base_lengths, self.costs
                ).select(F.col("term_base").alias("term"), F.col("base").alias("key"), "n_entries")
            elif kind == MATCH_DEFINITION:
                pairs = containment_pairs(
                    mine.withColumnRenamed("term", "needle"),
                    lex.words.withColumnRenamed("word", "key"),
                    small,
                    gram_sizes_for(tok_lengths),
                ).select(F.col("needle").alias("term"), "key", "n_entries")
            else:
                chars = lex.characters.withColumnRenamed("ch", "term")
                # No more distinct characters than code points, 1,114,112, hence the broadcast.
                pairs = chars.join(F.broadcast(mine), "term").select("term", F.col("term").alias("key"), "n_entries")
            pairs = pairs.select(F.lit(kind).alias("kind"), "term", "key", "n_entries")
            out = pairs if out is None else out.unionByName(pairs)
        return self._cut(out)

    def _choices(self, postings: DataFrame) -> DataFrame:
        """(query_id, anchors, chars): per kind the term with the fewest postings.

        Syllable and definition search need every term to match something;
        headword search goes on with the known characters. The right side has
        one row per term, so a hot term is split by adaptive skew handling.
        """
        sizes = postings.groupBy("kind", "term").agg(F.sum("n_entries").alias("n"))
        headword = F.col("kind") == MATCH_HEADWORD
        needed = (F.col("missing") == 0) | (headword if not self.strict else F.lit(False))
        terms = self._query_terms()
        if self.strict:
            terms = terms.filter(~headword | (F.trim("term") != ""))
        per_kind = (
            terms
            .join(sizes, ["kind", "term"], "left")
            .groupBy("query_id", "kind")
            .agg(
                F.count_if(F.col("n").isNull()).alias("missing"),
                F.min(F.when(F.col("n").isNotNull(), F.struct("n", "term"))).alias("best"),
                F.collect_set(
                    F.when((F.col("kind") == MATCH_HEADWORD) & F.col("n").isNotNull(), F.col("term"))
                ).alias("chars"),
            )
            .filter(F.col("best").isNotNull() & needed)
        )
        return per_kind.groupBy("query_id").agg(
            F.map_from_entries(F.collect_list(F.struct("kind", "best.term"))).alias("anchors"),
            F.sum("best.n").alias("anchor_entries"),
            F.max("chars").alias("chars"),
        )

    # --- candidates --------------------------------------------------------

    def _keyed(self, kind: str) -> tuple[DataFrame, Column]:
        """The entry columns that scoring needs, and the entry's keys."""
        cols = ["entry_id", F.col("static_cost").cast("bigint").alias("static_cost"), "syllables"]
        if kind == MATCH_SYLLABLE:
            return self.lexicon.entries.select(*cols), syllable_keys(F.col("syllables"))
        if kind == MATCH_HEADWORD:
            return self.lexicon.entries.select(*cols, "headword"), headword_keys(F.col("headword"))
        block = search_block(F.col("definitions")).alias("block")
        if self.dedup:
            cols.append("headword")
        return self.lexicon.entries.select(*cols, block), block_words(F.col("block"))

    def _candidates(self, kind: str) -> DataFrame:
        """Entries joined with the queries whose anchor they contain, each pair once."""
        entries, keys = self._keyed(kind)
        mine = self.queries.withColumn("anchor", F.col("anchors")[kind]).filter(F.col("anchor").isNotNull())
        mine = mine.select("query_id", "k", "terms", "non_ascii", "chars", "anchor")
        if self.fits:
            exploded = entries.select(*entries.columns, F.explode(keys).alias("key"))
            if kind == MATCH_HEADWORD:
                return exploded.withColumnRenamed("key", "anchor").join(F.broadcast(mine), "anchor")
            table = self.keys.filter(F.col("kind") == kind).select("key", "anchor")
            hits = exploded.join(F.broadcast(table), "key").filter(self._first_hit(kind))
            return hits.drop("key").join(F.broadcast(mine), "anchor")
        # Ids only until the pairs are known; the texts join last, once per pair.
        # The stored vocabularies tell which keys are hot.
        ids = entries.select("entry_id", F.explode(keys).alias("key"))
        by_entry = F.xxhash64("entry_id")
        if kind == MATCH_HEADWORD:
            hot = hot_from_counts(self.lexicon.characters.select(F.col("ch").alias("anchor"), "n_entries"))
            wanted = salted_join(ids.withColumnRenamed("key", "anchor"), mine, "anchor", spread=by_entry, hot=hot)
        else:
            vocabulary = self.lexicon.syllables if kind == MATCH_SYLLABLE else self.lexicon.words
            table = self.keys.filter(F.col("kind") == kind).select("key", "anchor")
            hot = hot_from_counts(vocabulary.toDF("key", "n_entries"))
            pairs = salted_join(ids, table, "key", spread=by_entry, hot=hot)
            pairs = self._cut(pairs.select("entry_id", "anchor").distinct())
            wanted = salted_join(pairs, mine, "anchor", spread=by_entry)
        return wanted.join(entries, "entry_id")

    def _first_hit(self, kind: str) -> Column:
        """Of the keys of one entry that match an anchor, only the first passes.

        For definitions that is the word around the anchor's first place in the
        block. The block is searched once, in generated code, and the check
        reads nothing but the text around that place.
        """
        key, anchor = F.col("key"), F.col("anchor")
        if kind == MATCH_DEFINITION:
            word_start = F.greatest(F.instr("block", anchor) - F.instr(key, anchor), F.lit(1))
            around = F.substring("block", word_start, F.length(key) + 2)
            return around == F.concat(F.lit(" "), key, F.lit(" "))
        bases = F.filter(
            F.transform("syllables", lambda s: s["base"]),
            lambda b: term_syllable_cost(anchor, fold(anchor), b, self.costs).isNotNull(),
        )
        return F.get(bases, F.lit(0)) == key

    # --- matches -----------------------------------------------------------

    def _matches(self, kind: str) -> DataFrame:
        pairs = self._candidates(kind)
        zero = F.lit(0).cast("bigint")
        if kind == MATCH_SYLLABLE:
            score = self.by_syllable
        elif kind == MATCH_DEFINITION:
            score = definition_score(F.col("terms"), F.col("non_ascii"), F.col("block"), self.costs)
        else:
            in_headword = F.forall("chars", lambda c: F.contains(F.col("headword"), c))
            score = F.when(in_headword, F.struct(*[zero.alias(c) for c in COSTS]))
        if kind != MATCH_SYLLABLE and MATCH_SYLLABLE in self.kinds:
            score = F.when(self.by_syllable.isNull(), score)
        if kind == MATCH_DEFINITION and self.dedup and MATCH_HEADWORD in self.kinds:
            by_headword = F.size("chars") > 0
            by_headword = by_headword & F.forall("chars", lambda c: F.contains(F.col("headword"), c))
            score = F.when(~F.coalesce(by_headword, F.lit(False)), score)
        # Exploding an array of one or none scores and filters in a single evaluation.
        scored = pairs.select(
            "query_id", "k", "entry_id", "static_cost", F.explode(F.filter(F.array(score), lambda s: s.isNotNull())).alias("score")
        )
        return scored.select(
            "query_id",
            "k",
            "entry_id",
            F.lit(kind).alias("match_type"),
            *[F.col(f"score.{c}").alias(c) for c in COSTS],
            "static_cost",
        )

    def matches(self) -> DataFrame:
        """Every match, before ranking."""
        if self.index is not None:
            return with_total(self.index.matches())
        parts = [self._matches(kind) for kind in self.kinds if kind in self.present]
        if not parts:
            parts = [self._matches(MATCH_HEADWORD).limit(0)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return with_total(out)

    def ranked(self) -> DataFrame:
        """The k cheapest matches of each query; equal costs keep lexicon order."""
        kind_rank = F.lit(0)
        for kind, rank in KIND_RANK.items():
            kind_rank = F.when(F.col("match_type") == kind, rank).otherwise(kind_rank)
        order = ["total_cost", "static_cost", "entry_id", kind_rank]
        found = self.matches() if self.index is None else with_total(self.index.contenders())
        return top_k(found, "query_id", order, "k", self.k_max)

    def candidate_counts(self) -> DataFrame:
        """(query_id, internal_candidates) for every query, zero included."""
        counts = self.matches().groupBy("query_id").agg(F.count("*").alias("n"))
        return self.queries.select("query_id").join(counts, "query_id", "left").select(
            "query_id", F.coalesce("n", F.lit(0)).alias("internal_candidates")
        )


def with_total(matches: DataFrame) -> DataFrame:
    return matches.withColumn("total_cost", F.col("static_cost") + sum((F.col(c) for c in COSTS), F.lit(0)))


def search(queries: DataFrame, lexicon: Lexicon, k: int | None = None, **options) -> DataFrame:
    """queries(query_id, query[, k]) -> the ranked matches of each query."""
    return SearchRun(queries, lexicon, k, **options).ranked()


def candidate_counts(queries: DataFrame, lexicon: Lexicon, **options) -> DataFrame:
    return SearchRun(queries, lexicon, 1, **options).candidate_counts()
