"""Matches of a table of queries from the posting tables of a saved lexicon.

A posting tells where its key first occurs, so the place and the cost of a
term follow from the key it was found in; no text is read. Keys that were not
asked for are pruned by shard. Hits are folded to the best one per query,
entry and term, then to one row per query and entry, which counts if every
term is there. Where no query has more than SLOTS terms, one aggregation with
a minimum per term does both.

Where the anchors (each query's rarest term) have few enough entries, those
are broadcast, and postings of other terms that belong to none of them go
before anything is shuffled. The number is known from the stored counts.

The k best of queries that only definitions can match, with many hits in all,
are sought among near postings first. Static cost and place of a posting, its
bound, are part of the cost of every match that needs it, and later places of
a term have higher bounds. So all matches of a cost up to some bound follow
exactly from the postings up to it. Queries that have k such matches are done;
the others are sought further out and, once few hits are left, among all.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.costs import MATCH_DEFINITION, MATCH_HEADWORD, MATCH_SYLLABLE
from glossa.functions.scoring import COSTS, inversion_count, packed_cost, packed_position, term_syllable_cost, total, unmatched_cost
from glossa.functions.text import fold
from glossa.operators.joins import hot_from_counts, salted_join
from glossa.operators.postings import shard_of

if TYPE_CHECKING:
    from glossa.plans.search import SearchRun

TABLES = {MATCH_SYLLABLE: "syllables", MATCH_DEFINITION: "words", MATCH_HEADWORD: "characters"}
#: What a candidate (query, entry) takes in a broadcast table.
CANDIDATE_BYTES = 64
#: Terms of the longest query up to which each term has a column of its own.
SLOTS = 4
#: Hits up to which the matches of all queries are made and then ranked.
MANY_HITS = 1 << 22
#: Near postings that are first looked at, and how many times more each time after.
NEAR_ROWS, FURTHER = 1 << 18, 16
#: Shards from which the bounds of so many postings are estimated. No result depends on them.
BOUND_SHARDS = 8
_HALF = 32
_FACTS = ("k", "n_terms", "non_ascii")


class Asked:
    """The keys that a run asks for, by kind, and the shards that hold them."""

    def __init__(self, run: SearchRun, pairs: DataFrame):
        self.run = run
        tagged = []
        costs = run.costs
        # No other kind matches such a query, and what its matches cost is at least their bound.
        alone = F.size("anchors") == 1 if min(costs.english_offset, costs.english_mid_word, costs.inversion) >= 0 else F.lit(False)
        for kind in run.kinds:
            if kind == MATCH_SYLLABLE:
                terms = F.transform("terms", lambda t, i: F.struct(t["base"].alias("term"), t["tone"].alias("tone"), i.alias("term_idx")))
            elif kind == MATCH_DEFINITION:
                terms = F.transform("terms", lambda t, i: F.struct(t["tok_fold"].alias("term"), F.lit(None).cast("int").alias("tone"), i.alias("term_idx")))
            else:
                terms = F.transform("chars", lambda c, i: F.struct(c.alias("term"), F.lit(None).cast("int").alias("tone"), i.alias("term_idx")))
            rows = run.queries.filter(F.col("anchors")[kind].isNotNull())
            tagged.append(
                rows.select(
                    "query_id", "k", F.size(terms).alias("n_terms"), "non_ascii", F.lit(kind).alias("kind"), F.col("anchors")[kind].alias("anchor"), alone.alias("alone"), F.explode(terms).alias("t")
                ).select("query_id", *_FACTS, "kind", "alone", "t.term", "t.tone", "t.term_idx", (F.col("t.term") == F.col("anchor")).alias("at_anchor"))
            )
        terms = tagged[0]
        for t in tagged[1:]:
            terms = terms.unionByName(t)
        pairs = pairs.select("kind", "term", "key", "n_entries")
        # Few terms join anew each time that they are read; their pairs are many more rows, and are not written again.
        light = run.query_bytes <= run.broadcast_bytes
        self.wanted = pairs.join(F.broadcast(terms), ["kind", "term"]) if light else run._cut(terms.join(pairs, ["kind", "term"]))
        self.shards: dict[str, list[int]] = {}
        shard = F.lit(0)
        for kind in run.kinds:
            shard = F.when(F.col("kind") == kind, shard_of(F.col("key"), run.lexicon.postings[TABLES[kind]].shards)).otherwise(shard)
        size = F.sum(F.octet_length("key") + F.octet_length("term") + 96).alias("bytes")
        # A row per kind and shard, of which there are no more than a few thousand.
        far = (F.col("kind") == MATCH_DEFINITION) & F.col("alone")
        facts = [size, F.max("n_terms").alias("n_terms"), F.sum(F.when(far, F.col("n_entries"))).alias("hits"), F.count_if(~far).alias("others")]
        asked = self.wanted.groupBy("kind", shard.alias("shard")).agg(*facts).collect()
        self.slots: dict[str, int] = {}
        self.hits, self.others = 0, False
        for r in asked:
            self.shards.setdefault(r["kind"], []).append(r["shard"])
            self.slots[r["kind"]] = max(self.slots.get(r["kind"], 0), r["n_terms"])
            self.hits += r["hits"] or 0
            self.others |= r["kind"] == MATCH_DEFINITION and r["others"] > 0
        self.small = sum(r["bytes"] for r in asked) <= run.broadcast_bytes
        candidates = run.queries.agg(F.coalesce(F.sum("anchor_entries"), F.lit(0))).first()[0]
        self.few = candidates * CANDIDATE_BYTES <= run.broadcast_bytes

    def _table(self, kind: str) -> DataFrame:
        return self.run.lexicon.postings[TABLES[kind]].of_shards(self.shards[kind])

    def _hits(self, kind: str, wanted: DataFrame) -> DataFrame:
        """Postings of the wanted keys, each with the queries and terms that asked for it."""
        table = self._table(kind)
        wanted = wanted.drop("kind", "at_anchor", "alone", "n_entries")
        if self.small:
            return table.join(F.broadcast(wanted), "key")
        counts = getattr(self.run.lexicon, TABLES[kind])
        hot = hot_from_counts(counts.toDF("key", "n_entries"))
        return salted_join(table, wanted, "key", spread=F.xxhash64("entry_id"), hot=hot)

    def _best(self, kind: str) -> Column:
        """The hit as a number that orders the hits of a term and holds what its cost needs."""
        if kind == MATCH_SYLLABLE:
            cost = term_syllable_cost(F.col("term"), fold(F.col("term")), F.col("key"), self.run.costs)
            return F.when(F.col("tone_asked").isNull() | (F.col("tone_asked") == F.col("tone")), F.shiftleft(cost.cast("bigint"), 31) + F.col("pos"))
        if kind == MATCH_DEFINITION:
            inner = F.instr("key", F.col("term"))
            before = F.substring("key", F.lit(1), inner - 1)
            middle = F.when((inner == 1) | F.endswith(before, F.lit("-")), 0).otherwise(1)
            place = (F.col("at_char") + inner - 1).cast("bigint")
            return F.shiftleft(place, _HALF) + (F.col("at_byte") + F.octet_length(before)).cast("bigint") * 2 + middle
        return F.lit(0).cast("bigint")

    def _scored(self, kind: str, best: Column, n_syllables: Column) -> Column:
        costs = self.run.costs
        zero = F.lit(0).cast("bigint")
        if kind == MATCH_SYLLABLE:
            positions = F.transform(best, packed_position)
            return F.struct(
                total(F.transform(best, packed_cost)).alias(COSTS[0]),
                unmatched_cost(positions, n_syllables, costs).alias(COSTS[1]),
                (inversion_count(positions) * costs.inversion).alias(COSTS[2]),
            )
        if kind == MATCH_DEFINITION:
            low = F.lit((1 << _HALF) - 1).cast("bigint")
            # The block's leading blank is no byte of the definitions.
            hit = lambda b: (F.shiftright(b.bitwiseAND(low), 1) - 1) * costs.english_offset + b.bitwiseAND(F.lit(1).cast("bigint")) * costs.english_mid_word
            cost = costs.english_base + F.col("non_ascii").cast("bigint") * costs.english_non_ascii + total(F.transform(best, hit))
            return F.struct(
                cost.cast("bigint").alias(COSTS[0]),
                zero.alias(COSTS[1]),
                (inversion_count(F.transform(best, lambda b: F.shiftright(b, _HALF))) * costs.inversion).alias(COSTS[2]),
            )
        return F.struct(*[zero.alias(c) for c in COSTS])

    def _wanted(self, kind: str) -> DataFrame:
        return self.wanted.filter(F.col("kind") == kind).withColumnRenamed("tone", "tone_asked")

    def _matches(self, kind: str, wanted: DataFrame | None = None) -> DataFrame:
        wanted = self._wanted(kind) if wanted is None else wanted
        if self.few:
            # The entries of the anchors first; what else is asked has to be in one of them.
            first = self._hits(kind, wanted.filter("at_anchor"))
            candidates = self.run._cut(first.select("query_id", "entry_id").distinct())
            others = self._hits(kind, wanted.filter("not at_anchor")).join(F.broadcast(candidates), ["query_id", "entry_id"], "left_semi")
            hits = first.unionByName(others)
        else:
            hits = self._hits(kind, wanted)
        return self._folded(kind, hits)

    def _folded(self, kind: str, hits: DataFrame) -> DataFrame:
        """One row per query and entry whose terms are all there."""
        n_syllables = F.col("n_syllables") if kind == MATCH_SYLLABLE else F.lit(0)
        hits = hits.select("query_id", *_FACTS, "entry_id", "static_cost", "term_idx", n_syllables.alias("n_syllables"), self._best(kind).alias("best")).filter("best is not null")
        facts = [F.max(c).alias(c) for c in (*_FACTS, "static_cost", "n_syllables")]
        slots = self.slots[kind]
        if slots <= SLOTS:
            mins = [F.min(F.when(F.col("term_idx") == i, F.col("best"))).alias(f"best{i}") for i in range(slots)]
            per_pair = hits.groupBy("query_id", "entry_id").agg(*mins, *facts)
            enough = F.lit(True)
            for i in range(slots):
                enough = enough & (F.col(f"best{i}").isNotNull() | (F.col("n_terms") <= i))
            best = F.slice(F.array(*[f"best{i}" for i in range(slots)]), F.lit(1), F.col("n_terms"))
        else:
            per_term = hits.groupBy("query_id", "entry_id", "term_idx").agg(F.min("best").alias("best"), *facts)
            per_pair = per_term.groupBy("query_id", "entry_id").agg(F.sort_array(F.collect_list(F.struct("term_idx", "best"))).alias("found"), *facts)
            enough = F.size("found") == F.col("n_terms")
            best = F.transform("found", lambda x: x["best"])
        if kind == MATCH_SYLLABLE:
            enough = enough & (F.col("n_syllables") >= F.col("n_terms"))
        score = self._scored(kind, best, F.col("n_syllables"))
        scored = per_pair.filter(enough).withColumn("score", score)
        return scored.select(
            "query_id", "k", "entry_id", F.lit(kind).alias("match_type"), *[F.col(f"score.{c}").alias(c) for c in COSTS], F.col("static_cost").cast("bigint").alias("static_cost")
        )

    def _asked_in(self, table: DataFrame, wanted: DataFrame) -> DataFrame:
        """``table`` joined with what is wanted of it, which is dealt out by its measured size."""
        wanted = wanted.drop("kind", "at_anchor", "alone", "n_entries")
        limit = self.run.broadcast_bytes
        sizes = wanted.agg(F.coalesce(F.sum(F.octet_length("key") + F.octet_length("term") + 96), F.lit(0)).alias("rows")).first()
        if sizes["rows"] <= limit:
            return table.join(F.broadcast(wanted), "key")
        keys = wanted.select("key").distinct()
        if keys.agg(F.sum(F.octet_length("key") + 48)).first()[0] <= limit:
            table = table.join(F.broadcast(keys), "key", "left_semi")
        return salted_join(table, wanted, "key", spread=F.xxhash64("entry_id"))

    def contenders(self) -> DataFrame:
        """Matches that hold the k best of each query: all of them, or where these are many, those of low bounds."""
        run, kind, costs = self.run, MATCH_DEFINITION, self.run.costs
        many = self.hits > MANY_HITS and run.lexicon.repeated.count()
        if self.hits <= MANY_HITS or many * CANDIDATE_BYTES > run.broadcast_bytes:
            return self.matches()
        told = F.broadcast if run.query_bytes <= run.broadcast_bytes else lambda df: df
        table, bound = self._table(kind), F.col("static_cost").cast("bigint") + (F.col("at_byte").cast("bigint") - 1) * costs.english_offset
        # Places and costs under an id that several entries have are not those of one entry; such postings are always near.
        always = F.col("entry_id").isNull()
        if many:
            table = table.join(F.broadcast(run.lexicon.repeated.withColumn("again", F.lit(True))), "entry_id", "left")
            always = always | F.col("again").isNotNull()
        parts = [self.matches(alone=False)] if self.others or len(self.shards) > 1 else []
        wanted, left, rows = self._wanted(kind).filter("alone"), self.hits, NEAR_ROWS
        postings = run.lexicon.words.agg(F.sum("n_entries")).first()[0]
        some = run.lexicon.postings[TABLES[kind]].of_shards(sorted(self.shards[kind])[:BOUND_SHARDS])
        while left > MANY_HITS and rows * 4 < postings:
            limit = some.agg(F.percentile_approx(bound, rows / postings, 10_000)).first()[0]
            if limit is None:
                break
            near = run._cut(table.filter(always | F.coalesce(bound <= limit, F.lit(True))).drop("again"))
            keys = near.select("key").distinct()
            size = keys.agg(F.coalesce(F.sum(F.octet_length("key") + 48), F.lit(0))).first()[0]
            asked = wanted.join(F.broadcast(keys) if size <= run.broadcast_bytes else keys, "key", "left_semi")
            found = run._cut(self._folded(kind, self._asked_in(near, run._cut(asked))))
            # What all matches of a query cost alike is no part of the bounds. Without a static cost, a match comes first.
            alike = costs.english_base + F.col("non_ascii").cast("bigint") * costs.english_non_ascii
            within = F.coalesce(F.col("static_cost") + sum((F.col(c) for c in COSTS), F.lit(0)) - alike <= limit, F.lit(True))
            full = found.join(told(run.queries.select("query_id", "non_ascii")), "query_id").filter(within)
            full = run._cut(full.groupBy("query_id").agg(F.count("*").alias("n"), F.max("k").alias("k")).filter("n >= k").select("query_id"))
            parts.append(found.join(told(full), "query_id", "left_semi"))
            wanted = wanted.join(told(full), "query_id", "left_anti")
            left = wanted.agg(F.coalesce(F.sum("n_entries"), F.lit(0))).first()[0]
            rows *= FURTHER
        if left:
            parts.append(self._folded(kind, self._asked_in(table.drop("again"), run._cut(wanted))))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def matches(self, alone: bool = True) -> DataFrame:
        """Every match; one kind excludes another by (query, entry). Without ``alone``, not those of queries that only definitions match."""
        run, pair = self.run, ["query_id", "entry_id"]
        kinds = [k for k in run.kinds if k in self.shards and (alone or k != MATCH_DEFINITION or self.others)]
        if not kinds:
            return self._empty()
        found = {k: self._matches(k, None if alone or k != MATCH_DEFINITION else self._wanted(k).filter("not alone")) for k in kinds}
        if len(kinds) > 1:
            # Read by other kinds too, so made once.
            for k in (MATCH_SYLLABLE, *([MATCH_HEADWORD] if run.dedup else [])):
                if k in found:
                    found[k] = run._cut(found[k])
        out = None
        for k in kinds:
            rows = found[k]
            if k != MATCH_SYLLABLE and MATCH_SYLLABLE in found:
                rows = rows.join(found[MATCH_SYLLABLE].select(*pair), pair, "left_anti")
            if k == MATCH_DEFINITION and run.dedup and MATCH_HEADWORD in found:
                rows = rows.join(found[MATCH_HEADWORD].select(*pair), pair, "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return out

    def _empty(self) -> DataFrame:
        none = F.lit(0).cast("bigint")
        rows = self.run.queries.limit(0)
        return rows.select("query_id", "k", none.alias("entry_id"), F.lit("").alias("match_type"), *[none.alias(c) for c in (*COSTS, "static_cost")])
