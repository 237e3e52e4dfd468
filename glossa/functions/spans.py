"""Highlight spans: merging, locating and rendering them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.costs import DEFAULT_COSTS, CostModel
from glossa.functions.scoring import best_positions, packed_position, term_syllable_cost
from glossa.functions.text import byte_offset, characters, ci_index_of, escape_html, let, running_max, totals_before

SPAN = "struct<start:int,end:int>"
# The highlight markup.
MARK_OPEN = '<mark class="hit-highlight">'
MARK_CLOSE = "</mark>"


def span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def merge_spans(spans: Column) -> Column:
    """Sorted spans, fused where the next one starts at most one past the current end.

    A merged span begins where a start lies beyond all ends before it, and ends
    at the highest end before the next one begins. One pass over the running
    highest end finds both.
    """

    def islands(xs: Column, highest: Column) -> Column:
        at = F.transform(xs, lambda x, i: F.when((i == 0) | (x["start"] > F.get(highest, i - 1) + 1), i))
        return let(
            F.filter(at, lambda i: i.isNotNull()),
            lambda begins: F.transform(
                begins,
                lambda i, j: span(F.get(xs, i)["start"], F.get(highest, F.coalesce(F.get(begins, j + 1), F.size(xs)) - 1)),
            ),
        )

    merged = let(
        F.sort_array(spans),
        lambda xs: let(running_max(F.transform(xs, lambda x: x["end"])), lambda highest: islands(xs, highest)),
    )
    return F.when(F.size(spans) > 0, merged).otherwise(no_spans())


def highlight(text: Column, spans: Column) -> Column:
    """Escape ``text`` and wrap the merged byte ``spans`` in mark elements."""
    raw = text.cast("binary")

    def piece(start: Column, end: Column) -> Column:
        return escape_html(F.substring(raw, start + 1, end - start).cast("string"))

    def marked(s: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
        return F.concat(piece(before, s["start"]), F.lit(MARK_OPEN), piece(s["start"], s["end"]), F.lit(MARK_CLOSE))

    tail = piece(F.element_at(spans, -1)["end"], F.octet_length(text))
    return F.when(F.size(spans) == 0, escape_html(text)).otherwise(
        F.concat(F.array_join(F.transform(spans, marked), ""), tail)
    )


def char_spans_to_bytes(text: Column, spans: Column) -> Column:
    return F.transform(
        spans, lambda s: span(byte_offset(text, s["start"] + 1), byte_offset(text, s["end"] + 1))
    )


def headword_spans(headword: Column, query_chars: Column) -> Column:
    """Character-index spans of the headword characters that occur in the query."""
    hits = F.filter(
        F.transform(characters(headword), lambda c, i: F.struct(c.alias("c"), i.alias("i"))),
        lambda x: F.array_contains(query_chars, x["c"]),
    )
    return F.transform(hits, lambda x: span(x["i"], x["i"] + 1))


def definition_spans(definition: Column, terms: Column) -> Column:
    """Byte spans of the first hit of each whitespace term within one definition."""
    found = F.transform(
        terms,
        lambda t: F.struct(ci_index_of(t["tok"], definition).alias("p"), F.octet_length(t["tok"]).alias("n")),
    )
    return F.transform(F.filter(found, lambda x: x["p"].isNotNull()), lambda x: span(x["p"], x["p"] + x["n"]))


#: Costs are compared like tuples: what a match costs, then the position of each term.
_COST = "array<bigint>"
_STATE = f"struct<rows:array<{_COST}>,cols:array<{_COST}>,taken:array<int>>"
_REACHED = f"array<struct<far:{_COST},via:int,done:boolean>>"
_WALK = f"struct<reached:{_REACHED},row:int,at:int,far:{_COST},end:int>"
#: More than any sum of costs of matches that exist.
_IMPOSSIBLE = 1 << 50


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def assign_syllables(terms: Column, syl: Column, costs: CostModel = DEFAULT_COSTS) -> Column:
    """Cheapest assignment of the terms to distinct syllable positions, null if none exists.

    Ties go to the lexicographically smallest position list. Terms are added
    one by one along shortest augmenting paths, with potentials that keep all
    reduced costs from falling below zero, so the work grows with
    terms^2 * syllables^2. A cost is an array, of what the match costs and then
    the chosen position in the place of its term: sums of such arrays, ordered
    like tuples, rank whole assignments by cost and then by positions. Where
    the cheapest, then earliest syllables of all terms differ, they are that
    assignment, and no path is searched.
    """

    def cost(t: Column, i: Column, s: Column, j: Column) -> Column:
        found = F.when(
            t["tone"].isNull() | (t["tone"] == s["tone"]), term_syllable_cost(t["base"], t["base_fold"], s["base"], costs)
        )
        first = F.coalesce(found.cast("bigint"), F.lit(_IMPOSSIBLE).cast("bigint"))
        return F.concat(F.array(first), F.transform(terms, lambda _, k: F.when(k == i, j).otherwise(F.lit(0)).cast("bigint")))

    edges = F.transform(terms, lambda t, i: F.transform(syl, lambda s, j: cost(t, i, s, j)))
    nothing = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(terms, lambda _: F.lit(0).cast("bigint")))
    start = F.struct(
        F.transform(terms, lambda _: nothing).alias("rows"),
        F.transform(syl, lambda _: nothing).alias("cols"),
        F.transform(syl, lambda _: F.lit(-1)).alias("taken"),
    ).cast(_STATE)

    def shortest(edges: Column, state: Column, i: Column) -> Column:
        """The walk from term ``i`` to the nearest free syllable: what was reached, and the free one in ``end``."""

        def look(w: Column) -> Column:
            def reach(c: Column, j: Column) -> Column:
                step = _minus(_minus(F.get(F.get(edges, w["row"]), j), F.get(state["rows"], w["row"])), F.get(state["cols"], j))
                nearer = lambda far: F.when(c["far"].isNull() | (far < c["far"]), F.struct(far.alias("far"), w["at"].alias("via"), F.lit(False).alias("done"))).otherwise(c)
                return F.when(c["done"], c).otherwise(let(_plus(w["far"], step), nearer))

            return F.transform(w["reached"], reach).cast(_REACHED)

        def settle(reached: Column) -> Column:
            nearest = F.array_min(F.transform(reached, lambda c, j: F.when(~c["done"], F.struct(c["far"].alias("far"), j.cast("int").alias("j")))))

            def go_on(near: Column) -> Column:
                mark = lambda c, j: F.struct(c["far"].alias("far"), c["via"].alias("via"), (c["done"] | (j == near["j"])).alias("done"))
                row = F.get(state["taken"], near["j"])
                return F.struct(
                    F.when(row < 0, reached).otherwise(F.transform(reached, mark)).alias("reached"),
                    row.alias("row"),
                    near["j"].alias("at"),
                    near["far"].alias("far"),
                    F.when(row < 0, near["j"]).otherwise(-1).alias("end"),
                ).cast(_WALK)

            return let(nearest, go_on)

        begin = F.struct(
            F.transform(syl, lambda _: F.struct(F.lit(None).cast(_COST).alias("far"), F.lit(-1).alias("via"), F.lit(False).alias("done"))).alias("reached"),
            i.cast("int").alias("row"),
            F.lit(-1).alias("at"),
            nothing.alias("far"),
            F.lit(-1).alias("end"),
        ).cast(_WALK)
        step = lambda w, _: F.when(w["end"] >= 0, w).otherwise(let(look(w), settle)).cast(_WALK)
        # A walk settles at most one syllable per term placed so far, and then a free one.
        return F.aggregate(F.sequence(F.lit(0), i.cast("int")), begin, step)

    def place(edges: Column, state: Column, i: Column) -> Column:
        def end(walk: Column) -> Column:
            far = walk["far"]
            cols = F.zip_with(state["cols"], walk["reached"], lambda v, c: F.when(c["done"], _plus(v, _minus(c["far"], far))).otherwise(v))
            settled = F.transform(walk["reached"], lambda c, j: F.when(c["done"], F.struct(F.get(state["taken"], j).alias("row"), c["far"].alias("far"))))

            def raised(u: Column, r: Column, settled: Column) -> Column:
                own = F.get(F.filter(settled, lambda x: x.isNotNull() & (x["row"] == r)), F.lit(0))
                return F.when(r == i, _plus(u, far)).when(own.isNotNull(), _plus(u, _minus(far, own["far"]))).otherwise(u)

            rows = let(settled, lambda xs: F.transform(state["rows"], lambda u, r: raised(u, r, xs)))

            def shift(x: Column, _: Column) -> Column:
                via = F.get(walk["reached"], x["j"])["via"]
                owner = F.when(via < 0, i.cast("int")).otherwise(F.get(x["taken"], via))
                moved = F.struct(F.transform(x["taken"], lambda o, j: F.when(j == x["j"], owner).otherwise(o)).alias("taken"), via.alias("j"))
                return F.when(x["j"] < 0, x).otherwise(moved).cast("struct<taken:array<int>,j:int>")

            back = F.aggregate(
                F.sequence(F.lit(0), i.cast("int")),
                F.struct(state["taken"].alias("taken"), walk["end"].alias("j")).cast("struct<taken:array<int>,j:int>"),
                shift,
            )
            return F.struct(rows.alias("rows"), cols.alias("cols"), back["taken"].alias("taken")).cast(_STATE)

        return let(shortest(edges, state, i), end)

    def solved(edges: Column) -> Column:
        indices = F.transform(terms, lambda _, i: i)
        return let(F.aggregate(indices, start, lambda state, i: place(edges, state, i)), lambda done: path_of(edges, done["taken"]))

    def path_of(edges: Column, taken: Column) -> Column:
        path = F.transform(terms, lambda _, i: (F.array_position(taken, i.cast("int")) - 1).cast("int"))
        real = lambda ps: F.forall(F.transform(ps, lambda p, i: F.get(F.get(F.get(edges, i), p), F.lit(0)) < _IMPOSSIBLE), lambda x: x)
        return let(path, lambda ps: F.when(real(ps), ps))

    def assigned(best: Column) -> Column:
        positions = F.transform(best, lambda b: packed_position(b).cast("int"))
        differ = F.size(F.array_distinct(positions)) == F.size(best)
        searched = F.when(differ, positions).otherwise(let(edges, solved))
        return F.when(F.forall(best, lambda b: b.isNotNull()), searched)

    return F.when((F.size(terms) > 0) & (F.size(terms) <= F.size(syl)), let(best_positions(terms, syl, costs), assigned))


def syllable_spans(terms: Column, syl: Column, path: Column) -> Column:
    """Byte spans in the display reading for an assignment of terms to syllables."""

    width = F.transform(syl, lambda s: F.octet_length(s["base"]) + F.octet_length(s["tone"].cast("string")) + 1)

    def of_syllable(s: Column, i: Column, starts: Column) -> Column:
        target = F.concat(s["base"], s["tone"].cast("string"))
        start = F.get(starts, i).cast("int")
        t = F.get(terms, F.array_position(path, i.cast("int")).cast("int") - 1)
        whole = ci_index_of(t["tok"], target)
        bare = ci_index_of(t["base"], target)
        end = start + F.octet_length(target)
        found = (
            F.when(whole.isNotNull(), F.array(span(start + whole, start + whole + F.octet_length(t["tok"]))))
            .when(
                t["tone"].isNotNull() & bare.isNotNull(),
                F.array(span(start + bare, start + bare + F.octet_length(t["base"])), span(end - 1, end)),
            )
            .when(t["tone"].isNotNull(), F.array(span(end - 1, end)))
            .otherwise(no_spans())
        )
        return F.when(F.array_contains(path, i.cast("int")), found).otherwise(no_spans())

    found = let(totals_before(width), lambda starts: F.flatten(F.transform(syl, lambda s, i: of_syllable(s, i, starts))))
    return F.when(path.isNull(), no_spans()).otherwise(found)
