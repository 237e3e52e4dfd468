"""Scalar functions on the cases of the fixture list."""

import functools
import itertools
import random

from pyspark.sql import functions as F

import model
from glossa.functions import distance, scoring, spans, text


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema).coalesce(1)


def apply(spark, data, schema, column):
    return [r[0] for r in rows(spark, [(i, *d) for i, d in enumerate(data)], "i int, " + schema).orderBy("i").select(column).collect()]


def test_ci_index_of(spark):
    def first(needle, hay):
        low = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
        at = low(hay).find(low(needle)) if needle else -1
        return None if at < 0 else len(hay[:at].encode())

    rng = random.Random(21)
    alphabet = "aAbBkKßé🦊 "
    cases = [("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 3))), "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 9)))) for _ in range(300)]
    got = apply(spark, cases, "n string, h string", text.ci_index_of(F.col("n"), F.col("h")))
    assert got == [first(*c) for c in cases]


def test_syllable_tokens(spark):
    cases = {
        "hello ngo5 hai6 dan dan": ["ngo5", "hai6"],
        "bat1 daa2 ，soeng6 fong4": ["bat1", "daa2", "soeng6", "fong4"],
        "man4 zuk6ＬＯＯＫ": ["man4", "zuk6"],
        "5a5 55 7": ["5a5", "55"],
        "a1b2": ["a1", "b2"],
        "": [],
    }
    assert apply(spark, [(c,) for c in cases], "s string", text.syllable_tokens(F.col("s"))) == list(cases.values())


def test_tone_and_base(spark):
    cases = [("lou5", "lou", 5), ("lou", "lou", None), ("5", "", 5), ("a55", "a5", 5)]
    got = apply(spark, [(c[0],) for c in cases], "s string", F.struct(text.token_base(F.col("s")), text.token_tone(F.col("s"))))
    assert [tuple(g) for g in got] == [c[1:] for c in cases]


def test_definitions(spark):
    cases = [
        ("/a/ b //c　/", ["a", "b", "c"]),
        ("/one/two # three/four/", ["one", "two"]),
        ("", []),
        ("  /x\x0b/", ["x"]),
    ]
    assert apply(spark, [(c[0],) for c in cases], "s string", text.parse_definitions(F.col("s"))) == [c[1] for c in cases]


def test_ordered_distinct_keeps_first_spelling(spark):
    cases = [(["b", "A", "a", "B", "É", "é", "b"], ["b", "A", "É", "é"]), ([], [])]
    assert apply(spark, [(c[0],) for c in cases], "x array<string>", text.ordered_ci_distinct(F.col("x"))) == [c[1] for c in cases]


def test_escape_and_highlight(spark):
    assert apply(spark, [("1 < 2 & \"3\" > '0'",), ("",)], "s string", text.escape_html(F.col("s"))) == ["1 &lt; 2 &amp; &quot;3&quot; &gt; &#x27;0&#x27;", ""]
    m = '<mark class="hit-highlight">'  # fixed value
    cases = [
        ("red kite", [(0, 3), (4, 6)], f"{m}red</mark> {m}ki</mark>te"),
        ("a<b>c", [(1, 4)], f"a{m}&lt;b&gt;</mark>c"),
        ("no & hit", [], "no &amp; hit"),
        ("öl 木?", [(0, 2), (4, 7)], f"{m}ö</mark>l {m}木</mark>?"),
    ]
    schema = f"s string, x array<{spans.SPAN}>"
    assert apply(spark, [c[:2] for c in cases], schema, spans.highlight(F.col("s"), F.col("x"))) == [c[2] for c in cases]


def test_merge_spans(spark):
    def merged(xs):
        out = []
        for a, b in sorted(xs):
            if out and a <= out[-1][1] + 1:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    rng = random.Random(22)
    cases = [[(a, a + rng.randint(1, 6)) for a in (rng.randint(0, 40) for _ in range(rng.randint(0, 7)))] for _ in range(200)]
    got = apply(spark, [(c,) for c in cases], f"x array<{spans.SPAN}>", spans.merge_spans(F.col("x")))
    assert [[tuple(x) for x in g] for g in got] == [merged(c) for c in cases]


def test_distances():
    @functools.cache
    def edits(q, t, substitution):
        if not q or not t:
            return len(q) + len(t)
        return min(edits(q[1:], t, substitution) + 1, edits(q, t[1:], substitution) + 1, edits(q[1:], t[1:], substitution) + (0 if q[0] == t[0] else substitution))

    rng = random.Random(23)
    for _ in range(300):
        q, t = ("".join(rng.choice("xyzü") for _ in range(rng.randint(0, 4))) for _ in range(2))
        a, b = q.encode(), t.encode()
        parts = [b[i:j] for i in range(len(b)) for j in range(i + 1, len(b) + 1)]
        assert model.local_levenshtein(q, t) == (min(edits(a, p, 1) for p in parts) if a and b else len(a))
        assert model.prefix_indel(q, t) == (min(edits(a, b[:j], 2) for j in range(1, len(b) + 1)) if a and b else len(a))


def test_closed_form_fuzzy_prefix_is_the_edit_table(spark):
    def words(n):
        return ["".join(w) for i in range(1, n + 1) for w in itertools.product("abé", repeat=i)]

    pairs = [(q, t) for q in words(3) for t in words(4)]
    got = apply(spark, pairs, "q string, t string", scoring.fuzzy_prefix_distance(F.col("q"), F.col("t")))
    # Two texts beyond ASCII may share half a character in bytes; such a near match is none.
    want = [(0 if t.startswith(q) else None) if not (q.isascii() or t.isascii()) else d if (d := model.prefix_indel(q, t)) < 2 else None for q, t in pairs]
    assert got == want


def test_frequency_cost(spark):
    freqs = [(0.05670893,), (0.84706557,), (0.0,), (-0.5,), (1.0,), (1e-9,)]
    assert apply(spark, freqs, "f float", scoring.frequency_cost(F.col("f"))) == [2869, 165, 7000, 0, 1, 7000]


def test_heuristics(spark):
    cases = [
        (["tiger", "CL:x"], 2000),
        (["plain"], 7000),
        (["(Cantonese) M: x"], 0),
        (["abbr. for X", "Surname"], 14000),
        (["Confucius of the Dynasty (Buddhism)"], 22000),
        ([], 7000),
    ]
    assert apply(spark, [(c[0],) for c in cases], "d array<string>", scoring.heuristic_cost(F.col("d"))) == [c[1] for c in cases]


def test_local_levenshtein_join_is_the_brute_force(spark):
    from glossa.operators.joins import local_levenshtein_pairs, within_reach_of_any

    terms = ["lamp", "ramp", "über", "ab", "xyzw", "é", "a", "", "è!"]
    texts = ["la m,p", "a limp", "ubër", "ba", "xyw", "", "lamp lamp", "café", "xyz", "è"]
    needles = rows(spark, [(t,) for t in terms], "needle string")
    for bound in (1, 2):
        pairs = {tuple(r) for r in local_levenshtein_pairs(needles, rows(spark, [(t,) for t in texts], "key string"), bound).collect()}
        any_text = {r["needle"]: r["distance"] for r in within_reach_of_any(needles, bound).collect()}
        assert any_text == {t: len(t.encode()) for t in terms if 0 < len(t.encode()) <= bound}
        for n in terms:
            for t in texts:
                d = model.local_levenshtein(n, t)
                if n in any_text:
                    assert ((n, t, 0) in pairs) == (d == 0) and (not t or d <= any_text[n])
                elif n and t:
                    assert ((n, t, d) in pairs) == (d <= bound), (n, t, d)


def test_merge_ten_thousand_spans(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(200_000), rng.randint(0, 30)) for _ in range(10_000)]
    rows = [(s, s + n) for s, n in rows]
    want = []
    for s, e in sorted(rows):
        if want and s <= want[-1][1] + 1:
            want[-1] = (want[-1][0], max(want[-1][1], e))
        else:
            want.append((s, e))
    (got,) = apply(spark, [(rows,)], f"x array<{spans.SPAN}>", spans.merge_spans(F.col("x")))
    assert [tuple(x) for x in got] == want


def test_prefix_indel_is_the_model(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abé日") for _ in range(rng.randint(0, n)))
    cases = [(word(6), word(9)) for _ in range(150)] + [("", "a"), ("a", ""), ("", "")]
    got = apply(spark, cases, "q string, t string", distance.prefix_indel(F.col("q"), F.col("t")))
    assert got == [model.prefix_indel(*c) for c in cases]


def test_local_levenshtein_join_on_random_texts(spark, monkeypatch):
    from glossa.operators import joins

    rng = random.Random(6)
    word = lambda n, m: "".join(rng.choice("abcé ") for _ in range(rng.randint(n, m)))
    terms, texts = sorted({word(3, 14) for _ in range(40)}), sorted({word(0, 60) for _ in range(40)})
    for limit in (joins.NEEDLE_BYTES, 0):
        monkeypatch.setattr(joins, "NEEDLE_BYTES", limit)
        for bound in (0, 1, 2):
            found = joins.local_levenshtein_pairs(rows(spark, [(t,) for t in terms], "needle string"), rows(spark, [(t,) for t in texts], "key string"), bound)
            got = {tuple(r) for r in found.collect()}
            far = {(n, t): model.local_levenshtein(n, t) for n in terms for t in texts}
            assert got == {(n, t, d) for (n, t), d in far.items() if t and d <= bound and (len(n.encode()) > bound or d == 0)}
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
