"""Personal data by weak supervision, with built-in functions only.

Broad patterns propose spans. Labelers vote on each proposal for, against or
not at all: strict patterns, gazetteers, words around it, its edges and its
digits. Expectation-maximisation over the counts of vote patterns estimates
how often each labeler votes which way on true and on false spans, and the
share of true spans of each kind. The resulting probabilities train a naive
Bayes classifier over the votes and further features of a span, which decides
on the proposals of the kinds that no fixed rule settles.

Vote patterns and feature values are few, whatever the number of documents,
so their counts are all that leaves the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import cut, free_name

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "local_phone", "name")
KINDS = BASE + ADDED
ROUNDS = 50
ACCEPT = 0.5
CONTEXT = 40
_MARK, _OTHER = "", ""
_CHUNK = 64

# What proposes a span. The base kinds' rules are fixed: email, ip and phone as given, card as runs of
# digits with single separators. Possessive forms keep Java's matcher from recursing on long runs.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){13})[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+(.-])(?<!\+[0-9]{1,3} )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "name": r"(?<![\p{L}.])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? \p{Lu}\p{L}{1,20}(?: \p{Lu}\p{L}{1,20})?(?!\p{L})",
}
# A cheap sign without which a pattern cannot match.
SIGNS = {"email": "@", "phone": "+", "ssn": "-"}
_DIGIT_KINDS = ("ip", "card", "phone", "iban", "ssn", "local_phone")

# Gazetteers and context words.
TOP_DOMAINS = "com|org|net|edu|gov|int|info|io|de|fr|es|uk|eu|us|it|nl|ch|at|be|pl|se|example|test"
CALLING_CODES = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98|351|352|353|354|358|420|421"
CARD_PREFIXES = "4|5[1-5]|2[2-7]|34|37|36|38|30|60|62|64|65|35"
IBAN_COUNTRIES = "AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM|TR"
FOR_WORDS = {
    "email": "mail|contact|write|address",
    "ip": "\\bip\\b|host|server|address|login|from",
    "card": "card|visa|credit|payment|karte|tarjeta|carte",
    "phone": "phone|tel|call|fax|mobile|cell",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security|taxpayer",
    "local_phone": "phone|tel|call|fax|mobile|cell|number",
    "name": "name|dear|by|from|contact|signed|author",
}
AGAINST_WORDS = "version|release|isbn|issn|doi|section|figure|page|order no|invoice|ticket|serial|part no|build|chapter"


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def _running(lengths: Column) -> Column:
    """Sum of the elements before each element, in two levels so that long arrays are not rebuilt per element."""
    sums = lambda xs, start: F.aggregate(
        xs,
        F.struct(F.array().cast("array<int>").alias("out"), start.cast("int").alias("run")),
        lambda a, x: F.struct(F.concat(a["out"], F.array(a["run"])).alias("out"), (a["run"] + x).cast("int").alias("run")),
    )["out"]
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _CHUNK).cast("int")), lambda c: F.slice(lengths, c * _CHUNK + 1, _CHUNK))
    return _let(
        chunks,
        lambda cs: _let(
            sums(F.transform(cs, lambda c: F.aggregate(c, F.lit(0), lambda a, x: (a + x).cast("int"))), F.lit(0)),
            lambda starts: F.flatten(F.transform(cs, lambda c, i: sums(c, starts[i]))),
        ),
    )


_SPAN = "struct<kind:string,start:int,end:int,value:string,left:string,right:string>"


def _guard(text: Column, kind: str) -> Column:
    has = text.rlike(PATTERNS[kind])
    if kind in SIGNS:
        return (F.instr(text, SIGNS[kind]) > 0) & has
    return has


def _parts(text: Column, kind: str) -> Column:
    """The text cut at the matches: odd elements of the array are matches."""
    marked = F.regexp_replace(F.translate(text, _MARK, _OTHER), PATTERNS[kind], f"{_MARK}$0{_MARK}")
    return F.split(marked, _MARK)


def proposals(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches of a kind as spans in code points with their surroundings."""

    def spans(parts: Column) -> Column:
        return _let(
            _running(F.transform(parts, lambda p: F.char_length(p))),
            lambda starts: F.transform(
                F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)),
                lambda i: F.struct(
                    F.lit(kind).alias("kind"),
                    starts[i].alias("start"),
                    (starts[i] + F.char_length(parts[i])).alias("end"),
                    parts[i].alias("value"),
                    F.right(parts[i - 1], F.lit(CONTEXT)).alias("left"),
                    F.left(parts[i + 1], F.lit(CONTEXT // 2)).alias("right"),
                ),
            ),
        )

    return F.when(_guard(text, kind), _let(_parts(text, kind), spans)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: (a + x).cast("int")) % 10 == 0


def valid_base(kind: str, value: Column) -> Column:
    """The fixed rule of a base kind on one match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # A part of at most three digits after its leading zeros, and at most 255.
        small = lambda p: _let(F.ltrim(p, F.lit("0")), lambda q: (F.char_length(q) <= 3) & (F.concat(F.lit("0"), F.substring(q, 1, 3)).cast("int") <= 255))
        return F.forall(F.split(value, r"\."), small)
    n = F.char_length(_digits(value))
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), luhn(_digits(value))).otherwise(F.lit(False))
    return (n >= 10) & (n <= 15)


def votes(span: Column) -> Column:
    """Votes of the labelers on a span: 1 for, -1 against, 0 none."""
    kind, value, left, right = span["kind"], span["value"], F.lower(span["left"]), F.lower(span["right"])
    digits = _digits(value)
    yes_no = lambda c: F.when(c, 1).otherwise(-1)
    by_kind = lambda options, other: _case(kind, options, other)
    strict = by_kind(
        {
            "email": yes_no(value.rlike(r"^[A-Za-z0-9][^@]{0,63}@[A-Za-z0-9].*\.[A-Za-z]{2,}$")),
            "ip": yes_no(valid_base("ip", value)),
            "card": yes_no(valid_base("card", value)),
            "phone": yes_no(valid_base("phone", value)),
            "iban": yes_no(F.char_length(F.regexp_replace(value, " ", "")).between(15, 34)),
            "ssn": yes_no(~value.rlike("^(000|666|9)|-00-|-0000$")),
            "local_phone": yes_no(value.rlike(r"^\(?[2-9]")),
        },
        F.lit(0),
    )
    gazetteer = by_kind(
        {
            "email": F.when(value.rlike(rf"\.(?:{TOP_DOMAINS})$"), 1).otherwise(0),
            "ip": F.when(value.rlike(r"^(?:0|127|255|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."), -1).otherwise(0),
            "card": F.when(digits.rlike(f"^(?:{CARD_PREFIXES})"), 1).otherwise(-1),
            "phone": yes_no(value.rlike(rf"^\+(?:{CALLING_CODES})")),
            "iban": yes_no(value.rlike(f"^(?:{IBAN_COUNTRIES})")),
            "name": F.lit(1),
        },
        F.lit(0),
    )
    near = F.concat_ws(" ", left, right)
    words = by_kind({k: F.when(near.rlike(w), 1).otherwise(0) for k, w in FOR_WORDS.items()}, F.lit(0))
    against = F.when(left.rlike(AGAINST_WORDS), -1).otherwise(0)
    edges = F.when(span["left"].rlike(r"[\p{L}\p{N}_/=#-]$") | span["right"].rlike(r"^[\p{L}\p{N}_/=#-]"), -1).otherwise(1)
    plain = F.when((F.char_length(digits) >= 7) & digits.rlike(r"^(\d)\1+$|123456789|987654321"), -1).otherwise(0)
    return F.array(strict, gazetteer, words, against, edges, plain).cast("array<int>")


def _case(on: Column, options: dict, other: Column) -> Column:
    out = None
    for k, v in options.items():
        out = F.when(on == k, v) if out is None else out.when(on == k, v)
    return other if out is None else out.otherwise(other)


def features(span: Column) -> Column:
    """Further features of a span, each with few values."""
    value = span["value"]
    return F.array(
        F.least(F.char_length(value), F.lit(40)).cast("int"),
        F.least(F.char_length(_digits(value)), F.lit(20)).cast("int"),
        F.pmod(F.xxhash64(F.lower(F.regexp_extract(span["left"], r"([\p{L}]+)[^\p{L}]*$", 1))), F.lit(64)).cast("int"),
    )


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = ROUNDS) -> dict[tuple[str, tuple[int, ...]], float]:
    """P(true) of each (kind, votes) by EM. ``patterns``: (kind, votes, count).

    Each labeler has a probability of each vote given the truth, with a prior
    that it is right more often than not; each kind has its own share of true
    spans, with one true and one false span as its prior.
    """
    if not patterns:
        return {}
    m = len(patterns[0][1])
    kinds = sorted({k for k, _, _ in patterns})
    share = dict.fromkeys(kinds, 0.5)
    prior = {True: {1: 4.0, 0: 2.0, -1: 1.0}, False: {1: 1.0, 0: 2.0, -1: 4.0}}
    rate = {y: [{v: prior[y][v] / 7 for v in (1, 0, -1)} for _ in range(m)] for y in (True, False)}
    post: dict[tuple[str, tuple[int, ...]], float] = {}
    for _ in range(rounds):
        for kind, vote, _ in patterns:
            odds = math.log(share[kind] / (1 - share[kind])) + sum(math.log(rate[True][i][v] / rate[False][i][v]) for i, v in enumerate(vote))
            post[kind, vote] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for kind in kinds:
            own = [(post[k, v], n) for k, v, n in patterns if k == kind]
            share[kind] = (1 + sum(p * n for p, n in own)) / (2 + sum(n for _, n in own))
        for y in (True, False):
            for i in range(m):
                held = dict(prior[y])
                for kind, vote, n in patterns:
                    p = post[kind, vote]
                    held[vote[i]] += n * (p if y else 1 - p)
                total = sum(held.values())
                rate[y][i] = {v: c / total for v, c in held.items()}
    return post


class SpanClassifier:
    """Naive Bayes over votes and features: log-odds per value, as a Column."""

    def __init__(self, bias: dict[str, float], odds: list[dict[int, float]]):
        self.bias, self.odds = bias, odds

    def probability(self, span: Column) -> Column:
        def score(values: Column) -> Column:
            total = _case(span["kind"], {k: F.lit(b) for k, b in self.bias.items()}, F.lit(0.0))
            for i, table in enumerate(self.odds):
                total = total + _case(values[i], {v: F.lit(o) for v, o in table.items()}, F.lit(0.0))
            return 1 / (1 + F.exp(-total))

        return _let(F.concat(votes(span), features(span)), score)


def train(spans: DataFrame) -> SpanClassifier:
    """Fit the classifier on all proposals (column ``span``); without any it accepts nothing."""
    voted = spans.select(F.col("span.kind").alias("kind"), votes(F.col("span")).alias("votes"), features(F.col("span")).alias("features"))
    counted = cut(voted.groupBy("kind", "votes", "features").count())
    found = counted.groupBy("kind", "votes").agg(F.sum("count").alias("n")).collect()  # at most kinds * 3 ** labelers
    post = estimate(sorted((r["kind"], tuple(r["votes"]), r["n"]) for r in found))
    if not post:
        return SpanClassifier(dict.fromkeys(KINDS, -10.0), [])
    rows = [(k, list(v), p) for (k, v), p in post.items()]
    table = F.broadcast(spans.sparkSession.createDataFrame(rows, "kind string, votes array<int>, p double"))
    each = counted.join(table, ["kind", "votes"]).select(
        "kind", "p", "count", F.posexplode(F.concat(F.array(F.lit(-1)), "votes", "features")).alias("at", "value")
    )
    sums = each.groupBy("kind", "at", "value").agg(F.sum(F.col("p") * F.col("count")).alias("t"), F.sum((1 - F.col("p")) * F.col("count")).alias("f")).collect()
    bias, odds, all_t, all_f = {}, [], 0.0, 0.0
    for r in sums:
        if r["at"] == 0:
            bias[r["kind"]] = math.log((r["t"] + 1) / (r["f"] + 1))
            all_t, all_f = all_t + r["t"], all_f + r["f"]
    width = max(r["at"] for r in sums)
    for at in range(1, width + 1):
        held: dict[int, list[float]] = {}
        for r in sums:
            if r["at"] == at:
                h = held.setdefault(r["value"], [0.0, 0.0])
                h[0], h[1] = h[0] + r["t"], h[1] + r["f"]
        n = len(held)
        odds.append({v: math.log((t + 1) / (all_t + n) * (all_f + n) / (f + 1)) for v, (t, f) in sorted(held.items())})
    return SpanClassifier(bias, odds)


def _all_proposals(text: Column) -> Column:
    has_digit = text.rlike("[0-9]")
    none = F.array().cast(f"array<{_SPAN}>")
    digit = F.when(has_digit, F.concat(*[proposals(text, k) for k in _DIGIT_KINDS])).otherwise(none)
    return F.concat(proposals(text, "email"), proposals(text, "name"), digit)


def _is_base(span: Column) -> Column:
    return _case(span["kind"], {k: valid_base(k, span["value"]) for k in BASE}, F.lit(False))


def _proposed(docs: DataFrame) -> DataFrame:
    """(doc_id, proposed): written once, as spans are needed for training and for the result."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return cut(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _all_proposals(text).alias("proposed")))


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per document.

    A null or empty text has no spans. Repeated rows are told again and null
    doc_ids stay null. An empty table gives no rows. Columns other than doc_id
    and text are ignored.
    """
    rows = _proposed(docs)
    model = train(rows.select(F.explode("proposed").alias("span")))
    rank = lambda s: _case(s["kind"], {k: F.lit(i) for i, k in enumerate(KINDS)}, F.lit(99))
    key = lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    base = F.array_sort(F.transform(F.filter("proposed", _is_base), key))
    added = F.transform(
        F.filter("proposed", lambda s: s["kind"].isin(*ADDED) & (model.probability(s) >= ACCEPT)), key
    )
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    out = rows.select("doc_id", base.alias("base"), added.alias("added"))
    counted = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    counts = [counted(k).alias(f"n_{k}") for k in BASE]
    return out.select(
        "doc_id",
        *counts,
        F.sha2(told(F.col("base")), 256).alias("base_sha256"),
        told(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced by its kind in brackets, kind after kind; n_chars follows the text.

    All rows and columns stay; a null text stays null.
    """
    model = train(_proposed(docs).select(F.explode("proposed").alias("span")))

    def one(text: Column, kind: str) -> Column:
        def ok(value: Column, left: Column, right: Column) -> Column:
            if kind in BASE:
                return valid_base(kind, value)
            span = F.struct(F.lit(kind).alias("kind"), value.alias("value"), left.alias("left"), right.alias("right"))
            return model.probability(span) >= ACCEPT

        def joined(parts: Column) -> Column:
            near = lambda i: ok(parts[i], F.right(parts[i - 1], F.lit(CONTEXT)), F.left(parts[i + 1], F.lit(CONTEXT // 2)))
            return F.array_join(F.transform(parts, lambda p, i: F.when((i % 2 == 1) & near(i), F.lit(f"[{kind.upper()}]")).otherwise(p)), "")

        return F.when(_guard(text, kind), _let(_parts(text, kind), joined)).otherwise(text)

    new = free_name(docs, "_text")
    out = docs.withColumn(new, F.col("text"))
    for kind in KINDS:
        out = out.withColumn(new, one(F.col(new), kind))
    changed = F.col(new) != F.col("text")
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(changed, F.char_length(new).cast(kind)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.when(changed, F.col(new)).otherwise(F.col("text"))).select(*docs.columns)
