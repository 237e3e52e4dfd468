"""Secret scans with multipart credential linking.

A credential often comes in parts: an access identifier, a secret and an
endpoint. Spans of the base kinds are told wherever they occur. Weak parts,
which alone say little, are told only where parts that complement each other
lie within one scope: a secret-looking string near an access identifier or an
endpoint with a login, a user name near a password, and so on.

A task finds the parts of each text. Parts are then joined by interval within
their scope: a scope is a stretch of text without a blank line, and two parts
meet if they lie within ``REACH`` characters. The join asks only for the
nearest complementary part on either side, by running maxima and minima over
the parts in order, so no pairs are made however many parts a scope holds.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("assign", "access", "hex", "secret", "user", "endpoint")
BASE = KINDS[:3]
REACH = 300
#: Bits of entropy per character from which a string looks like a secret.
ENTROPY = 3.5

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_HINT = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_BLANK = re.compile(r"\n[\x20\t\r]*\n")
# Weak parts.
_LOOKS_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])")
_USER = re.compile(r"(?<![A-Za-z0-9_])(?:user(?:name)?|login|client_id|account)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@+-]{3,})", re.IGNORECASE | re.ASCII)
_AFTER_SCHEME = re.compile(r"[^\s\"'<>]{4,}")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+")
_HOST_HEAD = re.compile(r"(?<![A-Za-z0-9:/.])(?:db|api|sql|mongo|redis|smtp|ftp|s3|auth)")
_HOST_REST = re.compile(r"[A-Za-z0-9.-]*+")
_HOST_END = re.compile(r"\.[a-z]{2,}")
_PORT = re.compile(r":[0-9]{2,}")
#: Parts that make a weak candidate of the left kind worth telling.
COMPLEMENTS = {
    "secret": ("access", "user", "endpoint"),
    "user": ("assign", "secret", "hex"),
    "endpoint": ("assign", "access", "secret", "hex"),
}


def entropy(s: str) -> float:
    """Bits per character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds by start, then kind as listed."""
    out = []
    if _ASSIGN_HINT.search(text):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def urls(text: str) -> Iterator[tuple[int, int]]:
    """Spans of URLs: a scheme of two or more characters that begins with a letter, ``://`` and what follows.

    The scheme is read backwards from its ``://``, so that the work stays linear.
    """
    upto, at = 0, text.find("://")
    while at >= 0:
        first, next_ = at, at + 3
        while first > upto and text[first - 1] in _SCHEME:
            first -= 1
        for a in range(first, at - 1):
            if "a" <= text[a] <= "z" and (a == 0 or not (text[a - 1].isascii() and text[a - 1].isalnum())):
                if rest := _AFTER_SCHEME.match(text, next_):
                    upto = next_ = rest.end()
                    yield a, upto
                break
        at = text.find("://", next_)


def hosts(text: str) -> Iterator[tuple[int, int]]:
    """Spans of host names that begin like a service, with their port; the last top-level part ends the name."""
    upto = 0
    for m in _HOST_HEAD.finditer(text):
        if m.start() < upto:
            continue
        upto = _HOST_REST.match(text, m.end()).end()
        end = 0
        for t in _HOST_END.finditer(text, m.end(), upto):
            end = t.end()
        if end:
            port = _PORT.match(text, end)
            yield m.start(), port.end() if port else end


def weak_parts(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak candidates of any length outside the base spans; none where nothing in the text could complement them."""
    found = [(m.start(), m.end(), "user") for m in _USER.finditer(text)]
    found += [(a, b, "endpoint") for a, b in hosts(text)]
    if "://" in text:
        found += [(a, b, "endpoint") for a, b in urls(text)]
    if not found and not base:
        return []
    found += [(m.start(), m.end(), "secret") for m in _LOOKS_SECRET.finditer(text) if entropy(m.group()) >= ENTROPY]
    out, i, covered = [], 0, 0
    for s in sorted(found):
        while i < len(base) and base[i][0] < s[1]:
            covered = max(covered, base[i][1])
            i += 1
        if covered <= s[0]:
            out.append(s)
    return out


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


_PARTS = "array<struct<scope:int,start:int,end:int,kind:string>>"


def find_parts(docs: DataFrame) -> DataFrame:
    """(row, doc_id, counts of the base kinds, base_sha256, parts) per document; weak parts only where any part is."""

    def run(batches):
        for batch in batches:
            counts, digests, parts = [], [], []
            for text in batch.pop("_text"):
                base = base_spans(text)
                counts.append(Counter(k for _, _, k in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                every = sorted(base + weak_parts(text, base))
                scopes = []
                if every:
                    breaks = [m.start() for m in _BLANK.finditer(text)]
                    at = 0
                    for a, b, k in every:
                        while at < len(breaks) and breaks[at] < a:
                            at += 1
                        scopes.append({"scope": at, "start": a, "end": b, "kind": k})
                parts.append(scopes)
            yield batch.assign(**{f"n_{k}": [c[k] for c in counts] for k in BASE}, base_sha256=digests, parts=parts)

    # The row's place tells repeated rows apart; it is the same whenever a lost task is run again.
    given = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text")
    )
    return given.mapInPandas(run, f"row bigint, doc_id bigint, {', '.join(f'n_{k} bigint' for k in BASE)}, base_sha256 string, parts {_PARTS}")


def link(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """``parts`` (row, scope, start, end, kind, ...) with ``linked``: whether a complementary part lies within reach.

    For each kind the end of the last such part before and the start of the
    next one after are carried along the scope.
    """
    before = Window.partitionBy("row", "scope").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row", "scope").orderBy("start", "end", "kind").rowsBetween(1, Window.unboundedFollowing)
    needed = sorted({k for ks in COMPLEMENTS.values() for k in ks})
    for k in needed:
        of = F.col("kind") == k
        parts = parts.withColumn(f"_last_{k}", F.max(F.when(of, F.col("end"))).over(before)).withColumn(f"_next_{k}", F.min(F.when(of, F.col("start"))).over(after))
    linked = F.lit(False)
    for weak, others in COMPLEMENTS.items():
        near = F.lit(False)
        for k in others:
            close = (F.col("start") - F.col(f"_last_{k}") <= reach) | (F.col(f"_next_{k}") - F.col("end") <= reach)
            near = near | F.coalesce(close, F.lit(False))
        linked = linked | ((F.col("kind") == weak) & near)
    return parts.withColumn("linked", linked).drop(*[f"_{side}_{k}" for k in needed for side in ("last", "next")])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), one row per document.

    A null or empty text has no spans. Repeated rows are told again and null
    doc_ids stay null; an empty table gives no rows. Columns other than doc_id
    and text are ignored.
    """
    given = ["row", "doc_id", *[f"n_{k}" for k in BASE], "base_sha256"]
    each = find_parts(docs).select(*given, F.explode_outer("parts").alias("p")).select(*given, "p.*")
    # A text without parts has one row of nulls; collect_list leaves nulls out.
    kept = link(each).withColumn(
        "span", F.when(F.col("linked") | F.col("kind").isin(*BASE), F.struct("start", _rank().alias("rank"), "end", "kind"))
    )
    spans = F.transform(
        F.array_sort(F.collect_list("span")), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    )
    return kept.groupBy(*given).agg(F.array_join(spans, ",").alias("spans")).drop("row")


def _rank():
    out = F.lit(len(KINDS))
    for i, k in enumerate(KINDS):
        out = F.when(F.col("kind") == k, i).otherwise(out)
    return out
