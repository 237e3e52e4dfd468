"""HTML extraction by templates deduced from equivalence classes.

Pages of one host are made from a template. A token of the template occurs in
every page the same number of times; tokens with the same occurrence vector
over the pages form an equivalence class. Tokens here are the containers of a
page with their path, and whole blocks of text with the path they stand in.

The vectors are never built: a token's count times a hash of the page, summed
over pages, stands for its vector, and adds up in any order on any number of
executors. Classes that occur in most pages of a host are its template.
Containers of valid classes, nested as their paths are, are its frame. A
container whose text is nearly all made of blocks that are themselves of the
template says the same on every page and is closed, whatever its class names;
so is one of mostly linked text outside an article. The other containers of the
frame are its slots: their blocks stay, repeated headings too, but for blocks
of the template that come last in a slot which is not named as the article's. Text in
containers that only some pages have goes by the innermost container of the
frame around it. Where the frame has containers named as the article's, only
the outermost of these are read.
"""

from __future__ import annotations

import html as html_lib
import re
import sys
from collections import defaultdict
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Share of a host's pages in which a class must occur to be of the template.
SUPPORT = 0.5
#: Different pages of a host from which on classes mean anything.
LEAST_PAGES = 4
#: Share of a container's text in blocks of the template from which on it is closed.
CONSTANT = 0.9
#: Tokens of a valid class.
LEAST_TOKENS = 2

# Possessive throughout: quotes that never close must not make the matcher try every way to pair them.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|object|textarea|title)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+'|[\"'])*+)>"
    r"|<[!?][^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
# Elements of HTML by their use.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset(
    "html head body div section article main nav header footer aside form ul ol dl table fieldset figure details dialog menu select button center".split()
)
BOILERPLATE = frozenset("head nav footer aside form menu select button dialog fieldset".split())
#: Words of class and id names that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement adbox banner sponsor sponsored promo promotion sidebar side widget menu nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead topbar header cookie cookies consent notice notices notification alert popup modal overlay comment comments reply replies disqus "
    "respond share sharing social related recommended newsletter subscribe signup login search pagination pager toolbar skip copyright".split()
)
_NAME = re.compile(r"[A-Za-z]+")
#: End of the path of a container that is named as the article's, in Python and in Spark.
NAMED = r"/(article|main)(\.[^/]*)?$|\.main(\.[^/]*)?$"
#: A path below such a container, and that of a whole page.
BELOW_NAMED = r"/(article|main)(\.[^/]*)?/|\.main(\.[^/]*)?/"
WHOLE = r"^(/html[^/]*)?(/body[^/]*)?$"


def _container(tag: str, rest: str, inside: bool) -> tuple[str, bool, bool]:
    """(name of a container in a path, whether it is boilerplate by its tag or names, whether it is an article or the main part).

    ``inside`` of these a class or id marks only as a whole: an article-header is the article's own.
    """
    names, out, own = [], tag in BOILERPLATE, tag in ("article", "main")
    for m in _ATTRIBUTE.finditer(rest):
        key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if key == "role":
            out |= value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert")
            names += ["main"] if value.lower() == "main" else []
            own |= value.lower() == "main"
        elif key in ("hidden", "aria-hidden"):
            out |= key == "hidden" or value.lower() == "true"
        else:
            names.append(value)
            out |= any(w.lower() in MARKS for w in (value.split() if inside else _NAME.findall(value)))
    return f"{tag}.{'.'.join(names)}" if names else tag, out, own


def blocks(page: str):
    """(containers opened, blocks) of a page.

    A container is (path, boilerplate). A block is (path, boilerplate, text,
    linked characters): the text between two block-level tags, its character
    references decoded and its white space made single spaces.
    """
    stack: list[tuple[str, str, bool, bool]] = []  # tag, path, boilerplate, inside of an article or the main part
    opened: list[tuple[str, bool]] = []
    out: list[tuple[str, bool, str, int]] = []
    held: list[str] = []
    linked = depth_a = 0

    def flush():
        nonlocal linked
        if held:
            text = " ".join(html_lib.unescape("".join(held)).split())
            if text:
                path, bad = (stack[-1][1], stack[-1][2]) if stack else ("", False)
                out.append((path, bad, text, linked))
            held.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        text = m.group("text")
        if text is not None:
            held.append(text)
            if depth_a:
                linked += len(text)
            continue
        tag = m.group("tag")
        if tag is None:
            if m.group("raw"):
                flush()
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                depth_a = 0 if m.group("end") else 1
            continue
        flush()
        if tag not in CONTAINERS or tag in VOID:
            continue
        if m.group("end"):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            depth_a = 0
        else:
            above, above_bad, inside = stack[-1][1:] if stack else ("", False, False)
            name, bad, own = _container(tag, m.group("rest"), inside)
            # A header inside of the article is the article's own.
            bad |= tag == "header" and "/article" not in above and "/main" not in above
            if tag in ("article", "main") or ".main" in name:
                bad = False
            path = f"{above}/{name}"
            stack.append((tag, path, bad or above_bad, inside or own))
            opened.append((path, bad or above_bad))
    flush()
    return opened, out


def below(opened: list[tuple[str, bool]], found: list[tuple[str, bool, str, int]]) -> dict[str, list[int]]:
    """[characters, linked ones] of all text below each container that is named as the article's, boilerplate left out."""
    named = {path for path, bad in opened if not bad and re.search(NAMED, path)}
    out = {path: [0, 0] for path in named}
    direct: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    if named:
        for path, bad, block, linked in found:
            if not bad:
                direct[path][0] += len(block)
                direct[path][1] += min(linked, len(block))
    for path, (chars, linked) in direct.items():
        for i in [*(m.start() for m in re.finditer("/", path)), len(path)]:
            if path[:i] in named:
                out[path[:i]][0] += chars
                out[path[:i]][1] += linked
    return out


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts)) - (1 << 63)


TOKENS = "host string, token bigint, kind int, path string, home bigint, pages bigint, occurrences bigint, vector bigint, chars bigint, linked bigint"
_MOD = (1 << 61) - 1


def host_of(url):
    """Host of a URL in lower case without user and port; the whole string where there is none."""
    h = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.when(h != "", h).otherwise(F.coalesce(F.lower(url), F.lit("")))


def page_tokens(pages: DataFrame) -> DataFrame:
    """Per host and token, sums over the pages of a batch: kind 0 is the page itself, 1 a container, 2 a block.

    ``home`` is the token of the container that a block stands in.
    """

    def run(batches):
        for batch in batches:
            held: dict[tuple[str, int], list] = {}

            def add(host, token, kind, path, home, count, page, chars, linked):
                h = held.setdefault((host, token), [kind, path, home, 0, 0, 0, 0, 0])
                h[3] += 1
                h[4] += count
                h[5] = (h[5] + count * page) % _MOD
                h[6] += chars
                h[7] += linked

            for host, text in zip(batch["host"], batch["html"], strict=True):
                page = _hash(text) % _MOD
                opened, found = blocks(text)
                add(host, 0, 0, "", 0, 1, page, 0, 0)
                counts: dict[tuple[int, str, str], list[int]] = defaultdict(lambda: [0, 0, 0])
                for path, bad in opened:
                    counts[1, path, "!" if bad else ""][0] += 1
                for path, bad, block, linked in found:
                    block_counts = counts[2, path, block]
                    block_counts[0] += 1
                    block_counts[1] += len(block)
                    own = counts[1, path, "!" if bad else ""]
                    own[1] += len(block)
                    own[2] += min(linked, len(block))
                for path, sums in below(opened, found).items():
                    counts[1, path, ""][1:] = sums
                for (kind, path, what), (n, chars, linked) in counts.items():
                    home = 0 if kind == 1 else _hash("1", path, "")
                    add(host, _hash(str(kind), path, what), kind, path + what if kind == 1 else "", home, n, page, chars, linked)
            yield pd.DataFrame([(h, t, *v) for (h, t), v in held.items()], columns=["host", "token", "kind", "path", "home", "pages", "occurrences", "vector", "chars", "linked"])

    return pages.mapInPandas(run, TOKENS)


def different_pages(pages: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """(host, html): one of each set of equal pages of a host.

    Only pages that have copies are dealt out, and of these one per task, unless there are too many to be told by a broadcast.
    """
    keyed = pages.select("host", "html", F.xxhash64("host", "html").alias("page"))
    copied = cut(keyed.groupBy("page").count().filter("count > 1").select("page"))
    one = lambda df: df.groupBy("page").agg(F.first("host").alias("host"), F.first("html").alias("html")).select("host", "html")
    if copied.count() * 24 > limit:
        return one(keyed)
    few = F.broadcast(copied)
    return keyed.join(few, "page", "left_anti").select("host", "html").union(one(keyed.join(few, "page", "left_semi")))


def templates(pages: DataFrame) -> DataFrame:
    """(host, named, closed, open, boilerplate) per host with enough different pages.

    named: paths of the frame's containers that are named as the article's.
    closed, open: tokens of its containers that are left out, and of the others.
    boilerplate: tokens of the blocks of the template.

    Copies of a page are no evidence of a template, so equal pages count once.

    Only tokens of most of a host's pages are gathered, no more than a few
    times those of a page.
    """
    vector = F.pmod(F.sum(F.col("vector").cast("decimal(38,0)")), F.lit(_MOD).cast("decimal(38,0)")).cast("bigint")
    sums = page_tokens(different_pages(pages)).groupBy("host", "token", "kind", "path", "home").agg(
        F.sum("pages").alias("pages"), F.sum("occurrences").alias("occurrences"), vector.alias("vector"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")
    )
    sums = cut(sums.filter((F.col("pages") >= LEAST_PAGES) | (F.col("kind") == 0)))
    hosts = sums.filter("kind = 0").select("host", F.col("pages").alias("host_pages")).filter(F.col("host_pages") >= LEAST_PAGES)
    frequent = sums.filter("kind <> 0").join(hosts, "host").filter(F.col("pages") >= F.col("host_pages") * SUPPORT)
    # A class: the tokens of a host with one occurrence vector.
    classes = frequent.groupBy("host", "pages", "occurrences", "vector").agg(
        F.count("*").alias("tokens"), F.collect_list(F.struct("token", "kind", "path", "chars", "linked")).alias("members")
    )
    members = classes.filter(F.col("tokens") >= LEAST_TOKENS).select("host", F.explode("members").alias("m")).select("host", "m.*")
    constant = frequent.filter("kind = 2").groupBy("host", F.col("home").alias("token")).agg(F.sum("chars").alias("constant"))
    members = members.join(constant, ["host", "token"], "left")
    frame = (F.col("kind") == 1) & ~F.col("path").endswith("!")
    named = frame & F.col("path").rlike(NAMED)
    linked = (F.col("chars") <= 2 * F.col("linked")) & ~F.col("path").rlike(BELOW_NAMED)
    says_nothing = (F.col("constant") >= CONSTANT * F.col("chars")) | linked
    closed = frame & ~named & ~F.col("path").rlike(WHOLE) & (F.col("chars") > 0) & F.coalesce(says_nothing, F.lit(False))
    held = lambda test, name: F.collect_list(F.when(test, F.col(name)))
    return members.groupBy("host").agg(
        held(named & (F.col("chars") > 2 * F.col("linked")), "path").alias("named"),
        held(closed, "token").alias("closed"),
        held(frame & ~closed, "token").alias("open"),
        held(F.col("kind") == 2, "token").alias("boilerplate"),
    )


def outermost(paths) -> list[str]:
    """``paths`` without those below another one."""
    out: list[str] = []
    for path in sorted(set(paths), key=len):
        if not any(path.startswith(o + "/") for o in out):
            out.append(path)
    return out


class Template(NamedTuple):
    """The template of a host, as told by ``templates``."""

    named: frozenset = frozenset()
    closed: frozenset = frozenset()
    open: frozenset = frozenset()
    boilerplate: frozenset = frozenset()


def article(page: str, template: Template = Template()) -> str:
    """Text of the template's slots; without a template, of the page's own articles, main part or body."""
    opened, found = blocks(page)
    good = [path for path, bad in opened if not bad]
    articles = [path for path in good if re.search(r"/article(\.[^/]*)?$", path)]
    mains = [path for path in good if re.search(r"/main(\.[^/]*)?$", path)]
    known = [path for path in good if path in template.named]
    roots = outermost(known + articles if known else articles or mains)
    shut: dict[str, bool] = {}

    def is_shut(path: str) -> bool:
        """Whether the innermost container of the frame around a block is closed."""
        if path not in shut:
            token = _hash("1", path, "")
            above = path.rpartition("/")[0]
            shut[path] = token in template.closed or (token not in template.open and bool(above) and is_shut(above))
        return shut[path]

    out: list[tuple[str, str]] = []
    for path, bad, text, _ in found:
        if bad or roots and not any(path == r or path.startswith(r + "/") for r in roots):
            continue
        if template.closed and is_shut(path):
            continue
        # Text that stands in no container of its own goes where the template has it.
        if template.boilerplate and not roots and re.search(WHOLE, path) and _hash("2", path, text) in template.boilerplate:
            continue
        out.append((path, text))
    if not template.boilerplate or roots:
        return " ".join(text for _, text in out)
    # Blocks of the template after the last text of a slot's own end the frame; before it they are headings.
    last = {path: i for i, (path, text) in enumerate(out) if _hash("2", path, text) not in template.boilerplate}
    return " ".join(text for i, (path, text) in enumerate(out) if i <= last.get(path, i))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per page.

    A null or empty page has the empty text; a null url is a host of its own.
    Hosts with fewer than LEAST_PAGES different pages have no template and are read by
    their tags alone. Repeated rows are told again; an empty table gives no
    rows. Columns other than page_id, url and html are ignored.
    """
    given = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    made = cut(templates(given.select("host", "html")))
    tokens = F.size("closed") + F.size("open") + F.size("boilerplate")
    size = made.agg(F.coalesce(F.sum(tokens * 8 + F.length(F.array_join("named", " ")) + 200), F.lit(0))).first()[0]
    joined = given.join(F.broadcast(made) if size <= 32 << 20 else made, "host", "left")
    parts = ["named", "closed", "open", "boilerplate"]

    def run(batches):
        for batch in batches:
            known: dict[str, Template] = {}
            texts = []
            for host, page, *template in zip(batch["host"], batch["html"], *(batch[p] for p in parts), strict=True):
                if host not in known:
                    known[host] = Template(*(frozenset(t.tolist() if hasattr(t, "tolist") else t or ()) for t in template))
                texts.append(article(page, known[host]))
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts})

    id_type = dict(pages.dtypes)["page_id"]
    out = joined.select("page_id", "url", "host", "html", *parts).mapInPandas(run, f"page_id {id_type}, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))
