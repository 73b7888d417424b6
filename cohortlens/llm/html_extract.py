"""Main text of web pages by equivalence-class template deduction (operator 7).

Tokens are the opening and closing tags of structural elements, told apart by
their path and class.  Over the pages of a host each token has an occurrence
vector (how often it occurs on each page); tokens with equal vectors form an
equivalence class.  Vectors are never built: each page adds a hash of itself
and the count to the token's signature, so classes come from one
pre-aggregated group-by, however many pages a host has.  Classes that hold two
tokens or more, on most pages, nest by their paths into the host's template;
the template's elements are its slots.  Hosts with few pages use the classes
of all pages together.

A host's slots are then judged once, by where they lie (navigation, header,
footer, sidebar, notice, advert, form, reader comments), by their share of
link text and by whether their text ever changes.  Pages are read again and
the text of the remaining slots is extracted, whole; what lies outside any
slot follows the nearest slot around it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Elements that make the paths of slots.
STRUCTURE = frozenset("html head body header nav main article section aside footer div ul ol table form fieldset figure "
                      "dl details dialog noscript template svg iframe button select title object".split())
#: Elements whose text is never main text.
NEVER = frozenset("head nav aside footer form fieldset noscript template svg iframe button select title object "
                  "dialog".split())
BLOCKS = STRUCTURE | frozenset("p h1 h2 h3 h4 h5 h6 li tr blockquote pre dt dd figcaption address hr br caption "
                               "center summary".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class and id names that mark what is not main text.
OUTSIDE = re.compile(r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|menu\w*|nav\w*|breadcrumbs?|header|masthead|footer|"
                     r"cookies?|consent|notices?|alerts?|popup|modal|newsletter|subscribe|login|signup|search|share|sharing|social|"
                     r"related|recommended|comments?|replies|reply|disqus|widget|toolbar|copyright)", re.IGNORECASE)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"""
                   r"""|<(/?)([a-zA-Z][\w:-]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)/?>|<(/?)([a-zA-Z][\w:-]*)[^<>]*>""",
                   re.DOTALL | re.IGNORECASE)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
LEAST_PAGES = 3
SUPPORT = 0.5
#: Broadcast bound for the table of slots.
BROADCAST_HOSTS = 20_000


def host_of(url: Column) -> Column:
    """The lower-case host of a url; empty where it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^\w+://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _marks(attributes: str) -> tuple[str, bool]:
    """The class names of a tag, and whether they or its role or visibility
    say that it is not main text."""
    names, outside = [], False
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), values[0] or values[1] or values[2]
        if key in ("class", "id"):
            words = re.split(r"[\s_-]+", value)
            names += value.split() if key == "class" else []
            outside |= any(OUTSIDE.fullmatch(w) for w in words)
        elif key == "role":
            outside |= value.lower() in ROLES
        else:
            outside |= key == "hidden" or value.lower() == "true"
    return ".".join(sorted(names)), outside


def events(html: str) -> Iterator[tuple]:
    """``("open", path, outside)``, ``("close", path)`` of structural
    elements, ``("break",)`` at block borders and ``("text", path, text,
    in link, outside)`` in page order.  Unclosed elements end with the element
    around them."""
    stack: list[tuple[str, str, bool]] = []  # name, path, outside
    at, link = 0, False
    for found in TOKEN.finditer(html):
        if found.start() > at:
            top = stack[-1] if stack else ("", "", False)
            yield "text", top[1], html[at:found.start()], link, top[2]
        at = found.end()
        name = (found[3] or found[6] or "").lower()
        if not name:
            continue
        closing = bool(found[2] or found[5])
        if name in BLOCKS:
            yield ("break",)
        elif name in ("td", "th"):
            yield "text", "", " ", False, True
        if name == "a":
            link = not closing
        if closing:
            if any(s[0] == name for s in stack):
                while True:
                    top = stack.pop()
                    if top[0] in STRUCTURE:
                        yield "close", top[1]
                    if top[0] == name:
                        break
            continue
        if name in VOID:
            continue
        marks, outside = _marks(found[4]) if found[4] else ("", False)
        if name in BLOCKS and stack and stack[-1][0] == "p":
            stack.pop()
        if name in STRUCTURE or outside:
            path, hidden = (stack[-1][1], stack[-1][2]) if stack else ("", False)
            inside = "/article" in path or "/main" in path
            hidden = hidden or outside or name in NEVER or (name == "header" and not inside)
            path = f"{path}/{name}" + (f".{marks}" if marks else "") if name in STRUCTURE else path
            stack.append((name, path, hidden))
            if name in STRUCTURE:
                yield "open", path, hidden
    if at < len(html):
        top = stack[-1] if stack else ("", "", False)
        yield "text", top[1], html[at:].partition("<")[0] if re.match(r"[^<]*</?[a-zA-Z!?][^>]*\Z", html[at:]) else html[at:], link, top[2]


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


_SUMS = pa.schema([("host", pa.string()), ("token", pa.string()), ("pages", pa.int64()), ("signature", pa.int64()),
                   ("words", pa.int64()), ("linked", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("outside", pa.bool_())])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up, per batch, each token's pages and signature, and each slot's
    words, words in links and least and greatest hash of its text."""
    wrap = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    for batch in batches:
        sums: dict[tuple[str, str], list] = {}
        for page, url, at, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "host", "html"))):
            count: dict[str, int] = {}
            slot: dict[str, list] = {}
            for event in events(html or ""):
                if event[0] == "open":
                    count["+" + event[1]] = count.get("+" + event[1], 0) + 1
                    slot.setdefault(event[1], [0, 0, [], event[2]])
                elif event[0] == "close":
                    count["-" + event[1]] = count.get("-" + event[1], 0) + 1
                elif event[0] == "text" and event[1]:
                    words = event[2].split()
                    held = slot.setdefault(event[1], [0, 0, [], event[4]])
                    held[0] += len(words)
                    held[1] += len(words) if event[3] else 0
                    held[2] += words
            for host in (at, "*"):
                for token, n in [*count.items(), ("", 1)]:
                    held = sums.setdefault((host, token), [0, 0, 0, 0, 1 << 63, -(1 << 63), False])
                    held[0] += 1
                    held[1] = wrap(held[1] + _hash(page, url, n))
                    if token[:1] == "+":
                        words, linked, text, outside = slot[token[1:]]
                        own = _hash(*text)
                        held[2] += words
                        held[3] += linked
                        held[4], held[5], held[6] = min(held[4], own), max(held[5], own), held[6] or outside
        rows = [(*k, *v[:4], min(v[4], (1 << 63) - 1), v[5], v[6]) for k, v in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SUMS)], schema=_SUMS)


def _rows(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))


def deduce_templates(pages: DataFrame) -> DataFrame:
    """``host, keep, drop``: the paths of each host's slots that hold main
    text, and of those that do not; host ``*`` stands for all pages."""
    found = _rows(pages).mapInArrow(_occurrences, "host string, token string, pages long, signature long, words long, linked long, "
                            "low long, high long, outside boolean")
    # sums of hashes wrap around by themselves only outside ANSI mode: exact sums, then modulo
    tokens = staged(found.groupBy("host", "token").agg(
        F.sum("pages").alias("pages"), F.sum(F.col("signature").cast("decimal(38,0)")).alias("signature"),
        F.sum("words").alias("words"), F.sum("linked").alias("linked"), F.min("low").alias("low"),
        F.max("high").alias("high"), F.max("outside").alias("outside")), "tokens")
    totals = tokens.where("token = ''").select("host", F.col("pages").alias("total"))
    frequent = tokens.where("token <> ''").join(totals, "host").where(
        ((F.col("total") >= LEAST_PAGES) | (F.col("host") == "*")) & (F.col("pages") >= SUPPORT * F.col("total")))
    classes = frequent.groupBy("host", "signature").agg(F.count("*").alias("size")).where("size >= 2")
    path = F.expr("substring(token, 2)")
    valid = frequent.where("token LIKE '+%'").join(classes, ["host", "signature"]).select("host", path.alias("path"), "words", "linked",
                                                                                         "pages", "low", "high", "outside")
    named = F.col("path").rlike("/(article|main)(\\.|/|$)")
    bad = F.col("outside") | (~named & ((2 * F.col("linked") > F.col("words"))
                                        | ((F.col("pages") > 2) & (F.col("low") == F.col("high")) & (F.col("words") > 0))))
    slots = valid.select("host", "path", bad.alias("bad"), (named & ~F.col("outside")).alias("named"))
    best = slots.groupBy("host").agg(F.max("named").alias("has_main"))
    # where a host's template has an article or main element, other slots are beside it
    judged = slots.join(best, "host").select("host", "path", (F.col("bad") | (F.col("has_main") & ~F.col("named"))).alias("bad"))
    return judged.groupBy("host").agg(F.collect_set(F.when(~F.col("bad"), F.col("path"))).alias("keep"),
                                      F.collect_set(F.when(F.col("bad"), F.col("path"))).alias("drop"))


def main_text(html: str, keep: frozenset[str], drop: frozenset[str]) -> str:
    """The text of the kept slots, one line a block.  A page that has none of
    its host's slots is judged by its own elements."""
    known: dict[str, bool] = {}

    def kept(path: str) -> bool:
        if path not in known:
            near = path
            while near and near not in keep and near not in drop:
                near = near.rpartition("/")[0]
            known[path] = near in keep if near else bool(re.search(r"/(article|main)(\.|/|$)", path)) or not keep
        return known[path]

    blocks, now = [], []
    for event in events(html):
        if event[0] == "break":
            blocks.append("".join(now))
            now = []
        elif event[0] == "text":
            if not event[1]:
                if event[4]:  # a cell border
                    now.append(event[2])
                elif not keep:
                    now.append(unescape(event[2]))
            elif not event[4] and kept(event[1]):
                now.append(unescape(event[2]))
    blocks.append("".join(now))
    text = "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)
    return main_text(html, frozenset(), frozenset()) if not text and keep else text


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``.

    NULL and empty html give an empty text; a NULL or odd url counts as a host
    of its own.  Text of a slot is whole: nothing repeated or common is
    dropped from it.  Repeated rows give equal texts; an empty table gives an
    empty result.
    """
    templates = staged(deduce_templates(pages), "templates")
    shared = templates.where("host = '*'").first()
    common = (frozenset(shared["keep"]), frozenset(shared["drop"])) if shared else (frozenset(), frozenset())

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, tuple] = {}
        for batch in batches:
            texts = []
            for html, name, keep, drop in zip(*(batch.column(c).to_pylist() for c in ("html", "host", "keep", "drop"))):
                if len(sets) > 1000:
                    sets.clear()
                if name not in sets:
                    sets[name] = (frozenset(keep), frozenset(drop)) if keep or drop else common
                texts.append(main_text(html or "", *sets[name]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    hosts = templates.where("host <> '*'")
    hosts = F.broadcast(hosts) if templates.count() <= BROADCAST_HOSTS else hosts
    return _rows(pages).join(hosts, "host", "left").select("page_id", "url", "host", "html", "keep", "drop") \
        .mapInArrow(extract, "page_id long, url string, text string, n_chars long")
