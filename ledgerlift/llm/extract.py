"""Main text of web pages, with a suffix array of each host against boilerplate.

Parsing keeps a stack of open elements, with the ends that HTML lets authors leave out (p, li, dt, dd, tr, td, th,
option, and whatever an enclosing element's end closes).  It drops what the markup itself calls no article: head,
scripts, styles, navigation, headers, footers, asides, forms, hidden parts, and parts whose class, id or role
names adverts, menus, sidebars, notices, sharing, related links or comments.  Of a class name the whole or
its last part counts, or its first before a part that names a container (``sidebar-left``); ``no-``, ``has-`` and
``with-`` take the meaning away, and inside ``pre`` and ``code`` classes tell colours.  The rest becomes blocks: character
references decoded, white space one space, blocks without text left out.  A page with ``article`` or ``main``
elements keeps only their blocks.

What markup doesn't tell, repetition does.  The first ``RUN`` tokens of every suffix of a page's token stream are
hashed with the host and dealt out, so suffixes with a common prefix that long meet, whatever task their pages came
from.  The order of suffixes beyond these tokens isn't computed: what is covered depends on these prefixes
alone.  In pages without an article element, tokens covered by such strings of two or more different pages are
removed and unique runs kept; a short block goes if it repeats whole.  Inside an article only a whole block that stands on at least
half of the host's pages (and on ``SITEWIDE``) goes, so articles that quote or copy each other stay whole.  A
page that would lose everything is a copy and keeps what isn't sitewide.

Pages with equal blocks count once.  A host is never gathered: its suffixes are spread over all bins, and
of a page's strings only those that repeat come back to it.

Defined cases: null and empty html and pages without text give an empty text; a null url is a host of its
own; repeated rows give equal results; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlift.llm import bins
from ledgerlift.llm.common import maybe, small_batches, stage_packed, texts
from ledgerlift.session import stage

#: Tokens of a long repeated string; pages that a sitewide block stands on at least.
RUN, SITEWIDE = 8, 5

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "object", "canvas", "video", "audio", "select"))
_DROPPED = frozenset(("head", "nav", "footer", "aside", "form", "button", "dialog", "menu", "header"))
_VOID = frozenset(("br", "hr", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track", "param"))
_BLOCK = frozenset((
    "html", "body", "p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "caption", "thead", "tbody", "tfoot", "blockquote", "pre",
    "section", "article", "main", "header", "footer", "nav", "aside", "figure", "figcaption", "address", "hr", "form", "fieldset", "details", "summary", "center", "hgroup",
))
_ARTICLE, _CODE = frozenset(("article", "main")), frozenset(("pre", "code"))
_NAMES = frozenset((
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation",
    "menu", "submenu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "popup",
    "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "comment", "comments", "reply",
    "replies", "respond", "disqus", "widget", "toolbar", "pagination", "pager", "copyright", "disclaimer", "hidden", "alert",
))
_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "tooltip"))
#: Parts of a class name that say only what its first part is held in.
_CONTAINERS = frozenset((
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "column", "container", "content", "form", "group", "header", "icon", "icons", "inner", "item", "items", "label",
    "left", "link", "links", "list", "main", "panel", "post", "posts", "right", "row", "section", "side", "slot", "text", "title", "top", "unit", "wrap", "wrapper", "zone",
))
_NEGATIONS = frozenset(("no", "not", "has", "with", "without"))
#: Start tags that end an open element of the first kind, unless one of the last kind was opened since.
_LISTS, _TABLES = frozenset(("ul", "ol", "menu", "dl")), frozenset(("table",))
_IMPLIED = {
    "li": (frozenset(("li",)), _LISTS), "dt": (frozenset(("dt", "dd")), _LISTS), "dd": (frozenset(("dt", "dd")), _LISTS), "option": (frozenset(("option",)), frozenset()),
    "tr": (frozenset(("tr", "td", "th")), _TABLES), "td": (frozenset(("td", "th")), _TABLES | {"tr"}), "th": (frozenset(("td", "th")), _TABLES | {"tr"}),
    "tbody": (frozenset(("tr", "td", "th", "thead", "tbody", "tfoot")), _TABLES), "body": (frozenset(("head",)), frozenset()),
}
#: What a block's start ends besides, and what an end tag doesn't reach out of.
_ENDS_P = frozenset(("p",))
_SCOPES = {"p": frozenset(("article", "main", "section", "div", "td", "th", "li", "blockquote", "table", "button")), "li": _LISTS, "td": _TABLES, "th": _TABLES, "tr": _TABLES}
_TALK = frozenset(("comment", "comments", "reply", "replies", "respond", "disqus"))


def _unwanted(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _DROPPED and not (tag == "header" and in_article):
        return True
    if not attributes.strip():
        return False
    found = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), "".join(values).lower())
    names = _meanings(" ".join((found.get("class", ""), found.get("id", ""))))
    if tag in _ARTICLE or tag in ("html", "body"):
        return tag == "article" and bool(names & _TALK)
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    return hidden or bool(names & _NAMES) or (not in_article and "header" in names) or found.get("role") in _ROLES


def _meanings(names: str) -> set[str]:
    """What class names say of an element, as words."""
    out = set()
    for name in names.split():
        parts = [p for p in re.split(r"[^a-z0-9]+", name) if p]
        if not parts or parts[0] in _NEGATIONS:
            continue
        out.add(parts[-1])
        if all(p in _CONTAINERS or p.isdigit() for p in parts[1:]):
            out.add(parts[0])
    return out


def blocks(source: str | None) -> list[tuple[str, bool]]:
    """(text, whether inside an article or main element) of each block, in page order."""
    out: list[tuple[str, bool]] = []
    if not source:
        return out
    held: list[str] = []
    at = article = dropped = code = 0
    seen_article = False
    stack: list[tuple[str, bool]] = []  # open elements, and whether each is left out

    def close() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((text, article > 0))

    def leave(n: int) -> None:
        """Close the innermost elements until ``n`` are open."""
        nonlocal article, dropped, code
        while len(stack) > n:
            tag, left_out = stack[-1]
            if tag in _BLOCK or left_out:
                close()
            stack.pop()
            dropped -= left_out
            article -= tag in _ARTICLE and not dropped and not left_out
            code -= tag in _CODE

    def innermost(tags: frozenset[str], scope: frozenset[str]) -> int | None:
        """Where the innermost of such elements stands, if none of ``scope`` is opened inside it."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                return k
            if stack[k][0] in scope:
                return None
        return None

    while m := _TAG.search(source, at):
        if not dropped and m.start() > at:
            held.append(source[at:m.start()])
        at = m.end()
        end, tag, attributes = m[1], (m[2] or "").lower(), m[3] or ""
        if not tag:
            continue
        if tag in _RAW:
            if not end and not attributes.endswith("/"):
                closing = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(source, at)
                at = closing.end() if closing else len(source)
            continue
        if end:
            k = innermost(frozenset((tag,)), _SCOPES.get(tag, frozenset()))
            if k is not None:
                leave(k)
            if tag in _BLOCK and not dropped:
                close()
            continue
        if tag in _VOID:
            if not dropped:
                if tag in _BLOCK:
                    close()
                elif tag == "br":
                    held.append(" ")
            continue
        if tag in _BLOCK:
            k = innermost(_ENDS_P, _SCOPES["p"])
            if k is not None:
                leave(k)
        if tag in _IMPLIED:
            ended, scope = _IMPLIED[tag]
            while (k := innermost(ended, scope)) is not None:
                leave(k)
        if tag in _ARTICLE and dropped and not seen_article and not _unwanted(tag, attributes, False):
            # the first article inside what is left out: what should have been closed before
            k = next(j for j, (_, left_out) in enumerate(stack) if left_out)
            if stack[k][0] in ("div", "span", "header", "nav", "head"):
                leave(k)
        if attributes.endswith("/"):
            continue
        left_out = not dropped and _unwanted(tag, "" if code else attributes, article > 0)
        if not dropped:
            if tag in _BLOCK or left_out:
                close()
            elif tag in ("td", "th"):
                held.append(" ")
        if tag in _ARTICLE and not dropped and not left_out:
            article += 1
            seen_article = True
        dropped += left_out
        code += tag in _CODE
        stack.append((tag, left_out))
    if not dropped:
        held.append(source[at:])
    close()
    return out


def _tokens(parts: list[str]) -> list[tuple[int, str]]:
    """(block, token) of a stream of blocks."""
    return [(k, t) for k, p in enumerate(parts) for t in p.split()]


def _key(host: str, words: Iterable[str], kind: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join((kind, host, *words)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


def suffixes(host: str, parts: list[str], in_article: bool) -> list[int]:
    """Keys of a page's suffixes, cut to their first ``RUN`` tokens; of whole blocks where these are judged."""
    if in_article:
        return [_key(host, (p,), "block") for p in parts]
    words = [t for _, t in _tokens(parts)]
    return [_key(host, words[k:k + RUN], "run") for k in range(len(words) - RUN + 1)] + [_key(host, (p,), "block") for p in parts]


def unique(host: str, parts: list[str], in_article: bool, pages: dict[int, int], host_pages: int) -> list[str]:
    """The blocks without boilerplate; ``pages`` gives, for keys that repeat, the number of pages they are on."""
    sitewide = lambda p: pages.get(_key(host, (p,), "block"), 0) >= max(SITEWIDE, host_pages / 2)
    kept = [p for p in parts if not sitewide(p)]
    if in_article:
        return kept or parts
    stream = _tokens(parts)
    words = [t for _, t in stream]
    covered = np.zeros(len(words), dtype=bool)
    for k in range(len(words) - RUN + 1):
        if pages.get(_key(host, words[k:k + RUN], "run"), 0) > 1:
            covered[k:k + RUN] = True
    left: dict[int, list[str]] = {}
    for (block, token), gone in zip(stream, covered, strict=True):
        if not gone:
            left.setdefault(block, []).append(token)
    new = []
    for k, tokens in sorted(left.items()):
        whole = len(tokens) == len(parts[k].split())
        if not (whole and len(tokens) < RUN and pages.get(_key(host, (parts[k],), "block"), 0) > 1):
            new.append(parts[k] if whole else " ".join(tokens))
    return new or kept


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html)."""

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, mains, contents = [], [], []
            for host, source in zip(texts(batch, "host"), texts(batch, "html"), strict=True):
                found = blocks(source)
                main = any(m for _, m in found)
                parts.append([t for t, m in found if m or not main])
                mains.append(main)
                contents.append(int.from_bytes(hashlib.blake2b("\x00".join((host, str(main), *parts[-1])).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True))
            kept = [batch.column(batch.schema.get_field_index(n)) for n in ("page_id", "url", "host")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(parts, pa.list_(pa.string())), pa.array(mains, pa.bool_()), pa.array(contents, pa.int64())], names=["page_id", "url", "host", "parts", "main", "content"])

    host = F.coalesce(F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1)), F.lit(""))
    source = small_batches(pages).select(F.col("page_id").cast("bigint").alias("page_id"), "url", host.alias("host"), "html")
    parsed = stage_packed(source.mapInArrow(parse, "page_id bigint, url string, host string, parts array<string>, main boolean, content bigint"), "blocks")
    contents = parsed.select("host", "content").distinct()
    per_host = stage(contents.groupBy("host").agg(F.count("*").alias("host_pages")), "hosts")
    size = parsed.agg(F.sum(F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + F.when(F.col("main"), 1).otherwise(1 + F.length(p) / 4).cast("bigint")))).first()[0] or 0
    n_bins = bins.count(int(size))

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = bins.Packer(n_bins)
        for batch in batches:
            for host, parts, main, content in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                packer.add(int(main), np.unique(np.array(suffixes(host, parts, main), dtype=np.uint64)), content)
            if packer.full:
                yield from packer.rows()
        yield from packer.rows()

    def sort(key, table):
        keys, pages = bins.unpack(table)
        begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        n = np.diff(np.append(begin, len(keys)))
        times = np.repeat(n, n)
        repeated = times >= (SITEWIDE if key[0].as_py() else 2)  # inside articles only sitewide blocks matter
        return pa.table({"content": pages[repeated], "key": keys[repeated].view(np.int64), "n_pages": times[repeated].astype(np.int64)})

    found = parsed.select("host", "parts", "main", "content").mapInArrow(emit, bins.SCHEMA).groupBy("kind", "bin").applyInArrow(sort, "content bigint, key bigint, n_pages bigint")
    # a page's own repeated strings: no more than its tokens
    per_page = stage(found.groupBy("content").agg(F.collect_list(F.struct("key", "n_pages")).alias("repeated")), "repeated")

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            out = []
            for host, parts, main, repeated, n in zip(*(column[c] for c in ("host", "parts", "main", "repeated", "host_pages")), strict=True):
                often = {r["key"] & (2**64 - 1): r["n_pages"] for r in repeated or []}
                out.append("\n\n".join(unique(host, parts, main, often, n or 1)))
            kept = [batch.column(batch.schema.get_field_index(n)) for n in ("page_id", "url")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    wanted = ["page_id", "url", "host", "parts", "main", "repeated", "host_pages"]
    marked = maybe(parsed, per_page, "content")
    plain = marked.where("not __maybe").withColumns({"repeated": F.lit(None).cast(per_page.schema["repeated"].dataType), "host_pages": F.lit(1).cast("bigint")})
    whole = marked.where("__maybe").join(per_page, "content", "left").join(per_host, "host", "left").select(wanted).unionByName(plain.select(wanted))
    return whole.mapInArrow(finish, "page_id bigint, url string, text string, n_chars bigint")
