"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host."""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.common import materialize

#: A wrapper says what is constant once it has seen so many different pages.
LEAST_PAGES = 5
#: Nodes of a wrapper, beyond which optional nodes that a single page had are forgotten.
MOST_NODES = 4000
#: Characters from which a constant text is held as a hash.
BRIEF = 2000
#: Hosts whose wrappers one task holds before it passes them on, and partial wrappers that one merge takes.
HOSTS_HELD = 1000
MERGE_WAYS = 16
#: Bytes of extraction rules up to which they are broadcast; beyond, pages and rules are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Hashes of repeated pages up to which they are broadcast.
BROADCAST_PAGES = 200_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe|svg|math|select|button|object)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD = re.compile(r"[a-z]+")
_PART = re.compile(r"[-_]+")
_HOST = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)")

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED_TAGS = frozenset("nav footer aside form head menu dialog fieldset".split())
MAIN_TAGS = frozenset(["article", "main"])
#: Classes and ids, whole or as parts of one made of nothing else ("cookie-banner"), that name what is not the article.
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup login comment comments reply replies disqus share sharing social related recommended widget pagination copyright masthead skip".split()
)
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _named(names: str) -> bool:
    """Whether a whole class or id names what is dropped: ``no-comments`` or ``has-sidebar`` doesn't."""
    return any(DROPPED_NAMES.issuperset(filter(None, _PART.split(n))) for n in names.split() if n.strip("-_"))


def blocks(page: str) -> list[tuple[tuple[str, ...], bool, bool, str, int]]:
    """The text blocks of a page in order: path of block elements (``!`` in a key: its name says to drop it), dropped, inside article or main, text, characters in links.

    Tolerates unclosed and stray tags, quoted ``>``, raw text in scripts, and ``<`` that starts no tag. Names never drop
    an article or main element, nor one around it unless the page has such an element in nothing dropped, or more text
    outside of all these than in them.
    """
    out: list[tuple] = []
    stack: list[tuple[str, str, bool, bool, tuple]] = []  # tag, key, dropped, main, elements around that names drop
    number = 0
    around: set[int] = set()  # those of them with an article or main element
    parts: list[str] = []
    links = in_link = 0

    def flush():
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            top = stack[-1] if stack else ("", "", False, False, ())
            out.append((tuple(s[1] for s in stack), top[2], top[3], text, min(links, len(text)), top[4]))
        parts.clear()
        links = 0

    def close(n: int):
        flush()
        del stack[n:]

    def text(piece: str):
        nonlocal links
        if piece:
            piece = html.unescape(piece)
            parts.append(piece)
            if in_link:
                links += len(piece)

    at = 0
    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        ends = bool(m[2] or m[5])
        if tag == "br":
            parts.append(" ")
        elif tag in INLINE:
            if tag == "a":
                in_link = 0 if ends else 1
        elif ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            else:
                flush()
            in_link = 0
        elif tag in VOID:
            flush()
        else:
            flush()
            in_link = 0
            for closed in (_CLOSES.get(tag, ()), ("p",) if tag in _ENDS_P else ()):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in closed:
                        close(i)
                        break
                    if stack[i][0] not in ("p", "tr", "td", "th", "li", "dt", "dd", "option"):
                        break
            attributes = {a[1].lower(): (a[2] or "").strip("\"'").lower() for a in _ATTRIBUTE.finditer(m[4] or m[7] or "")}
            names = sorted({*_WORD.findall(attributes.get("class", "")), *_WORD.findall(attributes.get("id", ""))})
            up = stack[-1] if stack else ("", "", False, False, ())
            is_main = tag in MAIN_TAGS or attributes.get("role") == "main" or attributes.get("itemprop") == "articlebody"
            main = up[3] or is_main
            number += 1
            named = up[4]
            if is_main:
                around.update(named)
            elif tag not in ("body", "html") and (_named(attributes.get("class", "")) or _named(attributes.get("id", ""))):
                named = (*named, number)
            dropped = up[2] or tag in DROPPED_TAGS or tag == "header" and not main or attributes.get("role") in ("navigation", "banner", "contentinfo", "complementary", "search", "alert") or "hidden" in attributes or attributes.get("aria-hidden") == "true"
            stack.append((tag, ".".join([tag, *names, *["!"][: named != up[4]]]), dropped, main, named))
    text(page[at:])
    flush()
    free = [b for b in out if not b[1] and not b[5]]
    spared = sum(len(b[3]) for b in out if b[2] and not b[1] and b[5] and around.issuperset(b[5]))
    if any(b[2] for b in free) or sum(len(b[3]) for b in free) > spared:
        around.clear()
    return [(path, dropped or not around.issuperset(named), main, text, links) for path, dropped, main, text, links, named in out]


# A wrapper is a list of nodes [key, children, optional, repeated, text, pages, characters, characters in links]:
# an element has children and no text; a text has the key "#" and its constant, or null for a slot.


def _node(key: str, text: str | None = None, chars: int = 0, links: int = 0) -> list:
    return [key, [], False, False, text, 1, chars, links]


def _join(a: list, b: list, same_page: bool) -> list:
    """Two aligned nodes in one."""
    return [a[0], _align(a[1], b[1], same_page), a[2] or b[2], a[3] or b[3] or same_page, a[4] if a[4] == b[4] else None, max(a[5], b[5]) if same_page else a[5] + b[5], a[6] + b[6], a[7] + b[7]]


def _fold(nodes: list) -> list:
    """Neighbours with the same key become one repeated node."""
    out: list = []
    for n in nodes:
        if out and out[-1][0] == n[0]:
            out[-1] = _join(out[-1], n, True)
        else:
            out.append(n)
    return out


def _align(a: list, b: list, same_page: bool = False) -> list:
    """Align two runs of siblings by their longest common subsequence of keys; what only one has becomes optional."""
    if [n[0] for n in a] == [n[0] for n in b]:
        return [_join(x, y, same_page) for x, y in zip(a, b, strict=True)]
    if len(a) * len(b) > 250_000:
        a, b = _fold(sorted(a, key=lambda n: n[0])), _fold(sorted(b, key=lambda n: n[0]))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i][0] == b[j][0]:
            out.append(_join(a[i], b[j], same_page))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            out.append([*a[i][:2], True, *a[i][3:]])
            i += 1
        else:
            out.append([*b[j][:2], True, *b[j][3:]])
            j += 1
    return _fold(out)


def wrapper_of(page: str) -> list:
    """The wrapper of a single page: its tree of block elements with repeats folded and all texts constant."""
    root = _node("")
    path: list[tuple[str, list]] = [("", root)]
    for keys, _, _, text, links in blocks(page):
        k = 0
        while k < len(keys) and k + 1 < len(path) and path[k + 1][0] == keys[k]:
            k += 1
        k = min(k, len(keys) - 1) if keys and k == len(keys) == len(path) - 1 else k
        del path[k + 1 :]
        for key in keys[k:]:
            child = _node(key)
            path[-1][1][1].append(child)
            path.append((key, child))
        path[-1][1][1].append(_node("#", text, len(text), links))

    def folded(n: list) -> list:
        n[1] = _fold([folded(c) for c in n[1]])
        return n

    return folded(root)


def _size(n: list) -> int:
    return 1 + sum(map(_size, n[1]))


def merge_wrappers(a: list, b: list) -> list:
    out = _join(a, b, False)
    if _size(out) > MOST_NODES:

        def pruned(n: list) -> list:
            n[1] = [pruned(c) for c in n[1] if not (c[2] and c[5] == 1)]
            return n

        out = pruned(out)
    return out


def _brief(text: str) -> str:
    """A text as rules hold it: one of BRIEF characters or more as its hash."""
    return text if len(text) < BRIEF else "sha256:" + hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def rule_of(wrapper: list) -> dict:
    """What a wrapper tells extraction: the path that holds most of the text in slots, or the article element around it, and the texts that all pages share."""
    pages, constant, weight = wrapper[5], [], {}

    def walk(n: list, path: tuple):
        for c in n[1]:
            if c[0] != "#":
                walk(c, (*path, c[0]))
            elif c[4] is not None and not c[2] and not c[3] and c[5] == pages:
                constant.append(["/".join(path), c[4]])
            elif not any(k.endswith(".!") or k.split(".")[0] in DROPPED_TAGS for k in path):
                for d in range(1, len(path) + 1):
                    weight[path[:d]] = weight.get(path[:d], 0) + c[6] - 2 * c[7]

    walk(wrapper, ())
    if pages < LEAST_PAGES or not weight:
        return {}
    total = max(weight.values())
    holds = [p for p, w in weight.items() if w >= 0.8 * total and p[-1].split(".")[0] in ("div", "section", "td", "main", "article", "body")]
    main = max(holds, key=lambda p: (len(p), p), default=None)
    if main:  # headline, lead and closing stand in the article beside the division that holds most of it
        around = [d for d in range(1, len(main) + 1) if main[d - 1].split(".")[0] == "article"]
        main = main[: around[-1]] if around else main
    return {"main": "/".join(main) if main else None, "constant": [[p, _brief(t)] for p, t in constant]}


@lru_cache(maxsize=4096)
def _rule(text: str) -> tuple:
    rule = json.loads(text)
    return rule.get("main"), frozenset(map(tuple, rule.get("constant", ())))


def main_text(page: str | None, rule: str | None = None) -> str:
    """The article of a page: where its host's wrapper has the text slots; for a host without a rule, and for a page that
    doesn't fit it, in article or main elements, or else in blocks that aren't mostly links."""
    if not page:
        return ""
    where, constant = _rule(rule) if rule else (None, frozenset())
    found = [b for b in blocks(page) if not b[1]]
    varies = lambda b: ("/".join(b[0]), _brief(b[3])) not in constant
    inside = [b for b in found if where and ("/".join(b[0]) + "/").startswith(where + "/")]
    if inside or any(b[2] for b in found):
        found = [b for b in inside or found if (inside or b[2]) and (varies(b) or b[2] and b[0][-1].split(".")[0] in ("p", "h1", "article", "main"))]
    else:
        found = [b for b in found if varies(b)]
        found = [b for b in found if 2 * b[4] <= len(b[3])] or found
    return " ".join(b[3] for b in found)


def _host() -> Column:
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST.pattern, 1)).alias("host")


def infer_rules(pages: DataFrame) -> DataFrame:
    """``host, rule`` for all hosts of ``pages(url, html)``.

    Pages that a host has more than once are found by a count of hashes, and one of each is kept; only these are shuffled.
    Each task aligns the pages of a host as it meets them into one partial wrapper; partial wrappers are merged by host
    and a salt, and these by host. So a host with most of the pages costs one row a task, and no group holds pages.
    """

    def partial(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[str, list] = {}

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())], ["host", "wrapper"])
            held.clear()
            return out

        for batch in batches:
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if page:
                    host, w = host_of(url), wrapper_of(page)
                    held[host] = merge_wrappers(held[host], w) if host in held else w
            if len(held) > HOSTS_HELD:
                yield rows()
        yield rows()

    def merged(pdf):
        import pandas as pd

        w = None
        for x in pdf["wrapper"]:
            w = json.loads(x) if w is None else merge_wrappers(w, json.loads(x))
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(w)]})

    def ruled(pdf):
        import pandas as pd

        w = None
        for x in pdf["wrapper"]:
            w = json.loads(x) if w is None else merge_wrappers(w, json.loads(x))
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "rule": [json.dumps(rule_of(w))]})

    key = ["host", "h1", "h2"]
    hashed = pages.select("url", "html", _host(), F.xxhash64("html").alias("h1"), F.xxhash64(F.lit(1), "html").alias("h2")).where("html <> ''")
    again = materialize(hashed.groupBy(*key).count().where("count > 1").select(*key), "html-again")
    again = F.broadcast(again) if again.count() <= BROADCAST_PAGES else again
    each = hashed.join(again, key, "left_anti").select("url", "html").unionByName(hashed.join(again, key, "left_semi").dropDuplicates(key).select("url", "html"))
    parts = each.mapInArrow(partial, "host string, wrapper string")
    once = parts.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(MERGE_WAYS)).alias("salt")).applyInPandas(merged, "host string, wrapper string")
    return once.groupBy("host").applyInPandas(ruled, "host string, rule string")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``.

    Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles go by their elements and
    names; the wrapper of the host tells where the slots are that hold the article, and constant text from slots.
    Article and main elements decide only for hosts of fewer than LEAST_PAGES pages and pages that don't fit the wrapper. Null or empty html gives the empty text, a null url counts as one host; repeated pages count once in a
    wrapper and are all extracted.
    """
    rules = materialize(infer_rules(pages), "html-rules").where("rule <> '{}'")
    small = (rules.agg(F.sum(F.length("rule") + F.length("host"))).first()[0] or 0) <= BROADCAST_BYTES

    def take(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(p, r) for p, r in zip(batch.column("html").to_pylist(), batch.column("rule").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html", _host())
    return rows.join(F.broadcast(rules) if small else rules, "host", "left").select("page_id", "url", "html", "rule").mapInArrow(take, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
