"""Main text of an HTML page by the maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score +1; a tag scores minus
the boilerplate words expected after it, with the expectations counted by
Spark on labelled pages (those that mark their content, see ``label``).  One
linear scan finds the contiguous run of tokens with the largest sum.  The run
then grows to the smallest element that holds it, so that short paragraphs at
its edges are not lost, and parts that are not the article (menus, headers and
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments)
are left out of it.

Text: character references are decoded, white space inside a block becomes
one space, blocks are trimmed and joined in page order by one line break.

Defined cases: null or empty html, or a page without words, gives an empty
text; markup may be unclosed or cut off anywhere; any length is read whole;
on equal sums the earliest, then longest run wins; repeated rows are extracted
each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm.common import map_rows, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark nobr q rp rt "
                   "ruby s samp small span strike strong sub sup time tt u var wbr img".split())
# Elements and names that are no part of an article.
OUT_TAGS = frozenset("nav footer aside form button select option menu dialog head input fieldset".split())
# Parts of class and id names of such elements, and what may stand before "header".
OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar footer masthead topbar toolbar cookie cookies consent gdpr notice alert popup modal "
    "newsletter subscribe signup login share sharing social related recommended recommendations comment comments "
    "commentlist replies reply disqus respond widget search pagination pager copyright skip".split())
HEADERS = frozenset("site page top main global web blog".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
CLOSES = {  # an opening tag that ends an open element of these names
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}}
NAME = re.compile(r"/?([A-Za-z][A-Za-z0-9:-]*)")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
DEFAULT_COST = 4.0


def tokens(page: str):
    """(kind, name, text) of a page: ``text``, ``open`` and ``close``; raw elements and comments are skipped."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            yield "text", "", page[at:lt]
        if lt == n:
            return
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        m = NAME.match(page, lt + 1)
        if not m:
            if page[lt + 1:lt + 2] in ("!", "?", "/"):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                yield "text", "", "<"
                at = lt + 1
            continue
        end = tag_end(page, m.end())
        name, attrs, at = m[1].lower(), page[m.end():end], min(n, end + 1)
        if page[lt + 1] == "/":
            yield "close", name, ""
            continue
        if end >= n:
            return                              # a tag that is cut off
        yield "open", name, attrs
        if name in RAW and not attrs.endswith("/"):
            at = raw_end(page, name, at)
            yield "close", name, ""


def tag_end(page: str, at: int) -> int:
    """Place of the ``>`` that ends a tag; quoted values may hold one."""
    while True:
        gt = page.find(">", at)
        if gt < 0:
            return len(page)
        part = page[at:gt]
        if part.count('"') % 2 == 0 and part.count("'") % 2 == 0:
            return gt
        quote = next(c for c in part if c in "\"'")
        close = page.find(quote, at + part.index(quote) + 1)
        if close < 0:
            return gt
        at = close + 1


def raw_end(page: str, name: str, at: int) -> int:
    m = re.compile(f"</{name}", re.I).search(page, at)
    return m.start() if m else len(page)


def is_out(name: str, attrs: str) -> int:
    """1 if an element is no part of an article by its tag, role or being hidden, 2 if by its class or id, else 0."""
    if name in OUT_TAGS or name in RAW:
        return 1
    if not attrs or name in ("html", "body"):
        return 0
    for key, *values in ATTR.findall(attrs):
        key, value = key.lower(), "".join(values).lower()
        if (key == "role" and value in OUT_ROLES or key == "hidden" or key == "aria-hidden" and value == "true"
                or key == "style" and HIDDEN.search(value)):
            return 1
        if key in ("class", "id"):
            for word in value.split():
                parts = re.split("[-_]+", word)
                if not OUT_NAMES.isdisjoint(parts) or word == "header" or parts[-1] == "header" and parts[0] in HEADERS:
                    return 2
    return 0


def parse(page: str):
    """Nodes (tag, parent, out) and runs (text, node, block) of a page.

    A node is ``out`` when it or an element around it is no part of an
    article.  ``block`` numbers the blocks in page order.
    """
    nodes: list[tuple[str, int, int]] = [("", -1, 0)]
    runs: list[tuple[str, int, int]] = []
    seq: list[tuple[str, int]] = []           # tag name or "" for a run, with its node or run number
    stack, block = [0], 0
    still: Counter[str] = Counter()           # open elements by name: an end tag without one looks at no element

    def shut_last():
        still[nodes[stack.pop()][0]] -= 1

    for kind, name, text in tokens(page):
        if kind == "text":
            seq.append(("", len(runs)))
            runs.append((text, stack[-1], block))
            continue
        block += name not in INLINE
        if kind == "open":
            shut = CLOSES.get(name)
            if shut and nodes[stack[-1]][0] in shut:
                shut_last()
            elif name not in INLINE:
                while nodes[stack[-1]][0] == "p" or nodes[stack[-1]][0] in INLINE:
                    shut_last()               # a block ends an open paragraph and what is left open in it
            out = is_out(name, text)
            if name == "header" and not out:
                out = int(not still["article"] and not still["main"])
            nodes.append((name, stack[-1], out))
            seq.append((name, len(nodes) - 1))
            if name == "br":
                runs.append((" ", stack[-1], block))
            if name not in VOID and not text.endswith("/"):
                stack.append(len(nodes) - 1)
                still[name] += 1
        else:
            seq.append(("/" + name, stack[-1]))
            if still[name]:
                while nodes[stack[-1]][0] != name:
                    shut_last()
                shut_last()
    return outside(nodes), runs, seq


def outside(nodes: list[tuple[str, int, int]]) -> list[tuple[str, int, bool]]:
    """Nodes with whether they, or an element around them, are no part of an article.

    A class or id does not count on an element that holds the article or the
    main part of the page (a name like ``with-sidebar``).
    """
    holds = bytearray(len(nodes))
    for name, parent, out in nodes:
        if name in ("article", "main") and not out:
            while parent > 0 and not holds[parent]:
                holds[parent] = 1
                parent = nodes[parent][1]
    result: list[tuple[str, int, bool]] = []
    for i, (name, parent, out) in enumerate(nodes):
        result.append((name, parent, out == 1 or (out == 2 and not holds[i]) or (parent >= 0 and result[parent][2])))
    return result


def n_words(text: str) -> int:
    return len(html.unescape(text).split())


def best_run(seq, words: list[int], cost: dict[str, float]) -> tuple[int, int] | None:
    """First and last run (inclusive) of the maximum-scoring subsequence; None without words."""
    best, top, total, start = 0.0, None, 0.0, None
    for name, i in seq:
        if name:
            total -= cost.get(name, DEFAULT_COST)
        elif words[i]:
            if total <= 0 or start is None:
                total, start = 0.0, i
            total += words[i]
            if total > best:
                best, top = total, (start, i)
    return top


def ancestors(nodes, i: int) -> list[int]:
    out = []
    while i >= 0:
        out.append(i)
        i = nodes[i][1]
    return out


def extract(page: str | None, cost: dict[str, float]) -> str:
    """Main text of one page."""
    nodes, runs, seq = parse(page or "")
    words = [0 if nodes[node][2] else n_words(text) for text, node, _ in runs]
    top = best_run(seq, words, cost)
    if top is None:
        return ""
    # The smallest element around the run, which is that around its first and last node in page order;
    # a paragraph or text element stands for the element around it.
    inside = [runs[i][1] for i in range(top[0], top[1] + 1) if words[i]]
    root, last = min(inside), max(inside)
    while root != last:
        if root < last:
            last = nodes[last][1]
        else:
            root = nodes[root][1]
    while root and (nodes[root][0] in INLINE or nodes[root][0] in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6")):
        root = nodes[root][1]
    marked = [a for a in ancestors(nodes, root) if nodes[a][0] in ("article", "main")]
    root = marked[0] if marked else root
    keep = bytearray(len(nodes))
    for i in range(root, len(nodes)):
        keep[i] = not nodes[i][2] and (i == root or (nodes[i][1] >= root and keep[nodes[i][1]]))
    out, last, parts = [], None, []
    for text, node, block in runs:
        if keep[node]:
            if block != last:
                out.append("".join(parts))
                last, parts = block, []
            parts.append(text)
    out.append("".join(parts))
    lines = (" ".join(html.unescape(x).split()) for x in out)
    return "\n".join(x for x in lines if x)


def label(page: str | None) -> list[tuple[str, int, int]]:
    """(tag, words after it inside the content, words after it outside) of a page that marks its content
    with ``article`` or ``main``; nothing for other pages."""
    nodes, runs, seq = parse(page or "")
    inside = bytearray(len(nodes))
    for i, (name, parent, _) in enumerate(nodes):
        inside[i] = name in ("article", "main") or (parent >= 0 and inside[parent])
    if not any(inside):
        return []
    out, tag = [], None
    for name, i in seq:
        if name:
            if tag:
                out.append((tag, 0, 0))
            tag = name
        elif tag and (w := n_words(runs[i][0])):
            ok = inside[runs[i][1]] and not nodes[runs[i][1]][2]
            out.append((tag, w if ok else 0, 0 if ok else w))
            tag = None
    return out


def tag_costs(pages: DataFrame, html_col: str) -> dict[str, float]:
    """Cost of every tag name, from the labelled pages of a table.

    A tag costs twice the mean boilerplate words that follow one such tag
    (0.05 at least), so that boilerplate sums below zero and content above it.
    Counting runs over all pages; the result has a row per tag name of HTML,
    others together as "".
    """

    def make():
        def run(rows):
            sums: dict[str, list[int]] = {}
            for (page,) in rows:
                for tag, _, outside in label(page):
                    x = sums.setdefault(tag if tag.removeprefix("/") in KNOWN else "", [0, 0])
                    x[0] += 1
                    x[1] += outside
            yield from ((k, *v) for k, v in sums.items())
        return run

    counts = map_rows(pages.select(html_col), make, "tag string, n bigint, outside bigint")
    rows = counts.groupBy("tag").agg(F.sum("n").alias("n"), F.sum("outside").alias("outside")).collect()
    return {r["tag"]: max(0.05, 2 * r["outside"] / r["n"]) for r in rows}


KNOWN = VOID | RAW | INLINE | OUT_TAGS | frozenset(
    "html body article main section header div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre figure figcaption address details summary center".split())


def extract_pages(df: DataFrame, id_col: str, url_col: str, html_col: str,
                  labelled: DataFrame | None = None) -> DataFrame:
    """``id_col, url_col, text, n_chars`` for every row; weights come from ``labelled`` (default: the rows themselves)."""
    cost = tag_costs(df if labelled is None else labelled, html_col)

    def make():
        def run(rows):
            for key, url, page in rows:
                text = extract(page, cost)
                yield key, url, text, len(text)
        return run

    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    return map_rows(df.select(id_col, url_col, html_col), make,
                    f"`{id_col}` {kind[id_col]}, `{url_col}` {kind[url_col]}, text string, n_chars bigint")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"), "page_id", "url", "html")
