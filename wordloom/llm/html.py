"""Main text of web pages by composite text density.

Every node of the page's tree gets its characters per tag, adjusted by how much of both is links. The block whose
children's densities sum up highest is the core of the article; the least density on its way up to the body is the
threshold that its neighbours must reach to belong to it. The core is a part where an article is made of several: it grows
to the <article> that holds it, or else takes the headings, sections and other blocks beside it and beside what holds it,
where they are no lists of links. Elements that are something else by their tag or role (menus, forms, scripts) take no
part, nor do containers whose class or id names them reader comments, or adverts and notices where they hold few blocks.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import slices

# Element names of HTML by what they mean here.
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
RAW = frozenset(["script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"])
BLOCK = frozenset([
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main",
    "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead",
    "tr", "ul",
])
DROPPED = frozenset([
    "script", "style", "noscript", "template", "head", "title", "nav", "footer", "aside", "form", "button", "select", "option", "textarea", "input", "iframe",
    "object", "embed", "applet", "svg", "canvas", "audio", "video", "map", "dialog", "menu", "noembed", "noframes", "xmp", "search",
])
#: Start tags that end an open one of the same group: (new, what it ends, what keeps it from looking further up).
IMPLIED = {
    **{t: (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])) for t in ["li"]},
    **{t: (frozenset(["dt", "dd"]), frozenset(["dl"])) for t in ("dt", "dd")},
    **{t: (frozenset(["td", "th"]), frozenset(["tr", "table"])) for t in ("td", "th")},
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
ROLES = frozenset(["navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form"])
#: Words of class and id that name adverts, reader comments, notices and ways to skip: what an article may hold inside.
ASIDE = frozenset([
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "comment", "comments", "commentlist", "disqus", "cookie", "cookies",
    "consent", "gdpr", "breadcrumb", "breadcrumbs", "newsletter", "paywall", "popup", "modal", "lightbox", "skip",
])
COMMENTS = frozenset(["comment", "comments", "commentlist", "disqus"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: What an article is made of, beside plain containers; and what a class or id may name: containers and links.
PARTS = HEADINGS | frozenset(["section", "header", "hgroup", "p", "pre", "blockquote", "figure", "table", "dl", "ul", "ol", "details", "address"])
TEXTUAL = frozenset(["p", "pre", "blockquote", "h1", "h2", "h3", "li", "td", "dd"])

PARAGRAPHS = frozenset(["p", "pre", "h1", "h2", "h3", "h4", "h5", "h6"])

OPENS, HINTED = BLOCK | {"a", "span", "b", "i"}, BLOCK - PARAGRAPHS - {"blockquote", "figcaption", "caption", "summary", "td", "dd"}
P, NO_FENCE = frozenset(["p"]), frozenset()
P_FENCE = frozenset(["button", "td", "th", "li", "table", "object", "applet"])

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|$)""", re.I)
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"[ \t\n\r\f]+")


class Page:
    """The tree of a page as lists by node; a node's number is greater than its parent's. Node 0 is the root."""

    def __init__(self, html: str):
        self.tag, self.parent, self.attrs = ["html"], [0], [""]
        self.runs: list[tuple[int, str]] = []  # (node, text) in page order; an empty text ends a block
        self.parse(html)

    def open(self, tag: str, parent: int, attrs: str) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.attrs.append(attrs)
        return len(self.tag) - 1

    def parse(self, html: str) -> None:
        stack, at, runs = [0], 0, self.runs
        tags = self.tag

        def close(wanted: frozenset, fence: frozenset) -> None:
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] in wanted:
                    del stack[k:]
                    return
                if tags[stack[k]] in fence:
                    return

        search = TOKEN.search
        while m := search(html, at):
            if m.start() > at:
                runs.append((stack[-1], html[at : m.start()]))
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                if m[0].startswith("<![CDATA["):
                    runs.append((stack[-1], m[0][9:].removesuffix("]]>").replace("&", "&amp;")))
                continue
            name, ends = name.lower(), bool(m[1] or m[4])
            if ends:
                if name in BLOCK:
                    runs.append((stack[-1], ""))
                if name in VOID:
                    continue
                if tags[stack[-1]] == name and len(stack) > 1:
                    stack.pop()
                else:
                    close(frozenset([name]), NO_FENCE if name in BLOCK else BLOCK)
                continue
            if name in ("html", "body") and name in (tags[k] for k in stack):
                continue
            if name in BLOCK:
                runs.append((stack[-1], ""))
                close(P, P_FENCE)
                if name in IMPLIED:
                    close(*IMPLIED[name])
            if name == "br":
                runs.append((stack[-1], " "))
            attrs = m[3] or m[6] or ""
            node = self.open(name, stack[-1], attrs)
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I).search(html, at)
                at = end.end()
            elif name not in VOID and not attrs.endswith("/"):
                stack.append(node)
            elif name not in VOID and name in OPENS:
                stack.append(node)  # a slash means nothing there
        if at < len(html):
            runs.append((stack[-1], html[at:]))


def marks(attrs: str) -> tuple[set[str], str, bool]:
    """Words of class and of an id of one or two words (longer ones are made of titles), role, and whether the element is hidden."""
    words, role, hidden = set(), "", False
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            found = WORD.findall(value)
            if name == "class" or len(found) <= 2:
                words.update(found)
        elif name == "role":
            role = value.strip()
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return words, role, hidden


def extract(html: str) -> str:
    """The blocks of the main text, joined by two line ends; an empty page has none."""
    page = Page(html)
    tag, parent, n = page.tag, page.parent, len(page.tag)
    clean = [(k, unescape(t) if "&" in t else t) for k, t in page.runs]
    plain, linked, several = [0] * n, [0] * n, [0] * n  # to tell what names itself side matter from parts of the article
    link = [False] * n
    for k in range(1, n):
        link[k] = link[parent[k]] or tag[k] == "a"
    for k, t in clean:
        if t:
            plain[k] += len(t.strip())
            linked[k] += link[k] and len(t.strip())
    for k in range(n - 1, 0, -1):
        up = parent[k]
        plain[up] += plain[k]
        linked[up] += linked[k]
        several[up] += several[k] + (tag[k] in TEXTUAL and plain[k] > 0)
    out, inside = [False] * n, [False] * n
    for k in range(1, n):
        up = parent[k]
        if out[up]:
            out[k] = True
            continue
        inside[k] = inside[up] or tag[k] in ("article", "main")
        if tag[k] in DROPPED or tag[k] == "header" and not inside[k]:
            out[k] = True
        elif page.attrs[k]:
            words, role, hidden = marks(page.attrs[k])
            if hidden or role in ROLES:
                out[k] = tag[k] not in ("body", "html", "main")
            elif tag[k] == "a":
                out[k] = "skip" in words
            elif tag[k] not in ("body", "html", "main") and tag[k] in HINTED and words & ASIDE:
                few = several[k] < 3 or 2 * linked[k] > plain[k]
                out[k] = (few or bool(words & COMMENTS)) and 2 * plain[k] < 1.9 * plain[0]  # not what holds nearly all of the text
    chars, tags, link_chars, link_tags, textual = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for k, t in clean:
        if t and not out[k]:
            size = len(t.strip())
            chars[k] += size
            if link[k]:
                link_chars[k] += size
    for k in range(n - 1, 0, -1):
        if not out[k]:
            up = parent[k]
            chars[up] += chars[k]
            link_chars[up] += link_chars[k]
            tags[up] += tags[k] + 1
            link_tags[up] += link_tags[k] + (tag[k] == "a")
            textual[up] += textual[k] + (tag[k] in TEXTUAL)
    body = next((k for k in range(n) if tag[k] == "body"), 0)
    if not chars[body]:
        body = 0
    share = link_chars[body] / max(chars[body], 1)

    def density(k: int) -> float:
        c, t, lc, lt = chars[k], tags[k] or 1, link_chars[k] or 1, link_tags[k] or 1
        if not c:
            return 0.0
        base = log(log(c * lc / max(c - lc, 1) + share * c + e))
        return c / t * log(max(c / lc * t / lt, 1.0)) / max(base, 0.1)

    dense, total = [0.0] * n, [0.0] * n
    for k in range(n - 1, -1, -1):
        if not out[k]:
            dense[k] = density(k)
            if k:
                total[parent[k]] += dense[k]
    holds = [False] * n  # a paragraph or a line is no article; what holds blocks may be
    for k in range(1, n):
        if not out[k] and tag[k] in BLOCK:
            holds[parent[k]] = True
    core = max((k for k in range(body, n) if not out[k] and holds[k] and tag[k] not in PARAGRAPHS), key=lambda k: (total[k], k), default=body)
    path = [core]
    while path[-1] not in (body, 0):
        path.append(parent[path[-1]])
    threshold = min(dense[k] for k in path)
    article = next((k for k in path if tag[k] == "article"), -1)
    whole = article if article >= 0 else core
    chosen, on_path = {whole}, set(path[path.index(whole) :])
    for k in range(1, n):
        if parent[k] in on_path and k not in on_path and not out[k] and chars[k]:
            dense_near = dense[k] >= threshold and (textual[k] or tag[k] in TEXTUAL) and 3 * link_chars[k] < chars[k]
            part = tag[k] in PARTS and 3 * link_chars[k] < chars[k]
            # Beside an <article> stand other things, but for its title and more articles.
            fits = dense_near and tag[k] in ("article", "section") or part and tag[k] in HEADINGS | {"header", "hgroup"} if article >= 0 else dense_near or part
            if fits:
                chosen.add(k)
    taken, before = [False] * n, [0] * n
    last = [0] * n
    for k in range(1, n):
        if not out[k] and chars[k]:
            before[k], last[parent[k]] = last[parent[k]], k
    for k in range(n):
        if not out[k]:
            # A page without a container has its menus beside the article's blocks: lists of links that are less dense than it,
            # but lists of works, numbered under a heading or with text of their own after the article's.
            beside = core == body and k > 0 and parent[k] == body and dense[k] < threshold and 2 * link_chars[k] > chars[k]
            listed = tag[k] in ("ol", "ul") and before[k] and any(tag[j] in PARAGRAPHS - HEADINGS for j in (before[k], before[before[k]]))
            works = listed and (10 * link_chars[k] <= 9 * chars[k] or tag[k] == "ol" and tag[before[k]] in HEADINGS)
            taken[k] = k in chosen or k > 0 and taken[parent[k]] and not (beside and not works)
    blocks, current = [], []
    for k, t in clean:
        if not t:
            if text := SPACE.sub(" ", "".join(current)).strip(" "):
                blocks.append(text)
            current = []
        elif taken[k]:
            current.append(t)
    if text := SPACE.sub(" ", "".join(current)).strip(" "):
        blocks.append(text)
    return "\n\n".join(blocks)


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row (id, url, text, n_chars) for each row of df; null or empty html, and pages without text, give an empty
    text. Repeated rows are extracted each, null ids and urls stay null, an empty table gives none. No shuffle."""

    def run(batches):
        for b in slices(batches):
            out = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["id", "url", "text", "n_chars"])

    src = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    kind = src.schema["id"].dataType.simpleString()
    rows = src.mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
    return rows.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
