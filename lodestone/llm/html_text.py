"""Main text of web pages by two-pass block rules.

Pass one reads the page once and cuts it into blocks at block-level tags. A block is decided by where it stands (menus,
headers, footers, asides, forms, adverts, notices, comments are boilerplate), by its link density, and by length and
stop-word density (long prose with many stop words is content). What is short, or is prose of middling density, stays
undecided. Pass two gives every undecided block the label of its nearest decided neighbours: the one both sides agree
on, else the nearer side's. Inside an article element prose needs no stop words to be content, so that pages in other
languages come out whole.

Words in class, id and role mark boilerplate if their first or last part names it (`sidebar`, `site-footer`, `adBox`), not if
they name a layout, subject or state (`has-sidebar`, `category-newsletter`, `comments-open`) or only mention it
(`page-alert-wrap`). An article inside a marked box stands by itself, but for boxes of comments, related articles, adverts and
the like, hidden ones, and asides, footers and menus. A form is boilerplate where the page has content outside of it, and not where it wraps the page: a main
or article element inside a form stands by itself, and so does a main element inside marked boxes.

Cases: null or empty html, and a page without content, give an empty text. Broken markup is read as far as it goes: an
unclosed comment or script runs to the end of the page; after a tag whose quotes never close, tags end at the next `>`.
Pages of any length and depth are read in time linear in them. Rows with equal ids are extracted each on its own.
An empty table gives an empty result; other columns of `pages` are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import column, load

#: Frequent function words of the languages that the stop-word density knows.
STOP_WORDS = frozenset(
    "the of and to in a is that for it on was with as be by at this have from or an are not but which you he had his they"
    " le la les de des du et un une en est que qui dans pour par sur au aux avec ce il pas plus ne se sont"
    " der die das und in zu den von mit ist des im für auf ein eine dem nicht sich als auch es an werden aus er"
    " el los las y que del se por con para una su al lo como más pero sus o este sí porque".split()
)
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "title", "select", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var del img wbr input".split())
OUTSIDE = {"nav", "aside", "footer", "menu", "button", "dialog", "head"}
FORM = {"form", "fieldset"}
CONTENT = {"article", "main"}
#: Elements whose text is prose even where most of it is one link.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figcaption", "dd"}
#: Parts of class and id words that name a box of boilerplate. An article inside one of the second kind isn't the page's.
PLAIN_BOX = re.compile(r"banner|cookies?|consent|gdpr|notice|alert|menu|nav|navbar|navigation|breadcrumbs?|footer|signup|login|popup|modal|overlay|toolbar|pagination|pager|skip")
SEALED_BOX = re.compile(r"ads?|adbox|adslot|adsense|advert\w*|sponsor\w*|sidebar|comment(?:s|list|thread|form|box|area|section)?|replies|reply|respond|disqus|share|sharing|social|related|recommended|promo|newsletter|subscribe")
#: First parts of words for a layout or a subject, and last ones for a state: such words only mention a box.
LAYOUT = {"has", "with", "without", "no", "not", "is", "show", "shows", "hide", "hides", "js", "overflow", "tag", "tags", "category", "cat", "topic", "type", "format"}
STATES = {"open", "opened", "closed", "enabled", "disabled", "on", "off", "allowed", "visible", "active"}
#: Classes of an article element that is none: a comment, a teaser beside the page's own.
OWN = re.compile(r"(?i)comment(?:-?(?:body|item|content))?|reply|related(?:-?(?:post|item|article))?|ad|advertisement|promo|sponsored")
PARTED = re.compile(r"[-_]+|(?<=[a-z0-9])(?=[A-Z])")
UNSEEN = {"hidden", "is-hidden", "visually-hidden", "sr-only", "d-none"}
START = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[!?])")
STOP = re.compile(r"[>\"']")
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
UNSHOWN = re.compile(r"""\baria-hidden\s*=\s*["']?true|\bstyle\s*=\s*(?:"[^"]*|'[^']*)display\s*:\s*none""", re.I)

LENGTH_LOW, LENGTH_HIGH, STOP_LOW, STOP_HIGH, LINKS_MOST = 70, 200, 0.20, 0.30, 0.33


@dataclass
class Block:
    text: str
    link_chars: int
    outside: bool
    inside: bool
    heading: bool
    form: bool = False
    prose: bool = False


@lru_cache(maxsize=1 << 16)
def _box(word: str) -> int:
    """Of a class or id word: 2 if its first or last part names a sealed box, 1 a plain one, else 0."""
    parts = [p.lower() for p in PARTED.split(word) if p]
    if not parts or parts[0] in LAYOUT or parts[-1] in STATES:
        return 0
    ends = (parts[0], parts[-1])
    return 2 if any(SEALED_BOX.fullmatch(p) for p in ends) else 1 if any(PLAIN_BOX.fullmatch(p) for p in ends) else 0


def _marked(attributes: str) -> int:
    """Whether a tag's attributes name boilerplate (1, or 2 for a sealed box), or hide what it holds (2)."""
    words = [word for found in NAMED.findall(attributes) for word in "".join(found).split()]
    if any(w.lower() in UNSEEN for w in words) or HIDDEN.search(QUOTED.sub("", attributes)) or UNSHOWN.search(attributes):
        return 2
    return max(map(_box, words), default=0)


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, with what pass one needs to know of each."""
    out: list[Block] = []
    open_: list[tuple[str, bool, bool, bool, bool]] = []  # name, outside, inside an article, inside a form, sealed
    depth: Counter[str] = Counter()  # of the names in open_
    parts: list[str] = []
    links: list[str] = []
    at, in_link, heading, strict = 0, 0, False, True

    def state() -> tuple[bool, bool, bool, bool]:
        return open_[-1][1:] if open_ else (False, False, False, False)

    def flush() -> None:
        nonlocal heading
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            outside, inside, form, _ = state()
            out.append(Block(text, len(" ".join(html.unescape(" ".join(links)).split())), outside, inside, heading, form, bool(open_) and open_[-1][0] in PROSE))
        parts.clear()
        links.clear()
        heading = False

    def say(s: str) -> None:
        if s:
            parts.append(s)
            if in_link:
                links.append(s)

    def pop() -> None:
        depth[open_.pop()[0]] -= 1

    def tag_end(i: int) -> int:
        """The place of the > that ends a tag whose attributes begin at i, or -1."""
        nonlocal strict
        j = i
        while strict and (m := STOP.search(page, j)):
            if m[0] == ">":
                return m.start()
            j = page.find(m[0], m.end()) + 1
            if not j:
                break
        strict = False
        return page.find(">", i)

    n = len(page)
    last = max(page.rfind(">"), page.rfind("<!--"))
    while at < n:
        i = page.find("<", at) if at <= last else -1
        if i < 0:
            say(page[at:])
            break
        say(page[at:i])
        m = START.match(page, i)
        if not m:
            say("<")
            at = i + 1
            continue
        if m[1]:
            end = page.find("-->", m.end())
            at = n if end < 0 else end + 3
            continue
        end = tag_end(m.end()) if m[3] else page.find(">", m.end())
        if end < 0:
            say(page[i:])
            break
        at = end + 1
        if not m[3]:
            continue
        name, attributes = m[3].lower(), page[m.end() : end]
        if m[2]:
            if name == "a":
                in_link = max(0, in_link - 1)
            elif name not in INLINE:
                flush()
                if depth[name]:
                    while open_[-1][0] != name:
                        pop()
                    pop()
            continue
        if name in RAW:
            if not attributes.endswith("/"):
                stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = stop.end() if stop else n
            continue
        if name == "a":
            in_link = 1
            continue
        if name in INLINE:
            continue
        if name == "br":
            parts.append(" ")
            continue
        flush()
        if name in VOID:
            continue
        if name == "p" or name in ("div", "ul", "ol", "table", "section", "article", "aside", "footer", "header", "nav", "form", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "main"):
            if open_ and open_[-1][0] == "p":
                pop()
        elif open_ and open_[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            pop()
        outside, inside, form, sealed = state()
        if name in CONTENT:
            own = name == "article" and any(OWN.fullmatch(w) for found in NAMED.findall(attributes) for w in "".join(found).split())
            inside, form, sealed = True, False, sealed or own
            if name == "main" and not any(depth[x] for x in OUTSIDE):
                outside = sealed = False
            elif name == "article":
                outside = sealed
        elif name in OUTSIDE or (name == "header" and not inside):
            outside, sealed = True, sealed or name in OUTSIDE
        elif name not in ("html", "body") and attributes and (box := _marked(attributes)):
            outside, sealed = True, sealed or box == 2
        if name in FORM:
            form = True
        heading = re.fullmatch("h[1-6]", name) is not None
        if not attributes.endswith("/"):
            open_.append((name, outside, inside, form, sealed))
            depth[name] += 1
    flush()
    return out


def density(b: Block) -> float:
    """Share of stop words among a block's words."""
    words = b.text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)


def decide(b: Block) -> bool | None:
    """Pass one: content, boilerplate, or None for undecided."""
    if b.outside:
        return False
    n = len(b.text)
    if b.link_chars > LINKS_MOST * n and not (b.inside and b.prose):
        return None if b.inside and n >= LENGTH_HIGH else False
    if n < LENGTH_LOW:
        return None
    if b.inside:
        return True
    dense = density(b)
    if dense >= STOP_HIGH:
        return True if n > LENGTH_HIGH else None
    return None if dense >= STOP_LOW else False


def inherit(known: list[Block], labels: list[bool | None]) -> list[bool]:
    """Pass two: undecided blocks take the label of their nearest decided neighbours; inside an article, of those there."""
    n = len(labels)
    far = n + 1
    left: list[tuple[int, bool | None]] = []
    right: list[tuple[int, bool | None]] = [(far, None)] * n
    seen: tuple[int, bool | None] = (-far, None)
    for i in range(n):
        if labels[i] is not None:
            seen = (i, labels[i])
        left.append((i - seen[0], seen[1]))
    seen = (2 * far, None)
    for i in range(n - 1, -1, -1):
        if labels[i] is not None:
            seen = (i, labels[i])
        right[i] = (seen[0] - i, seen[1])
    none_good = True not in labels
    out = []
    for i in range(n):
        own = labels[i]
        if own is None:
            (dl, l), (dr, r) = left[i], right[i]
            if known[i].inside or none_good:
                own = True  # an article's own short lines; or a page of short lines only
            elif l == r or r is None or l is None:
                own = bool(l if l is not None else r)
            else:
                # Between content and boilerplate the nearer decides; a heading belongs to what follows it.
                own = r if known[i].heading or dr < dl else l if dl < dr else False
        out.append(bool(own))
    return out


def decide_all(known: list[Block]) -> list[bool | None]:
    """Pass one of a page: where no block is content or has stop words enough, those of its language aren't in the list, and length and links decide alone."""
    wraps = not any(decide(b) for b in known if not b.form)  # a form that holds all the content is no form
    labels = [False if b.form and not wraps else decide(b) for b in known]
    plain = [not b.outside and len(b.text) >= LENGTH_LOW and b.link_chars <= LINKS_MOST * len(b.text) for b in known]
    if True in labels or any(density(b) >= STOP_LOW for b, long in zip(known, plain, strict=True) if long):
        return labels
    return [(True if len(b.text) > LENGTH_HIGH else None) if long else label for b, label, long in zip(known, labels, plain, strict=True)]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    known = blocks(page)
    return " ".join(b.text for b, good in zip(known, inherit(known, decide_all(known)), strict=True) if good)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of `pages` (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(x) for x in column(batch, "html").to_pylist()]
            cols = [column(batch, "page_id"), column(batch, "url"), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    kind = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages"))
