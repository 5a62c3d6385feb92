"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. First pass, each block alone: what the page marks as a menu, header,
footer, sidebar, form, notice, advert or comment, or is mostly links, is boilerplate; of the rest long text dense in
stop words is content, long text with hardly any is boilerplate, and short text and text in between is ambiguous.
Second pass: ambiguous blocks take the label of the nearest decided neighbours on the same side of an article's edge,
and a heading belongs to what follows it.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm._common import as_text

#: Blocks of fewer characters are ambiguous by themselves, blocks of LONG and more need fewer stop words.
SHORT, LONG = 70, 200
#: Share of a block's characters that stand in links, from which it is boilerplate.
LINKS = 0.33
#: Share of stop words among the words: content from HIGH, boilerplate below LOW.
STOP_LOW, STOP_HIGH = 0.12, 0.25
# Frequent function words of the languages that pages come in.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be been but by can could did do for from had has have he her his how
    i if in into is it its me more my no not of on one or our out she so some than that the their them then there these
    they this to up was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis da dann das dass dem den der des die doch durch ein eine einem einen einer
    er es für hat ich ihr im in ist ja kann mich mit nach nicht noch nur ob oder sein sich sie sind so über um und uns
    unter vom von vor war was wenn wie wir wird zu zum zur
    au aussi aux avec c ce ces cette comme d dans de des du elle elles en est et être eux il ils j je l la le les leur
    leurs lui mais même n ne nous on ou par pas plus pour qu que qui s sa se ses si son sont sur un une vous y
    al algo ante antes como con contra cual cuando de del desde donde el ella ellas ellos en entre era es esa ese eso
    esta este esto fue ha hay la las le lo los más me mi muy no nos o otra otro para pero por porque que quien se ser si
    sin sobre son su sus también te tiene todo tu un una uno y ya yo""".split()
)
#: What these hold is no text of the page. Up to the end of the page if they are not closed:
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
#: Up to their end tag, if they have one:
DROPPED = frozenset("noscript template svg math object select canvas audio video".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog button fieldset header".split())
ARTICLE_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|"
    r"notices?|overlay|pagination|popup|promo\w*|related|replies|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
# Possessive throughout: a tag that never ends is read once.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
WORD = re.compile(r"[^\W\d_]+")
BOILERPLATE, CONTENT, AMBIGUOUS = -1, 1, 0
LANDMARKS = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog"}


class Block(NamedTuple):
    """A block's text, how many of its characters stand in links, whether the page marks it as boilerplate, the number
    of the outermost article that it is in (0: none) and whether it is a heading."""

    text: str
    links: int = 0
    marked: bool = False
    article: int = 0
    heading: bool = False


class _Blocks:
    """Cuts a page into blocks."""

    def __init__(self) -> None:
        self.out: list[Block] = []
        self.open: list[tuple[str, bool]] = []  # open block elements, and whether each is boilerplate
        self.held: Counter[str] = Counter()  # how many of each are open
        self.marked = self.inside = self.articles = 0
        self.parts: list[str] = []
        self.links = self.link = 0

    def text(self, raw: str) -> None:
        if raw:
            self.parts.append(raw)
            if self.link:
                self.links += len(raw.strip())

    def flush(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text:
            heading = any(self.held[h] for h in HEADINGS)
            self.out.append(Block(text, min(self.links, len(text)), self.marked > 0, self.articles if self.inside else 0, heading))
        self.parts, self.links = [], 0

    def push(self, name: str, bad: bool) -> None:
        self.open.append((name, bad))
        self.held[name] += 1
        self.marked += bad
        if name in ARTICLE_TAGS:
            self.articles += self.inside == 0
            self.inside += 1

    def pop(self) -> str:
        name, bad = self.open.pop()
        self.held[name] -= 1
        self.marked -= bad
        self.inside -= name in ARTICLE_TAGS
        return name

    def tag(self, name: str, closing: bool, rest: str) -> None:
        if name == "a":
            self.link = 0 if closing else 1
        if name == "br":
            self.parts.append(" ")
        if name in INLINE:
            return
        self.flush()
        if name in VOID or rest.endswith("/"):
            return
        if closing:
            if self.held[name]:
                while self.pop() != name:
                    pass
            self.link = 0
            return
        if name == "p" and self.open and self.open[-1][0] == "p":
            self.pop()  # a paragraph ends where the next begins
        named = [a or b or c for a, b, c in ATTRIBUTE.findall(rest)] if rest else []
        bad = (name in BOILERPLATE_TAGS and not (name == "header" and self.inside)) or (
            name not in ("html", "body", "article", "main") and any(HINT.search(x) or x.lower() in LANDMARKS for x in named)
        )
        self.push(name, bad)


@functools.cache
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I)


def blocks(page: str) -> list[Block]:
    """The blocks of a page, in order; references are decoded and white space is single.

    One pass over the page. As in browsers, a comment or a tag that never ends holds all that follows.
    """
    cutter, at, size = _Blocks(), 0, len(page)
    unclosed: set[str] = set()  # dropped elements that no end tag follows any more
    while at < size:
        lead = page.find("<", at)
        if lead < 0:
            cutter.text(page[at:])
            break
        cutter.text(page[at:lead])
        after = page[lead + 1 : lead + 2]
        if after in ("!", "?") or (after == "/" and not page[lead + 2 : lead + 3].isalpha()):
            if page.startswith("<!--", lead):
                at = lead + 5 if page.startswith("<!-->", lead) else page.find("-->", lead + 4) + 3
                if at == 2:
                    break
            else:
                at = page.find(">", lead) + 1
                if at == 0:
                    break
            continue
        if not ("a" <= after <= "z" or "A" <= after <= "Z" or after == "/"):
            cutter.text("<")
            at = lead + 1
            continue
        m = TAG.match(page, lead)
        if not m:
            break
        at = m.end()
        name, closing, rest = m[2].lower(), m[1] == "/", m[3]
        if not closing and (name in RAW or (name in DROPPED and name not in unclosed and not rest.endswith("/"))):
            if stop := _end_of(name).search(page, at):
                at = stop.end()
                continue
            if name in RAW:
                break
            unclosed.add(name)
        cutter.tag(name, closing, rest)
    cutter.flush()
    return cutter.out


def alone(block: Block) -> int:
    """First pass: a block by itself."""
    if block.marked or block.links / len(block.text) > LINKS:
        return BOILERPLATE
    if len(block.text) < SHORT:
        return AMBIGUOUS
    words = WORD.findall(block.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stops >= STOP_HIGH or (stops >= STOP_LOW and len(block.text) >= LONG):
        return CONTENT
    # text in an article, in a language whose stop words are not known, may yet be what the article says
    return AMBIGUOUS if stops >= STOP_LOW or block.article else BOILERPLATE


def classify(page: list[Block]) -> list[int]:
    """Labels of a page's blocks after both passes.

    An ambiguous block takes the label of the nearest decided block before or after it, in the same article or, like it,
    in none; what an article marks as boilerplate is no neighbour to its other blocks. Where both are as near, a heading
    takes the label of what follows and other blocks are boilerplate. Without any neighbour, blocks of an article are content, others boilerplate.
    """
    first = [alone(b) for b in page]

    def walk(order: range) -> list[tuple[int, int]]:
        """(distance, label) of the nearest decided block behind each block in walking order."""
        out, last = [(0, 0)] * len(page), {}
        for i in order:
            at, label = last.get(page[i].article, (-1, AMBIGUOUS))
            out[i] = (abs(i - at) if label else len(page), label)
            if first[i] and not (page[i].article and page[i].marked):
                last[page[i].article] = (i, first[i])
        return out

    out = []
    for block, label, left, right in zip(page, first, walk(range(len(page))), walk(range(len(page) - 1, -1, -1))):
        if label == AMBIGUOUS:
            if left[0] != right[0]:
                label = min(left, right)[1]
            elif left[1] == right[1]:
                label = left[1] or (CONTENT if block.article else BOILERPLATE)
            else:
                label = right[1] if block.heading else BOILERPLATE
        out.append(label)
    return out


def main_text(page: str) -> str:
    """The content blocks of a page, joined by single spaces."""
    cut = blocks(page)
    return " ".join(b.text for b, label in zip(cut, classify(cut)) if label == CONTENT)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text string (empty if none), n_chars long (its code points).

    Null and empty pages have the empty text; stray, nested and unclosed elements are borne; pages are read whole, in
    time in proportion to their length; null ids and repeated rows pass through; other columns of `pages` don't matter; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in as_text(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"]
            )

    kind = pages.schema[id_col].dataType.simpleString()
    picked = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    out = picked.mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
