"""Main-text extraction by two-pass block rules.

A page is cut into blocks at block-level tags. Blocks inside navigation, headers and footers of
the page, asides, forms, scripts, styles, hidden elements and elements whose class, id or role
names boilerplate are no text, whatever they say, and take no part in what follows; text of such
inline elements and of buttons is left out of its block.

Pass one classifies every other block by its link density, its length and its stop-word density:
links in bulk are bad, as are long blocks with few stop words on a page that has them; a long
block with many is good, one of middling length or density near, a short one short. An article or main
element is a feature of the same rules: within one, length alone makes a block good and only links in
bulk beside other such links make it bad, as the page itself says where its text is. If no block
turns out good, near ones with many stop words do.

Pass two gives near and short blocks the label of their nearest decided neighbours, within the
same article or outside any: a block between two good ones is good, between two bad ones bad, and
else it takes the nearer one's label, at equal distance good; within an article one good neighbour
is enough, and without any the block is good. The edge of the page counts as bad unless marked
boilerplate lies between, and is half a block nearer but for headings. A page with few stop words is in another language than those listed here, so that its
blocks are judged without them. Both passes take time in proportion to the page.

Edge cases: null or empty html gives an empty text; unclosed and stray tags are tolerated; an
article without decided blocks is kept whole; a form, or an element named like boilerplate, that
holds the articles or most of the page's text is a wrapper and counts as plain; very long pages
are processed whole; repeated rows give repeated results, other columns pass through and a clash
with ``text`` or ``n_chars`` is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

# fixed values: HTML element names
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes svg select object canvas annotation annotation-xml".split())
OUTSIDE = frozenset("nav aside footer menu dialog button head".split())
INLINE = frozenset("a abbr b bdi bdo big cite code em font i ins kbd mark q s samp small span strike strong sub sup tt u var".split())
# fixed values: words in class, id and role that mark boilerplate
MARKED = frozenset("ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus footer gdpr header menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget complementary alert".split())
# fixed values: frequent function words of the corpus languages
STOP = frozenset(
    "a about all an and are as at be but by can do for from had has have he her his i if in is it its my no not of on one or our she so that the their them there they this to up us was we were what when which who will with would you your "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses si son sont sur un une vous y "
    "aber als am an auch auf aus bei bin bis da das dass dem den der des die doch ein eine einem einen einer er es für hat ich ihr im in ist ja kann mit nach nicht noch nur oder sein sich sie sind so und uns unter vom von vor war was wenn wie wir wird zu zum zur über "
    "al como con cuando del desde e el ella ellos era es esta este fue ha hay la las lo los más me mi muy nos o para pero por porque que se sin sobre su sus también te tiene todo una uno y ya".split()
)
LONG, SHORT = 200, 70
LINKS = 0.33
STOP_LOW, STOP_HIGH = 0.10, 0.20
STOP_PAGE = 0.15
MOST = 0.5

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*(?>\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^>])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>][^\s=/>]*)(?>\s*=\s*(\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>]+))?|[\"'=/]")
_PART = re.compile(r"[a-z]+")
# fixed values: parts that say what a page has rather than what an element is, and parts that name a container
_ABOUT = frozenset("no has with without".split())
_HOLDER = frozenset("area bar block box inner links list section".split())
# fixed values: RAW elements whose content is markup, which without an end tag hide nothing
_MARKUP = frozenset("noscript template svg select object canvas annotation annotation-xml".split())


def attributes_of(tag: str) -> dict[str, str]:
    """Attributes of a start tag by lower-case name, the first of a name; values in lower case."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(tag) if tag and not tag.isspace() else ():
        if name:
            out.setdefault(name.lower(), (value[1:].rstrip(value[0]) if value[:1] in ("'", '"') else value).lower())
    return out


def _named(name: str, attributes: dict[str, str], whole: bool) -> bool:
    """Whether a class, id or role names boilerplate: as a whole word or, unless ``whole``, by its last part (cookie-notice).

    The id of a section within an article is an anchor, not a name."""
    for key in ("class", "role") if whole and name == "section" else ("class", "id", "role"):
        for word in attributes.get(key, "").split():
            parts = _PART.findall(word)
            while len(parts) > 1 and parts[-1] in _HOLDER:
                parts.pop()
            if word in MARKED or (not whole and parts and parts[-1] in MARKED and not _ABOUT & set(parts)):
                return True
    return False


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")


def _is_main(name: str, attributes: dict[str, str]) -> bool:
    return name in ("article", "main") or "articlebody" in attributes.get("itemprop", "").split() or "main" in attributes.get("role", "").split()


class Block:
    __slots__ = ("text", "linked", "bad", "article", "heading", "wrapper", "label")

    def __init__(self, text: str, linked: int, bad: bool, article: int, heading: bool, wrapper: int):
        self.text, self.linked, self.bad, self.article, self.heading, self.wrapper, self.label = text, linked, bad, article, heading, wrapper, ""


def blocks_of(html: str) -> list[Block]:
    """The page's blocks of text in page order.

    If every article lies in elements named like boilerplate or in forms, those are wrappers of the page and count as plain;
    without an article, so does such an element that holds most of the page's unlinked text."""
    out, articles, around = _blocks(html, frozenset())
    if articles:
        return out
    if not around:
        sizes: dict[int, int] = {}
        for b in out:
            if b.wrapper != _NONE:
                sizes[b.wrapper] = sizes.get(b.wrapper, 0) + len(b.text) - b.linked
        most = max(sizes, key=sizes.__getitem__, default=_NONE)
        if most == _NONE or most == _PLAIN or sizes[most] <= MOST * sum(sizes.values()):
            return out
        around = frozenset([most])
    return _blocks(html, around)[0]


#: of blocks that no wrapper could free, and of those that lie in none
_NONE, _PLAIN = -2, -1


class _Open:
    """The open elements. Positions by name and of blocks find what an end tag closes without a walk."""

    def __init__(self) -> None:
        self.names: list[str] = []
        #: of each element: inside boilerplate, article number, chain of named elements around with the outermost one (None: hidden otherwise)
        self.states: list[tuple[bool, int, tuple | None]] = []
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def state(self) -> tuple[bool, int, tuple | None]:
        return self.states[-1] if self.states else (False, 0, ())

    def push(self, name: str, state: tuple[bool, int, tuple | None]) -> None:
        self.where.setdefault(name, []).append(len(self.names))
        if name in BLOCK:
            self.blocks.append(len(self.names))
        self.names.append(name)
        self.states.append(state)

    def close(self, name: str, within_block: bool) -> None:
        """Close the innermost element of this name and all in it; with ``within_block`` only if no block is open inside it."""
        at = self.where.get(name)
        if at and (not within_block or not self.blocks or self.blocks[-1] <= at[-1]):
            for _ in range(len(self.names) - at[-1]):
                gone = self.names.pop()
                self.states.pop()
                self.where[gone].pop()
                if gone in BLOCK:
                    self.blocks.pop()


def _raw_end(html: str, name: str, at: int, without: set[str]) -> int:
    """Where a RAW element's content ends; ``without`` has the names known to have no further end tag."""
    if name not in without:
        if end := re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at):
            return end.end()
        without.add(name)
    return at if name in _MARKUP else len(html)


def _blocks(html: str, plain: frozenset[int]) -> tuple[list[Block], int, frozenset[int]]:
    """Blocks, number of articles, and places of the elements whose names alone hide an article; ``plain`` names none."""
    opened = _Open()
    around: set[int] = set()
    without: set[str] = set()
    out: list[Block] = []
    pieces: list[str] = []
    began: tuple[bool, int, tuple | None] | None = None  # the state in which the block at hand has its first text
    linked = links = articles = 0
    heading = False
    at, n = 0, len(html)

    def flush() -> None:
        nonlocal linked, began
        text = " ".join(unescape("".join(pieces)).split())
        if text and began is not None:
            bad, article, chain = began
            out.append(Block(text, linked, bad, article, heading, _NONE if chain is None else chain[2] if bad and chain else _PLAIN))
        pieces.clear()
        linked, began = 0, None

    def add(text: str) -> None:
        nonlocal linked, began
        state = opened.state()
        if began is not None and state[0] != began[0] and text.strip():
            if state[0]:
                return  # a hidden or named piece, or a button, within a block of text
            flush()
        if began is None and text.strip():
            began = state
        pieces.append(text)
        if links:
            linked += len(text.strip())

    while at < n:
        m = _TOKEN.search(html, at)
        if not m:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            if name in BLOCK:
                flush()
                links = 0
                heading = False
            if name == "br":
                add(" ")
            opened.close(name, name not in BLOCK)
            continue
        if name in RAW:
            if not m[3].endswith("/"):
                at = _raw_end(html, name, at, without)
            continue
        if name == "br" or name == "wbr":
            if name == "br":
                add(" ")
            continue
        if name == "a":
            links += 1
        if name in BLOCK:
            flush()
            links = 0
            heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
            if name == "p" or name == "li":  # these close their open like, and what it left open within
                opened.close(name, True)
        if name in VOID or m[3].endswith("/"):
            continue
        bad, article, within = opened.state()
        attributes = attributes_of(m[3])
        if _is_main(name, attributes):
            if not bad and not article:
                articles += 1
                article = articles
            elif bad:
                chain = within
                while chain and chain[0] not in around:
                    around.add(chain[0])
                    chain = chain[1]
        root = name in ("html", "body", "article", "main")
        hard = name in OUTSIDE or (name == "header" and not article) or (not root and _hidden(attributes))
        named = not root and name not in INLINE and not heading and _named(name, attributes, bool(article))
        soft = m.start() not in plain and (named or name == "form")
        chain = None if hard or within is None else (m.start(), within, within[2] if within else m.start()) if soft else within
        opened.push(name, (bad or hard or soft, article, chain))
    flush()
    return out, articles, frozenset(around)


def _stops(words: list[str]) -> int:
    return sum(w.strip(".,;:!?\"'()") in STOP for w in words)


def _links_only(b: Block) -> bool:
    return b.linked / max(1, len(b.text)) > 0.8 and not b.heading


def _first_pass(b: Block, bulk: bool, listed: bool) -> str:
    """``bulk``: a neighbour in the same article is all links too; ``listed``: the page has stop words to go by."""
    words = b.text.lower().split()
    density = b.linked / max(1, len(b.text))
    if b.article:
        return "bad" if bulk and _links_only(b) and len(words) > 3 else ("good" if len(b.text) >= SHORT and density <= LINKS else "short")
    if density > LINKS or "©" in b.text[:3]:
        return "bad"
    if len(b.text) < SHORT:
        return "bad" if b.linked else "short"
    stop = _stops(words) / max(1, len(words)) if listed else 1.0
    if stop >= STOP_HIGH:
        return "good" if len(b.text) > LONG else "near"
    return "near" if stop >= STOP_LOW or len(b.text) <= LONG else "bad"


def classify(blocks: list[Block]) -> list[Block]:
    """Set every block's label to good or bad."""
    marked = [b.bad for b in blocks]
    free = [b for b in blocks if not b.bad]
    for b in blocks:
        b.label = "bad"
    prose = [w for b in free if b.linked / max(1, len(b.text)) <= LINKS for w in b.text.lower().split()]
    listed = _stops(prose) >= STOP_PAGE * len(prose)
    for k, b in enumerate(free):
        beside = [*free[max(0, k - 1) : k], *free[k + 1 : k + 2]]
        b.label = _first_pass(b, any(o.article == b.article and _links_only(o) for o in beside), listed)
    if not any(b.label == "good" for b in free):
        for b in free:
            words = b.text.lower().split()
            if b.label == "near" and (not listed or _stops(words) >= STOP_HIGH * len(words)):
                b.label = "good"
    # pages whose first or last block is marked boilerplate have no bare edge there
    edges = not marked or not marked[0], not marked or not marked[-1]
    before, after = _nearest(free, 1, edges[0]), _nearest(free, -1, edges[1])
    for k, b in enumerate(free):
        if b.label not in ("good", "bad"):
            near = [x for x in (before[k], after[k]) if x]
            labels = {x for _, x in near}
            if b.article:
                b.label = "good" if "good" in labels or len(near) < 2 else "bad"
            elif len(labels) == 1:
                b.label = labels.pop()
            elif near:
                best = min(d for d, _ in near)
                b.label = "good" if "good" in {x for d, x in near if d == best} else "bad"
            else:
                b.label = "bad"
    return blocks


def _nearest(blocks: list[Block], step: int, bare: bool) -> list[tuple[float, str] | None]:
    """For every block, distance and label of the nearest decided one of its article on one side.

    Outside articles a bare edge of the page counts as bad and half a block nearer, but for headings."""
    out: list[tuple[float, str] | None] = [None] * len(blocks)
    order = range(len(blocks)) if step > 0 else range(len(blocks) - 1, -1, -1)
    last: int | None = None  # the nearest decided block of the article at hand
    edge = -1 if step > 0 else len(blocks)
    for k in order:
        first = k - step in (-1, len(blocks))
        if first or blocks[k - step].article != blocks[k].article:
            last, edge = None, k - step if not first or bare else None
        if last is not None:
            out[k] = (abs(k - last), blocks[last].label)
        elif not blocks[k].article and edge is not None:
            out[k] = (abs(k - edge) - (0 if blocks[k].heading else 0.5), "bad")
        if blocks[k].label in ("good", "bad"):
            last = k
    return out


def main_text(html: str | None) -> str:
    return " ".join(b.text for b in classify(blocks_of(html)) if b.label == "good") if html else ""


def extract_main(df: DataFrame, html: str = "html") -> DataFrame:
    """Replace the ``html`` column by ``text`` and ``n_chars`` (code points)."""
    keep = [f for f in df.schema.fields if f.name != html]
    if clash := {f.name.lower() for f in keep} & {"text", "n_chars"}:
        raise ValueError(f"output columns already exist: {sorted(clash)}")
    schema = T.StructType([*keep, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, pages in slices(batches, html, 4_000_000):
            texts = [main_text(p) for p in pages]
            own = [batch.column(f.name) for f in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return df.mapInArrow(run, schema)
