"""Main text of web pages as the maximum-scoring contiguous run of blocks.

A page is read once as tags and words, in blocks between block-level tags. Words score WORD; each start tag costs
its own weight once, and each word pays the weights of the elements around it that hold no content. All
weights are zero or negative. A linear scan (maximum-sum subsequence) finds the best run of blocks, and nothing
else decides what is left of a page's beginning and end. Elements of weight -WORD or less inside the run (an advert in
the middle of an article) are left out; everything else in it is kept whole. In marked content they don't count against the run.

Weights come from labelled pages: those that mark their content (one <article> or <main>). They are counted over a
bounded, seeded sample. A tag's own weight is the log-odds by which it is more frequent outside content. An element is
named by its tag with each of its classes and its id, or by its tag alone; its weight is the log-odds of its words'
being content, where elements around content count as content and, of what lies beside it, only the outermost
element is counted: the list in a menu isn't what makes it a menu. Elements that HTML itself defines as other
than content, and names of the parts that are never main text (FIXED below), weigh FIXED_WEIGHT at least. On pages that
mark their content, what isn't in it pays the weight of OUTSIDE, which is learned like the others.

An element never pays if it holds the marked content, or if its name alone speaks against it and it holds more
than half of the content's words.

Character references are decoded, white space inside a block becomes one space, blocks are joined in
page order by one newline; <br> is white space. Defined results: null, empty or tag-only html gives
an empty text; unclosed elements end with their parent, end tags without an element are passed over; an unclosed
comment, script or style runs to the end of the page; of runs with equal scores the first, longest one is taken; repeated
rows are each answered; without labelled pages only the fixed weights count; an input column of the name of the result
is replaced, others are kept; an empty table gives no rows. Time is linear in the page's length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, small_batches

WORD = 1.0
#: A tag that no labelled page has.
DEFAULT = -1.0
#: What a tag inside a block costs at most: a link in a sentence is no menu.
INLINE = -1.5
#: Weights per unit of log-odds, what an element's log-odds must be above to weigh nothing, and the least weight.
SCALE, BIAS, MOST = 1.0, 1.0, 5.0
#: Tags in marked content cost so much of their own weight.
INSIDE = 0.05
FIXED_WEIGHT = -2.0
OUTSIDE = "(outside)"
#: Pages from which weights are counted: one in so many that about this number is read.
LABELLED_PAGES = 2_000

# Fixed values of HTML: element kinds, elements that aren't content, and names of parts that are never main text.
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul video audio canvas".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|template"
NEVER = frozenset("head nav footer aside form menu dialog button select".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NAMES = frozenset("ad ads advert adverts advertisement advertisements sponsored menu nav navbar navigation breadcrumb breadcrumbs sidebar sidebars cookie cookies notice notices comment comments".split())
WHOLE_NAMES = frozenset("header footer top-menu site-header site-footer page-header page-footer".split())
#: What may stand beside such a name in one token: "cookie-banner" is one, "notice-of-meeting" and "ad-hoc" are not.
LAYOUT = frozenset("site page main top bottom left right inner outer wrapper wrap container box block slot unit banner bar list area item items widget content text link links inline global primary secondary".split())
#: On headings and sections of the content, only these: a section on navigation isn't a menu.
PARTS_OF_CONTENT = frozenset("section h1 h2 h3 h4 h5 h6".split())
NEVER_CONTENT = frozenset("ad ads advert adverts advertisement advertisements sponsored sidebar sidebars cookie cookies comment comments".split())
#: Elements whose <article> is no main text.
ASIDE = frozenset("aside nav footer".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?<!/)>.*?(?:</\1\s*+>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)|([^<]++|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?|["']""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def furniture(token: str, of_content: bool = False) -> bool:
    """Whether a class or id names a part of a page that is never main text; with ``of_content`` on a heading or section of the content."""
    if of_content:
        return token.lower() in NEVER_CONTENT
    parts = [p.lower() for p in _PART.findall(token)]
    return token.lower() in WHOLE_NAMES or any(p in NAMES for p in parts) and all(p in NAMES or p in LAYOUT or p.isdigit() for p in parts)


class Element:
    __slots__ = ("keys", "fixed", "named", "parent", "inside", "holds", "words", "pays", "aside")

    def __init__(self, name: str, attributes: str, parent: Element | None, inside: bool) -> None:
        self.parent, self.inside, self.holds, self.words, self.pays = parent, inside, False, 0, 0.0
        self.fixed = name in NEVER or name == "header" and not inside
        self.named = False
        names = []
        if attributes and name not in ("html", "body"):
            for key, *value in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), next((v for v in value if v), "")
                if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) or key == "role" and value.lower() in ROLES:
                    self.fixed = True
                elif key in ("class", "id"):
                    for token in value.split():
                        names.append(f"{name}{'.' if key == 'class' else '#'}{token.lower()[:40]}")
                        self.named = self.named or furniture(token, inside and name in PARTS_OF_CONTENT)
        #: Whether an <article> in it is no main text.
        self.aside = parent is not None and parent.aside or name in ASIDE or self.fixed and name not in NEVER
        self.keys = names or [name]


class Block:
    __slots__ = ("parts", "tags", "element", "text")

    def __init__(self, element: Element) -> None:
        self.parts: list[str] = []
        self.tags: list[str] = []
        self.element, self.text = element, ""


def blocks(html: str) -> tuple[list[Block], list[Element], bool]:
    """Runs of text between block-level tags, the elements in order of their starts, and whether the page marks its content."""
    root = Element("", "", None, False)
    found, elements, marked = [Block(root)], [root], False
    stack: list[tuple[str, Element]] = []
    held: Counter[str] = Counter()  # names on the stack
    levels: list[int] = []  # places of block-level elements on the stack

    def turn(tag: str, element: Element) -> None:
        b = found[-1]
        if b.parts or b.element is not element:
            found.append(b := Block(element))
        b.tags.append(tag)

    def cut(k: int) -> None:
        while len(stack) > k:
            held[stack.pop()[0]] -= 1
        while levels and levels[-1] >= k:
            levels.pop()

    for m in _TOKEN.finditer(html):
        raw, end, name, attributes, text = m.groups()
        here = stack[-1][1] if stack else root
        if text is not None:
            b = found[-1]
            if b.element is not here:
                found.append(b := Block(here))
            b.parts.append(text)
        elif name:
            name = name.lower()
            block = name in BLOCK
            if not end:
                if block and levels and stack[levels[-1]][0] == "p":  # a paragraph ends where a block begins
                    cut(levels[-1])
                    here = stack[-1][1] if stack else root
                if name not in VOID and not attributes.endswith("/"):
                    element = here
                    if block:
                        content = name in ("article", "main")
                        content = content and not here.aside
                        if content and not here.inside:
                            marked = True
                            up: Element | None = here
                            while up is not None and not up.holds:
                                up.holds = True
                                up = up.parent
                        element = Element(name, attributes, here, here.inside or content)
                        elements.append(element)
                        levels.append(len(stack))
                    stack.append((name, element))
                    held[name] += 1
                if block:
                    turn(name, stack[-1][1] if stack else root)
                else:
                    found[-1].tags.append(name)
                    if name == "br":
                        found[-1].parts.append(" ")
            elif held[name] > 0:
                k = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)
                cut(k)
        elif raw:
            found[-1].tags.append(raw.lower())
    for b in found:
        b.text = text_of(b)
        b.element.words += b.text.count(" ") + 1 if b.text else 0
    for e in reversed(elements):  # children come after their parents
        if e.parent is not None:
            e.parent.words += e.words
    return found, elements, marked


def text_of(b: Block) -> str:
    t = "".join(b.parts)
    return " ".join((unescape(t) if "&" in t else t).split())


def best_run(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the largest sum: the first, and of those the longest."""
    best, at, run, start = float("-inf"), (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if run < 0:
            run, start = 0.0, i
        run += s
        if run > best or run == best and start == at[0]:
            best, at = run, (start, i + 1)
    return at if best > 0 else (0, 0)


def _weigh(elements: list[Element], marked: bool, weights: dict[str, float]) -> None:
    """What each word in an element pays."""
    content = sum(e.words for e in elements if e.inside and not (e.parent and e.parent.inside)) if marked else elements[0].words
    outside = weights.get(OUTSIDE, FIXED_WEIGHT)
    for e in elements:
        own = 0.0
        if not e.holds:
            most = 2 * e.words > content and (e.inside or not marked)
            own = min(0.0, *(weights.get(k, 0.0) for k in e.keys)) if not most else 0.0
            if e.fixed or e.named and not most:
                own = min(own, FIXED_WEIGHT)
        if marked and not e.inside:
            own = min(own, outside) if e.parent is None or e.holds or e.parent.holds else own
        # what a holder pays for loose text isn't paid by its parts
        up = e.parent
        e.pays = own + (up.pays if up is not None and not (up.holds or marked and up.parent is None) else 0.0)


def scored(html: str, weights: dict[str, float], default: float = DEFAULT) -> tuple[list[Block], list[float]]:
    """The page's blocks and their scores."""
    found, elements, marked = blocks(html)
    _weigh(elements, marked, weights)
    scores = []
    for b in found:
        n = b.text.count(" ") + 1 if b.text else 0
        one = WORD + b.element.pays
        scores.append(n * (max(0.0, one) if b.element.inside else one) + (INSIDE if b.element.inside else 1.0) * sum(w if g in BLOCK else max(w, INLINE) for g in b.tags for w in (weights.get(f"<{g}", default),)))
    return found, scores


def main_text(html: str | None, weights: dict[str, float], default: float = DEFAULT, *, run=best_run, nested: bool = True) -> str:
    """The text of the run's blocks; without ``nested`` nothing inside the run is left out."""
    if not html:
        return ""
    found, scores = scored(html, weights, default)
    s, e = run(scores)
    return "\n".join(b.text for b in found[s:e] if b.text and (WORD + b.element.pays > 0 or not nested))


def _counted(html: str, count: Counter[tuple[str, bool]]) -> None:
    """Adds a labelled page: (tag or element, whether in content) and how often, or with how many words."""
    found, elements, marked = blocks(html)
    if not marked:
        return
    for b in found:
        for g in b.tags:
            if len(g) <= 12:
                count[f"<{g}", b.element.inside] += 1
    for e in elements:
        if e.parent is None:
            continue
        if e.inside or e.holds:
            for k in e.keys:
                count[k, True] += e.words
        elif e.parent.holds or e.parent.parent is None:
            for k in (*e.keys, OUTSIDE):
                count[k, False] += max(1, e.words)


def fit_weights(pages: DataFrame, *, html_col: str = "html", sample: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights from about ``sample`` pages, chosen by a hash of the page, that have one <article> or <main>."""
    every = max(1, pages.count() // sample)
    html = pages[html_col]
    some = pages.where(F.pmod(F.xxhash64(html), F.lit(every)) == 0).where(F.regexp_count(F.lower(html), F.lit("<(article|main)[ >]")) == 1).select(html.alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[tuple[str, bool]] = Counter()
        for b in slices(batches):
            for page in b.column(0).to_pylist():
                _counted(page or "", count)
        rows = list(count.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.bool_()), pa.array([n for _, n in rows], pa.int64())], names=["key", "inside", "n"])

    counts = some.mapInArrow(run, "key string, inside boolean, n bigint").groupBy("key").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("o"))
    out = {}
    for r in counts.where("o > 0 or key like '<%'").orderBy(F.desc(F.col("i") + F.col("o")), "key").limit(2_000).collect():
        odds = SCALE * math.log((r.i + 1) / (r.o + 1)) - (0.0 if r.key[0] == "<" else BIAS)
        out[r.key] = max(-MOST, min(0.0, odds))
    return out


def extract(pages: DataFrame, *, html_col: str = "html", name: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    """pages without its html, with the main text."""
    small_batches(pages.sparkSession)
    weights = fit_weights(pages, html_col=html_col) if weights is None else weights
    at = pages.columns.index(html_col)
    keep = [i for i, c in enumerate(pages.columns) if c not in (html_col, name)]
    kind = T.StructType([*[pages.schema.fields[i] for i in keep], T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [main_text(h, weights) for h in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(texts, pa.string())], names=kind.names)

    return pages.mapInArrow(run, kind)
