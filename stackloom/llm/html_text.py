"""HTML extraction: flat text blocks, classified by a decision tree trained on a small labelled table.

A page becomes a flat list of text blocks. The tree (CART, Gini impurity) sees of each block its words and link
density, those of two blocks before and after, whether it ends as a sentence, its element kind (paragraph, heading, item, or bare
text of a container), whether an element made for page furniture or for main text (nav, footer, form; article, main) lies
around it, and where a class or id names a region of the page: what share of the page's text that region holds, and its
words and links. Names alone decide nothing: an element that holds most of the text is the text, whatever it is called. The
labelled table is html_samples.py, where data-main marks what belongs to the main text.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm.common import ready, rows_bytes, slices
from stackloom.llm.html_samples import SAMPLES

# Element names and words that mark regions of pages (fixed values of HTML and of common page templates).
SKIPPED = frozenset("script style title noscript template textarea select svg math iframe object canvas audio video datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul caption".split())
ENDS_P = BLOCKS - {"body", "head", "html", "option", "optgroup", "tbody", "tfoot", "thead", "tr", "caption"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
EDGE_TAGS = frozenset("nav footer aside form menu dialog button fieldset label legend".split())
EDGE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist status".split())
EDGE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adbox adsense sponsor sponsors sponsored promo promos promoted promotion banner
    cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay toast paywall newsletter subscribe subscription signup
    signin login register sidebar sidebars rail widget widgets aside menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toc
    footer foot copyright legal disclaimer masthead topbar toolbar comment comments commentlist respond reply replies disqus discussion feedback share sharing
    social related recommended recommendations trending popular teaser teasers tagcloud search skip hidden form forms""".split()
)
HEAD_WORDS = frozenset("header head".split())
MAIN_TAGS = frozenset("article main".split())
MAIN_WORDS = frozenset("article articlebody content post entry story main text body".split())
#: What follows these in a name tells what is or isn't there, not what the element is; the second begin names of a subject.
STATE_WORDS = frozenset("has no with without".split())
SUBJECT_WORDS = frozenset("category tag".split())
ITEMS = frozenset("li dd dt td th blockquote pre figcaption caption".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
#: Tags whose quotes never close that are looked for to the end of the page; after so many, a tag ends at its first >.
UNCLOSED = 16
_PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Block:
    """A stretch of text between block tags and what surrounds it; region: number of the named region, -1 without."""

    text: str
    words: int
    linked: int
    furniture: bool
    main: bool
    heading: bool
    paragraph: bool
    item: bool
    region: int
    label: bool


def _named(names: list[list[str]], inside_main: bool) -> bool:
    """Whether names of an element, each as its words, tell of a region of the page rather than of its state or subject."""
    told: set[str] = set()
    for n in names:
        if n[0] not in SUBJECT_WORDS:
            told.update(n[: next((i for i, p in enumerate(n) if p in STATE_WORDS), len(n))])
    return bool(told & EDGE_WORDS) or (not inside_main and bool(told & HEAD_WORDS) and not any(set(n) & MAIN_WORDS for n in names))


def _marks(tag: str, attrs: str, inside_main: bool) -> tuple[bool, bool, bool, bool]:
    """(furniture, main part, named region, labelled as main) of an element."""
    furniture, main = tag in EDGE_TAGS or (tag == "header" and not inside_main), tag in MAIN_TAGS
    label = False
    names: list[list[str]] = []
    if attrs and attrs.strip("/ \n\t"):
        for name, *values in _ATTR.findall(attrs):
            name, value = name.lower(), "".join(values)
            if name in ("class", "id"):
                if tag not in ("html", "body", "main"):  # names of the whole page or of its text mark no part of it
                    names += [w for n in value.split() if (w := [p.lower() for p in _PART.findall(n)])]
            elif name == "role":
                furniture |= value.lower() in EDGE_ROLES and not (value.lower() == "banner" and inside_main)
                main |= value.lower() in ("main", "article")
            elif name == "itemprop":
                main |= value == "articleBody"
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                furniture = True
            elif name == "data-main":
                label = True
    return furniture, main and not furniture, bool(names) and _named(names, inside_main), label


class _Open:
    """The open elements, with counts by tag and places of each, so that no step looks through all of them."""

    def __init__(self) -> None:
        # tag, blocks up to it, furniture, main, region, label: of it or anything around it
        self.stack: list[tuple[str, int, bool, bool, int, bool]] = []
        self.places: dict[str, list[int]] = {}

    @property
    def top(self) -> tuple[str, int, bool, bool, int, bool]:
        return self.stack[-1] if self.stack else ("", 0, False, False, -1, False)

    def push(self, tag: str, furniture: bool, main: bool, region: int, label: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, self.top[1] + (tag in BLOCKS), furniture, main, region, label))

    def cut(self, k: int) -> None:
        while len(self.stack) > k:
            self.places[self.stack.pop()[0]].pop()

    def last(self, *tags: str) -> int:
        """Place of the innermost open element of these tags, or -1."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def has(self, tags) -> bool:
        return any(self.places.get(t) for t in tags)


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, with character references decoded and white space made single spaces."""
    out: list[Block] = []
    open_ = _Open()
    text: list[str] = []
    linked: list[str] = []
    regions = unclosed = 0

    def flush() -> None:
        if text:
            words = html.unescape("".join(text)).split()
            if words:
                _, _, furniture, main, region, label = open_.top
                n = len(words)
                out.append(Block(" ".join(words), n, min(n, len(html.unescape(" ".join(linked)).split())), furniture, main, open_.has(HEADINGS), open_.has(("p",)), open_.has(ITEMS), region, label))
            text.clear()
            linked.clear()

    def add(s: str) -> None:
        if s:
            text.append(s)
            if open_.places.get("a"):
                linked.append(s)

    at, n, end = 0, len(page), page.rfind(">")
    while at < n:
        m = (_TOKEN if unclosed < UNCLOSED else _PLAIN).search(page, at) if at <= end else None
        if not m:
            rest = page.find("<!", at)  # a comment that never closes takes the rest
            add(page[at:] if rest < 0 else page[at:rest])
            break
        add(page[at : m.start()])
        at = m.end()
        closing, tag, attrs = m[1], m[2], m[3]
        if tag is None and m.re is _TOKEN and m[5] is not None:
            closing, tag, attrs = m[4], m[5], m[6]
            unclosed += 1
        if not tag:
            continue
        tag, attrs = tag.lower(), attrs or ""
        if closing:
            k = open_.last(tag)
            if tag in BLOCKS:
                flush()
                if k >= 0:
                    open_.cut(k)
            elif k >= 0 and open_.top[1] == open_.stack[k][1]:  # no block opened since
                before = open_.stack[k - 1] if k else ("", 0, False, False, -1, False)
                if open_.stack[k][2] != before[2] or open_.stack[k][4] != before[4]:
                    flush()  # what a marked inline element held is a block of its own
                open_.cut(k)
            continue
        if tag in SKIPPED:
            if not attrs.endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else n
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br" and text:
                text.append(" ")
            continue
        if tag in ("td", "th"):
            text.append(" ")
        if tag in BLOCKS:
            flush()
            k = open_.last("p")
            if tag in ENDS_P and k >= 0 and open_.top[1] == open_.stack[k][1]:  # an open paragraph ends where a block begins
                open_.cut(k)
            if tag in ("li", "dd", "dt", "tr") and (k := open_.last(tag)) > open_.last("ul", "ol", "dl", "table", "menu"):
                open_.cut(k)
        _, _, around, inside, region, labelled = open_.top
        furniture, main, named, label = _marks(tag, attrs, inside)
        if (furniture or named) and tag not in BLOCKS:
            flush()
        if not attrs.endswith("/") or tag in BLOCKS:
            if named:
                regions += 1
                region = regions
            open_.push(tag, around or furniture, inside or main, region, labelled or label)
    flush()
    return out


FEATURES = (
    "words", "links", "words_before", "links_before", "words_before_2", "links_before_2", "words_after", "links_after", "words_after_2", "links_after_2", "sentence",
    "furniture", "main", "page_has_main", "heading", "paragraph", "item", "bare_share", "named", "region_share", "region_links",
)


def table(page: list[Block]) -> np.ndarray:
    """Feature rows of a page's blocks.

    Shares are of the words outside links of what may be main text: the blocks without furniture, inside the page's main
    elements where it has any. bare_share is, for text that is neither paragraph, heading nor item, the share of such
    text; region_share that of the named region around a block, 1 where there is none.
    """
    if not page:
        return np.zeros((0, len(FEATURES)))
    words, linked = np.array([b.words for b in page], float), np.array([b.linked for b in page], float)
    flags = np.array([[b.furniture, b.main, b.heading, b.paragraph, b.item] for b in page], bool)
    furniture, main, heading, paragraph, item = flags.T
    has_main = bool((main & ~furniture).any())
    plain = np.where(~furniture & (main | (not has_main)), words - linked, 0.0)
    whole = max(plain.sum(), 1.0)
    bare = ~(heading | paragraph | item)
    region = np.array([b.region for b in page])
    _, at = np.unique(region, return_inverse=True)
    share = np.where(region < 0, 1.0, (np.bincount(at, plain) / whole)[at])
    inside = np.where(region < 0, 0.0, (np.bincount(at, linked) / np.bincount(at, words))[at])
    w = np.concatenate([[0.0, 0.0], words, [0.0, 0.0]])
    d = np.concatenate([[0.0, 0.0], linked / words, [0.0, 0.0]])
    n = len(page)
    near = [x[i : i + n] for i in (2, 1, 0, 3, 4) for x in (w, d)]
    ends = np.array([b.text.rstrip("\"')]»”’")[-1:] in (".", "!", "?", "…", ":", ";") for b in page])
    return np.column_stack([*near, ends, furniture, main, np.full(n, has_main), heading, paragraph, item, np.where(bare, plain[bare].sum() / whole, 1.0), region >= 0, share, inside]).astype(float)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """Decision tree by Gini impurity: a leaf is its majority, a node (feature, threshold, below, above)."""
    if depth == 0 or y.min() == y.max():
        return bool(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < cut
            gini = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            if best is None or gini < best[0] - 1e-12:
                best = gini, f, float(cut), low
    if best is None:
        return bool(y.mean() >= 0.5)
    _, f, cut, low = best
    return f, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def judge(tree, row) -> bool:
    while not isinstance(tree, bool):
        f, cut, below, above = tree
        tree = below if row[f] < cut else above
    return tree


def printed(tree, indent: str = "") -> str:
    """The tree as text, a line a node."""
    if isinstance(tree, bool):
        return f"{indent}{'main' if tree else 'other'}\n"
    f, cut, below, above = tree
    return f"{indent}{FEATURES[f]} < {cut:.3g}\n" + printed(below, indent + "  ") + printed(above, indent + "  ")


def labelled(samples=SAMPLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, template of each) of the blocks of labelled pages."""
    pages = [(k, blocks(p)) for k, made in enumerate(samples) for p in made]
    return np.vstack([table(p) for _, p in pages]), np.array([b.label for _, p in pages for b in p], float), np.array([k for k, p in pages for _ in p])


def trained():
    """The tree of the labelled table."""
    x, y, _ = labelled()
    return grow(x, y)


def held_out() -> tuple[float, float]:
    """(recall, precision) of main blocks, each template judged by a tree of the others."""
    x, y, k = labelled()
    told = np.zeros(len(y), bool)
    for t in np.unique(k):
        tree = grow(x[k != t], y[k != t])
        told[k == t] = [judge(tree, r) for r in x[k == t].tolist()]
    return float(told[y > 0].mean()), float(y[told].mean())


def main_text(page: str, tree) -> tuple[str, int]:
    """(main text, number of its blocks) of a page."""
    found = blocks(page)
    kept = [b.text for b, row in zip(found, table(found).tolist()) if judge(tree, row)]
    return "\n".join(kept), len(kept)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars, n_blocks.

    Null and empty pages, and pages without main text, give an empty text. Unclosed tags and comments end with the page
    or where HTML lets them end; a bare < is text. page_id and url come back as they are, nulls and repeats included;
    further columns are ignored.
    """
    tree = trained()
    ready(pages.sparkSession)

    def run(batches):
        for batch in (x for b in batches for x in slices(b, 2)):
            found = [main_text(t.decode(), tree) for t in rows_bytes(batch.column(2))]
            text = [t for t, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array([n for _, n in found], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_blocks"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long")


def op2_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
