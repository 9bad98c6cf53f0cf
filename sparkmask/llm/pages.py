"""Main text of web pages by site style trees.

Each page is read into elements with their style, the chain of tags and classes from the root. The pages of a host are
merged: for every style of a block element the tree notes, page by page, how it is presented (its children's styles in order, and
how often it occurs) and what it contains (its text, and its share of the page's words outside of links). For each
style this gives three entropies, each as a share of the entropy if every page differed: P of the child sequences, O of the
occurrences, H of the texts; and T, the mean share of words. A branch is removed from all pages of the host if its style
occurs on `n_pages` pages at least and either
- H is below `least_text`: nearly all pages say the same there, as in a notice; or
- it is a slot of the template: it occurs on nine tenths of the host's pages, and H * max(P, O, T) is below `least`, so it is built
  alike everywhere and holds little of the text, whatever it says: menus (which hold links only), adverts, footers, comment boxes.
  Headings and what lies within a marked article aren't taken for slots.

The tree gets the whole page. Beside it stands a prior for what one site can't show, such as sites of few pages: elements whose
tag or class names a part that isn't the article go, and if a page marks its article or main part, what lies outside goes too.
`n_removed` says how many branches of a page the tree removed, whether or not the prior names them.

Pages of a host that keep the same content count once, so copies of an article don't make its style look like a notice.

The tree of a host is never held anywhere: (host, style, kind, value) is counted by partial aggregation, and
only low styles, of which a site has few, go back to the pages, by a join on the host. Reading takes time and memory in
proportion to the page, however deep its elements are nested.

Defined cases: null html is empty and gives the empty text; a null or bad url has the host ''; a page
alone on its host loses only what the prior names; repeated rows are each returned and count once; unclosed tags
end with their parent (buttons, selects, frames and drawings without any closing tag after them are empty, and so are self-closed inline ones); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, table

MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
NAMES = re.compile(r"(?:\s|^)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
DIGITS = re.compile(r"\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, up to their closing tag.
RAW = frozenset("script style textarea title".split())
CLOSED = re.compile(r"(?:^|[\s\"'])/\s*$")
BLOCK = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold no article text wherever they stand.
ASIDE = frozenset("nav footer aside form menu dialog head noscript template iframe svg select button".split()) | RAW
#: Paragraphs in these don't end one around them.
HOLDS = ("noscript", "template", "iframe", "svg", "select", "button", "object")
#: A new one of these ends an open one of its group.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "button": ("button",), "select": ("select",)}
#: Words in class, id or role that name a part that isn't the article.
PARTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|login|masthead|menu|modal|nav\w*|newsletter|notices?|pagination|popup|promo\w*|related|replies|reply|search|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget|contentinfo|complementary|navigation|alert)(?:$|[\s_-])",
    re.I,
)


def named(attributes: str) -> tuple[str, bool]:
    """(class names without digits, whether a name says that this isn't the article)."""
    if not attributes.strip():
        return "", False
    cls, aside = "", False
    for m in NAMES.finditer(attributes):
        key, value = m[1].lower(), next((x for x in m.groups()[1:] if x is not None), "")
        if key == "class":
            cls = DIGITS.sub("0", " ".join(value.split()))
        aside |= key in ("hidden",) or (key == "aria-hidden" and value == "true") or (key != "aria-hidden" and bool(PARTS.search(value)))
    return cls, aside


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
TOP = 2**64 - 1


class Element:
    __slots__ = ("tag", "style", "aside", "main", "link", "parent", "kids", "words", "text")

    def __init__(self, tag: str, style: int, aside: bool, main: bool, link: bool, parent: Element | None):
        self.tag, self.style, self.aside, self.main, self.link, self.parent = tag, style, aside, main, link, parent
        #: A hash of the children's labels in order; words outside of links and a hash of the text, of the whole branch after `gather`.
        self.kids = self.words = self.text = 0


def chained(h: int, label: str) -> int:
    return xxhash.xxh3_64_intdigest(label, h)


def read(page: str, prior: bool = True) -> tuple[list[tuple[Element, str | None]], list[Element], bool]:
    """(element, text) runs in page order, with None for the text at a block's edge; elements, parents first; whether an article is marked.

    Without the prior, no element counts as aside by its tag or class names.
    """
    root = Element("", 0, False, False, False, None)
    runs: list[tuple[Element, str | None]] = []
    elements = [root]
    at, here, marked = 0, root, False
    n = len(page)
    last: dict[str, int] = {}
    opened: Counter = Counter()

    def closes(tag: str) -> bool:
        """Whether a closing tag follows: an element without one would take what follows it with it, so it is empty."""
        if tag not in last:
            last[tag] = max((x.start() for x in re.finditer(rf"</{tag}\s*>", page, re.I)), default=-1)
        return last[tag] >= at

    def leave(e: Element) -> Element:
        """The parent of e, which ends with all that is open in it."""
        x = here
        while x is not e.parent:
            opened[x.tag] -= 1
            x = x.parent
        return x

    while at < n:
        m = MARK.search(page, at)
        end = m.start() if m else n
        if end > at:
            runs.append((here, page[at:end]))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag]:
                e = here
                while e.tag != tag:
                    e = e.parent
                here = leave(e)
                if tag in BLOCK:
                    runs.append((here, None))
            continue
        if tag in VOID:
            runs.append((here, None if tag == "hr" else " "))
            continue
        if tag in BLOCK and opened["p"]:
            e = here
            while e.tag and e.tag != "p" and e.tag not in ("div", "td", "th", "li", "article", "section", "body", *HOLDS):
                e = e.parent
            if e.tag == "p":
                here = leave(e)
        group = ENDS.get(tag, ())
        if any(opened[x] for x in group):
            e = here
            while e.tag and e.tag not in group and e.tag not in ("ul", "ol", "dl", "table"):
                e = e.parent
            if e.tag in group:
                here = leave(e)
        cls, aside = named(m[3])
        main = here.main or tag in ("article", "main")
        marked |= tag in ("article", "main")
        aside = prior and (here.aside or tag in ASIDE or (tag == "header" and not here.main) or (aside and tag not in ("body", "html", "article", "main")))
        label = f"{tag}.{cls}" if cls else tag
        here.kids = chained(here.kids, label)
        new = Element(tag, chained(here.style, label), aside, main, here.link or tag == "a", here)
        elements.append(new)
        closed = tag not in BLOCK and bool(CLOSED.search(m[3]))
        if closed or (tag in ASIDE and tag not in BLOCK | RAW and not closes(tag)):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        here = new
        opened[tag] += 1
        if tag in BLOCK:
            runs.append((here, None))
    return runs, elements, marked


def plain(text: str | None) -> str | None:
    return htmllib.unescape(text) if text and "&" in text else text


def gather(runs: list[tuple[Element, str | None]], elements: list[Element]) -> None:
    """Sums words and hashes of texts into every branch: what a run adds doesn't depend on its place, so sums go up once."""
    for e, t in runs:
        if t is not None and (words := plain(t).split()):
            e.words += 0 if e.link else len(words)
            e.text = (e.text + xxhash.xxh3_64_intdigest(" ".join(words))) & TOP
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.words += e.words
            e.parent.text = (e.parent.text + e.text) & TOP


def text_of(runs, elements: list[Element], marked: bool, low: frozenset[int] = frozenset()) -> tuple[str, int]:
    """The page's text without the branches of low styles and what the prior names; how many such branches there are."""
    gone: dict[int, bool] = {}
    branches = 0
    if low:
        for e in elements:
            above = e.parent is not None and gone[id(e.parent)]
            gone[id(e)] = above or (e.tag in BLOCK and signed(e.style) in low)
            branches += gone[id(e)] and not above
    blocks: list[str] = []
    part: list[str] = []
    for e, t in runs:
        if t is None:
            if part and (block := " ".join("".join(part).split())):
                blocks.append(block)
            part = []
        elif not e.aside and (e.main or not marked) and not (low and gone[id(e)]):
            part.append(plain(t))
    if part and (block := " ".join("".join(part).split())):
        blocks.append(block)
    return "\n".join(blocks), branches


def extract(page: str | None, low: frozenset[int] = frozenset(), prior: bool = True) -> tuple[str, int]:
    runs, elements, marked = read(page or "", prior)
    return text_of(runs, elements, marked and prior, low)


def signed(h: int) -> int:
    return h - 2**64 if h >= 2**63 else h


def styles_of(page: str | None) -> dict[int, tuple[int, int, int, float]]:
    """Of each block style of a page: a hash of its child sequences, its occurrences, a hash of its texts, its share of the words outside of links."""
    runs, elements, _ = read(page or "", prior=False)
    gather(runs, elements)
    total = max(1, elements[0].words)
    found: dict[int, list] = {}
    for e in elements:
        if e.tag in BLOCK or e.parent is None:  # a word in bold that every page has is part of its sentence
            x = found.setdefault(e.style, [0, 0, 0, 0.0])
            x[0] = chained(x[0], str(e.kids))
            x[1] += 1
            x[2] = (x[2] + e.text) & TOP
            x[3] += 1.0 if e.main or e.tag in HEADINGS or e.parent is None else e.words / total
    return {style: (a, n, text, min(1.0, share)) for style, (a, n, text, share) in found.items()}


def presented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) -> (host, content, styles, shown, times, filled, share): a page's styles, and a hash of all that it keeps."""
    kinds = [pa.int64()] * 4 + [pa.float64()]
    for batch in batches:
        content: list[int] = []
        rows: list[list] = [[], [], [], [], []]
        for page in batch.column("html").to_pylist():
            found = styles_of(page)
            content.append(signed(xxhash.xxh3_64_intdigest(repr(sorted(found.items())))))
            values = [signed(x) for x in found], [signed(x[0]) for x in found.values()], [x[1] for x in found.values()], [signed(x[2]) for x in found.values()], [x[3] for x in found.values()]
            for column, value in zip(rows, values, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(content, pa.int64()), *(pa.array(x, pa.list_(kind)) for x, kind in zip(rows, kinds, strict=True))], ["host", "content", "styles", "shown", "times", "filled", "share"])


def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [extract(page, frozenset(low or ())) for page, low in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist(), strict=True)]
        text, n = [x for x, _ in out], [x for _, x in out]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64()), pa.array(n, pa.int64())], ["page_id", "url", "text", "n_chars", "n_removed"])


def low_styles(pages: DataFrame, least: float, least_text: float, n_pages: int) -> DataFrame:
    """(host, style): the hashes of the styles of low importance; equal pages of a host count once."""
    rows = pages.select("host", "html").mapInArrow(presented, "host string, content long, styles array<long>, shown array<long>, times array<long>, filled array<long>, share array<double>")
    once = rows.groupBy("host", "content").agg(F.first(F.struct("styles", "shown", "times", "filled", "share")).alias("p"))  # what is equal in content is equal in these
    style = once.select("host", F.explode(F.arrays_zip("p.styles", "p.shown", "p.times", "p.filled", "p.share")).alias("p")).select("host", "p.*")
    style = style.select("host", F.col("styles").alias("style"), "share", F.explode(F.create_map(F.lit(0), "shown", F.lit(1), "times", F.lit(2), "filled")).alias("kind", "value"))
    value = style.groupBy("host", "style", "kind", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("share").alias("share"))
    each = value.groupBy("host", "style", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("x"), F.sum("share").alias("share"))
    each = each.withColumn("e", F.when(F.col("m") > 1, (F.log("m") - F.col("x") / F.col("m")) / F.log("m")).otherwise(1.0))
    of = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    node = each.groupBy("host", "style").agg(of(0, "m").alias("m"), of(0, "e").alias("p"), of(1, "e").alias("o"), of(2, "e").alias("h"), (of(0, "share") / of(0, "m")).alias("t"))
    size = node.where("style = 0").select(F.col("host").alias("_host"), F.col("m").alias("_all"))  # every page has a root
    node = node.where((F.col("m") >= n_pages) & (F.col("style") != 0)).join(size, F.col("host") == F.col("_host"))
    slot = (F.col("m") >= 0.9 * F.col("_all")) & (F.col("h") * F.greatest("p", "o", "t") < least)
    return node.where((F.col("h") < least_text) | slot).select("host", "style")


def main_text(pages: DataFrame, least: float = 0.2, least_text: float = 0.1, n_pages: int = 8) -> DataFrame:
    """page_id, url, text, n_chars and n_removed of each row of pages (page_id, url, html, ...)."""
    scratch = Scratch(pages.sparkSession, "pages")
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit("")).alias("host"))
    found = scratch.write(low_styles(rows, least, least_text, n_pages), "low")
    low = found.groupBy(F.col("host").alias("_host")).agg(F.collect_set("style").alias("low"))
    low = F.broadcast(low) if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else low
    out = rows.join(low, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "low")
    kinds = dict(rows.dtypes)
    return out.mapInArrow(extracted, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_removed long")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
