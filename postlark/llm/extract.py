"""Main text of web pages by a maximum-scoring run of words and tags.

A page is read as a sequence of runs of words and tags. Words score above zero and tags
below; one linear scan finds the contiguous region with the highest sum, the article. The
weights come from labelled pages: pages that mark their main part themselves, with one
``<article>`` or else one ``<main>``. For every kind of word (the block and the part of
the page it stands in, in a link or not) and of tag (name, opening or closing, what its
class says) they are counted inside and outside of the marked region over all pages.

* A word's weight is the logarithm of its odds to be inside, ``LEAST`` at the least.
* A tag's weight is the same logarithm, ``-LEAST`` at the most. Tags that begin or end
  marked regions cost up to ``BOUNDARY`` of a mean region more, so that a region crosses
  them only for text that is worth it.
* Kinds the labelled pages lack get ``UNSEEN_TAG`` times the mean weight of a word inside,
  or that weight; inline tags, line breaks, images and scripts divide nothing and cost
  ``LEAST``, as do tags inside a part that is left out. Without labelled pages a word
  scores 1 and a tag -3.25.

Inside the region the text of menus, page headers, footers, sidebars, notices, adverts,
forms and reader comments is left out, known by element, role or a word of the class or id.
A header inside an article belongs to it. Character references are decoded after the tags
are taken out, white space inside a block becomes one space, blocks (and lines broken by
``<br>``) are joined by one space, inline tags by none.

Scale: two passes over the pages, each a map without a shuffle of rows. Only sums per kind,
of which there are at most a few hundred, are shuffled and reach the driver. Reading a page
takes time and memory in proportion to it.

Defined cases: NULL and empty pages give an empty text, as do pages without words. Tags that
are never closed end with the element around them, scripts, styles and comments at the end
of the page; a ``<`` that begins no tag is text. Repeated rows and NULL ids are rows like
others. Of equal regions the first counts. An empty table gives no rows. Other columns of
the pages are neither read nor returned.
"""

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlark.llm.common import slices, stored

LEAST = 0.05
UNSEEN_TAG = -3.25
BOUNDARY = 0.5

# Fixed values of HTML: elements whose text is no markup, elements without content, inline
# elements, and elements that a head cannot hold.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp "
    "small span strike strong sub sup time tt u var img wbr".split()
)
HEAD_ONLY = {"head", "meta", "link", "base", "title", "style", "script", "noscript", "template"}

# Elements that hold others, and what a part of a page is by its element alone.
NESTED = set(
    "html body div section article main nav header footer aside form ul ol dl table dialog menu "
    "blockquote figure head select button svg math template fieldset details center object video "
    "audio canvas".split()
)
PARTS = {
    "nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "sidebar",
    "form": "form", "select": "form", "button": "form", "dialog": "notice", "head": "head",
    "svg": "other", "math": "other", "template": "other", "object": "other", "video": "other",
    "audio": "other", "canvas": "other",
}
# Parts in which even an article is none of the page's own, such as a teaser.
_FIRM = {"footer", "aside", "form", "dialog", "template"}
ROLES = {
    "navigation": "menu", "menu": "menu", "menubar": "menu", "banner": "header",
    "contentinfo": "footer", "complementary": "sidebar", "search": "form", "form": "form",
    "alert": "notice", "dialog": "notice", "alertdialog": "notice",
}

# What a class or id says about a part of a page, by one of the words it is made of.
HINTS = {
    word: part
    for part, words in {
        "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager topbar",
        "header": "header masthead",
        "footer": "footer colophon copyright",
        "sidebar": "sidebar aside widget widgets related recommended recommendations trending share sharing social",
        "notice": "notice notices cookie cookies consent gdpr alert banner popup modal newsletter subscribe paywall toast",
        "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo adsbygoogle",
        "form": "form search login signup",
        "comment": "comment comments commentlist disqus discussion replies reply respond",
    }.items()
    for word in words.split()
}
# With one of these words beside it, a class names a layout or a part of the article.
NO_HINT = {"with", "has", "no", "article", "entry", "post", "content", "main", "story"}

_MARK = re.compile(
    r"""<(?:(/?)([A-Za-z][^\s/<>]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>|!--.*?(?:-->|\Z)|[!?/][^>]*(?:>|\Z))""",
    re.DOTALL,
)
_LOOSE = re.compile(
    r"<(?:(/?)([A-Za-z][^\s/<>]*)([^<>]*)>|!--.*?(?:-->|\Z)|[!?/][^>]*(?:>|\Z))", re.DOTALL
)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for name in RAW}
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORD_ENDS = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")

_BLOCKS = {"p": "p", "li": "li", "dd": "li", "dt": "li", "td": "td", "th": "td"} | {
    f"h{n}": "h" for n in range(1, 7)
}
_TAGS = NESTED | INLINE | VOID | RAW | _BLOCKS.keys() | {"pre", "tr", "tbody", "thead", "figcaption", "address"}


def _hint(attributes: str) -> str:
    """The part of a page that a tag's class, id or role names, or nothing."""
    for name, *values in _NAMES.findall(attributes):
        value = "".join(values)
        if name.lower() == "role":
            if value.lower() in ROLES:
                return ROLES[value.lower()]
            continue
        for one in value.split():
            words = {word.lower() for word in _WORD_ENDS.split(one)}
            if not words & NO_HINT:
                for word in sorted(words):
                    if word in HINTS:
                        return HINTS[word]
    return ""


class Page:
    """A page as parallel lists, an entry per tag or run of text.

    ``kinds`` what is scored, ``sizes`` words (0 for tags), ``texts`` None for tags and else
    the text, ``breaks`` whether a block begins or ends, ``parts`` the part of the page
    (empty: possibly the article), ``marked`` the number of the article it stands in, or 0.
    """

    def __init__(self, source: str):
        self.kinds, self.sizes, self.texts = [], [], []
        self.breaks, self.parts, self.marked = [], [], []
        self.articles = Counter()
        self._open = []  # (name, part, number of the article, whether an element says so)
        self._named = Counter()
        self._block, self._links = "-", 0
        self._read(source)

    def _read(self, source: str) -> None:
        pattern, start, at = _MARK, 0, 0
        while (at := source.find("<", at)) >= 0:
            mark = pattern.match(source, at)
            if mark is None:
                # A quote that never ends makes the strict form read on to the end of the
                # page, so it is tried no more after that.
                if at + 1 < len(source) and (source[at + 1].isalpha() or source[at + 1] == "/"):
                    pattern = _LOOSE
                    mark = pattern.match(source, at)
                if mark is None:
                    at += 1
                    continue
            self._text(source[start:at])
            at = mark.end()
            name = mark[2]
            if name:
                name = name.lower()
                if mark[1]:
                    self._close(name)
                elif name in RAW:
                    self._tag(name, "", False)
                    end = _RAW_END[name].search(source, at)
                    at = end.end() if end else len(source)
                else:
                    self._opened(name, mark[3])
            start = at
        self._text(source[start:])

    def _top(self) -> tuple:
        return self._open[-1] if self._open else ("", "", 0, False)

    def _add(self, kind, size, text, breaks, part="") -> None:
        _, around, article, _ = self._top()
        part = part or around
        self.kinds.append(kind)
        self.sizes.append(size)
        self.texts.append(text)
        self.breaks.append(breaks)
        self.parts.append(part)
        self.marked.append(article)

    def _text(self, text: str) -> None:
        if text:
            link = "a" if self._links else ""
            self._add(f"w:{self._top()[1]}:{self._block}:{link}", len(text.split()), text, False)

    def _tag(self, name: str, hint: str, closing: bool, part: str = "") -> None:
        # Inside a part that is left out anyway, tags say nothing more.
        shown = name if name in _TAGS else "other"
        around = self._top()[1]
        kind = f"t:{'/' if closing else ''}{shown}:{hint}" if not around else f"t:inner:{around}"
        self._add(kind, 0, None, name not in INLINE, part)

    def _opened(self, name: str, attributes: str) -> None:
        if name not in INLINE:
            if self._top()[0] == "p":
                self._pop("p")
            if name not in HEAD_ONLY and name != "html" and self._named["head"]:
                self._pop("head")
            self._block = _BLOCKS.get(name, "-")
        elif name == "a":
            self._links = 1
        hint = _hint(attributes) if attributes and name not in ("html", "body", "main") else ""
        if name == "article" and hint != "comment":
            hint = ""
        _, part, article, firm = self._top()
        if name not in VOID and (name in NESTED or hint or self._named[name]):
            own = PARTS.get(name) or hint
            if name in ("article", "main") and not hint and not firm:
                part = ""
                if not article:
                    self.articles[name] += 1
                    article = (self.articles[name] << 1) | (name == "main")
            elif not part and own and not (own == "header" and article):
                part, firm = own, name in _FIRM
            self._tag(name, hint, False, part)
            self._open.append((name, part, article, firm))
            self._named[name] += 1
        else:
            self._tag(name, hint, False)

    def _close(self, name: str) -> None:
        if name == "a":
            self._links = 0
        elif name not in INLINE:
            self._block = "-"
        part = self._top()[1]
        if self._named[name]:
            self._pop(name)
        self._tag(name, "", True, part)

    def _pop(self, name: str) -> None:
        while self._open:
            last = self._open.pop()[0]
            self._named[last] -= 1
            if last == name:
                return

    def region(self) -> tuple[int, int] | None:
        """Bounds of the part the page itself marks as its article, if it marks just one."""
        name = "article" if self.articles["article"] else "main"
        if self.articles[name] != 1:
            return None
        number = 2 | (name == "main")
        inside = [i for i, one in enumerate(self.marked) if one == number and not self.parts[i]]
        return (inside[0], inside[-1] + 1) if inside else None

    def best(self, weights: "Weights") -> tuple[int, int] | None:
        """Bounds of the contiguous region with the highest score, the first of equal ones."""
        best, found, total, start = 0.0, None, 0.0, 0
        for i, (kind, size) in enumerate(zip(self.kinds, self.sizes)):
            if total <= 0:
                total, start = 0.0, i
            total += weights.score(kind, size)
            if total > best:
                best, found = total, (start, i + 1)
        return found

    def text(self, bounds: tuple[int, int] | None) -> str:
        if bounds is None:
            return ""
        pieces = []
        for i in range(*bounds):
            if self.breaks[i]:
                pieces.append(" ")
            elif self.texts[i] is not None:
                pieces.append(" " if self.parts[i] else entities.unescape(self.texts[i]))
        return " ".join("".join(pieces).split())


class Weights:
    """What a word or tag of each kind scores."""

    def __init__(self, sums: dict[str, tuple[int, int, int]], pages: int):
        """``sums``: per kind how often it is inside, outside, and next to a marked region."""
        self._known = {}
        tags = {kind: n for kind, n in sums.items() if kind.startswith("t:")}
        words = {kind: n for kind, n in sums.items() if kind.startswith("w:")}
        for kind, (n_in, n_out, _) in words.items():
            self._known[kind] = max(LEAST, self._odds(n_in, n_out))
        inside = sum(n for n, _, _ in words.values())
        total = sum(n * self._known[kind] for kind, (n, _, _) in words.items())
        self.word = total / inside if inside else 1.0
        region = total / pages if pages else 0.0
        for kind, (n_in, n_out, beside) in tags.items():
            crossing = BOUNDARY * region * beside / max(n_in + n_out, 1)
            self._known[kind] = min(-LEAST, self._odds(n_in, n_out)) - crossing

    @staticmethod
    def _odds(n_in: int, n_out: int) -> float:
        return math.log((n_in + 1) / (n_out + 1))

    def score(self, kind: str, size: int) -> float:
        weight = self._known.get(kind)
        if kind[0] == "w":
            return size * (self.word if weight is None else weight)
        if weight is not None:
            return weight
        name = kind.removeprefix("t:").removeprefix("/").partition(":")[0]
        flows = kind.endswith(":") and (name in INLINE or name in RAW or name in VOID)
        return -LEAST if flows or name == "inner" else UNSEEN_TAG * self.word


def fit(pages: DataFrame) -> Weights:
    """Weights from all pages that mark their article themselves."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside, beside, n = Counter(), Counter(), Counter(), 0
        for batch in batches:
            for piece in slices(batch, "html"):
                for source in piece.column("html"):
                    page = Page(source.as_py() or "")
                    bounds = page.region()
                    if bounds is None:
                        continue
                    n += 1
                    first, last = bounds
                    for i, kind in enumerate(page.kinds):
                        found = inside if first <= i < last else outside
                        found[kind] += page.sizes[i] or (kind[0] == "t")
                    for i in (first - 1, last):
                        if 0 <= i < len(page.kinds) and page.kinds[i][0] == "t":
                            beside[page.kinds[i]] += 1
        kinds = sorted(inside.keys() | outside.keys())
        rows = [("", n, 0, 0)] + [(k, inside[k], outside[k], beside[k]) for k in kinds]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.string(), *[pa.int64()] * 3))],
            ["kind", "inside", "outside", "beside"],
        )

    counted = pages.select("html").mapInArrow(count, "kind string, inside long, outside long, beside long")
    names = ("inside", "outside", "beside")
    sums = counted.groupBy("kind").agg(*[F.sum(name).alias(name) for name in names]).collect()
    by_kind = {row.kind: tuple(row[name] for name in names) for row in sums}
    pages_used = by_kind.pop("", (0, 0, 0))[0]
    return Weights(by_kind, pages_used)


def main_text(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page; ``weights`` are fitted if not given."""
    if weights is None:
        weights = fit(pages)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "html"):
                texts = []
                for source in piece.column("html"):
                    page = Page(source.as_py() or "")
                    texts.append(page.text(page.best(weights)))
                text = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("page_id"), piece.column("url"), text, pc.utf8_length(text).cast(pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
