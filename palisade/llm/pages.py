"""Main text of web pages: site template removal.

Each task parses its pages to a list of elements and text blocks and hashes the
subtree of every element. Spark counts, for each host, on how many different
pages a subtree recurs (copies of a page count once); those that recur on many pages of the host are its template and
are deleted. What a site repeats with other words on each page (menus, adverts,
comments) is known by its element or its class names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import checkpointed
from .tables import table

#: A subtree is template if it occurs on so many different pages of the host and on this share of them at least.
MIN_PAGES, MIN_SHARE = 5, 0.3
#: Template subtrees (16 bytes and a host number each) that may be broadcast; more are joined by shuffle.
BROADCAST_SUBTREES = 500_000

#: HTML elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BOILERPLATE = frozenset(
    "head title script style noscript template iframe nav header footer aside form button select option input "
    "textarea menu dialog svg canvas object embed audio video map".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rb rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
#: Elements that end no block of text: the inline ones, and what is never shown.
FLOWING = INLINE | {"script", "style", "template"}
CONTENT = frozenset(("article", "main"))
#: Elements that their names never make noise. An article is noise by its names only beside or in another one.
ROOTS = CONTENT | {"html", "body"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that can be a site's template inside an article.
PARTS = frozenset("aside div footer form header nav section".split())
#: A start tag of one of these ends an open element of the set before it, up to the fence.
CLOSES = {
    "p": ({"p"}, {"article", "section", "div", "td", "th", "li", "body", "button", "blockquote"}),
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav "
    "ol pre section table ul".split()
)
#: What an author writes with: only names that wholly say advert, notice or comment make noise of these, and none of headings.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption table tr td th dl dt dd".split())
#: Class, id or role names that mark what a site says anew on every page beside its articles (menus, adverts, notices,
#: comments), which no count of equal subtrees can tell: whole names, made of such words and of those that say where
#: or what it is. Others, as has-sidebar or share-enabled, speak of the page.
NOISE_WORD = (
    r"(?:ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|disqus|footer|"
    r"foot|header|masthead|menu|nav|navbar|navigation|newsletter|notice|pagination|pager|popup|promo\w*|related|"
    r"replies|search|share|sharing|sidebar|social|sponsor\w*|subscribe|subscription|toc|toolbar|widget|"
    r"complementary|contentinfo)"
)
PLACE_WORD = (
    r"(?:site|page|global|main|primary|secondary|left|right|top|bottom|upper|lower|post|article|entry|blog|box|block|"
    r"list|item|area|bar|wrap|wrapper|container|inner|section|slot|unit|links?|buttons?|icons?|form|thread|posts|\d+)"
)
ASIDE_WORD = r"(?:ads?|advert\w*|adsense|comments?|cookies?|consent|newsletter|notice|promo\w*|sponsor\w*|subscribe|subscription)"
#: Inside an article a header holds the article's own headings.
HEADER_WORD = r"(?:header|masthead|banner)"


def _names(word: str) -> re.Pattern:
    return re.compile(rf"(?:^|\s)(?:{PLACE_WORD}[_-]+)*{word}(?:[_-]+(?:{word}|{PLACE_WORD}))*(?:$|\s)", re.I)


NOISE = _names(NOISE_WORD)
NOISE_INSIDE = _names(rf"(?!{HEADER_WORD}\b){NOISE_WORD}")
NOISE_ASIDE = re.compile(rf"(?:^|\s){ASIDE_WORD}(?:[_-]+{ASIDE_WORD})*(?:$|\s)", re.I)
#: Attributes up to the end of a tag. A quote opens a value only after an equals sign; one that is never closed is
#: a character of an unquoted value. All repetitions are possessive: a tag is read once.
_VALUES = {'"': r'"[^"]*+"', "'": r"'[^']*+'"}
ATTRIBUTES = {
    quotes: re.compile(r"((?:[^>=]++|=\s*+(?:" + "".join(_VALUES[q] + "|" for q in quotes) + r"[^\s>]*+))*+)>")
    for quotes in ("", '"', "'", "\"'")
}
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: One attribute: its name and, after an equals sign, its value.
ATTRIBUTE = re.compile(r"([^\s/=][^\s/=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
NO_DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.I)
SPACE = re.compile(r"\s+")


def tags(source: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of the texts (kind ""), start ("<") and end tags ("/") of a page, in one pass."""
    n, at = len(source), 0
    last = {q: source.rfind(q) for q in _VALUES}
    while at < n:
        low = source.find("<", at)
        if low < 0:
            yield "", source[at:], ""
            return
        if low > at:
            yield "", source[at:low], ""
        mark = source[low + 1 : low + 2]
        if mark in ("!", "?"):
            if source.startswith("<!--", low):
                end = source.find("-->", low + 2)
                at = end + 3 if end >= 0 else n
            elif source.startswith("<![CDATA[", low):
                end = source.find("]]>", low)
                yield "", source[low + 9 : end if end >= 0 else n], ""
                at = end + 3 if end >= 0 else n
            else:
                end = source.find(">", low)
                at = end + 1 if end >= 0 else n
            continue
        name = NAME.match(source, low + 1 + (mark == "/"))
        if name is None:
            yield "", "<", ""
            at = low + 1
            continue
        quotes = "".join(q for q in _VALUES if last[q] >= name.end())
        found = ATTRIBUTES[quotes].match(source, name.end())
        if found is None and quotes:
            # The last quote of the page may open a value that never ends.
            found = ATTRIBUTES[""].match(source, name.end())
        at = found.end() if found else n
        tag = name[0].lower()
        yield ("/" if mark == "/" else "<"), tag, found[1] if found else source[name.end() :]
        if mark != "/" and tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>?", re.I).search(source, at)
            yield "/", tag, ""
            at = end.end() if end else n


def named_and_hidden(attributes: str) -> tuple[str, bool]:
    """The class, id and role of a start tag, joined by spaces, and whether its attributes hide the element."""
    names, hidden, seen = [], False, set()
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if name in seen:
            continue  # only the first of the same name counts
        seen.add(name)
        if name in ("class", "id", "role"):
            names.append(value)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and NO_DISPLAY.search(value):
            hidden = True
    return " ".join(names), hidden


class Page:
    """A parsed page: text runs with the number of their block, and elements with where they begin and end.

    ``runs`` are (block, text). ``elements`` are (parent, tag, first run, end run,
    noise, inside content, names). With ``hashed``, ``digests`` has a hash of every subtree that holds text.
    """

    def __init__(self, source: str, hashed: bool = True):
        self.runs: list[tuple[int, str]] = []
        self.elements: list[list] = []
        self.stack: list[int] = []
        self.open: Counter[str] = Counter()
        self.block = 0
        self.hashed = hashed
        #: What each open element holds so far, and the hashes of the closed ones.
        self.inner: list[list[bytes]] = []
        self.digests: list[bytes | None] = []
        #: For each element whether its names, and whether its kind or attributes, make it noise.
        self.marks: list[tuple[bool, bool]] = []
        for kind, name, attributes in tags(source):
            if not kind:
                self._text(name)
            elif kind == "/":
                self._end(name)
            else:
                self._start(name, attributes)
                if name in VOID or attributes.endswith("/") and name not in RAW:
                    self._close(len(self.stack) - 1)
        self._close(0)
        self._settle()

    def _text(self, text: str) -> None:
        text = html.unescape(text)
        self.runs.append((self.block, text))
        if self.hashed and self.inner and (words := " ".join(text.split())):
            self.inner[-1].append(words.encode("utf-8", "surrogatepass"))

    def _start(self, tag: str, attributes: str) -> None:
        ends, fence = CLOSES.get(tag, (None, None))
        if ends or tag in CLOSES_P:
            ends, fence = ends or {"p"}, fence or {"article", "section", "div", "td", "th", "li", "body"}
            low = None
            if any(self.open[x] for x in ends):
                for i in range(len(self.stack) - 1, -1, -1):
                    name = self.elements[self.stack[i]][1]
                    if name in ends:
                        low = i
                    if name in fence and name not in ends:
                        break
            if low is not None:
                self._close(low)
        if tag not in FLOWING:
            self.block += 1
        parent = self.stack[-1] if self.stack else -1
        names, hidden = named_and_hidden(attributes) if attributes else ("", False)
        up = self.elements[parent] if parent >= 0 else None
        inside = tag in CONTENT or bool(up and up[5])
        within = bool(up and up[5])
        if tag in PROSE or tag == "article" or within and tag == "li":
            noise = NOISE_ASIDE if tag not in HEADINGS else None
        else:
            noise = None if tag in ROOTS else NOISE_INSIDE if within else NOISE
        named = bool(names and noise and noise.search(names))
        hidden = hidden and tag not in ("html", "body")
        # The article's own heading may stand in a <header>.
        own = tag == "header" and within
        self.marks.append((named, not own and (tag in BOILERPLATE or hidden)))
        self.elements.append([parent, tag, len(self.runs), None, False, inside, names])
        self.stack.append(len(self.elements) - 1)
        self.open[tag] += 1
        self.inner.append([])
        self.digests.append(None)

    def _settle(self) -> None:
        """Tell noise, which what is inside inherits; names do not make noise of an element that holds all articles."""
        around: set[int] | None = None
        barred: list[bool] = []
        outer: list[int] = []
        for i, ((parent, tag, *_), (_, fixed)) in enumerate(zip(self.elements, self.marks, strict=True)):
            barred.append(fixed or parent >= 0 and barred[parent])
            if tag in CONTENT and not barred[-1] and (parent < 0 or not self.elements[parent][5]):
                outer.append(i)
        # Articles whose names say comment or advert are none where others stand beside them.
        plain = [i for i in outer if not self.marks[i][0]]
        for parent in (self.elements[i][0] for i in plain or outer):
            up = set()
            while parent >= 0 and (around is None or around):
                up.add(parent)
                parent = self.elements[parent][0]
            around = up if around is None else around & up
        spared = (around or set()) | (set() if plain else set(outer))
        for i, (element, (named, fixed)) in enumerate(zip(self.elements, self.marks, strict=True)):
            up = element[0]
            element[4] = up >= 0 and self.elements[up][4] or fixed or named and i not in spared

    def _end(self, tag: str) -> None:
        if self.open[tag]:
            for i in range(len(self.stack) - 1, -1, -1):
                name = self.elements[self.stack[i]][1]
                if name == tag:
                    self._close(i)
                    return
                if tag in INLINE and name not in INLINE:
                    return  # a stray end inside a block closes nothing outside it
        if tag not in FLOWING:
            self.block += 1

    def _close(self, low: int) -> None:
        """Close the open elements from the place ``low`` of the stack on."""
        for i in range(len(self.stack) - 1, low - 1, -1):
            at = self.stack[i]
            element, held = self.elements[at], self.inner.pop()
            element[3] = len(self.runs)
            self.open[element[1]] -= 1
            if element[1] not in FLOWING:
                self.block += 1
            if held:
                shape = f"<{element[1]} {element[6]}>".encode("utf-8", "surrogatepass")
                self.digests[at] = xxhash.xxh64_digest(b"\0".join((shape, *held)))
                if self.inner:
                    self.inner[-1].append(b"\1" + self.digests[at])
        if low >= 0:
            del self.stack[low:]

    def subtree_hashes(self) -> list[int | None]:
        """64-bit hashes of the subtrees that may be template; None for those that may not.

        A subtree is its element names, class names and text. Inline elements and
        those without text never are template of their own. Nor are headings and
        paragraphs of an article: an author may say the same in many articles.
        """
        out: list[int | None] = []
        for (parent, tag, _, _, _, inside, _), digest in zip(self.elements, self.digests, strict=True):
            outer = parent < 0 or not self.elements[parent][4]
            part = tag in PARTS if inside else tag not in INLINE
            fits = digest and outer and part and tag not in ("html", "body", *CONTENT)
            out.append(int.from_bytes(digest, "little", signed=True) if fits else None)
        return out

    def text(self, hashes: list[int | None], template: frozenset[int]) -> str:
        """The main text: what no template, boilerplate or noise holds, of the article if there is one."""
        n = len(self.runs)
        articles = False
        # Elements are in page order: what a dropped or an article's element covers is marked by steps at its ends.
        drop, keep = [0] * (n + 1), [0] * (n + 1)
        for (parent, tag, first, end, noise, inside, _), h in zip(self.elements, hashes, strict=True):
            if noise or (h is not None and h in template):
                drop[first] += 1
                drop[end] -= 1
            elif tag in CONTENT and (parent < 0 or not self.elements[parent][5]):
                keep[first] += 1
                keep[end] -= 1
                articles = True
        blocks: list[list[str]] = []
        last, dropped, kept = None, 0, 0
        for i, (block, text) in enumerate(self.runs):
            dropped += drop[i]
            kept += keep[i]
            if dropped or (articles and not kept):
                continue
            if block == last:
                blocks[-1].append(text)
            else:
                blocks.append([text])
                last = block
        return " ".join(filter(None, (SPACE.sub(" ", "".join(b)).strip() for b in blocks)))


def host(url: str = "url") -> Column:
    """The host of a URL in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def content(html: str = "html") -> Column:
    """A hash that copies of a page share."""
    return F.xxhash64(F.coalesce(F.col(html), F.lit("")))


def subtree_counts(pages: DataFrame) -> DataFrame:
    """host, subtree, n: on how many different pages of a host a subtree recurs, from two on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, found = [], []
            for i, source in enumerate(batch.column("html")):
                own = {x for x in Page(source.as_py() or "").subtree_hashes() if x is not None}
                hosts += [i] * len(own)
                found += own
            at = pa.array(hosts, pa.int64())
            columns = [batch.column("host").take(at), batch.column("page").take(at), pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "page", "subtree"])

    found = pages.select(host().alias("host"), content().alias("page"), "html")
    found = found.mapInArrow(run, "host string, page long, subtree long")
    return found.groupBy("host", "subtree").agg(F.count_distinct("page").alias("n")).where("n > 1")


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """host, subtree of the subtrees that recur on many different pages of their host."""
    sizes = pages.groupBy(host().alias("host")).agg(F.count_distinct(content()).alias("pages"))
    often = F.col("n") >= F.greatest(F.lit(min_pages), F.col("pages") * min_share)
    return subtree_counts(pages).join(sizes, "host").where(often).select("host", "subtree")


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined in page order by one space. Without an article or
    main element all that is not template or boilerplate counts. A page that is
    null, empty or has no main text gives "" and 0. Pages without a host form one
    host. Repeated rows are kept, but copies of a page count as one page of their host;
    an empty table gives no rows; other columns are ignored.
    """
    templates = checkpointed(site_templates(pages, min_pages, min_share))
    small = templates.count() <= BROADCAST_SUBTREES
    lists = templates.groupBy("host").agg(F.collect_set("subtree").alias("template"))
    rows = pages.select("page_id", "url", "html", host().alias("host"))
    # A host has at most (subtrees of a page) / min_share templates, so its list is as long as some pages.
    rows = rows.join(F.broadcast(lists) if small else lists, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, template in zip(batch.column("html"), batch.column("template"), strict=True):
                known = frozenset(template.as_py() or ())
                page = Page(source.as_py() or "", hashed=bool(known))
                texts.append(page.text(page.subtree_hashes() if known else [None] * len(page.elements), known))
            n_chars = pa.array([len(t) for t in texts], pa.int64())
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), n_chars]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    rows = rows.select("page_id", "url", "html", "template")
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages: see ``main_text``."""
    return main_text(table(spark, sf_dir, "pages"))
