"""Main-text extraction with a site style tree.

Pages of one host are merged into a style tree: a node for each path of block elements, with the number
of pages that have it, the child sequences it occurs with (its presentation styles) and the texts that
stand in it. A node's importance is its composite entropy: presentation that differs between pages and
content that few pages share are important, what all pages of the site repeat is not; the texts of a
node are its leaves and are judged one by one too. Branches and texts of low importance are removed from
each page, inside ``article`` and ``main`` as elsewhere, besides branches that their tag or role declares
to be navigation, forms and the like. A class that declares a branch to be noise lowers its rank, however
long it is: a page gives its text in ``article`` and ``main`` alone if it has any, else the text outside
branches with such a class, and those branches only if nothing else is left.

The tree is aggregated with partial sums by (host, path, feature), so a host with very many pages is no
single group; only the removed paths of each host come back to the pages.
"""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoylake.llm.common import rows_out, store, table

#: A node on fewer pages than this cannot be judged; nodes of lower importance than that are removed.
LEAST_PAGES, LEAST_IMPORTANCE = 4, 0.3
#: Weight of content against presentation.
CONTENT_WEIGHT = 0.9
#: Kinds of text: declared main text, undeclared text, text in a branch with a noise class.
MAIN, PLAIN, NOISE = 2, 1, 0

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
_RAW = frozenset("script style textarea title noscript template svg math iframe object select option button canvas audio video map head".split())
_NOISE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
_NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs"
    " footer header masthead comment comments disqus reply replies share sharing social related recommended newsletter subscribe subscription signup login search pagination pager widget toolbar copyright disclaimer".split()
)
#: Words that beside a noise word in one class token leave it one.
_NEUTRAL = frozenset("bar block bottom box btn button container content global id inner item items left link links list main page panel right section site slot top unit widget wrap wrapper zone".split())
_REMARKS = frozenset("comment comments disqus reply replies".split())
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset("ul ol dl table div section article main body html".split())
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW}


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _marks(rest: str) -> tuple[set[str], set[str], str, bool]:
    """Words of class and id, the noise words among them whose whole token says so, role, and whether the element is hidden."""
    words: set[str] = set()
    noise: set[str] = set()
    role, hidden = "", False
    for name, value in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            for token in value.split():
                parts = set(re.findall(r"[a-z]+", token))
                words |= parts
                if parts <= _NOISE_WORDS | _NEUTRAL:
                    noise |= parts & _NOISE_WORDS
        elif name == "role":
            role = value
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return words, noise, role, hidden


class Page:
    """Blocks of a page: ``blocks`` holds (path, kind, text); declared noise is left out. ``styles`` has the child sequences of the elements by path."""

    def __init__(self, html: str) -> None:
        self.styles: list[tuple[str, str]] = []
        self.blocks: list[tuple[str, int, str]] = []
        # an element: tag, path, main, noise, whether it is in a branch with a noise class, tags of its children
        self.stack: list[tuple[str, str, bool, bool, bool, list[str]]] = [("", "", False, False, False, [])]
        self.text: list[str] = []
        at = 0
        while (m := _TAG.search(html, at)) is not None:
            if m.start() > at:
                self.text.append(html[at : m.start()])
            at = m.end()
            if m[2]:
                at = self._tag(html, at, m[1] == "/", m[2].lower(), m[3])
        self.text.append(html[at:])
        self._flush()
        while len(self.stack) > 1:
            self._pop()

    def _flush(self) -> None:
        if self.text:
            raw = "".join(self.text)
            self.text = []
            _, path, main, noise, marked, _ = self.stack[-1]
            if not noise and (text := " ".join((entities.unescape(raw) if "&" in raw else raw).split())):
                self.blocks.append((path, NOISE if marked else MAIN if main else PLAIN, text))

    def _pop(self) -> None:
        _, path, _, noise, _, children = self.stack.pop()
        if not noise:
            self.styles.append((path, ">".join(dict.fromkeys(children))))

    def _tag(self, html: str, at: int, closing: bool, tag: str, rest: str) -> int:
        if closing:
            depth = next((k for k in range(len(self.stack) - 1, 0, -1) if self.stack[k][0] == tag), 0)
            if depth and not (tag in _INLINE and any(e[0] not in _INLINE for e in self.stack[depth + 1 :])):
                self._flush()
                while len(self.stack) > depth:
                    self._pop()
            elif tag not in _INLINE:
                self._flush()
            return at
        if tag in _RAW:
            self._flush() if tag in ("head", "title") else self.text.append(" ")
            if tag == "head":  # its text is not the page's; it ends where the body begins
                end = re.compile(r"</head\s*>|<body\b|<(?:article|main|div|p|nav|header|section|h1)\b", re.I).search(html, self._after_raw(html, at))
                return (end.end() if end[0].startswith("</") else end.start()) if end else len(html)
            end = None if rest.rstrip().endswith("/") else _RAW_END[tag].search(html, at)
            return end.end() if end else (at if rest.rstrip().endswith("/") or tag in ("option", "object", "button", "select") else len(html))
        if tag in _VOID:
            if tag == "hr":
                self._flush()
            elif tag == "br":
                self.text.append(" ")
            return at
        words, marked, role, hidden = _marks(rest) if rest and not rest.isspace() else (set(), set(), "", False)
        if tag in _INLINE:
            if not hidden and not marked:
                return at
            self._flush()
        else:
            self._flush()
            self._close_implied(tag)
        _, path, main, noise, within, children = self.stack[-1]
        children.append(tag)
        if tag in ("html", "body"):
            pass
        elif (tag in ("article", "main") or role == "main") and not words & _REMARKS and not hidden:
            # an article inside comments or a list of related ones stays what surrounds it
            main, noise, within = True, noise and main, within and main
        elif hidden or tag in _NOISE_TAGS or role in _NOISE_ROLES or tag == "header" and not main or marked & _REMARKS:
            noise = True
        elif marked - {"header"} if main else marked:
            within = True
        self.stack.append((tag, f"{path}/{tag}" + "".join(f".{w}" for w in sorted(words)), main, noise, within, []))
        return at

    @staticmethod
    def _after_raw(html: str, at: int) -> int:
        """Past the scripts and styles that may hold tags, from inside the head."""
        while (m := re.compile(r"<(script|style|title|noscript)\b|</head\s*>|<body\b", re.I).search(html, at)) is not None and m[1]:
            end = _RAW_END[m[1].lower()].search(html, m.end())
            if end is None:
                return at
            at = end.end()
        return at

    def _close_implied(self, tag: str) -> None:
        """Closes an open p, and the item that a new item ends."""
        stop = _CLOSED_BY.get(tag, ())
        for k in range(len(self.stack) - 1, 0, -1):
            open_tag = self.stack[k][0]
            if open_tag == "p" or open_tag in stop:
                while len(self.stack) > k:
                    self._pop()
                return
            if open_tag in _SCOPES:
                return


def leaf(path: str, text: str) -> int:
    """A text at its node, as a signed number."""
    return xxhash.xxh3_64_intdigest(f"{path}\0{text}") - (1 << 63)


def kept_text(blocks: list[tuple[str, int, str]], removed: set[str], leaves: set[int] | frozenset[int] = frozenset()) -> str:
    """The blocks outside the removed branches and texts, joined by an empty line, of the best kind that the page has.

    Declared main text that the site repeats as a whole is kept if nothing else is declared.
    """

    def stays(path: str, text: str) -> bool:
        return not (leaves and leaf(path, text) in leaves) and not (removed and any(path == r or path.startswith(r + "/") for r in removed))

    left = [b for b in blocks if stays(b[0], b[2])]
    if any(kind == MAIN for _, kind, _ in blocks):
        kept = [b for b in left if b[1] == MAIN] or [b for b in blocks if b[1] == MAIN]
    else:
        kept = [b for b in left if b[1] == PLAIN] or left
    return "\n\n".join(text for _, _, text in kept)


def style_tree(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of each host's style tree (host, path, pages, importance) and the texts that it repeats (host, path, feature, k: pages that have it), from page_id, host and html."""

    def features(batches):
        def rows():
            for batch in batches:
                for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    page = Page(html or "")
                    seen = {(path, 0, xxhash.xxh3_64_intdigest(style) - (1 << 63)) for path, style in page.styles if path}
                    seen |= {(path, 1, leaf(path, text)) for path, _, text in page.blocks}
                    for path, part, feature in seen:
                        yield host, path, part, feature
                    for path in {p for p, _, _ in seen}:
                        yield host, path, 2, 0

        return rows_out(pa.schema([("host", pa.string()), ("path", pa.string()), ("part", pa.int32()), ("feature", pa.int64())]), 10_000)(rows())

    found = pages.select("host", "html").mapInArrow(features, "host string, path string, part int, feature bigint")
    counts = store(found.groupBy("host", "path", "part", "feature").agg(F.count("*").alias("k")))
    # sums from which entropies to the base of the number of pages follow
    sums = counts.groupBy("host", "path").agg(
        F.max(F.when(F.col("part") == 2, F.col("k"))).alias("pages"),
        F.sum(F.when(F.col("part") == 0, F.col("k"))).alias("styles"),
        F.sum(F.when(F.col("part") == 0, F.col("k") * F.log("k"))).alias("styles_log"),
        F.sum(F.when(F.col("part") == 1, F.col("k"))).alias("texts"),
        F.sum(F.when(F.col("part") == 1, F.col("k") * F.log("k"))).alias("texts_log"),
    )
    base = F.log("pages")
    presentation = F.coalesce((F.log("styles") - F.col("styles_log") / F.col("styles")) / base, F.lit(0.0))
    content = F.coalesce(1 - F.col("texts_log") / F.col("texts") / base, F.lit(1.0))  # a text on k of m pages has the entropy log k / log m
    importance = F.when(F.col("pages") > 1, CONTENT_WEIGHT * content + (1 - CONTENT_WEIGHT) * F.least(presentation, F.lit(1.0))).otherwise(1.0)
    return sums.select("host", "path", "pages", importance.alias("importance")), counts.where((F.col("part") == 1) & (F.col("k") >= LEAST_PAGES)).select("host", "path", "feature", "k")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of each page: the id, ``url``, ``text`` (blocks in page order, joined by an empty line) and ``n_chars``.

    Null or empty pages, and pages without text, give an empty text. Pages without a host share an
    empty one. Repeated rows count as pages of their own, null ids are kept, other columns ignored,
    empty input gives an empty result.
    """

    def hosts(batches):
        for batch in batches:
            names = [host_of(u) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string())], names=["id", "url", "html", "host"])

    pages = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    sited = pages.mapInArrow(hosts, "id bigint, url string, html string, host string")
    nodes, texts = style_tree(sited)
    nodes = store(nodes.where((F.col("pages") >= LEAST_PAGES) & (F.col("path") != "")))
    low = nodes.where(F.col("importance") < LEAST_IMPORTANCE).groupBy("host").agg(F.collect_set("path").alias("removed"))
    # a text is a leaf of content importance 1 - log k / log pages; on less than half of its node's pages it stays
    common = texts.join(nodes, ["host", "path"]).where((F.col("k") * 2 >= F.col("pages")) & (1 - F.log("k") / F.log("pages") < LEAST_IMPORTANCE))
    removed = store(low.join(common.groupBy("host").agg(F.collect_set("feature").alias("leaves")), "host", "full"))

    def cut(batches):
        def rows():
            for batch in batches:
                for i, url, html, paths, leaves in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    text = kept_text(Page(html or "").blocks, set(paths or ()), set(leaves or ()))
                    yield i, url, text, len(text)

        return rows_out(pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]), 500)(rows())

    # Spark broadcasts the removed paths if they are few, else it joins by host and splits crowded hosts
    out = sited.join(removed, "host", "left").select("id", "url", "html", "removed", "leaves").mapInArrow(cut, "id bigint, url string, text string, n_chars bigint")
    return out.withColumnRenamed("id", id_col)


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op1_html_extract": op1_html_extract}
#: What the operator gives on pages of the test tables' make: one ``article`` of ``h1`` and ``p`` with ``b`` and ``br``.
ORACLES = {
    "op1_html_extract": r"""
WITH cut AS (SELECT page_id, url, string_split_regex(coalesce(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), ''), '</?(?:p|h1)>') AS raw FROM pages),
parts AS (SELECT page_id, url, list_filter(list_transform(raw, lambda b: trim(regexp_replace(replace(replace(regexp_replace(replace(b, '<br>', ' '), '</?b>', '', 'g'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda b: b <> '') AS blocks FROM cut)
SELECT page_id, url, array_to_string(blocks, chr(10) || chr(10)) AS text, length(array_to_string(blocks, chr(10) || chr(10))) AS n_chars FROM parts"""
}
