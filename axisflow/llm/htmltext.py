"""Main text of web pages: page furniture by markup, site templates by how often subtrees recur on a host."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import put, small

MIN_CONTEXTS = 10      # places between different neighbours at which a subtree is a template
MIN_VARIETY = 0.3      # of its distinct pages; near copies of one article repeat the same neighbours
MAX_TEMPLATES = 1_000_000  # templates that are broadcast as pairs of hashes; beyond it they are joined

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
                  "hgroup hr html legend li main menu nav noscript ol p pre search section summary table tbody td tfoot th thead tr ul".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption b i em strong a".split())
DROPPED = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math canvas object embed audio video head nav footer aside form button "
                    "select option input label fieldset legend dialog menu search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|notification\w*|alert|popup|modal|overlay|newsletter|"
                       r"subscri\w+|signup|sign-up|login|menu\w*|nav|navbar|navigation|breadcrumbs?|sidebar\w*|widget\w*|related|recommend\w*|share|sharing|social|"
                       r"comments?|commentlist|disqus|discussion|respond|reply|replies|reader-\w+|footer|header|masthead|topbar|toolbar|pagination|pager|skip\w*|"
                       r"copyright|disclaimer|sr-only|visually-hidden|hidden)(?:$|[\s_-])", re.I)
COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|respond|ads?|advert\w*|promo\w*|related|sponsor\w*)(?:$|[\s_-])", re.I)
CONTENT = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story)[\s_-]?(?:body|content|text)(?:$|[\s_-])|^(?:content|main-content|main)$", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
CLOSES_P = BLOCK - {"html", "body", "head"}
#: An opening tag that ends an open element of these, up to the nearest element that holds such lists or rows.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
        "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}


def _h(s: str | bytes) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


class Page:
    """Blocks of a page in order and the element subtrees that hold them."""

    def __init__(self, source: str):
        self.blocks: list[str] = []
        self.level: list[int] = []                       # 3 in an article, 2 in main, 1 in a content container, 0 elsewhere
        self.trees: list[tuple[str, int, int, bool]] = []  # tag, first block, block after the last, whether it is plain prose
        self._buffer: list[str] = []
        self._stack: list[tuple[str, int, bool, int, bool]] = []  # tag, first block, dropped, level, plain
        self._read(source)
        self._flush()
        while self._stack:
            self._pop()

    def _flush(self) -> None:
        if self._buffer:
            text = " ".join(html.unescape("".join(self._buffer)).split())
            self._buffer.clear()
            if text:
                self.blocks.append(text)
                self.level.append(self._stack[-1][3] if self._stack else 0)

    def _pop(self) -> None:
        tag, first, _, _, plain = self._stack[-1]
        if tag in BLOCK:
            self._flush()
        self._stack.pop()
        if first < len(self.blocks) and tag in BLOCK and tag not in ("html", "body"):
            self.trees.append((tag, first, len(self.blocks), plain))

    def _close(self, tag: str) -> None:
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] == tag:
                while len(self._stack) > i:
                    self._pop()
                return
            if self._stack[i][0] in ("article", "main", "body", "table") and tag not in ("html", "body", "main", "article"):
                return

    def _ended(self, tag: str) -> None:
        if tag in ENDS:
            own, holders = ENDS[tag]
            for i in range(len(self._stack) - 1, -1, -1):
                if self._stack[i][0] in holders:
                    return
                if self._stack[i][0] in own:
                    while len(self._stack) > i:
                        self._pop()
                    if tag != "tr":
                        return
        elif tag in CLOSES_P:
            for i in range(len(self._stack) - 1, max(-1, len(self._stack) - 12), -1):
                t = self._stack[i][0]
                if t == "p":
                    while len(self._stack) > i:
                        self._pop()
                    return
                if t in BLOCK:
                    return

    def _open(self, tag: str, rest: str) -> None:
        parent = self._stack[-1] if self._stack else ("", 0, False, 0, False)
        if tag in BLOCK:
            self._flush()
        dropped, level = parent[2] or tag in DROPPED, parent[3]
        marked = False
        if not dropped:
            if rest and tag not in ("html", "body"):
                given = {m.group(1).lower(): m.group(2) or m.group(3) or m.group(4) or "" for m in ATTRIBUTE.finditer(rest)}
                names = f"{given.get('class', '')} {given.get('id', '')}".strip()
                marked = bool(names)
                if tag in ("article", "main"):
                    dropped = bool(COMMENT.search(names))
                else:
                    dropped = bool(names and FURNITURE.search(names)) or given.get("role", "").lower() in ROLES
                dropped = dropped or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
                if names and any(CONTENT.search(given.get(k, "")) for k in ("class", "id")) or given.get("role", "").lower() == "main":
                    level = max(level, 1)
            level = max(level, {"article": 3, "main": 2}.get(tag, 0))
            if tag == "header":  # of the site, or the title of an article
                dropped = dropped or level < 3
        self._stack.append((tag, len(self.blocks), dropped, level, tag in PROSE and not marked))

    def _say(self, text: str) -> None:
        if not (self._stack and self._stack[-1][2]):
            if any(t[0] == "header" for t in self._stack[-6:]) and not any(t[0] in HEADINGS for t in self._stack[-4:]):
                return
            self._buffer.append(text)

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            m = TAG.search(source, at)
            if m is None:
                self._say(source[at:])
                return
            if m.start() > at:
                self._say(source[at:m.start()])
            at = m.end()
            tag = m.group(2) or m.group(5)
            if tag is None:
                continue
            tag = tag.lower()
            if m.group(1) or m.group(4):
                self._close(tag)
                continue
            rest = m.group(3) or m.group(6) or ""
            if tag in RAW:
                end = RAW[tag].search(source, at)
                at = end.end() if end else n
                continue
            if tag == "br":
                self._say(" ")
                continue
            self._ended(tag)
            if tag in VOID:
                if tag in BLOCK:
                    self._flush()
                continue
            self._open(tag, rest)

    def subtrees(self) -> Iterator[tuple[int, int, int]]:
        """(hash, first block, block after the last) of every removable subtree of the main part."""
        top = max(self.level, default=0)
        own = [_h(b) for b in self.blocks]
        met = set()
        for tag, first, end, plain in reversed(self.trees):
            if (first, end) in met or self.level[first] < top or (plain and top > 0) or (tag in ("article", "main") and top > 0):
                continue
            met.add((first, end))
            yield _h(f"{tag}:" + ",".join(map(str, own[first:end]))), first, end

    def text(self, templates=frozenset()) -> str:
        """The blocks of the best main part there is, without the subtrees whose hashes are templates."""
        top = max(self.level, default=0)
        gone: set[int] = set()
        if templates:
            for h, first, end in self.subtrees():
                if h in templates:
                    gone.update(range(first, end))
        return " ".join(b for i, b in enumerate(self.blocks) if self.level[i] == top and i not in gone)


HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)")


def host_of(url: str | None) -> str:
    m = HOST.match((url or "").strip())
    return m.group(1).lower() if m else ""


LAID = "host long, content long, blocks array<long>, subtree array<long>, first array<int>, after array<int>"


def _laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as hashes: their host, whole content, blocks and subtrees."""
    for batch in batches:
        rows = []
        for url, source in zip(batch.column(0).to_pylist(), batch.column(1)):
            page = Page(source.as_py() or "")
            trees = list(page.subtrees())
            if trees:
                blocks = [_h(b) for b in page.blocks]
                rows.append((_h(host_of(url)), _h(repr((blocks, trees))), blocks, *map(list, zip(*trees))))
        cols = list(zip(*rows)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["host", "content", "blocks", "subtree", "first", "after"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, subtree, before, after) of the subtrees that are left, between the nearest blocks that are left."""
    for batch in batches:
        rows = []
        for host, blocks, trees, firsts, ends, gone in zip(*(c.to_pylist() for c in batch.columns)):
            known = frozenset(gone or ())
            left = [True] * len(blocks)
            for h, first, end in zip(trees, firsts, ends):
                if h in known:
                    left[first:end] = [False] * (end - first)
            before, after = [0] * (len(blocks) + 1), [0] * (len(blocks) + 1)
            for i, b in enumerate(blocks):
                before[i + 1] = b if left[i] else before[i]
            for i in range(len(blocks) - 1, -1, -1):
                after[i] = blocks[i] if left[i] else after[i + 1]
            rows += [(host, h, before[first], after[end]) for h, first, end in zip(trees, firsts, ends) if any(left[first:end])]
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["host", "subtree", "before", "after"])


def site_templates(pages: DataFrame, min_contexts: int = MIN_CONTEXTS, min_variety: float = MIN_VARIETY) -> DataFrame:
    """(host, subtree) hashes of subtrees that recur on a host between many different neighbours.

    Pages of a host with the same blocks count once, so pages that only copy an article neither make a template of it nor
    outvote the templates around it. Neighbours are the nearest blocks outside templates that are known already;
    rounds go on until none is added, so of adjacent templates the outer ones follow those that touch the article.
    A host of a third of all pages is spread by its subtrees.
    """
    laid = cut_lineage(pages.mapInArrow(_laid, LAID).dropDuplicates(["host", "content"]))
    found, n = None, 0
    while True:
        if found is None:
            known = laid.withColumn("gone", F.lit(None).cast("array<long>"))
        else:
            parts = laid.select("host", "content", F.explode("subtree").alias("subtree")).join(small(found), ["host", "subtree"])
            known = laid.join(parts.groupBy("host", "content").agg(F.collect_set("subtree").alias("gone")), ["host", "content"], "left")
        seen = known.select("host", "blocks", "subtree", "first", "after", "gone").mapInArrow(_neighbours, "host long, subtree long, before long, after long")
        placed = seen.groupBy("host", "subtree", "before", "after").agg(F.count("*").alias("n"))
        counted = placed.groupBy("host", "subtree").agg(F.count("*").alias("contexts"), F.sum("n").alias("pages"))
        more = counted.where((F.col("contexts") >= min_contexts) & (F.col("contexts") >= min_variety * F.col("pages"))).select("host", "subtree")
        found = cut_lineage(more if found is None else found.union(more).distinct())
        before, n = n, found.count()
        if n == before:
            return found


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_contexts: int = MIN_CONTEXTS, max_broadcast: int = MAX_TEMPLATES) -> DataFrame:
    """``pages`` with ``text``, the main text, and ``n_chars``, its code points.

    Furniture goes by element, role and class names. The main part is the articles of a page, else its main element,
    else a content container, else the body. Of that part, subtrees that recur on the page's host between at least
    ``min_contexts`` different neighbours are site templates and go; plain paragraphs, headings and list items of
    an explicit main part are the article itself and stay, however often the host repeats them. Character
    references are decoded, white space in a block becomes one space, blocks are joined by one space.

    A null page is empty, an empty page has an empty text. A null url is the host "". Repeated rows are extracted one
    by one; input columns ``text`` and ``n_chars`` give way; an empty table gives an empty table.
    """
    have = {c.lower(): c for c in pages.columns}
    url, source = F.col(f"`{have[url_col.lower()]}`"), F.col(f"`{have[html_col.lower()]}`")
    found = site_templates(pages.select(url.alias("url"), source.alias("html")), min_contexts)
    order = [c for c in pages.columns if c.lower() not in ("text", "n_chars")]
    if found.limit(max_broadcast + 1).count() <= max_broadcast:
        by_host: dict[int, set[int]] = {}
        for r in found.toLocalIterator():
            by_host.setdefault(r.host, set()).add(r.subtree)
        known = pages.sparkSession.sparkContext.broadcast(by_host)

        @F.pandas_udf("string")
        def text(urls: pd.Series, sources: pd.Series) -> pd.Series:
            return pd.Series([Page(s or "").text(known.value.get(_h(host_of(u)), frozenset())) for u, s in zip(urls, sources)], dtype="object")
        done = pages.withColumn("_main_text", text(url, source))
    else:
        @F.pandas_udf("string")
        def joined(sources: pd.Series, gone: pd.Series) -> pd.Series:
            return pd.Series([Page(s or "").text(frozenset() if g is None else frozenset(map(int, g))) for s, g in zip(sources, gone)], dtype="object")

        @F.pandas_udf("array<struct<host:long,subtree:long>>")
        def own(urls: pd.Series, sources: pd.Series) -> pd.Series:
            return pd.Series([[{"host": _h(host_of(u)), "subtree": t[0]} for t in Page(s or "").subtrees()] for u, s in zip(urls, sources)])
        mark = put(pages, _html_a=F.xxhash64(url, source), _html_b=F.xxhash64(source, F.lit(3), url))
        parts = mark.select("_html_a", "_html_b", F.explode(own(url, source)).alias("t")).select("_html_a", "_html_b", "t.host", "t.subtree").distinct()
        gone = parts.join(found, ["host", "subtree"]).groupBy("_html_a", "_html_b").agg(F.collect_set("subtree").alias("_html_gone"))
        done = mark.join(gone, ["_html_a", "_html_b"], "left").withColumn("_main_text", joined(source, F.col("_html_gone")))
    return put(done, text=F.col("_main_text"), n_chars=F.length("_main_text").cast("long")).select(*[F.col(f"`{c}`") for c in order], "text", "n_chars")
