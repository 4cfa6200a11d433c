"""Main text of web pages: page structure first, then a host's suffix array over what structure cannot tell.

A page is read as a stream of tags and text. Menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments are left out with all they hold: by their tag, or by a whole name in their class, id,
role or label (a part of a name between hyphens does not count, and an element that holds over half of the article's
letters, of the page's where none is marked, stays in spite of its names, unless they are those of comments). Where the page
marks its article (article or main element), the article's blocks are its text. The blocks of a page without such a mark, and the blocks
outside it, go to the host's token stream: streams of a host of at most ``CHUNK_PAGES`` pages are concatenated
and sorted by prefix doubling up to ``RUN`` tokens; a run of that length that ``MIN_PAGES`` distinct pages of the
host share is boilerplate, tokens it covers are removed and unique runs stay. Pages of equal blocks count as one. A larger host is cut into chunks of
about that many pages; its runs are counted over all its chunks by 64-bit hashes, and those that recur are sent
to every chunk.

A null html gives ""; pages without url make a host of their own; repeated rows each give a row; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import keep, map_columns, small_batches
from sparkloom.llm.fingerprints import U, mix, powers

CHUNK_PAGES = 256
RUN = 16
MIN_PAGES = 3

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|[^<]+|<", re.S)
#: Elements left out with all they hold, elements whose text is no markup, block elements.
LEFT_OUT = {"nav", "footer", "aside", "form", "noscript", "template", "iframe", "svg", "button", "select", "textarea", "dialog", "menu", "head", "title", "object", "canvas", "audio", "video"}
RAW = {"script", "style", "textarea", "title", "xmp", "noembed"}
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "table", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "blockquote", "pre", "article", "main", "section", "header", "footer", "nav", "aside", "form", "figure", "figcaption", "address", "hr", "body", "html", "details", "summary", "fieldset", "center"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Whole names in class, id, role or aria-label that mark what is no article; names of reader comments.
_MARKED = re.compile(
    r"""ads?|ad-?(?:box|banner|block|container|slot|unit|wrapper)|adverts?|advertis(?:ement|ements|ing)|banner|(?:ad|cookie|promo|top)-banner|sponsor(?:ed|s)?|sponsored-(?:content|links|post)|promo(?:s|tion|tions)?
    |side-?bar|(?:left|right|page|site)-side-?bar|cookies?|cookie-?(?:bar|consent|notice|popup)|consent|gdpr|notices?|alerts?|alert-(?:danger|info|warning)|complementary|search|search-(?:box|form)
    |newsletter|newsletter-(?:form|signup)|subscribe|sign-?up|popup|modal|overlay|menu|(?:main|site|top)-menu|nav-?bar|navigation|nav|(?:main|site|top)-nav(?:igation)?|breadcrumbs?
    |footer|contentinfo|(?:page|site)-(?:footer|header)|masthead|topbar|toolbar|social|social-(?:icons|links|media|share)|share|sharing|share-(?:buttons|links)
    |related|related-(?:articles|content|links|posts|stories)|recommended|recommendations|recommended-(?:articles|posts)|widget|widget-area|pagination|pager|skip-link""",
    re.I | re.X,
)
_COMMENTS = re.compile(r"comments?|comment-?(?:list|section|form|area)|comments-(?:area|list|section)|disqus|disqus_thread|replies|reply|respond", re.I)
_LABEL = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_SPACE = re.compile(r"\s+")


def _names(attributes: str) -> list[str]:
    return " ".join(x.strip("\"'") for x in _LABEL.findall(attributes)).split()


def _left_out(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element goes whatever it holds."""
    if name in LEFT_OUT or (name == "header" and not inside):
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    return bool(_HIDDEN.search(attributes)) or any(_COMMENTS.fullmatch(n) for n in _names(attributes))


def _marked(name: str, attributes: str) -> bool:
    """Whether an element's names speak against it: it goes unless it holds most of the article."""
    return bool(attributes) and name not in ("html", "body", "article", "main") and any(_MARKED.fullmatch(n) for n in _names(attributes))


def blocks_of(html: str | None) -> list[tuple[bool, str]]:
    """(is in the article, text) of every block that is not left out."""
    html = html or ""
    found: list[tuple[bool, str, tuple[int, ...]]] = []
    piece: list[str] = []
    inside, skip, depth = 0, "", 0
    at, size = 0, len(html)
    regions, open_ = 0, []  # marked elements: [tag, depth, number, articles around it]

    def flush() -> None:
        text = _SPACE.sub(" ", unescape("".join(piece))).strip()
        piece.clear()
        if text:
            found.append((inside > 0, text, tuple(r[2] for r in open_)))

    def nearest(name: str) -> int | None:
        return next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), None)

    lowered, more_cdata = None, True
    while at < size:
        m = _TOKEN.match(html, at)
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA[") and more_cdata:
                end = html.find("]]>", m.start() + 9)
                more_cdata = end >= 0  # the end is looked for once
                if more_cdata:
                    if not skip:
                        piece.append(html[m.start() + 9 : end])
                    at = end + 3
            elif not skip and (html[m.start()] != "<" or m.end() == m.start() + 1):
                piece.append(m[0])
            continue
        name, closing = name.lower(), bool(m[1])
        if name in RAW and not closing and not m[3].endswith("/"):
            lowered = html.lower() if lowered is None else lowered
            if len(lowered) != size:
                lowered = re.sub("[A-Z]", lambda x: chr(ord(x[0]) + 32), html)
            end = lowered.find(f"</{name}", at)
            at = size if end < 0 else end
            if not skip and name in BLOCKS:
                flush()
            if end >= 0:
                close = html.find(">", at)
                at = size if close < 0 else close + 1
            continue
        if skip:
            if name == skip and not m[3].endswith("/"):
                depth += -1 if closing else 1
            if depth <= 0 or (closing and name in ("body", "html") or closing and name in ("article", "main") and inside):
                skip = ""
                if name in ("article", "main"):
                    inside = max(0, inside - 1)
            continue
        if name in BLOCKS:
            flush()
        elif name == "br":
            piece.append(" ")
        if closing:
            if name in ("article", "main"):
                while open_ and open_[-1][3] >= inside > 0:  # left open inside the article
                    open_.pop()
                inside = max(0, inside - 1)
            elif (i := nearest(name)) is not None:
                open_[i][1] -= 1
                if not open_[i][1]:
                    flush()
                    del open_[i:]
        elif name not in VOID and not m[3].endswith("/"):
            if _left_out(name, m[3], inside > 0):
                flush()
                skip, depth = name, 1
            elif name in ("article", "main"):
                inside += 1
            elif _marked(name, m[3]):
                flush()
                regions += 1
                open_.append([name, 1, regions, inside])
            elif (i := nearest(name)) is not None:
                open_[i][1] += 1
    if not skip:
        flush()
    if not regions:
        return [(own, text) for own, text, _ in found]
    article = any(own for own, _, _ in found)
    total, held = 0, [0] * (regions + 1)
    for own, text, of in found:
        if own or not article:
            total += len(text)
            for r in of:
                held[r] += len(text)
    return [(own, text) for own, text, of in found if all(2 * held[r] > total for r in of)]


def covered(streams: list[list[str]], run: int = RUN, min_pages: int = MIN_PAGES, contents: list | None = None) -> list[np.ndarray]:
    """For each page, which tokens lie in a run of at least ``run`` tokens that min_pages distinct pages share; pages of
    equal contents (by default, their streams) are one. A longer run is covered by its runs of ``run`` tokens, so the
    suffixes are sorted by that many tokens and no more."""
    sizes = [len(s) for s in streams]
    total = sum(sizes)
    if not total:
        return [np.zeros(n, bool) for n in sizes]
    ids = {w: i + 1 for i, w in enumerate(sorted({w for s in streams for w in s}))}
    numbers: dict = {}
    page = np.repeat([numbers.setdefault(c, len(numbers)) for c in (map(tuple, streams) if contents is None else contents)], sizes)
    rank = np.array([ids[w] for s in streams for w in s], np.int64)
    left = np.concatenate([np.arange(n, 0, -1) for n in sizes]) if total else np.zeros(0, int)
    width = 1
    while width < run:
        step = min(width, run - width)
        following = np.zeros(total, np.int64)
        has = left > step
        following[has] = rank[np.flatnonzero(has) + step]
        order = np.lexsort((following, rank))
        new = np.concatenate(([True], (rank[order][1:] != rank[order][:-1]) | (following[order][1:] != following[order][:-1])))
        rank = rank.copy()
        rank[order] = np.cumsum(new)
        width += step
    starts = np.flatnonzero(left >= run)
    pairs = np.unique(np.stack((rank[starts], page[starts]), 1), axis=0) if len(starts) else np.zeros((0, 2), int)
    kinds, pages = np.unique(pairs[:, 0], return_counts=True)
    common = starts[np.isin(rank[starts], kinds[pages >= min_pages])]
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, common, 1)
    np.add.at(change, common + run, -1)
    over = np.cumsum(change[:-1]) > 0
    return np.split(over, np.cumsum(sizes)[:-1])


def run_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """A 64-bit hash of every run of ``RUN`` tokens; known keeps the hashes of tokens."""
    n = len(words) - RUN + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if len(known) > 500_000:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = int.from_bytes(blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")
    hashes, factor = np.array([known[w] for w in words], U), powers(0xD1B54A32D192ED03, RUN + 1)
    out = np.zeros(n, U)
    for k in range(RUN):
        out += hashes[k : k + n] * factor[k + 1]
    return mix(out).view(np.int64)


def covered_by(streams: list[list[str]], common: np.ndarray) -> list[np.ndarray]:
    """For each page, which tokens lie in a run whose hash is in common (sorted)."""
    known: dict[str, int] = {}
    out = []
    for words in streams:
        over, runs = np.zeros(len(words), bool), run_hashes(words, known)
        if len(common) and len(runs):
            starts = np.flatnonzero(common[np.minimum(np.searchsorted(common, runs), len(common) - 1)] == runs)
            for k in range(RUN):
                over[starts + k] = True
        out.append(over)
    return out


def main_texts(pages: list[list[tuple[bool, str]]], common: np.ndarray | None = None) -> list[str]:
    """Texts of a host's pages; of some of its pages, if common has the hashes of the host's recurring runs."""
    streams = [[w for inside, b in page if not inside for w in b.split()] for page in pages]
    contents = ["\n".join(b for _, b in page) for page in pages]
    out = []
    for page, over in zip(pages, covered(streams, contents=contents) if common is None else covered_by(streams, common), strict=True):
        kept, at = [], 0
        for inside, b in page:
            if inside:
                kept.append(b)
                continue
            words = b.split(" ")
            part = over[at : at + len(b.split())]
            at += len(b.split())
            if not part.any():
                kept.append(b)
            elif not part.all() and len(words) == len(part):
                kept.append(" ".join(w for w, gone in zip(words, part, strict=True) if not gone))
        out.append("\n".join(kept))
    return out


def recurring_runs(pages: DataFrame) -> DataFrame:
    """(host, run) of every run that MIN_PAGES distinct pages of a host share; pages: host (long), html."""
    small_batches(pages.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for host, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = blocks_of(html)
                runs = np.unique(run_hashes([w for inside, b in found if not inside for w in b.split()], known))
                if len(runs):
                    page = int.from_bytes(blake2b("\n".join(b for _, b in found).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(runs), host, np.int64)), pa.array(runs), pa.array(np.full(len(runs), page, np.int64))], ["host", "run", "page"])

    # distinct pages of a run are dealt by run and page, then counted in parts
    runs = pages.select("host", "html").mapInArrow(read, "host long, run long, page long")
    return runs.groupBy("host", "run").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= MIN_PAGES).select("host", "run")


def extract_text(df: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def read() -> Callable[..., Iterator[tuple]]:
        def work(keys: list, urls: list, names: list, pages: list) -> Iterator[tuple]:
            for k, u, n, h in zip(keys, urls, names, pages, strict=True):
                found = blocks_of(h)
                yield k, u, n, [i for i, _ in found], [t for _, t in found]

        return work

    host = F.xxhash64(F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit("")))
    parsed = map_columns(df, [F.col(key).try_cast("long"), F.col(url), host, F.col(html)], "page_id long, url string, host long, inside array<boolean>, blocks array<string>", read)
    hosts = keep(df.groupBy(host.alias("host")).agg(F.ceil(F.count("*") / CHUNK_PAGES).cast("int").alias("chunks")), "hosts")
    large = hosts.where("chunks > 1")
    common = keep(recurring_runs(df.select(host.alias("host"), F.col(html).alias("html")).join(large, "host", "left_semi")), "runs")
    common = common.groupBy("host", F.pmod("run", F.lit(64)).alias("part")).agg(F.collect_list("run").alias("runs")).join(large, "host")
    common = common.select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)).alias("chunk"), F.lit(True).alias("many"), "runs")
    dealt = parsed.join(hosts, "host").withColumn("chunk", F.pmod(F.xxhash64("page_id", "url"), F.col("chunks")))
    dealt = dealt.select("host", "chunk", (F.col("chunks") > 1).alias("many"), F.lit(None).cast("array<long>").alias("runs"), "page_id", "url", "inside", "blocks").unionByName(common, allowMissingColumns=True)
    dealt = dealt.repartition("host", "chunk").sortWithinPartitions("host", "chunk", F.col("runs").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        common: list[list[int]] = []
        at = None

        def done() -> pa.RecordBatch:
            known = np.unique(np.array([x for part in common for x in part], np.int64)) if at[2] else None
            texts = main_texts([list(zip(r[6], r[7], strict=True)) for r in rows], known)
            return pa.RecordBatch.from_arrays([pa.array([r[4] for r in rows], pa.int64()), pa.array([r[5] for r in rows], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (row[:3] != at or (at[2] and len(rows) >= CHUNK_PAGES)):
                    yield done()
                    rows = []
                if row[:3] != at:
                    at, common = row[:3], []
                if row[3] is not None:
                    common.append(row[3])
                else:
                    rows.append(row)
        if rows:
            yield done()

    return dealt.mapInArrow(run, "page_id long, url string, text string, n_chars long")
