"""Main text of HTML pages, with a suffix array over the pages of a host.

A page is read as blocks of visible text in page order; what markup names as menu, header, footer, sidebar, notice, advert,
form or reader comments is no candidate. If the page marks an article (or main part), its blocks are the text and the rest
goes. Blocks of other pages are undecided: the token streams of a host's undecided blocks are concatenated, a suffix array
finds the long substrings that repeat across distinct pages, over the edges of blocks too, and tokens they cover are
boilerplate: those runs of a block go that are long or the whole block, and its other tokens stay. A few words at the edge
of a block that only continue the block beside it stay.

Inside a marked article the suffix array decides nothing: pages of one host repeat whole articles and paragraphs, and
those are text, not boilerplate.

Defined cases: a null or empty page has an empty text; unclosed elements end where their container ends; a page that ends
early is read to its end; rows of equal page id are pages of their own; an empty table gives no rows; further columns are
not read."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Tokens that a repeated substring must have, and distinct pages it must stand on.
REPEAT_TOKENS, REPEAT_PAGES = 6, 3
#: Tokens of a host that one suffix array holds; the suffixes of a larger host are dealt by their first tokens.
HOST_TOKENS = 1_000_000

#: Element names.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
DROPPED = frozenset("nav header footer aside form menu dialog button select noscript iframe svg head template object video audio canvas figure".split()) - {"figure"}
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that name what is not main text.
UNWANTED = frozenset("ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar widget footer header masthead cookie cookies consent gdpr notice popup modal newsletter subscribe share sharing social comment comments commentlist disqus respond replies related recommended form login search".split())

# a tag ends at the next tag or the end of the page too, so no search looks at a part of the page again and again
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/><]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\"><]++)*+)(?:>|(?=<)|\Z)", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_SPACE = re.compile(r"\s+")
_RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for x in RAW}


#: Words that name the head of an article where they stand inside it.
OWN_HEAD = frozenset(("header", "masthead"))


def unwanted(attributes: str, article: bool = False) -> bool:
    return any(w in UNWANTED and not (article and w in OWN_HEAD) for m in _NAMED.finditer(attributes) for w in re.split(r"[^a-z0-9]+", m[1].lower()))


def blocks(page: str | None) -> tuple[list[str], bool]:
    """The candidate blocks in page order, and whether an article holds them."""
    page = page or ""
    inside: list[str] = []  # blocks of articles
    outside: list[str] = []
    part: list[str] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether they are dropped
    open_: dict[str, int] = {}  # how many of each name
    dropped = article = 0
    found = False

    def close() -> None:
        if part:
            text = _SPACE.sub(" ", html.unescape("".join(part))).strip()
            if text:
                (inside if article else outside).append(text)
            part.clear()

    def pop() -> None:
        nonlocal dropped, article
        name, drops = stack.pop()
        open_[name] -= 1
        dropped -= drops
        article -= name in ("article", "main")

    at = 0
    while True:
        m = _TAG.search(page, at)
        if not dropped:
            part.append(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCK or name in DROPPED:
            close()
        elif name in VOID and not dropped:
            part.append(" ")
        if m[1]:
            if open_.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        if name in ("p", "li", "tr", "td", "th", "option", "dt", "dd") and stack and any(n == name for n, _ in stack[-3:]):
            # an open element of the kind ends here, unless a container stands between
            for k in range(len(stack) - 1, max(len(stack) - 4, -1), -1):
                if stack[k][0] == name:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in BLOCK:
                    break
        # the parts of an article have their own header, and the article itself is never unwanted by its name
        drops = (name in DROPPED and not (name == "header" and article)) or (name not in ("article", "main", "body", "html") and unwanted(m[3], article > 0))
        stack.append((name, drops))
        open_[name] = open_.get(name, 0) + 1
        dropped += drops
        if name in ("article", "main") and not dropped:
            found = True
        article += name in ("article", "main")
    close()
    return (inside, True) if found else (outside, False)




def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_key, page_id, url, html) with the blocks in place of the page."""
    for batch in batches:
        _, offsets = common.buffers(batch.column(3))
        for low, high in common.steps(offsets):
            part = batch.slice(low, high - low)
            keep, article = [], []
            for page in part.column(3):
                b, a = blocks(page.as_py())
                keep.append(b)
                article.append(a)
            tokens = [0 if a else sum(x.count(" ") + 1 for x in b) for b, a in zip(keep, article, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(keep, pa.list_(pa.string())), pa.array(article, pa.bool_()), pa.array(tokens, pa.int64())], ["page_key", "page_id", "url", "blocks", "article", "tokens"])


def suffixes(codes: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; every negative code is a separator of its own."""
    n = len(codes)
    _, rank = np.unique(codes, return_inverse=True)
    width = 1
    order = np.argsort(rank, kind="stable")
    while n > 1:
        after = np.full(n, -1, np.int64)
        after[: n - width] = rank[width:]
        order = np.lexsort((after, rank))
        fresh = np.concatenate(([0], ((rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])).astype(np.int64)))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if fresh.sum() == n - 1:
            break
        width *= 2
        if width >= n:
            break
    return order


def covered(pages: list[list[str]], keys: list[int] | None = None, least: int = REPEAT_TOKENS, distinct: int = REPEAT_PAGES) -> list[list[np.ndarray]]:
    """For each block of each page which of its tokens repeated substrings cover. Rows of equal key are one page."""
    number: dict[int, int] = {}
    words: dict[str, int] = {}
    codes, owner = [], []
    for i, page in enumerate(pages):
        own = [words.setdefault(w, len(words)) for text in page for w in text.split(" ")]
        codes += [*own, -1 - i]
        owner += [i if keys is None else number.setdefault(keys[i], len(number))] * (len(own) + 1)
    if not codes:
        return [[] for _ in pages]
    c, who = np.array(codes), np.array(owner)
    order = suffixes(c)
    m = len(c)
    # which neighbours in the suffix array share `least` tokens (no separator is among shared ones)
    same = np.ones(m - 1, bool)
    for k in range(least):
        x, y = order[:-1] + k, order[1:] + k
        same &= (x < m) & (y < m)
        same &= c[np.minimum(x, m - 1)] == c[np.minimum(y, m - 1)]
    group = np.concatenate(([0], np.cumsum(~same)))
    pairs = np.unique(np.stack((group, who[order])), axis=1)
    common_ = np.bincount(pairs[0], minlength=group[-1] + 1) >= distinct
    starts = order[common_[group]]
    cover = np.zeros(m + least + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + least, -1)
    mask, at, out = (np.cumsum(cover)[:m] > 0) & (c >= 0), 0, []
    for page in pages:
        out.append([])
        for text in page:
            n = text.count(" ") + 1
            out[-1].append(mask[at : at + n])
            at += n
        at += 1  # the separator
    return out


def repeated(pages: list[list[str]], keys: list[int] | None = None, least: int = REPEAT_TOKENS, distinct: int = REPEAT_PAGES) -> list[list[float]]:
    """For each block of each page the share of its tokens that repeated substrings cover."""
    return [[float(x.mean()) for x in own] for own in covered(pages, keys, least, distinct)]


def uncovered(blocks: list[str], masks: list[np.ndarray]) -> list[str]:
    """The blocks without their covered runs that are long or the whole block."""
    out = []
    for text, mask in zip(blocks, masks, strict=True):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], np.asarray(mask, np.int8), [0])))).tolist()
        words = text.split(" ")
        for a, b in reversed(list(zip(edges[::2], edges[1::2], strict=True))):
            if b - a >= REPEAT_TOKENS or b - a == len(mask):
                del words[a:b]
        if words:
            out.append(" ".join(words))
    return out


def _unique_runs(pages):
    """The pages of one host, or of one of its parts, without the tokens that repeats cover."""
    masks = covered([list(b) for b in pages["blocks"]], pages["page_key"].tolist())
    pages["blocks"] = [uncovered(list(b), own) for b, own in zip(pages["blocks"], masks, strict=True)]
    return pages[["page_id", "url", "blocks"]]


def _cleared(batches):
    """Pages with their covered places to pages without those."""
    for pages in batches:
        kept = []
        for own, places in zip(pages["blocks"], pages["covered"], strict=True):
            ends = np.cumsum([x.count(" ") + 1 for x in own])
            mask = np.zeros(int(ends[-1]), bool)
            if places is not None:
                mask[np.asarray(places, np.int64)] = True
            kept.append(uncovered(list(own), np.split(mask, ends[:-1])))
        pages["blocks"] = kept
        yield pages[["page_id", "url", "blocks"]]


def _dealt(pages: DataFrame) -> DataFrame:
    """The same for hosts that are too large for one array: suffixes that share their first tokens meet in one group,
    which counts its distinct pages; only tokens that repeats cover come back to their pages."""
    page = pages.select("host", "page_key", F.split(F.array_join("blocks", " "), " ").alias("words")).dropDuplicates(["page_key"])
    starts = F.when(F.size("words") >= REPEAT_TOKENS, F.transform(F.sequence(F.lit(1), F.size("words") - REPEAT_TOKENS + 1), lambda i: F.xxhash64(F.slice("words", i, F.lit(REPEAT_TOKENS)))))
    suffix = page.select("host", "page_key", F.posexplode(starts).alias("at", "first"))
    often = suffix.select("host", "first", "page_key").distinct().groupBy("host", "first").agg(F.count("*").alias("pages")).where(F.col("pages") >= REPEAT_PAGES).select("host", "first")
    hit = suffix.join(often, ["host", "first"]).groupBy("page_key").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + REPEAT_TOKENS - 1)))).alias("covered"))
    joined = pages.join(hit, "page_key", "left").select("page_id", "url", "blocks", "covered")
    return joined.mapInPandas(_cleared, "page_id long, url string, blocks array<string>")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Rows (page_id, url, text, n_chars)."""
    spark = pages.sparkSession
    shared = common.Shared(spark)
    source = pages.select(F.xxhash64(page_id, url, page).alias("page_key"), F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    parsed = shared.write(source.mapInArrow(common.tidy(_parsed), "page_key long, page_id long, url string, blocks array<string>, article boolean, tokens long"), keep=True)
    done = parsed.where("article OR tokens = 0").select("page_id", "url", "blocks")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1))
    open_ = parsed.where("NOT article AND tokens > 0").withColumn("host", host)
    sizes = open_.groupBy("host").agg(F.sum("tokens").alias("host_tokens"))
    sized = open_.join(sizes, "host")
    small = sized.where(F.col("host_tokens") <= HOST_TOKENS).groupBy("host").applyInPandas(_unique_runs, "page_id long, url string, blocks array<string>")
    large = _dealt(sized.where(F.col("host_tokens") > HOST_TOKENS))
    rest = small.unionByName(large)
    text = F.array_join("blocks", "\n\n")
    return done.unionByName(rest).select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))
