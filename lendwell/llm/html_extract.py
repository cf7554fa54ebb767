"""Main text of web pages, with site templates found by counting element subtrees per host.

First pass: every page is parsed, its container elements are hashed bottom-up (tag, own text
and child hashes), and Spark counts in how many pages of a host each hash occurs. Pages that are near
copies of each other count once, so that copies of one article do not turn its parts into templates.
They are told by MinHash bands over runs of five words of the main text, 16 numbers a page: texts that share 0.8
of their runs share a band with a probability of 0.9998, others with less than half in common rarely.
Second pass: subtrees that recur in a share of the host's unlike pages, or in a number of
them, are deleted, as are elements that by tag, role or class are no article text; what is left of the
article becomes blocks.

A page's article is its ``article`` elements, else its ``main`` element, else its body. Inside
an article paragraphs, headings and quotations stay however often they recur; lists, tables, figures
and other containers are counted. A class or id says that an element is no text if a whole name does, such as
``sidebar``, or all words of a name say so or nothing, such as ``site-footer`` or ``share-buttons``, but not
``social-history``; inside an article fewer names count.

Cases: null or empty html gives an empty text; unclosed and crossed tags are closed as
browsers do; a reference that is cut by a tag is none; a page without a host is counted with all others
without one; repeated rows each give a row; very long and deeply nested pages are parsed in time and memory
that grow with their length, alone in their piece; no pages give no rows; other columns do not matter. A box that is most
of the text of its pages makes them near copies, and stays.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendwell.llm.common import by_bytes, small_side
from lendwell.llm.components import components
from lendwell.llm.words import mixed, shingles, words_of
from lendwell.session import checkpointed

# A subtree is a template when it is in this share of a host's unlike pages, and in so many at least,
TEMPLATE_SHARE = 0.1
TEMPLATE_PAGES = 5
# or, on a host of any size, in so many unlike pages.
UNLIKE_PAGES = 20
# Runs of words, bands and values of a band that tell near copies.
NEAR_SHINGLE, BANDS, BAND_ROWS = 5, 16, 4
# Texts with fewer runs have a hash for every value.
FEW_RUNS = 256
PIECE_CHARS = 1 << 20

# Element names of HTML and words that name parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section "
    "summary table caption tbody td tfoot th thead tr ul".split()
)
# Not counted inside an article: its prose, and parts of lists and tables, which are counted as wholes.
PROSE = frozenset(
    "p h1 h2 h3 h4 h5 h6 hgroup blockquote pre li dt dd caption thead tbody tfoot tr td th figcaption address".split()
)
# Elements that end an open element of their own kind, up to the list or table they are in.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
NO_TEXT_TAGS = frozenset(
    "head nav aside footer form button select dialog menu template svg math canvas object audio video".split()
)
NO_TEXT_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split()
)
NO_TEXT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements sponsor sponsored promo banner cookie cookies consent gdpr "
    "notice notices sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs comment comments disqus "
    "respond share sharing social related recommended newsletter subscribe popup modal footer masthead pagination "
    "pager login signup".split()
)
# Words of compound names that say nothing by themselves.
FILLER = frozenset(
    "site page main top bottom left right list lists item items box boxes bar bars wrapper wrap container inner outer area "
    "block section widget widgets link links post posts button buttons icon icons title header head primary secondary "
    "global mobile desktop form forms".split()
)
# The names that also count inside an article.
NEVER_TEXT = frozenset(
    "ad ads adv advert adverts advertisement advertisements sponsor sponsored cookie cookies consent gdpr sidebar "
    "sidebars nav navbar navigation breadcrumb breadcrumbs comment comments disqus respond share sharing newsletter "
    "subscribe popup modal pagination pager login signup".split()
)
NO_ARTICLE_NAMES = frozenset("comment ad ads advert sponsored promo related teaser".split())
DEEP = 64

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+>",
    re.S,
)
COMMENT = re.compile(r"<!--.*", re.S)
MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true", re.I)
NAME = re.compile(r"[a-z0-9]+")


@dataclass
class Block:
    text: str
    place: str  # article, main or body
    inside: int  # number of the innermost container around it, or -1


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    hashes: list[int] = field(default_factory=list)  # by container; 0 while open
    around: list[int] = field(default_factory=list)  # the next container around each, a smaller number, or -1
    article: bool = False
    main: bool = False

    def text(self, templates: frozenset[int] | set[int] = frozenset()) -> str:
        place = "article" if self.article else "main" if self.main else "body"
        gone = [False] * (len(self.hashes) + 1)  # the last one stands for no container
        for number, (digest, outer) in enumerate(zip(self.hashes, self.around)):
            gone[number] = gone[outer] or digest in templates
        left = [b.text for b in self.blocks if (b.place == place or place == "body") and not gone[b.inside]]
        return "\n\n".join(left)


def says_no_text(name: str, names: frozenset[str]) -> bool:
    """Whether a whole class name, or all its words together, are among ``names``."""
    if name in names:
        return True
    words = NAME.findall(name)
    return not names.isdisjoint(words) and all(w in names or w in FILLER for w in words)


def unwanted(tag: str, attributes: str, in_article: bool) -> bool:
    """True for elements that by tag, role or class hold no article text."""
    if tag in NO_TEXT_TAGS or (tag == "header" and not in_article):
        return True
    if not attributes:
        return False
    if tag in ("html", "body"):
        return False
    if HIDDEN.search(attributes):
        return True
    for kind, *values in MARKS.findall(attributes):
        value = next((v for v in values if v), "").lower()
        if kind.lower() == "role":
            if value.strip() in NO_TEXT_ROLES:
                return True
        elif tag in ("article", "main"):
            if not NO_ARTICLE_NAMES.isdisjoint(value.split()):
                return True
        elif any(says_no_text(name, NEVER_TEXT if in_article else NO_TEXT_NAMES) for name in value.split()):
            return True
    return False


def parse(source: str) -> Page:
    """Blocks and container hashes of a page."""
    page = Page()
    # Frames: tag, hash parts, hidden, place, container number or -1, number of the innermost container
    stack: list[tuple[str, list[str], bool, str, int, int]] = [("", [], False, "body", -1, -1)]
    open_tags: dict[str, int] = {}
    words: list[str] = []

    def end_block() -> None:
        if words:
            text = " ".join("".join(words).split())
            words.clear()
            if text:
                top = stack[-1]
                page.blocks.append(Block(text, top[3], top[5]))

    def close() -> None:
        tag, parts, _, _, number, _ = stack[-1]
        if tag in BLOCK:
            end_block()
        stack.pop()
        open_tags[tag] -= 1
        digest = xxhash.xxh64_intdigest(f"{tag}\x00" + "\x00".join(parts)) >> 1
        if number >= 0:
            page.hashes[number] = digest
        stack[-1][1].append(f"{digest:x}")

    def close_to(names: set[str], stops: set[str] | frozenset[str]) -> None:
        for back in range(1, min(DEEP, len(stack))):
            tag = stack[-back][0]
            if tag in names:
                for _ in range(back):
                    close()
                return
            if tag in stops:
                return

    def text(piece: str) -> None:
        if piece:
            frame = stack[-1]
            frame[1].append(piece)
            if not frame[2]:
                words.append(entities.unescape(piece))

    at, size, last = 0, len(source), source.rfind(">")
    while at < size:
        # Without another ">" only a comment can follow; looking for tags would start over at every "<".
        found = TAG.search(source, at) if at <= last else COMMENT.search(source, at)
        if not found:
            text(source[at:])
            break
        text(source[at : found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower() if found.re is TAG else ""
        if not tag:
            continue
        attributes = found[3] or found[6] or ""
        if found[1] or found[4]:
            if tag == "br":
                words.append(" ")
            elif open_tags.get(tag):
                while stack[-1][0] != tag:
                    close()
                close()
            continue
        if tag in VOID:
            if tag == "hr":
                end_block()
            elif tag == "br":
                words.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
            at = end.end() if end else size
            continue
        block = tag in BLOCK
        if block:
            if open_tags.get("p"):
                while stack[-1][0] != "p":
                    close()
                close()
            if tag in ENDS and any(open_tags.get(t) for t in ENDS[tag][0]):
                close_to(*ENDS[tag])
            end_block()
        _, _, hidden, place, _, inner = stack[-1]
        hidden = hidden or unwanted(tag, attributes, place == "article")
        if tag in ("article", "main") and not hidden:
            if tag == "article":
                place, page.article = "article", True
            elif place == "body":
                place, page.main = "main", True
        number = -1
        if block and tag not in ("html", "body", "head", "article", "main") and (place != "article" or tag not in PROSE):
            number = len(page.hashes)
            page.hashes.append(0)
            page.around.append(inner)
            inner = number
        # A self-closing mark means nothing on HTML elements.
        stack.append((tag, [], hidden, place, number, inner))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    while len(stack) > 1:
        close()
    end_block()
    return page


def bands(texts: list[str]) -> np.ndarray:
    """MinHash bands of texts: 64-bit numbers, which near copies share some of.

    In long texts a run of words has one hash, whose first bits choose the value that it may lower; in
    texts with few runs it has a hash for every value. A text without a run of so many words has
    bands of its own.
    """
    values = BANDS * BAND_ROWS
    words = words_of(texts)
    hashes, valid = shingles(words, NEAR_SHINGLE)
    hashes, docs = hashes[valid], words.docs[: len(hashes)][valid]
    empty = np.uint64(2**64 - 1)
    table = np.full((len(texts), values), empty)
    many = np.bincount(docs, minlength=len(texts)) >= FEW_RUNS
    long = many[docs]
    np.minimum.at(table, (docs[long], (hashes[long] >> np.uint64(58)).astype(np.int64) % values), mixed(hashes[long]))
    # Values that no run chose take the next one's.
    for _ in range(values - 1):
        gaps = (table == empty) & many[:, None]
        if not gaps.any():
            break
        table = np.where(gaps, np.roll(table, -1, axis=1), table)
    hashes, docs = hashes[~long], docs[~long]
    if len(docs):
        starts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
        for value in range(values):
            table[docs[starts], value] = np.minimum.reduceat(mixed(hashes + mixed(np.uint64([value + 1]))), starts)
    whole = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64)
    table = np.where((table == empty).all(axis=1)[:, None], mixed(whole)[:, None], table)
    out = np.zeros((len(texts), BANDS), np.uint64)
    for row in range(BAND_ROWS):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + table[:, row::BAND_ROWS])
    # A band is only compared with the same band.
    return mixed(out + np.arange(BANDS, dtype=np.uint64)) >> np.uint64(1)


def subtrees(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Page, host, hash and bands of the main text, and container hashes of every page."""
    for frame in by_bytes(frames, "html", PIECE_CHARS):
        texts, hashes = [], []
        for source in frame["html"]:
            page = parse(source or "")
            texts.append(page.text())
            hashes.append(sorted(set(page.hashes)))
        yield pd.DataFrame(
            {
                "page": frame["page"],
                "host": frame["host"],
                "content": [xxhash.xxh64_intdigest(t) >> 1 for t in texts],
                "bands": list(bands(texts).astype(np.int64)),
                "hashes": hashes,
            }
        )


def extracted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Text of every page without its host's templates."""
    for frame in by_bytes(frames, "html", PIECE_CHARS):
        texts = [
            parse(source or "").text(set() if found is None else set(found))
            for source, found in zip(frame["html"], frame["templates"])
        ]
        yield pd.DataFrame(
            {"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]}
        )


def host_of(url: str) -> Column:
    """What stands between the first ``://`` and the path, lower-cased; empty if there is none."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    return F.lower(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")))


def near_copies(different: DataFrame, hosts: DataFrame) -> DataFrame:
    """``page, group``: pages of some hosts that share a band with another, also by way of others, and their least page."""
    keyed = different.join(small_side(hosts, hosts.count()), "host", "left_semi").select(
        "host", "page", F.explode("bands").alias("band")
    )
    least = keyed.groupBy("host", "band").agg(F.min("page").alias("b"), F.max("page").alias("most")).filter("b <> most")
    least = checkpointed(least.select("host", "band", "b"))
    edges = keyed.join(small_side(least, least.count()), ["host", "band"]).select(F.col("page").alias("a"), "b")
    return components(edges).select(F.col("vertex").alias("page"), F.col("component").alias("group"))


def templates(pages: DataFrame) -> DataFrame:
    """``page, templates``: each page's subtrees that recur on its host; pages without any have no row.

    ``pages`` has ``page`` (a hash of host and html), ``host`` and ``html``.
    """
    fields = "page long, host string, content long, bands array<long>, hashes array<long>"
    found = checkpointed(pages.mapInPandas(subtrees, fields))
    # Pages with equal main text count once.
    least = F.min(F.struct("hashes", "page", "bands")).alias("least")
    different = found.groupBy("host", "content").agg(least).select("host", "least.*")
    flat = different.select("host", "page", F.explode("hashes").alias("hash"))
    counts = flat.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= TEMPLATE_PAGES)
    candidates = checkpointed(counts.select("host", "hash"))
    number = candidates.count()
    if not number:
        return found.select("page", F.col("hashes").alias("templates")).limit(0)
    hosts = checkpointed(candidates.select("host").distinct())
    groups = checkpointed(near_copies(different, hosts))
    copies = groups.count()

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.join(small_side(groups, copies), "page", "left").withColumn("group", F.coalesce("group", "page"))

    all_groups = grouped(different.select("host", "page")).select("host", "group").distinct()
    sizes = checkpointed(all_groups.groupBy("host").agg(F.count(F.lit(1)).alias("all_groups")))
    holding = grouped(flat.join(small_side(candidates, number), ["host", "hash"])).select("host", "hash", "group").distinct()
    unlike = holding.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("unlike"))
    enough = (F.col("unlike") >= TEMPLATE_PAGES) & (F.col("unlike") >= TEMPLATE_SHARE * F.col("all_groups"))
    known = checkpointed(
        unlike.join(small_side(sizes, sizes.count()), "host")
        .filter(enough | (F.col("unlike") >= UNLIKE_PAGES))
        .select("host", "hash")
    )
    own = found.select("page", "host", F.explode("hashes").alias("hash")).join(
        small_side(known, known.count()), ["host", "hash"]
    )
    return own.groupBy("page").agg(F.sort_array(F.collect_set("hash")).alias("templates"))


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (page_id, url, html)."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        host_of("url").alias("host"),
        F.col("html").cast("string").alias("html"),
    ).withColumn("page", F.xxhash64("host", "html"))
    by_page = checkpointed(templates(rows.select("page", "host", "html")))
    joined = rows.join(small_side(by_page, by_page.count()), "page", "left")
    return joined.select("page_id", "url", "html", "templates").mapInPandas(
        extracted, "page_id long, url string, text string, n_chars long"
    )
