"""HTML extraction: a minimum cut labels a page's blocks content or boilerplate."""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylattice.llm.common import table

#: Training bounds: pages, and characters of a training page. Every page is extracted whole.
MAX_PAGES, MAX_CHARS = 400, 60_000
#: Costs of labelling neighbours differently: next in page order, and next with the same DOM parent.
NEXT, SIBLING = 0.4, 0.4

# Elements whose content is never text of the page; fixed values. Those of RAW run to their end tag or the page's end; of the
# others one that isn't closed within its section runs to the next block.
RAW, HIDDEN = "script|style|template|title|textarea", "select|button|svg|iframe"
# Elements that end a block; fixed values.
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = set("nav header footer aside form menu dialog".split())
CONTENT = set("article main".split())
VOID = set("br hr img input meta link area base col embed source track wbr".split())
# Names (or last words of names) in class, id and role that stand for boilerplate; fixed values.
BAD_WORDS = set(
    "ad ads advert advertisement advertising adverts adbox adsense banner breadcrumb breadcrumbs comment comments commentlist discussion disqus replies "
    "cookie cookies consent gdpr notice notices notification alert popup modal promo promoted promotion sponsor sponsored subscribe subscription "
    "newsletter signup login share sharing social menu nav navbar navigation navigation topnav masthead footer sidebar widget widgets related "
    "recommended recommendations pagination pager toolbar copyright disclaimer outbrain taboola teaser contentinfo complementary".split()
)
# Words that, after a word of boilerplate, name its container: `share-buttons`, `comment-list`; fixed values.
PARTS = set("area bar block body box button buttons container content form group inner item items label left link links list outer panel right row section slot thread top unit wrap wrapper".split())
# First words that stand for boilerplate only before such a word or in a role; fixed values.
WEAK_WORDS = set("search tags tag legal more header side rail overlay paging form respond".split())
# First words that stand for boilerplate if the last one names a container, whatever is between: `cookie-law-info-bar`; fixed values.
STRONG_WORDS = set("cookie cookies gdpr consent newsletter advert advertisement adsense".split())
GOOD_WORDS = set("article main content body post entry story text".split())

# A self-closed svg has no content; a slash that ends an unquoted value doesn't close it.
_EMPTY = r"<svg(?:\s+[^\s=>\"'/]++(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']++))?)*+\s*/>"
_OPEN = r"(?=[\s>/])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
_SECTION = r"/(?:article|main|section|body|html)\b"
_BLOCKS = "|".join(sorted(BLOCK, key=len, reverse=True))
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|{_EMPTY}|<(?P<raw>{RAW}){_OPEN}.*?(?:</(?P=raw)\s*>|\Z)|"
    rf"<(?P<hidden>{HIDDEN}){_OPEN}[^<]*+(?:<(?!{_SECTION}|(?P=hidden)[\s>/]|/(?P=hidden)\s*>)[^<]*+)*+</(?P=hidden)\s*>|"
    rf"<(?:{HIDDEN}){_OPEN}[^<]*+(?:<(?!/?(?:{_BLOCKS})[\s>/])[^<]*+)*+|"
    r"<(?P<close>/?)(?P<tag>[a-zA-Z][^\s>/]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.S | re.I,
)
HINT = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[a-z]+")


def _names_boilerplate(words: list[str], role: bool) -> bool:
    if words[0] in STRONG_WORDS and (words[-1] in PARTS or words[-1] in BAD_WORDS):
        return True
    last = len(words)
    while last > 1 and words[last - 1] in PARTS:
        last -= 1
    return words[last - 1] in BAD_WORDS or words[last - 1] in WEAK_WORDS and (role or last < len(words))


def hint_of(tag: str, attrs: str, inside: int) -> int:
    """-1 boilerplate, 1 content, 0 what the parent is. `inside` is the parent's."""
    if attrs and ("=" in attrs):
        good = bad = False
        for m in HINT.findall(attrs):
            for name in "".join(m[1:]).lower().split():
                words = WORDS.findall(name)
                if words:
                    bad |= _names_boilerplate(words, m[0].lower() == "role")
                    good |= not GOOD_WORDS.isdisjoint(words)
        if bad and not (tag in CONTENT and good):
            return -1
        if good and tag not in BOILERPLATE:
            return 1
    if tag == "header" and inside > 0:  # the heading of an article
        return 0
    return -1 if tag in BOILERPLATE else 1 if tag in CONTENT else 0


class Block:
    __slots__ = ("hint", "linked", "parent", "tag", "text")

    def __init__(self, text: str, linked: int, hint: int, parent: int, tag: str):
        self.text, self.linked, self.hint, self.parent, self.tag = text, linked, hint, parent, tag


def blocks_of(page: str) -> list[Block]:
    """Non-empty text blocks in page order, with their parent and their hint: that of the nearest ancestor that has one, of the
    paragraph itself, or of inline elements that hold most of the text."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, hint, number
    depth: dict[str, int] = {}  # open elements of each name
    text: list[str] = []
    linked = vetoed = opened = own = 0
    in_link, tag = False, ""
    inline, level = "", 0  # the inline element of boilerplate that is open, and how often its name is
    at = 0

    def end() -> None:
        nonlocal linked, text, vetoed, own
        if text:
            raw = "".join(text)
            joined = " ".join(entities.unescape(raw).split())
            if joined:
                hint = -1 if 2 * vetoed > len(raw) else own or stack[-1][1]
                out.append(Block(joined, min(linked, len(joined)), hint, stack[-1][2], tag))
            text, linked, vetoed = [], 0, 0
        own = 0

    for m in TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
            if inline:
                vetoed += m.start() - at
        at = m.end()
        name = m["tag"]
        if name is None:
            continue
        name = name.lower()
        if name in BLOCK:
            end()
            tag, inline = name, ""
            if m["close"]:
                if depth.get(name):
                    while True:
                        gone = stack.pop()[0]
                        depth[gone] -= 1
                        if gone == name:
                            break
            elif name == "p":
                own = hint_of(name, m["attrs"], stack[-1][1]) if m["attrs"] else 0
            elif name not in VOID and not m["attrs"].endswith("/"):
                opened += 1
                hint = hint_of(name, m["attrs"], stack[-1][1]) or stack[-1][1]
                stack.append((name, hint, opened))
                depth[name] = depth.get(name, 0) + 1
            continue
        if name == "a":
            in_link = not m["close"]
        elif name == "br":
            text.append(" ")
        if name == inline:
            level += -1 if m["close"] else 1
            if not level:
                inline = ""
        elif not inline and m["attrs"] and not m["close"] and name not in VOID and not m["attrs"].endswith("/") and hint_of(name, m["attrs"], 0) < 0:
            inline, level = name, 1
    if at < len(page):
        text.append(page[at:])
        if inline:
            vetoed += len(page) - at
    end()
    return out


def features(blocks: list[Block], hints: bool = True) -> np.ndarray:
    x = np.zeros((len(blocks), 10))
    for i, b in enumerate(blocks):
        n, words = len(b.text), b.text.count(" ") + 1
        x[i] = (
            1,
            b.hint > 0 if hints else 0,
            b.hint < 0 if hints else 0,
            # Inside what is marked as content a link is part of it.
            0 if hints and b.hint > 0 else b.linked / n,
            min(math.log1p(words), 6) / 3,
            min(math.log1p(n), 8) / 4,
            b.tag == "p",
            b.tag == "li",
            b.tag in ("h1", "h2", "h3"),
            b.text[-1] in ".!?",
        )
    return x


def train(pages: list[str], rounds: int = 1500) -> np.ndarray:
    """Logistic weights from a bounded sample, taught by the blocks whose markup says what they are.

    Every block counts twice, once with its hints hidden, so that the text's own features carry pages without such
    markup. Without any taught block the starting weights hold.
    """
    weights = np.array([-0.5, 4.0, -6.0, -2.0, 0.5, 0.5, 0.5, -0.5, 0.5, 0.5])
    start = weights.copy()
    xs, ys = [np.zeros((0, 10))], [np.zeros(0)]
    for page in pages:
        taught = [b for b in blocks_of(page) if b.hint]
        if taught:
            y = np.array([b.hint > 0 for b in taught], dtype=float)
            xs += [features(taught), features(taught, hints=False)]
            ys += [y, y]
    x, y = np.vstack(xs), np.concatenate(ys)
    if len(y):
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            weights += 0.5 * (x.T @ (y - p) / len(y) - 1e-3 * (weights - start))
    return weights


def min_cut(gain: list[float], parents: list[int]) -> list[bool]:
    """Source side of a minimum cut. gain > 0: capacity from the source, < 0: to the sink; edges, both ways, join neighbours in
    page order (NEXT) and neighbours among the blocks of one parent (SIBLING).

    Elements nest, so no two edges cross, and the maximum flow is found by series reduction: a block between two others is
    replaced by the equivalent edge and terminal capacities of these, which pass on whatever flow it lets through; an edge
    beside another one adds its capacity. Blocks are put back in reverse, each on its cheaper side. Linear in the blocks.
    """
    g = list(gain)
    path: list[int] = []  # blocks not yet replaced, and the capacity from each to the one before
    cap: list[float] = []
    last: dict[int, int] = {}
    gone: list[tuple[int, int, int, float, float, float]] = []

    def reduced(x: int, u: int, v: int, c: float, d: float) -> float:
        """Takes x from between u (capacity c) and v (capacity d; -1: there is none); the capacity of the new edge."""
        t, s = max(g[x], 0.0), max(-g[x], 0.0)  # costs of x as boilerplate and as content
        gone.append((x, u, v, c, d, g[x]))
        if v < 0:
            g[u] -= min(s, t + c) - min(t, s + c)
            return 0.0
        none, both = min(t, s + c + d), min(s, t + c + d)
        left, right = min(t + c, s + d), min(t + d, s + c)  # u alone is content, v alone is
        g[u] -= (left - right + both - none) / 2
        g[v] -= (right - left + both - none) / 2
        return max((left + right - none - both) / 2, 0.0)

    for i, parent in enumerate(parents):
        path.append(i)
        cap.append(NEXT if i else 0.0)
        before = last.get(parent)
        if before is not None:
            while path[-2] != before:
                c, d = cap[-2], cap[-1]
                x = path.pop(-2)
                cap[-2:] = [reduced(x, path[-2], i, c, d)]
            cap[-1] += SIBLING
        last[parent] = i
    while len(path) > 1:
        x = path.pop()
        reduced(x, path[-1], -1, cap.pop(), 0.0)
    side = [x > 1e-12 for x in g]
    for x, u, v, c, d, own in reversed(gone):
        content = max(-own, 0.0) + c * (not side[u]) + (d * (not side[v]) if v >= 0 else 0.0)
        boilerplate = max(own, 0.0) + c * side[u] + (d * side[v] if v >= 0 else 0.0)
        side[x] = content < boilerplate - 1e-12
    return side


def main_text(page: str, weights: np.ndarray) -> str:
    """The blocks on the content side of the cut, joined by line feeds."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    gain = (features(blocks) @ weights).tolist()
    return "\n".join(b.text for b, keep in zip(blocks, min_cut(gain, [b.parent for b in blocks]), strict=True) if keep)


def extract_main_text(pages: DataFrame, max_pages: int = MAX_PAGES, max_chars: int = MAX_CHARS) -> DataFrame:
    """`pages` (page_id, html, ...) with text and n_chars (code points) of the main text.

    Block costs come from a classifier that is fitted on a bounded sample of pages and become terminal
    capacities; page order and a shared DOM parent give the smoothness edges; the cut decides. Null and empty
    pages, and pages without a content block, get an empty text; an empty table gives an empty result. The cost of a page is
    linear in its length. Of equal costs, boilerplate wins. Rows may repeat and ids be null; other columns stay, but columns
    named text or n_chars are replaced. One pass, no shuffle.
    """
    spark = pages.sparkSession
    pages = pages.drop("text", "n_chars")
    short = pages.where(F.char_length("html").between(1, max_chars)).select("html", F.xxhash64("html").alias("key"))
    # Keys first: each task sends a few numbers, not its pages.
    keys = [r.key for r in short.select("key").distinct().orderBy("key").limit(max_pages).collect()]
    sample = [r.html for r in short.where(F.col("key").isin(keys)).groupBy("key").agg(F.min("html").alias("html")).orderBy("key").collect()]
    weights = spark.sparkContext.broadcast(train(sample))

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p, weights.value) if p else "" for p in batch], dtype=object)

    out = pages.withColumn("text", extracted("html"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of all `pages`; null, empty, very long and repeated pages as in `extract_main_text`."""
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
