"""Main text of web pages by the maximum-scoring contiguous region.

A page is read as a sequence of tags and words. Words score positive and tags negative, with weights learned from
labelled pages (those that mark their article with an article or main element). One linear scan finds the contiguous region
with the highest sum; of it, the blocks whose words score positive are the text.

A word's weight is the log odds that it is content: the sum of BASE and of the weights of the block elements around it
(their names, classes, ids and roles; of a block of links also that), fitted as a logistic regression on the labelled
pages. The elements that are the labels are no features of the fit, so that what it learns holds on pages without them.
What is known before any page is seen enters as the mean of each weight's prior, and is all that is known of a key that
the pages don't show; a key of many pages is what they make it. Words of log odds below 0 add nothing and are left out. A tag's
weight is learned too: how often it comes within content and how often between.

Two things are judged on a page as a whole. A form, or an element whose names mean no content, that holds half of a page's words or more isn't ruled out by its
keys if nearly all words that could be content are in it, as then it tells nothing apart (a form around a page); but
neither within an article nor beside one. And where
the article or main elements hold a quarter of those words or more, words outside them have OUTSIDE added.

Fitting takes at most SAMPLE labelled pages (a documented bound); every page is scored, whole, in time linear in its
length.

Null and empty pages give the empty text. Damaged pages (unclosed elements, pages cut off within a tag, an
attribute or a reference) give what they hold up to there. Elements nested deeper than DEEPEST are read as text of the
one above. Of regions that tie the first, and the shorter one, wins. Null ids and repeated rows are rows like any other,
and equal pages get equal results. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm.common import bounded_sample, map_rows

SAMPLE = 2_000
KEYS = 4_096  # kinds of blocks, and of tags, that are fitted: the commonest first
DEEPEST = 256

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|textarea|iframe|svg|math|object|canvas|select)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    # An attribute's value is quoted as a whole or not at all: a quote within an unquoted one is part of it.
    r"|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\s+|/(?!>)|[^\s/>=][^\s/>=]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*|(?=>)))?|=)*+)(/?>|\Z)?|[^<]+|<",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img picture".split())
#: Elements that a new paragraph or item ends, where their end tags are left out.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS_THAT_END_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CONTENT = frozenset(("article", "main"))
#: What is known before any page is seen: elements, and words in class, id or role, that mean no content.
NOT_CONTENT = frozenset("nav footer aside form button dialog menu title head".split())
#: Of these, the ones that never hold a whole page's text.
NEVER_AROUND = NOT_CONTENT - {"form"}
NAMES = re.compile(
    r"(?:^|[-_ ])(?:ad|ads|adv|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|sidebar|side|menu|navbar|nav|navigation|breadcrumb|breadcrumbs|toolbar|pager|pagination"
    r"|footer|header|masthead|topbar|comment|comments|commentlist|reply|replies|respond|disqus|cookie|cookies|consent|notice|notices|notification|alert|gdpr|popup|modal|overlay|newsletter|subscribe|subscription|signup|login"
    r"|share|sharing|social|related|recommended|widget|search|searchform|form|copyright|legal|skip|hidden|contentinfo|complementary)(?:$|[-_ \d])",
    re.I,
)
#: Log odds of a word under no key that tells; of keys known to be content and not to be; of words outside a page's article.
BASE, FOR, AGAINST, OUTSIDE = 0.5, 4.0, -12.0, -8.0
#: Precision of a weight's prior, and the bounds of what is learned: of any weight, and from above of those of general elements.
PRECISION, MOST, MOST_GENERAL = 0.2, 12.0, 2.0
#: Elements too general for their words to be judged by: they may raise a word's score, not lower it.
GENERAL = frozenset("div section p ul ol li dl dt dd table tbody tr td th center blockquote h1 h2 h3 h4 h5 h6 figure figcaption hgroup details summary pre header".split())
TEXTUAL = INLINE - {"a"} | frozenset("p br h1 h2 h3 h4 h5 h6 blockquote pre".split())
LINKS = "!links"


def tag_prior(tag: str) -> float:
    """The weight of a tag before learning: text is full of paragraphs and emphasis, boilerplate of links and containers."""
    return -0.1 if tag.lstrip("/") in TEXTUAL else -1.0


def prior(key: str) -> float:
    """The weight of a key before learning."""
    if key in CONTENT:
        return FOR
    if key == LINKS:
        return -2.0
    if key in NOT_CONTENT or key in ("!hidden", "!header") or key[0] == "." and NAMES.search(key[1:]):
        return AGAINST
    return 0.0


class Element:
    """A block element: its keys, the element around it, whether content marks enclose it, and words within (counted later)."""

    __slots__ = ("tag", "keys", "above", "inside", "words", "depth", "number")

    def __init__(self, tag: str, keys: tuple[str, ...], above: Element | None, number: int) -> None:
        self.tag, self.keys, self.above, self.number = tag, keys, above, number
        self.inside = tag in CONTENT or above is not None and above.inside
        self.depth = above.depth + 1 if above else 0
        self.words = 0


class Block:
    """Text between block boundaries: its pieces, the tags before it, the element around it, and how many of its words are linked."""

    __slots__ = ("pieces", "tags", "element", "linked", "text", "size")

    def __init__(self, tags: list[str], element: Element | None) -> None:
        self.pieces: list[str] = []
        self.tags, self.element, self.linked = tags, element, 0

    def close(self) -> None:
        found = _html.unescape("".join(self.pieces)).split()
        self.text, self.size = " ".join(found), len(found)

    @property
    def inside(self) -> bool:
        return self.element is not None and self.element.inside

    @property
    def links(self) -> bool:
        return 0 < self.size <= self.linked


def names(tag: str, attributes: str) -> tuple[str, ...]:
    """The keys of an element: its name (but for those around every page), its classes, id and role, and whether it is hidden."""
    out = [tag] if tag not in ("html", "body") else []
    if attributes.strip():
        for name, *values in ATTRIBUTE.findall(attributes):
            value, name = next((v for v in values if v), ""), name.lower()
            if name in ("class", "id", "role"):
                out += [f".{v.lower()}" for v in value.split()]
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                out.append("!hidden")
    return tuple(dict.fromkeys(out))


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order, without what is never text (scripts, styles, the head, comments of the markup).

    Block elements form a stack, inline ones are counted above its top by name: a block element's end ends the inline ones
    within. How often a name is open is counted, so that an end tag of what isn't open costs nothing."""
    out: list[Block] = []
    stack: list[tuple[Element, Counter]] = []  # block elements, and the inline ones that were open around them
    opened: Counter = Counter()  # block elements by name
    inline: Counter = Counter()  # open inline elements by name
    tags: list[str] = []
    current: Block | None = None
    number = 0

    def pop() -> None:
        nonlocal inline
        element, inline = stack.pop()
        opened[element.tag] -= 1

    for match in TOKEN.finditer(page or ""):
        raw, close, tag, attributes, end = match.groups()
        if raw is not None:
            tags.append(raw.lower())
            current = None
            continue
        if tag is None:
            text = match.group(0)
            if text.startswith(("<!", "<?")):
                continue
            if current is None:
                if not text.strip():
                    continue
                current = Block(tags, stack[-1][0] if stack else None)
                out.append(current)
                tags = []
            current.pieces.append(text)
            if inline["a"]:
                current.linked += len(text.split())
            continue
        if not (end or "").endswith(">"):
            break  # the page is cut off within this tag
        tag = tag.lower()
        tags.append("/" * bool(close) + tag)
        if tag in INLINE:
            if tag not in VOID:
                inline[tag] = max(0, inline[tag] + (-1 if close else 1)) if tag != "a" else int(not close)
            continue
        current = None
        if close:
            if opened[tag]:
                while stack[-1][0].tag != tag:
                    pop()
                pop()
        elif tag not in VOID:
            if opened["head"] and tag != "title":
                while opened["head"]:
                    pop()
            ends = CLOSED_BY.get(tag, ()) or (("p",) if tag in BLOCKS_THAT_END_P else ())
            while stack and stack[-1][0].tag in (*ends, "p") and (stack[-1][0].tag in ends or tag in CLOSED_BY):
                pop()
            if len(stack) < DEEPEST:
                number += 1
                above = stack[-1][0] if stack else None
                keys = names(tag, attributes)
                if tag == "header" and not (above and above.inside):
                    keys += ("!header",)
                stack.append((Element(tag, keys, above, number), inline))
                opened[tag] += 1
                inline = Counter(a=inline["a"])
    for block in out:
        block.close()
    return [b for b in out if b.size]


def features(block: Block, content: bool = True) -> tuple[str, ...]:
    """The keys of a block, sorted; without content, those of the elements that are labels are left out."""
    found, element = set(), block.element
    while element:
        found.update(element.keys)
        element = element.above
    if block.links:
        found.add(LINKS)
    return tuple(sorted(found if content else found - CONTENT))


def within(block: Block) -> set[str]:
    """The keys of the elements around a block up to the outermost article or main element."""
    found, element = set(), block.element
    while element and element.inside:
        found.update(element.keys)
        element = element.above
    return found


def labels(page: list[Block]) -> list[bool]:
    """Whether each block of a labelled page is content: in its article or main element, and there under no key that is known to
    mean the contrary. A key of half of the article's words or more can't mean that."""
    around = [within(b) for b in page]
    sizes: Counter = Counter()
    for block, keys in zip(page, around):
        sizes.update(dict.fromkeys(keys, block.size))
    total = sum(b.size for b in page if b.inside)
    contrary = {k for k in sizes if prior(k) < -FOR and 2 * sizes[k] < total}
    return [b.inside and not keys & contrary for b, keys in zip(page, around)]


def count(pages: Iterable[str | None]) -> tuple[int, Counter]:
    """Labelled pages, and how many words each kind of block, and how many tags of each name, have in and out of content."""
    n, seen = 0, Counter()
    for page in pages:
        found = blocks(page)
        if not any(b.inside for b in found):
            continue
        n += 1
        before = False
        for block, own in zip(found, labels(found)):
            seen["w", " ".join(features(block, content=False)), own] += block.size
            for tag in block.tags:
                seen["t", tag, own and before] += 1
            before = own
    return n, seen


def fit(counts: dict[tuple[str, str, bool], int], steps: int = 400) -> dict[str, float]:
    """Weights of keys, and of tags ("<tag"). Keys: a logistic regression over kinds of blocks, by Adam, each weight with a normal
    prior; general elements have none below 0. Tags: smoothed log odds, between 0 and -2."""
    kinds = sorted({key for kind, key, _ in counts if kind == "w"})
    keys = sorted({k for kind in kinds for k in kind.split(" ") if k})
    weights: dict[str, float] = {}
    if keys:
        place = {k: i for i, k in enumerate(keys)}
        has = np.zeros((len(kinds), len(keys)), np.float32)
        for i, kind in enumerate(kinds):
            has[i, [place[k] for k in kind.split(" ") if k]] = 1
        yes, no = (np.array([counts.get(("w", kind, label), 0) for kind in kinds], float) for label in (True, False))
        mean = np.array([prior(k) for k in keys])
        least, most = (np.array([bound if k in GENERAL else other for k in keys]) for bound, other in ((0.0, -MOST), (MOST_GENERAL, MOST)))
        w = mean.copy()
        first, second = np.zeros(len(keys)), np.zeros(len(keys))
        total = max(1.0, float((yes + no).sum()))
        for step in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(has @ w + BASE, -30, 30)))
            slope = has.T @ ((yes + no) * p - yes) / total + PRECISION * (w - mean) / total
            first += 0.1 * (slope - first)
            second += 0.01 * (slope * slope - second)
            w -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
            w = np.clip(w, least, most)
        weights = dict(zip(keys, w.tolist()))
    tags = {key for kind, key, _ in counts if kind == "t"}
    for key in tags:
        inside, between = (counts.get(("t", key, label), 0) for label in (True, False))
        weights[f"<{key}"] = tag_prior(key) + max(-1.0, min(0.0, 0.2 * math.log((inside + 1) / (between + 1))))
    return weights


def odds(page: list[Block], weights: dict[str, float]) -> list[float]:
    """The log odds of each block's words."""
    known = lambda k: weights[k] if k in weights else prior(k)
    own: dict[int, float] = {}  # by element: what its own keys add
    total: dict[int, tuple[float, frozenset]] = {}  # by element: the sum of its keys and of those around it, each key once
    every = sum(b.size for b in page)
    elements: dict[int, Element] = {}
    chains: list[list[int]] = []
    for block in page:
        chain, element = [], block.element
        while element:
            chain.append(element.number)
            elements[element.number] = element
            element.words += block.size
            element = element.above
        chains.append(chain)
    for number in sorted(elements):  # an element comes after those around it
        element = elements[number]
        above, seen = total[element.above.number] if element.above else (0.0, frozenset())
        new = [k for k in element.keys if k not in seen]
        own[number] = sum(known(k) for k in new)
        total[number] = (above + own[number], seen.union(new))
    base = [BASE + (total[c[0]][0] if c else 0.0) + (known(LINKS) if b.links else 0.0) for b, c in zip(page, chains)]
    # Elements that hold half of the words and count against them: an outer and an inner one may, two side by side can't.
    # Within an article they stay what their keys say, and so they do where an article is outside of them.
    large = {n for n, e in elements.items() if own[n] < 0 and 2 * e.words >= every and not (e.above and e.above.inside) and e.tag not in NEVER_AROUND}
    if large:
        around = [[n for n in c if n in large] for c in chains]
        spared = [s - sum(own[n] for n in a) for s, a in zip(base, around)]
        within: Counter = Counter()
        for b, s, a in zip(page, spared, around):
            if s > 0:
                within.update(dict.fromkeys(a, b.size))
        could = sum(b.size for b, s in zip(page, spared) if s > 0)
        spare = {n for n in large if 0 < 0.9 * could <= within[n]} - {n for b, s, a in zip(page, spared, around) if s > 0 and b.inside for n in large.difference(a)}
        base = [s - sum(own[n] for n in a if n in spare) for s, a in zip(base, around)]
    marked, could = sum(b.size for b, s in zip(page, base) if s > 0 and b.inside), sum(b.size for b, s in zip(page, base) if s > 0)
    return [s + OUTSIDE if 4 * marked >= could > 0 and not b.inside else s for s, b in zip(base, page)]


def scores(page: list[Block], weights: dict[str, float]) -> list[tuple[float, float]]:
    """For each block the sum of the tags before it, and of its words."""
    cost = lambda t: weights[f"<{t}"] if f"<{t}" in weights else tag_prior(t)
    return [(sum(map(cost, b.tags)), max(0.0, s) * b.size) for b, s in zip(page, odds(page, weights))]


def region(scored: list[tuple[float, float]]) -> tuple[int, int]:
    """First block and end of the best region: a linear scan with a running sum that starts anew where it falls to 0."""
    best, begin, end, run, start = 0.0, 0, 0, 0.0, 0
    for k, (tags, own) in enumerate(scored):
        if run + tags <= 0:
            run, start = 0.0, k
        else:
            run += tags
        run += own
        if run > best:
            best, begin, end = run, start, k + 1
    return begin, end


def extract(page: str | None, weights: dict[str, float]) -> str:
    found = blocks(page)
    scored = scores(found, weights)
    begin, end = region(scored)
    return " ".join(b.text for b, s in zip(found[begin:end], scored[begin:end]) if s[1] > 0)


def train(df: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights from at most `sample` labelled pages: chosen by hash, so that reruns agree."""
    labelled = df.select("html").filter(F.col("html").rlike(r"(?i)<(article|main)\b"))
    chosen = bounded_sample(labelled, sample, "html")

    def run(columns: list[list]) -> list[list]:
        _, seen = count(columns[0])
        keys = list(seen)
        return [[k[0] for k in keys], [k[1] for k in keys], [k[2] for k in keys], [seen[k] for k in keys]]

    counted = map_rows(chosen, run, "kind string, key string, good boolean, n long").groupBy("kind", "key", "good").agg(F.sum("n").alias("n"))
    rows = [r for kind in "wt" for r in counted.filter(F.col("kind") == kind).orderBy(F.desc("n"), "key", "good").limit(KEYS).collect()]  # KEYS rows at most
    return fit({(r.kind, r.key, r.good): r.n for r in rows})


def main_text(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""

    def run(columns: list[list]) -> list[list]:
        texts = [extract(h, weights) for h in columns[2]]
        return [columns[0], columns[1], texts, [len(t) for t in texts]]

    return map_rows(df.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
