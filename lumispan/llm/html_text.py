"""Main text of HTML pages by two passes of block rules.

Pass 1 cuts the page into blocks and labels each one. Blocks that are mostly links are bad; of the rest, long blocks are
good where enough of their words are stop words and bad where few are, inside an article or not. What HTML or a name
sets apart from an article (menus, headers, footers, asides, forms, comments) is a prior, which densities overrule: an
element that holds most of the page's good text is the page's frame, whatever it is called, and is no longer apart; what
is apart inside it remains so. Names that tell of a state (``has-sidebar``, ``ad-free``) say nothing of the element.
Weaker names count as a hint against blocks that densities leave in doubt, and against long ones outside an article.
What is left, short blocks and long ones without stop words inside an article, is open. Pass 2 gives every open block the
label of its nearest decided neighbours (the better one when they tie). On a page without a good block, as in a language
without known stop words, long blocks that aren't bad count as good before pass 2. Good blocks are joined in page order.

Pages are independent rows, so the work is a map over partitions of the table: nothing is shuffled, and a task holds one
batch of pages.

Edge cases: null or empty html gives an empty text; markup that is cut off or never closed ends with its parent or the
page; a very long page or tag is one pass over its characters, whatever it is broken like; repeated rows give repeated
results; of elements that hold equally much good text the first goes first; an empty table gives no rows; extra columns
are dropped.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame

from .common import written

# Common words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a about after all also an and are as at be been but by can for from had has have he her his i if in into is it its "
    "more no not of on one or our out she so than that the their them then there they this to up was we were what when "
    "which who will with would you your "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer es für hat "
    "ich ihr im in ist ja mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn wie wir zu "
    "zum zur "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas pour que "
    "qui sa sans se ses son sur un une vous y "
    "al como con cuando de del el ella en era es esta este hay la las lo los más mi muy no o para pero por que se ser "
    "si sin sobre su sus también un una y ya".split()
)
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never content.
BAD_TAGS = frozenset(
    "aside button datalist dialog fieldset footer form head input menu nav noscript option search select title".split()
)
#: Elements whose content isn't markup, or isn't text.
RAW_TAGS = frozenset(
    "script style template svg math iframe object textarea noembed noframes canvas audio video".split()
)
#: Elements that never hold an article, however much text they have.
NEVER_TAGS = frozenset("button datalist head input menu nav noscript option select title".split())
#: Words of a class, id or role that mark what surrounds an article.
BAD_NAMES = frozenset(
    "ad ads adv advert advertisement advertisements adverts alert alerts breadcrumb breadcrumbs "
    "consent contentinfo cookie cookies copyright disclaimer "
    "footer footers form gdpr login menu menus modal nav navbar navigation newsletter "
    "paywall popup popups privacy promo promos promotion recommended "
    "related sharing sidebar sidebars signup skip sponsor "
    "sponsored sponsors subscribe subscription".split()
)
#: Words that mark what readers wrote, which may be longer than the article.
READER_NAMES = frozenset("comment comments commentlist discussion disqus replies reply respond responses".split())
#: Words beside which a name tells a state of the element, not what it is.
STATE_WORDS = frozenset("free has have hide hides is no non not show shows with without".split())
#: Words that mark it unless a word for a part of an article stands beside them.
WEAK_NAMES = frozenset(
    "banner banners byline dialog header headers masthead notice notices notification overlay pager "
    "pagination search share social tabs tags teaser teasers toolbar topbar widget widgets".split()
)
PART_NAMES = frozenset("article body content entry headline main paragraph post section story text title".split())
MAX_LINK_DENSITY = 0.5
LONG = 70
MIN_STOP_DENSITY = 0.12

#: Good text outside a marked element, as a share of that inside, above which the mark stands.
FRAME = 0.25

_EDGE = re.compile("[\"'>]")
_NAME = re.compile(r"[^\s/>]*")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: What is held against an element: nothing, a hint, its kind or name, that readers wrote it, that it is no text at all.
CLEAR, HINTED, APART, READERS, NEVER = range(5)


def tag_end(html: str, lt: int, doomed: set[int]) -> int:
    """Where the tag that begins at ``lt`` ends, quotes minded; -1 if one of them never closes. ``doomed`` remembers the
    quotes from which that was found, so that none is followed twice."""
    at, opened = lt + 1, []
    while (m := _EDGE.search(html, at)) and m.start() not in doomed:
        if m[0] == ">":
            return m.start()
        opened.append(m.start())
        close = html.find(m[0], m.end())
        if close < 0:
            break
        at = close + 1
    doomed.update(opened)
    return -1


def tokens(html: str) -> Iterator[tuple[str, bool, str, str]]:
    """Text as ("", False, text, "") and tags as (name, closing, text, attributes); comments, declarations and what isn't
    text are left out. Every character is looked at a bounded number of times."""
    at, n = 0, len(html)
    last = html.rfind(">")
    doomed: set[int] = set()
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            yield "", False, html[at:], ""
            return
        if lt > at:
            yield "", False, html[at:lt], ""
        after = html[lt + 1 : lt + 2]
        if after == "!" or after == "?" or after == "/" and not html[lt + 2 : lt + 3].isalpha():
            end = html.find("-->", lt + 4) if html.startswith("<!--", lt) else html.find(">", lt)
            if end < 0:
                return
            at = end + (3 if html.startswith("<!--", lt) else 1)
            continue
        if not (after.isascii() and after.isalpha()) and after != "/":
            yield "", False, "<", ""
            at = lt + 1
            continue
        if lt > last:
            return  # a tag that is cut off, and none after it is whole
        end = tag_end(html, lt, doomed)
        if end < 0:  # a quote that never ends
            end = html.find(">", lt)
        closing = after == "/"
        m = _NAME.match(html, lt + 1 + closing, end)
        name, attributes, at = m[0].strip("/").lower(), html[m.end() : end], end + 1
        if name in RAW_TAGS and not closing:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                if not end:
                    return
                at = end.end()
            continue
        yield name, closing, "", attributes


def against(tag: str, attributes: str, in_content: bool) -> int:
    """What an element's tag or names hold against it."""
    if tag in NEVER_TAGS:
        return NEVER
    found = APART if tag in BAD_TAGS or (tag == "header" and not in_content) else CLEAR
    if not attributes or tag in ("html", "body"):
        return found
    if _HIDDEN.search(attributes):
        return NEVER
    if tag not in ("main", "p", "a", "b", "i", "em", "strong", "span", "h1"):
        for value in _NAMES.findall(attributes):
            for one in value.strip("\"'").split():
                names = {x.lower() for x in _PARTS.findall(one)}
                if not STATE_WORDS.isdisjoint(names):
                    continue
                if not READER_NAMES.isdisjoint(names):
                    return READERS
                if not BAD_NAMES.isdisjoint(names):
                    found = APART
                elif found == CLEAR and not WEAK_NAMES.isdisjoint(names) and PART_NAMES.isdisjoint({x.lower() for x in _PARTS.findall(value)}):
                    found = HINTED
    return found


#: A block: text, its characters inside links, its innermost mark or -1, is a hint against it, is it inside an article or main.
Block = tuple[str, int, int, bool, bool]


def blocks_of(html: str) -> tuple[list[Block], list[tuple[int, int]]]:
    """The page's blocks in order, and its marks, elements that something stronger than a hint is held against: what that
    is, and the mark around it or -1."""
    out: list[Block] = []
    marks: list[tuple[int, int]] = []
    text: list[str] = []
    linked = 0
    stack: list[tuple[str, int, bool, bool]] = []  # tag, what is held against it, is it an article, is it a link
    open_: Counter[str] = Counter()
    around = [-1]  # the marks that are open
    content = links = hints = 0

    def flush() -> None:
        nonlocal linked
        if text:
            body = " ".join(_html.unescape("".join(text)).split())
            if body:
                out.append((body, linked, around[-1], hints > 0, content > 0))
            text.clear()
        linked = 0

    def leave(entry: tuple[str, int, bool, bool]) -> None:
        nonlocal content, links, hints
        name, kind, c, a = entry
        open_[name] -= 1
        hints, content, links = hints - (kind == HINTED), content - c, links - a
        if kind > HINTED:
            around.pop()

    for tag, closing, raw, attributes in tokens(html):
        if not tag:
            text.append(raw)
            if links:
                linked += len(_html.unescape(raw).strip())
            continue
        if tag in BLOCK_TAGS:
            flush()
        elif tag == "br":
            text.append(" ")
        if closing:
            while open_[tag]:
                entry = stack.pop()
                leave(entry)
                if entry[0] == tag:
                    break
        elif tag not in VOID_TAGS and not attributes.endswith("/"):
            if tag == "p" and stack and stack[-1][0] == "p":
                leave(stack.pop())
            kind = against(tag, attributes, content > 0)
            entry = (tag, kind, tag in ("article", "main"), tag == "a")
            stack.append(entry)
            open_[tag] += 1
            if kind > HINTED:
                marks.append((kind, around[-1]))
                around.append(len(marks) - 1)
            hints, content, links = hints + (kind == HINTED), content + entry[2], links + entry[3]
    flush()
    return out, marks


def frames(blocks: list[Block], marks: list[tuple[int, int]]) -> set[int]:
    """The marks that are void: of elements that hold most of the page's good text. They are taken from the outside in,
    the one with most good text first, as long as what stands outside all marks is little beside it; of what readers
    wrote, as long as nothing stands outside."""
    total, own = [0] * len(marks), [0] * len(marks)
    outside = 0
    for text, linked, mark, _, _ in blocks:
        if len(text) >= LONG and linked <= MAX_LINK_DENSITY * len(text):
            if mark < 0:
                outside += len(text)
            elif stop_density(text) >= MIN_STOP_DENSITY:
                own[mark] += len(text)
    below: dict[int, list[int]] = {}
    for m in range(len(marks) - 1, -1, -1):  # a mark comes after the one around it
        total[m] += own[m]
        if marks[m][1] >= 0:
            total[marks[m][1]] += total[m]
        below.setdefault(marks[m][1], []).append(m)
    void: set[int] = set()
    heap: list[tuple[int, int]] = []

    def reach(m: int) -> None:
        for x in below.get(m, ()):
            if total[x] and marks[x][0] != NEVER:
                heappush(heap, (-total[x], x))

    reach(-1)
    while heap:
        weight, m = heappop(heap)
        if outside > (0 if marks[m][0] == READERS else -weight * FRAME):
            continue
        void.add(m)
        outside += own[m]
        reach(m)
    return void


def stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / max(1, len(words))


def label(block: Block, apart: bool, has_content: bool) -> str:
    text, linked, _, hinted, inside = block
    doubted = apart or hinted
    if linked > MAX_LINK_DENSITY * len(text):
        return "bad" if doubted or len(text) < 200 or linked > 0.9 * len(text) else "open"
    if apart or (hinted and not inside):
        return "bad"
    if len(text) >= LONG:
        if stop_density(text) >= MIN_STOP_DENSITY:
            return "good" if inside or not has_content else "bad"
        return "open" if inside else "bad"
    return "bad" if doubted or (has_content and not inside) else "open"


def extract(html: str | None) -> str:
    blocks, marks = blocks_of(html or "")
    void = frames(blocks, marks)
    apart = [m >= 0 and m not in void for _, _, m, _, _ in blocks]
    # An article is one that holds a block which nothing is held against.
    has_content = any(inside and not a and not hinted for (_, _, _, hinted, inside), a in zip(blocks, apart, strict=True))
    labels = [label(b, a, has_content) for b, a in zip(blocks, apart, strict=True)]
    if "good" not in labels:
        for i, (text, linked, _, hinted, inside) in enumerate(blocks):
            if not apart[i] and not hinted and (inside or not has_content) and linked <= MAX_LINK_DENSITY * len(text) and (len(text) >= LONG or inside):
                labels[i] = "good"
    decided = [i for i, x in enumerate(labels) if x != "open"]
    final, k = [], 0
    for i, x in enumerate(labels):
        if x == "open":
            while k < len(decided) and decided[k] < i:
                k += 1
            near = [j for j in ((decided[k - 1] if k else None), (decided[k] if k < len(decided) else None)) if j is not None]
            if blocks[i][4]:  # inside an article, blocks of the article are its neighbours
                near = [j for j in near if blocks[j][4]]
            gaps = [(abs(j - i), labels[j] != "good") for j in near]
            x = ("bad" if min(gaps)[1] else "good") if gaps else ("good" if blocks[i][4] or not has_content else "bad")
        final.append(x)
    return "\n\n".join(b[0] for b, x in zip(blocks, final, strict=True) if x == "good")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: key, url, text, n_chars."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [extract(x) for x in batch[html]]
            yield pd.DataFrame({key: batch[key], url: batch[url], "text": texts, "n_chars": [len(t) for t in texts]})

    schema = f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars bigint"
    return written(pages.select(key, url, html).mapInPandas(run, schema), "main-text", batch=200)
