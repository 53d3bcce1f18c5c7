"""Main text of web pages by two-pass block rules.

Pass one cuts a page into blocks and decides each by its stop-word density, its length and its link
density; its place in the page shifts what these must reach. Blocks that none of these decide are left
open; pass two gives them the label of the nearest decided neighbour.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm.common import small_batches

# Frequent function words of the corpus languages.
STOP_WORDS = frozenset(
    (
        "a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it its "
        "just like more my no not now of on only or other our out over she so some than that the their them then there these they this those to up was we "
        "were what when which who will with would you your "
        "au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais me même mes moi mon ne nos notre nous on ou où "
        "par pas plus pour qu que qui sa se ses si son sont sur ta te tes toi ton tu un une vos votre vous "
        "aber als am an auch auf aus bei bin bis bist da dass das dem den der des die doch du durch ein eine einem einen einer es für hat ich ihr im in ist "
        "ja kann mein mich mir mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wer wie wir wird zu zum zur "
        "al algo ante como con contra cuando de del desde donde el ella ellos en entre era es esa ese eso esta este esto fue ha hay la las le les lo los más "
        "me mi muy nada ni no nos o otra otro para pero poco por porque que quien se ser si sin sobre son su sus también tanto te tiene todo tu un una uno y ya yo"
    ).split()
)
# Elements whose content is never article text.
DROPPED = frozenset("script style noscript template iframe object embed svg canvas audio video head title nav footer aside form button select option textarea input label dialog menu map applet".split())
RAW = frozenset("script style noscript template iframe textarea title svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id or role that mark furniture, and those that mark the article.
BAD_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense adslot banner banners sponsor sponsored sponsors promo promos promoted promotion sidebar sidebars "
    "nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead cookie cookies consent notice notices gdpr newsletter subscribe subscription signup popup modal "
    "overlay share sharing social comment comments commentlist disqus discussion respond replies reply related recommended recommendations widget widgets toolbar login search "
    "pagination pager copyright legal disclaimer skip alert complementary contentinfo dialog hidden outbrain taboola paywall toc".split()
)
TALK_HINTS = frozenset("comment comments commentlist disqus discussion respond replies reply".split())
FILL_HINTS = frozenset("area bar block box button buttons container inner links list section".split())
SOFT_HINTS = frozenset("header head side top bottom".split())
GOOD_HINTS = frozenset("article content main post story entry body text page hentry".split())
SCOPE_HINTS = frozenset("articlebody article-body article-content post-content entry-content story-body main-content post-body article-text".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))|<[!?][^>]*+(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?(?:;|$)", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_HINT_WORD = re.compile(r"[^a-z0-9]+")


def _hints(attrs: str) -> tuple[bool, str, bool]:
    """(hidden, mark, marks the article) by the attributes of a tag.

    The mark is "hard" or "talk" where a whole class, id or role names furniture or a discussion, and
    "soft" where it only holds such a word.
    """
    if "=" not in attrs and "hidden" not in attrs.lower():
        return False, "", False
    found = {name.lower(): x or y or z for name, x, y, z in reversed(_ATTR.findall(attrs))}
    hidden = found.get("hidden", "false").lower() != "false" or found.get("aria-hidden", "").lower() == "true" or bool(_HIDING.search(found.get("style", "")))
    names = set(" ".join(found.get(x, "") for x in ("class", "id", "role", "itemprop")).lower().split())
    words = [set(_HINT_WORD.split(x)) - {""} for x in names]
    whole = [w for w in words if w & BAD_HINTS and w <= BAD_HINTS | FILL_HINTS]
    mark = ""
    if any(not w & TALK_HINTS for w in whole) or (names & SOFT_HINTS and not set().union(*words) & GOOD_HINTS):
        mark = "hard"
    elif whole:
        mark = "talk"
    elif any(w & BAD_HINTS - {"hidden"} for w in words):
        mark = "soft"
    return hidden, mark, mark in ("", "soft") and (bool(SCOPE_HINTS & names) or "main" in names)


def blocks(page: str) -> list[tuple[str, int, bool, bool, bool, bool]]:
    """The page's blocks in order: (text, characters in links, furniture, inside the article, heading, doubtful by a mark)."""
    out: list[tuple[str, int, bool, bool, bool, tuple[int, ...]]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []
    kinds: list[str] = []  # of all marked elements
    marks: list[int] = []  # the open ones
    bad = scope = 0
    linked = in_link = 0
    heading = False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, min(linked, len(text)), bad > 0, scope > 0, heading, tuple(marks)))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal bad, scope
        for _, b, s, m in stack[k:]:
            bad, scope = bad - b, scope - s
            if m:
                marks.pop()
        del stack[k:]

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        data = page[at : m.start()] if m else page[at:]
        if data:
            parts.append(data)
            if in_link:
                linked += len(data)
        if not m:
            break
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:  # an end tag
            if name == "a":
                in_link = 0
            if name not in INLINE:
                flush()
                heading = False
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            continue
        if name in ("br", "wbr", "img"):
            parts.append(" ")
            continue
        hidden, mark, good = _hints(m[3])
        if name in INLINE and mark == "soft":
            mark = ""
        if name == "a":
            in_link = 1
        if name not in INLINE or hidden or mark:
            flush()
            if name not in INLINE:
                in_link = 0
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in VOID or m[3].endswith("/>") and name not in DROPPED:
            continue
        if name in HEADINGS:
            heading = True
        elif name not in INLINE:
            heading = False
        if name == "body" or name == "html":
            hidden, mark, good = False, "", False
        drop = hidden or name in DROPPED or (name == "header" and not scope)
        inside = not drop and (good or name in ("article", "main"))
        if name == "p":  # a paragraph ends the one before it
            if stack and stack[-1][0] == "p":
                close(-1)
        elif name == "li" and stack and stack[-1][0] == "li":
            close(-1)
        if name not in INLINE or drop or mark:
            stack.append((name, drop, inside, bool(mark)))
            bad, scope = bad + drop, scope + inside
            if mark:
                marks.append(len(kinds))
                kinds.append(mark)
    flush()
    return _weighed(out, kinds)


def _weighed(found: list[tuple[str, int, bool, bool, bool, tuple[int, ...]]], kinds: list[str]) -> list[tuple[str, int, bool, bool, bool, bool]]:
    """Blocks with their marks settled: a marked element goes, unless it holds most of the text; then its mark only counts against it.

    To stay it must hold a paragraph, and no article element may lie outside of it. A discussion may be longer than its article, so it stays only where no paragraph lies outside of it.
    Soft marks count against a block in any element that does not hold most of the text.
    """
    sizes = [0] * len(kinds)
    for text, _, bad, _, _, marks in found:
        for m in () if bad else marks:
            sizes[m] += len(text)
    half = sum(len(b[0]) for b in found if not b[2]) / 2
    listed = _listed([b[:3] for b in found], LIMITS[0], LIMITS[2], LIMITS[4])
    gone, doubt = set(), set()
    for m, kind in enumerate(kinds):
        most = sizes[m] > half
        if most and kind != "soft":
            most = any(m in b[5] and not b[2] and len(b[0]) >= LIMITS[0] for b in found) and not any(b[3] and not b[2] and m not in b[5] for b in found)
        if most and kind == "talk":
            most = not any(not b[2] and m not in b[5] and _first(b[0], b[1], False, *LIMITS, False, listed) for b in found)
        if kind == "soft" and not most or kind != "soft" and most:
            doubt.add(m)
        elif kind != "soft":
            gone.add(m)
    return [(text, linked, bad or not gone.isdisjoint(marks), scope, heading, not doubt.isdisjoint(marks)) for text, linked, bad, scope, heading, marks in found]


#: least characters of a paragraph and of a long one, low and high share of stop words, most characters in links
LIMITS = (70, 200, 0.15, 0.3, 0.33)


@lru_cache(128)  # each pass asks again
def _stop_share(text: str) -> float:
    w = _WORD.findall(text.lower())
    return sum(x in STOP_WORDS for x in w) / max(1, len(w))


def _listed(found: list[tuple[str, int, bool]], min_chars: int, low: float, max_links: float) -> bool:
    """Whether the page's paragraphs ``(text, characters in links, furniture)`` reach the low share of stop words, weighed by length."""
    texts = [t for t, linked, bad in found if not bad and len(t) >= min_chars and linked <= max_links * len(t)]
    return sum(len(t) * _stop_share(t) for t in texts) >= low * sum(map(len, texts))


def _first(text: str, linked: int, inside: bool, min_chars: int, long_chars: int, low: float, high: float, max_links: float, outside: bool, listed: bool = True) -> bool | None:
    """Pass one for a block that is no furniture. Place never decides: less is asked ``inside`` the article, more ``outside`` one or of a block in doubt."""
    if linked / len(text) > (0.6 if inside else max_links):
        return False
    if len(text) < min_chars:
        return None
    if not listed:  # no stop words to go by: length and links decide
        return True if len(text) >= long_chars or not outside else None
    stop = _stop_share(text)
    if outside:
        return True if stop >= high and len(text) >= long_chars else None if stop >= low else False
    if stop >= high or (stop >= low and (inside or len(text) >= long_chars)):
        return True
    return None if stop >= low or inside else False


def labels(found: list[tuple[str, int, bool, bool, bool, bool]], min_chars: int = 70, long_chars: int = 200, low: float = 0.15, high: float = 0.3, max_links: float = 0.33) -> list[bool]:
    """Which blocks are article text. Lengths are code points, densities shares of words or characters.

    Article elements count as the article's place where they hold at least half of what the words find;
    otherwise they are teasers or quotes, and their blocks are decided like all others.
    """
    limits = (min_chars, long_chars, low, high, max_links)
    listed = _listed([b[:3] for b in found], min_chars, low, max_links)
    first: list[bool | None] = [False if bad else _first(text, linked, False, *limits, doubt, listed) for text, linked, bad, _, _, doubt in found]
    for kind in (True, None):  # where nothing is long enough to decide, the open blocks are weighed
        weight = [sum(len(b[0]) for b, x in zip(found, first, strict=True) if x is kind and b[3] is s) for s in (False, True)]
        if any(weight):
            break
    placed = weight[1] > 0 and weight[1] >= weight[0]
    if placed:
        first = [False if bad else _first(text, linked, scope and not doubt, *limits, doubt or not scope, listed) for text, linked, bad, scope, _, doubt in found]
    if not any(first):  # short pages are all text but for furniture and what lies beside the article
        return [x is None and (b[3] or not placed) for b, x in zip(found, first, strict=True)]
    # furniture says nothing about its neighbours
    decided = [i for i, x in enumerate(first) if x is not None and not found[i][2]]
    within = [i for i in decided if found[i][3]]
    out = []
    for i, x in enumerate(first):
        if x is not None:
            out.append(x)
            continue
        inside = placed and found[i][3]
        near = within if inside else decided
        # short blocks beside the article inherit nothing from it
        short = placed and not inside and len(found[i][0]) < min_chars
        k = bisect(near, i)
        before, after = ((bool(first[j]) and not (short and found[j][3]), abs(i - j)) if j is not None else None for j in (near[k - 1] if k else None, near[k] if k < len(near) else None))
        if before is None or after is None:
            out.append((before or after or (inside, 0))[0])
        elif before[1] == after[1]:  # a tie: headings belong to what follows, paragraphs inside the article need one, other blocks both
            out.append(after[0] if found[i][4] else (before[0] or after[0]) if inside and len(found[i][0]) >= min_chars else before[0] and after[0])
        else:
            out.append(min(before, after, key=lambda v: v[1])[0])
    return out


def main_text(page: str | None) -> str:
    """The article's blocks joined by line feeds; empty for null, blank or text-free pages."""
    found = blocks(page or "")
    return "\n".join(b[0] for b, keep in zip(found, labels(found), strict=True) if keep)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``(key, url, text, n_chars)`` per row; nulls in key or url stay null, null pages give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [key, url, "text", "n_chars"])

    small_batches(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, F.col(url).cast("string"), F.col(page).cast("string")).mapInArrow(run, f"`{key}` {kind}, `{url}` string, text string, n_chars long")
