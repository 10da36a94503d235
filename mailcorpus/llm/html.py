"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks that speak for
themselves: inside menus, headers, footers, side bars, notices, adverts, forms or comments, or
mostly links: bad; long and rich in stop words: good; long and poor in them: bad. Short blocks
and middling ones stay open. The second pass gives open blocks the label of their nearest
decided neighbours: of both if these agree; else short ones follow the nearer one (inside an
article the good one) and middling ones the good one. A heading follows the block it heads.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of four languages.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been but by can could do for from had has have he her his how i if in into is it its
    just like more my no not of on one only or other our out over said she so some than that the their them then there they this to up was we were
    what when which who will with would you your
    au aux avec ce ces cette dans de des du elle elles en est et être eu il ils je la le les leur lui mais me même mes ne nos notre nous on ou où par
    pas plus pour qu que qui sa sans se ses si son sont sur ta te tes toi ton tu un une vous votre vos y à ont été
    aber als am an auch auf aus bei bin bis das dass dem den der des die dies diese durch ein eine einem einen einer eines er es für hat hatte ich
    ihr ihre im in ist ja kann man mit nach nicht noch nur oder sein sich sie sind so über um und uns vom von vor war wenn werden wie wir wird zu zum zur
    al algo ante como con contra cual cuando de del desde donde el ella ellos en entre era es esta este esto fue ha han hasta hay la las lo los más
    me mi muy nada ni no nos o otra otro para pero poco por porque que quien se ser si sin sobre son su sus también te tiene todo tu un una uno y ya
    """.split()
)
RAW = "script|style|noscript|template|iframe|object|svg|math|textarea|select|button|title|canvas|audio|video|applet|datalist"
#: Of these, a page without an end tag has nothing but their content to its end; of others only the tag goes.
ENDLESS = "script|style|textarea|title|iframe"
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
HOLDERS = BLOCK - frozenset("p li dt dd td th tr h1 h2 h3 h4 h5 h6 hr body html head tbody thead tfoot caption pre legend".split())
BAD_TAGS = frozenset("nav footer aside form dialog menu search head".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|adslot|banners?|sponsor\w*|promos?|promotion\w*|cookies?|cookie\w+|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup"
    r"|share|sharing|social|related|recommend\w*|sidebar|side|rail|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|topbar|comments?|commentlist|reply|replies|respond|disqus|discussion"
    r"|login|search|searchform|pagination|pager|widgets?|toolbar|skip|copyright|legal|disclaimer|outbrain|taboola)(?=$|[\s_-])",
    re.I,
)
_GOOD_NAME = re.compile(r"(?:^|[\s_-])(?:article|content|entry|post|main|story|body|text)(?=$|[\s_-])", re.I)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_RAW = re.compile(rf"<({RAW})\b[^>]*>", re.I)
_RAW_END = re.compile(rf"</({RAW})\s*>", re.I)
_ENDLESS = frozenset(ENDLESS.split("|"))
_TAG = re.compile(r"<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([a-zA-Z][\w:-]*)([^>]*)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[^\W\d_]+")

#: Names that also head parts of an article: there they decide nothing, and a block must speak for itself.
_WEAK_NAME = re.compile(r"(?:discussion|legal|side)", re.I)
SHORT, LONG = 70, 200
LOW, HIGH = 0.08, 0.16
LINKS = 0.4


class _Block:
    __slots__ = ("parts", "linked", "bad", "article", "heading", "label")

    def __init__(self, bad: bool, article: bool, heading: bool):
        self.parts, self.linked, self.bad, self.article, self.heading, self.label = [], 0, bad, article, heading, ""


def _traits(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether an element is to be left out, whether it is an article, and whether it is a part of one that may be no text of it."""
    weak = False
    bad = tag in BAD_TAGS or (tag == "header" and not inside)
    article = tag in ("article", "main")
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role":
            bad |= value.lower() in BAD_ROLES
            article |= value.lower() in ("main", "article")
        elif name in ("class", "id"):
            names = [m[0].strip(" \t\r\n\f_-") for m in _BAD_NAME.finditer(value)] if not article and tag not in ("body", "html") else []
            if names and inside and all(map(_WEAK_NAME.fullmatch, names)):
                weak = True
            elif names:
                bad |= not _GOOD_NAME.search(value) or bool(re.search(r"comment|sidebar|footer|advert|cookie", value, re.I))
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            bad = True
    return bad, article, weak


def _tags(page: str):
    """Start, end, name, whether it closes, and attributes of each tag in order.

    Comments and declarations have no name, elements whose content is no text are one tag named
    ``raw``. Their end tags are listed first, so that one without an end costs no look at the rest
    of the page; behind the last ``>`` only a comment can begin. The time is linear in the page.
    """
    ends: dict[str, list[tuple[int, int]]] = {}
    for m in _RAW_END.finditer(page):
        ends.setdefault(m[1].casefold(), []).append(m.span())
    last, at = page.rfind(">"), page.find("<")
    while at >= 0:
        start = at
        m = _COMMENT.match(page, at)
        if m:
            at = m.end()
            yield start, at, "", False, ""
        elif at < last:
            m = _RAW.match(page, at)
            name = m[1].casefold() if m else ""
            spans = ends.get(name, [])
            k = bisect_left(spans, (m.end(), 0)) if m else 0
            if k < len(spans):
                at = spans[k][1]
                yield start, at, "raw", False, ""
            elif name in _ENDLESS:
                yield start, len(page), "", False, ""
                return
            elif m := _TAG.match(page, at):
                at = m.end()
                yield start, at, (m[2] or m[5] or "").lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
            else:
                at += 1
        else:
            at += 1
        at = page.find("<", at)


def _blocks(page: str) -> list[tuple[str, int, _Block]]:
    """Non-empty blocks in order: text, characters under links, block."""
    out: list[_Block] = []
    stack: list[tuple[str, bool, bool]] = []
    depth: Counter[str] = Counter()
    block = _Block(False, False, False)
    links, at = 0, 0

    def text(piece: str) -> None:
        if piece:
            block.parts.append(piece)
            if links:
                block.linked += len(piece.strip())

    for start, end, tag, closing, attributes in _tags(page):
        text(page[at:start])
        at = end
        if tag == "raw":
            text(" ")
        elif tag == "a":
            links = 0 if closing else 1
        elif tag in BLOCK:
            links = 0
            bad, article = (stack[-1][1:] if stack else (False, False))
            if closing:
                while tag in HOLDERS and depth[tag]:
                    name = stack.pop()[0]
                    depth[name] -= 1
                    if name == tag:
                        break
                bad, article = (stack[-1][1:] if stack else (False, False))
            else:
                own_bad, own_article, weak = _traits(tag, attributes, article)
                bad, article = bad or own_bad, (article or own_article) and not weak
                if tag in HOLDERS and not attributes.endswith("/"):
                    stack.append((tag, bad, article))
                    depth[tag] += 1
            out.append(block)
            block = _Block(bad, article, not closing and len(tag) == 2 and tag[0] == "h" and tag[1] in "123456")
        elif tag == "br" or tag == "img" or tag == "input":
            text(" ")
    text(page[at:])
    out.append(block)
    found = []
    for b in out:
        words = " ".join(unescape("".join(b.parts)).split())
        if words:
            found.append((words, b.linked, b))
    return found


def extract(page: str | None) -> str:
    """The main text of a page; empty if there is none."""
    blocks = _blocks(page or "")
    first = _first(blocks)
    settled = _settled(first, [b.heading for _, _, b in blocks], [b.article for _, _, b in blocks])
    return "\n".join(words for (words, _, _), good in zip(blocks, settled) if good)


def _first(blocks: list[tuple[str, int, _Block]]) -> list[str]:
    """The first pass: good, bad, short or middling."""
    for words, linked, b in blocks:
        density = 0.0
        if len(words) >= SHORT:
            tokens = _WORD.findall(words.lower())
            density = sum(t in STOP_WORDS for t in tokens) / max(1, len(tokens))
        if b.bad or linked > LINKS * len(words):
            b.label = "bad"
        elif len(words) < SHORT:
            b.label = "short"
        elif density >= HIGH and len(words) >= LONG or density >= LOW and b.article:
            b.label = "good"
        elif density >= LOW or b.article:
            b.label = "middling"
        else:
            b.label = "bad"
    first = [b.label for _, _, b in blocks]
    if "good" not in first:  # nothing stands out: blocks of an article, or else middling ones, do
        for k, (_, _, b) in enumerate(blocks):
            if not b.bad and (b.article or first[k] == "middling") and first[k] != "bad":
                first[k] = "good"
    return first


def _settled(first: list[str], heading: list[bool], article: list[bool]) -> list[bool]:
    """The second pass: which blocks are good once open ones have the label of their decided neighbours."""
    before, seen = [], None
    for k, label in enumerate(first):
        before.append(seen)
        seen = k if label in ("good", "bad") else seen
    after, seen = [None] * len(first), None
    for k in range(len(first) - 1, -1, -1):
        after[k] = seen
        seen = k if first[k] in ("good", "bad") else seen
    out = []
    for k, label in enumerate(first):
        if label in ("short", "middling"):
            near = [i for i in (before[k], after[k]) if i is not None]
            labels = {first[i] for i in near}
            if len(labels) < 2:
                label = labels.pop() if labels else "bad"
            elif heading[k]:
                label = first[after[k]]
            elif label == "middling" or article[k]:
                label = "good"
            else:
                label = first[min(near, key=lambda i: abs(i - k))]
        out.append(label == "good")
    return out


def _extracted(batches):
    for batch in batches:
        text = [extract(page) for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``(page_id, url, text, n_chars)``, a row for each row.

    Null and empty pages have an empty text. Character references are decoded, white space in a
    block becomes one space, blocks are joined by a line feed; nothing is capped. Repeated rows
    are treated alike; null ids and addresses are passed on; other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
