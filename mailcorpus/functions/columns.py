"""Columns that measure addresses, texts, attachments and pages. Built-in functions only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X


def any_of(tests: list[Column]) -> Column:
    return reduce(or_, tests, F.lit(False))


def domain(address: Column) -> Column:
    """After the last @, lower case; empty without one."""
    return F.when(address.contains("@"), F.regexp_replace(F.lower(F.substring_index(address, "@", -1)), r"[>\s]+$", "")).otherwise("")


def registrable_domain(host: Column) -> Column:
    """The last two labels, or three under a two-label public suffix."""
    labels = F.filter(F.split(F.lower(host), r"\."), lambda x: x != "")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    n = F.size(labels)
    return F.when(n <= 2, F.array_join(labels, ".")).when(two.isin(X.TWO_LABEL_SUFFIXES), F.array_join(F.slice(labels, -3, 3), ".")).otherwise(two)


def domains_align(a: Column, b: Column) -> Column:
    return F.coalesce((a != "") & (b != "") & (registrable_domain(a) != "") & (registrable_domain(a) == registrable_domain(b)), F.lit(False))


def aligned(a: Column, b: Column) -> Column:
    """Same organisation: equal, one under the other, or the same registrable domain."""
    a, b = F.lower(a), F.lower(b)
    return F.coalesce((a != "") & (b != "") & ((a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a)) | domains_align(a, b)), F.lit(False))


def is_under(host: Column, domain_: Column | str) -> Column:
    d = F.lit(domain_) if isinstance(domain_, str) else domain_
    return (host == d) | host.endswith(F.concat(F.lit("."), d))


def is_punycode(host: Column) -> Column:
    return F.coalesce(F.exists(F.split(F.lower(host), r"\."), lambda x: x.startswith("xn--")), F.lit(False))


def is_ascii(text: Column) -> Column:
    """As many bytes as characters: known without a look at any of them."""
    return F.octet_length(text) == F.length(text)


def strip_invisible(text: Column) -> Column:
    return F.when(is_ascii(text), text).otherwise(F.regexp_replace(text, X.INVISIBLE, ""))


URL = r"(?i)\b(?:https?|hxxps?|ftp)://[^\s<>\"'()\[\]]+|\bwww\.[^\s<>\"'()\[\]]+"
ATTRIBUTE = r"""(?i)\s(?:href|src)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)"""


def _addresses(text: Column) -> Column:
    """What URL finds; texts without a mark that every link holds are not searched."""
    held = text.contains("://") | F.lower(text).contains("www.")
    return F.when(held, F.regexp_extract_all(text, F.lit(URL), F.lit(0))).when(text.isNotNull(), F.array().cast("array<string>"))


def _links(found: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(found, lambda u: F.regexp_replace(F.trim(u), r"[.,;:!?)\]}'\"]+$", "")), lambda u: u != ""))


def urls(text: Column) -> Column:
    """Distinct links in order, without the punctuation that ends them."""
    return _links(_addresses(text))


def message_urls(text: Column, page: Column) -> Column:
    """Distinct links of a text and of a page: of its href and src attributes, quoted or not, and of what it says."""
    attributes = F.transform(F.regexp_extract_all(page, F.lit(ATTRIBUTE), F.lit(0)), lambda a: F.regexp_replace(F.regexp_extract(a, r"(?s)=\s*(.*)$", 1), r"""(?s)^(["'])(.*)\1$""", "$2"))
    none = F.array().cast("array<string>")
    parts = [_addresses(text), attributes, _addresses(page)]
    return F.filter(_links(F.concat(*(F.coalesce(p, none) for p in parts))), lambda u: u.rlike(r"(?i)^(?:https?|hxxps?|ftp|www\.)"))


def defanged(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"(?i)^http", "hxxp"), r"\.", "[.]")


def url_host(url: Column) -> Column:
    """Lower-case host; null if there is none. Addresses that start with www. count as http."""
    host = F.regexp_extract(F.lower(url), r"^(?:[a-z]+://)?(?:[^/?#@\s]*@)?([a-z0-9._-]+)", 1)
    return F.when(host.contains("."), host)


def url_hosts(list_: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(list_, url_host), lambda h: h.isNotNull()))


def tokens(text: Column, cap: int = X.TOKEN_CAP) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9._@-]*[a-z0-9]"), F.lit(0))), 1, cap)


def tokens_expanded(text: Column, cap: int = X.TOKEN_CAP) -> Column:
    """Tokens and the pieces (of two characters or more) of glued ones."""
    own = tokens(text, cap)
    pieces = F.filter(F.flatten(F.transform(own, lambda t: F.split(t, "[._@-]+"))), lambda p: F.length(p) >= 2)
    return F.slice(F.array_distinct(F.concat(own, pieces)), 1, cap)


def urgency_score(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a + b, [F.when(low.contains(k), 1).otherwise(0) for k in X.URGENCY])


#: What every match of an indicator holds, in lower case: texts with none of it are not searched for it.
_FINANCIAL_MARKS = {"swift_bic": ["swift", "bic"], "routing_number": ["routing"], "crypto_wallet_eth": ["0x"], "gift_card_request": ["gift"]}


def financial_indicators(text: Column) -> Column:
    low = F.lower(text)
    held = lambda k: any_of([low.contains(m) for m in _FINANCIAL_MARKS[k]]) if k in _FINANCIAL_MARKS else F.lit(True)
    return F.array_compact(F.array(*(F.when(held(k) & text.rlike(p), F.lit(k)) for k, p in X.FINANCIAL.items())))


def brand_mismatch(name: Column, host: Column) -> Column:
    """The name holds a brand's word (the first in order counts) and the host is not the brand's."""
    name, host = F.lower(name), F.lower(host)
    brand = F.coalesce(*(F.when(name.contains(k), F.lit(d)) for k, d in X.BRAND_KEYWORDS))
    return F.coalesce((name != "") & (host != "") & ~is_under(host, brand), F.lit(False))


def extension(name: Column) -> Column:
    """With its dot, lower case; (none) without one."""
    ext = F.regexp_extract(F.lower(name), r"\.([^.]*)$", 0)
    return F.when(ext == "", "(none)").otherwise(ext)


def dual_extension(name: Column) -> Column:
    parts = F.split(F.lower(name), r"\.")
    return F.coalesce((F.size(parts) >= 3) & F.try_element_at(parts, F.lit(-2)).isin(X.DOCUMENT_EXTENSIONS), F.lit(False))


def hidden_unicode_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, X.HIDDEN_CHARS, ""))


def shannon_entropy(text: Column) -> Column:
    """Bits per character; 0 for an empty text. The characters are sorted, then one fold sees the lengths of their runs."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    n = F.length(text).cast("double")
    part = lambda run: F.when(run > 0, run * F.log2(run)).otherwise(F.lit(0.0))
    state = lambda c, run, total: F.struct(c.alias("c"), run.alias("run"), total.alias("total"))
    step = lambda s, c: F.when(s["c"] == c, state(c, s["run"] + 1, s["total"])).otherwise(state(c, F.lit(1.0), s["total"] + part(s["run"])))
    total = F.aggregate(chars, state(F.lit(""), F.lit(0.0), F.lit(0.0)), step, lambda s: s["total"] + part(s["run"]))
    return F.when(n > 0, F.log2(n) - total / n).otherwise(F.when(text.isNotNull(), F.lit(0.0)))


def looks_random(text: Column, least: int = 12, bits: float = 3.5) -> Column:
    return F.when(F.length(text) >= least, shannon_entropy(text) > bits).otherwise(False)


def hidden_chars(text: Column) -> Column:
    """Counts of zero-width, direction and override characters; joiners only between Latin letters or digits."""
    count = lambda p: F.regexp_count(inner, F.lit(p)).cast("int")
    inner = F.regexp_replace(text, "^\ufeff", "")
    zero = count("[\u200b\u2060-\u2064\ufeff]") + count("(?<=[A-Za-z0-9])[\u200c\u200d](?=[A-Za-z0-9])")
    override = count("[\u202d\u202e]")
    found = lambda z, b, o: F.struct(z.alias("zero_width"), b.alias("bidi"), o.alias("override"))
    none = F.lit(0)
    # Most texts hold none of these characters, which a look at their size or one pass tells.
    clean = is_ascii(text) | ~text.rlike("[\u200b-\u200d\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufeff]")
    return F.when(clean, found(none, none, none)).otherwise(found(zero, override + count("[\u202a-\u202c\u2066-\u2069]"), override))


def script_profile(text: Column) -> Column:
    """Scripts with three letters and 5 % of the letters, most used first; else the most used one.

    Letters are counted by the length that a text loses with them. One pass takes the Latin ones,
    another all blocks that hold no other script; other letters are then counted in what is left.
    """
    lost = lambda t, letters: F.length(t) - F.length(F.regexp_replace(t, f"[{letters}]+", ""))
    others = F.regexp_replace(text, r"[\x00-\u036f\u1d00-\u1eff\u2000-\u2bff]+", "")
    counted = lambda rest: F.array(*(F.struct((-lost(text if s == "latin" else rest, v)).alias("n"), F.lit(k).alias("k"), F.lit(s).alias("s")) for k, (s, v) in enumerate(X.SCRIPTS.items())))

    def of(present: Column, total: Column) -> Column:
        large = F.filter(present, lambda c: (c["n"] <= -3) & (-c["n"] >= total * 0.05))
        return F.transform(F.when(F.size(large) > 0, large).otherwise(F.slice(present, 1, 1)), lambda c: c["s"])

    # One-element arrays bind the counts, and then their sum, to a variable: each is evaluated once.
    counts = F.transform(F.array(others), counted)
    present = F.transform(counts, lambda c: F.array_sort(F.filter(c, lambda x: x["n"] < 0)))
    summed = F.transform(present, lambda p: F.struct(p.alias("p"), F.aggregate(p, F.lit(0), lambda a, c: a - c["n"]).alias("total")))
    used = F.transform(summed, lambda x: of(x["p"], x["total"]))[0]
    ascii_ = F.when(text.rlike("[A-Za-z]"), F.array(F.lit("latin"))).otherwise(F.array().cast("array<string>"))
    return F.when(is_ascii(text), ascii_).otherwise(used)


def mixed_script_words(text: Column) -> Column:
    """How many words hold letters of two of the scripts that are confused with each other."""
    letters = "".join(X.SCRIPTS.values())
    words = F.regexp_extract_all(text, F.lit(rf"[{letters}][{letters}\u0300-\u036f\u200c\u200d\ufe00-\ufe0f]*"), F.lit(0))
    mixed = F.filter(words, lambda w: reduce(lambda a, b: a + b, [F.when(w.rlike(f"[{X.SCRIPTS[s]}]"), 1).otherwise(0) for s in X.CONFUSABLE_SCRIPTS]) >= 2)
    # Two of them are at least one that is not Latin.
    other = "".join(X.SCRIPTS[s] for s in X.CONFUSABLE_SCRIPTS if s != "latin")
    return F.when(is_ascii(text) | ~text.rlike(f"[{other}]"), 0).otherwise(F.size(mixed))


def _literal_map(values: dict) -> Column:
    """A map of fixed values, as one SQL literal."""
    text = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr("map(" + ", ".join(text(x) for pair in values.items() for x in pair) + ")")


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once: a one-element array binds it to a variable."""
    return F.transform(F.array(value), use)[0]


def _after(text: Column, mark: str, read) -> Column:
    """A text whose pieces after each ``mark`` are what ``read`` makes of them; texts without it are left alone."""
    joined = lambda ps: F.concat(ps[0], F.array_join(F.transform(F.slice(ps, F.lit(2), F.size(ps)), read), ""))
    return _bound(text, lambda t: F.when(t.contains(mark), _bound(F.split(t, mark), joined)).otherwise(t))


def decode_references(text: Column, unended: list[str] = X.BARE_REFERENCES) -> Column:
    """Character references as characters: numeric ones, with or without semicolon, then those of HTML 4, then the ``unended`` ones, the few that need no semicolon.

    128-159 are Windows-1252; numbers that are no character give U+FFFD, unknown names stay.
    """

    def numeric(p: Column) -> Column:
        code = F.regexp_extract(p, r"^(?:[xX][0-9a-fA-F]+|[0-9]+)", 0)
        cp = F.when(code.rlike("^[xX]"), F.conv(F.substring(code, F.lit(2), F.length(code)), 16, 10)).otherwise(code).try_cast("bigint")
        fine = (cp > 0) & (cp <= 0x10FFFF) & ~cp.between(0xD800, 0xDFFF)
        char = F.when(cp.between(128, 159), _literal_map(X.CP1252)[cp.cast("int")]).when(fine, F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")).otherwise("\ufffd")
        rest = F.substring(p, F.length(code) + 1, F.length(p))
        return F.when(code == "", F.concat(F.lit("&#"), p)).otherwise(F.concat(char, F.regexp_replace(rest, "^;", "")))

    def named(p: Column) -> Column:
        name = F.regexp_extract(p, r"^([A-Za-z][A-Za-z0-9]*);", 1)
        low = F.lower(name)
        char = F.coalesce(_literal_map(X.REFERENCES)[name], F.when(low.isin("amp", "lt", "gt", "quot"), _literal_map(X.REFERENCES)[low]))
        return F.coalesce(F.concat(char, F.substring(p, F.length(name) + 2, F.length(p))), F.concat(F.lit("&"), p))

    def bare(p: Column) -> Column:
        name = F.regexp_extract(p, rf"(?i)^({'|'.join(unended)})(?![A-Za-z0-9;])", 1)
        return F.coalesce(F.concat(_literal_map(X.REFERENCES)[F.lower(name)], F.substring(p, F.length(name) + 1, F.length(p))), F.concat(F.lit("&"), p))

    return _after(_after(_after(text, "&#", numeric), "&", named), "&", bare)


def html_to_text(page: Column, unended: list[str] = X.BARE_REFERENCES) -> Column:
    """Visible text: scripts and styles out, breaks and block ends to line feeds, tags out, entities decoded, blanks squeezed."""
    text = F.regexp_replace(page, r"(?is)<(script|style|head|title)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>|</(?:p|div|tr|li|h[1-6]|table|blockquote)\s*>", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", "")
    text = decode_references(text, unended)
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def hidden_css_blocks(page: Column) -> Column:
    """Elements whose inline style hides three characters or more."""
    pieces = F.regexp_extract_all(F.substring(page, 1, X.HTML_SCAN_CHARS), F.lit(r"""(?i)\bstyle\s*=\s*(?:"[^"]*"|'[^']*')[^>]*>[^<]*"""), F.lit(0))

    def hides(p: Column) -> Column:
        css = F.regexp_extract(p, r"""(?i)^style\s*=\s*["']([^"']*)""", 1)
        inner = F.regexp_replace(F.regexp_extract(p, r"^[^>]*>(.*)$", 1), r"(?i)\s|&nbsp;|&#160;", "")
        return (F.length(inner) >= 3) & (css.rlike(X.HIDDEN_CSS) | css.rlike(X.OFF_SCREEN) | css.rlike(X.TINY) | (css.rlike(X.WHITE_TEXT) & css.rlike(X.WHITE_GROUND)))

    return F.size(F.filter(pieces, hides))


def links(page: Column) -> Column:
    """Array of (text, href, mismatch): anchors and whether a host shown differs from the real one."""
    anchors = F.regexp_extract_all(page, F.lit(r"(?is)<a\s[^>]*>.*?</a\s*>"), F.lit(0))

    def read(a: Column) -> Column:
        href = F.regexp_extract(a, r"""(?is)^<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)""", 1)
        text = F.trim(F.regexp_replace(F.regexp_extract(a, r"(?is)^<a\s[^>]*>(.*)</a\s*>$", 1), r"<[^>]*>", ""))
        shown = F.regexp_extract(F.lower(text), r"^(?:https?://)?(?:www\.)?((?:[a-z0-9-]+\.)+[a-z]{2,})(?:[/?#:]\S*)?$", 1)
        real = F.regexp_replace(F.regexp_extract(F.lower(href), r"^https?://([^/?#:]+)", 1), r"^www\.", "")
        return F.struct(text.alias("text"), href.alias("href"), ((shown != "") & (real != "") & (shown != real)).alias("mismatch"))

    return F.transform(anchors, read)


def remote_resources(page: Column) -> Column:
    """Addresses of images and backgrounds that would load from elsewhere."""
    flat = F.regexp_replace(page, r"[\t\n\r]", "")
    found = F.regexp_extract_all(flat, F.lit(r"""(?i)<(?:img|input|table|td|body|video|audio|source)\b[^>]*?\b(?:src|background|poster)\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))
    css = F.regexp_extract_all(flat, F.lit(r"""(?i)url\(\s*["']?([^"')\s]+)"""), F.lit(1))
    return F.array_distinct(F.filter(F.concat(found, css), lambda u: u.rlike("(?i)^(?:https?:)?//")))


def is_private_ip(ip: Column) -> Column:
    part = lambda k: F.try_element_at(F.split(ip, r"\."), F.lit(k)).try_cast("int")
    a, b = part(1), part(2)
    v4 = (a == 10) | (a == 127) | (a == 0) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
    return F.coalesce(F.when(ip.contains(":"), ip.rlike(r"(?i)^(?:::1$|f[cd]|fe[89ab])")).otherwise(v4), F.lit(False))


def canonical_ip(text: Column) -> Column:
    """One form for each address: IPv4 without leading zeros, IPv6 as eight lower-case groups, mapped IPv4 as IPv4; null if it is none."""
    low = F.lower(text)
    v4 = F.regexp_extract(low, r"^(?:::ffff:)?((?:\d{1,3}\.){3}\d{1,3})$", 1)
    four = F.transform(F.split(v4, r"\."), lambda x: x.try_cast("int"))
    groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
    left, right = groups(F.substring_index(low, "::", 1)), F.when(low.contains("::"), groups(F.substring_index(low, "::", -1))).otherwise(F.array().cast("array<string>"))
    known = F.size(left) + F.size(right)
    eight = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - known)), right)
    fine = low.rlike(r"^[0-9a-f]{0,4}(?::[0-9a-f]{0,4}){2,7}$") & ~low.rlike(":::|::.*::") & F.when(low.contains("::"), known < 8).otherwise((known == 8) & (F.size(F.split(low, ":")) == 8))
    short = F.transform(eight, lambda g: F.coalesce(F.nullif(F.ltrim(g, F.lit("0")), F.lit("")), F.lit("0")))
    return F.when((v4 != "") & ~F.exists(four, lambda x: x > 255), F.array_join(F.transform(four, lambda x: x.cast("string")), ".")).when(fine, F.array_join(short, ":"))


def domain_tokens(text: Column, cap: int = 200) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)*\.[a-z]{2,}\b"), F.lit(0))), 1, cap)


def sniffed_type(head: Column) -> Column:
    """What the first bytes (binary) say a file is; empty if nothing."""
    h = F.hex(head)
    return (
        F.when(F.length(h) < 8, "").when(h.startswith("4D5A"), "exe").when(h.startswith("7F454C46"), "elf")
        .when(h.rlike("^(?:FEEDFAC[EF]|C[EF]FAEDFE)"), "macho").when(h.startswith("4C000000011402"), "lnk").when(h.startswith("2321"), "script").otherwise("")
    )


def category_of(host: Column, keyword: Column) -> Column:
    """A keyword with a leading dot is a suffix, one with a dot a domain, a bare word a substring."""
    return F.when(keyword.startswith("."), host.endswith(keyword)).when(keyword.contains("."), is_under(host, keyword)).otherwise(host.contains(keyword))


def domain_age(answer: Column, today: Column) -> Column:
    """(registrar, created, days) of a stored registration answer in JSON."""
    read = F.from_json(answer, "entities array<struct<roles:array<string>,name:string>>, events array<struct<eventAction:string,eventDate:string>>")
    registrar = F.try_element_at(F.filter(read["entities"], lambda e: F.array_contains(e["roles"], "registrar")), F.lit(1))["name"]
    created = F.try_element_at(F.filter(read["events"], lambda e: e["eventAction"] == "registration"), F.lit(1))["eventDate"]
    day = F.try_to_timestamp(created).cast("date")
    return F.struct(registrar.alias("registrar"), day.alias("created"), F.datediff(today, day).alias("days"))


def pick_image(attachments: Column) -> Column:
    """The first image of a list of attachments between 512 bytes and 8 MiB; null without one."""
    fits = F.filter(attachments, lambda a: a["mime_type"].startswith("image/") & (a["size"] > 512) & (a["size"] < 8 * 1024 * 1024))
    return F.try_element_at(fits, F.lit(1))


def text_overlap(one: Column, two: Column, cap: int = 1500) -> Column:
    """Shared words of three letters or more over those of the smaller text; null under eight words."""
    words_ = lambda t: F.slice(F.array_distinct(F.regexp_extract_all(F.lower(F.substring(t, 1, X.SCAN_CHARS)), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0))), 1, cap)
    a, b = words_(one), words_(two)
    small = F.least(F.size(a), F.size(b))
    return F.when(small >= 8, F.size(F.array_intersect(a, b)) / small)
