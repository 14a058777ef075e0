"""Column expressions for text: whitespace, entities, tag stripping.

Everything here returns a ``Column`` built from Spark SQL functions, so it
runs inside whole-stage codegen (or, for the short entity arrays, in the
interpreted higher-order functions) and never leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values --------------------------------------------------------
# Whitespace as ECMAScript's \s defines it. Java's \s is ASCII only, so the
# class is spelled out; it is used wherever the reference trims or collapses.
WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

# The same characters as a list, for functions that take characters instead of a pattern.
WS_CHARS = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

# ASCII word boundaries (the reference's regexes use ASCII \b).
WB_BEFORE = r"(?<![A-Za-z0-9_])"
WB_AFTER = r"(?![A-Za-z0-9_])"

# Named character references decoded by the page reader (fixed values).
NAMED_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
    "copy": "©", "reg": "®", "trade": "™", "hellip": "…",
    "mdash": "—", "ndash": "–", "bull": "•", "middot": "·",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "laquo": "«", "raquo": "»", "deg": "°", "plusmn": "±",
    "times": "×", "divide": "÷", "euro": "€", "pound": "£",
    "yen": "¥", "cent": "¢", "sect": "§", "para": "¶",
    "dagger": "†", "prime": "′", "frac12": "½", "frac14": "¼",
    "frac34": "¾", "ensp": " ", "emsp": " ", "thinsp": " ", "shy": "",
}

ENTITY_PATTERN = r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);"
COMMENT_PATTERN = r"(?s)<!--.*?-->"
ANY_TAG_PATTERN = r"<[^>]+>"
# -------------------------------------------------------------------------


def _entity_map() -> Column:
    items = []
    for k, v in NAMED_ENTITIES.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def codepoint_to_string(n: Column) -> Column:
    """Code point -> one-character string (``chr`` wraps at 256 in Spark).

    Surrogate code points cannot be held in UTF-8 and become U+FFFD.
    """
    as_utf32 = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when((n >= 0xD800) & (n <= 0xDFFF), F.lit("�")).otherwise(as_utf32)


def _decode_one(whole: Column, body: Column) -> Column:
    is_hex = body.startswith("#x") | body.startswith("#X")
    is_dec = body.startswith("#") & ~is_hex
    hex_digits = F.regexp_replace(F.substring(body, F.lit(3), F.length(body)), "^0+", "")
    dec_digits = F.regexp_replace(F.substring(body, F.lit(2), F.length(body)), "^0+", "")
    hex_val = F.when(F.length(hex_digits) == 0, F.lit(0)).when(
        F.length(hex_digits) <= 6, F.conv(hex_digits, 16, 10).cast("long"))
    dec_val = F.when(F.length(dec_digits) == 0, F.lit(0)).when(
        F.length(dec_digits) <= 7, dec_digits.cast("long"))
    num = F.when(is_hex, hex_val).otherwise(dec_val)
    numeric = F.when((num >= 1) & (num <= 0x10FFFF), codepoint_to_string(num)).otherwise(whole)
    named = F.coalesce(F.try_element_at(_entity_map(), body), whole)
    return F.when(is_hex | is_dec, numeric).otherwise(named)


def decode_entities(s: Column) -> Column:
    """Decode named, decimal and hex character references in one pass."""
    parts = F.split(s, ENTITY_PATTERN, -1)
    wholes = F.regexp_extract_all(s, F.lit(ENTITY_PATTERN), 0)
    # The body is the match without '&' and ';' (no second scan of the text).
    decoded = F.transform(wholes, lambda w: _decode_one(w, F.substring(w, F.lit(2), F.length(w) - 2)))
    padded = F.concat(decoded, F.array(F.lit("")))
    return F.array_join(F.zip_with(parts, padded, lambda p, d: F.concat(p, d)), "")


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once. (A fold over one element hands its
    result on as it is, while ``transform`` copies every array inside it.)"""
    return F.aggregate(F.array(F.lit(0)), value, lambda v, _: v, then)


def js_trim(s: Column) -> Column:
    return F.regexp_replace(s, f"^{WS}+|{WS}+$", "")


def collapse_blocks(s: Column) -> Column:
    """Runs of three or more whitespace characters become one blank line."""
    return js_trim(F.regexp_replace(s, f"{WS}{{3,}}", "\n\n"))


#: Put behind the '<' of an opening tag that no closing one follows. A noncharacter: no page may hold it.
DEAD = "\uffff"


def cut_tail(html: Column, then) -> Column:
    """``then(head, tail)``: the text up to its last '>', and what follows. No tag or
    comment ends in the tail, so a pattern for them need not look there."""
    return let(html, lambda h: let(F.substring_index(h, ">", -1), lambda tail: then(F.substring(h, F.lit(1), F.length(h) - F.length(tail)), tail)))


def mark_unclosed(html: Column, kinds: list[tuple[str, str]]) -> Column:
    """The text with DEAD in every opening that has no closing of its kind behind it.

    ``kinds`` are pairs of patterns: what follows the '<' of an opening, and a closing.
    An opening that ends at or before the last '>' in front of the last closing has one;
    any other has none. A lazy pattern from an unmarked opening to its closing
    therefore always finds one, and reads each character once, whatever mixture of
    openings and closings a page holds."""
    def mark(text: Column, opening: str, closing: str) -> Column:
        # a comment's opening ends in front of its closing; a tag's at some '>'
        live = r"(?is)^.*(?=-->)" if opening == "!--" else rf"(?is)^.*>(?=[^>]*{closing})"
        dead = lambda t, upto: F.concat(upto, F.regexp_replace(F.substring(t, F.length(upto) + 1, F.length(t)), rf"(?i)<(?={opening})", "<" + DEAD))
        return let(text, lambda t: F.when(t.rlike(rf"(?i)<{opening}"), let(F.regexp_extract(t, live, 0), lambda upto: dead(t, upto))).otherwise(t))

    def all_kinds(head: Column, tail: Column) -> Column:
        for opening, closing in kinds:
            head = mark(head, opening, closing)
        return F.concat(head, F.regexp_replace(tail, "(?i)<(?=" + "|".join(o for o, _ in kinds) + ")", "<" + DEAD))
    return cut_tail(html, all_kinds)


def unmark(s: Column) -> Column:
    return F.replace(s, F.lit("<" + DEAD), F.lit("<"))


COMMENT = ("!--", "-->")


def _elements(*names: str) -> list[tuple[str, str]]:
    return [(rf"{n}(?![A-Za-z0-9-])", rf"</{n}[^>]*>") for n in names]


def live_html(html: Column) -> Column:
    """A page as a parser sees its elements: without comments, and with empty
    scripts and styles (their content is text, whatever it looks like)."""
    marked = mark_unclosed(html, [COMMENT, *_elements("script", "style")])
    return unmark(F.regexp_replace(marked, r"(?is)(<(script|style)(?![A-Za-z0-9-])[^>]*>).*?(</\2[^>]*>)|<!--.*?-->", "$1$3"))


def spoken_html(html: Column) -> Column:
    """A page without comments, scripts, styles and templates: what holds its words."""
    marked = mark_unclosed(html, [COMMENT, *_elements("script", "style", "template")])
    return unmark(F.regexp_replace(marked, r"(?is)<(script|style|template)(?![A-Za-z0-9-])[^>]*>.*?</\1[^>]*>|<!--.*?-->", " "))


def tags_to_text(html: Column) -> Column:
    """Drop comments, turn every tag into a space, decode entities once,
    collapse long whitespace runs and trim (no chrome removal)."""
    no_comments = unmark(F.regexp_replace(mark_unclosed(html, [COMMENT]), COMMENT_PATTERN, ""))
    spaced = cut_tail(no_comments, lambda head, tail: F.concat(F.regexp_replace(head, ANY_TAG_PATTERN, " "), tail))
    return collapse_blocks(decode_entities(spaced))


def squash_spaces(s: Column) -> Column:
    """Every whitespace run -> one space, then trim."""
    return js_trim(F.regexp_replace(s, f"{WS}+", " "))


def regex_quote(s: str) -> str:
    """Escape a literal for a Java regex (the ``\\Q…\\E`` form breaks on ``\\E``)."""
    out = []
    for ch in s:
        if ch in r".*+?^${}()|[]\/-":
            out.append("\\" + ch)
        else:
            out.append(ch)
    return "".join(out)
