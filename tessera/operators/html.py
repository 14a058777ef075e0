"""HTML operators: tokenise (O26), furniture classes (O27), furniture spans
(O28) and clean text (O29).

Plan shape. A page is worked on in its own row: one regex scan and one split make
its tokens, each token becomes a few flags, and one fold over them finds the spans
to cut, with a count of open tags of the span's own name as its state. The text is
then put together from the stretches between cuts. No page bytes are exchanged, and
no token is a row. A page is capped at 5 MiB by ``scan_pages``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.folds import fold_chunks, none_of
from tessera.functions.html import CHROME_TAGS, MAIN_CONTENT_PATTERN, TAG_PATTERN, VOID_TAGS, is_chrome_open
from tessera.functions.text import WS, WS_CHARS, cut_tail, let, tags_to_text


def token_array(html: Column) -> Column:
    """A page's tags in order, each as (raw, seg): the tag and the text up to the next. The
    first has an empty tag, so all raw and seg joined are the page."""
    def pairs_of(head: Column, tail: Column) -> Column:
        # no tag ends behind the last '>'
        tags = F.regexp_extract_all(head, F.lit(TAG_PATTERN), 0)
        return let(F.split(head, TAG_PATTERN, -1), lambda segs: F.zip_with(
            F.concat(F.array(F.lit("")), tags), F.concat(F.slice(segs, F.lit(1), F.size(segs) - 1), F.array(F.concat(F.element_at(segs, -1), tail))),
            lambda r, s: F.struct(r.alias("raw"), s.alias("seg"))))
    return cut_tail(F.coalesce(html, F.lit("")), pairs_of)


def tokenize_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                  carry: Sequence[str] = ()) -> DataFrame:
    """One row per open/close tag, in document order.

    Row ``pos = 0`` is a pseudo token holding the text before the first tag;
    row ``pos = k`` holds tag k (``raw``) and the text up to the next tag
    (``seg``), so concatenating ``raw || seg`` in ``pos`` order rebuilds the
    page. Columns in ``carry`` are kept on the pseudo row only (null on the
    rest) so per-page values travel with the tokens without being copied.
    """
    pairs = token_array(F.col(html_col))
    exploded = pages.select(
        F.col(id_col).alias("page_id"),
        *[F.col(c) for c in carry],
        F.posexplode(pairs).alias("pos", "tok"),
    )
    raw = F.col("tok.raw")
    name = F.lower(F.regexp_extract(raw, TAG_PATTERN, 2))
    attrs = F.regexp_extract(raw, TAG_PATTERN, 3)
    pseudo = F.col("pos") == 0
    out = exploded.select(
        "page_id",
        "pos",
        raw.alias("raw"),
        F.col("tok.seg").alias("seg"),
        F.when(pseudo, F.lit(None).cast("boolean")).otherwise(raw.startswith("</")).alias("closing"),
        F.when(pseudo, F.lit(None).cast("string")).otherwise(name).alias("tag"),
        F.when(pseudo, F.lit(None).cast("string")).otherwise(attrs).alias("attrs"),
        F.when(pseudo, F.lit(None).cast("boolean"))
        .otherwise(name.isin(*VOID_TAGS) | attrs.rlike(f"/{WS}*$")).alias("self_closing"),
        *[F.when(pseudo, F.col(c)).alias(c) for c in carry],
    )
    return out


def classify_chrome(tokens: DataFrame) -> DataFrame:
    """``is_chrome`` for opening, non-self-closing tags (false otherwise)."""
    opening = (~F.col("closing")) & (~F.col("self_closing"))
    return tokens.withColumn(
        "is_chrome",
        F.coalesce(opening & is_chrome_open(F.col("tag"), F.col("attrs")), F.lit(False)))


_SPAN = "struct<s:int,e:int,action:string,tag:string>"


def _flags(token: Column, i: Column) -> Column:
    """What the fold needs of a token: its name, which way it counts, whether it may begin
    furniture, and whether main content begins with it or behind it."""
    raw, seg = token["raw"], token["seg"]
    closing = raw.startswith("</")
    skip = F.when(closing, F.lit(2)).otherwise(F.lit(1))

    def named(name: Column) -> Column:
        attrs = F.substring(raw, skip + F.length(name) + 1, F.greatest(F.length(raw) - skip - F.length(name) - 1, F.lit(0)))

        def flags(a: Column) -> Column:
            alone = name.isin(*VOID_TAGS) | F.rtrim(a, F.lit(WS_CHARS)).endswith("/")
            chrome = ~closing & ~alone & (name.isin(*CHROME_TAGS) | ((F.trim(a) != "") & is_chrome_open(name, a)))
            # a tag that can't be one of the three is looked through only where it holds another '<'
            may = name.startswith("main") | name.startswith("article") | name.startswith("h1") | seg.contains("<") | a.contains("<")
            return F.struct(i.alias("i"), name.alias("tag"), F.when(closing, F.lit(-1)).when(alone | (raw == ""), F.lit(0)).otherwise(F.lit(1)).alias("counts"),
                            ((raw != "") & chrome).alias("chrome"), (may & F.concat(raw, seg).rlike(MAIN_CONTENT_PATTERN)).alias("main"))
        return let(attrs, flags)
    return let(F.lower(F.regexp_extract(raw, "^</?([a-zA-Z][a-zA-Z0-9-]*)", 1)), named)


def chrome_spans(tokens: Column) -> Column:
    """The furniture spans of a page's tokens, in order: (s, e, action, tag).

    The first furniture tag outside an earlier span begins one, and the tag that
    balances it (counting its own name only) ends it. A span with main content is
    'kept', else 'cut'; one that nothing ends is 'unclosed', and the last."""
    def state(tag, s, depth, main, done) -> Column:
        return F.struct(tag.cast("string").alias("tag"), s.cast("int").alias("s"), depth.cast("int").alias("depth"), main.alias("main"), done.alias("done"))

    def span(acc: Column, e: Column, action: Column) -> Column:
        return F.struct(acc["s"].alias("s"), e.cast("int").alias("e"), action.alias("action"), acc["tag"].alias("tag")).cast(_SPAN)

    def step(acc: Column, x: Column) -> Column:
        within = F.coalesce(acc["s"] >= 0, F.lit(False))
        same = within & (x["tag"] == acc["tag"]) & (x["counts"] != 0)
        ended = same & (acc["depth"] + x["counts"] == 0)
        closed = span(acc, x["i"], F.when(acc["main"], F.lit("kept")).otherwise(F.lit("cut")))
        return (F.when(ended, state(F.lit(None), F.lit(-1), F.lit(0), F.lit(False), F.concat(acc["done"], F.array(closed))))
                .when(within, state(acc["tag"], acc["s"], acc["depth"] + F.when(same, x["counts"]).otherwise(F.lit(0)), acc["main"] | x["main"], acc["done"]))
                .when(x["chrome"], state(x["tag"], x["i"], F.lit(1), x["main"], acc["done"]))
                .otherwise(acc))

    def finish(acc: Column) -> Column:
        return F.when(acc["s"] >= 0, F.concat(acc["done"], F.array(span(acc, F.lit(None), F.lit("unclosed"))))).otherwise(acc["done"])

    zero = {"tag": F.lit(None), "s": F.lit(-1), "depth": F.lit(0), "main": F.lit(False), "done": none_of(_SPAN)}
    return let(fold_chunks(F.transform(tokens, _flags), state, zero, step, _SPAN), finish)


def _without(tokens: Column, cuts: Column) -> Column:
    """The page without the spans ``cuts``; what follows a span's last tag stays."""
    def stretch(t: Column, c: Column, k: Column) -> Column:
        begins = F.when(k == 0, F.lit(0)).otherwise(F.get(c, k - 1)["e"] + 1)
        ends = F.coalesce(F.get(c, k)["s"], F.size(t))
        rest = F.array_join(F.transform(F.slice(t, begins + 1, F.greatest(ends - begins, F.lit(0))), lambda x: F.concat(x["raw"], x["seg"])), "")
        return F.concat(F.when(k == 0, F.lit("")).otherwise(F.get(t, begins - 1)["seg"]), rest)
    return let(tokens, lambda t: let(cuts, lambda c: F.array_join(F.transform(F.sequence(F.lit(0), F.size(c)), lambda k: stretch(t, c, k)), "")))


def strip_chrome(pages: DataFrame) -> DataFrame:
    """From (page_id, html, ...) the HTML with furniture spans cut out (``kept_html``), plus
    ``cuts``, ``kept`` (spans spared because they hold main content) and ``unclosed``
    (the furniture tag that never closed and stopped the cutting)."""
    others = [c for c in pages.columns if c != "html"]
    tokens = pages.select(*others, token_array(F.col("html")).alias("tokens"))
    spans = tokens.select("*", let(F.col("tokens"), chrome_spans).alias("spans"))
    of = lambda action: F.filter("spans", lambda x: x["action"] == action)
    return spans.select(
        *others, _without(F.col("tokens"), of("cut")).alias("kept_html"), F.size(of("cut")).cast("int").alias("cuts"),
        F.size(of("kept")).cast("int").alias("kept"), F.get(of("unclosed"), F.lit(0))["tag"].alias("unclosed"))


def clean_pages(pages: DataFrame, extras: dict[str, Column] | None = None,
                id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Clean text of every page (furniture removed, tags dropped,
    entities decoded once, long whitespace runs to one blank line).

    Narrow: every page in its own row, in the partitioning of ``pages``. ``extras`` are
    per-page expressions over the pages' columns (title, hints, ...)."""
    p = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"), *[e.alias(k) for k, e in (extras or {}).items()])
    return strip_chrome(p).withColumn("text", tags_to_text(F.col("kept_html")))
