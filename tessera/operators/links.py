"""Links and destinations: href extraction with URL resolution (O35), anchor
vs page split (O36), redirect chains (O46) and destination policy (O51).

The resolver is a column expression (no UDF): scheme-relative, absolute,
root-relative, query-only, fragment-only and relative paths, with dot
segments folded, host lower-cased, default port dropped and the WHATWG
percent-encoding of path, query and fragment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import WS, js_trim
from tessera.session import saved

# --- fixed values --------------------------------------------------------
HREF_PATTERN = r"""(?i)href""" + WS + r"""*=""" + WS + r"""*["']([^"']+)["']"""
SKIP_SCHEME_PATTERN = r"(?i)^(javascript|mailto|tel|data):"
URL_PATTERN = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
# WHATWG percent-encode sets (controls, space and non-ASCII always encoded).
PATH_ENCODE = r"[\x00-\x20\x22\x3C\x3E\x60\x7B\x7D\x7F-\x{10FFFF}]"
QUERY_ENCODE = r"[\x00-\x20\x22\x23\x27\x3C\x3E\x7F-\x{10FFFF}]"
FRAGMENT_ENCODE = r"[\x00-\x20\x22\x3C\x3E\x60\x7F-\x{10FFFF}]"
SPECIAL_SCHEME = r"(?i)^(?:https?|wss?|ftp):"
NUMERIC_HOST = r"(?i)(?:^|\.)(?:0x[0-9a-f]*|[0-9]+)\.?$"
MAX_REDIRECTS = 5
# Reserved IPv4 ranges (first, last as 32-bit numbers) in rule order.
RESERVED_V4 = [
    ("0.0.0.0/8 (this network)", 0, 0x00FFFFFF),
    ("10.0.0.0/8 (private)", 0x0A000000, 0x0AFFFFFF),
    ("127.0.0.0/8 (loopback)", 0x7F000000, 0x7FFFFFFF),
    ("169.254.0.0/16 (link-local — cloud instance metadata)", 0xA9FE0000, 0xA9FEFFFF),
    ("172.16.0.0/12 (private)", 0xAC100000, 0xAC1FFFFF),
    ("192.168.0.0/16 (private)", 0xC0A80000, 0xC0A8FFFF),
    ("100.64.0.0/10 (carrier NAT)", 0x64400000, 0x647FFFFF),
    ("224.0.0.0/4+ (multicast/reserved)", 0xE0000000, 0xFFFFFFFF),
]
# -------------------------------------------------------------------------


def percent_encode(s: Column, char_class: str) -> Column:
    """UTF-8 percent-encode every character in ``char_class`` (a plain scan
    first: most URLs need no encoding and skip the array work)."""
    return F.when(s.rlike(char_class), _percent_encode_all(s, char_class)).otherwise(s)


def _percent_encode_all(s: Column, char_class: str) -> Column:
    parts = F.split(s, char_class, -1)
    chars = F.regexp_extract_all(s, F.lit(char_class), 0)
    enc = F.transform(chars, lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))
    return F.array_join(F.zip_with(parts, F.concat(enc, F.array(F.lit(""))), lambda p, e: F.concat(p, e)), "")


def remove_dot_segments(path: Column) -> Column:
    """Fold '.' and '..' segments of an absolute path, also when percent-coded
    (only paths that have such a segment go through the fold)."""
    dot = r"(?:\.|%2[eE])"
    plain = F.regexp_replace(F.regexp_replace(path, rf"(^|/){dot}{dot}(?=/|$)", "$1.."), rf"(^|/){dot}(?=/|$)", "$1.")
    return F.when(path.rlike(rf"(^|/){dot}{{1,2}}(/|$)"), _fold_dot_segments(plain)).otherwise(path)


def _fold_dot_segments(path: Column) -> Column:
    segs = F.slice(F.split(path, "/", -1), F.lit(2), F.length(path) + 1)
    n = F.size(segs)
    indexed = F.transform(segs, lambda s, i: F.struct(s.alias("s"), (i + 1 == n).alias("last")))

    def step(acc: Column, x: Column) -> Column:
        popped = F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
        dotdot = F.when(x["last"], F.concat(popped, F.array(F.lit("")))).otherwise(popped)
        dot = F.when(x["last"], F.concat(acc, F.array(F.lit("")))).otherwise(acc)
        return (F.when(x["s"] == "..", dotdot).when(x["s"] == ".", dot)
                .otherwise(F.concat(acc, F.array(x["s"]))))
    folded = F.aggregate(indexed, F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def canonical_url(url: Column) -> Column:
    """Spelling variants that a URL parser accepts, made plain: outer control
    characters and inner line breaks and tabs dropped, and for http-like
    schemes any run of slashes or backslashes after the scheme is '//', and a
    backslash before the query is a slash."""
    u = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    head = F.regexp_extract(u, r"^([^?#]*)", 1)
    slashed = F.regexp_replace(F.translate(head, "\\", "/"), r"^([A-Za-z]+):/*", "$1://")
    fixed = F.concat(slashed, F.substring(u, F.length(head) + 1, F.length(u)))
    return F.when(u.rlike(SPECIAL_SCHEME), fixed).otherwise(u)


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _ipv4_part(x: Column) -> Column:
    """One part of an IPv4 host: decimal, 0 octal or 0x hex; null if it is none."""
    digits = F.regexp_replace(x, "^0[xX]", "")
    number = (F.when(x.rlike("^0[xX][0-9a-fA-F]*$"), F.conv(F.concat(F.lit("0"), digits), 16, 10))
              .when(x.rlike("^0[0-7]+$"), F.conv(x, 8, 10)).when(x.rlike("^(0|[1-9][0-9]*)$"), x))
    return F.when(F.length(x) <= 16, number.cast("long"))


def _ipv4_total(parts: Column) -> Column:
    n = F.size(parts)
    limit = F.element_at(F.array(*[F.lit(256 ** k) for k in (4, 3, 2, 1)]), F.least(n, F.lit(4)))
    fits = (n <= 4) & ~F.exists(parts, lambda p: p.isNull()) & ~F.exists(F.slice(parts, F.lit(1), n - 1), lambda p: p > 255) & (
        F.element_at(parts, -1) < limit)
    place = F.array(*[F.lit(256 ** k) for k in (3, 2, 1)])
    total = F.aggregate(F.transform(parts, lambda p, i: F.when(i < n - 1, p * F.get(place, i)).otherwise(p)), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(fits, total)


def ipv4_number(host: Column) -> Column:
    """32-bit number of an IPv4 host in any form a URL parser takes: one to four
    parts, the last filling the bytes that are left, each decimal, octal or
    hexadecimal, with an optional final dot. Null if the host is not one."""
    parts = F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), _ipv4_part)
    return F.when(host.rlike(NUMERIC_HOST), _let(parts, _ipv4_total))


def ipv4_text(number: Column) -> Column:
    """Dotted quad of a 32-bit number."""
    return F.concat_ws(".", *[F.shiftright(number, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def plain_host(host: Column) -> Column:
    """Host as a URL parser keeps it: percent-decoded, lower-case, IPv4 as a dotted quad."""
    def decoded(x: Column) -> Column:
        return F.lower(F.when(x.contains("%"), F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)).otherwise(x))

    def quad(x: Column) -> Column:
        return F.when(x.rlike(NUMERIC_HOST), _let(ipv4_number(x), lambda n: F.when(n.isNull(), x).otherwise(ipv4_text(n)))).otherwise(x)

    return _let(_let(host, decoded), quad)


def ipv6_groups(host: Column) -> Column:
    """The eight 16-bit groups of an IPv6 host (no brackets); null if it is not one."""
    def hexed(x: Column) -> Column:
        pair = lambda n: F.concat_ws(":", F.lower(F.hex(F.shiftright(n, 16))), F.lower(F.hex(n.bitwiseAND(F.lit(0xFFFF)))))
        tail = F.regexp_extract(x, r":([0-9]+\.[0-9.]+)$", 1)
        return F.when(tail != "", F.concat(F.regexp_replace(x, r"[0-9]+\.[0-9.]+$", ""), _let(ipv4_number(tail), pair))).otherwise(x)

    def filled(x: Column) -> Column:
        sides = F.transform(F.split(x, "::"), lambda part: F.filter(F.split(part, ":"), lambda g: g != ""))
        return _let(sides, lambda s: F.when(F.size(s) == 1, F.get(s, F.lit(0))).when(
            F.size(s) == 2, F.concat(F.get(s, F.lit(0)), F.array_repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(8) - F.size(F.flatten(s)))), F.get(s, F.lit(1)))))

    def numbers(g: Column) -> Column:
        return F.transform(g, lambda x: F.when(x.rlike("^[0-9a-f]{1,4}$"), F.conv(x, 16, 10).cast("long")))

    groups = _let(_let(_let(host, hexed), filled), numbers)
    return F.when(host.contains(":"), _let(groups, lambda g: F.when((F.size(g) == 8) & ~F.exists(g, lambda x: x.isNull()), g)))


def url_parts(url: Column) -> dict[str, Column]:
    """scheme (lower), host (lower), port ('' when default), path, query
    ('?…' or ''), fragment ('#…' or '') of an absolute URL."""
    scheme = F.lower(F.regexp_extract(url, URL_PATTERN, 1))
    auth = F.regexp_extract(url, URL_PATTERN, 2)
    hostport = F.regexp_replace(auth, "^.*@", "")
    host = F.lower(F.regexp_extract(hostport, r"^(\[[^\]]*\]|[^:]*)", 1))
    port = F.regexp_extract(hostport, r"^(?:\[[^\]]*\]|[^:]*):([0-9]*)$", 1)
    port = F.regexp_replace(port, "^0+(?=.)", "")
    default = F.when(scheme == "http", F.lit("80")).when(scheme == "https", F.lit("443")).otherwise(F.lit(""))
    port = F.when(port == default, F.lit("")).otherwise(port)
    path = F.regexp_extract(url, URL_PATTERN, 3)
    return {"scheme": scheme, "host": host, "port": port, "path": path,
            "query": F.regexp_extract(url, URL_PATTERN, 4), "fragment": F.regexp_extract(url, URL_PATTERN, 5)}


def origin_of(url: Column) -> Column:
    p = url_parts(url)
    return F.concat(p["scheme"], F.lit("://"), p["host"],
                    F.when(p["port"] != "", F.concat(F.lit(":"), p["port"])).otherwise(F.lit("")))


def _with_parts(df: DataFrame, url: str, prefix: str) -> DataFrame:
    p = url_parts(F.col(url))
    return df.select("*", *[c.alias(prefix + k) for k, c in p.items()])


def _origin_cols(prefix: str) -> Column:
    return F.concat(F.col(prefix + "scheme"), F.lit("://"), F.col(prefix + "host"),
                    F.when(F.col(prefix + "port") != "", F.concat(F.lit(":"), F.col(prefix + "port")))
                    .otherwise(F.lit("")))


def with_resolved_url(df: DataFrame, href: str, base: str, out: str = "target_url") -> DataFrame:
    """Add ``out``: ``href`` resolved against the absolute URL in ``base``.

    Written as a chain of projections (base parts, then the merged URL, then
    its parts, then the normalised path) so every intermediate is computed
    once per row rather than re-inlined into one large expression.
    """
    keep = [c for c in df.columns if not c.startswith("_b_")]
    d = df.withColumn("_h", F.regexp_replace(F.col(href), r"[\t\n\r]", ""))
    if "_b_scheme" not in df.columns:
        d = _with_parts(d, base, "_b_")
    d = d.withColumn("_bpath", F.when(F.col("_b_path") == "", F.lit("/")).otherwise(F.col("_b_path")))
    # for an http-like base a backslash before the query is a slash
    plain = F.concat(F.translate(F.regexp_extract("_h", r"^([^?#]*)", 1), "\\", "/"), F.regexp_extract("_h", r"^[^?#]*(.*)$", 1))
    d = d.withColumn("_h", F.when(F.col("_h").contains("\\") & F.col("_b_scheme").isin("http", "https"), plain).otherwise(F.col("_h")))
    h = F.col("_h")
    d = d.select("*", h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:").alias("_has_scheme"),
                 F.lower(F.regexp_extract(h, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)).alias("_h_scheme"),
                 F.regexp_replace(h, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "").alias("_rest"))
    same_rel = F.col("_has_scheme") & (F.col("_h_scheme") == F.col("_b_scheme")) & ~F.col("_rest").startswith("/")
    d = d.select("*", same_rel.alias("_same_rel"))
    d = d.withColumn("_rel", F.when(F.col("_same_rel"), F.col("_rest")).otherwise(h))
    rel = F.col("_rel")
    borigin = _origin_cols("_b_")
    full = (F.when(F.col("_has_scheme") & ~F.col("_same_rel"),
                   F.concat(F.col("_h_scheme"), F.lit("://"), F.regexp_replace(F.col("_rest"), "^/*", "")))
            .when(h.startswith("//"), F.concat(F.col("_b_scheme"), F.lit(":"), h))
            .when(rel.startswith("/"), F.concat(borigin, rel))
            .when(rel.startswith("?"), F.concat(borigin, F.col("_bpath"), rel))
            .when(rel.startswith("#"), F.concat(borigin, F.col("_bpath"), F.col("_b_query"), rel))
            .when(rel == "", F.concat(borigin, F.col("_bpath"), F.col("_b_query")))
            .otherwise(F.concat(borigin, F.regexp_replace(F.col("_bpath"), "[^/]*$", ""),
                                F.regexp_extract(rel, r"^([^?#]*)", 1), F.regexp_extract(rel, r"^[^?#]*(.*)$", 1))))
    d = d.withColumn("_full", full)
    d = _with_parts(d, "_full", "_t_")
    d = d.withColumn("_tpath", remove_dot_segments(
        F.when(F.col("_t_path") == "", F.lit("/")).otherwise(F.col("_t_path"))))
    target = F.concat(_origin_cols("_t_"), percent_encode(F.col("_tpath"), PATH_ENCODE),
                      percent_encode(F.col("_t_query"), QUERY_ENCODE),
                      percent_encode(F.col("_t_fragment"), FRAGMENT_ENCODE))
    ok = F.col("_full").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+")
    return d.select(*keep, F.when(ok, target).alias(out),
                    F.when(ok, _origin_cols("_t_")).alias(out + "_origin"), borigin.alias("_base_origin"))


def extract_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every quoted href on any tag, resolved against the page URL, same
    origin only, distinct in first-seen order (``link_no`` 1-based)."""
    hrefs = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(HREF_PATTERN), 1)
    # The page URL is parsed once per page, before its hrefs are exploded.
    p = _with_parts(pages.select("page_id", F.col(url_col).alias("base"), hrefs.alias("hrefs")), "base", "_b_")
    e = p.select("page_id", "base", *[c for c in p.columns if c.startswith("_b_")],
                 F.posexplode("hrefs").alias("pos", "raw"))
    # One exchange of link rows on page_id: resolution runs spread over all
    # tasks, and the distinct-per-page aggregate and the numbering window
    # below reuse this partitioning (no further exchange).
    e = e.repartition("page_id")
    e = e.withColumn("raw", js_trim(F.col("raw")))
    e = e.where((F.col("raw") != "") & ~F.col("raw").rlike(SKIP_SCHEME_PATTERN))
    e = with_resolved_url(e, "raw", "base")
    same_origin = F.coalesce(F.col("target_url").isNotNull() & (F.col("target_url_origin") == F.col("_base_origin")),
                             F.lit(False))
    # Filtered after the aggregate, on an aggregate value: a filter on the
    # resolved URL itself would be pushed below its projection, inlining the
    # resolver expression a second time.
    first = (e.groupBy("page_id", "target_url")
             .agg(F.min("pos").alias("pos"), F.first("base").alias("base"), F.max(same_origin).alias("keep"))
             .where(F.col("keep")).drop("keep"))
    w = Window.partitionBy("page_id").orderBy("pos")
    return first.select("page_id", F.row_number().over(w).cast("int").alias("link_no"), "target_url", "base")


def split_anchors(links: DataFrame) -> DataFrame:
    """A link with a fragment to the same path and query is an anchor
    (kind 'anchor', value '#frag'); the rest are pages."""
    t = url_parts(F.col("target_url"))
    b = url_parts(F.col("base"))
    bpath = F.when(b["path"] == "", F.lit("/")).otherwise(b["path"])
    is_anchor = (t["fragment"].rlike("^#.") & (t["path"] == bpath) & (t["query"] == b["query"]))
    return links.select("page_id", "link_no", "target_url",
                        F.when(is_anchor, F.lit("anchor")).otherwise(F.lit("page")).alias("kind"),
                        F.when(is_anchor, t["fragment"]).otherwise(F.col("target_url")).alias("value"))


def _same_url(df: DataFrame, url: str, out: str) -> DataFrame:
    """Add ``out``: the URL as a parser writes it back (null if it can't be used)."""
    d = df.withColumn("_u", canonical_url(F.col(url)))
    return with_resolved_url(d, "_u", "_u", out).drop("_u", out + "_origin", "_base_origin")


def resolve_redirects(urls: DataFrame, hops: DataFrame, max_hops: int = MAX_REDIRECTS, allow: DataFrame | None = None) -> DataFrame:
    """Follow ``hops`` (url -> location) from each start URL.

    Start and hop URLs meet in the spelling a URL parser gives them; of several
    locations of one URL the smallest counts. Each location is resolved and
    gated (``classify_destination``) once, in the hop table; the walk is at most
    ``max_hops + 1`` joins on the URL, a constant.

    Status: 'ok' (no further hop); 'off_origin' (ended on another origin);
    'too_many' (a hop is still pending after ``max_hops``); 'no_location' (a hop
    without a location); 'bad_location' (one that is no URL); 'blocked' (the start
    or a hop leads to a destination that is not allowed; it is not followed).
    ``final_url`` is the last URL reached.
    """
    # written between the steps: a filter or join key that is pushed below the
    # resolver's projections would inline them into one another
    table = saved(_same_url(hops.select("url", F.coalesce("location", F.lit("")).alias("location")), "url", "at"), "hops")
    table = table.where("at is not null").groupBy("at").agg(F.min("location").alias("location"))
    table = with_resolved_url(table, "location", "at", "next")
    table = saved(table.select("at", F.when(F.col("location") != "", F.col("next")).alias("next"), (F.col("location") == "").alias("bare")), "hops")
    gate = classify_destination(table.select(F.col("at").alias("url_id"), F.coalesce("next", F.col("at")).alias("url")), allow)
    gate = gate.select(F.col("url_id").alias("at"), (F.col("status") != "allowed").alias("barred"))
    # one row a hop, read by every step of the walk
    h = saved(table.join(gate, "at").select(
        "at", "next", F.when(F.col("bare"), F.lit("no_location")).when(F.col("next").isNull(), F.lit("bad_location"))
        .when(F.col("barred"), F.lit("blocked")).alias("stop")), "hops")
    starts = saved(_same_url(urls.select("start_id", F.col("url").alias("start_url")), "start_url", "first"), "starts")
    allowed = classify_destination(starts.select(F.struct("start_id", "start_url").alias("url_id"), F.coalesce("first", "start_url").alias("url")), allow)
    state = allowed.select(
        F.col("url_id.start_id").alias("start_id"), F.col("url_id.start_url").alias("start_url"), F.col("url").alias("first"),
        F.col("url").alias("cur"), F.lit(0).alias("n_hops"), F.when(F.col("status") != "allowed", F.lit("blocked")).alias("status"))
    for _ in range(max_hops):
        step = state.join(h, (F.col("cur") == F.col("at")) & F.col("status").isNull(), "left")
        go = F.col("at").isNotNull() & F.col("stop").isNull()
        state = step.select("start_id", "start_url", "first", F.when(go, F.col("next")).otherwise(F.col("cur")).alias("cur"),
                            (F.col("n_hops") + go.cast("int")).alias("n_hops"), F.coalesce("status", "stop").alias("status"))
    last = state.join(h, (F.col("cur") == F.col("at")) & F.col("status").isNull(), "left")
    off = origin_of(F.col("cur")) != origin_of(F.col("first"))
    return last.select(
        "start_id", "start_url", F.col("cur").alias("final_url"), F.col("n_hops").cast("int").alias("n_hops"),
        F.coalesce("status", "stop", F.when(F.col("at").isNotNull(), F.lit("too_many")).when(off, F.lit("off_origin")), F.lit("ok")).alias("status"))


def reserved_rule(host: Column) -> Column:
    """The rule of the reserved range that a literal IP host lies in, else null."""
    def v4_rule(n: Column) -> Column:
        rule = F.lit(None).cast("string")
        for name, first, last in reversed(RESERVED_V4):
            rule = F.when((n >= first) & (n <= last), F.lit(name)).otherwise(rule)
        return rule

    def v6_rule(groups: Column) -> Column:
        g = lambda k: F.get(groups, F.lit(k))
        mapped = F.forall(F.slice(groups, 1, 5), lambda x: x == 0) & (g(5) == 0xFFFF)
        return (F.when(mapped, _let(g(6) * 65536 + g(7), v4_rule))
                .when(F.forall(F.slice(groups, 1, 7), lambda x: x == 0) & (g(7) <= 1), F.lit("::/128, ::1/128 (unspecified/loopback)"))
                .when(F.shiftright(g(0), 9) == (0xFC00 >> 9), F.lit("fc00::/7 (unique local)"))
                .when(F.shiftright(g(0), 6) == (0xFE80 >> 6), F.lit("fe80::/10 (link-local)")))

    return F.when(host.contains(":"), _let(ipv6_groups(host), v6_rule)).when(
        host.rlike(NUMERIC_HOST), _let(ipv4_number(host), lambda n: F.when(n.isNull(), F.lit("not an address")).otherwise(v4_rule(n))))


def classify_destination(urls: DataFrame, allow: DataFrame | None = None, allow_all: bool = False) -> DataFrame:
    """Blocked scheme; literal IPv4 / IPv4-mapped / IPv6 host in a
    reserved range (with the rule's name), in any spelling a URL parser takes;
    allow-list by host, or host:port with the scheme's default port dropped.

    Ranges are a ``when`` chain in the row; only an allow-list adds a join."""
    p = url_parts(F.col("canonical"))
    d = urls.select("url_id", "url", canonical_url(F.col("url")).alias("canonical"))
    d = d.select("url_id", "url", p["scheme"].alias("scheme"), p["host"].alias("raw_host"), p["port"].alias("port"))
    d = d.select("url_id", "url", "scheme", "port", plain_host(F.col("raw_host")).alias("full_host"))
    d = d.select("url_id", "url", "scheme", F.regexp_replace("full_host", r"^\[|\]$", "").alias("host"),
                 F.concat("full_host", F.when(F.col("port") != "", F.concat(F.lit(":"), F.col("port"))).otherwise(F.lit(""))).alias("hostport"))
    allowed = F.lit(allow_all)
    if allow is not None and not allow_all:
        entries = allow.select(F.lower(F.col("entry")).alias("entry")).where("entry is not null").distinct()
        for name in ("host", "hostport"):
            d = d.join(entries.select(F.col("entry").alias(f"{name} entry")), F.col(name) == F.col(f"{name} entry"), "left")
        allowed = F.col("host entry").isNotNull() | F.col("hostport entry").isNotNull()
    rule = reserved_rule(F.col("host"))
    status = (F.when(~F.col("scheme").isin("http", "https"), F.lit("blocked_scheme"))
              .when(allowed, F.lit("allowed"))
              .when(F.col("rule").isNotNull(), F.lit("blocked_reserved"))
              .otherwise(F.lit("allowed")))
    return d.withColumn("rule", rule).select("url_id", "url", "host", status.alias("status"),
                                             F.when(status == "blocked_reserved", F.col("rule")).alias("rule"))
