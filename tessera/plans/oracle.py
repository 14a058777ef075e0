"""DuckDB oracle SQL for the registered queries.

Each string runs on DuckDB with the test tables registered as views. The
SQL is written from the operator rules, independently of the Spark code:
RE2 regexes (leftmost-first, no possessive quantifiers), ordered
``string_agg``, window functions, and a recursive pointer chase for the
furniture spans where Spark uses a fold.
"""

from __future__ import annotations

from tessera.functions.text import NAMED_ENTITIES


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- fixed values (RE2 spellings) ------------------------------------------
WS_CHARS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = "[" + WS_CHARS + "]"
TAG = r"""<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:"[^"]*"|'[^']*'|[^>])*)>"""
ENT = r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);"
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
CHROME = ["script", "style", "noscript", "template", "svg", "nav", "header", "footer", "aside"]
NEVER = ["article", "main", "body", "html"]
WORDS = ["nav", "navbar", "navigation", "sidebar", "sidenav", "toc", "menu", "breadcrumb", "breadcrumbs",
         "header", "footer", "masthead", "topbar"]
ROLE = r"(?i)\brole" + WS + "*=" + WS + r"""*["']?(navigation|banner|contentinfo|search|complementary)\b"""
ARIA = r"(?i)\baria-hidden" + WS + "*=" + WS + r"""*["']?true\b"""
CLS = r"(?i)\b(back-to-top|skip-to-content|skip-link|screen-reader[\w-]*|sr-only|visually-hidden)\b"
MAIN = r"(?i)<(main|article|h1)\b"
# ---------------------------------------------------------------------------


def sql_list(xs: list[str]) -> str:
    return "(" + ", ".join(lit(x) for x in xs) + ")"


def attrval(attrs: str, name: str) -> str:
    pat = (r"(?i)(?:^|[^A-Za-z0-9_])" + name + WS + "*=" + WS +
           r"""*(?:"([^"]*)"|'([^']*)'|([^""" + WS_CHARS + r""">]+))""")
    return (f"(regexp_extract({attrs}, {lit(pat)}, 1) || regexp_extract({attrs}, {lit(pat)}, 2) || "
            f"regexp_extract({attrs}, {lit(pat)}, 3))")


def entity_map() -> str:
    return "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in NAMED_ENTITIES.items()) + "}"


def decode_one(w: str) -> str:
    b = f"substring({w}, 2, length({w}) - 2)"
    hexd = f"ltrim(substring({b}, 3), '0')"
    decd = f"ltrim(substring({b}, 2), '0')"

    def cp(n: str) -> str:
        return (f"(CASE WHEN {n} BETWEEN 1 AND 1114111 THEN (CASE WHEN {n} BETWEEN 55296 AND 57343 "
                f"THEN chr(65533) ELSE chr({n}::INTEGER) END) ELSE {w} END)")
    hex_val = f"(CASE WHEN length({hexd}) = 0 THEN 0 WHEN length({hexd}) <= 6 THEN ('0x' || {hexd})::BIGINT END)"
    dec_val = f"(CASE WHEN length({decd}) = 0 THEN 0 WHEN length({decd}) <= 7 THEN ({decd})::BIGINT END)"
    return (f"(CASE WHEN starts_with({b}, '#x') OR starts_with({b}, '#X') THEN coalesce({cp(hex_val)}, {w}) "
            f"WHEN starts_with({b}, '#') THEN coalesce({cp(dec_val)}, {w}) "
            f"ELSE coalesce(element_at({entity_map()}, {b})[1], {w}) END)")


def decode(x: str) -> str:
    return (f"list_transform([struct_pack(p := regexp_split_to_array({x}, {lit(ENT)}), "
            f"d := regexp_extract_all({x}, {lit(ENT)}))], lambda z: array_to_string(list_transform("
            f"range(1, len(z.p) + 1), lambda i: z.p[i] || coalesce({decode_one('z.d[i]')}, '')), ''))[1]")


def js_trim(x: str) -> str:
    return f"regexp_replace({x}, {lit('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def tags_to_text(x: str) -> str:
    s = f"regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', '', 'g'), '<[^>]+>', ' ', 'g')"
    return js_trim(f"regexp_replace({decode(s)}, {lit(WS + '{3,}')}, chr(10) || chr(10), 'g')")


def squash(x: str) -> str:
    return js_trim(f"regexp_replace({x}, {lit(WS + '+')}, ' ', 'g')")


SYNTH_HTML = f"""
synth_body AS (
  SELECT c_nationkey AS n_nationkey, floor(c_custkey / 100)::BIGINT AS blk, string_agg(
    '<h2 id="c' || c_custkey::VARCHAR || '">Customer ' || c_name || '</h2><p>Segment ' || c_mktsegment
    || '. Please log in to see more.</p><form action="/api/customer/' || c_custkey::VARCHAR
    || '" method="post"><input name="qty_' || c_custkey::VARCHAR
    || '" type="text"><input type="hidden" name="token"><input id="note_' || c_custkey::VARCHAR
    || '"><button data-href="/c/' || c_custkey::VARCHAR || '">Open ' || c_custkey::VARCHAR || '</button></form>',
    '' ORDER BY c_custkey) AS body
  FROM customer GROUP BY c_nationkey, floor(c_custkey / 100)::BIGINT),
synth AS (
  SELECT (1000000000000 + b.blk * 100 + n.n_nationkey)::BIGINT AS page_id,
    'https://n' || n.n_nationkey::VARCHAR || '.synth.example/nation/' || n.n_nationkey::VARCHAR || '/' || b.blk::VARCHAR || '.html' AS url,
    '<html><head><title>' || n.n_name || ' &amp; friends</title><script>fetch("/api/nation/' || n.n_nationkey::VARCHAR
    || '?full=1");</script></head><body><header class="site-header"><h1 id="top">Nation ' || n.n_name
    || '</h1><nav><a href="/">Home</a> <a href="#c-list">Customers</a></nav></header>'
    || '<div class="sidebar-menu"><a href="../up/">Up</a></div><main><p>Intro for ' || n.n_name
    || ' &mdash; region ' || n.n_regionkey::VARCHAR || '.</p>' || b.body
    || '<p><a href="?page=2">Next</a> <a href="other.html">Other</a> <a href="https://elsewhere.example/x">Off</a> <a href="//'
    || 'n' || n.n_nationkey::VARCHAR || '.synth.example' || '/abs/./x/../y">Abs</a> <a href="mailto:x@y">Mail</a> <a href="#c-list">Top</a></p>'
    || '<input type="search" placeholder="Search ' || n.n_name || '"></main><footer>&copy; synth</footer></body></html>' AS html
  FROM synth_body b JOIN nation n USING (n_nationkey)),
corpus AS (
  SELECT page_id, url, html FROM pages UNION ALL SELECT page_id, url, html FROM synth)"""


def _chrome_expr(tag: str, attrs: str) -> str:
    ident = f"({attrval(attrs, 'class')} || ' ' || {attrval(attrs, 'id')})"
    words = "[" + ", ".join(lit(w) for w in WORDS) + "]"
    by_attr = (f"(regexp_matches({attrs}, {lit(ROLE)}) OR regexp_matches({attrs}, {lit(ARIA)}) "
               f"OR regexp_matches({ident}, {lit(CLS)}) "
               f"OR list_has_any(string_split_regex(lower({ident}), {lit('(?:' + WS + '|[_-])+')}), {words}))")
    return (f"(CASE WHEN {tag} IN {sql_list(CHROME)} THEN true WHEN {tag} IN {sql_list(NEVER)} THEN false "
            f"ELSE {by_attr} END)")


TOKENS = f"""
tk0 AS (
  SELECT page_id, list_concat([''], regexp_extract_all(coalesce(html, ''), {lit(TAG)})) AS raws,
         regexp_split_to_array(coalesce(html, ''), {lit(TAG)}) AS segs FROM corpus),
tk AS (
  SELECT page_id, pos, raws[pos + 1] AS raw, segs[pos + 1] AS seg
  FROM (SELECT page_id, raws, segs, unnest(range(len(segs))) AS pos FROM tk0)),
tt AS (
  SELECT page_id, pos, raw, seg,
    CASE WHEN pos = 0 THEN NULL ELSE starts_with(raw, '</') END AS closing,
    CASE WHEN pos = 0 THEN NULL ELSE lower(regexp_extract(raw, {lit(TAG)}, 2)) END AS tag,
    CASE WHEN pos = 0 THEN NULL ELSE regexp_extract(raw, {lit(TAG)}, 3) END AS attrs
  FROM tk),
tt2 AS (
  SELECT *, CASE WHEN pos = 0 THEN NULL
    ELSE (tag IN {sql_list(VOID)} OR regexp_matches(attrs, {lit('/' + WS + '*$')})) END AS self_closing
  FROM tt),
tc AS (
  SELECT *, coalesce(NOT closing AND NOT self_closing AND {_chrome_expr('tag', 'attrs')}, false) AS is_chrome,
    regexp_matches(raw || seg, {lit(MAIN)})::INTEGER AS mainf
  FROM tt2)"""

STRIP = TOKENS + f""",
tw AS (
  SELECT *,
    coalesce(sum(mainf) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cme,
    sum(CASE WHEN closing THEN -1 WHEN NOT self_closing THEN 1 ELSE 0 END)
      OVER (PARTITION BY page_id, tag ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS depth
  FROM tc),
tl AS (SELECT *, CASE WHEN closing THEN depth + 1 WHEN NOT self_closing THEN depth END AS level FROM tw),
tn AS (
  SELECT *, lead(pos) OVER (PARTITION BY page_id, tag, level ORDER BY pos) AS nxt_pos,
    lead(closing) OVER (PARTITION BY page_id, tag, level ORDER BY pos) AS nxt_closing,
    lead(cme) OVER (PARTITION BY page_id, tag, level ORDER BY pos) AS nxt_cme
  FROM tl),
cand AS (
  SELECT page_id, pos AS s, CASE WHEN nxt_closing THEN nxt_pos END AS e,
    CASE WHEN nxt_closing THEN nxt_cme - cme > 0 ELSE false END AS main, tag
  FROM tn WHERE is_chrome),
nx AS (
  SELECT c.*, (SELECT min(c2.s) FROM cand c2 WHERE c2.page_id = c.page_id AND c2.s > c.e) AS nxt FROM cand c),
chain AS (
  SELECT page_id, s, e, main, tag, nxt FROM nx
  WHERE s = (SELECT min(c3.s) FROM cand c3 WHERE c3.page_id = nx.page_id)
  UNION ALL
  SELECT n.page_id, n.s, n.e, n.main, n.tag, n.nxt FROM chain ch JOIN nx n ON n.page_id = ch.page_id AND n.s = ch.nxt),
spans AS (
  SELECT page_id, s, e, tag, CASE WHEN e IS NULL THEN 'unclosed' WHEN main THEN 'kept' ELSE 'cut' END AS action
  FROM chain),
kept AS (
  SELECT t.page_id, string_agg((CASE WHEN x.s IS NOT NULL THEN '' ELSE t.raw END)
      || (CASE WHEN x.s IS NOT NULL AND t.pos < x.e THEN '' ELSE t.seg END), '' ORDER BY t.pos) AS kept_html
  FROM tk t LEFT JOIN (SELECT * FROM spans WHERE action = 'cut') x
    ON t.page_id = x.page_id AND t.pos BETWEEN x.s AND x.e
  GROUP BY t.page_id),
stripinfo AS (
  SELECT c.page_id,
    (SELECT count(*) FROM spans s WHERE s.page_id = c.page_id AND s.action = 'cut')::INTEGER AS cuts,
    (SELECT count(*) FROM spans s WHERE s.page_id = c.page_id AND s.action = 'kept')::INTEGER AS kept,
    (SELECT max(tag) FROM spans s WHERE s.page_id = c.page_id AND s.action = 'unclosed') AS unclosed
  FROM corpus c),
clean AS (
  SELECT k.page_id, k.kept_html, {tags_to_text('k.kept_html')} AS text FROM kept k)"""


def with_web(body: str, strip: bool = False) -> str:
    return "WITH RECURSIVE " + SYNTH_HTML.strip() + ("," + STRIP if strip else "") + "\n" + body


TITLE_RE = r"(?i)<title[^>]*>([^<]+)</title>"
H1_RE = r"(?i)<h1[^>]*>([^<]+)</h1>"


def title_expr(h: str) -> str:
    t = f"regexp_extract({h}, {lit(TITLE_RE)}, 1)"
    h1 = f"regexp_extract({h}, {lit(H1_RE)}, 1)"
    return f"(CASE WHEN {t} <> '' THEN {js_trim(t)} WHEN {h1} <> '' THEN {js_trim(h1)} ELSE 'Untitled' END)"


HEADING_ANY = "(?is)" + "|".join(f"<h{i}\\b[^>]*>.*?</h{i}>" for i in range(1, 7))

SECTIONS = f""",
hm AS (
  SELECT page_id, regexp_extract_all(kept_html, {lit(HEADING_ANY)}) AS ms,
         regexp_split_to_array(kept_html, {lit(HEADING_ANY)}) AS ps FROM clean),
hrows AS (
  SELECT page_id, hpos, ms[hpos + 1] AS m, ps[hpos + 2] AS p
  FROM (SELECT page_id, ms, ps, unnest(range(len(ms))) AS hpos FROM hm)),
hparsed AS (
  SELECT page_id, hpos, m, p,
    regexp_extract(m, '(?is)^<h([1-6])', 1)::INTEGER AS level,
    regexp_extract(m, '(?is)^<h[1-6]([^>]*)>', 1) AS hattrs,
    regexp_extract(m, '(?is)^<h[1-6][^>]*>(.*)</h[1-6]>$', 1) AS inner_html
  FROM hrows),
hclean AS (
  SELECT *, {squash(tags_to_text('inner_html'))} AS heading,
    coalesce(nullif({attrval('hattrs', 'id')}, ''), nullif({attrval('hattrs', 'name')}, '')) AS anchor
  FROM hparsed),
hnum AS (
  SELECT *, heading <> '' AS kept_h,
    sum(CASE WHEN heading <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY hpos
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_no
  FROM hclean),
sec0 AS (
  SELECT page_id, section_no,
    max(CASE WHEN kept_h THEN level END) AS level, max(CASE WHEN kept_h THEN heading END) AS heading,
    max(CASE WHEN kept_h THEN anchor END) AS anchor,
    string_agg(CASE WHEN kept_h THEN p ELSE m || p END, '' ORDER BY hpos) AS body_html
  FROM hnum WHERE section_no > 0 GROUP BY page_id, section_no),
sections AS (
  SELECT page_id, section_no::INTEGER AS section_no, level, heading, anchor,
    {tags_to_text('body_html')} AS text FROM sec0)"""


def address(anchor: str, heading: str) -> str:
    return f"(CASE WHEN {anchor} IS NOT NULL THEN '#' || {anchor} ELSE to_json({heading})::VARCHAR END)"


API_Q = r"""["'](/api/[a-zA-Z0-9/_-]+)["']"""
HREF = r"(?i)href" + WS + "*=" + WS + r"""*["']([^"']+)["']"""

ORACLES: dict[str, str] = {}

ORACLES["html_tokens"] = "WITH " + SYNTH_HTML.strip() + "," + TOKENS + """
SELECT page_id, count(*)::INTEGER AS n_tags, count(*) FILTER (WHERE closing)::INTEGER AS n_closing,
  count(*) FILTER (WHERE self_closing AND NOT closing)::INTEGER AS n_self_closing,
  count(DISTINCT tag)::INTEGER AS n_tag_names
FROM tc WHERE pos > 0 GROUP BY page_id"""

ORACLES["chrome_tags"] = "WITH " + SYNTH_HTML.strip() + "," + TOKENS + """
SELECT page_id, tag, count(*)::INTEGER AS n FROM tc WHERE is_chrome GROUP BY page_id, tag"""

ORACLES["chrome_strip"] = with_web("SELECT page_id, cuts, kept, unclosed FROM stripinfo", strip=True)

ORACLES["page_text"] = with_web("SELECT page_id, text FROM clean", strip=True)

ORACLES["page_title"] = with_web(f"SELECT page_id, {title_expr('html')} AS title FROM corpus")

ORACLES["page_summary"] = with_web(
    "SELECT page_id, replace(substring(text, 1, 200), chr(10), ' ') AS summary FROM clean", strip=True)

ORACLES["page_summary_300"] = with_web(
    f"SELECT page_id, replace({js_trim('substring(text, 1, 300)')}, chr(10), ' ') AS summary FROM clean", strip=True)

ORACLES["page_sections"] = "WITH RECURSIVE " + SYNTH_HTML.strip() + "," + STRIP + SECTIONS + """
SELECT page_id, section_no, level, heading, anchor, text, length(text)::INTEGER AS n_chars FROM sections"""

ORACLES["page_outline"] = "WITH RECURSIVE " + SYNTH_HTML.strip() + "," + STRIP + SECTIONS + f""",
agg AS (SELECT page_id, count(*)::INTEGER AS n_sections, sum(length(text))::BIGINT AS total_chars
        FROM sections GROUP BY page_id)
SELECT s.page_id, s.section_no, s.level, s.heading, length(s.text)::INTEGER AS n_chars,
  {address('s.anchor', 's.heading')} AS address, a.n_sections, a.total_chars, 'ok' AS status
FROM sections s JOIN agg a USING (page_id)
UNION ALL
SELECT c.page_id, NULL::INTEGER, NULL::INTEGER, NULL::VARCHAR, NULL::INTEGER, NULL::VARCHAR, 0, 0::BIGINT, 'no_headings'
FROM corpus c WHERE c.page_id NOT IN (SELECT page_id FROM sections)"""

ORACLES["fetch_section"] = "WITH RECURSIVE " + SYNTH_HTML.strip() + "," + STRIP + SECTIONS + f""",
req AS (
  SELECT page_id, lower(regexp_extract({title_expr('html')}, '^\\s*(\\S+)', 1)) AS want FROM corpus
  UNION ALL SELECT page_id, '#top' FROM corpus
  UNION ALL SELECT page_id, 'no such section' FROM corpus),
rq AS (SELECT page_id, want, lower(regexp_replace(want, '^#', '')) AS needle FROM req),
ranked AS (
  SELECT r.page_id, r.want, s.section_no, s.level, s.heading, s.text, s.anchor,
    CASE WHEN lower(s.anchor) = r.needle THEN 1 WHEN lower(s.heading) = r.needle THEN 2
         WHEN contains(lower(s.heading), r.needle) THEN 3 END AS rnk
  FROM rq r LEFT JOIN sections s ON s.page_id = r.page_id),
best AS (
  SELECT page_id, want, arg_min(struct_pack(section_no := section_no, level := level, heading := heading, text := text),
                                 rnk * 1000000 + section_no) FILTER (WHERE rnk IS NOT NULL) AS hit,
    string_agg(CASE WHEN anchor IS NOT NULL THEN '#' || anchor ELSE heading END, ', ' ORDER BY section_no) FILTER (WHERE section_no IS NOT NULL) AS available
  FROM ranked GROUP BY page_id, want)
SELECT page_id, want, CASE WHEN hit IS NOT NULL THEN 'found' ELSE 'missing' END AS status,
  hit.section_no AS section_no, hit.level AS level, hit.heading AS heading, hit.text AS text,
  CASE WHEN hit IS NULL THEN coalesce(available, '') END AS available
FROM best"""


ORACLES["api_hints_quoted"] = with_web(
    f"SELECT page_id, list_sort(list_distinct(regexp_extract_all(coalesce(html, ''), {lit(API_Q)}, 1))) AS api_hints "
    "FROM corpus")

AUTH_WORD = ("(?i)\\b(?:log" + WS + "?in|sign" + WS + "?in|sign" + WS + "?up|please authenticate"
             "|authentication required|unauthorized|access denied)\\b"
             "|\\b401\\b" + WS + "*(?:error|unauthorized|forbidden)"
             "|(?:error|status)" + WS + "*:?" + WS + "*\\b401\\b")

ORACLES["auth_word"] = with_web(
    f"SELECT page_id, coalesce(regexp_matches({tags_to_text('html')}, {lit(AUTH_WORD)}), false) AS auth_required "
    "FROM corpus")

def live(x: str) -> str:
    """No comments, empty scripts and styles."""
    no_comments = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    for t in ("script", "style"):
        no_comments = f"regexp_replace({no_comments}, '(?is)(<{t}(?:[^A-Za-z0-9>-][^>]*)?>).*?(</{t}[^>]*>)', '\\1\\2', 'g')"
    return no_comments


def spoken(x: str) -> str:
    """No comments, scripts, styles and templates."""
    for t in ("script", "style", "template"):
        x = f"regexp_replace({x}, '(?is)<{t}(?:[^A-Za-z0-9>-][^>]*)?>.*?</{t}[^>]*>', ' ', 'g')"
    return x


ORACLES["auth_substring"] = with_web(
    "SELECT page_id, coalesce(" + " OR ".join(
        f"contains(lower({tags_to_text(spoken('html'))}), {lit(s)})"
        for s in ["log in", "login", "sign in", "signin", "please authenticate", "unauthorized"])
    + ", false) AS auth_required FROM corpus")


def _scan_split(url: str) -> tuple[str, str]:
    """(site, path) of an absolute URL, RE2 spelling."""
    u = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
    scheme = f"lower(regexp_extract({url}, {lit(u)}, 1))"
    hostport = f"regexp_replace(regexp_extract({url}, {lit(u)}, 2), '^.*@', '')"
    host = f"lower(regexp_extract({hostport}, '^(\\[[^\\]]*\\]|[^:]*)', 1))"
    port0 = f"regexp_replace(regexp_extract({hostport}, '^(?:\\[[^\\]]*\\]|[^:]*):([0-9]*)$', 1), '^0+(.)', '\\1')"
    port = (f"(CASE WHEN {port0} = (CASE {scheme} WHEN 'http' THEN '80' WHEN 'https' THEN '443' ELSE '' END) "
            f"THEN '' ELSE {port0} END)")
    site = f"({scheme} || '://' || {host} || CASE WHEN {port} <> '' THEN ':' || {port} ELSE '' END)"
    p = f"regexp_extract({url}, {lit(u)}, 3)"
    path = f"(CASE WHEN {p} = '' THEN '/' ELSE {p} END)"
    return site, path


_site, _path = _scan_split("url")
ORACLES["scan_pages"] = (
    f"SELECT page_id, {_site} AS site, {_path} AS path, octet_length(encode(coalesce(html, '')))::BIGINT AS n_bytes, "
    f"CASE WHEN octet_length(encode(coalesce(html, ''))) > 5242880 THEN 'too_large' END AS reason FROM pages")


# --- links ------------------------------------------------------------------
URL_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
PATH_ENC = r"[\x00-\x20\x22\x3C\x3E\x60\x7B\x7D\x7F-\x{10FFFF}]"
QUERY_ENC = r"[\x00-\x20\x22\x23\x27\x3C\x3E\x7F-\x{10FFFF}]"
FRAG_ENC = r"[\x00-\x20\x22\x3C\x3E\x60\x7F-\x{10FFFF}]"


def pct(x: str, cls: str) -> str:
    return (f"list_transform([struct_pack(p := regexp_split_to_array({x}, {lit(cls)}), "
            f"c := regexp_extract_all({x}, {lit(cls)}))], lambda z: array_to_string(list_transform("
            f"range(1, len(z.p) + 1), lambda i: z.p[i] || coalesce(regexp_replace(hex(encode(z.c[i])), '(..)', '%\\1', 'g'), '')), ''))[1]")


def parts_cols(u: str, prefix: str) -> str:
    """SELECT-list columns: scheme, host, port (default dropped), path, query, frag of URL ``u``."""
    hostport = f"regexp_replace(regexp_extract({u}, {lit(URL_RE)}, 2), '^.*@', '')"
    scheme = f"lower(regexp_extract({u}, {lit(URL_RE)}, 1))"
    port0 = f"regexp_replace(regexp_extract({hostport}, '^(?:\\[[^\\]]*\\]|[^:]*):([0-9]*)$', 1), '^0+(.)', '\\1')"
    port = (f"(CASE WHEN {port0} = (CASE {scheme} WHEN 'http' THEN '80' WHEN 'https' THEN '443' ELSE '' END) "
            f"THEN '' ELSE {port0} END)")
    return (f"{scheme} AS {prefix}scheme, lower(regexp_extract({hostport}, '^(\\[[^\\]]*\\]|[^:]*)', 1)) AS {prefix}host, "
            f"{port} AS {prefix}port, regexp_extract({u}, {lit(URL_RE)}, 3) AS {prefix}path, "
            f"regexp_extract({u}, {lit(URL_RE)}, 4) AS {prefix}query, regexp_extract({u}, {lit(URL_RE)}, 5) AS {prefix}frag")


def origin(prefix: str) -> str:
    return (f"({prefix}scheme || '://' || {prefix}host || "
            f"CASE WHEN {prefix}port <> '' THEN ':' || {prefix}port ELSE '' END)")


def resolve_ctes(src: str, href: str, base: str, keys: str, out: str) -> str:
    """CTEs resolving column ``href`` of ``src`` against ``base``; the last
    CTE ``out`` has ``keys``, ``base``, ``target_url`` (NULL when unusable)."""
    scheme_re = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
    return f"""
{out}_a AS (
  SELECT {keys}, {base} AS base, regexp_replace({href}, '[\\t\\n\\r]', '', 'g') AS h, {parts_cols(base, 'b_')}
  FROM {src}),
{out}_b AS (
  SELECT *, regexp_matches(h, {lit(scheme_re)}) AS has_scheme,
    lower(regexp_extract(h, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) AS h_scheme,
    regexp_replace(h, {lit(scheme_re)}, '') AS rest,
    CASE WHEN b_path = '' THEN '/' ELSE b_path END AS bpath
  FROM {out}_a),
{out}_c AS (
  SELECT *, (has_scheme AND h_scheme = b_scheme AND NOT starts_with(rest, '/')) AS same_rel FROM {out}_b),
{out}_d AS (
  SELECT *, CASE WHEN same_rel THEN rest ELSE h END AS rel FROM {out}_c),
{out}_e AS (
  SELECT *, CASE
      WHEN has_scheme AND NOT same_rel THEN h_scheme || '://' || regexp_replace(rest, '^/*', '')
      WHEN starts_with(h, '//') THEN b_scheme || ':' || h
      WHEN starts_with(rel, '/') THEN {origin('b_')} || rel
      WHEN starts_with(rel, '?') THEN {origin('b_')} || bpath || rel
      WHEN starts_with(rel, '#') THEN {origin('b_')} || bpath || b_query || rel
      WHEN rel = '' THEN {origin('b_')} || bpath || b_query
      ELSE {origin('b_')} || regexp_replace(bpath, '[^/]*$', '') || regexp_extract(rel, '^([^?#]*)', 1)
           || regexp_extract(rel, '^[^?#]*(.*)$', 1) END AS full_url
  FROM {out}_d),
{out}_f AS (
  SELECT *, {parts_cols('full_url', 't_')} FROM {out}_e),
{out}_g AS (
  SELECT *, list_reduce(
      list_transform(list_zip(string_split(CASE WHEN t_path = '' THEN '/' ELSE t_path END, '/')[2:],
                              range(1, len(string_split(CASE WHEN t_path = '' THEN '/' ELSE t_path END, '/')))),
                     lambda z: struct_pack(s := z[1], last := z[2] = len(string_split(CASE WHEN t_path = '' THEN '/' ELSE t_path END, '/')) - 1)),
      lambda acc, x: CASE WHEN x.s = '..' THEN (CASE WHEN x.last THEN list_append(acc[1:len(acc) - 1], '') ELSE acc[1:len(acc) - 1] END)
                          WHEN x.s = '.' THEN (CASE WHEN x.last THEN list_append(acc, '') ELSE acc END)
                          ELSE list_append(acc, x.s) END,
      []::VARCHAR[]) AS segs
  FROM {out}_f),
{out} AS (
  SELECT {keys}, base, CASE WHEN regexp_matches(full_url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+') THEN
      t_scheme || '://' || t_host || CASE WHEN t_port <> '' THEN ':' || t_port ELSE '' END
      || {pct("'/' || array_to_string(segs, '/')", PATH_ENC)} || {pct('t_query', QUERY_ENC)} || {pct('t_frag', FRAG_ENC)}
    END AS target_url
  FROM {out}_g)"""


LINKS = f""",
hr0 AS (SELECT page_id, url, regexp_extract_all(coalesce(html, ''), {lit(HREF)}, 1) AS hs FROM corpus),
hr1 AS (SELECT page_id, url, pos, {js_trim('hs[pos + 1]')} AS raw
        FROM (SELECT page_id, url, hs, unnest(range(len(hs))) AS pos FROM hr0)),
hr2 AS (SELECT * FROM hr1 WHERE raw <> '' AND NOT regexp_matches(raw, '(?i)^(javascript|mailto|tel|data):')),
""" + resolve_ctes("hr2", "raw", "url", "page_id, pos", "res").lstrip() + f""",
res2 AS (
  SELECT r.*, {parts_cols('target_url', 'x_')}, {parts_cols('base', 'y_')} FROM res r WHERE target_url IS NOT NULL),
res3 AS (SELECT page_id, pos, base, target_url FROM res2 WHERE {origin('x_')} = {origin('y_')}),
firsts AS (SELECT page_id, target_url, min(pos) AS pos, min(base) AS base FROM res3 GROUP BY page_id, target_url),
links AS (
  SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY pos))::INTEGER AS link_no, target_url, base
  FROM firsts),
kinds0 AS (SELECT l.*, {parts_cols('target_url', 't_')}, {parts_cols('base', 'b_')} FROM links l),
kinds AS (
  SELECT page_id, link_no, target_url,
    CASE WHEN regexp_matches(t_frag, '^#.') AND t_path = (CASE WHEN b_path = '' THEN '/' ELSE b_path END)
              AND t_query = b_query THEN 'anchor' ELSE 'page' END AS kind,
    CASE WHEN regexp_matches(t_frag, '^#.') AND t_path = (CASE WHEN b_path = '' THEN '/' ELSE b_path END)
              AND t_query = b_query THEN t_frag ELSE target_url END AS value
  FROM kinds0)"""

ORACLES["page_links"] = "WITH RECURSIVE " + SYNTH_HTML.strip() + LINKS + """
SELECT page_id, link_no, target_url FROM links"""

ORACLES["link_kinds"] = "WITH RECURSIVE " + SYNTH_HTML.strip() + LINKS + """
SELECT page_id, link_no, kind, value FROM kinds"""

# --- forms and actions --------------------------------------------------------
FORM_RE = r"(?is)<form([^>]*)>(.*?)</form>"
CONTROL_RE = r"""(?i)<(input|select|textarea)\b((?:"[^"]*"|'[^']*'|[^>])*)>"""
HIDDEN_RE = r"(?i)\btype" + WS + "*=" + WS + r"""*["']?hidden\b"""

FORMS = f""",
fm0 AS (SELECT page_id, url, regexp_extract_all(coalesce(html, ''), {lit(FORM_RE)}) AS fs FROM corpus),
fm1 AS (SELECT page_id, url, form_no + 1 AS form_no, fs[form_no + 1] AS f
        FROM (SELECT page_id, url, fs, unnest(range(len(fs))) AS form_no FROM fm0)),
fm2 AS (SELECT page_id, url, form_no, regexp_extract(f, '(?is)^<form([^>]*)>', 1) AS fattrs,
          regexp_extract(f, '(?is)^<form[^>]*>(.*)</form>$', 1) AS body FROM fm1),
fm3 AS (SELECT *, list_filter(list_transform(
            list_filter(regexp_extract_all(body, {lit(CONTROL_RE)}, 2), lambda a: NOT regexp_matches(a, {lit(HIDDEN_RE)})),
            lambda a: CASE WHEN {attrval('a', 'name')} <> '' THEN {attrval('a', 'name')} ELSE {attrval('a', 'id')} END),
          lambda x: x <> '') AS names FROM fm2),
forms AS (
  SELECT page_id, form_no::INTEGER AS form_no, url AS page,
    list_filter(names, lambda x, i: list_position(names, x) = i) AS fields,
    upper(CASE WHEN regexp_extract(fattrs, '(?i)method=["'']([^"'']+)["'']', 1) <> ''
               THEN regexp_extract(fattrs, '(?i)method=["'']([^"'']+)["'']', 1) ELSE 'GET' END) AS method,
    CASE WHEN regexp_extract(fattrs, '(?i)action=["'']([^"'']+)["'']', 1) <> ''
         THEN regexp_extract(fattrs, '(?i)action=["'']([^"'']+)["'']', 1) ELSE url END AS act
  FROM fm3)"""

ORACLES["page_forms"] = "WITH RECURSIVE " + SYNTH_HTML.strip() + FORMS + """
SELECT page_id, form_no, page, fields, method, method || ' ' || act AS action FROM forms WHERE len(fields) > 0"""

PY_SPACE = r"[\t\n\x0B\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
BTN_RE = r"""(?is)<button((?:"[^"]*"|'[^']*'|[^>])*)>(.*?)</button>"""
A_RE = r"""(?is)<a((?:"[^"]*"|'[^']*'|[^>])*)>(.*?)</a>"""
INPUT_RE = r"""(?i)<input((?:"[^"]*"|'[^']*'|[^>])*)>"""


def exact_attr(a: str, name: str) -> str:
    pat = (r"(?i)(?:^|" + WS + ")" + name + WS + "*=" + WS +
           r"""*(?:"([^"]*)"|'([^']*)'|([^""" + WS_CHARS + r""">"']+))""")
    val = (f"(regexp_extract({a}, {lit(pat)}, 1) || regexp_extract({a}, {lit(pat)}, 2) || "
           f"regexp_extract({a}, {lit(pat)}, 3))")
    return f"(CASE WHEN regexp_matches({a}, {lit(pat)}) THEN {decode(val)} END)"


def strip_text(x: str) -> str:
    pieces = f"regexp_split_to_array(regexp_replace({x}, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>')"
    return (f"array_to_string(list_filter(list_transform({pieces}, lambda p: regexp_replace({decode('p')}, "
            f"{lit('^' + PY_SPACE + '+|' + PY_SPACE + '+$')}, '', 'g')), lambda p: p <> ''), '')")


ACTIONS = f""",
b0 AS (SELECT page_id, regexp_extract_all({live("coalesce(html, '')")}, {lit(BTN_RE)}) AS ms FROM corpus),
b1 AS (SELECT page_id, pos, ms[pos + 1] AS m FROM (SELECT page_id, ms, unnest(range(len(ms))) AS pos FROM b0)),
b2 AS (SELECT page_id, pos, regexp_extract(m, {lit(BTN_RE)}, 1) AS ba, {strip_text(f"regexp_extract(m, {lit(BTN_RE)}, 2)")} AS label FROM b1),
btn AS (SELECT page_id, 1 AS type_order, pos::BIGINT AS pos, 'button' AS type, label,
          CASE WHEN coalesce({exact_attr('ba', 'data-href')}, '') <> '' THEN {exact_attr('ba', 'data-href')}
               ELSE nullif({exact_attr('ba', 'formaction')}, '') END AS leads_to,
          NULL::VARCHAR AS endpoint, label AS k FROM b2),
a0 AS (SELECT page_id, regexp_extract_all({live("coalesce(html, '')")}, {lit(A_RE)}) AS ms FROM corpus),
a1 AS (SELECT page_id, pos, ms[pos + 1] AS m FROM (SELECT page_id, ms, unnest(range(len(ms))) AS pos FROM a0)),
a2 AS (SELECT page_id, pos, {exact_attr(f"regexp_extract(m, {lit(A_RE)}, 1)", 'href')} AS href,
          {strip_text(f"regexp_extract(m, {lit(A_RE)}, 2)")} AS label FROM a1),
lnk AS (SELECT page_id, 2 AS type_order, pos::BIGINT AS pos, 'link' AS type, label, href AS leads_to,
          NULL::VARCHAR AS endpoint, label || ':' || href AS k FROM a2
        WHERE href IS NOT NULL AND href <> '' AND NOT starts_with(href, 'mailto:')
          AND NOT starts_with(href, 'javascript:') AND NOT starts_with(href, '#')),
ch0 AS (SELECT page_id, regexp_split_to_array({live("coalesce(html, '')")}, {lit(FORM_RE)}) AS outs,
          regexp_extract_all({live("coalesce(html, '')")}, {lit(FORM_RE)}) AS fs FROM corpus),
ch1 AS (SELECT page_id, i, outs[i + 1] AS piece, fs[i + 1] AS f
        FROM (SELECT page_id, outs, fs, unnest(range(len(outs))) AS i FROM ch0)),
ch2 AS (SELECT page_id, i * 2 AS o, piece AS body, NULL::VARCHAR AS fattrs FROM ch1
        UNION ALL
        SELECT page_id, i * 2 + 1, regexp_extract(f, '(?is)^<form[^>]*>(.*)</form>$', 1),
               regexp_extract(f, '(?is)^<form([^>]*)>', 1) FROM ch1 WHERE f IS NOT NULL),
in0 AS (SELECT page_id, o, fattrs, regexp_extract_all(body, {lit(INPUT_RE)}, 1) AS ias FROM ch2),
in1 AS (SELECT page_id, o, fattrs, j, ias[j + 1] AS ia FROM (SELECT *, unnest(range(len(ias))) AS j FROM in0)),
in2 AS (SELECT *, {exact_attr('ia', 'type')} AS itype, {exact_attr('ia', 'placeholder')} AS ph,
          {exact_attr('ia', 'name')} AS nm, {exact_attr('ia', 'id')} AS iid FROM in1),
inp AS (SELECT page_id, 3 AS type_order, (o * 1000000 + j)::BIGINT AS pos, 'input' AS type,
          CASE WHEN coalesce(ph, '') <> '' THEN ph WHEN coalesce(nm, '') <> '' THEN nm ELSE coalesce(iid, '') END AS label,
          NULL::VARCHAR AS leads_to,
          CASE WHEN fattrs IS NOT NULL THEN coalesce({exact_attr('fattrs', 'action')}, '') || '?' || coalesce(nm, 'q') || '=' END AS endpoint,
          CASE WHEN coalesce(ph, '') <> '' THEN ph WHEN coalesce(nm, '') <> '' THEN nm ELSE coalesce(iid, '') END AS k
        FROM in2 WHERE itype IN ('search', 'text')),
allx AS (SELECT * FROM btn UNION ALL SELECT * FROM lnk UNION ALL SELECT * FROM inp),
firstx AS (SELECT * FROM allx WHERE label <> ''
           QUALIFY row_number() OVER (PARTITION BY page_id, k ORDER BY type_order, pos) = 1),
actions AS (
  SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY type_order, pos))::INTEGER AS action_no,
    type, label, leads_to, endpoint FROM firstx)"""

ORACLES["page_actions"] = "WITH RECURSIVE " + SYNTH_HTML.strip() + ACTIONS + """
SELECT * FROM actions"""

ORACLES["actions_for_path"] = "WITH RECURSIVE " + SYNTH_HTML.strip() + ACTIONS + """,
paths AS (SELECT DISTINCT leads_to AS path FROM actions WHERE type = 'button' AND leads_to IS NOT NULL)
SELECT p.path, a.page_id, a.action_no, a.type, a.label, a.leads_to
FROM actions a JOIN paths p ON a.leads_to IS NOT NULL AND contains(a.leads_to, p.path)"""

# --- API hints from scripts and attributes -------------------------------------
SCRIPT_RE = r"(?is)<script[^>]*>(.*?)</script>"
LINE_BREAKS = r"\r\n|\r|\n|\x0B|\f|\x{1C}|\x{1D}|\x{1E}|\x{85}|\x{2028}|\x{2029}"
ATTRV_RE = (r"(?:^|" + WS + r""")([^\t\n\x0B\f\r \x{A0}=>"'/]+)""" + WS + "*=" + WS +
            r"""*(?:"([^"]*)"|'([^']*)'|([^\t\n\x0B\f\r \x{A0}>"']+))""")
MARKERS = ["fetch(", "axios.", "xhr.open", '"/api/', "'/api/"]


def _parts_starting_api(lines: str, q: str) -> str:
    return (f"flatten(list_transform({lines}, lambda x: list_filter(string_split(x, {lit(q)}), "
            f"lambda p: starts_with(p, '/api/'))))")


ORACLES["api_hints_script"] = "WITH RECURSIVE " + SYNTH_HTML.strip() + f""",
sc0 AS (SELECT page_id, coalesce(html, '') AS html,
  list_filter(list_transform(flatten(list_transform(regexp_extract_all(coalesce(html, ''), {lit(SCRIPT_RE)}, 1),
      lambda b: regexp_split_to_array(b, {lit(LINE_BREAKS)}))),
      lambda x: regexp_replace(x, '^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g')),
    lambda x: {" OR ".join(f"contains(x, {lit(m)})" for m in MARKERS)}) AS lines
  FROM corpus),
sc1 AS (SELECT page_id, html, list_transform(list_concat({_parts_starting_api('lines', '"')}, {_parts_starting_api('lines', "'")}),
    lambda p: split_part(split_part(p, '?', 1), ' ', 1)) AS from_scripts FROM sc0),
at0 AS (SELECT page_id, html, from_scripts, regexp_extract_all({live('html')}, {lit(TAG)}, 3) AS attrs FROM sc1),
at1 AS (SELECT page_id, from_scripts,
    flatten(list_transform(attrs, lambda a: regexp_extract_all(a, {lit(ATTRV_RE)}, 1))) AS ns,
    flatten(list_transform(attrs, lambda a: list_transform(range(1, len(regexp_extract_all(a, {lit(ATTRV_RE)}, 0)) + 1),
      lambda i: coalesce(regexp_extract_all(a, {lit(ATTRV_RE)}, 2)[i], '') || coalesce(regexp_extract_all(a, {lit(ATTRV_RE)}, 3)[i], '')
                || coalesce(regexp_extract_all(a, {lit(ATTRV_RE)}, 4)[i], '')))) AS vs
  FROM at0),
at2 AS (SELECT page_id, from_scripts,
    list_transform(list_filter(range(1, len(ns) + 1), lambda i: lower(ns[i]) <> 'class' AND starts_with(vs[i], '/api/')),
                   lambda i: split_part(vs[i], '?', 1)) AS from_attrs FROM at1)
SELECT page_id, list_sort(list_distinct(list_concat(from_scripts, from_attrs))) AS api_hints FROM at2"""


# --- search, budget, site outline, lookups ------------------------------------
def _quote_re2(q: str) -> str:
    return "".join("\\" + ch if ch in r".*+?^${}()|[]\/-" else ch for ch in q)


SEARCH_Q = "the"
SEARCH_RE = "(?i)" + _quote_re2(SEARCH_Q)

ORACLES["page_search"] = "WITH RECURSIVE " + SYNTH_HTML.strip() + "," + STRIP + f""",
su0 AS (
  SELECT page_id, text, list_filter(flatten(list_transform(regexp_split_to_array(text, '\\n{{2,}}'),
      lambda b: string_split(regexp_replace(b, {lit('([.!?])' + WS + '+')}, '\\1' || chr(1), 'g'), chr(1)))),
    lambda u: {js_trim('u')} <> '') AS units
  FROM clean),
su1 AS (
  SELECT page_id, text, units,
    list_filter(range(1, len(units) + 1), lambda i: regexp_matches(units[i], {lit(SEARCH_RE)})) AS hits FROM su0),
su2 AS (
  SELECT page_id, text, list_transform(hits, lambda i: array_to_string(units[greatest(1, i - 1):least(len(units), i + 1)], ' ')) AS raw_blocks
  FROM su1),
su3 AS (
  SELECT page_id, text, len(list_filter(raw_blocks, lambda b: length(b) > 800))::INTEGER AS trimmed,
    list_transform(raw_blocks, lambda b: CASE WHEN length(b) > 800 THEN
      substring(b, greatest(0, strpos(lower(b), {lit(SEARCH_Q.lower())}) - 1 - 400) + 1, 800) || ' [800 characters kept]'
      ELSE b END) AS blocks0
  FROM su2),
su4 AS (
  SELECT page_id, text, trimmed, list_filter(blocks0, lambda x, i: list_position(blocks0, x) = i) AS blocks FROM su3)
SELECT page_id, (block_no + 1)::INTEGER AS block_no, blocks[block_no + 1] AS block, len(blocks)::INTEGER AS n_blocks,
  len(regexp_extract_all(text, {lit(SEARCH_RE)}))::INTEGER AS occurrences, length(text)::INTEGER AS n_chars, trimmed
FROM (SELECT *, unnest(range(len(blocks))) AS block_no FROM su4)"""


def _note(shown: str, bl: str) -> str:
    return f"(chr(10) || chr(10) || '[' || ({shown})::VARCHAR || ' of ' || ({bl})::VARCHAR || ' characters fit the budget]')"


ORACLES["text_budget"] = "WITH RECURSIVE " + SYNTH_HTML.strip() + "," + STRIP + f""",
hd AS (
  SELECT c.page_id, c.text, 'URL: ' || p.url || chr(10) || 'TITLE: ' || {title_expr('p.html')} || chr(10)
    || CASE WHEN si.unclosed IS NOT NULL THEN 'NOTE: <' || si.unclosed
       || '> has no end tag, so its text is kept below.' || chr(10) ELSE '' END
    || chr(10) AS header
  FROM clean c JOIN corpus p USING (page_id) JOIN stripinfo si USING (page_id)),
b0 AS (SELECT *, length(header) AS hl, length(text) AS bl FROM hd),
-- the largest count that fits with its notice, found by trying all
b4 AS (SELECT *, coalesce(list_max(list_filter(range(0, 1201), lambda k: hl + k + length({_note('k', 'bl')}) <= 1200)), 0) AS k4 FROM b0),
outb AS (SELECT page_id, CASE WHEN hl + bl <= 1200 THEN header || text
                      ELSE header || substring(text, 1, k4) || {_note('k4', 'bl')} END AS body FROM b4)
SELECT page_id, body, length(body)::INTEGER AS n_chars FROM outb"""

ORACLES["site_outline"] = "WITH RECURSIVE " + SYNTH_HTML.strip() + LINKS + FORMS + f""",
lk AS (SELECT page_id, count(*) FILTER (WHERE kind = 'page')::INTEGER AS n_pages,
         count(*) FILTER (WHERE kind = 'anchor')::INTEGER AS n_anchors FROM kinds GROUP BY page_id),
fmc AS (SELECT page_id, count(*)::INTEGER AS n_forms FROM forms WHERE len(fields) > 0 GROUP BY page_id)
SELECT c.page_id, {title_expr('c.html')} AS title,
  coalesce(regexp_matches({tags_to_text('c.html')}, {lit(AUTH_WORD)}), false) AS auth_required,
  coalesce(lk.n_pages, 0) AS n_pages, coalesce(lk.n_anchors, 0) AS n_anchors, coalesce(fmc.n_forms, 0) AS n_forms,
  len(list_distinct(regexp_extract_all(coalesce(c.html, ''), {lit(API_Q)}, 1)))::INTEGER AS n_api_hints
FROM corpus c LEFT JOIN lk USING (page_id) LEFT JOIN fmc USING (page_id)"""

_csite, _cpath = _scan_split("p.url")
ORACLES["get_page"] = "WITH RECURSIVE " + SYNTH_HTML.strip() + "," + STRIP + f""",
sp AS (SELECT p.page_id, {_csite} AS site, {_cpath} AS path, {title_expr('p.html')} AS title,
         replace(substring(c.text, 1, 200), chr(10), ' ') AS summary
       FROM corpus p JOIN clean c USING (page_id)),
one AS (SELECT site, path, arg_min(title, page_id) AS title, arg_min(summary, page_id) AS summary FROM sp GROUP BY site, path),
req AS (SELECT DISTINCT site, path FROM (SELECT site, path FROM sp UNION ALL SELECT site, '/no/such/page' FROM sp))
SELECT r.site, r.path, o.title, o.summary FROM req r LEFT JOIN one o USING (site, path)"""


# --- files ------------------------------------------------------------------------
def nl() -> str:
    return "chr(10)"


SYNTH_FILES = f"""
py_m AS (
  SELECT l_orderkey, string_agg('    def line_' || l_linenumber::VARCHAR || '(self, part=' || l_partkey::VARCHAR || '):'
      || chr(10) || '        return part * ' || l_linenumber::VARCHAR || chr(10) || chr(10), '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS methods
  FROM lineitem GROUP BY l_orderkey),
py AS (
  SELECT (1000000000000 + o.o_orderkey)::BIGINT AS file_id, 'synth/py/order_' || o.o_orderkey::VARCHAR || '.py' AS path,
    'import os' || chr(10) || chr(10) || chr(10) || 'class Order' || o.o_orderkey::VARCHAR || ':' || chr(10)
    || '    ' || repeat('"', 3) || 'Order ' || o.o_orderkey::VARCHAR || ' of customer ' || o.o_custkey::VARCHAR || '.' || chr(10) || chr(10)
    || '    def fake_' || o.o_orderkey::VARCHAR || '(self):' || chr(10) || '        return None' || chr(10)
    || '    ' || repeat('"', 3) || chr(10) || chr(10) || coalesce(m.methods, '')
    || CASE WHEN o.o_orderkey % 3 = 0 THEN 'def total_' || o.o_orderkey::VARCHAR || '(): return '
       || o.o_orderkey::VARCHAR || chr(10) ELSE '' END AS text
  FROM orders o LEFT JOIN py_m m ON m.l_orderkey = o.o_orderkey),
ts_m AS (
  SELECT l_orderkey, string_agg('  line' || l_linenumber::VARCHAR || '(part: number): number {{' || chr(10)
      || '    return part * ' || l_linenumber::VARCHAR || ';' || chr(10) || '  }}' || chr(10), '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS methods
  FROM lineitem GROUP BY l_orderkey),
ts AS (
  SELECT (2000000000000 + o.o_orderkey)::BIGINT AS file_id, 'synth/ts/order_' || o.o_orderkey::VARCHAR || '.ts' AS path,
    'export class Order' || o.o_orderkey::VARCHAR || ' {{' || chr(10) || coalesce(m.methods, '') || '}}' || chr(10) || chr(10)
    || 'export const total' || o.o_orderkey::VARCHAR || ' = (x: number) => x * ' || o.o_orderkey::VARCHAR || ';' || chr(10) AS text
  FROM orders o LEFT JOIN ts_m m ON m.l_orderkey = o.o_orderkey),
md_b AS (
  SELECT c_nationkey, floor(c_custkey / 100)::BIGINT AS blk, string_agg('## Customer ' || c_custkey::VARCHAR || chr(10) || '```' || chr(10)
      || '# not a heading ' || c_custkey::VARCHAR || chr(10) || '```' || chr(10), '' ORDER BY c_custkey) AS body
  FROM customer GROUP BY c_nationkey, floor(c_custkey / 100)::BIGINT),
md AS (
  SELECT (3000000000000 + b.blk * 100 + n.n_nationkey)::BIGINT AS file_id,
    'synth/md/nation_' || n.n_nationkey::VARCHAR || '_' || b.blk::VARCHAR || '.md' AS path,
    '# Nation ' || n.n_name || chr(10) || chr(10) || b.body AS text
  FROM md_b b JOIN nation n ON b.c_nationkey = n.n_nationkey),
fcorpus AS (
  SELECT doc_id AS file_id, source || '/doc_' || doc_id::VARCHAR || '.txt' AS path, text FROM documents
  UNION ALL SELECT * FROM py UNION ALL SELECT * FROM ts UNION ALL SELECT * FROM md),
fsplit AS (SELECT file_id, path, regexp_split_to_array(coalesce(text, ''), '\\r?\\n') AS arr FROM fcorpus),
files AS (
  SELECT file_id, path, regexp_extract(path, '([^/]*)$', 1) AS name,
    CASE WHEN arr[len(arr)] = '' THEN arr[1:len(arr) - 1] ELSE arr END AS lines
  FROM fsplit),
files2 AS (
  SELECT *, len(lines)::INTEGER AS total_lines,
    CASE lower(regexp_extract(name, '^.+(\\.[^.]*)$', 1))
      {" ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in __import__('tessera.operators.lines', fromlist=['x']).LANGUAGE_BY_EXTENSION.items())}
      ELSE 'text' END AS language
  FROM files),
flines AS (
  SELECT file_id, (i + 1)::INTEGER AS line_no, lines[i + 1] AS line
  FROM (SELECT file_id, lines, unnest(range(len(lines))) AS i FROM files2))"""


def with_files(body: str) -> str:
    return "WITH " + SYNTH_FILES.strip() + "\n" + body


ORACLES["file_lines"] = with_files("SELECT file_id, line_no, line FROM flines")
ORACLES["file_language"] = with_files("SELECT file_id, name, language, total_lines FROM files2")
ORACLES["admit_text"] = with_files(
    "SELECT file_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, "
    "CASE WHEN octet_length(encode(coalesce(text, ''))) > 33554432 THEN 'too_large' "
    "WHEN contains(substring(coalesce(text, ''), 1, 8192), chr(0)) AND NOT starts_with(coalesce(text, ''), chr(65279)) "
    "THEN 'binary' ELSE 'ok' END AS status FROM fcorpus")
ORACLES["confine_paths"] = with_files(
    "SELECT file_id, path FROM files2 WHERE " + " OR ".join(
        f"path = {lit(r)} OR starts_with(path, {lit(r + '/')})" for r in ["src1", "synth/md"]))

_SRCH = "(?i)the"
_SRX = "(?i)ti[oó]n[.,]"
ORACLES["search_lines"] = with_files(f"SELECT file_id, line_no, line FROM flines WHERE regexp_matches(line, {lit(_SRCH)})")
ORACLES["search_regex"] = with_files(f"SELECT file_id, line_no, line FROM flines WHERE regexp_matches(line, {lit(_SRX)})")

_HITS = f""",
hits AS (
  SELECT file_id, line_no, line,
    (row_number() OVER (PARTITION BY file_id ORDER BY line_no))::INTEGER AS rank,
    (count(*) OVER (PARTITION BY file_id))::INTEGER AS occurrences
  FROM flines WHERE regexp_matches(line, {lit(_SRCH)}))"""

# context from a frame of eleven line rows, so that no hit carries its whole file
ORACLES["search_context"] = with_files(f"""
, framed AS (
  SELECT file_id, line_no, line,
    list(line) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS before,
    list(line) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS after
  FROM flines)
SELECT file_id, line_no, coalesce(before, []) AS before, coalesce(after, []) AS after FROM framed WHERE regexp_matches(line, {lit(_SRCH)})""")
ORACLES["search_top"] = with_files(_HITS + "\nSELECT file_id, rank, line_no, occurrences FROM hits WHERE rank <= 20")


# only long lines are trimmed, each once; hits meet the lines around them by number
ORACLES["trim_match"] = with_files(_HITS + """,
long0 AS (SELECT file_id, line_no, line, strpos(lower(line), 'the') AS hit_at FROM flines WHERE length(line) > 800),
long AS (
  SELECT file_id, line_no, hit_at, substring(line, greatest(0, greatest(hit_at - 1, 0) - 400) + 1, 800) || '  [800 of ' || length(line)::VARCHAR
    || ' characters kept' || CASE WHEN hit_at = 0 THEN '' ELSE '; the match starts at ' || hit_at::VARCHAR END || ']' AS cut
  FROM long0),
around AS (SELECT file_id, line_no AS hit_line_no, line_no + unnest(range(-5, 6)) AS line_no FROM hits WHERE rank <= 20)
SELECT file_id, hit_line_no, line_no::INTEGER AS line_no, coalesce(cut, line) AS text, length(line) > 800 AS trimmed,
  length(line)::INTEGER AS n_chars, nullif(hit_at, 0)::INTEGER AS match_col
FROM around JOIN flines USING (file_id, line_no) LEFT JOIN long USING (file_id, line_no)""")
ORACLES["trimmed_per_file"] = "SELECT file_id, count(*) FILTER (WHERE trimmed)::INTEGER AS n_trimmed FROM (" + ORACLES["trim_match"] + ") GROUP BY file_id"

ORACLES["read_chunk"] = with_files("""
, req AS (
  SELECT file_id, 2 AS start, 4 AS "end" FROM files2
  UNION ALL SELECT file_id, total_lines - 1, total_lines + 5 FROM files2
  UNION ALL SELECT file_id, 100000, 100010 FROM files2),
cl AS (
  SELECT r.file_id, r.start, r."end", f.total_lines, f.lines, greatest(1, r.start) AS s, least(f.total_lines, r."end") AS e
  FROM req r JOIN files2 f USING (file_id))
SELECT file_id, start, "end", total_lines, CASE WHEN e >= s THEN 'ok' ELSE 'empty' END AS status,
  CASE WHEN e >= s THEN array_to_string(list_transform(range(s, e + 1), lambda n: format('{:5d}', n) || ' │ ' || lines[n]), chr(10)) END AS text
FROM cl""")


# --- outline (expected rows from the base tables) ------------------------------------
TRUTH = """
jl AS (SELECT l_orderkey, l_linenumber,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS j FROM lineitem),
om AS (SELECT o.o_orderkey, coalesce(c.cnt, 0) AS m FROM orders o
       LEFT JOIN (SELECT l_orderkey, count(*) AS cnt FROM lineitem GROUP BY l_orderkey) c ON c.l_orderkey = o.o_orderkey),
cj AS (SELECT c_nationkey, c_custkey, floor(c_custkey / 100)::BIGINT AS blk,
         row_number() OVER (PARTITION BY c_nationkey, floor(c_custkey / 100)::BIGINT ORDER BY c_custkey) AS j FROM customer),
truth AS (
  SELECT (1000000000000 + o_orderkey)::BIGINT AS file_id, 'Python' AS language, 'class' AS kind, 'Order' || o_orderkey::VARCHAR AS name,
    4 AS start_line, CASE WHEN m > 0 THEN 12 + 3 * (m - 1) ELSE 9 END AS end_line, 1 AS depth, NULL::INTEGER AS parent_start FROM om
  UNION ALL
  SELECT 1000000000000 + l_orderkey, 'Python', 'def', 'line_' || l_linenumber::VARCHAR, 11 + 3 * (j - 1), 12 + 3 * (j - 1), 2, 4 FROM jl
  UNION ALL
  SELECT 1000000000000 + o_orderkey, 'Python', 'def', 'total_' || o_orderkey::VARCHAR, 11 + 3 * m, 11 + 3 * m, 1, NULL FROM om
  WHERE o_orderkey % 3 = 0
  UNION ALL
  SELECT 2000000000000 + o_orderkey, 'TypeScript', 'class', 'Order' || o_orderkey::VARCHAR, 1, 2 + 3 * m, 1, NULL FROM om
  UNION ALL
  SELECT 2000000000000 + l_orderkey, 'TypeScript', 'method', 'line' || l_linenumber::VARCHAR, 2 + 3 * (j - 1), 4 + 3 * (j - 1), 2, 1 FROM jl
  UNION ALL
  SELECT 2000000000000 + o_orderkey, 'TypeScript', 'arrow fn', 'total' || o_orderkey::VARCHAR, 4 + 3 * m, 4 + 3 * m, 1, NULL FROM om
  UNION ALL
  SELECT DISTINCT 3000000000000 + cj.blk * 100 + cj.c_nationkey, 'Markdown', 'h1', 'Nation ' || n.n_name, 1, NULL::INTEGER, 1, NULL::INTEGER
  FROM cj JOIN nation n ON n.n_nationkey = cj.c_nationkey
  UNION ALL
  SELECT 3000000000000 + blk * 100 + c_nationkey, 'Markdown', 'h2', 'Customer ' || c_custkey::VARCHAR, 3 + 4 * (j - 1), NULL, 1, NULL FROM cj),
truth2 AS (
  SELECT file_id::BIGINT AS file_id, language, kind, name, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line,
    depth::INTEGER AS depth, parent_start::INTEGER AS parent_start FROM truth)"""


def with_truth(body: str, files: bool = False) -> str:
    return "WITH " + (SYNTH_FILES.strip() + "," if files else "") + TRUTH.strip() + "\n" + body


ORACLES["python_symbols"] = with_truth(
    "SELECT file_id, kind, name, start_line, end_line FROM truth2 WHERE language = 'Python'")
ORACLES["js_symbols"] = with_truth(
    "SELECT file_id, kind, name, start_line, end_line FROM truth2 WHERE language = 'TypeScript'")
ORACLES["markdown_headings"] = with_truth(
    "SELECT file_id, kind, name, start_line, end_line FROM truth2 WHERE language = 'Markdown'")
ORACLES["docstring_mask"] = (
    "SELECT (1000000000000 + o_orderkey)::BIGINT AS file_id, unnest([6, 7, 8, 9])::INTEGER AS line_no FROM orders")
ORACLES["nest_symbols"] = with_truth(
    "SELECT file_id, kind, name, start_line, end_line, depth, parent_start FROM truth2")
ORACLES["nest_symbol_rows"] = ORACLES["nest_symbols"]
ORACLES["outline_listing"] = with_truth("""
, ranked AS (SELECT *, (row_number() OVER (PARTITION BY file_id ORDER BY start_line))::INTEGER AS row_no,
               (count(*) OVER (PARTITION BY file_id))::INTEGER AS total FROM truth2),
page AS (SELECT *, count(*) OVER (PARTITION BY file_id) AS shown FROM ranked WHERE row_no > 1 AND row_no <= 4)
SELECT file_id, row_no, kind, name, start_line, end_line, depth, total,
  CASE WHEN 1 + shown < total THEN (1 + shown)::INTEGER END AS next_offset FROM page""")
ORACLES["outline_depth"] = with_truth("""
, tot AS (SELECT file_id, count(*)::INTEGER AS total FROM truth2 GROUP BY file_id),
kids AS (SELECT file_id, parent_start, count(*)::INTEGER AS n FROM truth2 WHERE parent_start IS NOT NULL
         GROUP BY file_id, parent_start),
vis AS (SELECT t.*, (row_number() OVER (PARTITION BY t.file_id ORDER BY t.start_line))::INTEGER AS row_no,
          count(*) OVER (PARTITION BY t.file_id) AS n_vis
        FROM truth2 t WHERE t.depth <= 1)
SELECT v.file_id, v.row_no, v.kind, v.name, v.start_line, v.end_line, k.n AS hidden_members, tot.total,
  CASE WHEN least(v.n_vis, 200) < v.n_vis THEN 200 END::INTEGER AS next_offset
FROM vis v JOIN tot USING (file_id) LEFT JOIN kids k ON k.file_id = v.file_id AND k.parent_start = v.start_line
WHERE v.row_no <= 200""")

ORACLES["fetch_symbol"] = with_truth("""
, fl AS (SELECT file_id, lines FROM files2),
firstln AS (SELECT l_orderkey, arg_min(l_linenumber, (l_linenumber, l_partkey, l_suppkey)) AS ln FROM lineitem GROUP BY l_orderkey),
req AS (
  SELECT 1000000000000 + o_orderkey AS file_id, 'Order' || o_orderkey::VARCHAR AS target FROM orders
  UNION ALL SELECT 1000000000000 + l_orderkey, 'LINE_' || ln::VARCHAR FROM firstln
  UNION ALL SELECT 1000000000000 + o_orderkey, 'fake_' || o_orderkey::VARCHAR FROM orders
  UNION ALL SELECT 1000000000000 + o_orderkey, 'nothing_' || o_orderkey::VARCHAR FROM orders
  UNION ALL SELECT file_id, 'the' FROM files2
  UNION ALL SELECT DISTINCT file_id, name FROM truth2 WHERE language = 'Markdown'),
m AS (
  SELECT r.file_id, r.target, t.kind, t.name, t.start_line, t.end_line FROM req r
  LEFT JOIN truth2 t ON t.file_id = r.file_id AND lower(t.name) = lower(r.target) AND t.depth <= 2),
g AS (
  SELECT file_id, target, count(start_line)::INTEGER AS n_matches, min(start_line) AS s, min(end_line) AS e,
    min(kind) AS kind, min(name) AS name,
    list(kind || ' ' || name || '  lines ' || start_line::VARCHAR || coalesce('–' || end_line::VARCHAR, '') ORDER BY start_line)
      FILTER (WHERE start_line IS NOT NULL) AS cands
  FROM m GROUP BY file_id, target)
, h AS (
  SELECT g.*, fl.lines, n_matches = 1 AND e IS NOT NULL AS one,
    CASE WHEN n_matches = 0 OR n_matches = 1 AND e IS NULL
         THEN list_filter(range(1, len(fl.lines) + 1), lambda i: contains(lower(fl.lines[i]), lower(g.target))) END AS hits
  FROM g JOIN fl USING (file_id))
SELECT file_id::BIGINT AS file_id, target,
  CASE WHEN n_matches > 1 THEN 'ambiguous' WHEN one THEN 'symbol' WHEN len(hits) > 0 THEN 'text' ELSE 'none' END AS status, n_matches,
  CASE WHEN one THEN kind END AS kind, CASE WHEN one THEN name END AS name,
  CASE WHEN one THEN s END::INTEGER AS start_line, CASE WHEN one THEN e END::INTEGER AS end_line,
  CASE WHEN one THEN array_to_string(list_transform(range(s, least(e, s + 249) + 1),
       lambda n: format('{:5d}', n) || ' │ ' || lines[n]), chr(10)) END AS body,
  CASE WHEN one AND e > s + 249 THEN s + 250 END::INTEGER AS continue_at,
  CASE WHEN n_matches > 1 THEN cands[1:20] END AS candidates,
  len(hits)::INTEGER AS occurrences, hits[1:5]::INTEGER[] AS hit_lines,
  list_transform(hits[1:5], lambda i: array_to_string(list_transform(range(greatest(1, i - 10), least(len(lines), i + 10) + 1),
       lambda n: format('{:5d}', n) || ' │ ' || lines[n]), chr(10))) AS hit_context
FROM h""", files=True)

ORACLES["outline_accuracy"] = with_truth("""
SELECT language, count(*)::INTEGER AS n_truth, count(*)::INTEGER AS n_found, count(*)::INTEGER AS n_exact,
  1.0::DOUBLE AS accuracy, true AS passed FROM truth2 WHERE language <> 'Markdown' GROUP BY language""")

ORACLES["file_summary"] = with_truth("""
, sc AS (SELECT file_id, count(*)::INTEGER AS n FROM truth2 GROUP BY file_id)
SELECT f.file_id, f.name, f.language, f.total_lines, coalesce(sc.n, 0)::INTEGER AS n_symbols,
  array_to_string(list_transform(range(1, least(40, f.total_lines) + 1), lambda n: format('{:5d}', n) || ' │ ' || f.lines[n]), chr(10)) AS head,
  CASE WHEN greatest(40, f.total_lines - 20) < f.total_lines THEN
    array_to_string(list_transform(range(greatest(40, f.total_lines - 20) + 1, f.total_lines + 1),
      lambda n: format('{:5d}', n) || ' │ ' || f.lines[n]), chr(10)) END AS tail
FROM files2 f LEFT JOIN sc USING (file_id)""", files=True)

ORACLES["file_notes"] = with_truth("""
, sc AS (SELECT file_id, count(*)::INTEGER AS n FROM truth2 GROUP BY file_id),
fn AS (SELECT f.file_id, f.language, f.language IN ('Python', 'JavaScript', 'TypeScript', 'Markdown') AS scanned, coalesce(sc.n, 0)::INTEGER AS n_symbols
       FROM files2 f LEFT JOIN sc USING (file_id))
SELECT file_id, language, scanned, n_symbols,
  CASE WHEN scanned OR n_symbols > 0 THEN NULL WHEN language = 'text' THEN 'unrecognised' ELSE 'unscanned' END AS note FROM fn""", files=True)

ORACLES["language_coverage"] = with_truth("""
, sc AS (SELECT file_id, count(*)::INTEGER AS n FROM truth2 GROUP BY file_id),
fx AS (SELECT f.language, coalesce(sc.n, 0) AS n_sym,
         f.language IN ('Python', 'JavaScript', 'TypeScript', 'Markdown') AS scanned FROM files2 f LEFT JOIN sc USING (file_id)),
fy AS (SELECT *, CASE WHEN scanned OR n_sym > 0 THEN NULL WHEN language = 'text' THEN 'unrecognised' ELSE 'unscanned' END AS note FROM fx)
SELECT language, count(*)::INTEGER AS n_files, count(*) FILTER (WHERE scanned)::INTEGER AS n_scanned,
  sum(n_sym)::BIGINT AS n_symbols, count(note)::INTEGER AS n_noted, max(note) AS note
FROM fy GROUP BY language""", files=True)


# --- redirects and destinations ----------------------------------------------------
ORACLES["resolve_redirects"] = """
WITH RECURSIVE c AS (
  SELECT c_custkey AS k, floor((c_custkey - 1) / 8)::BIGINT AS g, ((c_custkey - 1) % 8)::INTEGER AS p FROM customer),
starts AS (SELECT k AS start_id, 'https://r' || g::VARCHAR || '.redir.example/c/' || k::VARCHAR AS url FROM c),
hops AS (
  SELECT 'https://r' || g::VARCHAR || '.redir.example/c/' || k::VARCHAR AS url,
    CASE WHEN p < 7 THEN '/c/' || (k + 1)::VARCHAR
         WHEN g % 3 = 0 THEN 'https://elsewhere.example/x/' || k::VARCHAR END AS location
  FROM c),
walk AS (
  SELECT start_id, url AS start_url, url AS cur, 0 AS n FROM starts
  UNION ALL
  SELECT w.start_id, w.start_url,
    CASE WHEN starts_with(h.location, '/') THEN regexp_extract(w.cur, '^([a-z]+://[^/]+)', 1) || h.location ELSE h.location END,
    w.n + 1
  FROM walk w JOIN hops h ON h.url = w.cur AND h.location IS NOT NULL WHERE w.n < 5),
fin AS (SELECT start_id, arg_max(start_url, n) AS start_url, arg_max(cur, n) AS cur, max(n) AS n FROM walk GROUP BY start_id)
SELECT f.start_id, f.start_url, f.cur AS final_url, f.n::INTEGER AS n_hops,
  CASE WHEN EXISTS (SELECT 1 FROM hops h WHERE h.url = f.cur AND h.location IS NOT NULL) THEN 'too_many'
       WHEN regexp_extract(f.cur, '^([a-z]+://[^/]+)', 1) <> regexp_extract(f.start_url, '^([a-z]+://[^/]+)', 1) THEN 'off_origin'
       ELSE 'ok' END AS status
FROM fin f"""

ORACLES["classify_destination"] = """
WITH c AS (
  SELECT c_custkey AS k, ((c_custkey * 37) % 256)::BIGINT AS o1, ((c_custkey * 11) % 256)::BIGINT AS o2,
    (c_custkey % 256)::BIGINT AS o3, ((c_custkey * 7) % 256)::BIGINT AS o4 FROM customer),
u AS (
  SELECT k AS url_id, o1, o2, o3, o4,
    o1::VARCHAR || '.' || o2::VARCHAR || '.' || o3::VARCHAR || '.' || o4::VARCHAR AS quad,
    CASE WHEN k % 7 = 0 THEN 'ftp' ELSE 'http' END AS scheme,
    CASE WHEN k % 17 = 0 THEN 'name' WHEN k % 13 = 0 THEN 'v6' WHEN k % 11 = 0 THEN 'mapped' WHEN k % 19 = 0 THEN 'spelled' ELSE 'v4' END AS form,
    CASE WHEN k % 23 = 0 THEN ':/' WHEN k % 29 = 0 THEN ':' || chr(92) || chr(92) ELSE '://' END AS slashes,
    CASE WHEN k % 5 = 0 THEN ':8080' ELSE '' END AS port
  FROM c),
u2 AS (
  SELECT *, CASE form WHEN 'name' THEN 'host' || url_id::VARCHAR || '.example' WHEN 'v6' THEN '[fe80::1]'
                      WHEN 'mapped' THEN '[::ffff:' || quad || ']'
                      WHEN 'spelled' THEN CASE url_id % 6 WHEN 0 THEN v4num::VARCHAR WHEN 1 THEN '0x' || printf('%x', v4num)
                        WHEN 2 THEN quad || '.' WHEN 3 THEN o1::VARCHAR || '.' || (o2 * 65536 + o3 * 256 + o4)::VARCHAR
                        WHEN 4 THEN replace(quad, '.', '%2E')
                        ELSE '[0:0:0:0:0:ffff:' || printf('%x', o1 * 256 + o2) || ':' || printf('%x', o3 * 256 + o4) || ']' END
                      ELSE quad END AS h,
    -- the host as it must be read: the address itself, except for the IPv6 spelling
    CASE WHEN form = 'spelled' AND url_id % 6 < 5 THEN quad END AS read
  FROM (SELECT *, o1 * 16777216 + o2 * 65536 + o3 * 256 + o4 AS v4num FROM u)),
allow AS (
  SELECT DISTINCT lower(u2.h || u2.port) AS entry FROM u2 JOIN customer cu ON cu.c_custkey = u2.url_id
  WHERE cu.c_mktsegment = 'BUILDING'),
u3 AS (
  SELECT *, scheme || slashes || h || port || '/p' AS url, coalesce(read, lower(regexp_replace(h, '^\\[|\\]$', '', 'g'))) AS host
  FROM u2),
u4 AS (
  SELECT *,
    (host IN (SELECT lower(entry) FROM allow) OR (coalesce(read, lower(h)) || port) IN (SELECT lower(entry) FROM allow)) AS allowed,
    CASE WHEN form IN ('v4', 'mapped', 'spelled') THEN
      CASE WHEN o1 = 0 THEN '0.0.0.0/8 (this network)' WHEN o1 = 10 THEN '10.0.0.0/8 (private)'
           WHEN o1 = 127 THEN '127.0.0.0/8 (loopback)'
           WHEN o1 = 169 AND o2 = 254 THEN '169.254.0.0/16 (link-local — cloud instance metadata)'
           WHEN o1 = 172 AND o2 BETWEEN 16 AND 31 THEN '172.16.0.0/12 (private)'
           WHEN o1 = 192 AND o2 = 168 THEN '192.168.0.0/16 (private)'
           WHEN o1 = 100 AND o2 BETWEEN 64 AND 127 THEN '100.64.0.0/10 (carrier NAT)'
           WHEN o1 >= 224 THEN '224.0.0.0/4+ (multicast/reserved)' END
    WHEN form = 'v6' THEN 'fe80::/10 (link-local)' END AS r
  FROM u3)
SELECT url_id, url, host,
  CASE WHEN scheme NOT IN ('http', 'https') THEN 'blocked_scheme' WHEN allowed THEN 'allowed'
       WHEN r IS NOT NULL THEN 'blocked_reserved' ELSE 'allowed' END AS status,
  CASE WHEN scheme IN ('http', 'https') AND NOT allowed AND r IS NOT NULL THEN r END AS rule
FROM u4"""


# --- snapshot crawl (levels unrolled up to the page budget) ---------------------------
CRAWL_BUDGET = 10

SYNTH_LINK_PAGES = """
slinks AS (
  SELECT (2000000000000 + c_custkey)::BIGINT AS page_id,
    'https://s' || c_nationkey::VARCHAR || '-' || floor(c_custkey / 100)::BIGINT::VARCHAR || '.links.example/c/' || i::VARCHAR AS url,
    '<html><head><title>C' || i::VARCHAR || ' ' || c_name || '</title></head><body><p>Customer ' || c_name
    || '</p><a href="/c/' || (2 * i)::VARCHAR || '">left</a> <a href="/c/' || (2 * i + 1)::VARCHAR
    || '">right</a> <a href="/gone/' || i::VARCHAR || '">gone</a> <a href="/c/' || (2 * i)::VARCHAR || '">again</a></body></html>' AS html
  FROM (SELECT c_custkey, c_name, c_nationkey,
          row_number() OVER (PARTITION BY c_nationkey, floor(c_custkey / 100)::BIGINT ORDER BY c_custkey) AS i FROM customer)),
corpus AS (
  SELECT page_id, url, html FROM pages UNION ALL SELECT page_id, url, html FROM synth
  UNION ALL SELECT page_id, url, html FROM slinks)"""


def _crawl_ctes(budget: int = CRAWL_BUDGET) -> str:
    """The walk's queue as ``allq``."""
    synth = SYNTH_HTML.strip()
    synth = synth[:synth.index("corpus AS (")].rstrip().rstrip(",")
    page_site, page_path = _scan_split("target_url")
    parts = [
        "WITH RECURSIVE " + synth + "," + SYNTH_LINK_PAGES + LINKS,
        resolve_ctes("corpus", "url", "url", "page_id", "pn").rstrip(),
        f"""snap AS (
  SELECT site, path, min(page_id) AS page_id FROM (
    SELECT page_id, {page_site} AS site, {page_path} AS path FROM pn) GROUP BY site, path),
edges AS (SELECT page_id, link_no, {page_path} AS target_path FROM links),
q0 AS (SELECT site, arg_min(path, page_id) AS path, 1::BIGINT AS rank, 0 AS level FROM snap GROUP BY site),
-- the linked sites' redirects, from the base rows: two of three missing paths lead on
rd AS (
  SELECT regexp_extract(url, '^(.*)/c/', 1) AS site, '/gone/' || i::VARCHAR AS path,
    CASE WHEN i % 3 = 0 THEN regexp_extract(url, '^(.*)/c/', 1) ELSE 'https://elsewhere.example' END AS fsite,
    CASE WHEN i % 3 = 0 THEN '/c/' || (4 * i)::VARCHAR ELSE '/g/' || i::VARCHAR END AS fpath
  FROM (SELECT url, regexp_extract(url, '/c/([0-9]+)$', 1)::BIGINT AS i FROM corpus WHERE regexp_matches(url, '\\.links\\.example/c/[0-9]+$')) WHERE i % 3 < 2)""",
    ]
    body = []
    for lv in range(1, budget + 1):
        seen = " UNION ALL ".join(f"SELECT site, path, rank FROM q{k}" for k in range(lv))
        body.append(f"""seen{lv} AS ({seen}),
new{lv} AS (
  SELECT q.site, e.target_path AS path, q.rank AS parent_rank, e.link_no
  FROM (SELECT x.site, x.path, x.rank, s.page_id, row_number() OVER (PARTITION BY x.site, s.page_id ORDER BY x.rank) AS nth
        FROM seen{lv} x LEFT JOIN rd ON rd.site = x.site AND rd.path = x.path
        JOIN snap s ON s.site = x.site AND s.path = coalesce(rd.fpath, x.path)
        WHERE x.rank <= {budget} AND coalesce(rd.fsite, x.site) = x.site) m
  JOIN q{lv - 1} q ON q.site = m.site AND q.path = m.path JOIN edges e ON e.page_id = m.page_id
  WHERE m.nth = 1),
first{lv} AS (
  SELECT site, path, parent_rank, link_no FROM new{lv} n
  WHERE NOT EXISTS (SELECT 1 FROM seen{lv} x WHERE x.site = n.site AND x.path = n.path)
  QUALIFY row_number() OVER (PARTITION BY site, path ORDER BY parent_rank, link_no) = 1),
q{lv} AS (
  SELECT f.site, f.path,
    CASE WHEN f.rn <= {budget} AND t.top + f.rn <= {budget} THEN t.top + f.rn END::BIGINT AS rank, {lv} AS level
  FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY parent_rank, link_no) AS rn FROM first{lv}) f
  JOIN (SELECT site, max(rank) AS top FROM seen{lv} GROUP BY site) t USING (site))""")
    allq = " UNION ALL ".join(f"SELECT site, path, rank, level FROM q{k}" for k in range(budget + 1))
    tail = f"""allq AS (
  SELECT x.*, coalesce(rd.fsite, x.site) AS fsite, coalesce(rd.fpath, x.path) AS fpath, s.page_id AS pid,
    row_number() OVER (PARTITION BY x.site, coalesce(rd.fsite, x.site), coalesce(rd.fpath, x.path) ORDER BY x.rank NULLS LAST) AS nth
  FROM ({allq}) x LEFT JOIN rd ON rd.site = x.site AND rd.path = x.path
  LEFT JOIN snap s ON s.site = x.site AND s.path = coalesce(rd.fpath, x.path) AND coalesce(rd.fsite, x.site) = x.site)"""
    return parts[0] + ",\n" + parts[1] + ",\n" + parts[2] + ",\n" + ",\n".join(body) + ",\n" + tail


_WALK = f"""SELECT a.site, a.path, a.rank, a.level::INTEGER AS level,
  CASE WHEN a.rank IS NULL OR a.rank > {CRAWL_BUDGET} THEN 'unvisited' WHEN fsite <> site THEN 'off_origin' WHEN pid IS NULL THEN 'missing'
       WHEN nth = 1 THEN 'mapped' ELSE 'duplicate' END AS outcome,
  CASE WHEN a.rank <= {CRAWL_BUDGET} AND nth = 1 THEN pid END AS page_id"""
ORACLES["crawl_walk"] = _crawl_ctes() + "\n" + _WALK + "\nFROM allq a"


def _json_fields(**fields: str) -> str:
    """A JSON object; fields that are null are left out."""
    return "'{' || concat_ws(',', " + ", ".join(f"""'"{k}":' || {v}""" for k, v in fields.items()) + ") || '}'"


def _text(x: str) -> str:
    return f"to_json({x})::VARCHAR"


def _json_list(items: str) -> str:
    return f"'[' || coalesce({items}, '') || ']'"


def _agg(item: str, order: str, where: str) -> str:
    return f"string_agg({item}, ',' ORDER BY {order}) FILTER (WHERE {where})"


# what is known of each mapped page, and one JSON text a site
_auth = " OR ".join(f"contains(lower({tags_to_text(spoken('html'))}), {lit(w)})" for w in ["log in", "login", "sign in", "signin", "please authenticate", "unauthorized"])
_SITE_FACTS = f""",
walk AS ({_WALK}, a.fsite, a.fpath FROM allq a),
stored AS (SELECT page_id, url, coalesce(html, '') AS html FROM corpus),
facts AS (
  WITH RECURSIVE corpus AS (SELECT page_id, url, html FROM stored WHERE page_id IN (SELECT page_id FROM walk WHERE outcome = 'mapped')),
  {STRIP}{FORMS}{ACTIONS},
  pf AS (SELECT page_id, string_agg({_json_fields(page=_text("page"), fields=_text("fields"), action=_text("method || ' ' || act"), method=_text("method"))}, ',' ORDER BY form_no) AS forms
         FROM forms WHERE len(fields) > 0 GROUP BY page_id),
  pa AS (SELECT page_id, string_agg({_json_fields(type=_text("type"), label=_text("label"), leads_to=_text("leads_to"), endpoint=_text("endpoint"))}, ',' ORDER BY action_no) AS actions
         FROM actions GROUP BY page_id)
  SELECT page_id, {title_expr("html")} AS title, replace(substring(text, 1, 200), chr(10), ' ') AS summary, text AS content,
    regexp_extract_all(html, {lit(API_Q)}, 1) AS hints, ({_auth}) AS auth, forms, actions
  FROM corpus JOIN clean USING (page_id) LEFT JOIN pf USING (page_id) LEFT JOIN pa USING (page_id))"""
_mapped = "outcome = 'mapped'"
_page = _json_fields(path=_text("fpath"), title=_text("title"), summary=_text("summary"), content=_text("content"))
_gone = _json_fields(url=_text("site || path"), error="'\"not in the snapshot\"'")
_count = lambda where: f"(count(*) FILTER (WHERE {where}))::VARCHAR"
ORACLES["site_map_json"] = _crawl_ctes() + _SITE_FACTS + f"""
SELECT site, {_json_fields(
    site=_text("site"), url=_text("max(site || path) FILTER (WHERE rank = 1)"), pages_scanned=_count(_mapped), pages_attempted=_count("outcome <> 'unvisited'"),
    pages_failed=_count("outcome = 'missing'"), links_queued_unvisited=_count("outcome = 'unvisited'"), pages=_json_list(_agg(_page, "rank", _mapped)),
    failures=_json_list(_agg(_gone, "rank, path", "outcome = 'missing'")),
    off_origin_redirects_skipped=_json_list(_agg(_text("site || path || ' -> ' || fsite || fpath"), "rank, path", "outcome = 'off_origin'")),
    forms=_json_list(_agg("forms", "rank", _mapped)), actions=_json_list(_agg("actions", "rank", _mapped)),
    api_hints=_text(f"list_sort(list_distinct(coalesce(flatten(list(hints) FILTER (WHERE {_mapped})), [])))"), auth_required=f"coalesce(bool_or(auth) FILTER (WHERE {_mapped}), false)::VARCHAR",
    budget_exhausted=f"(count(*) FILTER (WHERE outcome <> 'unvisited') >= {CRAWL_BUDGET} AND count(*) FILTER (WHERE outcome = 'unvisited') > 0)::VARCHAR")} AS json
FROM walk LEFT JOIN facts USING (page_id) GROUP BY site"""
