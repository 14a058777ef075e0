"""Interactive elements: forms (O37), clickable actions (O38) and actions
leading to a path (O50).

Forms and actions are found with regexes on each page's own row (narrow, no
shuffle). Actions are then deduplicated per page with a window on the small
action rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.html import attr_value
from tessera.functions.text import WB_AFTER, WB_BEFORE, WS, cut_tail, decode_entities, live_html, mark_unclosed, unmark

# --- fixed values --------------------------------------------------------
ATTRS = r"""((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)"""
FORM_PATTERN = r"(?is)<form([^>]*)>(.*?)</form>"
CONTROL_PATTERN = r"(?i)<(input|select|textarea)" + WB_AFTER + ATTRS + ">"
HIDDEN_PATTERN = r"(?i)" + WB_BEFORE + r"type" + WS + r"*=" + WS + r"*[\"']?hidden" + WB_AFTER
FORM_ACTION_PATTERN = r"""(?i)action=["']([^"']+)["']"""
FORM_METHOD_PATTERN = r"""(?i)method=["']([^"']+)["']"""
BUTTON_PATTERN = r"(?is)<button(?![A-Za-z0-9_-])" + ATTRS + r">(.*?)</button>"
LINK_PATTERN = r"(?is)<a(?![A-Za-z0-9_-])" + ATTRS + r">(.*?)</a>"
INPUT_PATTERN = r"(?i)<input(?![A-Za-z0-9_-])" + ATTRS + ">"
PY_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1C-\x1F]"
# -------------------------------------------------------------------------


#: Openings and closings that are paired.
FORMS = [("form", "</form>")]
BUTTONS = [("button(?![A-Za-z0-9_-])", "</button>")]
LINKS = [("a(?![A-Za-z0-9_-])", "</a>")]


def forms_array(html: Column) -> Column:
    """Per page, the forms that have fields: array of (form_no, fields,
    method, act) with act '' when the form names no action."""
    def form(f: Column, i: Column) -> Column:
        attrs = F.regexp_extract(f, FORM_PATTERN, 1)
        body = F.regexp_extract(f, FORM_PATTERN, 2)
        controls = F.regexp_extract_all(body, F.lit(CONTROL_PATTERN), 2)
        names = F.transform(F.filter(controls, lambda a: ~a.rlike(HIDDEN_PATTERN)),
                            lambda a: F.when(attr_value(a, "name") != "", attr_value(a, "name"))
                            .otherwise(attr_value(a, "id")))
        declared = F.regexp_extract(attrs, FORM_METHOD_PATTERN, 1)
        method = F.upper(F.when(declared != "", declared).otherwise(F.lit("GET")))
        action = F.regexp_extract(attrs, FORM_ACTION_PATTERN, 1)
        return F.struct((i + 1).alias("form_no"), F.array_distinct(F.filter(names, lambda x: x != "")).alias("fields"),
                        method.alias("method"), action.alias("act"))
    found = F.regexp_extract_all(mark_unclosed(html, FORMS), F.lit(FORM_PATTERN), 0)
    return F.filter(F.transform(found, lambda f, i: form(unmark(f), i)), lambda x: F.size(x["fields"]) > 0)


def extract_forms(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per closed form, the non-hidden controls' ``name`` (else ``id``),
    distinct in order; method upper-cased (default GET); action defaults to
    the page URL; forms without fields are dropped.

    Forms are built as an array per page and filtered inside the array, so
    the field lists are computed once (no filter on a computed column)."""
    html = F.coalesce(F.col(html_col), F.lit(""))

    out = pages.select("page_id", F.col(url_col).alias("page"), F.explode(forms_array(html)).alias("f"))
    action = F.when(F.col("f.act") != "", F.col("f.act")).otherwise(F.col("page"))
    return out.select("page_id", F.col("f.form_no").cast("int").alias("form_no"), "page",
                      F.col("f.fields").alias("fields"), F.col("f.method").alias("method"),
                      F.concat(F.col("f.method"), F.lit(" "), action).alias("action"))


def _exact_attr(attrs: Column, name: str) -> Column:
    """Attribute by exact name (a parser's view: ``data-href`` is not ``href``)."""
    pat = (r"(?i)(?:^|" + WS + r")" + name + WS + r"*=" + WS +
           r"""*(?:"([^"]*)"|'([^']*)'|([^\t\n\x0B\f\r \x{A0}>"']+))""")
    present = attrs.rlike(pat)
    val = F.concat(F.regexp_extract(attrs, pat, 1), F.regexp_extract(attrs, pat, 2), F.regexp_extract(attrs, pat, 3))
    return F.when(present, decode_entities(val))


def _strip_text(inner: Column) -> Column:
    """Text of an element, each text piece stripped, pieces joined with ''."""
    pieces = F.split(inner, r"<[^>]*>", -1)  # comments are gone before
    stripped = F.transform(pieces, lambda p: F.regexp_replace(decode_entities(p), f"^{PY_SPACE}+|{PY_SPACE}+$", ""))
    return F.array_join(F.filter(stripped, lambda p: p != ""), "")


def extract_actions(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Buttons (label; data-href else formaction), links (label, href;
    not mailto:/javascript:/#), and text/search inputs (placeholder, name or
    id; endpoint ``action?name=`` inside a form). The first action per key
    wins, keys are shared across types (buttons and inputs by label, links by
    ``label:href``), in type order then document order.

    Candidates are built and filtered as arrays in each page's row (so labels
    are computed once), then exploded and deduplicated with a window keyed by
    page_id."""
    pages = pages.select("page_id", live_html(F.coalesce(F.col(html_col), F.lit(""))).alias("live"))
    html = F.col("live")

    def button(m: Column, i: Column) -> Column:
        attrs = F.regexp_extract(m, BUTTON_PATTERN, 1)
        dh = _exact_attr(attrs, "data-href")
        leads = F.when(F.coalesce(dh, F.lit("")) != "", dh).otherwise(F.nullif(_exact_attr(attrs, "formaction"), F.lit("")))
        return F.struct(i.cast("long").alias("pos"), _strip_text(F.regexp_extract(m, BUTTON_PATTERN, 2)).alias("label"),
                        leads.alias("leads_to"))

    def link(m: Column, i: Column) -> Column:
        return F.struct(i.cast("long").alias("pos"), _strip_text(F.regexp_extract(m, LINK_PATTERN, 2)).alias("label"),
                        _exact_attr(F.regexp_extract(m, LINK_PATTERN, 1), "href").alias("leads_to"))

    btns = F.filter(F.transform(F.regexp_extract_all(mark_unclosed(html, BUTTONS), F.lit(BUTTON_PATTERN), 0), lambda m, i: button(unmark(m), i)), lambda x: x["label"] != "")
    lnks = F.filter(F.transform(F.regexp_extract_all(mark_unclosed(html, LINKS), F.lit(LINK_PATTERN), 0), lambda m, i: link(unmark(m), i)),
                    lambda x: (x["label"] != "") & x["leads_to"].isNotNull() & (x["leads_to"] != "")
                    & ~x["leads_to"].startswith("mailto:") & ~x["leads_to"].startswith("javascript:")
                    & ~x["leads_to"].startswith("#"))
    b = pages.select("page_id", F.explode(btns).alias("x")).select(
        "page_id", F.lit(1).alias("type_order"), F.struct(F.col("x.pos").alias("o"), F.lit(0).cast("long").alias("j")).alias("pos"), F.lit("button").alias("type"),
        F.col("x.label").alias("label"), F.col("x.leads_to").alias("leads_to"),
        F.lit(None).cast("string").alias("endpoint"), F.col("x.label").alias("key"))
    a = pages.select("page_id", F.explode(lnks).alias("x")).select(
        "page_id", F.lit(2).alias("type_order"), F.struct(F.col("x.pos").alias("o"), F.lit(0).cast("long").alias("j")).alias("pos"), F.lit("link").alias("type"),
        F.col("x.label").alias("label"), F.col("x.leads_to").alias("leads_to"),
        F.lit(None).cast("string").alias("endpoint"), F.concat(F.col("x.label"), F.lit(":"), F.col("x.leads_to")).alias("key"))
    # Inputs: pieces outside forms and form bodies alternate in document order.
    pages = pages.select("page_id", mark_unclosed(html, FORMS).alias("formed"))
    outside = F.transform(F.split("formed", FORM_PATTERN, -1), unmark)
    forms = F.transform(F.regexp_extract_all("formed", F.lit(FORM_PATTERN), 0), unmark)
    # zip_with pads the shorter side with nulls: piece i is followed by form i.
    pairs = F.zip_with(outside, forms, lambda piece, f: F.struct(piece.alias("piece"), f.alias("f")))
    chunks = F.flatten(F.transform(pairs, lambda x, i: F.array(
        F.struct((i * 2).alias("o"), x["piece"].alias("body"), F.lit(None).cast("string").alias("form_attrs")),
        F.struct((i * 2 + 1).alias("o"), F.regexp_extract(x["f"], FORM_PATTERN, 2).alias("body"),
                 F.when(x["f"].isNotNull(), F.regexp_extract(x["f"], FORM_PATTERN, 1)).alias("form_attrs")))))
    chunks = F.filter(chunks, lambda x: x["body"].isNotNull() & ((x["o"] % 2 == 0) | x["form_attrs"].isNotNull()))
    c = pages.select("page_id", F.explode(chunks).alias("c"))

    def text_input(ia: Column, j: Column) -> Column:
        ph, nm, iid = _exact_attr(ia, "placeholder"), _exact_attr(ia, "name"), _exact_attr(ia, "id")
        label = (F.when(F.coalesce(ph, F.lit("")) != "", ph).when(F.coalesce(nm, F.lit("")) != "", nm)
                 .otherwise(F.coalesce(iid, F.lit(""))))
        return F.struct(j.alias("j"), _exact_attr(ia, "type").alias("type"), nm.alias("nm"), label.alias("label"))
    ins = F.filter(F.transform(cut_tail(F.col("c.body"), lambda head, _: F.regexp_extract_all(head, F.lit(INPUT_PATTERN), 1)), text_input),
                   lambda x: x["type"].isin("search", "text") & (x["label"] != ""))
    c = c.select("page_id", F.col("c.o").alias("o"), F.col("c.form_attrs").alias("form_attrs"), F.explode(ins).alias("x"))
    faction = F.coalesce(_exact_attr(F.col("form_attrs"), "action"), F.lit(""))
    endpoint = F.when(F.col("form_attrs").isNotNull(),
                      F.concat(faction, F.lit("?"), F.coalesce(F.col("x.nm"), F.lit("q")), F.lit("=")))
    inputs = c.select(
        "page_id", F.lit(3).alias("type_order"), F.struct(F.col("o").cast("long").alias("o"), F.col("x.j").cast("long").alias("j")).alias("pos"),
        F.lit("input").alias("type"), F.col("x.label").alias("label"), F.lit(None).cast("string").alias("leads_to"),
        endpoint.alias("endpoint"), F.col("x.label").alias("key"))
    allx = b.unionByName(a).unionByName(inputs)
    first = allx.withColumn("rn", F.row_number().over(
        Window.partitionBy("page_id", "key").orderBy("type_order", "pos"))).where("rn = 1")
    return first.select("page_id", F.row_number().over(
        Window.partitionBy("page_id").orderBy("type_order", "pos")).cast("int").alias("action_no"),
        "type", "label", "leads_to", "endpoint")


#: Characters of a path's end that key the join of actions and paths.
PATH_GRAM = 6


def actions_for_path(actions: DataFrame, paths: DataFrame) -> DataFrame:
    """Actions whose non-null ``leads_to`` contains the requested path.

    A path is keyed by its last PATH_GRAM characters (by itself when it is
    shorter); an action emits the distinct stretches of that length and of
    each shorter one, and the equal keys are checked with ``contains``. Every
    (action row, path row) pair meets at most once, so repeated rows stay
    repeated, and the empty path is in every target.
    """
    t = F.col("leads_to")
    lengths = F.sequence(F.lit(1), F.least(F.lit(PATH_GRAM), F.length(t)))
    grams = F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, n))))
    grams = F.when(F.length(t) > 0, F.array_distinct(F.concat(F.array(F.lit("")), grams))).otherwise(F.array(F.lit("")))
    keyed = actions.where(t.isNotNull()).select("*", F.explode(grams).alias("path gram"))
    wanted = paths.select("*", F.when(F.length("path") > PATH_GRAM, F.right(F.col("path"), F.lit(PATH_GRAM))).otherwise(F.col("path")).alias("path key"))
    return keyed.join(wanted, (F.col("path gram") == F.col("path key")) & t.contains(F.col("path"))).drop("path gram", "path key")
