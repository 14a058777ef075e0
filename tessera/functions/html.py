"""Column expressions for HTML tags and attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import WB_AFTER, WB_BEFORE, WS

# --- fixed values --------------------------------------------------------
# One open or close tag. Possessive quantifiers keep Java's regex engine from
# recursing once per attribute character (a 200,000-char attribute otherwise
# overflows the stack).
TAG_PATTERN = r"""<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>"""

# Elements with no closing tag.
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input",
             "link", "meta", "param", "source", "track", "wbr"]

# Elements that are page furniture by name alone.
CHROME_TAGS = ["script", "style", "noscript", "template", "svg",
               "nav", "header", "footer", "aside"]

# Class/id words that mark a container as page furniture (whole words only).
CHROME_WORDS = ["nav", "navbar", "navigation", "sidebar", "sidenav",
                "toc", "menu", "breadcrumb", "breadcrumbs", "header", "footer",
                "masthead", "topbar"]

# Content elements that are never furniture by class or id.
NEVER_BY_CLASS = ["article", "main", "body", "html"]

CHROME_ROLE_PATTERN = (r"(?i)" + WB_BEFORE + r"role" + WS + r"*=" + WS + r"*[\"']?"
                       r"(navigation|banner|contentinfo|search|complementary)" + WB_AFTER)
ARIA_HIDDEN_PATTERN = r"(?i)" + WB_BEFORE + r"aria-hidden" + WS + r"*=" + WS + r"*[\"']?true" + WB_AFTER
CHROME_CLASS_PATTERN = (r"(?i)" + WB_BEFORE +
                        r"(back-to-top|skip-to-content|skip-link|screen-reader[A-Za-z0-9_-]*|sr-only|visually-hidden)"
                        + WB_AFTER)
# A furniture span holding one of these is kept (main content lives there).
MAIN_CONTENT_PATTERN = r"(?i)<(main|article|h1)" + WB_AFTER
# -------------------------------------------------------------------------


def attr_value(attrs: Column, name: str) -> Column:
    """Value of the first ``name=`` in an attribute string ('' if absent).

    The name is matched after an ASCII word boundary, so ``data-name`` also
    answers for ``name``, as in the reference.
    """
    pat = (r"(?i)" + WB_BEFORE + name + WS + r"*=" + WS +
           r"""*(?:"([^"]*)"|'([^']*)'|([^\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}>]+))""")
    return F.concat(F.regexp_extract(attrs, pat, 1), F.regexp_extract(attrs, pat, 2),
                    F.regexp_extract(attrs, pat, 3))


def is_chrome_open(tag: Column, attrs: Column) -> Column:
    """Is an opening tag page furniture (navigation, scripts, footers, ...)?"""
    ident = F.concat_ws(" ", attr_value(attrs, "class"), attr_value(attrs, "id"))
    words = F.split(F.lower(ident), f"(?:{WS}|[_\\-])+", -1)
    by_attr = (attrs.rlike(CHROME_ROLE_PATTERN) | attrs.rlike(ARIA_HIDDEN_PATTERN)
               | ident.rlike(CHROME_CLASS_PATTERN)
               | F.arrays_overlap(words, F.array(*[F.lit(w) for w in CHROME_WORDS])))
    return (F.when(tag.isin(*CHROME_TAGS), F.lit(True))
            .when(tag.isin(*NEVER_BY_CLASS), F.lit(False))
            .otherwise(F.coalesce(by_attr, F.lit(False))))
