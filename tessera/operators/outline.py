"""Outline operators: symbols of Python (O15), JavaScript/TypeScript
and Markdown (O17) files, docstring mask (O18), block ends (O19, O20),
nesting (O21), listing (O22), depth cut (O23), symbol fetch (O24) and
accuracy against a truth table (O25).

Plan shape. No file's text is exchanged. In an Arrow task one lexing regex per file
rewrites comments and strings into a "clean" text with the same line breaks, and
a small fold (``functions.blocks``) passes over a file's lines
once with a stack of the blocks that are still open. The work is linear in lines,
plus events times nesting depth. Nesting, likewise, folds a file's symbols in line
order over the stack of symbols that may still cover the next one. A task's rows are
the symbols themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import blocks
from tessera.functions.blocks import TYPES, brace_blocks, compiled, indent_blocks, js_token, lexer, nested, python_token, symbol_rows
from tessera.functions.folds import fold_chunks, none_of
from tessera.functions.text import WS, WS_CHARS, js_trim, let
from tessera.operators.lines import numbered
from tessera.sources.files import split_lines

cloudpickle.register_pickle_by_value(blocks)  # executors need not have this package

# --- fixed values --------------------------------------------------------
W = "[A-Za-z0-9_]"
PY_LEX = (r"""(?=["'#])(?:#[^\n]*+"""
          r'|"""(?s:.*?)(?:"""|\z)'
          r"|'''(?s:.*?)(?:'''|\z)"
          r'|"(?:[^"\\\n]++|\\.)*+"?'
          r"|'(?:[^'\\\n]++|\\.)*+'?)")
JS_LEX = (r"""(?=[/"'`])(?://[^\n]*+"""
          r"|/\*(?s:.*?)(?:\*/|\z)"
          r'|"(?:[^"\\\n]++|\\.)*+"?'
          r"|'(?:[^'\\\n]++|\\.)*+'?"
          r"|`(?:[^`\\\n]++|\\.)*+`?)")
PY_CLASS = r"^(" + WS + r"*)class" + WS + r"+(" + W + r"+)"
PY_DEF = r"^(" + WS + r"*)(?:async" + WS + r"+)?def" + WS + r"+(" + W + r"+)"
# JavaScript / TypeScript line patterns, tried in this order; first wins.
JS_PATTERNS = [
    (r"^(?:export" + WS + r"+)?(?:async" + WS + r"+)?function" + WS + r"*\*?" + WS + r"*(" + W + r"+)", "function"),
    (r"^(?:export" + WS + r"+)?(?:default" + WS + r"+)?(?:abstract" + WS + r"+)?class" + WS + r"+(" + W + r"+)", "class"),
    (r"^" + WS + r"*(?:export" + WS + r"+)?(?:const|let|var)" + WS + r"+(" + W + r"+)" + WS + r"*(?::[^=]+)?="
     + WS + r"*(?:async" + WS + r"+)?(?:<[^>]*>" + WS + r"*)?(?:\([^)]*\)|" + W + r"+)" + WS + r"*(?::[^=>]+)?=>",
     "arrow fn"),
    (r"^" + WS + r"+(?:static" + WS + r"+)?(?:async" + WS + r"+)?(?!(?:if|for|while|switch|catch|do|return|typeof|await|new|function)(?!"
     + W + r"))(" + W + r"+)" + WS + r"*\((?![^)]*(?<!" + W + r")function(?!" + W + r"))[^)]*\)" + WS + r"*(?::[^{;]+)?"
     + WS + r"*\{", "method"),
    (r"^" + WS + r"+(?:static" + WS + r"+)?(?:get|set)" + WS + r"+(" + W + r"+)" + WS + r"*\([^)]*\)" + WS
     + r"*(?::[^{;]+)?" + WS + r"*\{", "accessor"),
    (r"^" + WS + r"*(?:export" + WS + r"+)?(?:const|let|var)" + WS + r"+(" + W + r"+)" + WS + r"*(?::[^=]+)?="
     + WS + r"*(?:async" + WS + r"+)?(?:<[^>]*>" + WS + r"*)?\(" + WS + r"*$", "arrow fn"),
]
JS_LOOKAHEAD = 20
MD_FENCE = r"^" + WS + r"{0,3}(`{3,}|~{3,})"
MD_HEADING = r"^(#{1,3})" + WS + r"+(.+)"
MASK_OPEN = "\u0001"
MASK_CLOSE = "\u0002"
SHOW_CANDIDATES = 20
FOLD_ROWS = 1024
# -------------------------------------------------------------------------

def _rows(files: DataFrame, symbols: str) -> DataFrame:
    """One row a symbol. (``explode`` would have Spark infer a filter that folds
    every file a second time.)"""
    s = files.select("file_id", F.explode_outer(symbols).alias("s")).where("s is not null")
    return s.select("file_id", "s.kind", "s.name", "s.start_line", "s.end_line")


SYMBOL = "struct<kind:string,name:string,start_line:int,end_line:int>"


def _symbol(kind: Column, name: Column, start: Column, end: Column) -> Column:
    return F.struct(kind.alias("kind"), name.alias("name"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"))


def _clean_text(text: Column, lex: str, rewrite) -> Column:
    """Text with every lexed token rewritten (line breaks kept). A token begins with one of a
    few characters; most of a text is passed by with one look at each."""
    gaps = F.split(text, lex, -1)
    toks = F.regexp_extract_all(text, F.lit(lex), 0)
    new = F.concat(F.transform(toks, rewrite), F.array(F.lit("")))
    return F.when(text.rlike(lex[:lex.index(")") + 1]), F.array_join(F.zip_with(gaps, new, lambda g, t: F.concat(g, t)), "")).otherwise(text)


def _balance(t: Column, opening: str, closing: str) -> Column:
    """Opening minus closing characters of a line (all ASCII, so bytes count them)."""
    def left(chars: str) -> Column:
        out = t
        for c in chars:
            out = F.replace(out, F.lit(c), F.lit(""))
        return F.octet_length(out)
    return left(closing) - left(opening)


def _ltrim(t: Column) -> Column:
    """Without the whitespace in front (plain spaces, the usual indent, in one go)."""
    return F.ltrim(F.ltrim(t), F.lit(WS_CHARS))


def _rtrim(t: Column) -> Column:
    return F.rtrim(F.rtrim(t), F.lit(WS_CHARS))


def _newlines(t: Column) -> Column:
    return F.when(t.contains("\n"), F.regexp_replace(t, r"[^\n]+", "")).otherwise(F.lit(""))


def _py_rewrite(t: Column) -> Column:
    nl = _newlines(t)
    triple = t.startswith('"""') | t.startswith("'''")
    return (F.when(t.startswith("#"), F.lit(""))
            .when(triple & (F.length(nl) > 0),
                  F.concat(F.lit(MASK_OPEN), F.length(nl).cast("string"), F.lit(MASK_CLOSE), nl))
            .otherwise(F.concat(F.lit('"'), nl)))


def _js_rewrite(t: Column) -> Column:
    nl = _newlines(t)
    return (F.when(t.startswith("//"), F.lit(""))
            .when(t.startswith("/*"), nl)
            .otherwise(F.substring(t, 1, 1)))


def _lines(files: DataFrame, lex: str, rewrite) -> DataFrame:
    """(file_id, total_lines, lines): each line as (i, raw, clean), i from 1."""
    text = F.coalesce(F.col("text"), F.lit(""))
    f = files.select("file_id", split_lines(text).alias("raw"), F.split(_clean_text(text, lex, rewrite), "\n", -1).alias("clean"))
    line = lambda x, i: F.struct((i + 1).alias("i"), x["raw"].alias("raw"), x["clean"].alias("clean"))
    zipped = F.arrays_zip("raw", F.slice("clean", F.lit(1), F.size("raw")).alias("clean"))
    return f.select("file_id", F.size("raw").cast("int").alias("total_lines"), F.transform(zipped, line).alias("lines"))


def _schema(files: DataFrame, width: int) -> str:
    """Of ``symbol_rows``."""
    fields = [f"{n} {'string' if t == pa.string() else 'int'}" for n, t in TYPES.items()]
    return ", ".join([f"file_id {files.schema['file_id'].dataType.simpleString()}", *fields[:width]])


def _folded(files: DataFrame, blocks_of: Callable[[str], list[tuple]], nest: bool = False) -> DataFrame:
    """One row a symbol that ``blocks_of`` finds in a file's text; with ``nest`` in line order, with depth and parent."""
    width = 6 if nest else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FOLD_ROWS):
                b = batch.slice(at, FOLD_ROWS)
                found = [blocks_of(t) for t in b.column(1).to_pylist()]
                if nest:
                    found = [nested(sorted(f, key=lambda s: (s[2], s[3], s[0], s[1]))) for f in found]
                yield symbol_rows(b.column(0), found, width)
    text = F.make_valid_utf8(F.coalesce(F.col("text"), F.lit("")))
    return files.select("file_id", text.alias("text")).mapInArrow(run, _schema(files, width))


# ----------------------------------------------------------------- Python

def _python_facts(files: DataFrame) -> DataFrame:
    """(file_id, total_lines, facts): what the fold needs of each line."""
    def fact(x: Column) -> Column:
        raw, clean = x["raw"], x["clean"]
        span = F.when(clean.contains(MASK_OPEN), F.regexp_extract(clean, "^.*" + MASK_OPEN + r"(\d+)" + MASK_CLOSE, 1))
        cls = F.when(raw.contains("class"), F.regexp_extract(raw, PY_CLASS, 2))
        dfn = F.when(raw.contains("def"), F.regexp_extract(raw, PY_DEF, 2))
        body = _ltrim(raw)
        return F.struct(
            x["i"].alias("i"), F.coalesce(x["i"] + F.nullif(span, F.lit("")).cast("int"), F.lit(0)).alias("mask_end"), _balance(clean, "([{", ")]}").alias("delta"),
            clean.contains(":").alias("colon"), (clean.contains(":") & (_ltrim(F.substring_index(clean, ":", -1)) != "")).alias("after_colon"),
            (F.length(raw) - F.length(body)).alias("indent"), ((body != "") & ~body.startswith("#")).alias("is_code"),
            F.when(cls != "", F.lit("class")).when(dfn != "", F.lit("def")).alias("kind"), F.when(cls != "", cls).otherwise(dfn).alias("name"))
    return _lines(files, PY_LEX, _py_rewrite).select("file_id", "total_lines", F.transform("lines", fact).alias("facts"))


def python_symbols(files: DataFrame) -> DataFrame:
    """O15 + O19: class/def symbols outside triple-quoted strings with their
    last body line: signature end by bracket depth and last ':', one-liners
    end on their header, the body is the lines indented past the header
    (blank and comment lines neutral, string lines in the body)."""
    return _folded(files, _python_blocks())


def _python_blocks() -> Callable[[str], list[tuple]]:
    headers = [("class", compiled(PY_CLASS), 2), ("def", compiled(PY_DEF), 2)]
    lex = lexer(PY_LEX)
    return lambda text: indent_blocks(text, lex.sub(python_token, text), headers)


def docstring_mask(files: DataFrame) -> DataFrame:
    """(file_id, line_no) of lines that begin inside a triple-quoted
    string (the opening line is not masked, the closing line is)."""
    spans = F.filter("facts", lambda x: (x["mask_end"] > x["i"]) & (x["i"] < F.col("total_lines")))
    masked = F.array_distinct(F.flatten(F.transform(spans, lambda x: F.sequence(x["i"] + 1, F.least(x["mask_end"], F.col("total_lines"))))))
    f = _python_facts(files).select("file_id", masked.alias("masked"))
    f = f.select("file_id", F.explode_outer("masked").alias("line_no")).where("line_no is not null")
    return f.select("file_id", F.col("line_no").cast("int").alias("line_no"))


# ------------------------------------------------------- JavaScript / TS

#: What a line must hold for a pattern to match at all.
_JS_HINTS = (["function"], ["class"], ["=>", "="], ["(", "{"], ["(", "{"], ["(", "="])


def _js_facts(files: DataFrame) -> DataFrame:
    def fact(x: Column) -> Column:
        raw, clean = x["raw"], x["clean"]
        which = F.lit(None).cast("int")
        for k in reversed(range(len(JS_PATTERNS))):
            may = raw.contains(_JS_HINTS[k][0])
            for hint in _JS_HINTS[k][1:]:
                may = may & raw.contains(hint)
            which = F.when(may & raw.rlike(JS_PATTERNS[k][0]), F.lit(k)).otherwise(which)

        def named(w: Column) -> Column:
            kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
            for k, (pat, kind_k) in enumerate(JS_PATTERNS):
                kind = F.when(w == k, F.lit(kind_k)).otherwise(kind)
                name = F.when(w == k, F.regexp_extract(raw, pat, 1)).otherwise(name)
            # the last two characters that are not whitespace
            arrow = F.when(clean.contains(">"), let(_rtrim(clean), lambda t: t.endswith(">") & _rtrim(F.substring(t, F.lit(1), F.length(t) - 1)).endswith("="))).otherwise(F.lit(False))
            semi = clean.contains(";") & _rtrim(clean).endswith(";")
            return F.struct(x["i"].alias("i"), _balance(clean, "{", "}").alias("delta"), clean.contains("{").alias("opens"), semi.alias("semi"),
                            arrow.alias("arrow"), kind.alias("kind"), name.alias("name"))
        return let(which, named)
    return _lines(files, JS_LEX, _js_rewrite).select("file_id", "total_lines", F.transform("lines", fact).alias("facts"))


def js_symbols(files: DataFrame) -> DataFrame:
    """O16 + O20: symbols by the six line patterns, with brace-block ends
    (strings and comments ignored, settled only at line ends, never on a
    line ending in '=>', expression arrows end at ';', no '{' within 20
    lines -> the header line)."""
    return _folded(files, _js_blocks())


def _js_blocks() -> Callable[[str], list[tuple]]:
    headers = [(kind, compiled(pattern), hints[0], hints[-1]) for (pattern, kind), hints in zip(JS_PATTERNS, _JS_HINTS)]
    lex = lexer(JS_LEX)
    return lambda text: brace_blocks(text, lex.sub(js_token, text), headers, JS_LOOKAHEAD)


# ----------------------------------------------------------------- Markdown

def markdown_symbols(files: DataFrame) -> DataFrame:
    """O17: '#'-'###' headings outside fenced code (a fence opens with 3+
    backticks or tildes after at most 3 spaces and closes only with the same
    character); fence lines are never headings; no end line."""
    return _rows(_markdown_arrays(files), "symbols")


def _markdown_arrays(files: DataFrame) -> DataFrame:
    def fact(x: Column, i: Column) -> Column:
        return F.struct((i + 1).alias("i"), F.substring(F.regexp_extract(x, MD_FENCE, 1), 1, 1).alias("fence"),
                        F.regexp_extract(x, MD_HEADING, 1).alias("hashes"), js_trim(F.regexp_extract(x, MD_HEADING, 2)).alias("name"))

    def step(acc: Column, x: Column) -> Column:
        # within a fence only its own character ends it
        fence = F.when(x["fence"] == "", acc["fence"]).when(acc["fence"] == "", x["fence"]).when(acc["fence"] == x["fence"], F.lit("")).otherwise(acc["fence"])
        heading = _symbol(F.concat(F.lit("h"), F.length(x["hashes"]).cast("string")), x["name"], x["i"], F.lit(None))
        found = F.when((x["fence"] == "") & (acc["fence"] == "") & (x["hashes"] != ""), F.concat(acc["done"], F.array(heading).cast(f"array<{SYMBOL}>")))
        return state(fence, found.otherwise(acc["done"]))

    def state(fence: Column, done: Column) -> Column:
        return F.struct(fence.alias("fence"), done.alias("done"))

    facts = F.filter(F.transform(split_lines(F.coalesce(F.col("text"), F.lit(""))), fact), lambda x: (x["fence"] != "") | (x["hashes"] != ""))
    zero = {"fence": F.lit(""), "done": none_of(SYMBOL)}
    return files.select("file_id", fold_chunks(facts, state, zero, step, SYMBOL)["done"].alias("symbols"))


# -------------------------------------------------------------- all languages

def _by_scanner(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The files of each scanner: Python, JavaScript and TypeScript, Markdown."""
    language = F.col("language")
    return files.where(language == "Python"), files.where(language.isin("JavaScript", "TypeScript")), files.where(language == "Markdown")


def outline_symbols(files: DataFrame) -> DataFrame:
    """Flat symbols of every scanned file: (file_id, kind, name, start_line,
    end_line). ``files`` has file_id, language and text."""
    py, js, md = _by_scanner(files)
    return python_symbols(py).unionByName(js_symbols(js)).unionByName(markdown_symbols(md))


def outline_tree(files: DataFrame) -> DataFrame:
    """``nest_symbols`` of ``outline_symbols``, in the files' own rows: no shuffle."""
    py, js, md = _by_scanner(files)
    in_order = F.sort_array(F.transform("symbols", lambda s: F.struct(s["start_line"].alias("start_line"), s["end_line"].alias("end_line"),
                                                                       s["kind"].alias("kind"), s["name"].alias("name"))))
    headings = _nested_rows(_markdown_arrays(md).select("file_id", in_order.alias("symbols")))
    return _folded(py, _python_blocks(), nest=True).unionByName(_folded(js, _js_blocks(), nest=True)).unionByName(headings)


def nest_symbols(symbols: DataFrame) -> DataFrame:
    """parent = nearest earlier symbol whose [start, end] covers this
    start; depth is 1 for roots. ``outline_tree`` does the same in the files' own rows."""
    item = F.struct("start_line", "end_line", "kind", "name")
    files = symbols.groupBy("file_id").agg(F.sort_array(F.collect_list(item)).alias("symbols"))
    return _nested_rows(files)


def _nested_rows(files: DataFrame) -> DataFrame:
    """One row a symbol from (file_id, symbols in order)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FOLD_ROWS):
                b = batch.slice(at, FOLD_ROWS)
                start, end, kind, name = (c.to_pylist() for c in b.column(1).flatten().flatten())
                rows = list(zip(kind, name, start, end))
                ends = np.cumsum(pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False))
                yield symbol_rows(b.column(0), [nested(rows[i:j]) for i, j in zip([0, *ends[:-1]], ends)], 6)
    symbols = F.col("symbols").cast("array<struct<start_line:int,end_line:int,kind:string,name:string>>")
    return files.select("file_id", symbols.alias("symbols")).mapInArrow(run, _schema(files, 6))


def outline_listing(nested: DataFrame, max_rows: int = 200, offset: int = 0) -> DataFrame:
    """Pre-order rows (start order is pre-order) with row number, total
    and the offset of the next page (null when none is left)."""
    w = Window.partitionBy("file_id").orderBy("start_line")
    r = nested.select("*", F.row_number().over(w).cast("int").alias("row_no"),
                      F.count("*").over(Window.partitionBy("file_id")).cast("int").alias("total"))
    r = r.where((F.col("row_no") > offset) & (F.col("row_no") <= offset + max_rows))
    shown = F.count("*").over(Window.partitionBy("file_id"))
    nxt = F.when(F.lit(offset) + shown < F.col("total"), F.lit(offset) + shown)
    return r.withColumn("next_offset", nxt.cast("int"))


def outline_depth(nested: DataFrame, max_depth: int, max_rows: int = 200, offset: int = 0) -> DataFrame:
    """Rows with depth <= max_depth; a row at the cut depth carries the
    number of all its hidden descendants; hidden rows use no row numbers;
    ``total`` still counts every symbol. ``next_offset`` is null when no
    visible rows remain (the reference prints a 'more' marker instead)."""
    # Rows below the cut hang from one at the cut depth: the nearest before them, since
    # every row's parent comes before it and depth grows by one along a branch.
    order = Window.partitionBy("file_id").orderBy("start_line", F.col("end_line").asc_nulls_first(), "kind", "name")
    cut_no = F.sum((F.col("depth") == max_depth).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    nested = nested.withColumn("cut_no", cut_no)
    below = F.sum((F.col("depth") > max_depth).cast("int")).over(Window.partitionBy("file_id", "cut_no"))
    nested = nested.withColumn("hidden_members", F.when(F.col("depth") == max_depth, below).cast("int"))
    total = F.count("*").over(Window.partitionBy("file_id"))
    v = nested.withColumn("total", total.cast("int")).where(F.col("depth") <= max_depth)
    v = v.drop("cut_no").withColumn("hidden_members", F.when(F.col("hidden_members") > 0, F.col("hidden_members")))
    w = Window.partitionBy("file_id").orderBy("start_line")
    v = v.withColumn("row_no", F.row_number().over(w).cast("int"))
    v = v.withColumn("n_visible", F.count("*").over(Window.partitionBy("file_id")))
    v = v.where((F.col("row_no") > offset) & (F.col("row_no") <= offset + max_rows))
    shown = F.count("*").over(Window.partitionBy("file_id"))
    return v.withColumn("next_offset", F.when(F.lit(offset) + shown < F.col("n_visible"),
                                              F.lit(offset) + shown).cast("int")).drop("n_visible")


def fetch_symbol(files: DataFrame, nested: DataFrame, requests: DataFrame, max_lines: int = 250,
                 ctx: int = 10, max_hits: int = 5) -> DataFrame:
    """Resolve (file_id, target) by name, ignoring case, among roots
    and their direct children. Several -> 'ambiguous' with up to 20
    candidates; exactly one with an end -> 'symbol' with its body (at most
    ``max_lines`` lines, ``continue_at`` when cut); otherwise a text search
    ('text' with up to 5 hit lines, each with ``ctx`` numbered lines on either
    side, and the true count, or 'none')."""
    symbol = F.struct("start_line", "end_line", "kind", "name")
    none = F.lit(None)
    # Requests and symbols go through one exchange, by file; names and files then meet without another.
    asked = requests.where("file_id is not null").select("file_id", F.struct("target").alias("request"), none.alias("symbol"))
    cand = nested.where((F.col("depth") <= 2) & F.col("file_id").isNotNull() & F.col("name").isNotNull()).select("file_id", none.alias("request"), symbol.alias("symbol"))
    both = asked.unionByName(cand).repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file_id")
    g = both.groupBy("file_id", F.lower(F.coalesce("request.target", "symbol.name")).alias("lname")).agg(
        F.collect_list("request").alias("requests"), F.collect_list("symbol").alias("symbols")).where(F.size("requests") > 0)
    g = g.select("file_id", "requests", "symbols", F.explode(F.array_distinct("requests")).alias("r"))
    # a request that is repeated counts each symbol as often
    times = F.size(F.filter("requests", lambda x: x.eqNullSafe(F.col("r"))))
    placed = F.filter("symbols", lambda x: x["start_line"].isNotNull())
    label = lambda x: F.concat_ws("", x["kind"], F.lit(" "), x["name"], F.lit("  lines "), x["start_line"].cast("string"),
                                  F.when(x["end_line"].isNotNull(), F.concat(F.lit("–"), x["end_line"].cast("string"))))
    labels = F.slice(F.array_sort(F.transform(placed, lambda x: F.struct(x["start_line"].alias("start_line"), label(x).alias("l")))), 1, SHOW_CANDIDATES)
    g = g.select("file_id", F.col("r.target").alias("target"), "symbols", times.alias("times"), (times * F.size(placed)).cast("int").alias("n_matches"),
                 F.array_min("symbols").alias("one"))
    status = (F.when(F.col("n_matches") > 1, F.lit("ambiguous"))
              .when((F.col("n_matches") == 1) & F.col("one.end_line").isNotNull(), F.lit("symbol"))
              .otherwise(F.lit("search")))
    g = g.withColumn("status", status)
    shown = F.slice(F.flatten(F.transform(labels, lambda x: F.array_repeat(x["l"], F.least(F.col("times"), F.lit(SHOW_CANDIDATES))))), 1, SHOW_CANDIDATES)
    g = g.select("file_id", "target", "n_matches", "one", "status", F.when(F.col("status") == "ambiguous", shown).alias("candidates"))
    # One join of the files, whatever the status. A file's lines go as one text, a third of the array's bytes,
    # unless a line is null or holds a line break: then breaks and joints don't agree.
    joined = F.array_join("lines", "\n", "\n")
    f = files.select("file_id", "total_lines", "lines", joined.alias("text"))
    plain = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) == F.size("lines") - 1
    f = f.select("file_id", "total_lines", F.when(plain, F.col("text")).alias("text"), F.when(plain, F.lit(None)).otherwise(F.col("lines")).alias("odd"))
    j = g.join(f, "file_id")
    needle = F.lower(F.col("target"))
    # most searches find nothing: one look at the whole text says so
    whole = F.coalesce("text", F.array_join("odd", "\n"))
    j = j.withColumn("found", F.when(F.col("status") == "search", F.coalesce(F.lower(whole).contains(needle), whole.isNull())))
    j = j.withColumn("lines", F.when(F.col("found") | (F.col("status") == "symbol"), F.coalesce("odd", F.split("text", "\n", -1))))
    numbered_lines = F.transform("lines", lambda x, i: F.struct((i + 1).alias("i"), F.lower(x).alias("l")))
    hits = F.transform(F.filter(numbered_lines, lambda x: x["l"].contains(needle)), lambda x: x["i"])
    j = j.withColumn("hits", F.when(F.col("status") == "search", F.when(F.col("found"), hits).otherwise(F.array().cast("array<int>"))))
    sym, search = F.col("status") == "symbol", F.col("status") == "search"
    first = F.col("one.start_line")
    last = F.least(F.col("one.end_line"), first + max_lines - 1)
    shown = F.slice("hits", 1, max_hits)

    def around(i: Column) -> Column:
        lo = F.greatest(F.lit(1), i - ctx)
        return numbered(F.slice("lines", lo, F.least(F.col("total_lines"), i + ctx) - lo + 1), lo)

    return j.select(
        "file_id", "target", F.when(~search, F.col("status")).when(F.size("hits") > 0, F.lit("text")).otherwise(F.lit("none")).alias("status"), "n_matches",
        F.when(sym, F.col("one.kind")).alias("kind"), F.when(sym, F.col("one.name")).alias("name"),
        F.when(sym, first).alias("start_line"), F.when(sym, F.col("one.end_line")).alias("end_line"),
        F.when(sym, numbered(F.slice("lines", first, last - first + 1), first)).alias("body"),
        F.when(sym & (last < F.col("one.end_line")), last + 1).cast("int").alias("continue_at"),
        F.when(F.col("status") == "ambiguous", F.col("candidates")).alias("candidates"),
        F.when(search, F.size("hits")).cast("int").alias("occurrences"),
        F.when(search, shown).alias("hit_lines"), F.when(search, F.transform(shown, around)).alias("hit_context"))


def outline_accuracy(symbols: DataFrame, truth: DataFrame, floors: dict[str, float] | None = None) -> DataFrame:
    """Per language, the share of truth symbols found by (file, kind
    group, name, start) whose end equals the truth's end; pass if at least
    the floor (Python 99.5 %, TypeScript 95.0 %)."""
    floors = floors or {"Python": 0.995, "TypeScript": 0.95, "JavaScript": 0.95}
    grp = F.when(F.col("kind") == "class", F.lit("class")).otherwise(F.lit("func"))
    s = symbols.select("file_id", grp.alias("grp"), "name", "start_line", F.col("end_line").alias("found_end"))
    t = truth.select("file_id", "language", F.when(F.col("kind") == "class", F.lit("class")).otherwise(F.lit("func")).alias("grp"),
                     "name", "start_line", F.col("end_line").alias("true_end"))
    j = t.join(s, ["file_id", "grp", "name", "start_line"], "left")
    floor = F.create_map(*[x for k, v in floors.items() for x in (F.lit(k), F.lit(v))])
    g = j.groupBy("language").agg(
        F.count("*").cast("int").alias("n_truth"),
        F.count("found_end").cast("int").alias("n_found"),
        F.count_if(F.col("found_end") == F.col("true_end")).cast("int").alias("n_exact"))
    acc = F.when(F.col("n_found") > 0, F.col("n_exact") / F.col("n_found"))
    return g.select("*", acc.alias("accuracy"),
                    (acc >= F.coalesce(F.try_element_at(floor, F.col("language")), F.lit(0.0))).alias("passed"))
