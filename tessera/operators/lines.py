"""Line operators over a files table (file_id, path, name, lines array):
line rows (O06), language tag (O07), language coverage (O08), line search
(O09), context (O10), top hits with true totals (O11), long-line trimming
(O12), chunk reads (O13) and file summaries (O14).

A file's lines live in one array in its row, so search, context, chunks and
summaries are per-row array expressions: no shuffle. Hit positions are
computed once per file and the context is sliced around each hit.
"""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import regex_quote
from tessera.sources.files import file_name, split_lines

# --- fixed values --------------------------------------------------------
LANGUAGE_BY_EXTENSION = {
    ".py": "Python", ".js": "JavaScript", ".mjs": "JavaScript",
    ".cjs": "JavaScript", ".jsx": "JavaScript",
    ".ts": "TypeScript", ".mts": "TypeScript", ".cts": "TypeScript",
    ".tsx": "TypeScript", ".md": "Markdown",
    ".go": "Go", ".rs": "Rust", ".java": "Java", ".rb": "Ruby",
    ".sh": "Shell", ".bash": "Shell", ".zsh": "Shell",
    ".json": "JSON", ".yaml": "YAML", ".yml": "YAML",
    ".toml": "TOML", ".html": "HTML", ".css": "CSS", ".cpp": "C++",
    ".c": "C", ".h": "C", ".hpp": "C++", ".cs": "C#",
}
SCANNED_LANGUAGES = ["Python", "JavaScript", "TypeScript", "Markdown"]
MAX_LINE_CHARS = 800
MAX_QUERY_CHARS = 200
# -------------------------------------------------------------------------


def language_of(name: Column) -> Column:
    """Language from the lower-cased last extension ('text' if none)."""
    ext = F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))
    m = F.create_map(*[x for k, v in LANGUAGE_BY_EXTENSION.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, ext), F.lit("text"))


def files_from_text(df: DataFrame, id_col: str, path_col: str, text_col: str) -> DataFrame:
    """A files table from (id, path, text) rows, split into lines."""
    return df.select(
        F.col(id_col).alias("file_id"), F.col(path_col).alias("path"),
        file_name(F.col(path_col)).alias("name"), language_of(file_name(F.col(path_col))).alias("language"),
        split_lines(F.col(text_col)).alias("lines")).withColumn("total_lines", F.size("lines").cast("int"))


def explode_lines(files: DataFrame) -> DataFrame:
    """(file_id, line_no, line), 1-based."""
    return files.select("file_id", F.posexplode("lines").alias("line_no", "line")) \
        .withColumn("line_no", (F.col("line_no") + 1).cast("int"))


def check_pattern(query: str) -> None:
    """Argument check for regex search: a length cap, and no repetition of a
    group that itself repeats something (it could backtrack exponentially).

    Escapes and character classes become a plain letter; then groups are
    rewritten from the inside out, each to a letter that is marked as
    repeating if the group held a repetition."""
    if len(query) > MAX_QUERY_CHARS:
        raise ValueError(f"the pattern has {len(query)} characters; {MAX_QUERY_CHARS} are allowed")
    flat = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]?", "x", query, flags=re.S)
    while group := re.search(r"\(([^()]*)\)([*+{]?)", flat):
        repeats = re.search(r"[*+{]", group[1]) is not None
        if repeats and group[2]:
            raise ValueError(f"the pattern repeats a group that holds a repetition: {group[0]!r}")
        flat = flat[:group.start()] + ("x+" if repeats else "x") + flat[group.end(1) + 1:]


def _compiles(df: DataFrame, pattern: str) -> None:
    """Compile once in the driver, so that a bad pattern never reaches a task."""
    try:
        df.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException) as e:
        raise ValueError(f"the pattern is not a regular expression: {e}") from None


def match_pattern(query: str, regex: bool) -> str:
    """Case-insensitive Java pattern for a literal or a checked regex."""
    if regex:
        check_pattern(query)
        return "(?iu)" + query
    return "(?iu)" + regex_quote(query)


def _hits(lines: Column, pat: str) -> Column:
    """1-based numbers of matching lines (no outer array captured in the lambda)."""
    return F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(pat), i + 1)), lambda i: i.isNotNull())


def search_lines(files: DataFrame, query: str, regex: bool = False, ctx: int = 5,
                 max_results: int | None = None) -> DataFrame:
    """Matching lines with up to ``ctx`` lines before and after
    (clipped at file ends). With ``max_results`` only the first k hits per
    file are returned, while ``occurrences`` counts every matching line."""
    pat = match_pattern(query, regex)
    _compiles(files, pat)
    f = files.select("file_id", "lines", "total_lines").withColumn("hit_idx", _hits(F.col("lines"), pat))
    f = f.withColumn("occurrences", F.size("hit_idx").cast("int"))
    shown = F.col("hit_idx") if max_results is None else F.slice("hit_idx", 1, max_results)
    lines, n = F.col("lines"), F.col("total_lines")

    def hit(i: Column) -> Column:
        lo = F.greatest(F.lit(1), i - ctx)
        return F.struct(i.alias("line_no"), F.element_at(lines, i).alias("line"),
                        F.slice(lines, lo, i - lo).alias("before"),
                        F.slice(lines, i + 1, F.least(F.lit(ctx), n - i)).alias("after"))
    out = f.select("file_id", "occurrences", F.posexplode(F.transform(shown, hit)).alias("rank", "h"))
    return out.select("file_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("h.line_no").cast("int").alias("line_no"),
                      F.col("h.line").alias("line"), F.col("h.before").alias("before"),
                      F.col("h.after").alias("after"), "occurrences")


def trim_line(line: Column, pat: str, max_chars: int = MAX_LINE_CHARS) -> dict[str, Column]:
    """A line over ``max_chars`` is cut to a window of that size around
    the first match (from max(0, at - max/2)); the note gives the original
    length and the 1-based match column."""
    at = F.regexp_instr(line, F.lit(pat))
    start = F.greatest(F.lit(0), F.when(at == 0, F.lit(0)).otherwise(at - 1) - max_chars // 2)
    long = F.length(line) > max_chars
    note = F.concat(F.lit(f"  [{max_chars} of "), F.length(line).cast("string"), F.lit(" characters kept"),
                    F.when(at == 0, F.lit("")).otherwise(F.concat(F.lit("; the match starts at "), at.cast("string"))),
                    F.lit("]"))
    text = F.when(long, F.concat(F.substring(line, start + 1, max_chars), note)).otherwise(line)
    return {"text": text, "trimmed": long, "n_chars": F.length(line).cast("int"),
            "match_col": F.when(long & (at > 0), at.cast("int"))}


def trimmed_hits(hits: DataFrame, query: str, regex: bool = False) -> DataFrame:
    """O12 over search output: every emitted line (context and hit) with its
    trimmed text (``trimmed_per_file`` counts them)."""
    pat = match_pattern(query, regex)
    rows = hits.select(
        "file_id", F.col("line_no").alias("hit_line_no"),
        F.posexplode(F.concat(
            F.transform("before", lambda x, j: F.struct((F.col("line_no") - F.size("before") + j).alias("n"), x.alias("l"))),
            F.array(F.struct(F.col("line_no").alias("n"), F.col("line").alias("l"))),
            F.transform("after", lambda x, j: F.struct((F.col("line_no") + 1 + j).alias("n"), x.alias("l")))
        )).alias("k", "e"))
    t = trim_line(F.col("e.l"), pat)
    return rows.select("file_id", "hit_line_no", F.col("e.n").cast("int").alias("line_no"),
                       t["text"].alias("text"), t["trimmed"].alias("trimmed"),
                       t["n_chars"].alias("n_chars"), t["match_col"].alias("match_col"))


def numbered(lines: Column, first: Column) -> Column:
    """Lines joined with a right-aligned 5-wide number gutter."""
    def gutter(n: Column) -> Column:
        return F.when(n < 100_000, F.lpad(n.cast("string"), 5, " ")).otherwise(n.cast("string"))
    return F.array_join(F.transform(lines, lambda x, i: F.concat(gutter(first + i), F.lit(" │ "), F.coalesce(x, F.lit("null")))), "\n")


def trimmed_per_file(trimmed: DataFrame) -> DataFrame:
    """Per file of ``trimmed_hits``, the number of emitted lines that were cut."""
    return trimmed.groupBy("file_id").agg(F.count_if("trimmed").cast("int").alias("n_trimmed"))


def read_chunk(files: DataFrame, requests: DataFrame) -> DataFrame:
    """Join (file_id, start, end) requests to files; clamp to [1, n];
    numbered lines, or status 'empty' with the file length. Spark broadcasts
    the requests when they are small by its statistics."""
    req = requests.select("file_id", "start", "end")
    j = files.select("file_id", "lines", "total_lines").join(req, "file_id")
    s = F.greatest(F.lit(1), F.col("start"))
    e = F.least(F.col("total_lines"), F.col("end"))
    sel = F.when(e >= s, F.slice("lines", s, e - s + 1)).otherwise(F.array().cast("array<string>"))
    return j.select("file_id", "start", "end", "total_lines",
                    F.when(F.size(sel) > 0, F.lit("ok")).otherwise(F.lit("empty")).alias("status"),
                    F.when(F.size(sel) > 0, numbered(sel, s)).alias("text"))


def summarize_files(files: DataFrame, symbol_counts: DataFrame, head: int = 40, tail: int = 20) -> DataFrame:
    """Name, language, size, symbol count, numbered head, and a tail
    starting at max(head, n - tail) so head and tail never overlap."""
    n = F.col("total_lines")
    tail_start = F.greatest(F.lit(head), n - tail)
    f = files.join(symbol_counts, "file_id", "left")
    return f.select(
        "file_id", "name", "language", "total_lines",
        F.coalesce(F.col("n_symbols"), F.lit(0)).cast("int").alias("n_symbols"),
        numbered(F.slice("lines", 1, head), F.lit(1)).alias("head"),
        F.when(tail_start < n, numbered(F.slice("lines", tail_start + 1, n - tail_start), tail_start + 1)).alias("tail"))


def file_notes(files: DataFrame, symbol_counts: DataFrame) -> DataFrame:
    """Per file its language, whether a scanner ran on it, its symbols, and
    the kind of note for a file that nothing scanned: 'unrecognised' (by its
    extension) or 'unscanned' (a known language without a scanner)."""
    f = files.select("file_id", "language").join(symbol_counts, "file_id", "left")
    scanned = F.col("language").isin(*SCANNED_LANGUAGES)
    n = F.coalesce(F.col("n_symbols"), F.lit(0))
    note = (F.when(scanned | (n > 0), F.lit(None).cast("string"))
            .when(F.col("language") == "text", F.lit("unrecognised")).otherwise(F.lit("unscanned")))
    return f.select("file_id", "language", scanned.alias("scanned"), n.alias("n_symbols"), note.alias("note"))


def language_coverage(files: DataFrame, symbol_counts: DataFrame) -> DataFrame:
    """``file_notes`` rolled up by language, first by language and note: the
    largest note among single files would have Spark sort every file."""
    notes = file_notes(files, symbol_counts).groupBy("language", "note").agg(
        F.count("*").alias("n_files"), F.count_if("scanned").alias("n_scanned"), F.sum("n_symbols").alias("n_symbols"))
    return notes.groupBy("language").agg(
        F.sum("n_files").cast("int").alias("n_files"),
        F.sum("n_scanned").cast("int").alias("n_scanned"),
        F.sum("n_symbols").cast("long").alias("n_symbols"),
        F.coalesce(F.sum(F.when(F.col("note").isNotNull(), F.col("n_files"))), F.lit(0)).cast("int").alias("n_noted"),
        F.max("note").alias("note"))
