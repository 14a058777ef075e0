"""Text-file sources: scan (O01), admission (O02) and root confinement.

Files are read with the ``binaryFile`` source; the size check runs on the
``length`` metadata column before ``content`` is touched, and the NUL sniff
looks only at the first 8 KiB. Lines are split in each file's own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values --------------------------------------------------------
MAX_TEXT_BYTES = 32 * 1024 * 1024
SNIFF_BYTES = 8192
# -------------------------------------------------------------------------


def split_lines(text: Column) -> Column:
    """Lines of a text: split on \\n or \\r\\n, exactly one trailing empty
    line dropped (so a 0-byte file has 0 lines); null text has 0 lines."""
    # one plain character to split at needs no pattern
    arr = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n", -1)
    return F.when(F.element_at(arr, -1) == "", F.slice(arr, 1, F.size(arr) - 1)).otherwise(arr)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def admit_text(files: DataFrame, content_col: str = "content", length_col: str = "length") -> DataFrame:
    """Status 'ok', 'too_large' (over 32 MiB) or 'binary' (a NUL byte in
    the first 8 KiB and no UTF-16 byte-order mark). Empty files are ok."""
    head = F.substring(F.col(content_col), 1, SNIFF_BYTES)
    bom16 = (F.substring(F.col(content_col), 1, 2) == F.unhex(F.lit("FFFE"))) | \
            (F.substring(F.col(content_col), 1, 2) == F.unhex(F.lit("FEFF")))
    has_nul = F.coalesce(F.contains(head, F.lit(bytearray(b"\x00"))), F.lit(False))
    status = (F.when(F.col(length_col) > MAX_TEXT_BYTES, F.lit("too_large"))
              .when(has_nul & ~bom16, F.lit("binary")).otherwise(F.lit("ok")))
    return files.withColumn("status", status)


def scan_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, name, n_bytes, status, text, lines, total_lines) for every
    file under ``path``. Rejected files keep their row with empty lines;
    invalid UTF-8 becomes U+FFFD."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    # the size rule is pushed into the source: an oversized file is listed, never read
    small = admit_text(reader.load(path).where(F.col("length") <= MAX_TEXT_BYTES))
    text = F.when(F.col("status") == "ok", F.make_valid_utf8(F.col("content").cast("string")))
    read = small.select("path", "length", "status", text.alias("text"))
    large = reader.load(path).where(F.col("length") > MAX_TEXT_BYTES).select(
        "path", "length", F.lit("too_large").alias("status"), F.lit(None).cast("string").alias("text"))
    out = read.unionByName(large).select(
        F.regexp_replace("path", "^file:", "").alias("path"),
        file_name(F.col("path")).alias("name"), F.col("length").alias("n_bytes"), "status", "text")
    lines = split_lines(F.col("text"))
    return out.withColumn("lines", lines).withColumn("total_lines", F.size("lines").cast("int"))


def confine_paths(files: DataFrame, roots: DataFrame, path_col: str = "path") -> DataFrame:
    """Keep files whose path equals a root or lies below it (a root
    'src1' does not admit 'src10/x'). An empty roots table keeps everything.

    Roots are matched by an equi-join on every ancestor folder of the path
    (the path's prefixes ending at a '/'), over distinct paths only; file rows
    then meet the admitted paths in a semi join, so no row id is needed and
    repeated rows stay as they are.
    """
    anywhere = "/"  # no root ends in a slash, so this can't be one
    named = roots.select(F.regexp_replace(F.col("root"), "/+$", "").alias("anc")).distinct()
    none = roots.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(anywhere).alias("anc"))
    path = F.coalesce(F.col(path_col), F.lit(""))
    admitted = (files.select(path.alias("admitted path")).distinct()
                .select("admitted path", F.explode(F.concat(_prefixes("admitted path"), F.array(F.lit(anywhere)))).alias("anc"))
                .join(named.union(none), "anc", "left_semi").select("admitted path").distinct())
    return files.join(admitted, path == F.col("admitted path"), "left_semi")


def _prefixes(path_col: str) -> Column:
    parts = F.split(F.col(path_col), "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
