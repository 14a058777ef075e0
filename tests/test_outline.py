import ast
import glob
import os
import sysconfig
import time

from pyspark.sql import functions as F

from tessera.functions import folds
from tessera.operators import outline as O
from tessera.operators.lines import language_of

HARD_PY = '''import os


def one(): return 1


def multi(a,
          b=(1, 2),
          c="x:y"):
    """A docstring that mentions
    class Fake:
        def fake(self): pass
    """
    return a


class Box:
# a comment at column 0 inside the class
    QUOTE = "\'\'\'"
    OTHER = \'"""\'

    def inner(self):
        def nested():
            return 1
        return nested()

    async def later(self):
        s = """
not code
"""
        return s
    # trailing comment


class Last:
    pass
'''

HARD_TS = '''export function top(a: number): number {
  return a;
}

export default class Shape {
  private size = 1;
  area(): number {
    const s = "}";
    return this.size;
  }
  async load(url: string): Promise<void> {
    await fetch(url);
  }
  get width() {
    return 2;
  }
}

export const pick = <T>(
  xs: T[],
  f: (x: T) => boolean,
): T[] => {
  return xs.filter(f);
};

const twice = (x: number) => x * 2;

namespace Util {
  export const tag = (s: string) => `<${s}>{}`;
}
'''


def _src(spark, rows):
    df = spark.createDataFrame(rows, "file_id long, path string, text string")
    return df.withColumn("language", language_of(F.col("path")))


def test_hard_python_against_ast(spark):
    src = _src(spark, [(1, "a/hard.py", HARD_PY)])
    got = {(r.name, r.start_line): r.end_line for r in O.python_symbols(src).collect()}
    want = {}
    for node in ast.walk(ast.parse(HARD_PY)):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            want[(node.name, node.lineno)] = node.end_lineno
    assert got == want
    masked = {r.line_no for r in O.docstring_mask(src).collect()}
    assert masked == {11, 12, 13, 29, 30}
    nested = {r.name: (r.depth, r.parent_start) for r in O.nest_symbols(O.python_symbols(src)).collect()}
    assert nested["nested"] == (3, 22) and nested["inner"] == (2, 17) and nested["Last"] == (1, None)


def test_hard_typescript(spark):
    src = _src(spark, [(2, "a/hard.ts", HARD_TS)])
    got = {r.name: (r.kind, r.start_line, r.end_line) for r in O.js_symbols(src).collect()}
    assert got["top"] == ("function", 1, 3)
    assert got["Shape"] == ("class", 5, 17)
    assert got["area"] == ("method", 7, 10)
    assert got["load"] == ("method", 11, 13)
    assert got["width"] == ("accessor", 14, 16)
    assert got["pick"] == ("arrow fn", 19, 24)
    assert got["twice"] == ("arrow fn", 26, 26)
    assert got["tag"] == ("arrow fn", 29, 29)
    assert set(got) == {"top", "Shape", "area", "load", "width", "pick", "twice", "tag"}


def test_markdown_fences(spark):
    md = "# Top\n```bash\n# not heading\n~~~\n# still code\n```\n## Real\n   ~~~~\n### no\n~~~~\n### Yes\n"
    src = _src(spark, [(3, "r.md", md)])
    got = [(r.kind, r.name, r.start_line) for r in O.markdown_symbols(src).orderBy("start_line").collect()]
    assert got == [("h1", "Top", 1), ("h2", "Real", 7), ("h3", "Yes", 11)]


def test_listing_depth_and_fetch(spark):
    src = _src(spark, [(1, "a/hard.py", HARD_PY)])
    nested = O.nest_symbols(O.outline_symbols(src))
    page = O.outline_listing(nested, max_rows=3, offset=3).orderBy("row_no").collect()
    assert [r.row_no for r in page] == [4, 5, 6] and page[0].total == 7 and page[-1].next_offset == 6
    cut = {r.name: r.hidden_members for r in O.outline_depth(nested, max_depth=1).collect()}
    assert cut == {"one": None, "multi": None, "Box": 3, "Last": None}
    from tessera.operators.lines import files_from_text
    files = files_from_text(src, "file_id", "path", "text")
    req = spark.createDataFrame([(1, "BOX"), (1, "fake"), (1, "nothing here"), (1, "nested")], "file_id long, target string")
    got = {r.target: r for r in O.fetch_symbol(files, nested, req).collect()}
    assert got["BOX"].status == "symbol" and got["BOX"].start_line == 17 and got["BOX"].end_line == 31
    assert got["fake"].status == "text" and got["fake"].hit_lines == [11, 12]
    assert got["nothing here"].status == "none"
    assert got["nested"].status == "text"          # depth 3: not searched as a symbol


def test_stdlib_block_end_accuracy(spark):
    """O25 on the running Python's own standard library, with ast as truth."""
    lib = sysconfig.get_paths()["stdlib"]
    paths = sorted(p for p in glob.glob(os.path.join(lib, "*.py")) if os.path.getsize(p) < 400_000)[:150]
    rows, truth = [], []
    for i, p in enumerate(paths):
        text = open(p, encoding="utf-8", errors="replace").read()
        try:
            tree = ast.parse(text)
        except SyntaxError:
            continue
        rows.append((i, p, text))
        for n in ast.walk(tree):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(n, ast.ClassDef) else "def"
                truth.append((i, "Python", kind, n.name, n.lineno, n.end_lineno))
    src = _src(spark, rows)
    t = spark.createDataFrame(truth, "file_id long, language string, kind string, name string, start_line int, end_line int")
    r = O.outline_accuracy(O.python_symbols(src), t).collect()[0]
    assert r.n_found >= 0.99 * r.n_truth
    assert r.accuracy >= 0.995 and r.passed


def _rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_chunks_of_lines_change_nothing(spark, monkeypatch):
    src = _src(spark, [(1, "a/hard.py", HARD_PY), (2, "a/hard.ts", HARD_TS), (3, "r.md", "# A\n~~~\n# b\n~~~\n## C\n### D\n"), (4, "none.py", None)])
    whole = _rows_of(O.nest_symbols(O.outline_symbols(src)))
    assert whole == _rows_of(O.outline_tree(src)) and len(whole) > 12
    monkeypatch.setattr(folds, "CHUNK", 3)
    assert whole == _rows_of(O.outline_tree(src))


def test_long_files_cost_linear_time(spark):
    def seconds(n):
        py = "".join(f"def f{k}(a, b):\n    x = a\n    return [b]\n" for k in range(n))
        js = "".join(f"function f{k}(a) {{\n  x = a;\n}}\n" for k in range(n))
        began = time.time()
        out = O.outline_tree(_src(spark, [(1, "a.py", py), (2, "b.ts", js)]))
        rows = out.groupBy("file_id").agg(F.count("*").alias("n"), F.sum(F.col("end_line") - F.col("start_line")).alias("s")).collect()
        assert sorted((r.file_id, r.n, r.s) for r in rows) == [(1, n, 2 * n), (2, n, 2 * n)]
        return time.time() - began
    seconds(100)
    first, last = seconds(16_000), seconds(64_000)
    assert first < 30 and last < 6 * max(first, 5)
