import random

from pyspark.sql import functions as F

from tessera.functions.html import attr_value
from tessera.functions.text import tags_to_text
from tessera.operators.lines import files_from_text, search_lines
from tessera.operators.outline import nest_symbols
from tessera.operators.pages import auth_required_word


def test_accented_ignore_case_search(spark):
    df = spark.createDataFrame([(0, "f.txt", "CAFÉ crème\nnothing\nun café")], "id long, path string, text string")
    hits = search_lines(files_from_text(df, "id", "path", "text"), "café", ctx=0).collect()
    assert [h.line_no for h in hits] == [1, 3] and hits[0].occurrences == 2


def test_login_next_to_accented_letters(spark, pages_df):
    df = pages_df([("u", "<p>éloginé</p>"), ("u", "<p>xlogin</p>"), ("u", "<p>Sign-in required</p>")])
    got = [r.a for r in df.select(auth_required_word(tags_to_text(F.col("html"))).alias("a")).orderBy("page_id").collect()]
    assert got == [True, False, False]


def test_data_name_answers_for_name(spark):
    df = spark.createDataFrame([(' data-name="x" ',), (' name = y ',), (" names='z' name='w'",)], "a string")
    assert [r.v for r in df.select(attr_value(F.col("a"), "name").alias("v")).collect()] == ["x", "y", "w"]


def _stack_parents(intervals):
    """Sequential nesting: pop while the top does not cover the start."""
    stack, out = [], {}
    for s, e in intervals:
        while stack and not (stack[-1][1] is not None and stack[-1][0] < s <= stack[-1][1]):
            stack.pop()
        out[s] = (stack[-1][0] if stack else None, len(stack) + 1)
        stack.append((s, e))
    return out


def _laminar(rng, lo, hi, depth):
    out, pos = [], lo
    while pos < hi and rng.random() < 0.8:
        s = pos
        e = min(hi, s + rng.randint(0, 12))
        out.append((s, e))
        if depth < 4 and e > s + 1:
            out += _laminar(rng, s + 1, e, depth + 1)
        pos = e + 1 + rng.randint(0, 2)
    return out


def test_nesting_matches_stack_walk(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for f in range(300):
        iv = sorted(_laminar(rng, 1, 120, 0))
        want[f] = _stack_parents(iv)
        rows += [(f, "def", f"s{s}", s, e) for s, e in iv]
    df = spark.createDataFrame(rows, "file_id long, kind string, name string, start_line int, end_line int")
    got = {}
    for r in nest_symbols(df).collect():
        got.setdefault(r.file_id, {})[r.start_line] = (r.parent_start, r.depth)
    assert got == {f: w for f, w in want.items() if w}


def _random_intervals(rng):
    out, used = [], set()
    for _ in range(rng.randint(1, 25)):
        st = rng.randint(1, 60)
        if st in used:
            continue
        used.add(st)
        out.append((st, None if rng.random() < 0.15 else st + rng.randint(0, 20)))
    return sorted(out)


def test_nesting_with_crossing_ranges_matches_stack_walk(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for f in range(400):
        iv = _random_intervals(rng)
        want[f] = _stack_parents(iv)
        rows += [(f, "def", f"s{s}", s, e) for s, e in iv]
    df = spark.createDataFrame(rows, "file_id long, kind string, name string, start_line int, end_line int")
    got = {}
    for r in nest_symbols(df).collect():
        got.setdefault(r.file_id, {})[r.start_line] = (r.parent_start, r.depth)
    assert got == want
