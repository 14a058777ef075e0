import pytest

from tessera.operators.lines import (check_pattern, explode_lines, files_from_text, read_chunk, search_lines,
                                     trimmed_hits)


def _files(spark, texts):
    df = spark.createDataFrame([(i, f"d/f{i}.txt", t) for i, t in enumerate(texts)], "id long, path string, text string")
    return files_from_text(df, "id", "path", "text")


def test_line_split_rules(spark):
    f = _files(spark, ["", "a\r\nb\r\n", "a\n\n", "\n", None, "x"])
    got = {r.file_id: r.lines for r in f.collect()}
    assert got == {0: [], 1: ["a", "b"], 2: ["a", ""], 3: [""], 4: [], 5: ["x"]}
    assert explode_lines(f).where("file_id = 1").orderBy("line_no").collect()[1].line_no == 2


def test_true_totals_with_cap(spark):
    f = _files(spark, ["\n".join(f"match {i}" for i in range(50))])
    rows = search_lines(f, "MATCH", ctx=2, max_results=3).collect()
    assert len(rows) == 3 and all(r.occurrences == 50 for r in rows)
    assert rows[0].before == [] and rows[0].after == ["match 1", "match 2"]


def test_long_line_trimmed_around_match(spark):
    line = "a" * 50_000 + "needle" + "b" * 50_000
    f = _files(spark, [line])
    r = trimmed_hits(search_lines(f, "needle", ctx=0), "needle").collect()[0]
    assert r.trimmed and r.match_col == 50_001 and len(r.text.split("  [")[0]) == 800
    assert "needle" in r.text and r.text.endswith("[800 of 100006 characters kept; the match starts at 50001]")


def test_regex_argument_check():
    with pytest.raises(ValueError):
        check_pattern("(a+)+$")
    with pytest.raises(ValueError):
        check_pattern("x" * 201)
    for bad in ("((a+))*", "(a{2,3}b)+", r"(x(?:y*)z){2}", "((ab)*c)+"):
        with pytest.raises(ValueError):
            check_pattern(bad)
    for good in ("(a+)(b*)", "(ab)+c*", "(a+)?", r"(\+)+", "([+*])+"):
        check_pattern(good)
    check_pattern(r"foo\(bar")
    check_pattern(r"[(a+)+]")


def test_chunks(spark):
    f = _files(spark, ["\n".join(str(i) for i in range(1, 100_011))])
    req = spark.createDataFrame([(0, 99_999, 100_001), (0, 200_000, 200_005), (0, -5, 1)], "file_id long, start int, end int")
    got = {r.start: r for r in read_chunk(f, req).collect()}
    assert got[99_999].text.split("\n")[0] == "99999 │ 99999"
    assert got[99_999].text.split("\n")[1] == "100000 │ 100000"
    assert got[200_000].status == "empty" and got[200_000].total_lines == 100_010
    assert got[-5].text == "    1 │ 1"
