import json
import os
import tempfile


from tessera.sources.files import confine_paths, scan_files
from tessera.sources.pages import scan_pages, write_site_maps


def test_scan_files_admission_and_lines(spark):
    d = tempfile.mkdtemp(prefix="tessera-files-")
    os.makedirs(os.path.join(d, "src1"))
    os.makedirs(os.path.join(d, "src10"))
    with open(os.path.join(d, "src1", "a.py"), "wb") as f:
        f.write(b"x = 1\r\ny = 2\r\n")
    with open(os.path.join(d, "src10", "bin.dat"), "wb") as f:
        f.write(b"\x7fELF\x00\x01\x02")
    with open(os.path.join(d, "src1", "u16.txt"), "wb") as f:
        f.write("hi".encode("utf-16"))
    with open(os.path.join(d, "src1", "empty.md"), "wb") as f:
        f.write(b"")
    with open(os.path.join(d, "src1", "bad.txt"), "wb") as f:
        f.write(b"ok \xff\xfe end\n")
    files = scan_files(spark, d)
    got = {r.name: r for r in files.collect()}
    assert got["a.py"].lines == ["x = 1", "y = 2"] and got["a.py"].status == "ok"
    assert got["bin.dat"].status == "binary" and got["bin.dat"].total_lines == 0
    assert got["u16.txt"].status == "ok"
    # Spark's file scan skips 0-byte files: an empty file yields no row (it would have 0 lines).
    assert "empty.md" not in got
    assert got["bad.txt"].lines == ["ok �� end"]
    roots = spark.createDataFrame([(os.path.join(d, "src1"),)], "root string")
    kept = {r.name for r in confine_paths(files, roots).collect()}
    assert kept == {"a.py", "u16.txt", "bad.txt"}


def test_scan_pages_rejects_large_bodies(spark):
    d = tempfile.mkdtemp(prefix="tessera-pages-")
    big = "a" * (5 * 1024 * 1024 + 1)
    spark.createDataFrame([(1, "https://A.example:443/x?y#z", "<p>hi</p>"), (2, "http://b.example", big)],
                          "page_id long, url string, html string").write.parquet(f"{d}/p")
    acc, rej = scan_pages(spark, f"{d}/p")
    a = acc.collect()
    assert [(r.site, r.path) for r in a] == [("https://a.example", "/x")]
    assert [(r.page_id, r.reason, r.path) for r in rej.collect()] == [(2, "too_large", "/")]


def test_site_map_sink_round_trip(spark):
    d = tempfile.mkdtemp(prefix="tessera-maps-")
    df = spark.createDataFrame([("https://a.example", 3, ["/api/x"])], "site string, pages_scanned int, api_hints array<string>")
    write_site_maps(df, f"{d}/maps")
    lines = [l for p in os.listdir(f"{d}/maps") if p.endswith(".json") for l in open(f"{d}/maps/{p}")]
    assert [json.loads(l) for l in lines] == [{"site": "https://a.example", "pages_scanned": 3, "api_hints": ["/api/x"]}]


def test_site_map_sink_hash_buckets(spark):
    d = tempfile.mkdtemp(prefix="tessera-maps-b-")
    df = spark.createDataFrame([(f"https://s{i}.example", i) for i in range(20)], "site string, pages_scanned int")
    write_site_maps(df, f"{d}/maps", buckets=4)
    back = spark.read.json(f"{d}/maps")
    assert back.count() == 20 and back.select("bucket").distinct().count() <= 4


def test_scan_pages_from_json_lines(spark):
    d = tempfile.mkdtemp(prefix="tessera-pages-json-")
    with open(f"{d}/p.json", "w") as f:
        f.write(json.dumps({"page_id": 7, "url": "http://x.example/a", "html": "<p>x</p>"}) + "\n")
    acc, rej = scan_pages(spark, d, fmt="json")
    assert [(r.page_id, r.site, r.path) for r in acc.collect()] == [(7, "http://x.example", "/a")] and rej.count() == 0
