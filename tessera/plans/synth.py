"""Documents synthesised in Spark from the test tables, so that the expected
answer is known from the base rows (customer, nation, orders, lineitem).

Every builder is a plain DataFrame job (join, grouping, ordered collect) and
grows with its source tables. The DuckDB oracle builds the same texts from
the same rows; see ``tessera.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Id ranges of the synthesised documents (far above the test tables' ids).
SYNTH_PAGE_BASE = 1_000_000_000_000
BLOCK = 100


def _block() -> Column:
    """Customers are grouped by nation and by blocks of 100 keys, so every
    synthesised document has a bounded size however large the tables grow."""
    return F.floor(F.col("c_custkey") / BLOCK).cast("long")


def _ordered_join(key: Column, piece: Column, sep: str = "") -> Column:
    """Aggregate: pieces joined in key order (ordered collect, then join)."""
    return F.array_join(F.sort_array(F.collect_list(F.struct(key.alias("k"), piece.alias("v"))))["v"], sep)


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, items): each order's lineitems in order. Every builder of sources
    takes its pieces from these numbers, so one exchange serves them all. Its parts are as
    many as the session's: few bytes here become much work on the sources' lines, and
    parts joined up by their bytes would leave cores idle."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    li = li.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    return li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("items"))


def _customer_blocks(spark: SparkSession, customer: DataFrame) -> DataFrame:
    """Customers with n_nationkey and blk, each block in one of as many parts as the session's
    (see ``order_lines``: few bytes here become much work on the documents)."""
    keyed = customer.withColumnRenamed("c_nationkey", "n_nationkey").withColumn("blk", _block())
    return keyed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "n_nationkey", "blk")


def synth_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per nation and block of customer keys: header with h1, nav, a sidebar menu, an h2 with
    an anchor per customer, a form per customer (named, hidden and id-only
    inputs, a button with data-href), a script with an API call, a search
    input and links of every resolver shape. Columns: page_id, url, html."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey").cast("string")
    piece = F.concat(
        F.lit('<h2 id="c'), k, F.lit('">Customer '), F.col("c_name"), F.lit("</h2><p>Segment "),
        F.col("c_mktsegment"), F.lit(". Please log in to see more.</p>"),
        F.lit('<form action="/api/customer/'), k, F.lit('" method="post"><input name="qty_'), k,
        F.lit('" type="text"><input type="hidden" name="token"><input id="note_'), k,
        F.lit('"><button data-href="/c/'), k, F.lit('">Open '), k, F.lit("</button></form>"))
    customer = customer.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    per_block = _customer_blocks(spark, customer).groupBy("n_nationkey", "blk").agg(
        _ordered_join(F.col("c_custkey"), piece).alias("body"))
    n = F.col("n_nationkey").cast("string")
    host = F.concat(F.lit("n"), n, F.lit(".synth.example"))
    html = F.concat(
        F.lit("<html><head><title>"), F.col("n_name"), F.lit(" &amp; friends</title><script>fetch(\"/api/nation/"), n,
        F.lit("?full=1\");</script></head><body><header class=\"site-header\"><h1 id=\"top\">Nation "),
        F.col("n_name"), F.lit("</h1><nav><a href=\"/\">Home</a> <a href=\"#c-list\">Customers</a></nav></header>"),
        F.lit("<div class=\"sidebar-menu\"><a href=\"../up/\">Up</a></div><main><p>Intro for "), F.col("n_name"),
        F.lit(" &mdash; region "), F.col("n_regionkey").cast("string"), F.lit(".</p>"),
        F.col("body"),
        F.lit("<p><a href=\"?page=2\">Next</a> <a href=\"other.html\">Other</a> "
              "<a href=\"https://elsewhere.example/x\">Off</a> <a href=\"//"), host,
        F.lit("/abs/./x/../y\">Abs</a> <a href=\"mailto:x@y\">Mail</a> <a href=\"#c-list\">Top</a></p>"),
        F.lit("<input type=\"search\" placeholder=\"Search "), F.col("n_name"),
        F.lit("\"></main><footer>&copy; synth</footer></body></html>"))
    return per_block.join(nation, "n_nationkey").select(
        (F.lit(SYNTH_PAGE_BASE) + F.col("blk") * 100 + F.col("n_nationkey")).cast("long").alias("page_id"),
        F.concat(F.lit("https://"), host, F.lit("/nation/"), n, F.lit("/"), F.col("blk").cast("string"),
                 F.lit(".html")).alias("url"),
        html.alias("html"))


def web_corpus(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """The crawled pages plus the synthesised nation pages. With ``spread`` the crawled ones
    are dealt by id into as many parts as the session's: a task that reads them takes whole
    row groups, which hold few bytes to a scan but much work to the page operators."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    if spread:
        pages = pages.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page_id")
    return pages.unionByName(synth_html(spark, sf_dir))


PY_FILE_BASE = 1_000_000_000_000
TS_FILE_BASE = 2_000_000_000_000
MD_FILE_BASE = 3_000_000_000_000


def synth_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Python module per order: a class named by the order key whose
    docstring holds a fake def, one two-line method per lineitem (blank line
    after each), and, for every third order key, a one-line def."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")

    def method(x: Column) -> Column:
        ln = x["l_linenumber"].cast("string")
        return F.concat(F.lit("    def line_"), ln, F.lit("(self, part="), x["l_partkey"].cast("string"),
                        F.lit("):\n        return part * "), ln, F.lit("\n\n"))
    methods = order_lines(spark, sf_dir)
    k = F.col("o_orderkey").cast("string")
    text = F.concat(
        F.lit("import os\n\n\nclass Order"), k, F.lit(':\n    """Order '), k, F.lit(" of customer "),
        F.col("o_custkey").cast("string"), F.lit(".\n\n    def fake_"), k,
        F.lit('(self):\n        return None\n    """\n\n'), F.coalesce(F.array_join(F.transform("items", method), ""), F.lit("")),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("def total_"), k, F.lit("(): return "), k, F.lit("\n")))
        .otherwise(F.lit("")))
    # merged part by part: a broadcast would leave the texts to the few parts of the orders
    return orders.join(methods.hint("merge"), "o_orderkey", "left").select(
        (F.lit(PY_FILE_BASE) + F.col("o_orderkey")).cast("long").alias("file_id"),
        F.concat(F.lit("synth/py/order_"), k, F.lit(".py")).alias("path"), text.alias("text"))


def synth_typescript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One TypeScript file per order: an exported class with one method per
    lineitem, then an exported expression arrow function."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")

    def method(x: Column) -> Column:
        ln = x["l_linenumber"].cast("string")
        return F.concat(F.lit("  line"), ln, F.lit("(part: number): number {\n    return part * "), ln,
                        F.lit(";\n  }\n"))
    methods = order_lines(spark, sf_dir)
    k = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("export class Order"), k, F.lit(" {\n"), F.coalesce(F.array_join(F.transform("items", method), ""), F.lit("")),
                    F.lit("}\n\nexport const total"), k, F.lit(" = (x: number) => x * "), k, F.lit(";\n"))
    # merged part by part: a broadcast would leave the texts to the few parts of the orders
    return orders.join(methods.hint("merge"), "o_orderkey", "left").select(
        (F.lit(TS_FILE_BASE) + F.col("o_orderkey")).cast("long").alias("file_id"),
        F.concat(F.lit("synth/ts/order_"), k, F.lit(".ts")).alias("path"), text.alias("text"))


def synth_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Markdown file per nation and block of customer keys: h1 for the nation, h2 per customer, and
    a fenced block per customer holding a '#' line that is not a heading."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    ck = F.col("c_custkey").cast("string")
    piece = F.concat(F.lit("## Customer "), ck, F.lit("\n```\n# not a heading "), ck, F.lit("\n```\n"))
    body = _customer_blocks(spark, customer.select("c_custkey", "c_nationkey")).groupBy("n_nationkey", "blk").agg(
        _ordered_join(F.col("c_custkey"), piece).alias("body"))
    n = F.col("n_nationkey").cast("string")
    return body.join(nation, "n_nationkey").select(
        (F.lit(MD_FILE_BASE) + F.col("blk") * 100 + F.col("n_nationkey")).cast("long").alias("file_id"),
        F.concat(F.lit("synth/md/nation_"), n, F.lit("_"), F.col("blk").cast("string"), F.lit(".md")).alias("path"),
        F.concat(F.lit("# Nation "), F.col("n_name"), F.lit("\n\n"), F.col("body")).alias("text"))


def file_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, path, text): the documents as text files plus the
    synthesised Python, TypeScript and Markdown sources."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("file_id"),
        F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        "text")
    return (docs.unionByName(synth_python(spark, sf_dir)).unionByName(synth_typescript(spark, sf_dir))
            .unionByName(synth_markdown(spark, sf_dir)))


LINK_PAGE_BASE = 2_000_000_000_000


def synth_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer pages grouped into one site per nation and block of customer
    keys: page /c/{i} (i = the customer's rank in its site) links to /c/{2i}, /c/{2i+1}, a missing
    /gone/{i} and /c/{2i} again. Columns: page_id, url, html."""
    from pyspark.sql import Window
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    c = _customer_blocks(spark, c.select("c_custkey", "c_name", "c_nationkey")).withColumnRenamed("n_nationkey", "c_nationkey")
    c = c.withColumn("i", F.row_number().over(Window.partitionBy("c_nationkey", "blk").orderBy("c_custkey")))
    i = F.col("i")
    html = F.concat(
        F.lit("<html><head><title>C"), i.cast("string"), F.lit(" "), F.col("c_name"),
        F.lit("</title></head><body><p>Customer "), F.col("c_name"), F.lit("</p><a href=\"/c/"), (2 * i).cast("string"),
        F.lit("\">left</a> <a href=\"/c/"), (2 * i + 1).cast("string"), F.lit("\">right</a> <a href=\"/gone/"),
        i.cast("string"), F.lit("\">gone</a> <a href=\"/c/"), (2 * i).cast("string"), F.lit("\">again</a></body></html>"))
    return c.select((F.lit(LINK_PAGE_BASE) + F.col("c_custkey")).cast("long").alias("page_id"),
                    F.concat(F.lit("https://s"), F.col("c_nationkey").cast("string"), F.lit("-"), F.col("blk").cast("string"),
                             F.lit(".links.example/c/"), i.cast("string")).alias("url"), html.alias("html"))


def synth_link_hops(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(starts, hops) of the linked sites' missing paths: two of three /gone/{i}
    redirect, one to /c/{4i} by way of /moved/{i}, one to another site."""
    pages = synth_links(spark, sf_dir).select("page_id", F.regexp_extract("url", "^(.*)/c/", 1).alias("site"),
                                              F.regexp_extract("url", "/c/([0-9]+)$", 1).cast("long").alias("i"))
    i, gone = F.col("i"), F.concat("site", F.lit("/gone/"), F.col("i").cast("string"))
    to = (F.when(i % 3 == 0, F.concat(F.lit("/moved/"), i.cast("string")))
          .when(i % 3 == 1, F.concat(F.lit("https://elsewhere.example/g/"), i.cast("string"))))
    first = pages.select(F.col("page_id").alias("start_id"), gone.alias("url"), to.alias("location")).where(F.col("location").isNotNull())
    second = pages.where(i % 3 == 0).select(F.concat("site", F.lit("/moved/"), i.cast("string")).alias("url"),
                                            F.concat(F.lit("/c/"), (4 * i).cast("string")).alias("location"))
    return first.select("start_id", "url"), first.select("url", "location").unionByName(second)


def synth_redirects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(starts, hops) from customer keys: in groups of 8 consecutive keys each
    URL redirects to the next one (a relative location); the last of every
    third group redirects off-site."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    k = F.col("c_custkey")
    g = F.floor((k - 1) / 8).cast("long")
    pos = ((k - 1) % 8).cast("int")
    url = F.concat(F.lit("https://r"), g.cast("string"), F.lit(".redir.example/c/"), k.cast("string"))
    starts = c.select(k.alias("start_id"), url.alias("url"))
    loc = (F.when(pos < 7, F.concat(F.lit("/c/"), (k + 1).cast("string")))
           .when(g % 3 == 0, F.concat(F.lit("https://elsewhere.example/x/"), k.cast("string"))))
    hops = c.select(url.alias("url"), loc.alias("location")).where(F.col("location").isNotNull())
    return starts, hops


def synth_hosts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(urls, allow-list) from customer keys: dotted quads built from the key
    (some reserved), some with a port, some ftp:, some IPv6 forms, some
    names; the allow-list holds the host[:port] of one market segment."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    k = F.col("c_custkey")
    quad = F.concat_ws(".", ((k * 37) % 256).cast("string"), ((k * 11) % 256).cast("string"),
                       (k % 256).cast("string"), ((k * 7) % 256).cast("string"))
    o1, o2, o3, o4 = (k * 37) % 256, (k * 11) % 256, k % 256, (k * 7) % 256
    number = o1 * 16777216 + o2 * 65536 + o3 * 256 + o4
    # the same address as a number, in hex, with a final dot, in two parts, percent-coded, or in all eight groups
    spelled = (F.when(k % 6 == 0, number.cast("string")).when(k % 6 == 1, F.concat(F.lit("0x"), F.lower(F.hex(number))))
               .when(k % 6 == 2, F.concat(quad, F.lit(".")))
               .when(k % 6 == 3, F.concat(o1.cast("string"), F.lit("."), (o2 * 65536 + o3 * 256 + o4).cast("string")))
               .when(k % 6 == 4, F.replace(quad, F.lit("."), F.lit("%2E")))
               .otherwise(F.concat(F.lit("[0:0:0:0:0:ffff:"), F.lower(F.hex(o1 * 256 + o2)), F.lit(":"), F.lower(F.hex(o3 * 256 + o4)), F.lit("]"))))
    host = (F.when(k % 17 == 0, F.concat(F.lit("host"), k.cast("string"), F.lit(".example")))
            .when(k % 13 == 0, F.lit("[fe80::1]"))
            .when(k % 11 == 0, F.concat(F.lit("[::ffff:"), quad, F.lit("]")))
            .when(k % 19 == 0, spelled)
            .otherwise(quad))
    port = F.when(k % 5 == 0, F.lit(":8080")).otherwise(F.lit(""))
    scheme = F.when(k % 7 == 0, F.lit("ftp")).otherwise(F.lit("http"))
    slashes = F.when(k % 23 == 0, F.lit(":/")).when(k % 29 == 0, F.lit(":\\\\")).otherwise(F.lit("://"))
    urls = c.select(k.alias("url_id"), F.concat(scheme, slashes, host, port, F.lit("/p")).alias("url"))
    # The allow-list names the host (and port, when the URL has one) of every
    # customer in one market segment.
    allow = c.where(F.col("c_mktsegment") == "BUILDING").select(F.concat(host, port).alias("entry")).distinct()
    return urls, allow
