"""More joins, aggregates, windows, ordered unions and record checks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.operators import revisions, state, usage
from folio.operators.scope import under
from folio.plans.reading import R1, views
from folio.tables import table


def j3_keep_all(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"), F.count(F.lit(1)).alias("n"))
    c = table(spark, sf_dir, "customer")
    return c.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "last", F.coalesce("n", F.lit(0)).alias("n"))


J3 = "SELECT c_custkey, max(o_orderdate) AS last, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"


def j6_first_line(spark, sf_dir):
    """The first line of each order; orders without one drop out."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("x"))
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return o.join(first, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "x.l_linenumber", "x.l_partkey", "x.l_suppkey")


J6 = """SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey
 QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1"""


def j9_exists_or(spark, sf_dir):
    """Customers in debt or with an order of more than 400,000."""
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("big")).distinct()
    c = table(spark, sf_dir, "customer").join(big, "c_custkey", "left")
    return c.filter((F.col("c_acctbal") < 0) | F.col("big")).select("c_custkey", "c_name")


J9 = "SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"


def j15_prefix_ranges(spark, sf_dir):
    """Pages under one of some tops: they meet by the first step of their paths, then by the whole prefix."""
    tops = spark.createDataFrame([("/fr",), ("/en",), ("/de/1",)], "top string").withColumn("step", F.split_part("top", F.lit("/"), F.lit(2)))
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/?#]+([^?#]*)", 1).alias("path")).withColumn("step", F.split_part("path", F.lit("/"), F.lit(2)))
    return pages.join(tops, "step").filter(under(F.col("path"), F.col("top"))).groupBy("top").agg(F.count(F.lit(1)).alias("n"))


J15 = """WITH p AS (SELECT regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages), t(top) AS (VALUES ('/fr'), ('/en'), ('/de/1'))
SELECT top, count(*) AS n FROM p JOIN t ON path = top OR starts_with(path, top || '/') GROUP BY 1"""


def j17_two_roles(spark, sf_dir):
    """Revenue between the nations of supplier and customer."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("from_nation"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("to_nation"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(c, "o_custkey")
    n = table(spark, sf_dir, "nation")
    sums = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(s, "l_suppkey").join(o, "l_orderkey").groupBy("from_nation", "to_nation").agg(F.sum("l_quantity").alias("quantity"))
    source, target = n.select(F.col("n_nationkey").alias("from_nation"), F.col("n_name").alias("source")), n.select(F.col("n_nationkey").alias("to_nation"), F.col("n_name").alias("target"))
    return sums.join(source, "from_nation").join(target, "to_nation").select("source", "target", "quantity")


J17 = """SELECT a.n_name AS source, b.n_name AS target, sum(l_quantity) AS quantity FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
 JOIN customer ON c_custkey = o_custkey JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey GROUP BY 1, 2"""


def j20_resolved(spark, sf_dir):
    """Each distinct part named by an event, found or unknown."""
    refs = table(spark, sf_dir, "events").select((F.col("user_id") * 37).alias("p_partkey")).distinct()
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.lit(True).alias("known"))
    return refs.join(parts, "p_partkey", "left").select("p_partkey", "p_name", F.coalesce("known", F.lit(False)).alias("known"))


J20 = "SELECT r.k AS p_partkey, p_name, p_partkey IS NOT NULL AS known FROM (SELECT DISTINCT user_id * 37 AS k FROM events) r LEFT JOIN part ON p_partkey = r.k"


def j23_set_equality(spark, sf_dir):
    """Orders whose numbers of lines are exactly 1 to n, and the first thing wrong with the others."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_linenumber").alias("d"), F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b"))
    code = F.when(F.col("n") != F.col("d"), "DUPLICATE").when(F.col("a") != 1, "NO_FIRST").when(F.col("b") != F.col("d"), "GAP").otherwise("EQUAL")
    return lines.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("orders"))


J23 = """SELECT CASE WHEN n != d THEN 'DUPLICATE' WHEN a != 1 THEN 'NO_FIRST' WHEN b != d THEN 'GAP' ELSE 'EQUAL' END AS code, count(*) AS orders FROM
 (SELECT count(*) AS n, count(DISTINCT l_linenumber) AS d, min(l_linenumber) AS a, max(l_linenumber) AS b FROM lineitem GROUP BY l_orderkey) GROUP BY 1"""


def a13_run_status(spark, sf_dir):
    """Each customer's orders by status, and one status for all of them."""
    t = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(*[F.count_if(F.col("o_orderstatus") == s).alias(s.lower()) for s in "FOP"])
    status = F.when((F.col("o") == 0) & (F.col("p") == 0), "succeeded").when(F.col("f") == 0, "failed").otherwise("partial")
    return t.withColumn("status", status)


A13 = """SELECT o_custkey, f, o, p, CASE WHEN o = 0 AND p = 0 THEN 'succeeded' WHEN f = 0 THEN 'failed' ELSE 'partial' END AS status FROM (SELECT o_custkey,
 count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1)"""


def a15_children(spark, sf_dir):
    """Customers and suppliers of each nation, where their numbers differ."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    both = c.join(s, "nation", "full_outer").select("nation", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))
    return both.filter("customers <> suppliers")


A15 = """WITH c AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY 1)
SELECT nation, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM c FULL JOIN s USING (nation) WHERE coalesce(c.n, 0) <> coalesce(s.n, 0)"""


def a16_ratio(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(F.col("l_quantity") * F.col("l_discount")).alias("a"), F.sum("l_quantity").alias("b"))
    return li.select("l_returnflag", F.round(usage.share(F.col("a"), F.col("b")), 6).alias("rate"))


A16 = "SELECT l_returnflag, round(sum(l_quantity * l_discount) / nullif(sum(l_quantity), 0), 6) AS rate FROM lineitem GROUP BY 1"


def a23_counters(spark, sf_dir):
    """One row of the sizes of several tables: each is one row before the join."""
    one = None
    for name in ("customer", "orders", "events", "documents"):
        n = table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias(name)).withColumn("_one", F.lit(1))
        one = n if one is None else one.join(n, "_one")
    return one.drop("_one")


A23 = "SELECT (SELECT count(*) FROM customer) AS customer, (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM documents) AS documents"


def a26_having(spark, sf_dir):
    found = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("role").alias("roles"))
    return found.filter("turns >= 4")


A26 = "SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles FROM conversations GROUP BY 1 HAVING count(*) >= 4"


def w3_previous_sibling(spark, sf_dir):
    before = F.lag("c_custkey").over(Window.partitionBy("c_nationkey").orderBy("c_name", "c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", before.alias("previous"))


W3 = "SELECT c_custkey, lag(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) AS previous FROM customer"


def w8_title_suffix(spark, sf_dir):
    """Titles of a brand's parts, repeated ones numbered from the second."""
    number = F.row_number().over(Window.partitionBy("p_brand", "p_name").orderBy("p_partkey"))
    p = table(spark, sf_dir, "part").withColumn("n", number)
    return p.select("p_partkey", F.when(F.col("n") > 1, F.concat_ws("-", "p_name", F.col("n").cast("string"))).otherwise(F.col("p_name")).alias("title"))


W8 = "SELECT p_partkey, CASE WHEN n > 1 THEN p_name || '-' || n ELSE p_name END AS title FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS n FROM part)"


def o5_priority_first(spark, sf_dir):
    """Of each customer one order: the most urgent, the earliest of several."""
    rank = F.when(F.startswith("o_orderpriority", F.lit("1")), 0).when(F.startswith("o_orderpriority", F.lit("2")), 1).otherwise(2)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(rank, F.col("o_orderdate"), F.col("o_orderkey"))).alias("o_orderkey"))


O5 = """SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey
 ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 2 END, o_orderdate, o_orderkey) = 1"""


def u4_ordered_union(spark, sf_dir):
    """Ten suggestions at most: brands of parts, then names, then types, each label once at its first source."""
    p = table(spark, sf_dir, "part")
    parts = [p.select(F.col(c).alias("label"), F.lit(i).alias("source")).filter(F.contains("label", F.lit("r"))) for i, c in enumerate(("p_brand", "p_name", "p_type"))]
    first = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("label").agg(F.min("source").alias("source"))
    return first.orderBy("source", "label").limit(10)


U4 = """SELECT label, min(source) AS source FROM (SELECT p_brand AS label, 0 AS source FROM part UNION ALL SELECT p_name, 1 FROM part UNION ALL SELECT p_type, 2 FROM part)
 WHERE label LIKE '%r%' GROUP BY 1 ORDER BY 2, 1 LIMIT 10"""


def v5_revision_pairs(spark, sf_dir):
    """Adjacent orders of a customer, and the oldest with the newest where there are at least three."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders")
    near = o.select("o_custkey", F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(by).alias("b"), F.lit("adjacent").alias("kind")).filter("b is not null")
    order = F.struct("o_orderdate", "o_orderkey")
    far = o.groupBy("o_custkey").agg(F.min_by("o_orderkey", order).alias("a"), F.max_by("o_orderkey", order).alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 2")
    return near.unionByName(far.select("o_custkey", "a", "b", F.lit("ends").alias("kind")))


V5 = """WITH x AS (SELECT o_custkey, o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders)
SELECT o_custkey, a, b, 'adjacent' AS kind FROM x WHERE b IS NOT NULL UNION ALL
SELECT o_custkey, min((o_orderdate, o_orderkey))[2], max((o_orderdate, o_orderkey))[2], 'ends' FROM orders GROUP BY 1 HAVING count(*) > 2"""


def v8_gate(spark, sf_dir):
    """Checks of texts and lines, and whether they may be published."""
    docs, orders, lines = (table(spark, sf_dir, t) for t in ("documents", "orders", "lineitem"))
    found = [
        revisions.findings(docs.filter("text is null or trim(text) = ''"), "EMPTY", F.col("doc_id"), F.col("n_chars")),
        revisions.findings(docs.filter(F.col("text").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")), "CONTROL", F.col("doc_id"), F.col("lang")),
        revisions.orphans(lines, "l_linenumber", "l_orderkey", orders, "o_orderkey", "ORPHAN"),
        revisions.duplicates(lines, ["l_orderkey", "l_linenumber"], "REPEATED"),
    ]
    return revisions.gate(revisions.all_findings(found), ["ORPHAN", "CONTROL"])


V8 = """WITH f AS (SELECT 'EMPTY' AS code FROM documents WHERE text IS NULL OR trim(text) = '' UNION ALL SELECT 'CONTROL' FROM documents WHERE regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')
 UNION ALL SELECT 'ORPHAN' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'REPEATED' FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
SELECT count(*) FILTER (code IN ('ORPHAN', 'CONTROL')) AS errors, count(*) FILTER (code NOT IN ('ORPHAN', 'CONTROL')) AS warnings,
 count(*) FILTER (code IN ('ORPHAN', 'CONTROL')) = 0 AND count(*) FILTER (code NOT IN ('ORPHAN', 'CONTROL')) <= 10 AS publish FROM f"""


def v12_range_resolution(spark, sf_dir):
    """Orders by a customer and price: found once, more often or not at all."""
    wanted = table(spark, sf_dir, "customer").select("c_custkey", (F.floor("c_acctbal") * 20).alias("wanted"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    hit = F.when(F.abs(F.col("o_totalprice") - F.col("wanted")) < 20000, F.col("o_orderkey"))
    found = wanted.join(o, "c_custkey", "left").groupBy("c_custkey").agg(F.count(hit).alias("matches"), F.min(hit).alias("first"), F.max(hit).alias("last"))
    return found.withColumn("outcome", F.when(F.col("matches") == 0, "NOT_FOUND").when(F.col("matches") > 1, "AMBIGUOUS").otherwise("RESOLVED"))


V12 = """WITH m AS (SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND abs(o_totalprice - floor(c_acctbal)::BIGINT * 20) < 20000)
SELECT c_custkey, count(o_orderkey) AS matches, min(o_orderkey) AS first, max(o_orderkey) AS last,
 CASE count(o_orderkey) WHEN 0 THEN 'NOT_FOUND' WHEN 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS outcome FROM m GROUP BY 1"""


def v16_swapped(spark, sf_dir):
    """Customers' nations moved where the stated one is what they have."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("current"))
    moved = F.col("current") + F.when(F.col("id") % 4 == 0, 1).otherwise(0)
    wanted = c.filter("id % 2 = 0").select("id", moved.alias("expected"), F.lit(99).alias("next"))
    return state.swapped(c, wanted)


V16 = """SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 2 THEN 99 ELSE c_nationkey END AS current,
 CASE WHEN c_custkey % 2 != 0 THEN 'kept' WHEN c_custkey % 4 = 0 THEN 'conflict' ELSE 'moved' END AS outcome FROM customer"""


def r6_additive_merge(spark, sf_dir):
    """Counts of pairs of both halves of the users added up."""
    v = views(spark, sf_dir)
    return usage.merged_counts(usage.cooccurrences(v.filter("user % 2 = 0")), usage.cooccurrences(v.filter("user % 2 <> 0")))


def r14_active_keys(spark, sf_dir):
    """Condition keys of parts that are set, as rows."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_type")).alias("type"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).alias("brand"))
    return p.unpivot("p_partkey", ["type", "brand"], "key", "value").filter("value is not null")


R14 = "SELECT p_partkey, 'type' AS key, p_type AS value FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, 'brand', p_brand FROM part WHERE p_partkey % 3 = 0"


def m3_increment(spark, sf_dir):
    """Counters of users after one more batch is added."""
    ev = table(spark, sf_dir, "events")
    old = ev.filter("event_type = 'view'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    new = ev.filter("event_type = 'click'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return old.unionByName(new).groupBy("user_id").agg(F.sum("n").alias("n"))


M3 = "SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1"


def m5_publish_once(spark, sf_dir):
    """Finished orders get a date of publication where they have none."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderdate")).alias("published"))
    return state.set_once(o, "published", F.lit("2000-01-01").cast("timestamp_ntz"), F.col("o_orderstatus") == "F").select("o_orderkey", "published")


M5 = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate WHEN o_orderstatus = 'F' THEN TIMESTAMP '2000-01-01' END AS published FROM orders"

_NAMES = (
    "j3_keep_all", "j6_first_line", "j9_exists_or", "j15_prefix_ranges", "j17_two_roles", "j20_resolved", "j23_set_equality", "a13_run_status", "a15_children", "a16_ratio", "a23_counters",
    "a26_having", "w3_previous_sibling", "w8_title_suffix", "o5_priority_first", "u4_ordered_union", "v5_revision_pairs", "v8_gate", "v12_range_resolution", "v16_swapped", "r14_active_keys",
    "m3_increment", "m5_publish_once",
)
QUERIES = {n: globals()[n] for n in _NAMES} | {"r6_additive_merge": r6_additive_merge}
ORACLES = {n: globals()[n.split("_")[0].upper()] for n in _NAMES} | {"r6_additive_merge": R1}
