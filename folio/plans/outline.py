"""Scopes, pages and regrouping of trees; validity, snapshots and refresh of versions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.operators import pointers, refresh, temporal, tree, tree_index
from folio.plans.reading import _TREE, H16, h16_chains, indexed
from folio.tables import table


def _level(c):
    return F.left(c, F.lit(1))


def h4_nearest_scope(spark, sf_dir):
    return tree.nearest_scope(indexed(spark, sf_dir), _level(F.col("id")), ["n", "r"])


H4 = _TREE + "SELECT id, CASE WHEN depth < 2 THEN id ELSE ancestors[2] END AS scope FROM t"


def h7_root_numbers(spark, sf_dir):
    heads = indexed(spark, sf_dir).filter("depth = 1")
    totals = heads.groupBy("root").agg(F.max("number").alias("total"))
    return heads.select("root", F.col("id").alias("head"), "number").join(totals, "root")


_NUMBERED = "SELECT root, id AS head, row_number() OVER (PARTITION BY root ORDER BY path, id) AS number, count(*) OVER (PARTITION BY root) AS total FROM t WHERE depth = 1"
H7 = _TREE + _NUMBERED


def h9_window(spark, sf_dir):
    return tree_index.around(indexed(spark, sf_dir), 1, 3, 1)


H9 = _TREE + f", h AS ({_NUMBERED}) SELECT *, 1::INT AS before, CASE WHEN total > 4 THEN 5::INT END AS after FROM h WHERE number BETWEEN 2 AND 4"


def h11_contents(spark, sf_dir):
    t = indexed(spark, sf_dir)
    return tree_index.pruned(t, _level(F.col("id")), ["r", "n"], _level).select("id", "parent", "depth")


H11 = _TREE + "SELECT id, parent, depth FROM t WHERE depth < 2"


def h13_regrouped(spark, sf_dir):
    """Customers whose number ends in 7 move below a new node of their nation."""
    t = tree.regrouped(indexed(spark, sf_dir), F.col("id").rlike("^c.*7$"), "g:", 1_000_000_000)
    return t.select("id", "parent", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


H13 = _TREE + """, m AS (SELECT id, parent, array_to_string(path[:-2], '/') || '/1000000000' AS above, row_number() OVER (PARTITION BY parent ORDER BY path, id) AS n FROM t WHERE id LIKE 'c%7')
SELECT id, parent, array_to_string(path, '/') AS path FROM t WHERE NOT id LIKE 'c%7'
UNION ALL SELECT DISTINCT 'g:' || parent, parent, above FROM m UNION ALL SELECT id, 'g:' || parent, above || '/' || n FROM m"""


def h10_document_index(spark, sf_dir):
    """The whole tree in document order, each node with the interval of what is below it."""
    return indexed(spark, sf_dir).select("id", "root", "depth", "first", "last", "number")


H10 = _TREE + """, o AS (SELECT *, row_number() OVER (ORDER BY root, path, id) AS first, row_number() OVER (PARTITION BY root, depth ORDER BY path, id) AS number FROM t),
b AS (SELECT a AS id, count(*) AS n FROM (SELECT unnest(ancestors) AS a FROM t) GROUP BY 1)
SELECT o.id, root, depth, first, first + coalesce(n, 0) AS last, number FROM o LEFT JOIN b ON b.id = o.id"""


def h16_routes(spark, sf_dir):
    """Parts as articles, every fourth size in force, that point at the half of their key; asked for by the lines of orders."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    to = F.when(key == 3, 5).when(key == 5, 3).when(key % 50 != 0, F.floor(key / 2))
    mapping = p.select(key.alias("from_id"), to.cast("long").alias("to_id"), F.when(key % 7 == 0, "ambiguous").otherwise("unique").alias("status"))
    asked = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_suppkey") % 40 == 0, F.col("l_partkey") + 10_000_000).otherwise(F.col("l_partkey")).alias("id")).distinct()
    return pointers.routes(asked, p.select(key.alias("id"), (F.col("p_size") % 4 == 0).alias("current")), mapping)


H16_ROUTES = """WITH RECURSIVE art AS (SELECT p_partkey AS id, p_size % 4 = 0 AS cur FROM part),
map AS (SELECT p_partkey AS f, CASE WHEN p_partkey = 3 THEN 5 WHEN p_partkey = 5 THEN 3 WHEN p_partkey % 50 != 0 THEN p_partkey // 2 END AS t, p_partkey % 7 = 0 AS amb FROM part),
asked AS (SELECT DISTINCT CASE WHEN l_suppkey % 40 = 0 THEN l_partkey + 10000000 ELSE l_partkey END AS id FROM lineitem),
w AS (SELECT asked.id AS start, asked.id AS pos, CASE WHEN art.id IS NULL THEN 'missing' WHEN cur THEN 'current' END AS o, 0 AS hops FROM asked LEFT JOIN art ON art.id = asked.id
 UNION ALL SELECT start, t, CASE WHEN f IS NULL THEN 'unmapped' WHEN amb THEN 'ambiguous' WHEN t IS NULL THEN 'removed' WHEN art.id IS NULL THEN 'unmapped' WHEN cur THEN 'redirect' WHEN hops >= 119 THEN 'cycle' END, hops + 1
 FROM w LEFT JOIN map ON f = w.pos LEFT JOIN art ON art.id = t WHERE o IS NULL)
SELECT start AS id, CASE WHEN o IN ('unmapped', 'ambiguous') THEN 'historical' ELSE o END AS outcome, CASE WHEN o IN ('current', 'redirect') THEN pos END AS target, CASE WHEN o IN ('unmapped', 'ambiguous') THEN o END AS reason
FROM w WHERE o IS NOT NULL"""


def h17_cycles(spark, sf_dir):
    return h16_chains(spark, sf_dir).filter("outcome = 'cycle'").select("start", "hops")


H17 = f"SELECT start, hops FROM ({H16}) WHERE outcome = 'cycle'"


def h18_matching_below(spark, sf_dir):
    t = tree_index.subtree(indexed(spark, sf_dir), "r1")
    return t.filter(F.contains("id", F.lit("7"))).select("id", "depth")


H18 = _TREE + "SELECT id, depth FROM t WHERE (id = 'r1' OR list_contains(ancestors, 'r1')) AND id LIKE '%7%'"


def h19_breadth_first(spark, sf_dir):
    return indexed(spark, sf_dir).select("root", "id", F.col("level_number").alias("number"))


H19 = _TREE + "SELECT root, id, row_number() OVER (PARTITION BY root ORDER BY depth, place, id) AS number FROM t"


def t1_validity(spark, sf_dir):
    start = F.when(F.col("o_orderstatus") == "F", F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(k) for k, c in temporal.validity(start).items()])


T1 = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE END AS valid_from, CASE WHEN o_orderstatus = 'F' THEN 'FIXED' ELSE 'UNDETERMINED' END AS state FROM orders"


def t4_applicable(spark, sf_dir):
    """A customer's pinned order, else the current one, else the one of a day."""
    order = F.struct("o_orderdate", "o_orderkey")
    day = F.lit("1995-06-01").cast("timestamp_ntz")
    picked = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.min(F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 300000), F.col("o_orderkey"))).alias("pinned"),
        F.max_by("o_orderkey", F.when(F.col("o_orderstatus") == "O", order)).alias("current"),
        F.max_by("o_orderkey", F.when(F.col("o_orderdate") <= day, order)).alias("as_of"),
    )
    found, source = temporal.first_applicable(pinned=F.col("pinned"), current=F.col("current"), as_of=F.col("as_of"))
    return picked.select("o_custkey", found.alias("o_orderkey"), source.alias("source"))


T4 = """WITH p AS (SELECT o_custkey, min(o_orderkey) FILTER (o_orderpriority = '1-URGENT' AND o_totalprice > 300000) AS a,
 max((o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'O') AS b, max((o_orderdate, o_orderkey)) FILTER (o_orderdate <= TIMESTAMP '1995-06-01') AS c FROM orders GROUP BY 1)
SELECT o_custkey, coalesce(a, b[2], c[2]) AS o_orderkey, CASE WHEN a IS NOT NULL THEN 'pinned' WHEN b IS NOT NULL THEN 'current' WHEN c IS NOT NULL THEN 'as_of' ELSE 'none' END AS source FROM p"""


def t5_live_intervals(spark, sf_dir):
    """Validity intervals that have a returned line, once each."""
    v = temporal.with_validity(table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate")), "o_custkey", "d", "o_orderkey")
    live = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return v.join(live, "o_orderkey", "left_semi").select("o_custkey", "valid_from", "valid_to").distinct()


T5 = """WITH v AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS valid_from, lead(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey) AS valid_to FROM orders)
SELECT DISTINCT o_custkey, valid_from, valid_to FROM v WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"""


def t6_same_node(spark, sf_dir):
    """Lines that the customer's next order has under the same number."""
    later = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    pairs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), later.alias("next_order")).filter("next_order is not null")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    other = lines.select(F.col("l_orderkey").alias("next_order"), "l_linenumber")
    return lines.join(pairs, "l_orderkey").join(other, ["next_order", "l_linenumber"]).select("l_orderkey", "l_linenumber", "next_order")


T6 = """WITH p AS (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_order FROM orders),
l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT a.l_orderkey, a.l_linenumber, next_order FROM l a JOIN p ON o_orderkey = a.l_orderkey JOIN l b ON b.l_orderkey = next_order AND b.l_linenumber = a.l_linenumber"""


def _day_text():
    return F.format_string("2024-%02d-%02d", F.col("event_id") % 14, F.col("user_id") % 33)


_DAY_SQL = "printf('2024-%02d-%02d', event_id % 14, user_id % 33)"


def t8_calendar_dates(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", temporal.calendar_date(_day_text()).alias("day"))


T8 = f"SELECT event_id, try_cast({_DAY_SQL} AS DATE) AS day FROM events"


def t10_snapshots(spark, sf_dir):
    """Snapshots made of an event's type, a day and a revision, with parts left out now and then."""
    def some(c, n):
        return F.when(F.col("event_id") % n != 0, c)
    error = temporal.snapshot_error(some(F.col("event_type"), 5), some(_day_text(), 5), some(F.col("user_id") % 3, 10), F.lit(1), ["view", "click", "signup"])
    return table(spark, sf_dir, "events").groupBy(F.coalesce(error, F.lit("VALID")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


T10 = f"""WITH s AS (SELECT CASE WHEN event_id % 5 != 0 THEN event_type END AS a, CASE WHEN event_id % 5 != 0 THEN {_DAY_SQL} END AS d, CASE WHEN event_id % 10 != 0 THEN user_id % 3 END AS r FROM events)
SELECT CASE WHEN a IS NULL AND d IS NULL AND r IS NULL THEN 'VALID' WHEN a IS NULL OR d IS NULL OR r IS NULL THEN 'INCOMPLETE' WHEN a NOT IN ('view', 'click', 'signup') THEN 'ANCHOR'
 WHEN try_cast(d AS DATE) IS NULL THEN 'DATE' WHEN r != 1 THEN 'REVISION' ELSE 'VALID' END AS error, count(*) AS n FROM s GROUP BY 1"""


def t12_history(spark, sf_dir):
    """Finished orders of each customer, newest first."""
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", F.row_number().over(order).alias("place"))


T12 = "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::INT AS place FROM orders WHERE o_orderstatus = 'F'"


def v18_refresh(spark, sf_dir):
    """Brands as documents of parts, against a snapshot that leaves out, changes, repeats and adds some."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("key"), F.col("p_type").alias("content"))
    number = F.expr("try_cast(substr(doc, 7) AS int)")
    kept = p.filter((number % 5 != 1) | (F.col("key") % 3 != 0)).filter((number % 5 != 2) | (F.col("key") % 40 != 0))
    changed = kept.withColumn("content", F.when((number % 5 != 0) & (F.col("key") % 7 == 0), F.concat("content", F.lit("+"))).otherwise(F.col("content")))
    return refresh.refreshed(p, changed.unionByName(p.filter((number % 5 == 4) & (F.col("key") % 90 == 0))))


V18 = """WITH a AS (SELECT p_brand AS doc, p_partkey AS key, p_type AS content, try_cast(substr(p_brand, 7) AS INT) % 5 AS m FROM part),
b AS (SELECT doc, key, CASE WHEN m != 0 AND key % 7 = 0 THEN content || '+' ELSE content END AS content FROM a WHERE (m != 1 OR key % 3 != 0) AND (m != 2 OR key % 40 != 0)
 UNION ALL SELECT doc, key, content FROM a WHERE m = 4 AND key % 90 = 0),
bk AS (SELECT doc, key, max(content) AS content, count(*) AS n FROM b GROUP BY 1, 2),
d AS (SELECT a.doc, count(*) AS nodes_before, coalesce(sum(n), 0)::BIGINT AS nodes_after, count(*) FILTER (n > 1) AS repeated, 0::BIGINT AS added, count(*) FILTER (n IS NULL) AS removed,
 count(*) FILTER (bk.content IS NOT NULL AND bk.content IS DISTINCT FROM a.content) AS modified FROM a LEFT JOIN bk ON bk.doc = a.doc AND bk.key = a.key GROUP BY 1),
p AS (SELECT *, CASE WHEN nodes_after = 0 THEN 'EMPTY' WHEN repeated > 0 THEN 'DUPLICATE_KEY' WHEN abs(nodes_after - nodes_before) > 0.2 * nodes_before THEN 'NODE_COUNT' END AS problem FROM d)
SELECT *, CASE WHEN problem IS NOT NULL THEN 'failed' WHEN added + removed + modified = 0 THEN 'unchanged' WHEN removed > 0 THEN 'held' ELSE 'activated' END AS outcome FROM p"""

_NAMES = (
    "h4_nearest_scope", "h7_root_numbers", "h9_window", "h10_document_index", "h11_contents", "h13_regrouped", "h17_cycles", "h18_matching_below", "h19_breadth_first", "t1_validity", "t4_applicable",
    "t5_live_intervals", "t6_same_node", "t8_calendar_dates", "t10_snapshots", "t12_history", "v18_refresh",
)
QUERIES = {n: globals()[n] for n in _NAMES}
ORACLES = {n: globals()[n.split("_")[0].upper()] for n in _NAMES}
QUERIES["h16_routes"], ORACLES["h16_routes"] = h16_routes, H16_ROUTES
