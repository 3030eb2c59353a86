"""Versions, trees, scope, comparison, usage and evaluation over the driver's tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from folio.functions import references, text
from folio.operators import evaluation, gram_index, pointers, revisions, scope, state, temporal, tree, tree_index, usage
from folio.sources.stored import fingerprint, kept, shared_dir, stored
from folio.tables import table

DAYS = ("1994-01-01", "1996-07-01", "1998-06-01")


def t3_as_of(spark, sf_dir):
    """Orders as versions of a customer's record; every third one runs on for 30 days, so days can be ambiguous."""
    v = temporal.with_validity(table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate")), "o_custkey", "d", "o_orderkey")
    v = v.withColumn("valid_to", F.when(F.col("o_orderkey") % 3 == 0, F.date_add("valid_to", 30)).otherwise(F.col("valid_to")))
    return temporal.as_of(v, [date.fromisoformat(d) for d in DAYS], "o_custkey", "o_orderkey").select("o_custkey", "day", "outcome", "matches", "o_orderkey", "first_day", "last_day")


T3 = f"""WITH a AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS f, lead(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey) AS t FROM orders),
v AS (SELECT o_custkey, o_orderkey, f, CASE WHEN o_orderkey % 3 = 0 THEN (t + INTERVAL 30 DAY)::DATE ELSE t END AS t FROM a),
d AS (SELECT unnest([{", ".join(f"DATE '{x}'" for x in DAYS)}]) AS day),
k AS (SELECT o_custkey, min(f) AS first_day, CASE WHEN bool_or(t IS NULL) THEN NULL ELSE max(t) END AS last_day FROM v GROUP BY 1),
m AS (SELECT k.o_custkey, day, first_day, last_day, count(v.o_orderkey) AS matches, min(v.o_orderkey) AS o FROM k CROSS JOIN d
 LEFT JOIN v ON v.o_custkey = k.o_custkey AND f <= day AND (t IS NULL OR day < t) GROUP BY ALL)
SELECT o_custkey, day, CASE matches WHEN 1 THEN 'resolved' WHEN 0 THEN 'out_of_range' ELSE 'ambiguous' END AS outcome, matches, CASE WHEN matches = 1 THEN o END AS o_orderkey, first_day, last_day FROM m"""


def t13_overlaps(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").distinct().withColumn("until", F.col("l_shipdate") + F.expr("INTERVAL '20' DAY"))
    return temporal.overlaps(li, ["l_orderkey"], "l_shipdate", "until", "l_linenumber").select("l_orderkey", "l_linenumber")


T13 = """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_shipdate FROM lineitem) SELECT a.l_orderkey, a.l_linenumber FROM l a WHERE EXISTS (SELECT 1 FROM l b WHERE b.l_orderkey = a.l_orderkey
 AND (b.l_shipdate, b.l_linenumber) < (a.l_shipdate, a.l_linenumber) AND a.l_shipdate < b.l_shipdate + INTERVAL 20 DAY)"""


def t9_local_day(spark, sf_dir):
    day = F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Tokyo"))
    return table(spark, sf_dir, "events").groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


T9 = "SELECT (ts + INTERVAL 9 HOUR)::DATE AS day, count(*) AS n FROM events GROUP BY 1"


def geography(spark, sf_dir):
    """Regions, nations and customers as one tree: id, parent, place."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    top = r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").cast("int").alias("place"))
    mid = n.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.col("n_nationkey").cast("int"))
    low = c.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), F.col("c_custkey").cast("int"))
    return top.union(mid).union(low)


_TREE = """WITH RECURSIVE node AS (
 SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent, r_regionkey::INT AS place FROM region UNION ALL
 SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey::INT FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey::INT FROM customer),
t AS (SELECT id, parent, place, 0 AS depth, [place] AS path, []::VARCHAR[] AS ancestors, id AS root FROM node WHERE parent IS NULL
 UNION ALL SELECT n.id, n.parent, n.place, t.depth + 1, list_append(t.path, n.place), list_append(t.ancestors, t.id), t.root FROM node n JOIN t ON n.parent = t.id)
"""


def indexed(spark, sf_dir):
    """The stored index of that tree; built by the first query that asks."""
    paths = [f"{sf_dir}/{t}.parquet" for t in ("region", "nation", "customer")]
    return kept(spark, "geography", paths, lambda: tree_index.built(geography(spark, sf_dir)))


def h1_subtree(spark, sf_dir):
    t = tree_index.subtree(indexed(spark, sf_dir), "r1")
    return t.select("id", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


H1 = _TREE + "SELECT id, depth, array_to_string(path, '/') AS path FROM t WHERE id = 'r1' OR list_contains(ancestors, 'r1')"


def h2_breadcrumbs(spark, sf_dir):
    return tree.breadcrumbs(indexed(spark, sf_dir))


H2 = _TREE + "SELECT id, (i - 1)::INT AS step, ancestors[i] AS ancestor FROM t, range(1, len(ancestors) + 1) x(i)"


def h6_page(spark, sf_dir):
    return tree_index.page(indexed(spark, sf_dir), 1, 2, 3).select("root", "head", "number", "id")


H6 = _TREE + """, h AS (SELECT id AS head, root, row_number() OVER (PARTITION BY root ORDER BY path, id) AS number FROM t WHERE depth = 1)
SELECT t.root, head, number, t.id FROM h JOIN t ON t.id = head OR list_contains(t.ancestors, head) WHERE number BETWEEN 2 AND 3"""


def h8_next(spark, sf_dir):
    t = indexed(spark, sf_dir)
    first = t.filter("root = 'r1' and depth = 1 and number = 1").select("id").first()
    return tree_index.next_after(t, first.id if first else "").select("id", "depth")


H8 = _TREE + """, f AS (SELECT id, path, root FROM t WHERE parent = 'r1' ORDER BY place LIMIT 1)
SELECT t.id, t.depth FROM t, f WHERE t.root = f.root AND t.path > f.path AND NOT list_contains(t.ancestors, f.id) ORDER BY t.path, t.id LIMIT 1"""


def h16_chains(spark, sf_dir):
    """Parts that point at the half of their key; multiples of 100 are removed, and 3 points at 7 and 7 at 3."""
    p = table(spark, sf_dir, "part").filter("p_partkey > 0")
    to = F.when(F.col("p_partkey") == 3, 7).when(F.col("p_partkey") == 7, 3).when(F.col("p_partkey") % 100 == 0, None).otherwise(F.floor(F.col("p_partkey") / 2))
    return pointers.chains(p.select(F.col("p_partkey").alias("from_id"), to.cast("long").alias("to_id"))).select("start", "last", "hops", "outcome")


H16 = """WITH RECURSIVE m AS (SELECT p_partkey AS a, CASE WHEN p_partkey = 3 THEN 7 WHEN p_partkey = 7 THEN 3 WHEN p_partkey % 100 = 0 THEN NULL ELSE p_partkey // 2 END AS b FROM part WHERE p_partkey > 0),
w AS (SELECT a AS start, b AS last, 1 AS hops, [a] AS seen FROM m
 UNION ALL SELECT w.start, m.b, w.hops + 1, list_append(w.seen, w.last) FROM w JOIN m ON m.a = w.last WHERE NOT list_contains(w.seen, w.last))
SELECT start, last, hops, CASE WHEN last IS NULL THEN 'removed' WHEN list_contains(seen, last) THEN 'cycle' ELSE 'end' END AS outcome FROM w
WHERE last IS NULL OR list_contains(seen, last) OR NOT EXISTS (SELECT 1 FROM m WHERE a = w.last)"""


def w10_carry_forward(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    head = tree.carried(F.col("role") == "user", F.col("turn"), ["conv_id"], [F.col("turn")])
    return t.select("conv_id", "turn", head.alias("user_turn"))


W10 = "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS user_turn FROM conversations"


def p8_scope(spark, sf_dir):
    """Parts as articles of brands (laws); odd brands are listed whole, the others by ranges of types."""
    p = table(spark, sf_dir, "part")
    brand = p.select("p_brand").distinct().withColumn("k", F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int"))
    articles = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("law_id"), (F.col("p_size") % 2).cast("string").alias("revision"), F.replace("p_type", F.lit(" "), F.lit("/")).alias("key"), F.when(F.col("p_size") > 45, F.lit("x")).alias("deleted_at"))
    laws = brand.select(F.col("p_brand").alias("law_id"), F.lit("1").alias("current"))
    entries = brand.select(F.col("p_brand").alias("law_id"), F.col("p_brand").alias("entry_id"), F.when(F.col("k") % 2 == 1, "full").otherwise("excerpt").alias("mode"), F.when(F.col("k") % 5 == 0, "draft").otherwise("verified").alias("status"))
    top = F.split_part(F.replace("p_type", F.lit(" "), F.lit("/")), F.lit("/"), F.lit(1))
    ranges = p.select(F.col("p_brand").alias("law_id"), top.alias("top")).distinct().filter("top < 'M'").join(brand.filter("k % 2 = 0").select(F.col("p_brand").alias("law_id")), "law_id").withColumnRenamed("law_id", "entry_id")
    return scope.visible(articles, laws, entries, ranges).select("id", "law_id", "key")


P8 = """WITH a AS (SELECT p_partkey AS id, p_brand AS law_id, replace(p_type, ' ', '/') AS key, regexp_extract(p_brand, '([0-9]+)$', 1)::INT AS k FROM part WHERE p_size % 2 = 1 AND p_size <= 45)
SELECT id, law_id, key FROM a WHERE k % 2 = 1 OR k % 5 = 0 OR (split_part(key, '/', 1) < 'M')"""


def v1_diff(spark, sf_dir):
    """Two revisions of part: some keys move by a million, some texts change, some rows go."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("parent"), F.col("p_name").alias("body"), F.col("p_size").cast("string").alias("content"))
    before = p.filter("key % 11 <> 0")
    after = p.filter("key % 13 <> 0").withColumn("key", F.when(F.col("key") % 7 == 0, F.col("key") + 1_000_000).otherwise(F.col("key"))).withColumn("content", F.when(F.col("key") % 5 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")))
    return revisions.compared(before, after)


V1 = """WITH a AS (SELECT p_partkey AS key, p_brand AS parent, p_name AS body, p_size::VARCHAR AS content FROM part WHERE p_partkey % 11 <> 0),
b0 AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN p_partkey + 1000000 ELSE p_partkey END AS key, p_brand AS parent, p_name AS body, p_size::VARCHAR AS content FROM part WHERE p_partkey % 13 <> 0),
b AS (SELECT key, parent, body, CASE WHEN key % 5 = 0 THEN content || 'x' ELSE content END AS content FROM b0),
ra AS (SELECT * FROM a WHERE key NOT IN (SELECT key FROM b)), rb AS (SELECT * FROM b WHERE key NOT IN (SELECT key FROM a)),
ca AS (SELECT parent, body, count(*) AS n, min(key) AS k FROM ra GROUP BY 1, 2), cb AS (SELECT parent, body, count(*) AS n, min(key) AS k FROM rb GROUP BY 1, 2)
SELECT a.key AS key_before, b.key AS key_after, CASE WHEN a.content = b.content THEN 'unchanged' ELSE 'modified' END AS kind FROM a JOIN b ON a.key = b.key
UNION ALL SELECT ca.k, cb.k, 'renumbered' FROM ca JOIN cb ON ca.parent = cb.parent AND ca.body = cb.body WHERE ca.n = 1 AND cb.n = 1
UNION ALL SELECT ra.key, NULL, CASE WHEN cb.n IS NULL THEN 'removed' ELSE 'ambiguous' END FROM ra JOIN ca ON ra.parent = ca.parent AND ra.body = ca.body LEFT JOIN cb ON ra.parent = cb.parent AND ra.body = cb.body WHERE cb.n IS NULL OR NOT (ca.n = 1 AND cb.n = 1)
UNION ALL SELECT NULL, rb.key, CASE WHEN ca.n IS NULL THEN 'added' ELSE 'ambiguous' END FROM rb JOIN cb ON rb.parent = cb.parent AND rb.body = cb.body LEFT JOIN ca ON rb.parent = ca.parent AND rb.body = ca.body WHERE ca.n IS NULL OR NOT (ca.n = 1 AND cb.n = 1)"""


def v2_tally(spark, sf_dir):
    return revisions.tallied(v1_diff(spark, sf_dir))


V2 = f"""WITH d AS ({V1}) SELECT {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in ("unchanged", "modified", "renumbered", "ambiguous", "removed", "added"))},
 count(*) FILTER (WHERE kind IN ('renumbered', 'ambiguous', 'removed')) AS held, count(*) FILTER (WHERE kind IN ('renumbered', 'ambiguous', 'removed')) = 0 AS publishable FROM d"""


def v10_checks(spark, sf_dir):
    docs, conv = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations")
    short = docs.filter(F.length(F.trim("text")) < 20)
    return revisions.all_findings([
        revisions.duplicates(docs.withColumn("h", F.md5("text")), ["h"], "same_text"),
        revisions.findings(short, "short", F.col("doc_id"), F.length("text")),
        revisions.orphans(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", table(spark, sf_dir, "customer").filter("c_acctbal > 0"), "c_custkey", "orphan"),
        revisions.later_repeats(conv, ["conv_id", "role"], ["turn"], "conv_id", "sibling"),
    ])


V10 = """SELECT 'same_text' AS code, md5(text) AS node, count(*)::VARCHAR AS detail FROM documents GROUP BY md5(text) HAVING count(*) > 1
UNION ALL SELECT 'short', doc_id::VARCHAR, length(text)::VARCHAR FROM documents WHERE length(trim(text)) < 20
UNION ALL SELECT 'orphan', o_orderkey::VARCHAR, o_custkey::VARCHAR FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)
UNION ALL SELECT 'sibling', conv_id::VARCHAR, n::VARCHAR FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations) WHERE n > 1"""


def views(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), "ts", F.col("event_id").alias("tie"), F.get_json_object("props", "$.k").alias("item"))


def r1_cooccurrence(spark, sf_dir):
    return usage.cooccurrences(views(spark, sf_dir))


R1 = """WITH v AS (SELECT props->>'k' AS item, ts, lag(props->>'k') OVER w AS p, lag(ts) OVER w AS pt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT p AS item, item AS related, count(*) AS n FROM v WHERE p <> item AND ts <= pt + INTERVAL 30 MINUTE GROUP BY 1, 2"""


def r3_recommendations(spark, sf_dir):
    return usage.recommended(usage.cooccurrences(views(spark, sf_dir), minutes=600), 5)


R3 = f"""WITH c AS ({R1.replace("INTERVAL 30 MINUTE", "INTERVAL 600 MINUTE")})
SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, related)::INT AS rank FROM c QUALIFY rank <= 5"""


def r4_cold_start(spark, sf_dir):
    packs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pack"), F.col("l_suppkey").alias("item"))
    return usage.cold_start(packs, 3)


R4 = """WITH p AS (SELECT DISTINCT l_orderkey AS pack, l_suppkey AS item FROM lineitem),
c AS (SELECT a.item, b.item AS related, count(*) AS n FROM p a JOIN p b ON a.pack = b.pack AND a.item <> b.item GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, related)::INT AS rank FROM c QUALIFY rank <= 3"""

RULES = [
    (1, "p_brand", '["Brand#11", "Brand#12", "Brand#21"]', "brand", "must", 1), (2, "p_type", '["STANDARD ANODIZED TIN", "ECONOMY ANODIZED STEEL", "PROMO BURNISHED COPPER", "STANDARD", "ECONOMY"]', "type", "may", 2),
    (3, "p_brand", '["Brand#11"]', "brand", "may", 0),
]


def r12_highlights(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "rule_id int, condition_key string, condition_values string, label string, level string, place int")
    p = table(spark, sf_dir, "part")
    conditions = p.select(F.col("p_partkey").alias("subject"), F.stack(F.lit(2), F.lit("p_brand"), F.col("p_brand"), F.lit("p_type"), F.col("p_type")).alias("key", "value"))
    found = usage.highlights(usage.matching_rules(rules, conditions))
    return found.select("subject", "level", "n_rules", F.array_join("labels", ",").alias("labels"))


R12 = f"""WITH r(id, k, v, label, level, place) AS (VALUES {", ".join(repr((a, b, c, d, e, f)) for a, b, c, d, e, f in RULES)}),
c AS (SELECT p_partkey AS subject, 'p_brand' AS k, p_brand AS v FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part),
m AS (SELECT subject, id, label, level, place FROM c JOIN r ON c.k = r.k AND list_contains(from_json(r.v, '["VARCHAR"]'), c.v)),
l AS (SELECT subject, label, min(place) AS p FROM m GROUP BY 1, 2)
SELECT m.subject, arg_min(level, place) AS level, count(*) AS n_rules, (SELECT string_agg(label, ',' ORDER BY p) FROM l WHERE l.subject = m.subject) AS labels FROM m GROUP BY m.subject"""


def _matched(spark, sf_dir, more=()):
    rules = spark.createDataFrame([*RULES, *more], "rule_id int, condition_key string, condition_values string, label string, level string, place int")
    p = table(spark, sf_dir, "part")
    conditions = p.select(F.col("p_partkey").alias("subject"), F.stack(F.lit(2), F.lit("p_brand"), F.col("p_brand"), F.lit("p_type"), F.col("p_type")).alias("key", "value"))
    return rules, usage.matching_rules(rules, conditions)


_NONE = (4, "p_type", '["NO SUCH TYPE"]', "nothing", "may", 3)


def r12_groups(spark, sf_dir):
    """Rules with how many parts each marks, and those that mark none."""
    return usage.rule_groups(*_matched(spark, sf_dir, [_NONE]))


R12_GROUPS = f"""WITH r(id, k, v, label, level, place) AS (VALUES {", ".join(repr(x) for x in (*RULES, _NONE))}),
c AS (SELECT p_partkey AS subject, 'p_brand' AS k, p_brand AS v FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part),
m AS (SELECT id, count(*) AS n FROM c JOIN r ON c.k = r.k AND list_contains(from_json(r.v, '["VARCHAR"]'), c.v) GROUP BY 1)
SELECT r.id::INT AS rule_id, label, k AS condition_key, coalesce(n, 0) AS articles, CASE WHEN n IS NULL THEN label || '（条件値未選択）' END AS unmatched FROM r LEFT JOIN m ON m.id = r.id"""


def r12_marked(spark, sf_dir):
    """Parts with the level of their first rule, the kinds of its conditions and all values that these list."""
    return usage.marked(*_matched(spark, sf_dir)).select("subject", "level", F.array_join("types", ",").alias("types"), F.size("given").alias("given"))


R12_MARKED = f"""WITH r(id, k, v, label, level, place) AS (VALUES {", ".join(repr(x) for x in RULES)}),
c AS (SELECT p_partkey AS subject, 'p_brand' AS k, p_brand AS v FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part),
m AS (SELECT DISTINCT subject, id, r.k AS k, r.v AS v, level, place FROM c JOIN r ON c.k = r.k AND list_contains(from_json(r.v, '["VARCHAR"]'), c.v)),
t AS (SELECT subject, k, min(place) AS p FROM m GROUP BY 1, 2), g AS (SELECT subject, count(DISTINCT x) AS n FROM (SELECT subject, unnest(from_json(v, '["VARCHAR"]')) AS x FROM m) GROUP BY 1)
SELECT m.subject, arg_min(level, place) AS level, (SELECT string_agg(k, ',' ORDER BY p) FROM t WHERE t.subject = m.subject) AS types, any_value(g.n)::INT AS given FROM m JOIN g ON g.subject = m.subject GROUP BY m.subject"""


def e2_evaluation(spark, sf_dir):
    """Customers as cases, their parts as targets, and the parts of the same nation most ordered as results."""
    o, li, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    lines = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("c_custkey"), F.col("l_suppkey").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    # once for the cases and for the counts
    pairs = stored(lines.join(c, "c_custkey").select(F.col("c_custkey").alias("case"), F.col("c_mktsegment").alias("category"), "c_nationkey", "target", "n"), "pairs")
    counts = pairs.groupBy(F.col("c_nationkey").alias("item"), F.col("target").alias("related")).agg(F.sum("n").alias("n"))
    ranked = usage.recommended(counts, 10).select(F.col("item").alias("c_nationkey"), F.col("related").alias("target"), "rank")
    # a case's results are its nation's, so a target's rank is found by nation
    measured = pairs.join(F.broadcast(ranked), ["c_nationkey", "target"], "left").groupBy("case", "category").agg(F.count(F.lit(1)).alias("targets"), F.count("rank").alias("hits"), F.min("rank").alias("first"))
    found = evaluation.summary(measured)
    return found.select("category", "cases", *[F.round(x, 6).alias(x) for x in ("recall", "mrr", "complete")])


E2 = """WITH l AS (SELECT c_custkey, c_nationkey, c_mktsegment, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey),
t AS (SELECT DISTINCT c_custkey AS c, c_nationkey AS n, c_mktsegment AS category, l_suppkey AS target FROM l),
r AS (SELECT c_nationkey AS n, l_suppkey AS item, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, l_suppkey) AS rank FROM l GROUP BY 1, 2 QUALIFY rank <= 10),
p AS (SELECT c, category, count(*) AS targets, count(rank) AS hits, min(rank) AS first FROM t LEFT JOIN r ON t.n = r.n AND t.target = r.item GROUP BY 1, 2)
SELECT category, count(*) AS cases, round(sum(hits) / sum(targets), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, round(avg((hits = targets)::INT), 6) AS complete FROM p GROUP BY GROUPING SETS ((category), ())"""


def e6_coverage(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x.role).alias("seen"))
    want = F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    return c.select("conv_id", F.round(evaluation.set_coverage(want, F.col("seen")), 6).alias("reached"), F.round(evaluation.ordered_coverage(F.array(F.lit("user"), F.lit("assistant"), F.lit("user")), F.col("seen")), 6).alias("in_order"))


E6 = """WITH s AS (SELECT conv_id, list(role ORDER BY turn) AS seen FROM conversations GROUP BY 1),
p AS (SELECT *, list_position(seen, 'user') AS a FROM s), q AS (SELECT *, CASE WHEN a > 0 THEN a + nullif(coalesce(list_position(seen[a + 1:], 'assistant'), 0), 0) END AS b FROM p),
z AS (SELECT *, CASE WHEN b > 0 THEN b + nullif(coalesce(list_position(seen[b + 1:], 'user'), 0), 0) END AS c FROM q)
SELECT conv_id, round(len(list_intersect(['system', 'user', 'assistant'], seen)) / 3, 6) AS reached,
 round(((coalesce(a, 0) > 0)::INT + (coalesce(b, 0) > 0)::INT + (coalesce(c, 0) > 0)::INT) / 3, 6) AS in_order FROM z"""


def n12_fingerprints(spark, sf_dir):
    """Every turn of the conversations, whose fingerprint says who spoke as well."""
    t = table(spark, sf_dir, "conversations")
    said = F.concat_ws(": ", "role", "text")
    return t.select("conv_id", "turn", text.fingerprint(text.collapsed(said)).alias("fingerprint"), *[c.alias(k) for k, c in text.quote_selector(F.col("text")).items()])


N12 = r"""SELECT conv_id, turn, left(sha256(trim(regexp_replace(concat_ws(': ', role, text), '[ \t\n\v\f\r]+', ' ', 'g'), ' ')), 16) AS fingerprint, left(text, 32) AS prefix,
 CASE WHEN length(text) > 32 THEN right(text, 32) ELSE '' END AS suffix FROM conversations"""


def _fingerprints(d):
    return d.select("doc_id", text.fingerprint(text.collapsed(F.col("text"))).alias("fingerprint"), *[c.alias(k) for k, c in text.quote_selector(F.col("text")).items()])


def n12_all_fingerprints(spark, sf_dir):
    """Every document in any script; a null text has no fingerprint or prefix and an empty suffix."""
    return _fingerprints(table(spark, sf_dir, "documents"))


N12_ALL = r"""SELECT doc_id, left(sha256(trim(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g'), ' ')), 16) AS fingerprint, left(text, 32) AS prefix,
 CASE WHEN length(text) > 32 THEN right(text, 32) ELSE '' END AS suffix FROM documents"""


def s15_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(references.hrefs(F.col("html"))).alias("href"))
    return p.groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


S15 = """SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1, 2"""


def l10_resolution(spark, sf_dir):
    """Links that lead to a page of the table, by address."""
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(references.hrefs(F.col("html"))).alias("url"))
    known = table(spark, sf_dir, "pages").select("url", F.col("page_id").alias("target"))
    return references.resolution_rate(references.resolved(found, known, ["url"]))


L10 = """WITH l AS (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS url FROM pages)
SELECT count(*) AS "references", count(*) FILTER (WHERE url IN (SELECT url FROM pages)) AS resolved, avg((url IN (SELECT url FROM pages))::INT) AS rate FROM l"""


def k5_bigrams(spark, sf_dir):
    """Documents that hold a phrase, and how often, by the kept index of character pairs; the first that asks builds it."""
    path = f"{shared_dir(spark)}/folio/kept/grams-{fingerprint(spark, [f'{sf_dir}/documents.parquet'])}"
    if gram_index.generations(spark, path) == 0:
        gram_index.add(table(spark, sf_dir, "documents"), path, doc="doc_id", text="text")
    return gram_index.search(spark, path, TERM).select(F.col("doc").alias("doc_id"), F.size("places").alias("n"))


TERM = "License"
K5 = f"SELECT doc_id, ((length(text) - length(replace(text, '{TERM}', ''))) // {len(TERM)})::INT AS n FROM documents WHERE contains(text, '{TERM}')"


def k6_suggest(spark, sf_dir):
    """Names with a prefix: from customers first, then suppliers, each name once, ten at most."""
    c = table(spark, sf_dir, "customer").filter(F.startswith("c_name", F.lit("Customer#00000001"))).select(F.col("c_name").alias("label"), F.lit(0).alias("rank"))
    s = table(spark, sf_dir, "supplier").filter(F.startswith("s_name", F.lit("Supplier#00000000"))).select(F.col("s_name").alias("label"), F.lit(1).alias("rank"))
    return c.unionByName(s).groupBy("label").agg(F.min("rank").alias("rank")).orderBy("rank", "label").limit(10)


K6 = """SELECT label, min(rank)::INT AS rank FROM (SELECT c_name AS label, 0 AS rank FROM customer WHERE starts_with(c_name, 'Customer#00000001')
 UNION ALL SELECT s_name, 1 FROM supplier WHERE starts_with(s_name, 'Supplier#00000000')) GROUP BY label ORDER BY rank, label LIMIT 10"""


def m1_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "part").filter("p_partkey % 3 <> 0").select("p_partkey", "p_size")
    new = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select("p_partkey", (F.col("p_size") + 100).alias("p_size"))
    return state.upserted(old, new, ["p_partkey"])


M1 = "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size + 100 ELSE p_size END AS p_size FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0"


def m2_insert_absent(spark, sf_dir):
    old = table(spark, sf_dir, "part").filter("p_partkey % 3 <> 0").select("p_partkey", "p_size")
    new = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select("p_partkey", (F.col("p_size") + 100).alias("p_size"))
    return state.inserted(old, new, ["p_partkey"])


M2 = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size + 100 ELSE p_size END AS p_size FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0"

QUERIES = {
    "t3_as_of": t3_as_of, "t13_overlaps": t13_overlaps, "t9_local_day": t9_local_day, "h1_subtree": h1_subtree, "h2_breadcrumbs": h2_breadcrumbs, "h6_page": h6_page, "h8_next": h8_next,
    "h16_chains": h16_chains, "w10_carry_forward": w10_carry_forward, "p8_scope": p8_scope, "v1_diff": v1_diff, "v2_tally": v2_tally, "v10_checks": v10_checks,
    "r1_cooccurrence": r1_cooccurrence, "r3_recommendations": r3_recommendations, "r4_cold_start": r4_cold_start, "r12_highlights": r12_highlights, "r12_groups": r12_groups, "r12_marked": r12_marked, "e2_evaluation": e2_evaluation,
    "e6_coverage": e6_coverage, "n12_fingerprints": n12_fingerprints, "n12_all_fingerprints": n12_all_fingerprints, "s15_links": s15_links, "l10_resolution": l10_resolution, "k5_bigrams": k5_bigrams, "k6_suggest": k6_suggest,
    "m1_upsert": m1_upsert, "m2_insert_absent": m2_insert_absent,
}
ORACLES = {
    "t3_as_of": T3, "t13_overlaps": T13, "t9_local_day": T9, "h1_subtree": H1, "h2_breadcrumbs": H2, "h6_page": H6, "h8_next": H8, "h16_chains": H16, "w10_carry_forward": W10, "p8_scope": P8,
    "v1_diff": V1, "v2_tally": V2, "v10_checks": V10, "r1_cooccurrence": R1, "r3_recommendations": R3, "r4_cold_start": R4, "r12_highlights": R12, "r12_groups": R12_GROUPS, "r12_marked": R12_MARKED, "e2_evaluation": E2, "e6_coverage": E6,
    "n12_fingerprints": N12, "n12_all_fingerprints": N12_ALL, "s15_links": S15, "l10_resolution": L10, "k5_bigrams": K5, "k6_suggest": K6, "m1_upsert": M1, "m2_insert_absent": M2,
}
