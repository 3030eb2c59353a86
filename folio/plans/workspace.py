"""Readers' views: lookups, history, packs and topics, roles, state changes, evaluation inputs; over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.functions.text import context_checksum
from folio.operators import evaluation, intervals, ranking, revisions, scope, temporal, usage
from folio.plans.registering import Register
from folio.sources.stored import shared_dir
from folio.tables import table

query = Register()
QUERIES, ORACLES = query.queries, query.oracles


# Lookups and search


@query("""WITH q(asked) AS (VALUES ('42'), ('0042'), ('#42'), ('no. 7'), ('none'), ('999999'))
SELECT asked, c_custkey, c_name FROM q LEFT JOIN customer ON c_custkey = try_cast(nullif(regexp_replace(asked, '[^0-9]', '', 'g'), '') AS BIGINT)""")
def k7_by_number(spark, sf_dir):
    """Customers by a number as written or in its normal form; unknown numbers stay, without a name."""
    asked = spark.createDataFrame([(x,) for x in ("42", "0042", "#42", "no. 7", "none", "999999")], "asked string")
    number = F.expr("try_cast(nullif(regexp_replace(asked, '[^0-9]', ''), '') as bigint)")
    return asked.withColumn("c_custkey_asked", number).join(table(spark, sf_dir, "customer"), F.col("c_custkey_asked") == F.col("c_custkey"), "left").select("asked", "c_custkey", "c_name")


@query("SELECT doc_id, left(text, 300) AS preview, length(text) > 300 AS more FROM documents")
def k8_preview(spark, sf_dir):
    """The first 300 characters of each document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(300)).alias("preview"), (F.length("text") > 300).alias("more"))


_URL = r"^https?://([^/?#]+)/([a-z]+)/([0-9]+)(?:\?page=([0-9]+))?"


@query(rf"""SELECT page_id, regexp_extract(url, '{_URL}', 1) AS site, regexp_extract(url, '{_URL}', 2) AS section, try_cast(nullif(regexp_extract(url, '{_URL}', 3), '') AS BIGINT) AS number,
 try_cast(nullif(regexp_extract(url, '{_URL}', 4), '') AS BIGINT) AS page FROM pages""")
def k9_routes(spark, sf_dir):
    """An address taken apart into the route that it names; parts that it lacks are null or empty."""
    number = [F.expr(f"try_cast(nullif(p{i}, '') as bigint)") for i in (3, 4)]
    parts = table(spark, sf_dir, "pages").select("page_id", *[F.regexp_extract("url", _URL, i).alias(f"p{i}") for i in range(1, 5)])
    return parts.select("page_id", F.col("p1").alias("site"), F.col("p2").alias("section"), number[0].alias("number"), number[1].alias("page"))


@query("SELECT user_id, event_id, ts FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def k10_recent(spark, sf_dir):
    """Each user's five latest views; five is the feature."""
    v = table(spark, sf_dir, "events").filter("event_type = 'view'")
    return temporal.newest_n(v, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id", "ts")


# Scope and roles


@query("""SELECT p_partkey, p_brand FROM part WHERE p_size % 3 = regexp_extract(p_brand, '([0-9]+)$', 1)::INT % 3""")
def p9_pinned_scope(spark, sf_dir):
    """Parts of the revision (size modulo 3) that their brand's entry pins."""
    p = table(spark, sf_dir, "part")
    pins = p.select("p_brand").distinct().withColumn("pinned", F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int") % 3)
    return p.withColumn("pinned", F.col("p_size") % 3).join(pins, ["p_brand", "pinned"]).select("p_partkey", "p_brand")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
def p11_row_security(spark, sf_dir):
    """Orders as one organisation (nation 7) sees them."""
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("organization"))
    return scope.of_organization(table(spark, sf_dir, "orders").join(owners, "o_custkey"), 7).select("o_orderkey", "o_custkey")


@query("""SELECT user_id, list_has_any(list(DISTINCT event_type), ['purchase', 'signup']) AS allowed, count(DISTINCT event_type) AS roles FROM events GROUP BY 1""")
def p12_roles(spark, sf_dir):
    """Whether a user holds one of the required roles; a role is a kind of event here."""
    held = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("held"))
    return held.select("user_id", scope.has_role(F.col("held"), ["purchase", "signup"]).alias("allowed"), F.size("held").cast("long").alias("roles"))


@query("""SELECT o_orderkey, CASE WHEN c_nationkey < 10 THEN o_custkey END AS target, CASE WHEN c_nationkey < 10 THEN c_name END AS title FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def p14_null_out(spark, sf_dir):
    """Orders with their customer; one that is out of scope is left empty, the row stays."""
    inside = table(spark, sf_dir, "customer").filter("c_nationkey < 10").select(F.col("c_custkey").alias("target"), F.col("c_name").alias("title"))
    return table(spark, sf_dir, "orders").join(inside, F.col("o_custkey") == F.col("target"), "left").select("o_orderkey", "target", "title")


# Joins


@query("SELECT o_orderstatus, count(*) AS n FROM orders, (SELECT avg(o_totalprice) AS a FROM orders) WHERE o_totalprice > a GROUP BY 1")
def j16_above_average(spark, sf_dir):
    """Orders above the mean price, by status: one row crossed with the table."""
    o = table(spark, sf_dir, "orders")
    return o.crossJoin(F.broadcast(o.agg(F.avg("o_totalprice").alias("a")))).filter("o_totalprice > a").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, user_id, p_partkey, p_name FROM events LEFT JOIN part ON p_partkey = (props->>'k')::BIGINT * 50")
def j18_enriched(spark, sf_dir):
    """Events with the part that they name, or nothing."""
    e = table(spark, sf_dir, "events").withColumn("wanted", F.get_json_object("props", "$.k").cast("long") * 50)
    return e.join(table(spark, sf_dir, "part"), F.col("wanted") == F.col("p_partkey"), "left").select("event_id", "user_id", "p_partkey", "p_name")


def _pairs(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("item"), "n_regionkey")
    return n.join(n.withColumnRenamed("item", "related"), "n_regionkey").filter("item <> related").select("item", "related")


@query("SELECT a.n_nationkey AS item, b.n_nationkey AS related FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def j24_pack_pairs(spark, sf_dir):
    """Ordered pairs within a pack made by hand, a region's five nations."""
    return _pairs(spark, sf_dir)


_KNOWN = "SELECT s_nationkey AS item, c_nationkey AS related, count(*) AS n FROM supplier JOIN customer ON c_custkey = s_suppkey GROUP BY 1, 2"


@query(f"""WITH k AS ({_KNOWN}), p AS (SELECT a.n_nationkey AS item, b.n_nationkey AS related FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey)
SELECT item, related, n FROM k UNION ALL SELECT item, related, 1 FROM p WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.item = p.item AND k.related = p.related)""")
def r5_preset_pairs(spark, sf_dir):
    """Pairs of packs get a count of one where they have none; counts that are there stay."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_nationkey").alias("related"))
    known = table(spark, sf_dir, "supplier").join(c, "s_suppkey").groupBy(F.col("s_nationkey").alias("item"), "related").agg(F.count(F.lit(1)).alias("n"))
    return known.unionByName(_pairs(spark, sf_dir).join(known, ["item", "related"], "left_anti").withColumn("n", F.lit(1).cast("long")))


@query("""WITH poor AS (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal < 0)
SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT s_nationkey FROM poor) THEN NULL ELSE c_nationkey END AS nation FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')""")
def j26_cascade(spark, sf_dir):
    """Customers after a cascade: those without a late order go, links to nations with a supplier in debt are cut."""
    late = table(spark, sf_dir, "orders").filter("o_orderdate >= timestamp_ntz'1998-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    poor = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey"), F.lit(True).alias("poor")).distinct()
    c = table(spark, sf_dir, "customer").join(late, "c_custkey", "left_semi").join(poor, "c_nationkey", "left")
    return c.select("c_custkey", F.when(F.col("poor").isNull(), F.col("c_nationkey")).alias("nation"))


@query("""WITH v AS (SELECT doc_id, text AS a, replace(text, ', ', '; ') AS b FROM documents), p AS (SELECT *, strpos(a, '. ') AS pa, strpos(b, '. ') AS pb FROM v)
SELECT doc_id, substr(a, greatest(pa - 10, 1), pa - greatest(pa - 10, 1)) = substr(b, greatest(pb - 10, 1), pb - greatest(pb - 10, 1)) AND substr(a, pa + 2, 10) = substr(b, pb + 2, 10) AS agrees FROM p WHERE pa > 0 AND pb > 0""")
def j27_contexts(spark, sf_dir):
    """Whether the ten characters on each side of the first full stop are the same in two versions of a text."""
    v = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("a"), F.replace("text", F.lit(", "), F.lit("; ")).alias("b"))
    v = v.withColumn("pa", F.locate(". ", "a")).withColumn("pb", F.locate(". ", "b")).filter("pa > 0 and pb > 0")

    def sides(c, p):
        first = F.greatest(F.col(p) - 10, F.lit(1))
        return F.struct(F.substr(c, first, F.col(p) - first), F.substr(c, F.col(p) + 2, F.lit(10)))

    left, right = sides(F.col("a"), "pa"), sides(F.col("b"), "pb")
    return v.select("doc_id", ((left["col1"] == right["col1"]) & (left["col2"] == right["col2"])).alias("agrees"))


# Aggregates and order


@query("SELECT p_brand AS id, p_type AS kind, min(p_name) AS label, count(*) AS n FROM part GROUP BY 1, 2")
def a12_labelled_counts(spark, sf_dir):
    """A counter for each brand and type, with a label carried along."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("id"), F.col("p_type").alias("kind")).agg(F.min("p_name").alias("label"), F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, string_agg(role || '=' || n, ',' ORDER BY role) AS turns FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2) GROUP BY 1")
def a20_grouped_maps(spark, sf_dir):
    """Turns of each conversation by role, as one map."""
    n = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("m"))
    return m.select("conv_id", F.array_join(F.transform(F.array_sort(F.map_keys("m")), lambda k: F.concat(k, F.lit("="), F.element_at("m", k).cast("string"))), ",").alias("turns"))


@query("SELECT event_type, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def a22_latency(spark, sf_dir):
    """Mean, ends and nearest-rank percentiles of each kind of event."""
    e = table(spark, sf_dir, "events")
    ends = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    return ends.join(ranking.percentiles(e, ["event_type"], "value", {"p50": 0.5, "p99": 0.99}), "event_type")


@query("SELECT source, round(sum(toxic) / nullif(count(toxic), 0), 6) AS toxic, round(avg(quality), 6) AS quality, count(*) AS documents FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def a17_nullable_rates(spark, sf_dir):
    """Rates of labels by source; null where nothing was labelled."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("source")
    return d.agg(F.round(usage.share(F.sum("toxic"), F.count("toxic")), 6).alias("toxic"), F.round(F.avg("quality"), 6).alias("quality"), F.count(F.lit(1)).alias("documents"))


@query("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderpriority, o_totalprice DESC, o_orderdate, o_orderkey)::INT AS place FROM orders""")
def o6_five_keys(spark, sf_dir):
    """A customer's orders by status in a stated order, priority, price, date and key."""
    rank = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    by = Window.partitionBy("o_custkey").orderBy(rank, "o_orderpriority", F.desc("o_totalprice"), "o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(by).alias("place"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500")
def o8_clamped(spark, sf_dir):
    """The dearest orders; a wish for 9,999 rows is clamped to 500."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(min(max(9_999, 1), 500))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def o11_sorted_names(spark, sf_dir):
    """Names of each region's nations in order."""
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


# Packs, topics, history


@query("""SELECT user_id, event_id, ts, p_name, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS place FROM events LEFT JOIN part ON p_partkey = (props->>'k')::BIGINT
QUALIFY place <= 20""")
def r8_history(spark, sf_dir):
    """Each user's twenty latest events with the part that they name; twenty is the feature."""
    by = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = table(spark, sf_dir, "events").withColumn("place", F.row_number().over(by)).filter("place <= 20").withColumn("wanted", F.get_json_object("props", "$.k").cast("long"))
    return e.join(table(spark, sf_dir, "part"), F.col("wanted") == F.col("p_partkey"), "left").select("user_id", "event_id", "ts", "p_name", "place")


@query("SELECT n_nationkey, n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 5000 GROUP BY 1, 2")
def r9_topic_counts(spark, sf_dir):
    """Nations as topics, with how many customers they have; those with none stay."""
    n = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "nation").join(n, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT r_name AS topic, c_custkey, c_name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE r_name = 'ASIA'")
def r10_of_topic(spark, sf_dir):
    """Customers of one topic, by way of its nations."""
    r = table(spark, sf_dir, "region").filter("r_name = 'ASIA'")
    n = table(spark, sf_dir, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("r_name").alias("topic"), "c_custkey", "c_name")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS owner FROM orders WHERE o_orderkey % 4 = 0 OR o_custkey = 11")
def r11_visible_packs(spark, sf_dir):
    """Packs without an owner and those of customer 11."""
    packs = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")).alias("owner"))
    return packs.filter(F.col("owner").isNull() | (F.col("owner") == 11))


@query("SELECT p_brand, count(DISTINCT p_type) AS kinds, count(DISTINCT p_partkey) FILTER (p_size > 25) AS marked FROM part GROUP BY 1")
def r13_distinct_marks(spark, sf_dir):
    """Distinct marks of each brand."""
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_distinct("p_type").alias("kinds"), F.count_distinct(F.when(F.col("p_size") > 25, F.col("p_partkey"))).alias("marked"))


@query("""SELECT doc_id, sha256(substr(text, 6, 10) || '⟦' || substr(text, 16, 8) || '⟧' || substr(text, 24, 10)) AS checksum FROM documents""")
def r15_anchor_checksums(spark, sf_dir):
    """Checksum of characters 15 to 23 of each text with ten characters of context."""
    return table(spark, sf_dir, "documents").select("doc_id", context_checksum(F.col("text"), F.lit(15), F.lit(23)).alias("checksum"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem)
SELECT a.l_orderkey, a.l_linenumber AS line, count(*) AS n FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber % 2 = 1 AND b.l_linenumber % 2 = 0
 AND a.l_shipdate < b.l_shipdate + INTERVAL 10 DAY AND b.l_shipdate < a.l_shipdate + INTERVAL 10 DAY GROUP BY 1, 2""")
def r16_span_overlaps(spark, sf_dir):
    """Odd lines whose ten days overlap those of even lines of their order, and how many."""
    start = F.col("l_shipdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), start.alias("start"), (start + F.expr("INTERVAL '10' DAY")).alias("end"))
    counts = intervals.overlap_counts(li.filter("line % 2 = 1"), li.filter("line % 2 = 0"), ["l_orderkey"], "line", "start", "end")
    return counts.filter("n > 0")


@query("SELECT l_orderkey, string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem WHERE l_orderkey IN (SELECT range * 7 FROM range(200)) GROUP BY 1")
def r17_batch_of_ids(spark, sf_dir):
    """Lines of a stated batch of ids, two hundred at most, grouped by id."""
    ids = spark.range(200).select((F.col("id") * 7).alias("l_orderkey"))
    li = table(spark, sf_dir, "lineitem").join(F.broadcast(ids), "l_orderkey", "left_semi")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x.l_partkey.cast("string"))
    return li.groupBy("l_orderkey").agg(F.array_join(parts, ",").alias("parts"))


@query("SELECT o_orderkey, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS active FROM orders")
def r18_one_active(spark, sf_dir):
    """Of a customer's projects the newest is active and no other."""
    o = table(spark, sf_dir, "orders")
    newest = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("newest"))
    return o.join(newest, "o_custkey").select("o_orderkey", (F.col("o_orderkey") == F.col("newest")).alias("active"))


@query("SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_type ORDER BY p_name, p_partkey)::INT AS place FROM part WHERE p_type = 'PROMO'")
def r19_glossary(spark, sf_dir):
    """Entries of one category in order of their reading."""
    by = Window.partitionBy("p_type").orderBy("p_name", "p_partkey")
    return table(spark, sf_dir, "part").filter("p_type = 'PROMO'").select("p_partkey", "p_name", F.row_number().over(by).alias("place"))


@query("SELECT p_brand, count(*) FILTER (p_size > 40) AS children, count(*) AS total FROM part GROUP BY 1")
def r20_rules_with_children(spark, sf_dir):
    """Rules (brands) with how many of their children are large."""
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_if(F.col("p_size") > 40).alias("children"), F.count(F.lit(1)).alias("total"))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_brand, p_size, p_partkey LIMIT 1")
def r22_first_of_all(spark, sf_dir):
    """The first part of the first brand."""
    first = table(spark, sf_dir, "part").agg(F.min(F.struct("p_brand", "p_size", "p_partkey", "p_name")).alias("x"))
    return first.filter("x is not null").select("x.p_partkey", "x.p_name")


# State


@query("""SELECT doc_id, md5(coalesce(text, '')) AS hash FROM documents WHERE doc_id % 2 = 0
AND (source, md5(coalesce(text, ''))) NOT IN (SELECT (coalesce(source, ''), md5(coalesce(text, ''))) FROM documents WHERE doc_id % 3 = 0)""")
def m4_unknown_only(spark, sf_dir):
    """Documents that arrive and are not stored yet, by source and content hash."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"))
    return d.filter("doc_id % 2 = 0").join(d.filter("doc_id % 3 = 0"), ["source", "hash"], "left_anti").select("doc_id", "hash")


@query("""SELECT DISTINCT user_id, CASE WHEN user_id % 5 = 0 THEN 'admin' ELSE event_type END AS role FROM events""")
def m6_roles_changed(spark, sf_dir):
    """Roles of users after every fifth user's roles are taken away and one is given: one new snapshot."""
    held = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("role")).distinct()
    changed = held.filter("user_id % 5 = 0").select("user_id").distinct()
    return held.join(changed, "user_id", "left_anti").unionByName(changed.withColumn("role", F.lit("admin")))


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'error', ts, event_id) AS seq FROM events""")
def m7_audit(spark, sf_dir):
    """Errors appended behind a user's other records, with numbers that go on from theirs."""
    e = table(spark, sf_dir, "events")
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    old = e.filter("event_type <> 'error'").select("user_id", "event_id", F.row_number().over(by).cast("long").alias("seq"))
    last = old.groupBy("user_id").agg(F.max("seq").alias("last"))
    new = e.filter("event_type = 'error'").select("user_id", "event_id", F.row_number().over(by).alias("n")).join(last, "user_id", "left")
    return old.unionByName(new.select("user_id", "event_id", (F.col("n") + F.coalesce("last", F.lit(0))).alias("seq")))


@query("""SELECT c_custkey AS id, c_name AS name, 'known' AS state FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT DISTINCT user_id, 'user-' || user_id, 'provisioned' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)""")
def m8_provisioned(spark, sf_dir):
    """Accounts, and a new one for each user who is seen for the first time."""
    known = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("known").alias("state"))
    seen = table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct().join(known, "id", "left_anti")
    return known.unionByName(seen.select("id", F.concat(F.lit("user-"), F.col("id").cast("string")).alias("name"), F.lit("provisioned").alias("state")))


@query("""SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01') THEN NULL ELSE TIMESTAMP '2000-01-01' END AS deleted_at FROM customer""")
def m11_soft_delete(spark, sf_dir):
    """Customers without a late order are marked, not removed."""
    late = table(spark, sf_dir, "orders").filter("o_orderdate >= timestamp_ntz'1998-01-01'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("late")).distinct()
    c = table(spark, sf_dir, "customer").join(late, "c_custkey", "left")
    return c.select("c_custkey", F.when(F.col("late").isNull(), F.expr("timestamp_ntz'2000-01-01'")).alias("deleted_at"))


# Evaluation inputs


@query("""SELECT 'REPEATED_ID' AS code, conv_id::VARCHAR AS node, count(*)::VARCHAR AS detail FROM conversations GROUP BY conv_id HAVING count(*) > 1
UNION ALL SELECT 'EMPTY_QUERY', item_id::VARCHAR, length(text)::VARCHAR FROM benchmark WHERE trim(text) = '' OR length(text) < 100
UNION ALL SELECT 'NO_TARGET', item_id::VARCHAR, '' FROM benchmark WHERE item_id NOT IN (SELECT label FROM embeddings)""")
def e1_input_checks(spark, sf_dir):
    """What is wrong with cases before they are measured: repeated ids, queries that are empty or short, no targets."""
    b = table(spark, sf_dir, "benchmark")
    short = b.filter("trim(text) = '' or length(text) < 100")
    lost = b.join(table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("item_id")), "item_id", "left_anti")
    return revisions.all_findings([
        revisions.duplicates(table(spark, sf_dir, "conversations"), ["conv_id"], "REPEATED_ID"),
        revisions.findings(short, "EMPTY_QUERY", F.col("item_id"), F.length("text")), revisions.findings(lost, "NO_TARGET", F.col("item_id"), F.lit("")),
    ])


@query("""WITH s AS (SELECT conv_id, list(DISTINCT role) AS seen FROM conversations WHERE turn < 3 GROUP BY 1)
SELECT conv_id, round(len(list_intersect(['system', 'assistant'], seen)) / 2, 6) AS disclosed, list_contains(seen, 'system') AS exception FROM s""")
def e7_disclosure(spark, sf_dir):
    """Share of what had to be disclosed that was, within a conversation's first three turns."""
    s = table(spark, sf_dir, "conversations").filter("turn < 3").groupBy("conv_id").agg(F.collect_set("role").alias("seen"))
    return s.select("conv_id", F.round(evaluation.set_coverage(F.array(F.lit("system"), F.lit("assistant")), F.col("seen")), 6).alias("disclosed"), F.array_contains("seen", "system").alias("exception"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'purchase') AS assertions, round(count(*) FILTER (event_type = 'purchase' AND value > 50) / nullif(count(*) FILTER (event_type = 'purchase'), 0), 6) AS false_rate
FROM events GROUP BY 1""")
def e8_false_evidence(spark, sf_dir):
    """Share of a user's assertions that are false; null without any."""
    said = F.col("event_type") == "purchase"
    n = F.count_if(said)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(n.alias("assertions"), F.round(usage.share(F.count_if(said & (F.col("value") > 50)), n), 6).alias("false_rate"))


_QUESTIONS = """WITH q AS (SELECT 2020 + y AS year, q + 1 AS number, (2020 + y) || '-' || lpad((q + 1)::VARCHAR, 2, '0') AS id, CASE WHEN y < 4 THEN 'dev' ELSE 'test' END AS split FROM range(5) a(y), range(30) b(q))"""


@query(_QUESTIONS + " SELECT doc_id, year, number, id, split FROM documents LEFT JOIN q ON (year - 2020) * 30 + number = doc_id % 200")
def s18_manifest(spark, sf_dir):
    """Documents with the question that they answer of the generated list, five years of thirty, the last year held back; fifty in two hundred answer none."""
    at = (F.col("year") - 2020) * 30 + F.col("number")
    q = _manifest(spark).withColumn("at", at)  # a hundred and fifty rows
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 200).alias("at"))
    return d.join(F.broadcast(q), "at", "left").drop("at")


def _manifest(spark):
    years = spark.range(5).select((F.col("id") + 2020).alias("year"))
    q = years.select("year", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(30).cast("long"))).alias("number"))
    number = F.lpad(F.col("number").cast("string"), 2, "0")
    return q.select("year", "number", F.concat_ws("-", F.col("year").cast("string"), number).alias("id"), F.when(F.col("year") < 2024, "dev").otherwise("test").alias("split"))


@query(_QUESTIONS + """, d AS (SELECT doc_id, lang, id, split, number FROM documents LEFT JOIN q ON (year - 2020) * 30 + number = doc_id % 200)
SELECT lang, count(*) AS documents, count(id) AS answered, count(DISTINCT id) AS questions, count(DISTINCT id) FILTER (split = 'dev') AS dev, count(DISTINCT id) FILTER (split = 'test') AS test,
 CASE WHEN count(id) = 0 THEN 'EMPTY' WHEN count(DISTINCT id) FILTER (split = 'dev') <> 120 OR count(DISTINCT id) FILTER (split = 'test') <> 30 THEN 'INCOMPLETE' WHEN count(*) <> count(id) THEN 'UNASSIGNED' ELSE 'OK' END AS code FROM d GROUP BY 1""")
def e10_manifest_checks(spark, sf_dir):
    """Whether the documents of each language answer all hundred and twenty and thirty questions of the list, and only these."""
    d = s18_manifest(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    split = F.col("split")
    m = d.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.count("id").alias("answered"), F.count_distinct("id").alias("questions"), F.count_distinct(F.when(split == "dev", F.col("id"))).alias("dev"), F.count_distinct(F.when(split == "test", F.col("id"))).alias("test"))
    code = F.when(F.col("answered") == 0, "EMPTY").when((F.col("dev") != 120) | (F.col("test") != 30), "INCOMPLETE").when(F.col("documents") != F.col("answered"), "UNASSIGNED").otherwise("OK")
    return m.withColumn("code", code)


@query("""SELECT n_nationkey AS place, n_name AS title, CASE WHEN n_regionkey = 2 THEN 'full' ELSE 'excerpt' END AS mode, count(c_custkey) AS documents FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def s19_catalogue(spark, sf_dir):
    """A catalogue stored as lines of JSON in its printed order, read with the order kept and joined to what it lists."""
    path = f"{shared_dir(spark)}/folio/catalogue-{uuid.uuid4().hex}"
    entries = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("displayOrder"), F.col("n_name").alias("printedTitle"), F.when(F.col("n_regionkey") == 2, "full").otherwise("excerpt").alias("inclusionMode"))
    entries.repartitionByRange("displayOrder").sortWithinPartitions("displayOrder").write.json(path)
    listed = spark.read.schema("displayOrder long, printedTitle string, inclusionMode string").option("mode", "FAILFAST").json(path)
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("displayOrder")).agg(F.count(F.lit(1)).alias("documents"))
    out = listed.join(counts, "displayOrder", "left").select(F.col("displayOrder").alias("place"), F.col("printedTitle").alias("title"), F.col("inclusionMode").alias("mode"), F.coalesce("documents", F.lit(0)).alias("documents"))
    return out.orderBy("place")


@query("""WITH c AS (SELECT o_custkey AS c, o_orderstatus AS category, l_suppkey AS target FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 5 <> 4 GROUP BY ALL),
r AS (SELECT l_suppkey AS item, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) AS rank FROM lineitem GROUP BY 1 QUALIFY rank <= 10),
p AS (SELECT c, category, count(*) AS targets, count(rank) AS hits FROM c LEFT JOIN r ON item = target GROUP BY 1, 2)
SELECT category, count(*) AS cases, round(sum(hits) / sum(targets), 6) AS recall FROM p GROUP BY GROUPING SETS ((category), ())""")
def e11_dev_split(spark, sf_dir):
    """Recall of one answer for all, the ten most ordered suppliers, on the cases that are not held back."""
    o = table(spark, sf_dir, "orders").filter("o_custkey % 5 <> 4").select(F.col("o_custkey").alias("case"), F.col("o_orderstatus").alias("category"), F.col("o_orderkey").alias("l_orderkey"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("target"))
    top = li.groupBy(F.col("target").alias("item")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "item").limit(10)
    cases = o.join(li, "l_orderkey").select("case", "category", "target").distinct()
    hits = cases.join(F.broadcast(top), F.col("target") == F.col("item"), "left").groupBy("case", "category").agg(F.count(F.lit(1)).alias("targets"), F.count("item").alias("hits"))
    return hits.groupingSets([["category"], []], "category").agg(F.count(F.lit(1)).alias("cases"), F.round(F.sum("hits") / F.sum("targets"), 6).alias("recall"))


# More of the same


@query("SELECT coalesce(max(o_orderdate), TIMESTAMP '1970-01-01') AS version FROM orders")
def a1_corpus_version(spark, sf_dir):
    """The newest change of all, or a fixed time where there is none."""
    return table(spark, sf_dir, "orders").agg(F.coalesce(F.max("o_orderdate"), F.expr("timestamp_ntz'1970-01-01'")).alias("version"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey = (SELECT n_nationkey FROM nation WHERE n_name = 'NATION_3')")
def j12_by_name(spark, sf_dir):
    """Customers of a nation by its name: one key looked up."""
    key = table(spark, sf_dir, "nation").filter("n_name = 'NATION_3'").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, sf_dir, "customer").join(F.broadcast(key), "c_nationkey").select("c_custkey")


@query("SELECT page_id FROM (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS p FROM pages) WHERE p = '/fr' OR starts_with(p, '/fr/')")
def p7_under(spark, sf_dir):
    """Pages at or below one path."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/?#]+([^?#]*)", 1).alias("p"))
    return p.filter(scope.under(F.col("p"), F.lit("/fr"))).select("page_id")


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role))::INT - 1 AS sequence FROM conversations")
def w9_sequence(spark, sf_dir):
    """A running number within each document, from nought."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(rows.alias("r")).select("conv_id", F.posexplode("r").alias("sequence", "x")).select("conv_id", "x.turn", "sequence")


@query("""SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY head DESC, doc_id)::INT AS rank FROM (SELECT t.term, doc_id, contains(left(text, 40), t.term) AS head FROM documents, (VALUES ('License'), ('zzzz'), ('und'), ('the ')) t(term) WHERE contains(text, t.term)) QUALIFY rank <= 10""")
def o10_top_ten(spark, sf_dir):
    """Ten answers at most to each of a stated list of terms, those with it near the front first."""
    terms = F.filter(F.transform(F.array(*[F.lit(t) for t in ("License", "zzzz", "und", "the ")]), lambda t: F.struct(t.alias("term"), F.contains("text", t).alias("hit"), F.contains(F.left("text", F.lit(40)), t).alias("head"))), lambda x: x.hit)
    found = table(spark, sf_dir, "documents").select("doc_id", F.inline(terms))
    by = Window.partitionBy("term").orderBy(F.desc("head"), "doc_id")
    return found.withColumn("rank", F.row_number().over(by)).filter("rank <= 10").select("term", "doc_id", "rank")


_ITEMS = "SELECT user_id AS u, props->>'k' AS item, event_id // 4 AS pack, ts, event_id FROM events"


@query(f"""WITH e AS ({_ITEMS}), v AS (SELECT item, count(*) AS views FROM e GROUP BY 1), x AS (SELECT item, ts, lag(item) OVER w AS p, lag(ts) OVER w AS pt FROM e WINDOW w AS (PARTITION BY u ORDER BY ts, event_id)),
c AS (SELECT p AS item, item AS related, count(*) AS n FROM x WHERE p <> item AND ts <= pt + INTERVAL 600 MINUTE GROUP BY 1, 2), k AS (SELECT DISTINCT pack, item FROM e),
s AS (SELECT a.item, b.item AS related, count(DISTINCT pack) AS n FROM k a JOIN k b USING (pack) WHERE a.item <> b.item GROUP BY 1, 2),
r AS (SELECT c.item, related, n, 'seen together' AS source FROM c JOIN v USING (item) WHERE views >= 50 UNION ALL SELECT s.item, related, n, 'pack' FROM s JOIN v USING (item) WHERE views < 50 OR s.item NOT IN (SELECT item FROM c))
SELECT item, related, source, row_number() OVER (PARTITION BY item ORDER BY n DESC, related)::INT AS rank FROM r QUALIFY rank <= 3""")
def r4_with_fallback(spark, sf_dir):
    """Three recommendations for each item: what was seen after it, or for one with fewer than 50 views, or without any such, what shares a pack with it."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), "ts", F.col("event_id").alias("tie"), F.get_json_object("props", "$.k").alias("item"))
    return usage.with_fallback(usage.cooccurrences(e, minutes=600), usage.pack_counts(e.select(F.floor(F.col("tie") / 4).alias("pack"), "item").distinct()), e.groupBy("item").agg(F.count(F.lit(1)).alias("views")), 3)


@query("""WITH h AS (SELECT p_name AS label, max(ts) AS t FROM events JOIN part ON p_partkey = (props->>'k')::BIGINT WHERE user_id = 8 AND contains(p_name, 'small') GROUP BY 1 ORDER BY t DESC, label LIMIT 5),
a AS (SELECT label, 0 AS source FROM h UNION ALL SELECT DISTINCT p_name, 1 FROM part WHERE starts_with(p_name, 'small') UNION ALL SELECT 'No. ' || p_partkey, 2 FROM part WHERE starts_with(p_partkey::VARCHAR, '12'))
SELECT label, min(source)::INT AS source FROM a GROUP BY 1 ORDER BY source, label LIMIT 10""")
def k6_with_history(spark, sf_dir):
    """Suggestions from one reader's last five matches, then names, then numbers with a prefix; each once, ten at most."""
    p = table(spark, sf_dir, "part")
    e = table(spark, sf_dir, "events").filter("user_id = 8").select(F.get_json_object("props", "$.k").cast("long").alias("p_partkey"), "ts")
    history = e.join(p, "p_partkey").filter(F.contains("p_name", F.lit("small"))).groupBy(F.col("p_name").alias("label")).agg(F.max("ts").alias("t")).orderBy(F.desc("t"), "label").limit(5).select("label", F.lit(0).alias("source"))
    names = p.filter(F.startswith("p_name", F.lit("small"))).select(F.col("p_name").alias("label"), F.lit(1).alias("source")).distinct()
    numbers = p.filter(F.startswith(F.col("p_partkey").cast("string"), F.lit("12"))).select(F.concat(F.lit("No. "), F.col("p_partkey").cast("string")).alias("label"), F.lit(2).alias("source"))
    return history.unionByName(names).unionByName(numbers).groupBy("label").agg(F.min("source").alias("source")).orderBy("source", "label").limit(10)
