"""From raw sources to a published revision: landing, checks, decisions, relations, backfills; over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.functions import references
from folio.functions.text import context_checksum
from folio.operators import digest, revisions, state, temporal, tree_index, verification
from folio.plans.reading import _TREE, V1, geography, indexed, v1_diff
from folio.plans.registering import Register
from folio.sources import backups, snapshots
from folio.sources.stored import kept, shared_dir, stored
from folio.streaming import activity, versions
from folio.tables import table

query = Register()
QUERIES, ORACLES = query.queries, query.oracles


# Sources and sinks


@query("SELECT page_id, sha256(html) AS checksum, strlen(html) AS n_bytes FROM pages")
def s6_checksums(spark, sf_dir):
    """The raw source of each page and its checksum."""
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("checksum"), F.octet_length("html").cast("long").alias("n_bytes"))


@query("""SELECT page_id, contains(html, '<html') AND contains(html, '</html>') AS whole, contains(html, '<body') AS body, regexp_matches(html, '<script[^>]*>') AS script FROM pages""")
def s11_structure(spark, sf_dir):
    """Whether a source has the elements that it must have."""
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", (html.contains("<html") & html.contains("</html>")).alias("whole"), html.contains("<body").alias("body"), html.rlike("<script[^>]*>").alias("script"))


@query("""WITH h AS (SELECT source, sha256(coalesce(text, '')) AS hash, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1, 2) SELECT source, hash, doc_id, n FROM h""")
def s8_artifacts(spark, sf_dir):
    """Raw texts stored once for each source and content hash, written and read again."""
    d = table(spark, sf_dir, "documents").select("source", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("hash"), "doc_id")
    return stored(d.groupBy("source", "hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "artifacts")


@query("""WITH a AS (SELECT p_partkey AS revision, md5(p_name) AS checksum FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_partkey AS revision, md5(CASE WHEN p_partkey % 5 = 0 THEN p_name || 'x' ELSE p_name END) AS checksum FROM part WHERE p_partkey % 3 <> 0)
SELECT b.revision, b.checksum, CASE WHEN a.checksum IS NULL THEN 'stored' WHEN a.checksum = b.checksum THEN 'kept' ELSE 'conflict' END AS outcome FROM b LEFT JOIN a USING (revision)""")
def s9_put(spark, sf_dir):
    """Putting revisions into a store: new ones are stored, equal ones kept, others in conflict."""
    p = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "revision")
    old = p.filter("revision % 2 = 0").select("revision", F.md5("p_name").alias("there"))
    new = p.filter("revision % 3 <> 0").select("revision", F.md5(F.when(F.col("revision") % 5 == 0, F.concat("p_name", F.lit("x"))).otherwise(F.col("p_name"))).alias("checksum"))
    return state.put(new, old)


_ENVELOPE = """WITH refs AS (SELECT o_custkey AS c, o_orderkey AS o, o_orderkey % 40 AS k, o_orderstatus AS s, (o_orderkey % 40) % 4 <> 0 AND o_orderstatus <> 'P' AS ok,
 (o_orderkey % 40 + 1) % 40 % 4 <> 0 AND o_orderstatus <> 'P' AS ok2, o_orderpriority AS tag FROM orders), fine AS (SELECT * FROM refs WHERE c % 10 <> 0)"""


def _envelopes(spark, sf_dir):
    """A backup of each customer, made of their orders; every tenth is cut short."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")

    def ref(n):
        return [F.concat(F.lit("L"), "o_orderstatus").alias("lawId"), (n % 40).cast("string").alias("articleNumberNormalized")]

    kind = F.element_at(F.array(*map(F.lit, ("search", "view", "export", "import", "odd"))), (key % 5).cast("int") + 1)
    lists = {
        "refs": F.struct(*ref(key)), "tags": F.struct(*ref(key), F.when(key % 13 == 0, "").otherwise(F.col("o_orderpriority")).alias("tagName")), "activities": F.struct(kind.alias("type"), key.alias("at")),
        "highlights": F.struct(*ref(key), F.lit(3).alias("rangeStart")), "articleCooccurrences": F.struct(F.struct(*ref(key)).alias("source"), F.struct(*ref(key + 1)).alias("related"), F.lit(2).alias("cooccurCount")),
    }
    rows = F.sort_array(F.collect_list(F.struct("o_orderkey", *[x.alias(n) for n, x in lists.items()])))
    own = o.groupBy("o_custkey").agg(rows.alias("rows")).select("o_custkey", *[F.col("rows")[n].alias(n) for n in lists])
    slug = F.when(F.col("o_custkey") % 11 != 0, F.concat(F.lit("t"), (F.col("o_custkey") % 7).cast("string")))
    whole = F.to_json(F.struct(F.array(F.struct(slug.alias("slug"), F.col("refs").alias("articleRefs"))).alias("practiceTopics"), F.array(F.struct(F.lit("p").alias("name"), F.col("refs").alias("items"))).alias("packs"), "tags", "activities", "highlights", "articleCooccurrences"))
    return own.select(F.col("o_custkey").alias("id"), whole.alias("w")).select("id", F.when(F.col("id") % 10 == 0, F.left("w", F.char_length("w") - 1)).otherwise(F.col("w")).alias("json"))


def _imported(spark, sf_dir):
    items = stored(backups.laid_out(_envelopes(spark, sf_dir)).withColumn("key", F.monotonically_increasing_id()), "backup-items")
    k = table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("k")).distinct().filter("k % 4 <> 0")
    articles = k.select(F.explode(F.array(F.lit("LO"), F.lit("LF"))).alias("law"), F.col("k").cast("string").alias("number"))
    # written, so that the join knows how small it is
    return items, backups.judged(items, stored(articles.withColumn("target", F.concat_ws("/", "law", "number")), "articles"))


@query(_ENVELOPE + """, r AS (SELECT c, 'articlePracticeTopics' AS section, CASE WHEN c % 11 = 0 THEN 'NO_PARENT' WHEN NOT ok THEN 'UNKNOWN_REFERENCE' WHEN row_number() OVER (PARTITION BY c, s, k ORDER BY o) > 1 THEN 'DUPLICATE' ELSE 'imported' END AS outcome FROM fine
UNION ALL SELECT c, 'packItems', CASE WHEN NOT ok THEN 'UNKNOWN_REFERENCE' WHEN row_number() OVER (PARTITION BY c, s, k ORDER BY o) > 1 THEN 'DUPLICATE' ELSE 'imported' END FROM fine
UNION ALL SELECT DISTINCT c, 'practiceTopics', CASE WHEN c % 11 = 0 THEN 'MISSING_TEXT' ELSE 'imported' END FROM fine UNION ALL SELECT DISTINCT c, 'packs', 'imported' FROM fine
UNION ALL SELECT c, 'tags', CASE WHEN NOT ok THEN 'UNKNOWN_REFERENCE' WHEN o % 13 = 0 THEN 'MISSING_TEXT' WHEN row_number() OVER (PARTITION BY c, s, k, tag, o % 13 = 0 ORDER BY o) > 1 THEN 'DUPLICATE' ELSE 'imported' END FROM fine
UNION ALL SELECT c, 'activities', CASE WHEN o % 5 = 4 THEN 'UNKNOWN_VALUE' ELSE 'imported' END FROM fine UNION ALL SELECT c, 'highlights', CASE WHEN ok THEN 'imported' ELSE 'UNKNOWN_REFERENCE' END FROM fine
UNION ALL SELECT c, 'articleCooccurrences', CASE WHEN ok AND ok2 THEN 'imported' ELSE 'UNKNOWN_REFERENCE' END FROM fine UNION ALL SELECT DISTINCT c, 'envelope', 'UNREADABLE' FROM refs WHERE c % 10 = 0)
SELECT c AS envelope, section, outcome, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def s12_import(spark, sf_dir):
    """Backups with six sections read into rows: what each section gives, what is put aside and why."""
    return _imported(spark, sf_dir)[1].groupBy("envelope", "section", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query(_ENVELOPE + "SELECT c AS envelope, o AS \"at\", CASE o % 5 WHEN 0 THEN 'search' WHEN 1 THEN 'view' WHEN 2 THEN 'export' ELSE 'import' END AS type FROM fine WHERE o % 5 < 4")
def s12_activities(spark, sf_dir):
    """The typed rows of one section of the backups."""
    return backups.values(_imported(spark, sf_dir)[1], "activities", {"at": "long", "type": "string"}).select("envelope", "at", "type")


@query("""SELECT o_custkey, to_json(list(struct_pack("key" := o_orderkey, status := o_orderstatus) ORDER BY o_orderkey))::VARCHAR AS json FROM orders GROUP BY 1""")
def s13_export(spark, sf_dir):
    """Each customer's orders as JSON, in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_json(rows).alias("json"))


@query("SELECT p_partkey, p_name, p_size FROM part")
def s14_tab_separated(spark, sf_dir):
    """Rows written as tab-separated text and read back by their schema."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    path = f"{shared_dir(spark)}/folio/tsv-{uuid.uuid4().hex}"
    p.write.csv(path, sep="\t")
    return spark.read.schema(p.schema).csv(path, sep="\t")


_SITE = "^(https?://[^/?#]+)"


@query(f"""WITH l AS (SELECT page_id, regexp_extract(url, '{_SITE}', 1) AS site, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
SELECT DISTINCT page_id, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '/') THEN site || href ELSE site || '/' || href END AS link FROM l
WHERE href <> '' AND NOT starts_with(href, '#')""")
def s15_absolute_links(spark, sf_dir):
    """Links of each page made absolute, once each."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", _SITE, 1).alias("site"), F.explode(references.hrefs(F.col("html"))).alias("href"))
    p = p.filter("href <> '' and not startswith(href, '#')")
    link = F.when(F.col("href").rlike("^https?://"), F.col("href")).when(F.startswith("href", F.lit("/")), F.concat("site", "href")).otherwise(F.concat("site", F.lit("/"), "href"))
    return p.select("page_id", link.alias("link")).distinct()


@query("""SELECT event_id, CASE WHEN json_keys(props) = ['k'] THEN 'ok' ELSE 'UNKNOWN_FIELD' END AS code, try_cast(props->>'k' AS BIGINT) AS k FROM events""")
def s17_whitelisted(spark, sf_dir):
    """Records whose fields are all known, and what a strict reader takes from them."""
    fields = F.json_object_keys("props")
    code = F.when(F.size(F.array_except(fields, F.array(F.lit("k")))) == 0, "ok").otherwise("UNKNOWN_FIELD")
    return table(spark, sf_dir, "events").select("event_id", code.alias("code"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, p_size FROM part WHERE p_partkey % 2 = 1")
def s20_appended(spark, sf_dir):
    """A table made by two appends and read once."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    path = f"{shared_dir(spark)}/folio/appended-{uuid.uuid4().hex}"
    p.filter("p_partkey % 2 = 0").write.parquet(path)
    p.filter("p_partkey % 2 = 1").write.mode("append").parquet(path)
    return spark.read.schema(p.schema).parquet(path)


_DOC = """SELECT o_custkey, to_json(list(struct_pack("key" := o_orderkey, status := o_orderstatus) ORDER BY o_orderkey))::VARCHAR AS json FROM orders GROUP BY 1"""


@query(f"SELECT o_custkey, sha256(json) AS etag, CASE WHEN o_custkey % 3 = 0 THEN 304 ELSE 200 END AS status FROM ({_DOC})")
def s23_etags(spark, sf_dir):
    """Documents with their checksum as a tag, and whether a reader who names one has it already."""
    etag = F.sha2(F.col("json").cast("binary"), 256)
    docs = s13_export(spark, sf_dir).select("o_custkey", etag.alias("etag"))
    asked = F.when(F.col("o_custkey") % 3 == 0, F.col("etag")).otherwise(F.lit("other"))
    return docs.select("o_custkey", "etag", F.when(asked == F.col("etag"), 304).otherwise(200).alias("status"))


_BODY = """SELECT c_nationkey::VARCHAR AS part, c_custkey::VARCHAR AS id, c_name || ':' || CASE WHEN c_nationkey % 5 = 0 AND c_custkey % 7 = 0 THEN 'changed' ELSE c_mktsegment END AS body FROM customer WHERE c_nationkey != 3"""


@query(f"""WITH docs AS ({_BODY}), """ + digest.sql("docs", "part", "id, body", """'{"id":"' || id || '","body":"' || body || '"}'""").replace("WITH leaf", "leaf").replace("AS version FROM one", "AS checksum, CASE WHEN part::INT % 5 = 0 AND part IN (SELECT part FROM docs WHERE body LIKE '%changed') THEN 2 ELSE 1 END AS version FROM one"))
def v16_published(spark, sf_dir):
    """Customers' records published by nation, and again after some have changed and a nation is gone: the parts that are current, and which of the two versions wrote each."""
    path = f"{shared_dir(spark)}/folio/published-{uuid.uuid4().hex}"
    c = table(spark, sf_dir, "customer")
    key = [F.col("c_nationkey").cast("string").alias("part"), F.col("c_custkey").cast("string").alias("id")]
    first = c.select(*key, F.concat("c_name", F.lit(":"), "c_mktsegment").alias("body"))
    new = F.when((F.col("c_nationkey") % 5 == 0) & (F.col("c_custkey") % 7 == 0), "changed").otherwise(F.col("c_mktsegment"))
    one = snapshots.publish(first, path, 0)
    two = snapshots.publish(c.filter("c_nationkey != 3").select(*key, F.concat("c_name", F.lit(":"), new).alias("body")), path, one)
    return snapshots.manifest(spark, path, two).select("part", "checksum", F.substring_index("written", "-", 1).cast("int").alias("version"))


@query("""SELECT p_partkey, sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || '}') AS checksum FROM part""")
def s24_envelope(spark, sf_dir):
    """Checksum of a record as JSON with sorted keys."""
    body = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_size").alias("size")))
    return table(spark, sf_dir, "part").select("p_partkey", F.sha2(body.cast("binary"), 256).alias("checksum"))


# Time


@query("""SELECT event_id, CASE WHEN value IS NULL THEN 'missing' WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'invalid_anchor' WHEN ts < TIMESTAMP '2024-01-02' THEN 'redirect' ELSE 'ok' END AS code,
 CASE WHEN event_type IN ('view', 'click', 'purchase') THEN ts::DATE END AS as_of FROM events""")
def t7_context(spark, sf_dir):
    """What a reader asks for: a known anchor and a date, or the reason why not."""
    known = F.col("event_type").isin("view", "click", "purchase")
    code = F.when(F.col("value").isNull(), "missing").when(~known, "invalid_anchor").when(F.col("ts") < F.expr("timestamp_ntz'2024-01-02'"), "redirect").otherwise("ok")
    return table(spark, sf_dir, "events").select("event_id", code.alias("code"), F.when(known, F.to_date("ts")).alias("as_of"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' to ' || coalesce(strftime(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), '%Y-%m-%d'), 'now') AS label FROM orders""")
def t11_period_labels(spark, sf_dir):
    """From when to when a version holds, in words."""
    v = temporal.with_validity(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")
    days = [F.date_format(c, "yyyy-MM-dd") for c in ("valid_from", "valid_to")]
    return v.select("o_orderkey", F.concat(days[0], F.lit(" to "), F.coalesce(days[1], F.lit("now"))).alias("label"))


@query("""SELECT c_custkey, CASE WHEN n IS NULL THEN 'never' WHEN failed THEN 'failed' WHEN last < TIMESTAMP '1998-01-01' THEN 'stale' ELSE 'fresh' END AS status
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last, max_by(o_orderstatus, (o_orderdate, o_orderkey)) = 'F' AS failed FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) ON o_custkey = c_custkey""")
def t14_display_status(spark, sf_dir):
    """How a document's latest refresh is shown."""
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0")
    latest = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"), (F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")) == "F").alias("failed"))
    status = F.when(F.col("last").isNull(), "never").when(F.col("failed"), "failed").when(F.col("last") < F.expr("timestamp_ntz'1998-01-01'"), "stale").otherwise("fresh")
    return table(spark, sf_dir, "customer").join(latest, "c_custkey", "left").select("c_custkey", status.alias("status"))


@query("""WITH k AS (SELECT o_custkey, count(*) FILTER (o_orderdate <= TIMESTAMP '1996-07-01') AS n, max(o_orderdate) FILTER (o_orderdate <= TIMESTAMP '1996-07-01') AS d FROM orders GROUP BY 1)
SELECT o_custkey, CASE n WHEN 0 THEN 'NOT_FOUND' WHEN 1 THEN 'FOUND' ELSE 'NOT_UNIQUE' END AS outcome, CASE WHEN n = 1 THEN d END AS enforced FROM k""")
def s5_as_of_source(spark, sf_dir):
    """The source that holds for a key on a day: exactly one in force, or the reason why not."""
    day = F.expr("timestamp_ntz'1996-07-01'")
    inside = F.col("o_orderdate") <= day
    k = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(inside).alias("n"), F.max(F.when(inside, F.col("o_orderdate"))).alias("d"))
    outcome = F.when(F.col("n") == 0, "NOT_FOUND").when(F.col("n") == 1, "FOUND").otherwise("NOT_UNIQUE")
    return k.select("o_custkey", outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("d")).alias("enforced"))


# Comparison and checks


@query("""WITH a AS (SELECT doc_id AS key, left(sha256(coalesce(text, '')), 16) AS f, length(coalesce(text, '')) AS n FROM documents WHERE doc_id % 13 <> 1),
b AS (SELECT CASE WHEN doc_id % 7 = 0 THEN doc_id + 1000000 ELSE doc_id END AS key, left(sha256(CASE WHEN doc_id % 5 = 0 THEN coalesce(text, '') || 'x' ELSE coalesce(text, '') END), 16) AS f FROM documents WHERE doc_id % 11 <> 1),
added AS (SELECT f, max(key) AS key FROM b WHERE key NOT IN (SELECT key FROM a) GROUP BY 1), removed AS (SELECT * FROM a WHERE key NOT IN (SELECT key FROM b)),
moved AS (SELECT removed.key AS before, added.key AS after FROM removed JOIN added ON removed.f = added.f AND n > 30)
SELECT a.key AS before, b.key AS after, CASE WHEN a.f = b.f THEN 'unchanged' ELSE 'modified' END AS kind FROM a JOIN b ON a.key = b.key UNION ALL SELECT before, after, 'moved' FROM moved
UNION ALL SELECT key, NULL, 'removed' FROM removed WHERE key NOT IN (SELECT before FROM moved)
UNION ALL SELECT NULL, key, 'added' FROM b WHERE key NOT IN (SELECT key FROM a) AND key NOT IN (SELECT after FROM moved)""")
def v4_moved(spark, sf_dir):
    """Two revisions of documents by fingerprint: what left one key and came back at another has moved, if it is longer than 30 characters."""
    d = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    a = d.filter("doc_id % 13 <> 1").select(F.col("doc_id").alias("key"), "text")
    b = d.filter("doc_id % 11 <> 1").select(F.when(F.col("doc_id") % 7 == 0, F.col("doc_id") + 1_000_000).otherwise(F.col("doc_id")).alias("key"), F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"))
    return revisions.moved(a, b)


_CANDIDATE = """WITH n AS (SELECT c_custkey // 10 % 25 AS law, c_custkey AS i, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 97 = 1 THEN -5 WHEN c_custkey % 50 = 7 THEN c_custkey ELSE c_custkey // 10 * 10 END AS parent,
 'k' || CASE WHEN c_custkey % 31 = 0 THEN c_custkey - 1 ELSE c_custkey END AS key, CASE WHEN c_custkey % 10 = 0 THEN 'chapter' ELSE 'article' END AS level, CASE WHEN c_custkey % 10 BETWEEN 1 AND 8 THEN (c_custkey % 10 // 2)::VARCHAR END AS number, c_acctbal FROM customer),
l AS (SELECT n_nationkey + 2 AS law, coalesce(b, 0) AS b FROM nation LEFT JOIN (SELECT law, count(*) FILTER (c_acctbal > 1000) AS b FROM n GROUP BY 1) x ON x.law = n_nationkey + 2),
c AS (SELECT law, count(*) AS now, count(*) FILTER (level = 'article') AS articles FROM n GROUP BY 1), m AS (SELECT l.law, b, coalesce(now, 0) AS now, coalesce(articles, 0) AS articles FROM l LEFT JOIN c ON c.law = l.law),
e AS (SELECT law, 'EMPTY_DOCUMENT' AS code, NULL AS node, '0' AS detail FROM m WHERE now = 0
UNION ALL SELECT law, 'DUPLICATE_DURABLE_KEY', key, i::VARCHAR FROM n QUALIFY row_number() OVER (PARTITION BY law, key ORDER BY i) > 1
UNION ALL SELECT law, 'ORPHAN_NODE', key, parent::VARCHAR FROM n WHERE parent IS NOT NULL AND (law, parent) NOT IN (SELECT law, i FROM n)
UNION ALL SELECT law, 'CYCLE_DETECTED', key, i::VARCHAR FROM n WHERE parent = i
UNION ALL SELECT law, 'COLLISION_SIBLING_NUMBER', key, level || ':' || number FROM n WHERE number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY law, CASE WHEN (law, parent) IN (SELECT law, i FROM n) THEN parent ELSE -9 END, number ORDER BY i) > 1
UNION ALL SELECT law, 'UNRESOLVED_DIFF', min(key), min(key || ' -> ' || key || 'x') FROM n WHERE i % 13 = 0 AND i % 26 <> 0 GROUP BY law
UNION ALL SELECT law, 'RANGE_UNRESOLVED', 'r' || law, 'VERIFIED_RANGE_NOT_FOUND' FROM l WHERE law % 6 = 0
UNION ALL SELECT law, 'STRUCTURE_CHANGE_REVIEW_REQUIRED', NULL, round((now - b) / b, 4)::VARCHAR FROM m WHERE b > 0 AND abs((now - b) / b) >= 0.2 AND law % 4 <> 0)"""


def _candidate(spark, sf_dir):
    """Customers as nodes of laws, ten a chapter, with faults of every kind; two laws have none."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    tens = F.floor(key / 10)
    parent = F.when(key % 10 == 0, None).when(key % 97 == 1, -5).when(key % 50 == 7, key).otherwise(tens * 10).cast("long")
    name = F.concat(F.lit("k"), F.when(key % 31 == 0, key - 1).otherwise(key).cast("string"))
    number = F.when((key % 10).between(1, 8), F.floor(key % 10 / 2).cast("string"))
    nodes = c.select((tens % 25).alias("law"), key.alias("index"), parent.alias("parent"), name.alias("key"), F.when(key % 10 == 0, "chapter").otherwise("article").alias("level"), number.alias("number"), "c_acctbal")
    law = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 2).cast("long").alias("law"))
    before = nodes.groupBy("law").agg(F.count_if(F.col("c_acctbal") > 1000).alias("nodes_before"))
    laws = law.join(before, "law", "left").fillna(0, ["nodes_before"])
    nodes = nodes.drop("c_acctbal")
    changed = nodes.filter("index % 13 = 0").select("law", F.col("key").alias("key_before"), F.concat("key", F.lit("x")).alias("key_after"), F.lit("renumbered").alias("kind"), "index")
    mappings = changed.filter("index % 26 = 0").select("law", F.col("key_before").alias("from_key"), F.col("key_after").alias("to_key"))
    blocked = F.col("law") % 6 == 0
    ranges = law.select("law", F.concat(F.lit("r"), "law").alias("range_id"), F.when(blocked, "blocked").otherwise("resolved").alias("status"), F.when(blocked, "VERIFIED_RANGE_NOT_FOUND").alias("reason"))
    guards = law.filter("law % 4 = 0").withColumn("guard", F.lit(verification.GUARD))
    return laws, nodes, verification.errors(laws, nodes, changed.drop("index"), ranges, mappings, guards)


@query(_CANDIDATE + " SELECT law, code, node, CASE WHEN code <> 'STRUCTURE_CHANGE_REVIEW_REQUIRED' THEN detail END AS detail FROM e")
def v9_candidate(spark, sf_dir):
    """All eight checks of candidates: empty, repeated keys, missing parents, cycles, numbers twice, differences and ranges that nobody has settled, and too great a change."""
    found = _candidate(spark, sf_dir)[2]
    return found.withColumn("detail", F.when(F.col("code") != verification.GUARD, F.col("detail")))


@query(_CANDIDATE + " SELECT m.law, now AS nodes, articles, CASE WHEN b > 0 THEN round((now - b) / b, 4) ELSE 0 END::DOUBLE AS changed, count(code) AS errors, count(code) = 0 AS publishable FROM m LEFT JOIN e ON e.law = m.law GROUP BY ALL")
def v9_reports(spark, sf_dir):
    """Each law's candidate: how many nodes and articles, how much has changed, and whether it may be published."""
    return verification.report(*_candidate(spark, sf_dir))


@query(f"""WITH d AS ({V1}) SELECT key_before, key_after, kind FROM d WHERE kind IN ('renumbered', 'ambiguous', 'removed') AND NOT coalesce(key_before % 4 = 0, FALSE)""")
def v11_unreviewed(spark, sf_dir):
    """Changes that are held back and that no reviewed decision covers (decisions: keys divisible by 4)."""
    held = v1_diff(spark, sf_dir).filter("kind in ('renumbered', 'ambiguous', 'removed')")
    decided = table(spark, sf_dir, "part").filter("p_partkey % 4 = 0").select(F.col("p_partkey").alias("key_before"))
    return held.join(decided, "key_before", "left_anti").select("key_before", "key_after", "kind")


@query("""SELECT p_partkey, CASE WHEN p_size IS NULL THEN 'INVALID' WHEN p_partkey % 6 = 0 THEN 'EXPECTATION_MISMATCH' ELSE 'ACCEPTED' END AS outcome FROM part WHERE p_partkey % 3 = 0""")
def v13_decisions(spark, sf_dir):
    """Reviewed decisions in JSON against what they expect: size and brand as they are now."""
    p = table(spark, sf_dir, "part")
    said = F.to_json(F.struct(F.when(F.col("p_partkey") % 6 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("size"), F.col("p_brand").alias("brand")))
    d = p.filter("p_partkey % 3 = 0").select("p_partkey", F.from_json(said, "size int, brand string").alias("d"))
    both = d.join(p, "p_partkey")
    outcome = F.when(F.col("d.size").isNull(), "INVALID").when((F.col("d.size") != F.col("p_size")) | (F.col("d.brand") != F.col("p_brand")), "EXPECTATION_MISMATCH").otherwise("ACCEPTED")
    return both.select("p_partkey", outcome.alias("outcome"))


@query("""SELECT c_custkey AS version, CASE WHEN c_custkey % 3 = 1 THEN 'staged' WHEN c_custkey % 4 = 0 THEN 'conflict' ELSE 'reused' END AS outcome FROM customer WHERE c_custkey % 2 = 0""")
def v15_staged(spark, sf_dir):
    """Candidates for a version: reused where the same one is there, in conflict with another, else staged."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("revision"), F.md5("c_name").alias("checksum"))
    old = c.filter("revision % 3 <> 1").select("revision", F.when(F.col("revision") % 4 == 0, F.lit("other")).otherwise(F.col("checksum")).alias("there"))
    found = state.put(c.filter("revision % 2 = 0"), old)
    return found.select(F.col("revision").alias("version"), F.when(F.col("outcome") == "kept", "reused").when(F.col("outcome") == "stored", "staged").otherwise("conflict").alias("outcome"))


@query("""SELECT o_custkey, max_by(CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'held' ELSE 'unchanged' END, (o_orderdate, o_orderkey)) AS status, max(o_orderdate) AS checked_at,
 count(*) FILTER (o_orderstatus = 'F') AS failures FROM orders GROUP BY 1""")
def v17_recorded(spark, sf_dir):
    """The latest outcome of each document's checks, and how often one failed."""
    kind = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "held").otherwise("unchanged")
    latest = F.max_by(kind, F.struct("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(latest.alias("status"), F.max("o_orderdate").alias("checked_at"), F.count_if(F.col("o_orderstatus") == "F").alias("failures"))


@query("""WITH a AS (SELECT p_partkey AS key, p_brand AS law, md5(p_name) AS h FROM part WHERE p_partkey % 17 <> 3), b AS (SELECT p_partkey AS key, p_brand AS law, md5(CASE WHEN p_partkey % 19 = 5 THEN 'x' ELSE p_name END) AS h FROM part WHERE p_partkey % 23 <> 7),
j AS (SELECT coalesce(a.law, b.law) AS law, CASE WHEN b.key IS NULL THEN 1 WHEN a.key IS NULL THEN 2 WHEN a.h <> b.h THEN 3 END AS c FROM a FULL JOIN b ON a.key = b.key)
SELECT law, CASE min(c) WHEN 1 THEN 'SOURCE_MISSING' WHEN 2 THEN 'STORED_MISSING' WHEN 3 THEN 'CHECKSUM_MISMATCH' ELSE 'OK' END AS code, count(c) AS problems FROM j GROUP BY 1""")
def v19_backfill_plan(spark, sf_dir):
    """Stored and source rows of each brand compared on both sides, with a checksum gate; the first of several errors counts."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("law"), "p_name")
    a = p.filter("key % 17 <> 3").select("key", "law", F.md5("p_name").alias("checksum"))
    b = p.filter("key % 23 <> 7").select("key", "law", F.md5(F.when(F.col("key") % 19 == 5, F.lit("x")).otherwise(F.col("p_name"))).alias("checksum"))
    return revisions.set_equality(a, b)


@query("""SELECT 'PARTS' AS code, count(*) = 2000 AS ok, count(*) AS n FROM part UNION ALL SELECT 'BRANDS', count(DISTINCT p_brand) = 25, count(DISTINCT p_brand) FROM part
UNION ALL SELECT 'TYPES', count(DISTINCT p_type) = 6, count(DISTINCT p_type) FROM part UNION ALL SELECT 'UNNAMED', count(*) = 0, count(*) FROM part WHERE p_name IS NULL OR p_name = ''
UNION ALL SELECT 'LOST_LINES', count(*) = 0, count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)""")
def v20_integrity(spark, sf_dir):
    """Whether a catalogue has the counts that it must have, and no row without its parent."""
    p = table(spark, sf_dir, "part")
    lost = table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"), "left_anti")
    counts = p.agg(F.count(F.lit(1)).alias("PARTS"), F.count_distinct("p_brand").alias("BRANDS"), F.count_distinct("p_type").alias("TYPES"), F.count_if(F.col("p_name").isNull() | (F.col("p_name") == "")).alias("UNNAMED"))
    rows = counts.crossJoin(lost.agg(F.count(F.lit(1)).alias("LOST_LINES"))).unpivot([], ["PARTS", "BRANDS", "TYPES", "UNNAMED", "LOST_LINES"], "code", "n")
    wanted = F.when(F.col("code") == "PARTS", 2000).when(F.col("code") == "BRANDS", 25).when(F.col("code") == "TYPES", 6).otherwise(0)
    return rows.select("code", (F.col("n") == wanted).alias("ok"), "n")


@query("""SELECT count(*) AS customers, count(*) FILTER (c_nationkey IS NULL) AS without_nation, count(*) - count(DISTINCT c_name) AS repeated_names, count(*) FILTER (c_acctbal < 0) AS in_debt,
 count(*) FILTER (n IS NULL) AS without_orders, count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) AS other_segments FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1) ON o_custkey = c_custkey""")
def v21_audit(spark, sf_dir):
    """Six counts over current rows in one pass."""
    n = table(spark, sf_dir, "orders").filter("o_orderkey % 4 = 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf_dir, "customer").join(n, "c_custkey", "left")
    return c.agg(
        F.count(F.lit(1)).alias("customers"), F.count_if(F.col("c_nationkey").isNull()).alias("without_nation"), (F.count(F.lit(1)) - F.count_distinct("c_name")).alias("repeated_names"),
        F.count_if(F.col("c_acctbal") < 0).alias("in_debt"), F.count_if(F.col("n").isNull()).alias("without_orders"), F.count_if(~F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).alias("other_segments"),
    )


@query("""SELECT event_id, CASE WHEN props IS NULL OR NOT json_valid(props) THEN 'FATAL' WHEN props->>'k' IS NULL THEN 'FATAL' WHEN (props->>'k')::BIGINT > 90 THEN 'WARNING' ELSE 'OK' END AS level FROM events""")
def v23_envelopes(spark, sf_dir):
    """Envelopes that can't be read, those that look odd, and the others."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").select("event_id", F.when(k.isNull(), "FATAL").when(k > 90, "WARNING").otherwise("OK").alias("level"))


@query(_ENVELOPE + """, n AS (SELECT 'L' || s AS law, k FROM fine UNION SELECT 'L' || s, (k + 1) % 40 FROM fine) SELECT law, k::VARCHAR AS number, k % 4 <> 0 AND law <> 'LP' AS known FROM n""")
def v24_collected(spark, sf_dir):
    """All articles that the sections of the backups name, each once, and whether it is known."""
    k = table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("k")).distinct().filter("k % 4 <> 0")
    articles = k.select(F.explode(F.array(F.lit("LO"), F.lit("LF"))).alias("law"), F.col("k").cast("string").alias("number"), F.lit(True).alias("known"))
    named = backups.references(backups.laid_out(_envelopes(spark, sf_dir)))
    return named.join(articles, ["law", "number"], "left").select("law", "number", F.coalesce("known", F.lit(False)).alias("known"))


# Relations


@query("""WITH c AS (SELECT l_orderkey AS a, l_partkey AS b, max(l_discount * 12) AS confidence FROM lineitem GROUP BY 1, 2)
SELECT md5(a || '|' || b) AS fingerprint, a, b, round(confidence, 6) AS confidence, CASE WHEN confidence > 1 THEN 'INVALID' WHEN a % 3 = 0 THEN 'KNOWN' ELSE 'SAVED' END AS outcome FROM c""")
def l15_candidates(spark, sf_dir):
    """Related pairs saved once by fingerprint; a confidence beyond 1 is refused."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")).agg(F.max(F.col("l_discount") * 12).alias("confidence"))
    c = c.withColumn("fingerprint", F.md5(F.concat_ws("|", "a", "b")))
    known = c.filter("a % 3 = 0").select("fingerprint", F.lit(True).alias("known")).distinct()
    outcome = F.when(~F.col("confidence").between(0, 1), "INVALID").when(F.col("known"), "KNOWN").otherwise("SAVED")
    return c.join(known, "fingerprint", "left").select("fingerprint", "a", "b", F.round("confidence", 6).alias("confidence"), outcome.alias("outcome"))


# What each action makes of each state.
MOVES = [("O", "approve", "F"), ("O", "reject", "R"), ("P", "approve", "F"), ("F", "revoke", "R")]


@query(f"""WITH m(o_orderstatus, action, next) AS (VALUES {", ".join(map(str, MOVES))}), a AS (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'revoke' END AS action FROM orders)
SELECT o_orderkey, coalesce(next, o_orderstatus) AS status, next IS NULL AS refused FROM a LEFT JOIN m USING (o_orderstatus, action)""")
def l16_transitions(spark, sf_dir):
    """States after an action each; an action that the state does not allow is refused."""
    moves = spark.createDataFrame(MOVES, "o_orderstatus string, action string, next string")
    action = F.when(F.col("o_orderkey") % 3 == 0, "approve").when(F.col("o_orderkey") % 3 == 1, "reject").otherwise("revoke")
    o = table(spark, sf_dir, "orders").withColumn("action", action).join(F.broadcast(moves), ["o_orderstatus", "action"], "left")
    return o.select("o_orderkey", F.coalesce("next", "o_orderstatus").alias("status"), F.col("next").isNull().alias("refused"))


@query("""SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS relations FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1""")
def l17_active(spark, sf_dir):
    """Active relations of each source, in order."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'")
    rows = F.array_sort(F.collect_list(F.struct("o_orderpriority", (-F.col("o_totalprice")).alias("p"), "o_orderkey")))
    return o.groupBy("o_custkey").agg(F.array_join(F.transform(rows, lambda x: x.o_orderkey.cast("string")), ",").alias("relations"))


@query("""SELECT o_orderkey AS id, c_name AS source, n_name AS target, o_orderdate AS since FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_custkey % 10 = 3""")
def l12_links_of_revision(spark, sf_dir):
    """All links of one revision (customers that end in 3) with both ends' names."""
    c = table(spark, sf_dir, "customer").filter("c_custkey % 10 = 3")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("target"))
    return table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, "c_nationkey").select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("source"), "target", F.col("o_orderdate").alias("since"))


# Batch jobs


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'r0' ELSE 'r' || p_size END AS current, CASE WHEN p_partkey % 4 = 0 THEN 'kept' ELSE 'initialised' END AS outcome FROM part")
def b1_seeded(spark, sf_dir):
    """Pointers of a catalogue: set where there is none, left where there is."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, "r0").alias("old"), F.concat(F.lit("r"), F.col("p_size").cast("string")).alias("new"))
    return p.select("p_partkey", F.coalesce("old", "new").alias("current"), F.when(F.col("old").isNull(), "initialised").otherwise("kept").alias("outcome"))


@query("""SELECT l_orderkey, bool_and(p_partkey IS NOT NULL) AS verified, count(*) FILTER (p_partkey IS NULL) AS lost, CASE WHEN bool_and(p_partkey IS NOT NULL) THEN string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey) END AS ranges
FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 10) ON p_partkey = l_partkey GROUP BY 1""")
def b2_verified_ranges(spark, sf_dir):
    """Ranges of an entry in order, if all that it names resolves; else what is lost."""
    known = table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("known"))
    li = table(spark, sf_dir, "lineitem").join(known, "l_partkey", "left").groupBy("l_orderkey")
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x.l_partkey.cast("string")), ",")
    lost = F.count_if(F.col("known").isNull())
    return li.agg((lost == 0).alias("verified"), lost.alias("lost"), F.when(lost == 0, rows).alias("ranges"))


@query("""WITH r AS (SELECT e.user_id, c_custkey FROM (SELECT DISTINCT user_id FROM events) e LEFT JOIN customer ON c_custkey = e.user_id * 3 AND c_acctbal > 0) SELECT count(c_custkey) AS created, count(*) - count(c_custkey) AS skipped FROM r""")
def b3_rule_seeding(spark, sf_dir):
    """Rules whose target resolves are made, the others skipped."""
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("wanted"), F.lit(True).alias("known"))
    r = table(spark, sf_dir, "events").select((F.col("user_id") * 3).alias("wanted")).distinct().join(c, "wanted", "left")
    return r.agg(F.count("known").alias("created"), F.count_if(F.col("known").isNull()).alias("skipped"))


@query("""SELECT a.page_id AS source, b.page_id AS target FROM (SELECT DISTINCT page_id, regexp_extract(url, '/([0-9]+)', 1) AS path FROM pages) a JOIN (SELECT page_id, (page_id * 2)::VARCHAR AS path FROM pages) b USING (path)""")
def b5_edges_by_path(spark, sf_dir):
    """Edges between pages by the path that one names and the other has."""
    p = table(spark, sf_dir, "pages")
    a = p.select(F.col("page_id").alias("source"), F.regexp_extract("url", "/([0-9]+)", 1).alias("path")).distinct()
    return a.join(p.select(F.col("page_id").alias("target"), (F.col("page_id") * 2).cast("string").alias("path")), "path").select("source", "target")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'NO_CURRENT_REVISION' WHEN n IS NULL THEN 'REVISION_NOT_FOUND' ELSE 'OK' END AS code, coalesce(n, 0) AS nodes
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1) ON o_custkey = c_custkey""")
def b6_backfill_codes(spark, sf_dir):
    """What a backfill finds for each document before it starts."""
    n = table(spark, sf_dir, "orders").filter("o_orderkey % 5 = 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    code = F.when(F.col("c_custkey") % 9 == 0, "NO_CURRENT_REVISION").when(F.col("n").isNull(), "REVISION_NOT_FOUND").otherwise("OK")
    return table(spark, sf_dir, "customer").join(n, "c_custkey", "left").select("c_custkey", code.alias("code"), F.coalesce("n", F.lit(0)).alias("nodes"))


@query("""WITH a AS (SELECT l_orderkey AS k, l_partkey AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WHERE l_linenumber <= 5),
b AS (SELECT l_orderkey AS k, CASE WHEN l_quantity > 40 THEN l_partkey + 1 ELSE l_partkey END AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WHERE l_linenumber <= 6)
SELECT k, i::INT AS i, a.v AS old, b.v AS new FROM a JOIN b USING (k, i) WHERE a.n = b.n AND a.v <> b.v""")
def b7_positional_changes(spark, sf_dir):
    """Rows of two lists put side by side by place where both are equally long; only those that change."""
    by = Window.partitionBy("k").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "k")

    def side(rows, value, name):
        return rows.select("k", value.alias(name), F.row_number().over(by).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("k")).alias(f"n_{name}"))

    a = side(li.filter("l_linenumber <= 5"), F.col("l_partkey"), "old")
    b = side(li.filter("l_linenumber <= 6"), F.when(F.col("l_quantity") > 40, F.col("l_partkey") + 1).otherwise(F.col("l_partkey")), "new")
    return a.join(b, ["k", "i"]).filter("n_old = n_new and old <> new").select("k", "i", "old", "new")


@query(_TREE + "SELECT id, CASE WHEN depth >= 1 THEN coalesce(ancestors[2], id) END AS nearest FROM t")
def b8_carried_down(spark, sf_dir):
    """The nearest nation at or above each node, carried down the tree; nothing above the first."""
    t = indexed(spark, sf_dir)
    own = F.filter(F.concat("ancestors", F.array("id")), lambda a: a.startswith("n"))
    return t.select("id", F.element_at(F.when(F.size(own) > 0, own), -1).alias("nearest"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'bold' ELSE 'plain' END AS style FROM part")
def b9_restyled(spark, sf_dir):
    """Styles by key where one is given, the old one elsewhere."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    given = p.filter("p_partkey % 3 = 0").withColumn("given", F.lit("bold"))
    return p.join(given, "p_partkey", "left").select("p_partkey", F.coalesce("given", F.lit("plain")).alias("style"))


@query("""SELECT doc_id, CASE WHEN length(text) < 30 THEN 'OUT_OF_BOUNDS' ELSE 'REPLACED' END AS outcome, CASE WHEN length(text) >= 30 THEN sha256(substr(text, 6, 10) || '⟦' || substr(text, 16, 15) || '⟧' || substr(text, 31, 10)) END AS checksum FROM documents WHERE doc_id % 2 = 0""")
def b10_checksum_backfill(spark, sf_dir):
    """Old checksums (with a dash) replaced where the quote lies within the text."""
    d = table(spark, sf_dir, "documents").withColumn("old", F.when(F.col("doc_id") % 2 == 0, "12-ab").otherwise("12ab")).filter(F.contains("old", F.lit("-")))
    inside = F.length("text") >= 30
    return d.select("doc_id", F.when(inside, "REPLACED").otherwise("OUT_OF_BOUNDS").alias("outcome"), F.when(inside, context_checksum(F.col("text"), F.lit(15), F.lit(30))).alias("checksum"))


@query("""WITH d AS (SELECT doc_id, text, left(text, 24) AS head FROM documents), w AS (SELECT * FROM d WHERE doc_id % 10 = 0),
a AS (SELECT w.doc_id, count(*) AS n, min(d.doc_id) AS t FROM w JOIN d ON d.text = w.text AND d.doc_id % 2 = 1 GROUP BY 1), b AS (SELECT w.doc_id, count(*) AS n, min(d.doc_id) AS t FROM w JOIN d ON d.head = w.head AND d.doc_id % 2 = 1 GROUP BY 1)
SELECT w.doc_id, CASE WHEN a.n = 1 THEN a.t WHEN b.n = 1 THEN b.t END AS target, CASE WHEN a.n = 1 THEN 'whole' WHEN b.n = 1 THEN 'head' WHEN a.n > 1 OR b.n > 1 THEN 'ambiguous' ELSE 'none' END AS found FROM w LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)""")
def b11_repair(spark, sf_dir):
    """For every tenth text the one odd document that equals it or, failing that, begins with its first 24 characters; exactly one may."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("whole"), F.left("text", F.lit(24)).alias("head"))
    wanted, odd = d.filter("doc_id % 10 = 0"), d.filter("doc_id % 2 = 1")
    out = wanted
    for key in ("whole", "head"):
        out = out.join(odd.groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{key}"), F.min("doc_id").alias(f"t_{key}")), key, "left")
    one, other = F.col("n_whole") == 1, F.col("n_head") == 1
    found = F.when(one, "whole").when(other, "head").when((F.col("n_whole") > 1) | (F.col("n_head") > 1), "ambiguous").otherwise("none")
    return out.select("doc_id", F.when(one, F.col("t_whole")).when(other, F.col("t_head")).alias("target"), found.alias("found"))


@query("SELECT md5(concat_ws('|', p_brand, CASE WHEN p_size > 25 THEN p_type END, p_partkey)) AS id, p_partkey FROM part")
def b12_migrated_keys(spark, sf_dir):
    """New keys from old columns; those that are null are left out."""
    return table(spark, sf_dir, "part").select(F.md5(F.concat_ws("|", "p_brand", F.when(F.col("p_size") > 25, F.col("p_type")), "p_partkey")).alias("id"), "p_partkey")


@query("""SELECT page_id, strlen(html) - strlen(regexp_replace(html, '<script[^>]*>[^<]*</script>|<style[^>]*>[^<]*</style>', '', 'g')) AS removed FROM pages""")
def b13_cleaned(spark, sf_dir):
    """How much a clean-up by pattern takes away."""
    clean = F.regexp_replace("html", "<script[^>]*>[^<]*</script>|<style[^>]*>[^<]*</style>", "")
    return table(spark, sf_dir, "pages").select("page_id", (F.octet_length("html") - F.octet_length(clean)).cast("long").alias("removed"))


@query("""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) AS tag FROM pages) SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages, min(page_id) AS sample FROM t GROUP BY 1 ORDER BY n DESC, tag LIMIT 5""")
def b14_tag_report(spark, sf_dir):
    """The five most frequent elements of pages, and where one is."""
    t = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), F.lit(1))).alias("tag"))
    return t.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("pages"), F.min("page_id").alias("sample")).orderBy(F.desc("n"), "tag").limit(5)


@query("""SELECT p_partkey, CASE WHEN p_size > 45 THEN 'UNKNOWN_KEY' WHEN p_size < 5 THEN 'WRONG_TYPE' ELSE 'OK' END AS code FROM part""")
def b16_conditions(spark, sf_dir):
    """Condition documents: unknown keys, values of another kind than text, and good ones."""
    doc = F.when(F.col("p_size") > 45, F.lit('{"use": "a", "colour": "b"}')).when(F.col("p_size") < 5, F.lit('{"use": 5}')).otherwise(F.lit('{"use": "a", "zone": "b"}'))
    d = table(spark, sf_dir, "part").select("p_partkey", doc.alias("doc"))
    unknown = F.size(F.array_except(F.json_object_keys("doc"), F.array(F.lit("use"), F.lit("zone")))) > 0
    wrong = F.col("doc").rlike(r':\s*[^"\s]')
    return d.select("p_partkey", F.when(unknown, "UNKNOWN_KEY").when(wrong, "WRONG_TYPE").otherwise("OK").alias("code"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'INCOMPLETE' WHEN event_type = 'signup' THEN 'INVALID_ANCHOR' WHEN value > 50 THEN 'REVISION_MISMATCH' ELSE 'CREATED' END AS outcome FROM events""")
def b17_gated_items(spark, sf_dir):
    """Items that are made only with a whole and fitting snapshot: anchor, date and revision."""
    e = table(spark, sf_dir, "events")
    day = F.when(F.col("event_type") != "error", F.to_date("ts"))
    revision = F.when(F.col("value") > 50, "old").otherwise("now")
    outcome = F.when(day.isNull(), "INCOMPLETE").when(~F.col("event_type").isin("view", "click", "purchase"), "INVALID_ANCHOR").when(revision != "now", "REVISION_MISMATCH").otherwise("CREATED")
    return e.select("event_id", outcome.alias("outcome"))


# Streams, run to their end over a finished source


def _stream(spark, sf_dir, name):
    """A table of the folder as a stream of files."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _run(spark, df, name, mode="append"):
    """All that a stream gives out, written by batches to the shared folder."""
    path = f"{shared_dir(spark)}/folio/stream-{name}-{uuid.uuid4().hex}"
    with activity.rocks_db(spark):
        q = df.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


@query("""WITH m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM events)
SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events FROM events, m GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= any_value(w)""")
def st3_hourly(spark, sf_dir):
    """Events of each hour and kind, as a stream gives them out once the watermark has passed the hour."""
    e = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _run(spark, activity.counts(e), "hourly").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events")


@query("SELECT event_id, user_id FROM events")
def st4_first_deliveries(spark, sf_dir):
    """Events that arrive twice, each kept once."""
    e = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "user_id", "ts")
    return _run(spark, activity.first_deliveries(e.unionByName(e), ["event_id"], late="365 days"), "deliveries").select("event_id", "user_id")


@query("""WITH v AS (SELECT user_id, props->>'k' AS item, ts, lag(props->>'k') OVER w AS p, lag(ts) OVER w AS pt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT p AS item, item AS related, count(*) AS n FROM v WHERE p <> item AND ts <= pt + INTERVAL 30 MINUTE GROUP BY 1, 2""")
def st1_streamed_pairs(spark, sf_dir):
    """What users look at within thirty minutes of something else, from a stream with users' last views as its state."""
    v = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tie"), F.get_json_object("props", "$.k").alias("item"))
    return _run(spark, activity.consecutive_pairs(v), "pairs").groupBy("item", "related").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH w AS (SELECT max(ts) - INTERVAL 30 MINUTE AS mark FROM events), g AS (SELECT user_id, ts, coalesce((ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE)::INT, 1) AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), x AS (SELECT user_id AS "user", min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM s GROUP BY user_id, k)
SELECT "user", start, "end", events FROM x, w WHERE "end" <= mark""")
def st2_sessions(spark, sf_dir):
    """Users' sessions with gaps of less than thirty minutes, those that the watermark has closed."""
    v = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("ts").cast("timestamp").alias("ts"))
    found = _run(spark, activity.sessions(v), "sessions")
    return found.select("user", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "events")


@query("""SELECT o_custkey % 4 AS part, bit_xor(('0x' || substr(md5(o_custkey || ':' || n), 1, 15))::BIGINT) AS version, count(*) AS documents FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1""")
def st5_versions(spark, sf_dir):
    """A digest of each part of a corpus, kept up by a stream of changes that comes in several batches: state for each customer, and a difference for each that a batch changes."""
    path = f"{shared_dir(spark)}/folio/stream-orders-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "orders").select("o_custkey")
    rows.repartition(4).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return versions.versions(_run(spark, versions.changes(stream, "o_custkey"), "versions"), F.col("document") % 4)


# Further trees and summaries


_OLD = _TREE.replace("FROM customer)", "FROM customer WHERE c_acctbal > 0)")


@query(_OLD + "SELECT id, depth FROM t WHERE id = 'n3' OR list_contains(ancestors, 'n3')")
def h3_historical(spark, sf_dir):
    """One nation's subtree as an older revision (customers not in debt) had it."""
    old = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    nodes = geography(spark, sf_dir)
    old_nodes = nodes.filter("not startswith(id, 'c')").unionByName(nodes.join(old, "id", "left_semi"))
    paths = [f"{sf_dir}/{t}.parquet" for t in ("region", "nation", "customer")]
    index = kept(spark, "geography-before", paths, lambda: tree_index.built(old_nodes))
    return tree_index.subtree(index, "n3").select("id", "depth")


@query(_TREE + "SELECT a AS scope, count(*) AS below, max(depth)::INT AS deepest FROM (SELECT unnest(ancestors) AS a, depth FROM t) GROUP BY 1")
def h5_scope_sizes(spark, sf_dir):
    """How many nodes each scope has below it, and how deep they lie."""
    t = indexed(spark, sf_dir).select(F.explode("ancestors").alias("scope"), "depth")
    return t.groupBy("scope").agg(F.count(F.lit(1)).alias("below"), F.max("depth").alias("deepest"))


@query(_TREE + "SELECT t.id, t.parent, t.depth::INT AS depth, coalesce(n, 0) AS children FROM t LEFT JOIN (SELECT parent, count(*) AS n FROM t GROUP BY 1) c ON c.parent = t.id WHERE t.depth < 2 OR (t.depth = 2 AND t.id LIKE '%00')")
def h12_contents(spark, sf_dir):
    """A table of contents: the upper levels, and of the lowest what a rule lets in, with how many children each has."""
    t = indexed(spark, sf_dir)
    n = t.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    listed = t.filter("depth < 2 or (depth = 2 and id like '%00')").select("id", "parent", "depth")
    return listed.join(n, "id", "left").select("id", "parent", "depth", F.coalesce("children", F.lit(0)).alias("children"))


@query(f"WITH changed AS (SELECT kind, coalesce(key_after, key_before)::VARCHAR AS key, count(*) AS c FROM ({V1}) WHERE kind <> 'unchanged' GROUP BY 1, 2), " + digest.sql("changed", "kind", "key", "key").replace("WITH leaf", "leaf")
       .replace("SELECT kind, CASE WHEN count(*) = 1", "SELECT kind, (SELECT sum(c)::BIGINT FROM changed x WHERE x.kind = one.kind) AS n, (SELECT string_agg(key, ',' ORDER BY key) FROM changed x WHERE x.kind = one.kind) AS keys, CASE WHEN count(*) = 1"))
def v3_summary(spark, sf_dir):
    """Changes by kind: how many, all changed keys, each once, in order, and a digest of these."""
    d = v1_diff(spark, sf_dir).filter("kind <> 'unchanged'").withColumn("key", F.coalesce("key_after", "key_before").cast("string"))
    counts = d.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    keys = stored(d.select("kind", "key").distinct(), "changed")
    listed, version = digest.joined(keys, ["kind"], ["key"], F.col("key"), ","), digest.listed(keys, ["kind"], ["key"], F.col("key"), levels=2)
    return counts.join(listed, "kind").join(version, "kind")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS place FROM lineitem""")
def l14_edges_in_order(spark, sf_dir):
    """Edges of each provision by status, then kind, in stated orders."""
    status = F.when(F.col("l_linestatus") == "O", 0).otherwise(1)
    kind = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    by = Window.partitionBy("l_orderkey").orderBy(status, kind, "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(by).alias("place"))
