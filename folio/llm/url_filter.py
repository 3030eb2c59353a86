"""URL filter: rules by host and path, then naive Bayes over the words of a segmented host and the tokens of the path.

A rule names a host and the beginning of a path; it fits that host and its subdomains, and the longest rule that fits decides.
Where none fits, the method does:

Segmentation. A host's runs of letters are names. Each distinct name is laid out as all its parts of MAX_WORD letters at
most; the parts meet a table of word counts in a join, and a unigram Viterbi over a name's own known parts splits it into the most probable
words. An unknown run of k letters is as probable as a word seen once, over 10**k. A host's last name (its top domain) and a name longer
than a DNS label (MAX_NAME letters, which no registered host has) are words of their own.

Classes. A page is unwanted if a rule blocks it or its host has a word of a list of unwanted words (SEEDS); all
other pages count as wanted, as in learning from positive and unlabelled rows. Multinomial naive Bayes, smoothed by one, learns
from all pages, so that words that keep unwanted company count too. Tokens are told apart by side (host or path); digits of a path
count as 0, so that numbers of one length are one token.

Pages are first counted by host and tokens of the path; words are counted and scored once for each distinct host and each
distinct list of path tokens, and their scores go back to the pages. In each join, keys that a ten-thousandth of the rows have are broadcast.

Defined cases: a null url, or one without ://, has an empty host and path, no rule and no token, so the classes' shares decide; equal scores
allow; a page_id that is null or repeats is a row like others; without words every name is an unknown one; an empty
table gives an empty result; further columns are left out of the result, whatever their names; hosts and paths of any length are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import met, written

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Words of hosts that a corpus of texts leaves out.
SEEDS = (
    "ads", "adult", "bet", "bets", "betting", "casino", "cialis", "escort", "gambling", "jackpot", "lottery", "malware", "phishing",
    "pills", "poker", "popup", "porn", "replica", "sex", "slots", "spam", "tracker", "viagra", "warez", "xxx",
)
MAX_WORD = 24
MAX_NAME = 63
#: A seed counts as a word as often as one in so many words of the corpus, at least.
SEED_SHARE = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts_of(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, form, i), F.lit("")) for i in (1, 2))
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """rule and verdict of the longest rule that fits, as a struct of nulls where none does; of rules of one length that with the longer host."""
    found = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0].index("/"), r[0])):
        own, start = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def unigrams(docs: DataFrame, text: str = "text") -> DataFrame:
    """word and n: how often each run of letters, lower-cased, stands in the texts; runs longer than MAX_WORD are none."""
    word = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+"), F.lit(0))).alias("word")
    return docs.select(word).filter(F.char_length("word") <= MAX_WORD).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def best_split(name: str, known: dict[str, int], total: int) -> list[str]:
    """The most probable words of a name; of equally probable splits that with the longest last word."""
    at: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - MAX_WORD), end):
            n = known.get(name[start:end], 0)
            options.append((at[start][0] + (math.log(n / total) if n else -math.log(total) - (end - start) * math.log(10)), -start))
        score, start = max(options)
        at.append((score, -start))
    words, end = [], len(name)
    while end:
        words.append(name[at[end][1] : end])
        end = at[end][1]
    return words[::-1]


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """name (distinct, MAX_NAME letters at most) and its words; words: word and n."""
    total = (words.agg(F.sum("n")).first()[0] or 0) + 1
    size = F.char_length("name")
    ends = F.explode(F.sequence(F.lit(1), F.least(F.lit(MAX_WORD), size - F.col("start") + 1)))
    parts = names.select("name", F.explode(F.sequence(F.lit(1), size)).alias("start")).select("name", "start", ends.alias("n")).selectExpr("name", "substring(name, start, n) AS word").distinct()
    parts = written(parts, "url-parts")
    facts = written(parts.groupBy("word").agg(F.count(F.lit(1)).alias("m")).join(words, "word"), "url-known")
    # a name has at most MAX_NAME * MAX_WORD parts
    known = met(parts, facts, ["word"], parts.count()).groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def f(batches):
        for batch in batches:
            names = batch.column("name").to_pylist()
            out = [best_split(x, {k["word"]: k["n"] for k in known or ()}, total) for x, known in zip(names, batch.column("known").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(out, pa.list_(pa.string()))], names=["name", "words"])

    return names.join(known, "name", "left").mapInArrow(f, "name string, words array<string>")


def hosts_in_words(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """The distinct hosts with the column words."""
    names = F.regexp_extract_all("host", F.lit(r"\p{L}+|\p{N}+"), F.lit(0))
    named = written(hosts.select("host", F.posexplode(names).alias("place", "name"), F.size(names).alias("count")), "url-names")
    split = (F.col("place") < F.col("count") - 1) & (F.char_length("name") <= MAX_NAME) & F.col("name").rlike(r"^\p{L}")
    own = named.filter(split).select("host", "place", "name")
    facts = written(own.groupBy("name").agg(F.count(F.lit(1)).alias("m")), "url-distinct-names")
    facts = written(facts.join(segmented(facts.select("name"), words), "name"), "url-split-names")
    parts = met(own, facts, ["name"], own.count()).select("host", "place", "words")
    parts = parts.unionByName(named.filter(~split).select("host", "place", F.array("name").alias("words")))
    # the names of one host
    whole = parts.groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "words"))), lambda p: p["words"])).alias("words"))
    return hosts.join(whole, "host", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))


def _summed(keyed: DataFrame, key: str, weights: DataFrame) -> DataFrame:
    """key and score, the sum of its tokens' weights; keyed has each key once, with its tokens."""
    rows = keyed.select(key, F.explode("tokens").alias("token"))
    return keyed.select(key).join(met(rows, weights, ["token"], rows.count()).groupBy(key).agg(F.sum("weight").alias("score")), key, "left").select(key, F.coalesce("score", F.lit(0.0)).alias("score"))


def judge(
    pages: DataFrame, words: DataFrame, *, page_id: Column, url: Column, rules: Sequence[tuple[str, str]] = RULES, seeds: Sequence[str] = SEEDS
) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log odds of blocking; null where a rule decides) and words of the host."""
    host, path = parts_of(url)
    tokens = F.regexp_extract_all(F.translate(F.translate("path", "123456789", "000000000"), _UPPER, _LOWER), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    rows = pages.select(page_id.alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.select("*", tokens.alias("sig"), rule_of(F.col("host"), F.col("path"), rules).alias("_")).select("page_id", "host", "path", "sig", "_.rule", "_.verdict")
    rows = written(rows, "url-rows")
    units = written(rows.groupBy("host", "sig").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "block").alias("blocked")), "url-units")
    counts = units.groupBy("host").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("pages"))
    words = written(words, "url-words")
    if seeds:
        total = words.agg(F.sum("n")).first()[0] or 0
        more = pages.sparkSession.createDataFrame([(s, total // SEED_SHARE + 1) for s in seeds], "word string, n long")
        words = words.unionByName(more).groupBy("word").agg(F.max("n").alias("n"))
    hosts = hosts_in_words(written(counts, "url-hosts"), words)
    hosts = written(hosts.withColumn("seeded", F.arrays_overlap("words", F.array(*map(F.lit, seeds))) if seeds else F.lit(False)), "url-segmented")
    bad = F.when(F.col("seeded"), F.col("n")).otherwise(F.col("blocked"))
    labelled = met(units, hosts.select("host", "m", "seeded"), ["host"], units.count()).select("host", "sig", "n", bad.alias("bad"))
    labelled = written(labelled, "url-labelled")
    both = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]

    def sided(side: str, column: str) -> Column:
        return F.transform(column, lambda w: F.concat(F.lit(side), w)).alias("tokens")

    by_host = hosts.select("host", sided("h", "words")).join(labelled.groupBy("host").agg(*both), "host")
    by_path = labelled.groupBy("sig").agg(*both).select("sig", sided("p", "sig"), "n", "bad")
    by_host, by_path = written(by_host, "url-by-host"), written(by_path, "url-by-path")
    counted = by_host.select("tokens", "n", "bad").unionByName(by_path.select("tokens", "n", "bad"))
    # m: rows that meet a token when scores are summed, of hosts or of paths
    tokens = written(counted.select(F.explode("tokens").alias("token"), "n", "bad").groupBy("token").agg(*both, F.count(F.lit(1)).alias("m")), "url-tokens")
    sums, priors = tokens.agg(*both, F.count(F.lit(1)).alias("k")).first(), labelled.agg(*both).first()
    bad_of, good_of = (sums.bad or 0) + sums.k, (sums.n or 0) - (sums.bad or 0) + sums.k
    weight = F.log((F.col("bad") + 1) / F.lit(float(bad_of or 1))) - F.log((F.col("n") - F.col("bad") + 1) / F.lit(float(good_of or 1)))
    weights = tokens.select("token", "m", weight.alias("weight"))
    prior = math.log(((priors.bad or 0) + 1) / ((priors.n or 0) - (priors.bad or 0) + 1))

    open_rows = rows.filter("rule IS NULL")
    host_scores = open_rows.groupBy("host").agg(F.count(F.lit(1)).alias("m")).join(_summed(by_host, "host", weights).withColumnRenamed("score", "host_score"), "host")
    path_scores = open_rows.groupBy("sig").agg(F.count(F.lit(1)).alias("m")).join(_summed(by_path, "sig", weights).withColumnRenamed("score", "path_score"), "sig")
    host_scores = host_scores.join(hosts.select("host", "words"), "host")
    n = open_rows.count()
    scored = met(open_rows, written(host_scores, "url-host-scores"), ["host"], n).drop("m")
    scored = met(scored, written(path_scores, "url-path-scores"), ["sig"], n)
    score = F.lit(prior) + F.col("host_score") + F.col("path_score")
    columns = ["page_id", "host", "path", "rule", "verdict", "score", "words"]
    decided = scored.withColumn("score", score).withColumn("verdict", F.when(F.col("score") > 0, "block").otherwise("allow")).select(*columns)
    ruled = rows.filter("rule IS NOT NULL").select("page_id", "host", "path", "rule", "verdict", F.lit(None).cast("double").alias("score"), F.lit(None).cast("array<string>").alias("words"))
    return ruled.unionByName(decided)
