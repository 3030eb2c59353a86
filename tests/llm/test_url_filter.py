"""URL filter against a plain form of the whole: rules, segmentation, counts and scores."""

import itertools
import math
import re
from collections import Counter

import pytest

pytest.importorskip("folio.llm")
import regex  # noqa: E402
from folio.llm import url_filter  # noqa: E402
from folio.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path, rules):
    fits = [(r, v) for r, v in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(fits, key=lambda x: (len(x[0]), x[0].index("/"), x[0]), default=(None, None))


def split(name, counts, total):
    def worth(w):
        return math.log(counts[w] / total) if counts.get(w) and len(w) <= 24 else -math.log(total) - len(w) * math.log(10)

    def ways(s):
        return [[s[:i], *rest] for i in range(1, len(s) + 1) for rest in (ways(s[i:]) if i < len(s) else [[]])]

    return max(ways(name), key=lambda ws: (round(sum(map(worth, ws)), 9), [len(w) for w in ws[::-1]]))


def judged(pages, texts, rules=url_filter.RULES, seeds=url_filter.SEEDS):
    counts = Counter(w for t in texts for w in regex.findall(r"\p{L}+", (t or "").lower()) if len(w) <= 24)
    share = sum(counts.values()) // 100_000 + 1
    for s in seeds:
        counts[s] = max(counts[s], share)
    total = sum(counts.values()) + 1
    rows = []
    for p, url in pages:
        host, path = cut(url)
        names = regex.findall(r"\p{L}+|\p{N}+", host)
        words = [w for i, x in enumerate(names) for w in (split(x, counts, total) if i < len(names) - 1 and len(x) <= 63 and not regex.match(r"\p{N}", x) else [x])]
        sig = regex.findall(r"[\p{L}\p{N}]+", path.translate(LOWER).translate(str.maketrans("123456789", "0" * 9)))
        rule, verdict = rule_of(host, path, rules)
        rows.append((p, host, path, rule, verdict, words, ["h" + w for w in words] + ["p" + w for w in sig], verdict == "block" or bool(set(words) & set(seeds))))
    good, bad = Counter(), Counter()
    for r in rows:
        (bad if r[7] else good).update(r[6])
    k = len(good | bad)
    n_bad = sum(r[7] for r in rows)
    out = []
    for p, host, path, rule, verdict, words, tokens, _ in rows:
        score = math.log((n_bad + 1) / (len(rows) - n_bad + 1))
        score += sum(math.log((bad[t] + 1) / (bad.total() + k)) - math.log((good[t] + 1) / (good.total() + k)) for t in tokens)
        out.append((p, host, path, rule, verdict or ("block" if score > 0 else "allow"), None if rule else round(score, 6), None if rule else words))
    return out


PAGES = [
    (1, "http://a.example.org/es/1"), (2, "https://example.org/es/"), (3, "https://badexample.org/es/"), (4, "http://example.org/en/17?x=/es/"), (5, "http://EXAMPLE.org/en/2"), (6, "http://a.com/fr/x"),
    (7, "http://b.com/de/1"), (8, "http://com/de/"), (9, "http://a.org"), (10, "http://a.org?x"), (11, "http://a.org#/es/"), (12, "no scheme"), (13, None), (14, ""), (15, "://"), (16, "x://y://z.org/p"),
    (17, "http://cheappills.net/en/1"), (18, "http://thecat.net/en/22"), (19, "http://spamthecat.net/en/22"), (20, "http://user@h.org:80/p"), (21, "http://été.net/à/Ünü"), (22, "http://1.2.3.4/de/5"),
    (23, "http://thecat.net/en/22"), (23, "http://thecat.net/en/22"), (None, "http://casino.net/"), (None, None), (24, f"http://{'thecat' * 11}.net/{'x' * 40}"), (25, "http://.net/"), (26, "HTTP://A.NET/De/9\n?q"), (27, "http://h.net//en/1"),
    *[(100 + i, f"http://cat{'the' * (i % 3)}.net/en/{i}") for i in range(40)],
]
TEXTS = ["the cat sat on the mat", "The cheap hat", None, "", "cat THE cat", "été pills"]


def compared(found):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, None if r.score is None else round(r.score, 6), r.words) for r in found), key=key)


def frames(spark, pages, texts):
    more = "page_id long, url string, host string, path string, m long, score double"
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return spark.createDataFrame([(*p, "h", "p", 1, 0.5) for p in pages], more).repartition(3), docs


@pytest.mark.parametrize("texts", [TEXTS, []])
def test_judged(spark, texts):
    pages, docs = frames(spark, PAGES, texts)
    short = [p for p in PAGES if p[0] != 24]  # the plain form tries all splits
    found = url_filter.judge(pages.filter("page_id <> 24 OR page_id IS NULL"), url_filter.unigrams(docs), page_id=pages["page_id"], url=pages["url"])
    want = judged(short, texts)
    assert compared(found.collect()) == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))
    if texts:
        by = {r[0]: r for r in want}
        assert by[17][6] == ["cheap", "pills", "net"] and by[18][6] == ["the", "cat", "net"] and by[17][4] == "block" and by[18][4] == "allow"
        assert by[4][3] == "example.org/en/1" and by[3][3] == "org/" and by[9][3] is None and by[8][3] == "com/de/"


def test_long_names_stay_whole(spark):
    pages, docs = frames(spark, PAGES, TEXTS)
    found = url_filter.judge(pages, url_filter.unigrams(docs), page_id=pages["page_id"], url=pages["url"])
    row = found.filter("page_id = 24").first()
    assert row.words == ["thecat" * 11, "net"] and found.count() == len(PAGES)


def test_no_pages_and_no_seeds(spark):
    pages, docs = frames(spark, PAGES, TEXTS)
    words = url_filter.unigrams(docs)
    assert url_filter.judge(pages.limit(0), words, page_id=pages["page_id"], url=pages["url"]).collect() == []
    short = [p for p in PAGES if p[0] != 24]
    found = url_filter.judge(pages.filter("page_id <> 24 OR page_id IS NULL"), words, page_id=pages["page_id"], url=pages["url"], seeds=())
    assert compared(found.collect()) == sorted(judged(short, TEXTS, seeds=()), key=lambda r: tuple((x is not None, x) for x in r))


def test_best_split_is_the_best_of_all():
    counts = {"a": 3, "ab": 4, "b": 2, "ba": 1, "aba": 1, "bb": 5}
    for n in range(1, 8):
        for name in map("".join, itertools.product("abx", repeat=n)):
            own = url_filter.best_split(name, counts, 17)
            other = split(name, counts, 17)
            worth = lambda ws: sum(math.log(counts[w] / 17) if w in counts else -math.log(17) - len(w) * math.log(10) for w in ws)
            assert "".join(own) == name and worth(own) == pytest.approx(worth(other))


def test_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = QUERIES["op13_url_filter"](spark, SF).collect()
    assert sorted((r.page_id, r.host, r.path) for r in found) == sorted((r.page_id, *cut(r.url)) for r in pages.collect())
    assert all(r.rule == rule_of(r.host, r.path, url_filter.RULES)[0] and r.verdict in ("allow", "block") for r in found)
