"""Each registered core query against its SQL on the same tables."""

import decimal
import hashlib
import re
import unicodedata

import duckdb
import pytest
from folio.plans import registry
from folio.tables import NAMES

SF = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, decimal.Decimal):
        return round(float(x), 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, sql, name):
    df = registry.queries()[name](spark, SF)
    found = sql.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, found.fetchall())


def test_every_query_has_sql():
    assert registry.queries().keys() - registry.oracle_sql().keys() == {"n11_normal_bodies"}  # see below


def test_normal_bodies(spark, tmp_path):
    rows = [(1, " Déja\u0300 \t vu "), (2, "ｆｕｌｌ　ｗｉｄｔｈ ①"), (3, "ﬁne\u00a0print\n"), (4, None), (5, ""), (6, "プ" * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    own = {d: None if t is None else hashlib.sha256(re.sub("[ \t\n\v\f\r]+", " ", unicodedata.normalize("NFKC", t)).strip(" ").encode()).hexdigest()[:16] for d, t in rows}
    assert {r.doc_id: r.fingerprint for r in registry.queries()["n11_normal_bodies"](spark, str(tmp_path)).collect()} == own


def test_fingerprints_of_every_script(spark, tmp_path):
    rows = [(1, " Déjà \t vu "), (2, "\u201cquoted\u201d text"), (3, "日本語の文書 " * 8), (4, "plain"), (5, None), (6, ""), (7, "\u00a0a\u3000")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for d, t in rows:
        own = None if t is None else hashlib.sha256(re.sub("[ \t\n\v\f\r]+", " ", t).strip(" ").encode()).hexdigest()[:16]
        want.add((d, own, None if t is None else t[:32], t[-32:] if t and len(t) > 32 else ""))
    found = registry.queries()["n12_all_fingerprints"](spark, str(tmp_path))
    assert {(r.doc_id, r.fingerprint, r.prefix, r.suffix) for r in found.collect()} == want and found.count() == len(rows)
