import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

pytest.importorskip("folio.llm")
sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from folio.llm import decontaminate, exact_dedup, jaccard_join, language, licenses, piece_transducer, quality, rans, repeats, sharding, token_files  # noqa: E402
from folio.llm.components import components  # noqa: E402
from folio.llm.queries import vocabulary  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SF = "/root/testdata/sf0.001"
EDGES = [None, "", " \t\n", "word", "A b C", "a" * 3000, "é" * 200, "x y z", "日本語 " * 30, "the same five words here now", "The SAME five words here now"]


def corpus(seed=1, n=60):
    """Texts with exact and near copies, shared passages, ties and edge cases."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    passage = " ".join(r.choice(vocab) for _ in range(20))
    texts = [" ".join(r.choice(vocab) for _ in range(r.choice([3, 5, 30, 80]))) for _ in range(n)]
    for i in range(n // 2):
        w = r.choice(texts).split()
        for _ in range(r.choice([0, 1, 2])):
            w[r.randrange(len(w))] = r.choice(vocab)
        texts.append(" ".join(w))
    texts += [f"{t[:40]} {passage} {t[40:]}" for t in texts[:15]] + EDGES + [texts[0]] * 12
    r.shuffle(texts)
    return list(enumerate(texts))


def frame(spark, rows, more=""):
    schema = "doc_id long, text string" + more
    return spark.createDataFrame(rows, schema).repartition(3) if rows else spark.createDataFrame([], schema)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda t: tuple((x is not None, x) for x in t))


def test_empty_tables(spark):
    docs = frame(spark, [])
    assert repeats.removed_repeats(docs).count() == 0
    assert exact_dedup.exact_dedup(docs).count() == 0
    assert jaccard_join.joined(docs).count() == 0
    assert piece_transducer.encode(docs, vocabulary("piece_bpe_32k.model")).count() == 0
    assert language.identify(docs, None).count() == 0
    assert licenses.scan(docs).count() == 0
    assert sharding.assign_shards(docs).count() == 0
    assert decontaminate.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert token_files.read_token_files(spark, token_files.write_token_files(docs, vocabulary("word_bpe_49k.json"))).count() == 0


def test_extra_columns_and_null_ids(spark):
    rows = [(None, "a b c d e f", "1", 7), (1, "a b c d e f", "2", 8), (1, "a b c d e f", "2", 8), (2, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hashes string, n int")
    assert got(repeats.removed_repeats(docs), "doc_id", "n_bytes") == [(None, 11), (1, 11), (1, 11), (2, 0)]
    assert got(jaccard_join.joined(docs), "doc_id", "component_id") == [(None, None), (1, 1), (1, 1), (2, 2)]
    assert got(exact_dedup.exact_dedup(docs), "doc_id", "group_size") == [(None, 3), (1, 3), (1, 3), (2, 1)]
    assert sorted(r.n_bytes for r in sharding.assign_shards(docs).collect()) == [0, 11, 11, 11]
    assert len(exact_dedup.kept_documents(docs).collect()) == 2
    assert jaccard_join.first_of_each(docs).columns == docs.columns


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats(spark, seed):
    rows = corpus(seed)
    assert got(repeats.removed_repeats(frame(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(rows)


def test_strings_with_one_hash_are_told_apart():
    r = random.Random(11)
    rows = [bytes(r.choice(b"ab") for _ in range(repeats.SIDE)) for _ in range(6)]
    lines = [r.choice(rows) + b"x" * repeats.GRAM + r.choice(rows) for _ in range(200)]
    doc, valid = np.arange(200) // 2, np.full(200, (1 << (repeats.SIDE + 1)) - 1, np.uint32)
    want = []
    for i, line in enumerate(lines):
        own = [line[repeats.SIDE - o : repeats.SIDE - o + repeats.SPAN] for o in range(repeats.SIDE + 1)]
        want.append(sum(1 << o for o, s in enumerate(own) if any(doc[j] < doc[i] and x[repeats.SIDE - o : repeats.SIDE - o + repeats.SPAN] == s for j, x in enumerate(lines))))
    table = np.frombuffer(b"".join(lines), np.uint8).reshape(-1, repeats.WIDTH)
    for mix in (repeats.mixed, lambda x: x & np.uint64(1)):
        assert repeats._open_masks(np.zeros(200, np.uint64), table, valid, doc, mix).tolist() == want


@pytest.mark.parametrize("seed, long_list", [(1, 20_000), (2, 1)])
def test_jaccard_components(spark, seed, long_list):
    rows = corpus(seed)
    assert got(jaccard_join.joined(frame(spark, rows), count_links=False, long_list=long_list), "doc_id", "n_shingles", "component_id") == brute.components(rows)


@pytest.mark.parametrize("long_list", [20_000, 2])
def test_a_chain_of_near_copies_is_one_component(spark, long_list):
    w = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(w[8 * i : 8 * i + 100])) for i in range(30)]
    assert got(jaccard_join.joined(frame(spark, rows), count_links=False, long_list=long_list), "doc_id", "n_shingles", "component_id") == brute.components(rows)


def test_parts_of_a_long_list_name_the_pairs_of_the_whole(spark):
    r = random.Random(5)
    rows = [(7, i, 20, r.randrange(5), r.choice([1, 1, 1, 2, 3, i]), i, 0) for i in range(60)] + [(8, i, 20, 0, 1, 1, 0) for i in range(50)]
    postings = spark.createDataFrame(rows, jaccard_join._POSTING)
    whole, *parts = (got(jaccard_join._candidates(postings, 80, most=m), "x", "y", "known") for m in (1000, 7, 1))
    assert len(whole) > 500 and all(p == whole for p in parts)


@pytest.mark.parametrize("long_list", [20_000, 3])
def test_links_are_counted_within_groups_of_near_copies(spark, long_list):
    r = random.Random(8)
    base, rows = [f"w{i}" for i in range(120)], corpus(8)
    for i in range(40):  # one to three changed words: some pairs are decided by the leader, others are not
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(120)] = f"x{i}"
        rows.append((1000 + i, " ".join(w)))
    sets = [frozenset(brute.shingle_set(t)) for _, t in rows]
    links = {a: sum(a != b and bool(a) and 100 * len(a & b) >= 80 * len(a | b) for b in set(sets)) for a in set(sets)}
    found = got(jaccard_join.joined(frame(spark, rows), long_list=long_list), "doc_id", "n_links")
    assert found == sorted((d, links[a]) for (d, _), a in zip(rows, sets)) and max(n for _, n in found) > 10


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7)]
    found = dict(got(components(spark.createDataFrame(edges, "u long, v long")), "node", "component"))
    assert found == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


@pytest.mark.parametrize("digest", [exact_dedup._sha256, lambda c: c[:1]])
def test_exact(spark, digest):
    rows = corpus(3)
    found = exact_dedup.exact_dedup(frame(spark, rows), digest=digest, limit=500)
    assert got(found, "doc_id", "keep_id", "group_size", "kept") == [r[:4] for r in brute.exact(rows)]


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = corpus(4) + [(500, "a\x1cb\u00a0c \u3000d"), (501, "word " * 60_000), (502, " lead"), (503, "tail \n")]
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want, start = [], 0
    for d, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    path = f"{tmp_path}/files"
    assert token_files.write_token_files(frame(spark, rows), vocabulary("word_bpe_49k.json"), path, block_tokens=70_000, files=2) == path
    again = spark.newSession()  # the folder is all that a reader needs
    assert got(token_files.read_token_files(again, path), "doc_id", "start", "n_tokens", "ids_crc32") == want
    for spread in (None, 5):  # whole blocks; parts from checkpoint to checkpoint, apart
        pieces = defaultdict(list)
        for r in token_files.token_ids(again, path, spread=spread).collect():
            pieces[r.file, r.doc_id].append((r.start, r.ids))
        whole = {d: np.array([i for _, x in sorted(p) for i in x], "<u4") for (_, d), p in pieces.items()}
        assert [(d, len(x), zlib.crc32(x.tobytes())) for d, x in sorted(whole.items())] == [(d, n, c) for d, _, n, c in want]


def test_a_table_of_token_files_is_checked(spark, tmp_path):
    path = token_files.write_token_files(frame(spark, corpus(4)), vocabulary("word_bpe_49k.json"), f"{tmp_path}/files")
    row = spark.read.parquet(f"{path}/table").first()
    with pytest.raises(ValueError):
        rans.Table.unpacked(row.frequencies, row.scale, row.crc ^ 1)


def test_rans_parts_and_checksums():
    ids = np.random.default_rng(1).zipf(1.3, 5000).clip(0, 999).astype(np.uint32)
    table = rans.Table.of_counts(np.bincount(ids, minlength=1000))
    raw = rans.encode(ids, np.array([[0, 5000]]), table, lanes=16, every=8)
    block = rans.Block(raw, table)
    assert (block.ids() == ids).all() and (block.part(3) == ids[3 * 128 : 4 * 128]).all()
    broken = bytearray(raw)
    broken[-3] ^= 1
    with pytest.raises(ValueError):
        rans.Block(bytes(broken), table)


def test_pieces_match_the_library(spark):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = corpus(5) + [(1000 + i, t) for i, t in enumerate(["  lead", " " * 37 + "x", "a\n\n\tb", "};\r\n", "▁x", "x\0y", "1234567890" * 5, "aaab" * 30, "🙂 ok"])]
    found = piece_transducer.decode(piece_transducer.encode(frame(spark, rows), path), path)
    for doc, ids, decoded in got(found, "doc_id", "ids", "decoded"):
        text = dict(rows)[doc] or ""
        want = library.encode(text)
        assert list(np.frombuffer(ids, "<u4")) == want
        assert decoded == text.replace("▁", " ")


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", language.held_out(F.col("doc_id")))
    model = language.train(docs.filter("not held_out"), vocabulary("piece_bpe_32k.model"))
    found = language.identify(docs, model).join(docs.select("doc_id", "lang", "held_out"), "doc_id").filter("held_out")
    assert found.filter("lang = lang_pred").count() >= 0.95 * found.count()
    odd = {r.doc_id: r for r in language.identify(frame(spark, [(1, None), (2, "12 34 ."), (3, ""), (4, "x" * 500)]), model).collect()}
    assert [odd[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and 0 <= odd[4].score <= 1


def test_forward_and_expected_counts_by_enumeration():
    path = vocabulary("piece_bpe_32k.model")
    lattice, table = language.Lattice.at(path), language.start_table(path)
    words = ["▁the", "▁house", "▁日x"]

    def ways(arcs, n, at=0):
        if at == n:
            yield []
        for k in range(len(arcs.piece)):
            if arcs.start[k] == at:
                for rest in ways(arcs, n, int(arcs.end[k])):
                    yield [arcs.spell.get(k, [int(arcs.piece[k])]), *rest]

    want, sums = np.zeros(len(table)), []
    for word, n in zip(words, (1.0, 2.0, 3.0)):
        paths = [[p for x in way for p in x] for way in ways(lattice.arcs([word]), len(word))]
        weights = np.array([table[p, 0].prod() for p in paths])
        sums.append(np.log(weights.sum()))
        for p, w in zip(paths, weights / weights.sum()):
            np.add.at(want, p, n * w)
    assert np.allclose(language.Model(["x"], table, path).log_likelihoods(words)[:, 0], sums)
    found = np.zeros(len(table))
    for piece, share in language._shares(words, np.array([1.0, 2.0, 3.0]), table, lattice):
        np.add.at(found, piece, share)
    assert np.allclose(found, want)


def test_languages_of_long_runs_and_many_languages(spark):
    rows = [(i, f"{'日本語文書' * 30} x", "ja") for i in range(5)] + [(10 + i, "some words of another kind " * 5, "en") for i in range(5)]
    rows += [(100 + i, f"q{'abcdefghij'[i % 10] * 3}{'klmnopqrst'[i // 10 % 10] * 3}{'uvw'[i // 100] * 3} " * 4, f"l{i:03}") for i in range(230)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, vocabulary("piece_bpe_32k.model"))
    assert len(model.langs) == 232
    found = dict(got(language.identify(docs, model), "doc_id", "lang_pred"))
    assert all(found[d] == lang for d, _, lang in rows if d < 100)
    assert sum(found[d] == lang for d, _, lang in rows) > 225


def test_forward_sums_all_segmentations():
    path = vocabulary("piece_bpe_32k.model")
    table = language.start_table(path)
    lattice = language.Lattice.at(path)

    def total(word):
        arcs = lattice.arcs([word])
        ways = {len(word): 1.0}
        for a in range(len(word) - 1, -1, -1):
            ways[a] = sum(np.prod(table[arcs.spell.get(k, [arcs.piece[k]]), 0]) * ways[e] for k, (s, e) in enumerate(zip(arcs.start, arcs.end)) if s == a)
        return np.log(ways[0])

    words = ["▁the", "▁internationalisation", "▁" + "abc" * 20, "▁日本語"]
    assert np.allclose(language.Model(["x"], table, path).log_likelihoods(words)[:, 0], [total(w) for w in words])


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = quality.classify(docs, labels, host=docs["source"], path=docs["lang"]).join(labels, "doc_id")
    assert found.filter("keep = (quality = 1)").count() >= 0.85 * found.count()
    kept = quality.kept_documents(docs, labels, host=docs["source"], path=docs["lang"])
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    one_kind = quality.classify(docs, labels.filter("quality = 1"), host=docs["source"], path=docs["lang"])
    assert one_kind.filter("not keep").count() == 0


def test_decontamination_recall(spark):
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(12, 40)))) for i in range(40)]
    rows, planted = [], set()
    for i, (_, t) in enumerate(items):
        w = t.split()
        if i % 2 and len(w) > 25:
            w[-1] = "other"
        rows.append((i, " ".join([r.choice(vocab) for _ in range(30)] + w + [r.choice(vocab) for _ in range(30)])))
        planted.add((i, i))
    rows += [(100 + i, " ".join(r.choice(vocab) for _ in range(80))) for i in range(40)]
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    found = set(got(decontaminate.contaminated(docs, bench), "doc_id", "item_id"))
    assert found <= planted and len(found) >= 0.97 * len(planted)
    assert decontaminate.clean_documents(docs, bench).count() == len(rows) - len({d for d, _ in found})


def test_decontamination_recall_at_the_threshold(spark):
    r = random.Random(12)
    vocab = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([7, 9, 12, 15, 25, 40, 80])))) for i in range(60)]
    rows = []
    for n in range(600):
        w = r.choice(items)[1].split()
        for _ in range(r.randint(0, 2 + len(w) // 30)):  # mostly at the passage's ends, so that some stay similar
            w[r.choice([0, 1, -1, -2, r.randrange(len(w))])] = r.choice(vocab)
        rows.append((n, " ".join([r.choice(vocab) for _ in range(r.randint(0, 20))] + w + [r.choice(vocab) for _ in range(r.randint(0, 20))])))
    want = brute.contaminated(rows, items)
    found = set(got(decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")), "doc_id", "item_id"))
    assert found <= set(want) and len(want) > 150 and len(found) >= 0.9 * len(want)
    close = {p for p, s in want.items() if s < 0.9}  # near the threshold
    assert len(close) > 40 and len(found & close) >= 0.9 * len(close)


def test_multi_index_finds_all_within_the_radius():
    r = np.random.default_rng(5)
    items = decontaminate.Items(list(range(50)), [" ".join(f"v{i}x{j}" for j in range(10)) for i in range(50)])
    prints = np.concatenate([items.prints, r.integers(0, 1 << 63, 4000).astype(np.uint64)])
    for i in range(3000):
        p = int(items.prints[i % 50])
        for b in r.choice(64, r.integers(0, 20), replace=False):
            p ^= 1 << int(b)
        prints[50 + i] = p
    window, item = items.near(10, prints)
    apart = np.bitwise_count(prints[:, None] ^ items.prints[None, :])
    assert set(zip(window.tolist(), item.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(apart <= decontaminate.RADIUS))))


def test_decontamination_of_documents_shorter_than_an_item(spark):
    r = random.Random(10)
    vocab = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(30, 60)))) for i in range(40)] + [(90, "p q r s t u v w")]
    rows = []
    for i, t in items[:40]:
        w = t.split()
        rows.append((i, " ".join([w[:-1], w[1:], w[:-2], w[1:-1]][i % 4])))
    rows += [(90, "p q r s t u v"), (91, "p q r s")]  # 3 of 4 shingles; no shingle
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    found = got(decontaminate.contaminated(docs, bench), "doc_id", "item_id", "start_word", "n_words", "start_byte", "end_byte")
    texts = dict(rows)
    assert all(f == (f[0], f[0], 0, len(texts[f[0]].split()), 0, len(texts[f[0]])) and f[0] < 40 for f in found)
    assert len(found) >= 0.97 * 40
    assert decontaminate.clean_documents(docs, bench).count() == len(rows) - len(found)
    assert [f[0] for f in got(decontaminate.contaminated(docs, bench, threshold=0.75, radius=31), "doc_id", "item_id") if f[0] >= 40] == [90]


def test_licenses(spark):
    mit = licenses.TEMPLATES["mit"]
    rows = [(1, "x y " + mit + " z"), (2, "words " * 50), (3, None), (4, mit.upper()), (5, mit[:200])]
    found = set(got(licenses.scan(frame(spark, rows)), "doc_id", "template"))
    assert found == set(got(licenses.scan(frame(spark, rows), most=4), "doc_id", "template"))  # in parts
    assert {(1, "mit"), (4, "mit")} <= found and not {d for d, _ in found} & {2, 3, 5}


def test_shards_fit(spark):
    rows = corpus(6)
    found = sharding.assign_shards(frame(spark, rows), limit=2000).toPandas()
    assert len(found) == len(rows)
    sums = found.groupby(["shard", "page"]).n_bytes.agg(["sum", "count"])
    assert ((sums["sum"] <= 2000) | (sums["count"] == 1)).all()
    shards = set(found.shard)
    assert not any(a != b and b.startswith(a) for a in shards for b in shards)
    same = sharding.assign_shards(frame(spark, [(1, "abcd")] * 50), limit=20).toPandas()
    assert len(same) == 50 and (same.groupby(["shard", "page"]).n_bytes.sum() <= 20).all()


def test_written_shards_hold_each_row_once(spark, tmp_path):
    rows = corpus(7)
    rows += [(None, t) for _, t in rows[:20]] + [(5, t) for _, t in rows[20:60]] + [(None, None)] * 3 + [(9, "abcd" * 50)] * 30
    docs = frame(spark, [(d, t, f"m{i}") for i, (d, t) in enumerate(rows)], ", more string")
    sharding.write_shards(docs, f"{tmp_path}/shards", limit=2000)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert got(back, "doc_id", "text", "more") == got(docs, "doc_id", "text", "more")
    sums = back.groupBy("_shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b"), F.count("*").alias("n")).collect()
    assert len(sums) > 1 and all(r.b <= 2000 or r.n == 1 for r in sums)
