"""N-gram Jaccard join with skipping by set relations, and the components of its links.

A document's set: the distinct 5-word shingles (64-bit hashes). Sets link when intersection * 100 >=
80 * union. (1) Shingles are counted over all documents (see exchange); a set of which fewer than 80 %
occur elsewhere links with nothing and is done. Equal sets become one, with the smallest doc_id.
(2) Leaders: of the sets with the same smallest hash (under two orders) the smallest doc_id is compared
with each other one; each set keeps its most similar leader's answer. (3) Lists: by prefix filtering,
linked sets share one of the n - ceil(0.8 n) + 1 shingles that come first in the order of (count, hash).
Lists whose members are connected by now are skipped whole, longer ones than LONG_LIST
are dealt over tasks in blocks (two parts of a list meet in one); in others, blocks of members with the same
size are skipped by size, and members within a block by position. For two sets with the same
leader, its answers bound their intersection: n(x) and n(y) and their distances from the leader decide
many pairs without their shingles. The rest are compared exactly. (4) Links make components.

No pair within a group of copies is listed for that: after (2) its lists are skipped. n_links is counted
apart, over all lists: sets of one leader in aggregate where its answers decide, all other pairs by comparison. Kept shingles are cut to 48
bits for comparison.

Defined cases: lower case of A-Z only; words are [^\\x20\\x09-\\x0D]+; fewer than 5 words make one
shingle of all; null, empty or blank texts have an empty set and link with nothing; a row with
a null doc_id takes part in no link (its component is null); repeated rows are each returned; an empty table gives an empty result; further columns are left alone,
whatever their names; a text longer than a batch (STEP_BYTES) is a batch of its own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.components import components
from folio.llm.exchange import batched, codes_of, counted, opened, pack, pack_sorted, route_of, spots, unpack, unpack_sorted
from folio.llm.shared import STEP_BYTES, Texts, met, mixed, numbered, partitions, renamed, shingles, words, written

K = 5
PERCENT = 80
_SEEDS = (np.uint64(0x1234567), np.uint64(0x89ABCDEF1))
_PAIRS = 200_000
LONG_LIST = 20_000


def sets_of(texts: Texts, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each text's distinct shingles, ascending by both."""
    row, _, value = shingles(words(texts), k)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[first], value[first]


def needed(n: int, percent: int) -> int:
    """Shingles that a set of n shares at least with any set that it links with."""
    return -(-n * percent // 100)


def overlap(nx, ny, percent: int):
    """Shingles that sets of nx and ny share at least if they link."""
    return -(-(nx + ny) * percent // (100 + percent))


_SET = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("hashes", pa.binary()), ("codes", pa.binary())])


def document_sets(docs: DataFrame, *, k: int = K, percent: int = PERCENT, batch_bytes: int = STEP_BYTES, **route) -> DataFrame:
    """doc_id and n of every document; fingerprint, keys for leaders and the shingles that occur elsewhere of those that may link."""
    batches = batched(docs, "jaccard-batches", batch_bytes)
    route = route_of(batches, **route)
    buckets = route.buckets

    def f(rows):
        for b in rows:
            for i in range(b.num_rows):
                _, ids, texts = opened(b, i)
                row, value = sets_of(texts, k)
                where = spots(value, buckets)
                code = codes_of(b, i)[np.searchsorted(np.unique(where), where)] if len(value) else np.zeros(0, np.uint8)
                n = np.bincount(row, minlength=len(ids))
                edges = np.concatenate([[0], np.cumsum(n)])
                shared = np.bincount(row, code > 0, minlength=len(ids)).astype(np.int64)
                known: set = set()
                out: list[list] = [[] for _ in _SET]
                for j, doc in enumerate(ids):
                    own = [doc, int(n[j]), None, None, None, None, None, None]
                    if n[j] and shared[j] * 100 >= percent * n[j]:
                        h, c = value[edges[j] : edges[j + 1]], code[edges[j] : edges[j + 1]]
                        prints = [int(mixed(h ^ s).sum(dtype=np.uint64).astype(np.int64)) for s in _SEEDS]
                        own[2:4] = prints
                        if tuple(prints) not in known:  # of equal sets of a batch, one has the shingles
                            known.add(tuple(prints))
                            h, c = h[c > 0], c[c > 0]
                            own[4:6] = [int(mixed(h + s).min().astype(np.int64)) for s in _SEEDS]
                            own[6:8] = [pack_sorted(h >> np.uint64(16)), pack(c)]
                    for col, x in zip(out, own):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(out, _SET)], schema=_SET)

    found = counted(batches, lambda t: sets_of(t, k)[1], route)
    return written(found.mapInArrow(f, "doc_id long, n long, f1 long, f2 long, k1 long, k2 long, hashes binary, codes binary"), "jaccard-sets", "none")


def _tokens(hashes: bytes) -> np.ndarray:
    return unpack_sorted(hashes, np.uint64)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """x, y, nx, ny and inter (size of the intersection) of the pairs (x, y) of set numbers."""
    own = sets.select(F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("hashes").alias("hx"))
    other = sets.select(F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("hashes").alias("hy"))
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("nx", pa.int64()), ("ny", pa.int64()), ("inter", pa.int64())])

    def f(rows):
        last, tokens = None, None
        for b in rows:
            inter = []
            for y, hx, hy in zip(b.column("y").to_pylist(), b.column("hx"), b.column("hy")):
                if y != last:
                    last, tokens = y, _tokens(hy.as_py())
                mine = _tokens(hx.as_py())
                at = np.searchsorted(tokens, mine)
                at[at == len(tokens)] = 0
                inter.append(int((tokens[at] == mine).sum()))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("x", "y", "nx", "ny")] + [pa.array(inter, pa.int64())], schema=schema)

    return pairs.join(own, "x").join(other, "y").select("x", "y", "nx", "ny", "hx", "hy").mapInArrow(f, "x long, y long, nx long, ny long, inter long")


def _linked(percent: int):
    return 100 * F.col("inter") >= percent * (F.col("nx") + F.col("ny") - F.col("inter"))


def _leaders(sets: DataFrame) -> DataFrame:
    """Pairs (x, y): y is the smallest of the sets that share a smallest hash with x."""
    keyed = sets.select("rep", F.posexplode(F.array("k1", "k2")).alias("order", "key"))
    least = keyed.groupBy("order", "key").agg(F.min("rep").alias("y"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("m")).filter("y <> last").drop("last")
    rows = met(keyed, written(least, "jaccard-least"), ["order", "key"], 2 * sets.count())
    return rows.filter("rep <> y").select(F.col("rep").alias("x"), "y").distinct()


_POSTING = "token long, rep long, n long, place int, comp long, lead long, d long"


def _postings(sets: DataFrame, percent: int) -> DataFrame:
    """A row for each shingle of each set's prefix: place in it, component so far, leader and distance from it."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(["token", "rep", "n", "place", "comp", "lead", "d"], kinds)))

    def f(rows):
        for b in rows:
            for r in b.to_pylist():
                h, c = _tokens(r["hashes"]), unpack(r["codes"], np.uint8)
                alone = r["n"] - len(h)  # these come first and are in no other set
                take = r["n"] - needed(r["n"], percent) + 1 - alone
                h = h[np.lexsort((h, c))[:take]]
                m = len(h)
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(np.full(m, r["rep"])), pa.array(np.full(m, r["n"])), pa.array(np.arange(alone, alone + m, dtype=np.int32)), pa.array(np.full(m, r["comp"])), pa.array(np.full(m, r["lead"])), pa.array(np.full(m, r["d"]))], schema=schema)

    return sets.select("rep", "n", "hashes", "codes", "comp", "lead", "d").mapInArrow(f, _POSTING)


def _of_list(members: dict[str, np.ndarray], percent: int, across: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a list that may link, and whether they are known to, by size, position, component and leader; some at a time.

    Members of role 1 are paired with those of other roles and, unless across, with each other.
    """
    order = np.lexsort((members["place"], members["n"]))
    rep, n, place, comp, lead, d, role = (members[k][order] for k in ("rep", "n", "place", "comp", "lead", "d", "role"))
    sizes, first = np.unique(n, return_index=True)  # blocks of one size, by place
    last = np.append(first[1:], len(n))
    xs, ys, sure, size = [], [], [], 0
    for i in np.flatnonzero(role == 1):
        low, high = np.searchsorted(sizes, needed(n[i], percent)), np.searchsorted(sizes, 100 * n[i] // percent, "right")
        for block in range(low, high):
            least = overlap(n[i], sizes[block], percent)
            room = n[i] - place[i]
            if room < least:
                continue
            a = first[block]
            b = a + np.searchsorted(place[a : last[block]], sizes[block] - least, "right")
            j = np.arange(a, b)
            j = j[(comp[j] != comp[i]) & ((role[j] != 1) | (not across and j > i))]
            if not len(j):
                continue
            same = lead[j] == lead[i]
            apart = n[i] + n[j] - 2 * least  # the largest symmetric difference of a link
            fits = ~same | (np.abs(d[i] - d[j]) <= apart)
            j, same, apart = j[fits], same[fits], apart[fits]
            xs.append(np.full(len(j), rep[i]))
            ys.append(rep[j])
            sure.append(same & (d[i] + d[j] <= apart))
            size += len(j)
            if size > _PAIRS:
                yield np.concatenate(xs), np.concatenate(ys), np.concatenate(sure)
                xs, ys, sure, size = [], [], [], 0
    if xs:
        yield np.concatenate(xs), np.concatenate(ys), np.concatenate(sure)


def _whole(members: dict[str, np.ndarray], percent: int, key: tuple):
    """Pairs of a list that is in one task: the members of its largest component are paired with the others alone."""
    kinds, counts = np.unique(members["comp"], return_counts=True)
    return _of_list(members | {"role": (members["comp"] != kinds[np.argmax(counts)]).astype(np.int64)}, percent)


def _part(members: dict[str, np.ndarray], percent: int, key: tuple):
    """Pairs of a part (token, kind, a, b) of a list that is dealt over tasks."""
    _, kind, a, b = key
    return _of_list(members, percent, across=kind == 0 or a != b)


def _in_parts(rows: DataFrame, total: int, most: int) -> DataFrame:
    """Postings of lists of m > most members, dealt so that each pair that may link meets in one part (token, kind, a, b), and their roles in it.

    A part has about most members on either side. Kind 0: a part of the largest component (role 0) and one of the
    others (role 1). Kind 1: two parts of the others (roles 1 and 2), or one of them with itself.
    """
    columns = [c for c in rows.columns if c != "m"]
    sizes = rows.groupBy("token", "m", "comp").agg(F.count(F.lit(1)).alias("c"))
    facts = sizes.groupBy("token", "m").agg(F.max(F.struct("c", "comp")).alias("b"))

    def parts(c):
        return F.greatest(F.ceil(c / most), F.lit(1)).cast("int")

    facts = facts.select("token", "m", F.col("b.comp").alias("most"), parts(F.col("b.c")).alias("p"), parts(F.col("m") - F.col("b.c")).alias("q"))
    rows = met(rows.drop("m"), written(facts, "jaccard-long-lists"), ["token"], total)

    def place(kind, a, b, role):
        return F.struct(F.lit(kind).alias("kind"), a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(role).cast("long").alias("role"))

    ps, qs = (F.sequence(F.lit(0), F.col(c) - 1) for c in ("p", "q"))
    of_most, of_others = F.pmod(F.xxhash64("rep"), "p"), F.pmod(F.xxhash64("rep"), "q")
    first = F.transform(qs, lambda b: place(0, of_most, b, 0))
    others = F.transform(ps, lambda a: place(0, a, of_others, 1))
    blocks = F.transform(qs, lambda b: place(1, F.least(of_others, b), F.greatest(of_others, b), F.when(of_others <= b, 1).otherwise(2)))
    where = F.when(F.col("comp") == F.col("most"), first).otherwise(F.concat(others, blocks))
    return rows.select(*columns, F.explode(where).alias("w")).select(*columns, "w.*")


def _candidates(postings: DataFrame, percent: int, decided: bool = True, most: int = LONG_LIST) -> DataFrame:
    """Pairs x > y of sets in different components that may link; known: a leader's answers say that they do (left out unless decided).

    A list of up to most members is gone through in one task, a longer one in parts.
    """
    postings = written(postings, "jaccard-postings")
    total = postings.count()
    lists = postings.groupBy("token").agg((F.min("comp") != F.max("comp")).alias("open"), F.count(F.lit(1)).alias("m"))
    lists = written(lists.filter(F.col("open") | (F.col("m") > total // 10_000)), "jaccard-lists")  # frequent closed ones too, so they go before a shuffle
    postings = met(postings, lists, ["token"], total).filter("open").drop("open")
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("known", pa.bool_())])

    def named(rows: DataFrame, keys: list[str], names: list[str], pairs_of) -> DataFrame:
        def f(batches):
            held, key = defaultdict(list), None
            seen: set = set()

            def pairs():
                for a, b, known in pairs_of({k: np.concatenate(v) for k, v in held.items()}, percent, key):
                    if not decided:
                        a, b, known = a[~known], b[~known], known[~known]
                    high, low = np.maximum(a, b), np.minimum(a, b)
                    new = [i for i, p in enumerate(zip(high.tolist(), low.tolist())) if p not in seen]
                    if len(seen) > 1_000_000:  # a memory of what this task has named already; repeats are removed later
                        seen.clear()
                    seen.update((int(high[i]), int(low[i])) for i in new)
                    yield pa.RecordBatch.from_arrays([pa.array(high[new], pa.int64()), pa.array(low[new], pa.int64()), pa.array(known[new], pa.bool_())], schema=schema)

            for b in batches:
                own = np.stack([b.column(k).to_numpy().astype(np.int64) for k in keys], axis=1)
                columns = {k: b.column(k).to_numpy().astype(np.int64) for k in names}
                edges = np.concatenate([[0], np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1, [len(own)]]) if len(own) else [0]
                for x, y in zip(edges, edges[1:]):
                    if held and tuple(own[x].tolist()) != key:
                        yield from pairs()
                        held.clear()
                    key = tuple(own[x].tolist())
                    for k in names:
                        held[k].append(columns[k][x:y])
            if held:
                yield from pairs()

        dealt = rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
        return dealt.mapInArrow(f, "x long, y long, known boolean")

    names = ["rep", "n", "place", "comp", "lead", "d"]
    out = named(postings.filter(F.col("m") <= most).drop("m"), ["token"], names, _whole)
    if lists.filter(F.col("open") & (F.col("m") > most)).head(1):
        dealt = _in_parts(postings.filter(F.col("m") > most), total, most)
        out = out.unionByName(named(dealt, ["token", "kind", "a", "b"], [*names, "role"], _part))
    return out.groupBy("x", "y").agg(F.max("known").alias("known"))


def _link_counts(sets: DataFrame, percent: int, most: int = LONG_LIST) -> DataFrame:
    """rep and n_links, the number of other sets that it links with, of the sets that have any.

    Sets of one leader count by size and distance from it where these decide; all other pairs of the lists are compared.
    """
    keys = ["lead", "n", "d"]
    close = sets.filter(F.col("d") * percent <= F.col("n") * (100 - percent))  # others are decided with no set
    kinds = close.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    other = kinds.select("lead", F.col("n").alias("n2"), F.col("d").alias("d2"), "c")
    total = F.col("n") + F.col("n2")
    apart = total - 2 * F.ceil(total * percent / (100 + percent))
    sure = kinds.drop("c").join(other, "lead").filter(F.col("d") + F.col("d2") <= apart).groupBy(*keys).agg(F.sum("c").alias("l"))
    own = close.select("rep", *keys).join(sure, keys)
    itself = 2 * F.col("d") <= 2 * F.col("n") - 2 * F.ceil(2 * F.col("n") * percent / (100 + percent))
    own = own.select("rep", (F.col("l") - itself.cast("long")).alias("l"))
    pairs = written(_candidates(_postings(sets.withColumn("comp", F.col("rep")), percent), percent, decided=False, most=most).select("x", "y"), "jaccard-undecided")
    links = verified(pairs, sets).filter(_linked(percent)).select(F.explode(F.array("x", "y")).alias("rep"), F.lit(1).cast("long").alias("l"))
    return own.unionByName(links).groupBy("rep").agg(F.sum("l").alias("n_links"))


def joined(docs: DataFrame, *, k: int = K, percent: int = PERCENT, count_links: bool = True, long_list: int = LONG_LIST, **exchange) -> DataFrame:
    """doc_id, n_shingles, component_id and, if count_links, n_links (other distinct sets that its set links with) of each document.

    The links of a component are many more than those that make it: counting compares each pair that no leader decides.
    """
    found = document_sets(docs, k=k, percent=percent, **exchange)
    may = found.filter("f1 is not null and doc_id is not null")
    reps = may.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max(F.struct("hashes", "codes", "k1", "k2")).alias("s"))
    sets = written(reps.select("f1", "f2", "rep", "n", "s.*"), "jaccard-distinct", "none")
    told = written(verified(_leaders(sets), sets), "jaccard-leaders")
    links = told.filter(_linked(percent)).select(F.col("x").alias("u"), F.col("y").alias("v"))
    comp = components(links)
    away = F.col("nx") + F.col("ny") - 2 * F.col("inter")
    best = told.groupBy("x").agg(F.min(F.struct(away.alias("d"), F.col("y").alias("lead"))).alias("b")).select(F.col("x").alias("rep"), "b.d", "b.lead")
    sets2 = sets.join(comp.withColumnRenamed("node", "rep").withColumnRenamed("component", "comp"), "rep", "left").join(best, "rep", "left")
    sets2 = sets2.withColumn("comp", F.coalesce("comp", "rep")).withColumn("lead", F.coalesce("lead", "rep")).withColumn("d", F.coalesce("d", F.lit(0)))
    pairs = written(_candidates(_postings(sets2, percent), percent, most=long_list), "jaccard-pairs")
    more = verified(pairs.filter("not known").select("x", "y"), sets).filter(_linked(percent)).select(F.col("x").alias("u"), F.col("y").alias("v"))
    links = written(links.unionByName(more).unionByName(pairs.filter("known").select(F.col("x").alias("u"), F.col("y").alias("v"))).distinct(), "jaccard-links")
    comp = components(links)
    classes = sets.select("f1", "f2", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.join(_link_counts(sets2, percent, long_list), "rep", "left") if count_links else classes.withColumn("n_links", F.lit(None))
    classes = classes.select("f1", "f2", F.coalesce("component", "rep").alias("c"), F.coalesce("n_links", F.lit(0)).alias("l"))
    alone = found.filter("f1 is null or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    rest = may.select("doc_id", "n", "f1", "f2").join(classes, ["f1", "f2"])
    out = alone.unionByName(rest.select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.col("l").cast("long").alias("n_links")))
    return out if count_links else out.drop("n_links")


def first_of_each(docs: DataFrame, *, k: int = K, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay: of each component the smallest doc_id; all columns. Rows without doc_id stay; of rows that repeat a doc_id all stay."""
    gone = joined(docs, k=k, percent=percent, count_links=False).filter("doc_id <> component_id").select(F.col("doc_id").alias("gone"))
    rows, name = numbered(docs)
    return renamed(rows.join(gone, F.col(name["doc_id"]).cast("long") == F.col("gone"), "left_anti"), docs)
