import random
import re

import numpy as np
import pytest
import xxhash
from conftest import DATA
from rows import AWKWARD, docs_of

from lexitide.llm import queries, simhash
from lexitide.llm.components import connected_components


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


def brute_print(text, width=4):
    w = words(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near(prints, radius=4):
    ids, values = list(prints), np.array(list(prints.values()), np.uint64)
    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values[:k] ^ values[k]) <= radius):
            yield ids[j], ids[k]


def test_query_against_brute_force(spark):
    sf_dir = f"{DATA}/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    want = classes(prints, near(prints))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in texts}


def test_awkward_rows(spark):
    got = simhash.near_duplicates(docs_of(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    named = {i: brute_print(t) for i, t in AWKWARD if i is not None}
    want = classes(named, near(named))
    for r in got:
        if r.doc_id is not None:
            assert (r.fp & (1 << 64) - 1, r.component_id) == (named[r.doc_id], want[r.doc_id])
        else:
            assert r.component_id == 9
    assert want[2] == want[3] == 1  # no words: fingerprint 0, linked
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
    assert [r.component_id for r in simhash.near_duplicates(docs_of(spark, [(None, "a")])).collect()] == [None]


@pytest.mark.parametrize("limit", [2, 5, 4096])
def test_hot_shards(spark, limit):
    """Families of near fingerprints overflow their shards; slices lose no link."""
    rng = random.Random(limit)
    items = {}
    for family in range(3):
        centre = rng.getrandbits(64)
        for _ in range(40):
            items[len(items)] = centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5)))
    items |= {len(items) + k: rng.getrandbits(64) for k in range(50)}
    items = {k: v for k, v in items.items() if v not in [items[j] for j in range(k)]}
    df = spark.createDataFrame([(k, [int(np.uint64(v).astype(np.int64))]) for k, v in items.items()], "node long, fp array<long>")
    got = simhash.links(df, tree_limit=limit).collect()
    assert classes(items, [tuple(r) for r in got]) == classes(items, near(items))
    direct = [tuple(r) for r in simhash.links(df, tree_limit=limit, direct=True).collect()]
    assert all((items[a] ^ items[b]).bit_count() <= 4 for a, b in direct)
    assert classes(items, direct) == classes(items, near(items))


def test_tree_search_finds_all_neighbours():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 12, 3000, dtype=np.uint64)
    shard = np.sort(rng.integers(0, 4, 3000))
    q, at, d = simhash.BKForest(fps, shard).search(np.arange(3000), 2)
    got = set(zip(q.tolist(), at.tolist()))
    dist = np.bitwise_count(fps[:, None] ^ fps[None, :])
    want = {(a, b) for a, b in zip(*np.where((dist <= 2) & (shard[:, None] == shard[None, :]))) if b < a}
    assert got == want and len(got) == len(q)


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (5, 5), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 100, 300: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_verified_classes(spark):
    rng = random.Random(0)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]

    def edited(n, seed):
        w, r = list(base), random.Random(seed)
        for k in r.sample(range(120), n):
            w[k] = f"x{r.randrange(10**6)}"
        return " ".join(w)

    other = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(80)) for _ in range(5)]
    rows = [(10, " ".join(base)), (11, edited(1, 1)), (12, edited(30, 2)), (13, " ".join(base)), *[(20 + i, t) for i, t in enumerate(other)], (None, edited(2, 4)), (40, None), (41, "")]
    got = {r.doc_id: r.component_id for r in simhash.verified_duplicates(docs_of(spark, rows)).collect()}
    assert got == {10: 10, 11: 10, 12: 12, 13: 10, None: 10, **{20 + i: 20 + i for i in range(5)}, 40: 40, 41: 40}
    assert simhash.verified_duplicates(docs_of(spark, [])).count() == 0


def test_verified_recall(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    sets = {}
    for r in docs.collect():
        w = words(r.text)
        sets[r.doc_id] = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    pairs = {(a, b) for v in where.values() for k, b in enumerate(v) for a in v[:k]}
    similar = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in simhash.verified_duplicates(docs).collect()}
    assert sum(got[a] == got[b] for a, b in similar) >= 0.9 * len(similar) and len(similar) > 50
    want = classes(sets, similar)
    assert all(want[i] == want[c] for i, c in got.items())  # nothing is linked that isn't similar


def test_verified_pairs_beyond_the_nearest(spark):
    """Texts of one word set have one word-set fingerprint: none may stand for the others."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(12):
        w = rng.sample(vocabulary, 200)
        rows.append((i, " ".join(w)))
        w[100], w[101] = w[101], w[100]
        rows.append((100 + i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in simhash.verified_duplicates(docs_of(spark, rows)).collect()}
    assert got == {i: i % 100 for i, _ in rows}


def test_verified_pairs_of_hot_shingles(spark):
    """Long runs with a shingle in common: some of a family, some only near its edge, some apart."""
    rng = random.Random(6)
    base, rows = [f"w{i}" for i in range(100)], []
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(100), rng.randint(0, 4)):
            w[k] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join([*base[:30], *[f"y{rng.randrange(10**9)}" for _ in range(rng.randint(0, 10))]])) for i in range(40)]
    sets = {i: set(simhash.shingle_set(t.encode(), 5).tolist()) for i, t in rows}
    want = classes(sets, [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    assert {r.doc_id: r.component_id for r in simhash.verified_duplicates(docs_of(spark, rows)).collect()} == want
    assert 2 < len(set(want.values())) < 90


@pytest.mark.parametrize("length", [60, 300, 1500])
def test_added_and_cut_paragraphs(spark, length):
    """Copies with words added at the end, in the middle, or cut, down to a similarity of 0.8, are all found."""
    rng, rows = random.Random(length), []
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    n = length - 4
    for k in range(20):
        base = new(length)
        for kind, j in enumerate((0.82, 0.9)):
            more, at = int(n / j) - n, rng.randrange(length // 4, length // 2)
            shown = int(n / (j + 0.01)) - n - 4  # an insertion also breaks the shingles across it
            rows += [(1000 * k + 10 * kind + 1, " ".join(base + new(more))), (1000 * k + 10 * kind + 2, " ".join(base[: length - int(n * (1 - j))]))]
            if shown > 0:
                rows.append((1000 * k + 10 * kind + 3, " ".join(base[:at] + new(shown) + base[at:])))
        rows.append((1000 * k, " ".join(base)))
    sets = {i: set(simhash.shingle_set(t.encode(), 5).tolist()) for i, t in rows}
    planted = [(i // 1000 * 1000, i) for i in sets if i % 1000]
    similar = [(a, b) for a, b in planted if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in simhash.verified_duplicates(docs_of(spark, rows)).collect()}
    assert [p for p in similar if got[p[0]] != got[p[1]]] == [] and len(similar) >= 80


def test_verified_recall_of_different_texts(spark):
    """Every pair of different texts of sf0.1, equal ones counted once."""
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").select("doc_id", "text")
    ids = {}
    for r in docs.collect():
        ids.setdefault(r.text or "", []).append(r.doc_id)
    sets = {}
    for t, i in ids.items():
        w = t.encode().lower().split()
        sets[min(i)] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    where, both = {}, {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    for v in where.values():
        for k, b in enumerate(v):
            for a in v[:k]:
                both[a, b] = both.get((a, b), 0) + 1
    similar = [(a, b) for (a, b), n in both.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    want = classes(sets, similar)
    got = {r.doc_id: r.component_id for r in simhash.verified_duplicates(docs).collect()}
    assert len(similar) == 48 and [p for p in similar if got[p[0]] != got[p[1]]] == []
    least = {}
    for t, i in ids.items():
        least[want[min(i)]] = min(least.get(want[min(i)], min(i)), *i)
    assert got == {d: least[want[min(i)]] for i in ids.values() for d in i}
