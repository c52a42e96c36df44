"""Similarity join and clusters against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from guichet.llm import grappes, similarite
from guichet.llm.similarite import Bounds, expand_pairs, linked_classes, pack, unpack, words_of

WORDS = [f"mot{c}{n:03d}" for c in "ab" for n in range(60)]


def corpus(seed, n=220):
    """Families of edited word sets with common phrases, copies, short and empty texts."""
    rnd = random.Random(seed)
    rows = []
    common = [f"phrase{i}" for i in range(25)]
    while len(rows) < n:
        base = rnd.sample(WORDS, rnd.randrange(8, 40)) + rnd.sample(common, rnd.randrange(5, 20))
        for _ in range(rnd.randrange(1, 7)):
            w = [x for x in base if rnd.random() > 0.12] + rnd.sample(WORDS, rnd.randrange(0, 6))
            rnd.shuffle(w)
            rows.append((len(rows) + 1, w[0] if rnd.random() < 0.9 else None, " ".join(w)))
            if rnd.random() < 0.15:
                rows.append((len(rows) + 1, *rows[-1][1:]))
            if rnd.random() < 0.1:
                rows.append(rows[-1])  # the same record again
    return rows + [(9001, None, None), (9002, "", ""), (9003, "court", "texte")]


def brute(rows, least, threshold):
    sets = {i: words_of(a, b) for i, a, b in rows}
    sets = {i: s for i, s in sets.items() if len(s) >= least}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", None) for r in rows], "id long, titre string, corps string, classe int, mots string, a string")


@pytest.mark.parametrize(("seed", "threshold", "cell"), [(1, 0.6, 50_000), (2, 0.55, 50_000), (3, 0.8, 50_000), (4, 0.6, 7), (5, 0.4, 7)])
def test_all_pairs_are_found(spark, monkeypatch, seed, threshold, cell):
    monkeypatch.setattr(similarite, "CELL", cell)  # 7: every cell is split into blocks
    rows = corpus(seed)
    members, links = linked_classes(frame(spark, rows), "id", ["titre", "corps"], 10, threshold)
    got = [(r.id_a, r.id_b) for r in expand_pairs(members, links).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 10, threshold)


def test_empty_and_alone(spark):
    members, links = linked_classes(frame(spark, corpus(1)).limit(0), "id", ["titre", "corps"], 10, 0.6)
    assert members.count() == 0 and links.count() == 0 and expand_pairs(members, links).count() == 0
    assert grappes.linked_groups(grappes.clustered(members, links), 2).count() == 0


def test_long_texts_and_hot_copies(spark):
    long = " ".join(f"mot{i:06d}" for i in range(20_000))
    rows = [(i, None, long) for i in range(1, 4)] + [(4, None, long + " unique")]
    members, links = linked_classes(frame(spark, rows), "id", ["titre", "corps"], 10, 0.6)
    assert links.count() == 1 and expand_pairs(members, links).count() == 6


def test_words():
    assert words_of("Écran-24 réseau_x", "été ÇA 12345") == {"ecran", "reseau", "12345"}
    h = np.array([1, 2**40 - 1], np.uint64)
    assert list(unpack(pack(h))) == list(h)


def test_bounds():
    b = Bounds(0.6)
    for x in range(10, 90):
        for y in range(10, x + 1):
            o = next(k for k in range(y + 2) if k > y or k >= 0.6 * (x + y - k) - 1e-9)
            if o <= y:
                assert b.overlap(x, y) == o and x - o < b.prefix(np.array([x]))[0]


def components(rows, pairs, least):
    parent = {i: i for i, *_ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    groups = {}
    for i in parent:
        groups.setdefault(root(i), set()).add(i)
    return {(i, min(g)) for g in groups.values() if len(g) >= least for i in g}


@pytest.mark.parametrize("dense", [512, 5])
def test_groups_and_clusters(spark, dense):
    """Blocks beyond the dense limit go through the distributed matrix and give the same."""
    rows = corpus(7, 90)
    members, links = linked_classes(frame(spark, rows), "id", ["titre", "corps"], 10, 0.5)
    records = grappes.clustered(members, links, dense=dense).cache()
    assert {(r.id, r.groupe_id) for r in grappes.linked_groups(records, 4).collect()} == components(rows, brute(rows, 10, 0.5), 4)
    assert records.count() == members.count()
    d = grappes.described(records, typical=3).collect()
    assert sum(r.taille for r in d) == members.select("id").distinct().count()
    assert all(len(r.typiques.split(",")) == min(3, r.taille) for r in d)


def test_markov_splits_weakly_joined_groups(spark):
    """Two cliques joined by one weak link are one block and two clusters, dense and distributed alike."""
    edges = [(a, b, 0.9) for g in (range(0, 6), range(10, 16)) for a, b in combinations(g, 2)] + [(5, 10, 0.3)]
    df = spark.createDataFrame(edges, "a long, b long, w double")
    for dense in (512, 4):
        got = grappes.markov(df, dense=dense).collect()
        assert {r.bloc for r in got} == {0} and len(got) == 12
        by = {}
        for r in got:
            by.setdefault(r.groupe, set()).add(r.noeud)
        assert sorted(map(sorted, by.values())) == [list(range(0, 6)), list(range(10, 16))]


def test_even_flow_below_the_pruning_limit(spark, monkeypatch):
    """A large even group, every entry of whose matrix is below the limit, stays one block and one cluster."""
    edges = [(a, b, 0.9) for a, b in combinations(range(30), 2)]
    df = spark.createDataFrame(edges, "a long, b long, w double")
    monkeypatch.setattr(grappes, "RECOVER", 5)
    members = spark.range(30).select("id", F.col("id").alias("classe"))
    links = df.select("a", "b", F.lit(9).alias("communs"), F.lit(10).alias("total"))
    for dense in (512, 4):
        got = grappes.clustered(members, links, prune=0.05, dense=dense).cache()
        assert got.count() == 30 and len({(r.bloc, r.groupe) for r in got.collect()}) == 1
        assert grappes.linked_groups(got, 4).count() == 30


def test_blocks_of_a_chain(spark):
    n = 60
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "a long, b long")
    got = {r.noeud: r.bloc for r in grappes.blocks(df).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}
    assert grappes.blocks(df.limit(0)).count() == 0


def test_no_cross_join(spark):
    members, links = linked_classes(frame(spark, corpus(1)), "id", ["titre", "corps"], 10, 0.6)
    plan = expand_pairs(members, links)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert F is not None


def plain_mcl(n, edges, inflation=2.0, prune=1e-4):
    """MCL as published, node by node."""
    m = np.eye(n)
    for a, b, w in edges:
        m[a, b] = m[b, a] = w
    m /= m.sum(0)
    for _ in range(200):
        last = m
        m = (m @ m) ** inflation
        m /= m.sum(0)
        m[m < prune] = 0
        m /= m.sum(0)
        if np.abs(m - last).max() < 1e-9:
            break
    return {j: int(np.nonzero(m[:, int(np.nonzero(m[:, j])[0][m[np.nonzero(m[:, j])[0], j].argmax()])])[0][0]) for j in range(n)}


def test_clusters_are_those_of_the_published_algorithm(spark):
    """Planted communities, joined weakly: clusters, sizes and typical members, dense and distributed."""
    rnd = random.Random(11)
    n, edges = 60, {}
    for a, b in combinations(range(n), 2):
        if a // 12 == b // 12 and rnd.random() < 0.7:
            edges[a, b] = rnd.uniform(0.6, 1.0)
        elif rnd.random() < 0.01:
            edges[a, b] = rnd.uniform(0.55, 0.6)
    rows = [(a, b, w) for (a, b), w in edges.items()]
    links = spark.createDataFrame([(a, b, round(w * 1000), 1000) for a, b, w in rows], "a long, b long, communs int, total int")
    want = plain_mcl(n, [(a, b, round(w * 1000) / 1000) for a, b, w in rows])
    members = spark.range(n).select("id", F.col("id").alias("classe"))
    for dense in (512, 8):
        got = grappes.clustered(members, links, dense=dense).cache()
        same = lambda g: {frozenset(i for i in g if g[i] == v) for v in g.values()}
        assert same({r.id: r.groupe for r in got.collect()}) == same(want) and len(same(want)) >= 5
        told = {r.groupe_id: r for r in grappes.described(got, typical=2, least=4).collect()}
        assert {k: r.taille for k, r in told.items()} == {min(c): len(c) for c in same(want) if len(c) >= 4} and all(r.stable for r in told.values())
        assert {(r.id, r.groupe_id) for r in grappes.linked_groups(got, 4).collect()} == components([(i,) for i in range(n)], [(a, b) for a, b, _ in rows], 4)


def test_blocks_rest_on_clusters_and_links():
    """Nodes of one cluster are one block though no link joins them; without the clusters they would be two."""
    group = np.array([[0, 0, 2, 3]])
    linked = np.zeros((1, 4, 4), bool)
    linked[0, 2, 3] = linked[0, 3, 2] = True
    assert grappes.contracted(group, linked).tolist() == [[0, 0, 2, 2]]
    assert grappes.contracted(np.arange(4)[None], linked).tolist() == [[0, 1, 2, 2]]


def test_unsettled_walks_are_reported(monkeypatch):
    monkeypatch.setattr(grappes, "STEPS", 1)
    m = np.full((1, 8, 8), 0.1) + np.eye(8) * 0.2
    m[0, 0, 1:3] = 0.9
    assert not grappes._walk(m / m.sum(1, keepdims=True), 2.0, 1e-4)[1].any()


def test_large_classes_are_joined_in_pieces(spark, monkeypatch):
    """Copies beyond the piece size give the same pairs, and no key of the joins holds more rows than twice a piece."""
    members = spark.range(100).select("id", F.when(F.col("id") < 40, 1).when(F.col("id") < 70, 2).when(F.col("id") < 72, 3).otherwise(F.col("id") + 100).cast("long").alias("classe"))
    links = spark.createDataFrame([(1, 2, 1, 1), (2, 3, 1, 1), (3, 180, 1, 1)], "a long, b long, communs int, total int")
    want = [tuple(r) for r in expand_pairs(members, links).collect()]
    assert len(want) == len(set(want)) == 40 * 30 + 30 * 2 + 2 + 40 * 39 // 2 + 30 * 29 // 2 + 1
    monkeypatch.setattr(similarite, "PIECE", 8)
    assert sorted(tuple(r) for r in expand_pairs(members, links).collect()) == sorted(want)
    placed, big = similarite._pieces(members)
    assert {r.classe: r.pieces for r in big.collect()} == {1: 5, 2: 4} and max(r["count"] for r in placed.groupBy("classe", "piece").count().collect()) <= 16


def cells_in_process(n, bounds):
    """Cells of n sets over one small vocabulary, a tenth of them edited copies; the classes are the row numbers. And the sets."""
    rnd = random.Random(3)
    vocabulary = [rnd.getrandbits(40) for _ in range(500)]
    sets = []
    while len(sets) < n:
        base = sets[rnd.randrange(len(sets))] if sets and rnd.random() < 0.1 else []
        kept = [w for w in base if rnd.random() > 0.12]
        sets.append({*kept, *(vocabulary[int(500 * rnd.random() ** 1.5)] for _ in range(rnd.randrange(25, 60) if not kept else 5))})
    lengths = np.array([len(s) for s in sets])
    h = np.concatenate([np.array(sorted(s), np.uint64) for s in sets])
    row, h, pos, end = similarite._prefixes(h, lengths, np.bincount(similarite._bucket(h), minlength=1 << similarite.BUCKET_BITS), bounds)
    _, first, key, after, _ = next(similarite._placed(h, end, [], bounds))
    order = np.argsort(key, kind="stable")
    first, key, after = first[order], key[order], after[order]
    sketch = similarite._sketches(np.concatenate([np.array(sorted(s), np.uint64) for s in sets]), lengths).view(np.int64)[row[first]]
    words = ((h >> np.uint64(22)) & np.uint64(0xFFFF))[similarite._spread(after, end[first])[1]]
    columns = [key, np.full(len(key), 1 << 60), np.zeros(len(key), np.int32), row[first], lengths[row[first]], pos[first], *sketch.T]
    return similarite._Cells([(columns, end[first] - after, words)], bounds), sets


@pytest.mark.parametrize(("threshold", "least", "few", "many"), [(0.6, 20, 32, 2_000), (0.6, 20, 1, 3), (0.55, 25, 2, 2_000), (0.6, 10, 1, 3), (0.6, 1, 1, 3)])
def test_no_pair_is_lost_in_split_groups(monkeypatch, threshold, least, few, many):
    monkeypatch.setattr(similarite, "FEW", few)
    monkeypatch.setattr(similarite, "MANY", many)
    cells, sets = cells_in_process(600, Bounds(threshold, least))
    found = {(int(a), int(b)) for x, y in cells.pairs() for a, b in zip(x, y)}
    want = {(a, b) for a, b in combinations(range(600), 2) if min(len(sets[a]), len(sets[b])) >= least and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}
    assert len(want) > 20 and want <= found


def test_few_of_the_pairs_of_a_cell_are_compared():
    """Texts over one small vocabulary share many single words; groups of several words hold a small part of those pairs."""
    cells, _ = cells_in_process(16_000, Bounds(0.6, 20))
    assert sum(len(a) for a, _ in cells.pairs()) > 0
    size = np.bincount(cells.cell)
    assert 0 < cells.met < 0.1 * (size * (size - 1) // 2).sum()


@pytest.mark.parametrize("cell", [2, 25])
def test_cells_are_split_by_next_words_on_the_cluster(spark, monkeypatch, cell):
    monkeypatch.setattr(similarite, "CELL", cell)
    rows = [r for r in corpus(9) if len(words_of(*r[1:])) >= 20]
    assert Bounds(0.6, 20).depth == 4
    members, links = linked_classes(frame(spark, rows), "id", ["titre", "corps"], 20, 0.6)
    got = [(r.id_a, r.id_b) for r in expand_pairs(members, links).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 20, 0.6)


def test_sketches_are_short_and_never_exceed_the_difference():
    rnd = random.Random(8)
    sets = [{rnd.getrandbits(40) for _ in range(rnd.randrange(1, 90))} for _ in range(40)]
    sets += [s ^ {rnd.getrandbits(40) for _ in range(9)} for s in sets]
    sketch = similarite._sketches(np.concatenate([np.array(sorted(s), np.uint64) for s in sets]), np.array([len(s) for s in sets]))
    assert sketch.shape == (80, 3)  # 24 bytes of each row sent
    assert all(np.bitwise_count(sketch[a] ^ sketch[b]).sum() <= len(sets[a] ^ sets[b]) for a, b in combinations(range(80), 2))
