"""The training-data operators against brute force and by held-out accuracy, on small inputs and edge cases."""

from datetime import datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenary import features
from lumenary.llm import abuse, additive, components, density, leakage, near_duplicates, neighbours, packing, reservoir, term_counts

SMALL = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)
GLOBAL = "image_id long, features array<float>, computed_at timestamp, raw string"
LOCAL = "image_id long, features array<array<float>>, computed_at timestamp, key string, piece int"


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def planted(rng, groups, each, dim, noise):
    centers = np.abs(rng.normal(size=(groups, dim)))
    return np.concatenate([np.abs(c + noise * rng.normal(size=(each, dim))) for c in centers])


# 1. near duplicates

D = 256


@pytest.fixture(scope="module")
def global_table(spark):
    rng = np.random.default_rng(0)
    m = planted(rng, 30, 4, D, 0.03)
    rows = [(i, v.tolist(), T0, "x") for i, v in enumerate(m)]
    rows += [(200 + i, m[0].tolist(), T0, "copy") for i in range(30)]  # a group of exact copies
    rows += [(300, None, T0, None), (301, [], T0, ""), (302, [0.0] * D, T0, ""), (303, [float("nan")] * D, T0, ""), (304, [1.0] * (D - 1), T0, ""), (None, m[1].tolist(), T0, "")]
    rows += [(0, m[5].tolist(), datetime(2020, 1, 1), "older"), (1, m[1].tolist(), T0, "repeat")]
    vectors = {i: v for i, v in enumerate(m)} | {200 + i: m[0] for i in range(30)}
    return spark.createDataFrame(rows, GLOBAL), vectors


def similarities(vectors):
    keys = np.array(sorted(vectors))
    x = unit(np.array([np.float32(vectors[k]) for k in keys]).astype(np.float64))
    return keys, (x @ x.T).round(9)


def test_near_duplicates_equal_brute_force(global_table):
    df, vectors = global_table
    keys, s = similarities(vectors)
    a, b = np.nonzero(np.triu(s >= 0.97, 1))
    links, members = near_duplicates.similar_classes(features.global_features(df, D), D, 0.97, 0.86)
    got = near_duplicates.all_pairs(links, members).collect()
    assert {(r.a, r.b) for r in got} == set(zip(keys[a].tolist(), keys[b].tolist(), strict=True))
    assert len(got) == len(a)


def test_near_duplicates_of_an_empty_table(global_table):
    links, members = near_duplicates.similar_classes(features.global_features(global_table[0].limit(0), D), D, 0.97, 0.86)
    assert (links.count(), members.count()) == (0, 0)


def test_hot_groups_are_met_in_parts(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "HOT", 40)
    monkeypatch.setattr(near_duplicates, "LOOKED_AT", 4)
    rows = spark.range(300).select("id", F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 9 + 1).alias("g"))
    got = near_duplicates.pairs_within(rows, "g", "id").collect()
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if (a < 200 and b < 200) or (a >= 200 and a % 9 == b % 9)}
    assert {(r.a, r.b) for r in got} == want
    assert len(got) == len(want)


def test_blocks_of_pairs_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "VERIFIED", 100)
    pairs = spark.range(60).select(F.col("id").alias("a")).crossJoin(spark.range(60).select(F.col("id").alias("b"))).filter("a < b")
    got = near_duplicates.placed_pairs(pairs)
    assert got.count() == 60 * 59 // 2
    assert got.groupBy("block").count().agg(F.max("count")).first()[0] < 600


def test_bands_find_pairs_at_the_stated_similarity():
    n = near_duplicates.band_count(0.86)
    assert (1 - 0.86**near_duplicates.ROWS) ** n <= near_duplicates.UNSEEN


def test_pruning_rarely_loses_a_pair_that_reaches_the_threshold():
    rng = np.random.default_rng(1)
    limits = near_duplicates.least_matches(0.86, 1e-4)
    lost = 0
    for _ in range(2000):
        same = rng.random(256) < 0.90
        same |= rng.random(256) < 1 / 16
        lost += any(same[:n].sum() < least for n, least in limits)
    assert lost <= 10


# 2. reservoir


def test_reservoir_is_uniform_and_exact(spark):
    rows = spark.range(400).select(F.col("id"), F.when(F.col("id") < 300, F.col("id") % 3).otherwise(7).cast("int").alias("piece"))
    counts = np.zeros(400)
    for seed in range(12):
        got = [r.id for r in reservoir.reservoir_sample(rows, ["id"], "piece", 100, slots=4, seed=seed).collect()]
        assert len(got) == len(set(got)) == 100
        counts[got] += 1
    assert abs(counts[:300].sum() / counts.sum() - 0.75) < 0.06
    same = [sorted(r.id for r in reservoir.reservoir_sample(x, ["id"], "piece", 100, slots=4).collect()) for x in (rows, rows.repartition(7))]
    assert same[0] == same[1]


def test_reservoir_of_many_slots(spark):
    rows = spark.range(3000).select(F.col("id"), (F.col("id") % 4).cast("int").alias("piece"))
    got = [r.id for r in reservoir.reservoir_sample(rows, ["id"], "piece", 1000, slots=30).collect()]
    assert len(got) == len(set(got)) == 1000
    assert abs(np.mean(got) - 1500) < 120
    assert max(abs(np.bincount(np.array(got) % 4) - 250)) < 60


def test_reservoir_bounds(spark):
    rows = spark.createDataFrame([(1, None), (2, 5)], "id long, piece int")
    assert sorted(r.id for r in reservoir.reservoir_sample(rows, ["id"], "piece", 10).collect()) == [1, 2]
    assert reservoir.reservoir_sample(rows, ["id"], "piece", 0).count() == 0
    assert reservoir.reservoir_sample(rows.limit(0), ["id"], "piece", 3).count() == 0


def planned(arrivals, k, slots, seed):
    rng = np.random.default_rng(seed)
    return reservoir.split_steps(reservoir.replaced([(p, int(c.sum())) for p, c in arrivals], k, rng), dict(arrivals), slots, rng)


def test_plan_keeps_every_record_with_the_same_chance():
    """Chi-square over pieces and slots, with the variance of draws without replacement."""
    arrivals = [(0, np.array([30, 10])), (1, np.array([5, 15])), (2, np.array([20, 20]))]
    hits, runs, k, total = np.zeros((3, 2)), 4000, 12, 100
    for seed in range(runs):
        held = np.zeros((3, 2), int)
        for p, s, evict, insert in planned(arrivals, k, 2, seed):
            rng = np.random.default_rng([seed, p, s])
            gone = rng.choice(np.repeat(np.arange(3), held[:, s]), evict, replace=False) if evict else []
            np.subtract.at(held[:, s], gone, 1)
            held[p, s] += insert
        assert held.sum() == k
        hits += held
    n = np.array([c for _, c in arrivals])
    expected = runs * k * n / total
    chi = ((hits - expected) ** 2 / expected).sum() * (total - 1) / (total - k)
    assert chi < 20.5  # 5 degrees of freedom, 0.001


def test_large_hypergeometric_draws():
    rng = np.random.default_rng(3)
    good, bad, n = 4 * 10**12, 6 * 10**12, 10**6
    x = np.array([reservoir.hypergeometric(rng, good, bad, n) for _ in range(400)])
    assert abs(x.mean() - 400_000) < 5 * 490 / 20
    assert 0.8 < x.std() / 489.9 < 1.2
    assert reservoir.hypergeometric(rng, 10**12, 0, 7) == 7
    assert reservoir.hypergeometric(rng, 0, 10**12, 7) == 0
    assert reservoir.hypergeometric(rng, 2 * 10**9, 5, 2 * 10**9 + 5) == 2 * 10**9
    rng, low = np.random.default_rng(4), reservoir.LARGE
    try:  # the inversion against the library's generator where both can draw
        reservoir.LARGE = 0
        own = np.array([reservoir.hypergeometric(rng, 30, 50, 20) for _ in range(4000)])
    finally:
        reservoir.LARGE = low
    other = rng.hypergeometric(30, 50, 20, 4000)
    assert abs(own.mean() - other.mean()) < 0.15
    assert abs(own.std() - other.std()) < 0.15
    plan = planned([(p, np.array([10**12, 3 * 10**11])) for p in range(3)], 10**6, 2, 1)
    assert sum(i - e for _, _, e, i in plan) == 10**6


# 3. nearest neighbours


def test_neighbours_recall(spark, global_table):
    df, vectors = global_table
    keys, s = similarities(vectors)
    np.fill_diagonal(s, -1)
    truth = set()
    for i, k in enumerate(keys):
        order = np.lexsort((keys, -s[i]))[:5]
        truth |= {(int(k), int(keys[j])) for j in order if s[i, j] >= 0.9}
    got = {(r.key, r.other) for r in neighbours.nearest_neighbours(df, D, False, 5, 0.9, per_cell=20).collect()}
    assert len(got & truth) >= 0.95 * len(truth)
    assert len(got - truth) <= 0.05 * len(truth)
    assert neighbours.nearest_neighbours(df.limit(0), D, False, 5, 0.9).count() == 0


def found_of(df, vectors, dim, least, **options):
    """(share of the true pairs found, share of the rows that are true) of the five most similar."""
    keys, s = similarities(vectors)
    np.fill_diagonal(s, -1)
    truth = {(int(k), int(keys[j])) for i, k in enumerate(keys) for j in np.lexsort((keys, -s[i]))[:5] if s[i, j] >= least}
    got = [(r.key, r.other) for r in neighbours.nearest_neighbours(df, dim, False, 5, least, **options).collect()]
    assert len(got) == len(set(got))
    return len(truth & set(got)) / len(truth), len(truth & set(got)) / len(got)


def test_neighbours_by_sketches_in_as_many_cells_as_a_large_table_has(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PER_WORD", 8)
    rng = np.random.default_rng(4)
    centers = 0.65 + 0.75 * rng.normal(size=(250, 512))
    m = (np.repeat(centers, 12, axis=0) + 0.3 * rng.normal(size=(3000, 512))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), T0, "") for i, v in enumerate(m)], GLOBAL)
    vectors = dict(enumerate(m))
    found, right = found_of(df, vectors, 512, 0.8, sketch=128)
    assert found > 0.995
    assert right > 0.995


@pytest.mark.parametrize("block", [8192, 7])
def test_neighbours_by_sketches_equal_brute_force(global_table, monkeypatch, block):
    monkeypatch.setattr(neighbours, "CROWD", 20)
    df, vectors = global_table
    assert found_of(df, vectors, D, 0.9, sketch=64, block=block) == (1, 1)
    assert neighbours.nearest_neighbours(df.limit(0), D, False, 5, 0.9, sketch=64).count() == 0


def test_lowest_places_in_order():
    d = np.random.default_rng(6).integers(0, 9, size=(50, 12)).astype(np.float32)
    want = d.argsort(axis=1, kind="stable")[:, :4]
    at, value = additive.lowest(d.copy(), 4)
    assert (at == want).all()
    assert (value == np.take_along_axis(d, want, axis=1)).all()


def test_first_two_of_a_random_order():
    rng = np.random.default_rng(5)
    z = rng.normal(size=(90, 3))
    hit = z @ z.T >= 0.5
    np.fill_diagonal(hit, (z * z).sum(axis=1) >= 0.5)
    one, two = neighbours.lowest_two(z, 0.5, 16)
    for i in range(90):
        want = [*np.flatnonzero(hit[i]), -1, -1][:2]
        assert (one[i], two[i]) == tuple(want)


def test_scores_by_tables_are_the_products_with_the_sums():
    rng = np.random.default_rng(2)
    x = unit(rng.normal(size=(500, 16))).astype(np.float32)
    aq = additive.AdditiveQuantiser.fit(x, 8)
    codes, cells = aq.encode(x)
    assert cells.shape == (500, 2)
    assert np.allclose(aq.scores(x[:7], codes), aq.decode(codes) @ x[:7].T, atol=1e-5)
    assert ((aq.decode(codes) - x) ** 2).sum() < 0.6 * (x**2).sum()


# 4. density clusters


def test_clusters_strays_and_copies(spark):
    rng = np.random.default_rng(3)
    centers = unit(np.abs(rng.normal(size=(6, 64))) * (rng.random((6, 64)) < 0.3))
    sizes = [40, 25, 12, 8, 6, 5]
    m, label = [], []
    for i, (c, n) in enumerate(zip(centers, sizes, strict=True)):
        m += list(np.abs(c + 0.035 * rng.normal(size=(n, 64))))
        label += [i] * n
    m += [m[0]] * 9 + list(np.eye(64)[50:60])
    label += [0] * 9 + [-1] * 10
    rows = [(i, [m[i].tolist()], T0, "x", 0) for i in range(len(m))]
    rows += [(900, None, T0, "", 0), (901, [], T0, "", 0), (902, [None, [0.0] * 64, [1.0]], T0, "", 0)]
    df = spark.createDataFrame(rows, LOCAL)
    found = density.density_clusters([df, df.limit(0)]).collect()
    got = {r.key // 1000: r.cluster // 1000 for r in found}
    first = {x: label.index(x) for x in set(label)}
    assert got == {i: first[x] for i, x in enumerate(label) if x >= 0}
    about = density.describe(density.density_clusters([df])).collect()
    assert sorted(r["size"] for r in about) == sorted([49, 25, 12, 8, 6, 5])
    assert all(len(r.exemplars) == 3 for r in about)
    assert density.density_clusters([df.limit(0)]).count() == 0


def test_a_small_cluster_spread_over_many_cells(spark):
    rng = np.random.default_rng(11)
    m = np.abs(rng.normal(size=(1500, 64))) * (rng.random((1500, 64)) < 0.3)  # strays
    c = np.abs(rng.normal(size=64))
    m[::250] = np.abs(c + 0.5 * rng.normal(size=(6, 64)))
    df = spark.createDataFrame([(i, [v.tolist()], T0, "x", 0) for i, v in enumerate(m)], LOCAL)
    own = unit(m[::250])
    assert (own @ unit(own.mean(axis=0)) > 0.78).all()
    found = density.density_clusters([df], per_cell=1)  # as many cells as vectors: no cell holds four of the six
    got = {r.key // 1000: r.cluster // 1000 for r in found.collect()}
    assert {i: got.get(i) for i in range(0, 1500, 250)} == dict.fromkeys(range(0, 1500, 250), 0)


def around(rng, centers, each, cosine):
    """Unit vectors with about that cosine to their center."""
    out = []
    for c in centers:
        v = rng.normal(size=(each, len(c)))
        v = unit(v - (v @ c)[:, None] * c)
        out.append(cosine * c + np.sqrt(1 - cosine**2) * v)
    return np.concatenate(out)


def test_clusters_of_any_density_are_found(spark):
    rng = np.random.default_rng(12)
    centers = unit(rng.normal(size=(40, 64)))
    m = np.concatenate([around(rng, centers[:20], 40, 0.83), around(rng, centers[20:], 40, 0.93)])
    label = np.arange(len(m)) // 40
    strays = unit(rng.normal(size=(300, 64)))
    rows = [(i, [v.tolist()], T0, "x", 0) for i, v in enumerate(np.concatenate([m, strays]))]
    found = density.density_clusters([spark.createDataFrame(rows, LOCAL)]).collect()
    got = {r.key // 1000: r.cluster // 1000 for r in found}
    assert len(got) == len(found)
    assert {i: got.get(i) for i in range(len(m))} == {i: int(label[i]) * 40 for i in range(len(m))}
    assert not [i for i in got if i >= len(m)]


@pytest.mark.parametrize("shape", ["random", "path", "star"])
def test_the_hierarchy_in_rounds_equals_that_of_one_task(spark, shape):
    import pandas as pd

    rng = np.random.default_rng(13)
    n = 60
    ends = {"random": [(int(rng.integers(i)), i) for i in range(1, n)] + [(int(a), int(b)) for a, b in rng.integers(0, n, (40, 2)) if a != b], "path": [(i - 1, i) for i in range(1, n)], "star": [(0, i) for i in range(1, n)]}[shape]
    edges = pd.DataFrame([(min(a, b), max(a, b), float(w)) for (a, b), w in zip(ends, rng.uniform(0.1, 0.45, len(ends)), strict=True)], columns=["a", "b", "w"]).groupby(["a", "b"], as_index=False).min()
    nearest = np.minimum(edges.groupby("a").w.min().reindex(range(n + 3)).fillna(1), edges.groupby("b").w.min().reindex(range(n + 3)).fillna(1))
    core = np.minimum(nearest, 0.5) * rng.uniform(0.2, 1, n + 3)
    size = rng.integers(5, 50, n + 3)
    leaves = pd.DataFrame({"node": range(n + 3), "n": size, "persist": size / core * 0.9, "core": core})
    want = density.condense(leaves, edges, 0.5, 1.5)
    for limit in (0, 1000):
        got = {r.node: r.cluster for r in density.hierarchy(spark.createDataFrame(leaves), spark.createDataFrame(edges), 0.5, 1.5, limit).collect()}
        assert set(got) == set(want)
        assert {frozenset(k for k in got if got[k] == v) for v in got.values()} == {frozenset(k for k in want if want[k] == v) for v in want.values()}


def test_vectors_of_a_cell_travel_in_one_row(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(14)
    x = unit(np.abs(rng.normal(size=(3000, 64)))).astype(np.float32)
    cells = additive.Cells(additive.AdditiveQuantiser.fit(x.copy(), 20), x, 3000.0, 500, 100, deeper=1)
    keys, small = np.arange(3000) * 7 - 900, density._eighth(x)
    who, cell, first = density._placed(cells, keys, x)
    assert len(who) == 6000 and (cells.parts > 1).any()
    for packed, batches in ((1 << 23, 1), (1000 * 64, 6)):
        monkeypatch.setattr(density, "PACKED", packed)
        got = list(density._packed(cells, ((keys[i : i + 500], x[i : i + 500], small[i : i + 500]) for i in range(0, 3000, 500)), 64, 1))
        assert len(got) == batches
        assert all(len(b.column("cell").unique()) == b.num_rows for b in got)
        # a cell may come in several rows and be cut between batches
        rows = pa.Table.from_batches(got).sort_by("cell").combine_chunks().to_batches()[0]
        groups = list(density._groups((rows.slice(i, 7) for i in range(0, rows.num_rows, 7)), 64))
        assert [g[0] for g in groups] == (np.unique(cell) * 2 + 1).tolist()
        seen = sorted((c, k, s.tobytes(), f) for c, ks, ss, fs in groups for k, s, f in zip(ks.tolist(), ss, fs.tolist(), strict=True))
        assert seen == sorted((c * 2 + 1, k, s.tobytes(), f) for c, k, s, f in zip(cell.tolist(), keys[who].tolist(), small[who], first.tolist(), strict=True))
    assert not list(density._packed(cells, iter([]), 64, 1)) and not list(density._groups(iter([]), 64))


@pytest.mark.parametrize(("n", "samples"), [(1, 4), (3, 4), (4, 4), (150, 4), (150, 1), (150, 20)])
def test_a_local_tree_equals_brute_force(n, samples):
    rng = np.random.default_rng(n)
    x = unit(around(rng, unit(rng.normal(size=(6, 64))), -(-n // 6), 0.9)[:n]).astype(np.float32)
    x[n // 2 :: 3] = unit(rng.normal(size=(len(x[n // 2 :: 3]), 64)))
    core, piece, a, b, w = density.local_tree(x, samples, 0.22)
    d = np.maximum(1 - x @ x.T, 0)
    want = np.sort(d, axis=1)[:, samples - 1] if n >= samples else np.full(n, 2)
    assert np.allclose(core, want, atol=1e-6)
    d = np.maximum(np.maximum(d, core), core[:, None])
    edges = sorted((float(d[i, j]), i, j) for i in range(n) for j in range(i))
    top = list(range(n))
    lengths, pieces = [], None
    for length, i, j in edges:
        if length > 0.22 and pieces is None:
            pieces = list(top)
        if top[i] != top[j]:
            low, high = sorted((top[i], top[j]))
            top = [low if t == high else t for t in top]
            lengths += [length] if length > 0.22 else []
    assert piece.tolist() == (pieces or top)
    assert np.allclose(sorted(w), lengths, atol=1e-6)
    assert all(piece[i] != piece[j] and abs(d[np.ix_(piece == piece[i], piece == piece[j])].min() - v) < 1e-6 for i, j, v in zip(a, b, w, strict=True))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(200, 200), (201, 202), (202, 201)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(51)}) == len({got[i] for i in range(100, 140)}) == 1
    assert got[201] == got[202] != got[0] != got[100]
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 5. term counts


def test_term_counts_equal_a_dictionary(spark):
    rng = np.random.default_rng(4)
    rows = [[str(x) for x in rng.zipf(1.3, rng.integers(0, 40)) % 5000] + (["", None, "ä" * 3000] if i % 50 == 0 else []) for i in range(600)]
    got = term_counts.term_frequencies(spark.createDataFrame([(r, 1) for r in rows] + [(None, 2)], "terms array<string>, records int").repartition(5), "terms").collect()
    want: dict = {}
    for r in rows:
        for t in r:
            if t is not None:
                want.setdefault(t, [0, 0])[0] += 1
        for t in set(r) - {None}:
            want[t][1] += 1
    assert {r.term: [r.occurrences, r.records] for r in got} == want
    assert len(got) == len(want)
    assert term_counts.term_frequencies(spark.createDataFrame([], "terms array<string>"), "terms").count() == 0


def test_a_trie_bursts_and_keeps_counts():
    trie = term_counts.BurstTrie(burst=4)
    for i in range(300):
        trie.add(f"{i:b}", i, 1)
    assert sum(len(e) for _, e in trie.containers()) == trie.size == 300
    assert {p + s: v for p, e in trie.containers() for s, v in e.items()} == {f"{i:b}": [i, 1] for i in range(300)}
    assert max(len(p) for p, _ in trie.containers()) > 2


# 6. packing


def test_packing_keeps_everything_and_wastes_little(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(x)) for i, x in enumerate(rng.integers(1, 300, 3000))] + [(-1, 0), (-2, None), (-3, 1050), (7, 100), (7, 100)]
    got = packing.pack(spark.createDataFrame([(*r, 1) for r in rows], "k long, s long, g int"), "k", "s", 100, per_worker=1000).toPandas()
    fill = got[got.tokens > 0].groupby("container").tokens.sum()
    assert fill.max() <= 100
    assert fill.sum() / (100 * len(fill)) > 0.95
    assert got.groupby("k").tokens.sum().to_dict() == {k: sum(s or 0 for x, s in rows if x == k) for k, _ in rows}
    split = got[got.k == -3].sort_values("piece")
    assert split.tokens.tolist() == [100] * 10 + [50]
    assert split.start.tolist() == list(range(0, 1100, 100))
    assert set(got[got.tokens == 0].k) == {-1, -2}
    assert (got[got.k >= 0].groupby("k").piece.nunique() == [-(-dict(rows)[k] // 100) for k in sorted(set(got.k)) if k >= 0]).all()
    assert packing.pack(spark.createDataFrame([], "k long, s long"), "k", "s", 100).count() == 0


@pytest.mark.skipif(not Path(packing.TOKENIZER).exists(), reason="no tokenizer")
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>")], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in packing.token_counts(df).collect()}
    assert got[1] == 2
    assert got[2] == got[3] == 0
    assert got[4] > 1


# 7. leaked passages

ITEM = " ".join(f"word{i} tiny{i}" for i in range(40))


def disguise(words):
    return "+# " + "\n+# ".join(" ".join(words[i : i + 4]).upper() for i in range(0, len(words), 4))


def test_leaks(spark):
    w = ITEM.split()
    bent = w[10:22] + w[24:40]
    edited = [x if i % 5 else "other" for i, x in enumerate(w[20:50])]
    docs = {
        1: "before " + disguise(w[:25]) + " after",
        2: " ".join(w[:24]),
        3: " ".join(edited),
        4: " ".join([x if i % 3 else "other" for i, x in enumerate(w)]),
        5: "foo " * 3000 + " ".join(bent) + " bar" * 3000,
        6: "\\n".join(["", *w[30:60]]),
        7: None,
        8: "",
        9: "the item about word1 and tiny2",
    }
    df = spark.createDataFrame([(k, v, 0) for k, v in docs.items()], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(5, ITEM), (6, "short text"), (7, None), (None, ITEM), (8, ITEM)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_items(df, items).collect()}
    assert got == {(d, i) for d in (1, 3, 5, 6) for i in (5, 8)}
    assert leakage.leaked_items(df.limit(0), items).count() == 0
    assert leakage.leaked_items(df, items.limit(0)).count() == 0


@pytest.mark.parametrize("lengths", [(16,), (9, 12, 15)])
def test_wu_manber_equals_find(lengths):
    rng = np.random.default_rng(6)
    text = bytes(rng.choice(list(b"ab "), 20_000).astype(np.uint8))
    starts = [i for i in range(len(text) - 16) if text[i] == 32]
    strings = [text[i : i + lengths[n % len(lengths)]] for n, i in enumerate(starts[::37])] + [b" " + b"zz" * 7 + b"z"]
    w = leakage.WuManber(strings, 16 if lengths == (16,) else 8)
    at, s = w.search(np.frombuffer(text + bytes(16), np.uint8))
    assert {(a, w.strings[x]) for a, x in zip(at.tolist(), s.tolist(), strict=True)} == {(i, text[i : i + n]) for i in starts for n in lengths if text[i : i + n] in set(strings)}


def test_leaks_of_short_words_and_large_skips(spark):
    rng = np.random.default_rng(21)
    short = [str(rng.integers(10)) if i % 2 else "xyzabc"[rng.integers(6)] for i in range(60)]
    long = [f"token{i}" for i in range(60)]
    items = spark.createDataFrame([(1, " ".join(short)), (2, " ".join(long))] + [(10 + i, None if i % 2 else "ab") for i in range(50)], "item_id long, text string")
    docs = {
        1: " ".join(x if i % 5 else "q" for i, x in enumerate(short[10:36])),
        2: " ".join(x if i % 5 else "q" for i, x in enumerate(long[10:36])),
        3: " ".join(short[:9]) + " end",
        4: " ".join(long[:24] + long[33:57]),  # nine words left out of 57
        5: " ".join(x if i % 5 < 3 else "q" for i, x in enumerate(short)),
        6: " ".join(short[5:30]),
        7: " ".join(long[5:29]),
    }
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_items(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), items).collect()}
    assert got == {(1, 1), (2, 2), (4, 2), (6, 1)}


def test_too_many_items_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(leakage, "MOST_CHARACTERS", 100)
    items = spark.createDataFrame([(i, "word " * 30) for i in range(5)], "item_id long, text string")
    with pytest.raises(ValueError, match="too large"):
        leakage.leaked_items(spark.createDataFrame([(1, "x")], "doc_id long, text string"), items)


def test_repeated_ids_of_labelled_texts(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (3, "dddd")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 1), (3, 0)], "doc_id long, toxic int")
    texts, y = abuse.labelled_texts(docs, labels, "doc_id", "text", "toxic")
    assert sorted(zip(texts, y.tolist(), strict=True)) == [("a", 1), ("c", 0), ("dddd", 1)]
    assert len(abuse.labelled_texts(docs, labels, "doc_id", "text", "toxic", characters=2)[0]) <= 2


# 8. abusive language


def made_texts(rng, n):
    people, code = ["olfi", "zoyel", "kelpa", "rivo", "ganel"], ["buffer", "index", "parser", "cache", "queue"]
    bad = ["{p} you are a worthless idiot", "shut up you stupid {p}", "nobody wants you here {p} you moron", "{p} is a filthy liar and should vanish"]
    good = ["the {c} is stupid when the disk is full", "fix the {c} that {p} reported", "remove worthless {c} entries", "{p} and you should read the {c}"]
    texts, y = [], []
    for _ in range(n):
        lines = [rng.choice(good).format(p=rng.choice(people), c=rng.choice(code)) for _ in range(6)]
        y.append(int(rng.random() < 0.3))
        if y[-1]:
            line = rng.choice(bad).format(p=rng.choice(people))
            lines[rng.integers(6)] = rng.choice([line, line.upper(), line.replace("you", "y0u"), line.replace("o", "о"), line.replace("id", "i​d")])
        texts.append("\n+ ".join(lines))
    return texts, np.array(y)


def test_held_out_accuracy(spark):
    rng = np.random.default_rng(7)
    texts, y = made_texts(rng, 900)
    rows = [(i, t, "s" if i % 2 else None) for i, t in enumerate(texts)] + [(1000, None, "s"), (1001, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, int(y[i])) for i in range(600)] + [(0, None), (None, 1)], "doc_id long, toxic int")
    scores = abuse.abuse_scores(docs, labels)
    got = {r.doc_id: r for r in scores.collect()}
    held = range(600, 900)
    assert np.mean([got[i].flagged == bool(y[i]) for i in held]) > 0.95
    assert got[1000].score is None
    assert not got[1001].flagged
    rates = {r.source: r for r in abuse.rates(abuse.abuse_scores(docs, labels, also="source"), "source").collect()}
    assert rates["s"].documents == 452
    assert rates[None].documents == 450
    none = abuse.abuse_scores(docs, labels.limit(0)).collect()
    assert len(none) == 902
    assert not any(r.flagged for r in none)


def test_disguises_are_read():
    words = abuse.Words(["idiot", "would", "raised"])
    assert words.reveal(abuse.plain("y o u  i.d.i.o.t")) == "you  idiot"
    assert words.reveal(abuse.plain("w*uld R4153D 1d10t")) == "would raised idiot"
    assert abuse.plain("еnjоy É​a") == "enjoy ea"


def test_running_sums_equal_the_sum_over_pairs():
    rng = np.random.default_rng(8)
    m = abuse.FactorizationMachine(bias=0.5)
    seen = rng.choice(1 << abuse.BITS, 30, replace=False)
    m.weights[seen] = rng.normal(size=30)
    m.place[seen] = np.arange(1, 31)
    m.factors = np.concatenate([m.factors, rng.normal(size=(30, abuse.FACTORS)).astype(np.float32)])
    one, two = rng.choice(seen, 10), rng.choice(seen, 10)
    got = m.scores(one, two, np.array([2]), np.array([7]))[0]
    t = np.r_[one[2:7], two[2:6]]
    v = m.factors[m.place[t]].astype(float)
    want = 0.5 + m.weights[t].sum() + sum(v[i] @ v[j] for i in range(len(t)) for j in range(i))
    assert got == pytest.approx(want, rel=1e-4)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables are not there")
@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p4_found", "p5_found", "p6_containers", "p7_found", "p8_found", "p2_sample", "p2_tenth"])
def test_registered_queries_run(spark, name):
    from lumenary.llm.queries import QUERIES

    rows = QUERIES[name](spark, SMALL).collect()
    assert len(rows) == len(set(rows)) > 0


@pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables are not there")
@pytest.mark.parametrize("name", ["p1_found", "p5_found", "p5_word_counts", "p5_source_terms", "p6_totals", "p8_source_documents"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from lumenary.llm.queries import ORACLES, QUERIES

    db = duckdb.connect()
    for f in Path(SMALL).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    want = db.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(tuple, QUERIES[name](spark, SMALL).select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)
