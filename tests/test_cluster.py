import numpy as np
import pytest
from pyspark.sql import functions as F

from balanza.operators import centroids, cluster, density, grid, pivots

BLOCK = 16


@pytest.fixture()
def small_blocks(monkeypatch):
    """Several cells, chunks and views even for a small fixture."""
    monkeypatch.setattr(grid.within, "__defaults__", (None, None, None, BLOCK))
    monkeypatch.setattr(pivots.k_distance, "__defaults__", (None, BLOCK))
    monkeypatch.setattr(pivots.distance_sums, "__defaults__", (BLOCK,))


def frame(spark, x, label=None):
    rows = [(f"p{i:04d}", *map(float, v), *([] if label is None else [int(label[i])])) for i, v in enumerate(x)]
    axes = ", ".join(f"x{d} double" for d in range(len(x[0])))
    return spark.createDataFrame(rows, f"id string, {axes}" + ("" if label is None else ", label int"))


@pytest.fixture(scope="module")
def blobs():
    """Three clouds, outliers, and a third of the points in one spot."""
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 0.4, size=(25, 2)) for c in ((0, 0), (5, 0), (0, 6))] + [np.full((40, 2), 2.5), [[30, 30], [-25, 8], [2.6, 9.9]]])
    return x


def gaps(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))


def test_silhouette(spark, blobs, small_blocks):
    label = np.arange(len(blobs)) % 3
    label[7] = 9
    d, expected = gaps(blobs), []
    for i in range(len(blobs)):
        own = label == label[i]
        if own.sum() == 1:
            expected.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, label == g].mean() for g in set(label) if g != label[i])
        expected.append((b - a) / max(a, b))
    rows = cluster.silhouette(frame(spark, blobs, label)).orderBy("id").collect()
    assert [r.silhouette for r in rows] == pytest.approx(expected) and rows[7].label == 9
    assert all(-1 <= r.silhouette <= 1 for r in rows)


def test_k_distance(spark, blobs, small_blocks):
    rows = cluster.k_distance(frame(spark, blobs)).orderBy("id").collect()
    assert [r.k_dist for r in rows] == pytest.approx(list(np.sort(gaps(blobs), axis=1)[:, 2]))


def test_k_distance_fixture(spark):
    points = frame(spark, [[0.0], [0.5], [1.0], [10.0]])
    assert [r.k_dist for r in cluster.k_distance(points).orderBy("id").collect()] == [1, 0.5, 1, 9.5]
    assert cluster.dbscan_eps(points).first().eps == pytest.approx(0.875)
    found = {r.id: r.cluster for r in cluster.numbered(cluster.dbscan(points, 0.6)).collect()}
    assert found == {"p0000": 0, "p0001": 0, "p0002": 0, "p0003": -1}


def brute_dbscan(x, eps, least):
    near = gaps(x) <= eps
    core = near.sum(axis=1) >= least
    label = [None] * len(x)
    for i in np.flatnonzero(core):
        if label[i] is None:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] is None:
                    label[j] = i
                    todo += [k for k in np.flatnonzero(near[j] & core) if label[k] is None]
    return [label[i] if core[i] else min((label[j] for j in np.flatnonzero(near[i] & core)), default=None) for i in range(len(x))], core


@pytest.mark.parametrize("eps", [0.3, 0.8, 3.0])
def test_dbscan(spark, blobs, small_blocks, eps):
    expected, core = brute_dbscan(blobs, eps, 3)
    for seed in (1, 2):
        points = frame(spark, blobs).orderBy(F.rand(seed)).repartition(3)
        rows = cluster.dbscan(points, eps).orderBy("id").collect()
        assert [r.label for r in rows] == [None if e is None else f"p{e:04d}" for e in expected]
        assert [r.nucleo for r in rows] == list(core)


def test_connected_components(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("a", "b"), ("c", "b"), ("hub", "x1"), ("hub", "x2"), ("x3", "hub"), ("q", "q")]
    rows = {r.id: r.label for r in grid.connected_components(spark.createDataFrame(chain, "u string, v string")).collect()}
    assert {rows[f"n{i:03d}"] for i in range(1, 41)} == {"n000"} and rows["b"] == rows["c"] == "a"
    assert rows["x1"] == rows["x2"] == rows["x3"] == "hub"


def test_components_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(grid, "EDGES_A_TASK", 5)
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("hub", f"x{i}") for i in range(20)] + [("a", "b")]
    edges = spark.createDataFrame(chain, "u string, v string").repartition(6)
    rows = {r.id: r.label for r in grid.connected_components(edges).collect()}
    assert rows == {**{f"n{i:03d}": "n000" for i in range(61)}, **{f"x{i}": "hub" for i in range(20)}, "hub": "hub", "a": "a", "b": "a"}
    assert grid.connected_components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("crowded", [False, True])
def test_dbscan_by_group(spark, blobs, small_blocks, crowded):
    """The same points at three dates, with a radius each: no date sees another's."""
    radii = {"d1": 0.3, "d2": 3.0, "d3": 0.0}
    x = np.vstack([blobs, np.full((60, 2), 2.5)]) if crowded else blobs
    rows = [(f"{d}{i:04d}", *map(float, v), d, r) for d, r in radii.items() for i, v in enumerate(x)]
    points = spark.createDataFrame(rows, "id string, x0 double, x1 double, fecha string, eps double")
    got = {r.id: (r.label, r.nucleo, r.fecha) for r in cluster.dbscan(points, "eps", by=["fecha"]).collect()}
    for d, r in radii.items():
        labels, core = brute_dbscan(x, r, 3)
        for i in range(len(x)):
            assert got[f"{d}{i:04d}"] == (None if labels[i] is None else f"{d}{labels[i]:04d}", bool(core[i]), d)
    summary = {r.fecha: (r.clusters, r.ruido) for r in cluster.dbscan_summary(cluster.dbscan(points, "eps", by=["fecha"]), ["fecha"]).collect()}
    labels, _ = brute_dbscan(x, 3.0, 3)
    assert summary["d2"] == (len(set(labels) - {None}), labels.count(None))


def test_cells_of_the_grid(spark):
    """Rows that are far apart share no cell, and a crowded cell is cut."""
    rng = np.random.default_rng(2)
    x = np.vstack([rng.uniform(0, 100, size=(400, 3)), np.full((200, 3), 50.0)])
    marked = frame(spark, x).withColumns({"_r": F.lit(1.0), "_target": F.lit(True), "_other": F.lit(True)})
    parts = grid._cells(marked, [], 32)
    sizes = parts.groupBy("_g0", "_g1", "_low", "_high").agg(F.count_if("_as_target").alias("a"), F.count_if(~F.col("_as_target")).alias("b"))
    most = sizes.agg(F.max("a"), F.max("b"), F.sum(F.col("a") * F.col("b"))).first()
    assert most[0] < 80 and most[1] < 80 and most[2] < 600 * 600 / 5


def test_k_distance_by_group(spark, blobs, small_blocks):
    rows = [(f"{d}{i:04d}", *map(float, v), d) for d in ("a", "b") for i, v in enumerate(blobs)]
    points = spark.createDataFrame(rows, "id string, x0 double, x1 double, fecha string")
    want = list(np.sort(gaps(blobs), axis=1)[:, 2])
    got = cluster.k_distance(points, by=["fecha"]).orderBy("id").collect()
    assert [r.k_dist for r in got] == pytest.approx(want * 2)
    assert [r.eps for r in cluster.dbscan_eps(points, by=["fecha"]).collect()] == pytest.approx([np.quantile(want, 0.25)] * 2)


def test_divisive_tree(spark, blobs):
    points = frame(spark, blobs[:75])
    label = np.array([r.label for r in cluster.hierarchical(points, 3).orderBy("id").collect()])
    assert sorted(np.bincount(label)) == [25, 25, 25] and len({label[0], label[30], label[60]}) == 3
    again = cluster.hierarchical(points.repartition(5), 3).orderBy("id").collect()
    assert [r.label for r in again] == list(label)
    costs = [r.inercia for r in cluster.tree_costs(points, [1, 2, 3]).orderBy("k").collect()]
    x = blobs[:75]
    assert costs[0] == pytest.approx(((x - x.mean(axis=0)) ** 2).sum()) and costs[0] > costs[1] > costs[2]
    assert cluster.hierarchical(frame(spark, [[1.0, 1.0]] * 5), 3).select("label").distinct().count() == 1


def test_indices(spark, blobs):
    label = np.arange(len(blobs)) % 4
    centres = np.array([blobs[label == g].mean(axis=0) for g in range(4)])
    size = np.bincount(label)
    within = sum(((blobs[label == g] - centres[g]) ** 2).sum() for g in range(4))
    between = (size * ((centres - blobs.mean(axis=0)) ** 2).sum(axis=1)).sum()
    spread = np.array([np.sqrt(((blobs[label == g] - centres[g]) ** 2).sum(axis=1)).mean() for g in range(4)])
    m = gaps(centres) + np.diag([np.inf] * 4)
    df = frame(spark, blobs, label)
    assert cluster.calinski_harabasz(df).first()[0] == pytest.approx(between / 3 / (within / (len(blobs) - 4)))
    assert cluster.davies_bouldin(df).first()[0] == pytest.approx(((spread[:, None] + spread[None]) / m).max(axis=1).mean())


def test_kmeans(spark, blobs):
    points = frame(spark, blobs[:75])
    labelled, centres = cluster.kmeans(points, 3, 10)
    got = np.array([r.label for r in labelled.orderBy("id").collect()])
    assert sorted(np.bincount(got)) == [25, 25, 25] and (np.diff(centres[:, 0]) > 0).all()
    again, _ = cluster.kmeans(points.repartition(7), 3, 10)
    assert [r.label for r in again.orderBy("id").collect()] == list(got)
    sweep = cluster.kmeans_sweep(points, [2, 3, 4, 5], 10)
    rows = sweep.orderBy("k").collect()
    assert all(a.inercia >= b.inercia for a, b in zip(rows, rows[1:]))
    x = blobs[:75]
    cost = sum(((x[got == g] - x[got == g].mean(axis=0)) ** 2).sum() for g in range(3))
    assert rows[1].inercia == pytest.approx(cost)
    assert cluster.best_k(sweep).first().silhouette == 3


def test_kmeans_with_fewer_spots_than_clusters(spark):
    points = frame(spark, [[0.0, 0.0]] * 30 + [[1.0, 1.0]] * 3)
    model = centroids.fit(points, ["x0", "x1"], [4], 2, 1)[4]
    assert model.cost == pytest.approx(0)


def test_pca(spark, blobs):
    rng = np.random.default_rng(1)
    x = np.column_stack([blobs, rng.normal(size=len(blobs)), blobs[:, 0] * 0.5 + 100])
    parts = cluster.Components(frame(spark, x))
    values, vectors = np.linalg.eigh(np.cov(x.T))
    order = np.argsort(values)[::-1]
    variance = parts.variance().orderBy("componente").collect()
    assert [r.varianza for r in variance] == pytest.approx(list(values[order] / values.sum()), abs=1e-9)
    assert variance[-1].acumulada == pytest.approx(1)
    first = vectors[:, order[0]] * np.sign(vectors[np.abs(vectors[:, order[0]]).argmax(), order[0]])
    scores = [r.pc1 for r in parts.scores().orderBy("id").collect()]
    assert scores == pytest.approx(list((x - x.mean(axis=0)) @ first), abs=1e-6)
    assert cluster.components_for(parts.variance(), 0.7).first()[0] >= 1
    rows = cluster.biplot(parts, ["a", "b", "c", "d"], x[:2]).collect()
    assert {r.tipo for r in rows} == {"puntaje", "carga", "centroide"}


def test_adjusted_rand(spark):
    df = spark.createDataFrame([(0, 1, 5), (0, 1, 5), (1, 0, 5), (1, 0, 5), (2, 2, 5)], "a int, b int, c int")
    assert cluster.adjusted_rand(df, "a", "a").first()[0] == pytest.approx(1)
    assert cluster.adjusted_rand(df, "a", "b").first()[0] == pytest.approx(1)
    assert cluster.adjusted_rand(df, "a", "c").first()[0] == pytest.approx(0)
    assert cluster.adjusted_rand(df, "c", "c").first()[0] == pytest.approx(1)


def test_parts_are_bounded(spark):
    """A group with all points still splits into parts of bounded size, in which every pair meets once."""
    points = frame(spark, np.zeros((300, 2))).withColumns({"g": F.lit(1), "_home": F.lit(True), "_other": F.lit(True)})
    sizes = grid.parts(points, ["g"], 32).groupBy("_low", "_high").agg(F.count_if("_as_target").alias("a"), F.count_if(~F.col("_as_target")).alias("b"))
    most = sizes.agg(F.max("a"), F.max("b"), F.sum(F.col("a") * F.col("b"))).first()
    assert most[0] < 64 and most[1] < 64 and most[2] == 300 * 300


def test_few_blocks_are_compared(spark):
    """Far-apart clouds: most pairs of blocks are ruled out, and the distances stay exact."""
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 1.0, size=(60, 3)) for c in rng.uniform(-400, 400, size=(12, 3))] + [np.full((240, 3), 7.0)])
    points = frame(spark, x)
    _, pairs = pivots.nearest_lists(points, 3, None, 30)
    blocks = len(x) // 30
    assert pairs.count() < blocks * (blocks - 1) / 4
    rows = pivots.k_distance(points, 3, None, 30).orderBy("id").collect()
    assert [r.k_dist for r in rows] == pytest.approx(list(np.sort(gaps(x), axis=1)[:, 2]))


def test_few_clusters_are_compared(spark):
    rng = np.random.default_rng(4)
    centres = rng.uniform(-100, 100, size=(10, 2))
    x, label = np.vstack([rng.normal(c, 1.0, size=(20, 2)) for c in centres]), np.repeat(np.arange(10), 20)
    long = frame(spark, x, label).withColumn("label", F.col("label").cast("string")).withColumn("etiquetado", F.lit("e"))
    met = pivots.candidate_clusters(long).agg(F.sum(F.size("_meets"))).first()[0]
    assert met < 200 * 10 / 3
    d, want = gaps(x), []
    for i in range(200):
        a = d[i, label == label[i]].sum() / 19
        b = min(d[i, label == g].mean() for g in range(10) if g != label[i])
        want.append((b - a) / max(a, b))
    got = cluster.silhouette(frame(spark, x, label)).orderBy("id").collect()
    assert [r.silhouette for r in got] == pytest.approx(want)


def test_dbscan_at_radius_zero(spark):
    rows = [(f"p{i}", 1.0, 2.0) for i in range(6)] + [("q", 1.0, 2.5), ("r", -0.0, 0.0), ("s", 0.0, 0.0), ("t", 0.0, 0.0)]
    points = spark.createDataFrame(rows, "id string, x0 double, x1 double")
    got = {r["id"]: (r["label"], r["nucleo"]) for r in cluster.dbscan(points, 0.0).collect()}
    assert all(got[f"p{i}"] == ("p0", True) for i in range(6)) and got["q"] == (None, False)
    assert all(got[x] == ("r", True) for x in "rst")


def test_pairs_of_packs_are_not_written(spark, blobs):
    """Packs stream past each other: no row is shuffled once per pair, for neighbours or for silhouettes."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    lists, _ = pivots.nearest_lists(frame(spark, blobs), 3, None, 16)
    assert "CartesianProduct" in plan(lists)
    label = np.arange(len(blobs)) % 3
    texts = frame(spark, blobs, label).withColumns({"a": F.col("label").cast("string"), "b": F.lit("x")}).drop("label")
    sums = pivots.distance_sums(texts, ["a", "b"], 16)
    assert plan(sums).count("CartesianProduct") == 1
    got = {(r.id, r.etiquetado, r.other): r.total for r in sums.collect()}
    d = gaps(blobs)
    assert got["p0007", "b", "x"] == pytest.approx(d[7].sum()) and got["p0007", "a", "1"] == pytest.approx(d[7, label == 1].sum())


def test_distances_far_from_the_origin():
    rng = np.random.default_rng(5)
    x = 1e6 + rng.normal(0, 1e-3, size=(40, 10))
    x = np.vstack([x, x[:3], np.full((2, 10), -1e6)])
    assert np.sqrt(pivots.squares(x, x)) == pytest.approx(gaps(x), rel=1e-9, abs=0)


def test_a_radius_from_the_k_distance_reaches_its_neighbour(spark):
    """k-distances are those of the grid to the last bit, so that a row at exactly the radius counts."""
    rng = np.random.default_rng(6)
    x = rng.normal(3.0, 1.0, size=(60, 10))
    got = [r.k_dist for r in cluster.k_distance(frame(spark, x)).orderBy("id").collect()]
    total = np.zeros((60, 60))
    for c in range(10):
        total += (x[:, c][:, None] - x[:, c][None, :]) ** 2
    assert got == list(np.sort(np.sqrt(total), axis=1)[:, 2])


def test_each_pair_of_packs_meets_once(spark):
    """A pair's distances are computed in one order only, and count for the rows of both packs."""
    held = spark.range(30).select(F.col("id").alias("_pack"), F.array("id").alias("x"))

    def names(batches):
        for batch in batches:
            yield batch.select(["_pack", "_pack2"])

    pairs = pivots.meet_once(held, 30, F.col("x")[0] + F.col("x2")[0] != 7, names, "_pack bigint, _pack2 bigint").collect()
    assert sorted(tuple(sorted(p)) for p in pairs) == [(i, j) for i in range(30) for j in range(i, 30) if i + j != 7]


def test_sums_of_both_packs_of_a_pair(spark):
    """Rows of different packs and labelings, in clusters of very different spread."""
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(c, s, size=(40, 3)) for c, s in (((0, 0, 0), 1.0), ((4, 0, 0), 2.0), ((0, 900, 0), 60.0))])
    labels = {"a": np.repeat([0, 1, 2], 40), "b": rng.integers(0, 4, 120)}
    points = frame(spark, x).select("*", *[F.element_at(F.array(*[F.lit(int(v)) for v in labels[c]]), F.substring("id", 2, 9).cast("int") + 1).cast("string").alias(c) for c in labels])
    sums = pivots.distance_sums(points, ["a", "b"], 16).collect()
    d, own = gaps(x), 0
    for r in sums:
        i = int(r.id[1:])
        assert r.label == str(labels[r.etiquetado][i]) and r.total == pytest.approx(d[i, labels[r.etiquetado] == int(r.other)].sum())
        own += r.label == r.other
    assert own == 240
    for name, label in labels.items():
        means = {(int(r.id[1:]), int(r.other)): r.total for r in sums if r.etiquetado == name and r.label != r.other}
        for i in range(120):
            of = {g: d[i, label == g].mean() for g in set(label) - {label[i]}}
            assert (i, min(of, key=of.get)) in means


@pytest.fixture()
def small_packs(monkeypatch):
    monkeypatch.setattr(density.Radius.__init__, "__defaults__", (None, BLOCK))
    monkeypatch.setattr(pivots, "LEAF_ROWS", 4)


@pytest.mark.parametrize("eps", [0.0, 0.3, 3.0])
def test_dbscan_over_many_packs(spark, blobs, small_packs, eps):
    x = np.vstack([blobs, np.full((60, 2), 2.5), blobs[:30] + 0.05])
    expected, core = brute_dbscan(x, eps, 3)
    rows = cluster.dbscan(frame(spark, x), eps).orderBy("id").collect()
    assert [r.label for r in rows] == [None if e is None else f"p{e:04d}" for e in expected]
    assert [r.nucleo for r in rows] == list(core)


def test_rows_are_not_written_per_neighbouring_cell(spark, blobs, small_packs):
    """Packs stream past each other: no row is copied before it is shuffled, and one link joins two dense packs."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    near = density.Radius(0.8)
    counts = near.counts(frame(spark, blobs))
    assert "CartesianProduct" in plan(counts) and "Generate" not in plan(counts)
    got = {r.id: r.n for r in counts.groupBy("id").agg(F.sum("n").alias("n")).collect()}
    assert [got[f"p{i:04d}"] for i in range(len(blobs))] == list((gaps(blobs) <= 0.8).sum(axis=1))
    same = frame(spark, np.zeros((160, 2)))
    assert near.links(same).count() <= 160 + 10 * 9 / 2


def test_groups_without_a_name(spark, small_packs):
    """Rows without a group are a group of their own, however many blocks it takes; an id may occur twice."""
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, size=(600, 2))
    rows = [(f"{d}{i:04d}", *map(float, v), d, 0.1) for d in ("a", None) for i, v in enumerate(x)] + [("twice", 50.0, 50.0, "a", 0.1)] * 2
    points = spark.createDataFrame(rows, "id string, x0 double, x1 double, fecha string, eps double")
    distances = pivots.k_distance(points, 3, ["fecha"], BLOCK).where(F.col("id") != "twice").orderBy("id").collect()
    want = list(np.sort(gaps(x), axis=1)[:, 2])
    assert [r.k_dist for r in distances] == pytest.approx(want + want) and {r.fecha for r in distances} == {"a", None}
    labels, core = brute_dbscan(x, 0.1, 3)
    found = cluster.dbscan(points, "eps", by=["fecha"]).collect()
    got = {(r.id, r.fecha): (r.label, r.nucleo) for r in found}
    assert len(found) == 1202 and got["twice", "a"] == ("twice", True)
    for d in ("a", None):
        assert [got[f"{d}{i:04d}", d] for i in range(600)] == [(None if e is None else f"{d}{e:04d}", bool(c)) for e, c in zip(labels, core)]
