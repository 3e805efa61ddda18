"""Principal components, clustering, validation indices and density-based outliers."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from balanza.constants import CLUSTER_FEATURES
from balanza.functions.ordered import exact_quantiles, global_position
from balanza.operators import centroids, density, grid, neighbours, pivots
from balanza.operators.describe import crosstab
from balanza.operators.stats import robust_scale
from balanza.session import checkpoint

SEED = 42


def scaled_points(panel: DataFrame, features: list[str] = CLUSTER_FEATURES, id_column: str = "id") -> DataFrame:
    """Robust-scaled complete rows as (id, x0, x1, ...), checkpointed for the passes to come."""
    complete = panel.na.drop(subset=features)
    if "id" not in panel.columns:
        complete = complete.withColumn("id", F.concat_ws("|", "ruc", "fecha_corte"))
    return checkpoint(neighbours.to_points(robust_scale(complete, features), id_column, features))


def _assembled(points: DataFrame, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=neighbours.dimensions(points), outputCol=out).transform(points)


# Principal components ----------------------------------------------------------------------


class Components:
    """PCA of points: centred first, each component signed so that its largest loading is positive."""

    def __init__(self, points: DataFrame, k: int | None = None):
        self.spark = points.sparkSession
        self.axes = neighbours.dimensions(points)
        self.k = k or len(self.axes)
        centred = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="features")
        assembled = _assembled(points, "raw")
        self.scaler = centred.fit(assembled)
        rows = self.scaler.transform(assembled)
        model = PCA(k=self.k, inputCol="features", outputCol="pcs").fit(rows)
        loadings = np.asarray(model.pc.toArray())
        signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(self.k)])
        self.loadings_matrix = loadings * signs
        self.explained = np.asarray(model.explainedVariance.toArray())
        flips = F.array(*[F.lit(float(s)) for s in signs])
        self.rows = model.transform(rows).withColumn(
            "pcs", F.zip_with(vector_to_array("pcs"), flips, lambda a, b: a * b)
        )

    def scores(self, k: int | None = None) -> DataFrame:
        return self.rows.select("id", *[F.col("pcs")[i].alias(f"pc{i + 1}") for i in range(k or self.k)])

    def loadings(self, features: list[str]) -> DataFrame:
        rows = [(f, *(float(v) for v in self.loadings_matrix[i])) for i, f in enumerate(features)]
        return self.spark.createDataFrame(rows, "indicador string, " + ", ".join(f"pc{i + 1} double" for i in range(self.k)))

    def variance(self) -> DataFrame:
        """Explained share per component with its running total (one row per component)."""
        rows = [(i + 1, float(v)) for i, v in enumerate(self.explained)]
        table = self.spark.createDataFrame(rows, "componente int, varianza double")
        return with_cumulative(table)

    def project(self, centres: np.ndarray) -> np.ndarray:
        return (centres - np.asarray(self.scaler.mean.toArray())) @ self.loadings_matrix


def with_cumulative(variance: DataFrame) -> DataFrame:
    """Running total over the components: as many rows as features."""
    upto = Window.partitionBy(F.lit(0)).orderBy("componente").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return variance.withColumn("acumulada", F.sum("varianza").over(upto))


def components_for(variance: DataFrame, share: float = 0.70) -> DataFrame:
    """Fewest components that explain the share."""
    return variance.agg(F.min(F.when(F.col("acumulada") >= share, F.col("componente"))).alias("componentes"))


def biplot(components: Components, features: list[str], centres: np.ndarray | None = None, stretch: float = 3.5) -> DataFrame:
    """Plot rows: scores, stretched loadings and projected centroids on the first two components."""
    scores = components.scores(2).select(F.lit("puntaje").alias("tipo"), F.col("id").alias("nombre"), "pc1", "pc2")
    arrows = components.loadings(features).select(
        F.lit("carga").alias("tipo"), F.col("indicador").alias("nombre"),
        (F.col("pc1") * F.lit(stretch)).alias("pc1"), (F.col("pc2") * F.lit(stretch)).alias("pc2"),
    )
    rows = scores.unionByName(arrows)
    if centres is None:
        return rows
    marks = [("centroide", str(i), float(p[0]), float(p[1])) for i, p in enumerate(components.project(centres))]
    return rows.unionByName(components.spark.createDataFrame(marks, "tipo string, nombre string, pc1 double, pc2 double"))


# K-Means -----------------------------------------------------------------------------------


def assign(points: DataFrame, centres: np.ndarray, out: str = "label") -> DataFrame:
    return points.withColumn(out, centroids.nearest_centre(neighbours.dimensions(points), centres))


def _in_order(centres: np.ndarray) -> np.ndarray:
    """Centres by their coordinates, so that cluster numbers repeat between runs."""
    return centres[np.lexsort(centres.T[::-1])]


def kmeans(points: DataFrame, k: int = 3, n_init: int = 50, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """Labelled points and centres of the cheapest of ``n_init`` fits."""
    model = centroids.fit(points, neighbours.dimensions(points), [k], n_init, seed)[k]
    centres = _in_order(model.centres)
    return assign(points, centres), centres


def kmeans_sweep(points: DataFrame, ks: list[int] | None = None, n_init: int = 20, seed: int = SEED) -> DataFrame:
    """Inertia and the three validation indices for each k."""
    ks = ks or list(range(2, min(points.count() - 1, 9)))
    models = centroids.fit(points, neighbours.dimensions(points), ks, n_init, seed)
    labelled, names = points, {}
    for k in ks:
        names[f"k{k}"] = k
        labelled = assign(labelled, models[k].centres, f"k{k}")
    indices = validation(checkpoint(labelled), list(names))
    rows = [(k, models[k].cost, *indices[name]) for name, k in names.items()]
    return points.sparkSession.createDataFrame(
        rows, "k int, inercia double, silhouette double, calinski_harabasz double, davies_bouldin double"
    )


def best_k(sweep: DataFrame) -> DataFrame:
    """The k each criterion prefers."""
    return sweep.agg(
        F.min_by("k", "inercia").alias("inercia"),
        F.max_by("k", "silhouette").alias("silhouette"),
        F.max_by("k", "calinski_harabasz").alias("calinski_harabasz"),
        F.min_by("k", "davies_bouldin").alias("davies_bouldin"),
    )


# Validation --------------------------------------------------------------------------------


def _long_labels(labelled: DataFrame, labelings: list[str], columns: list[str]) -> DataFrame:
    """One row per point and labeling."""
    texts = labelled.withColumns({c: F.col(c).cast("string") for c in labelings})
    return texts.unpivot(columns, labelings, "etiquetado", "label")


def silhouettes(labelled: DataFrame, labelings: list[str]) -> DataFrame:
    """Euclidean silhouette of every row under each labeling; a cluster of one scores 0.

    A row meets its own cluster and those that may be its nearest other one.
    """
    texts = labelled.select("id", *neighbours.dimensions(labelled), *[F.col(c).cast("string").alias(c) for c in labelings])
    sums = pivots.distance_sums(texts, labelings)
    sizes = (
        _long_labels(labelled, labelings, ["id"])
        .groupBy("etiquetado", F.col("label").alias("other"))
        .agg(F.count(F.lit(1)).alias("_size"))
    )
    own = F.col("other") == F.col("label")
    means = (
        sums.join(F.broadcast(sizes), ["etiquetado", "other"])  # a row per cluster
        .groupBy("id", "etiquetado", "label")
        .agg(
            F.max(F.when(own, F.col("_size"))).alias("_own"),
            F.max(F.when(own & (F.col("_size") > 1), F.col("total") / (F.col("_size") - 1))).alias("a"),
            F.min(F.when(~own, F.col("total") / F.col("_size"))).alias("b"),
        )
    )
    score = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return means.select(
        "id", "etiquetado", "label", F.when(F.col("_own") == 1, F.lit(0.0)).otherwise(score).alias("silhouette")
    )


def silhouette(labelled: DataFrame, label: str = "label") -> DataFrame:
    kind = labelled.schema[label].dataType
    return silhouettes(labelled, [label]).select("id", F.col("label").cast(kind).alias(label), "silhouette")


class ClusterMoments:
    """Size, centre, spread and sum of squares of the clusters of one labeling (k-sized arrays)."""

    def __init__(self, rows, axes: list[str]):
        self.sizes = np.array([r["size"] for r in rows], float)
        self.spread = np.array([r["spread"] for r in rows])
        self.within = np.array([r["within"] for r in rows])
        self.centres = np.array([[r[f"m_{c}"] for c in axes] for r in rows])
        self.n, self.k = self.sizes.sum(), len(rows)

    def calinski_harabasz(self) -> float:
        overall = self.sizes @ self.centres / self.n
        between = float(self.sizes @ ((self.centres - overall) ** 2).sum(axis=1))
        return float(between / (self.k - 1) / (self.within.sum() / (self.n - self.k)))

    def davies_bouldin(self) -> float:
        gaps = np.sqrt(((self.centres[:, None] - self.centres[None]) ** 2).sum(axis=2))
        np.fill_diagonal(gaps, np.inf)
        return float(((self.spread[:, None] + self.spread[None]) / gaps).max(axis=1).mean())


def cluster_moments(labelled: DataFrame, labelings: list[str]) -> dict[str, ClusterMoments]:
    """Two aggregates over the rows for all labelings; one row per cluster reaches the driver."""
    axes, keys = neighbours.dimensions(labelled), ["etiquetado", "label"]
    long = _long_labels(labelled, labelings, axes)
    centres = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"), *[F.avg(c).alias(f"m_{c}") for c in axes])
    square = F.lit(0.0)
    for c in axes:
        square = square + (F.col(c) - F.col(f"m_{c}")) * (F.col(c) - F.col(f"m_{c}"))
    rows = (
        long.join(centres, keys)
        .groupBy(*keys)
        .agg(
            F.max("_size").alias("size"), F.avg(F.sqrt(square)).alias("spread"), F.sum(square).alias("within"),
            *[F.max(f"m_{c}").alias(f"m_{c}") for c in axes],
        )
        .orderBy(*keys)
        .collect()
    )
    return {name: ClusterMoments([r for r in rows if r.etiquetado == name], axes) for name in labelings}


def calinski_harabasz(labelled: DataFrame, label: str = "label") -> DataFrame:
    value = cluster_moments(labelled, [label])[label].calinski_harabasz()
    return labelled.sparkSession.createDataFrame([(value,)], "calinski_harabasz double")


def davies_bouldin(labelled: DataFrame, label: str = "label") -> DataFrame:
    value = cluster_moments(labelled, [label])[label].davies_bouldin()
    return labelled.sparkSession.createDataFrame([(value,)], "davies_bouldin double")


def validation(labelled: DataFrame, labelings: list[str]) -> dict[str, tuple[float, float, float]]:
    """(silhouette, Calinski-Harabasz, Davies-Bouldin) per labeling."""
    moments = cluster_moments(labelled, labelings)
    means = silhouettes(labelled, labelings).groupBy("etiquetado").agg(F.avg("silhouette").alias("s")).collect()
    mean = {r.etiquetado: float(r.s) for r in means}
    return {n: (mean[n], moments[n].calinski_harabasz(), moments[n].davies_bouldin()) for n in labelings}


def validation_table(labelled: DataFrame, labelings: list[str], seed: int = SEED) -> DataFrame:
    """Indices per method. The inertia column is that of a fresh K-Means with the same k."""
    counts = labelled.agg(*[F.countDistinct(c).alias(c) for c in labelings]).first().asDict()
    usable = [c for c in labelings if counts[c] >= 2]
    indices = validation(labelled, usable)
    ks = sorted({counts[c] for c in usable})
    fresh = centroids.fit(labelled, neighbours.dimensions(labelled), ks, 1, seed)
    rows = [(c, counts[c], *indices[c], fresh[counts[c]].cost) for c in usable]
    return labelled.sparkSession.createDataFrame(
        rows, "metodo string, k int, silhouette double, calinski_harabasz double, davies_bouldin double, inercia double"
    )


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chance-corrected agreement of two labelings, from contingency counts."""

    def pairs(c):
        return F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)

    table = crosstab(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b)
    cells = table.agg(pairs("n").alias("both"), F.sum("n").alias("n"))
    rows = table.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs("n"))
    columns = table.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs("n"))
    total = F.col("n").cast("double") * (F.col("n") - 1) / 2
    sums = cells.withColumns({"pa": rows.scalar(), "pb": columns.scalar()})
    expected = F.col("pa") * F.col("pb") / total
    highest = (F.col("pa") + F.col("pb")) / 2
    return sums.select(
        F.coalesce(F.try_divide(F.col("both") - expected, highest - expected), F.lit(1.0)).alias("ari")
    )


def attach_clusters(panel: DataFrame, labelled: DataFrame, out: str = "cluster") -> DataFrame:
    """Labels back on the panel; rows that were not clustered stay with null."""
    keyed = panel if "id" in panel.columns else panel.withColumn("id", F.concat_ws("|", "ruc", "fecha_corte"))
    return keyed.join(labelled.select("id", F.col("label").alias(out)), "id", "left")


def cluster_members(df: DataFrame, label: str, name: str) -> DataFrame:
    """Members in order, one row each with its cluster's size: the list itself has no bound."""
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return df.join(sizes, label).select(label, "n", name).orderBy(label, name)


# Density -----------------------------------------------------------------------------------


def k_distance(points: DataFrame, k: int = 3, by: list[str] | None = None) -> DataFrame:
    """Distance to the k-th nearest row, of the row's own group ``by`` if given; a row is its own first neighbour."""
    return pivots.k_distance(points, k, by)


def dbscan_eps(points: DataFrame, k: int = 3, share: float = 0.25, by: list[str] | None = None) -> DataFrame:
    return exact_quantiles(k_distance(points, k, by), by or [], "k_dist", [share], ["eps"])


def dbscan(points: DataFrame, eps, min_points: int = 3, by: list[str] | None = None) -> DataFrame:
    """(id, label, nucleo): label is the smallest core id of the cluster, null for noise.

    ``eps`` is a number, or with groups ``by`` a column of ``points`` that is the same within a
    group; rows of different groups are never neighbours. Rows meet in packs, of which only per-row
    results leave: neighbour counts, links between cores and border labels. Core rows of a dense
    region are linked by a spanning set of edges, not by all pairs.
    """
    by = by or []
    near, kept = density.Radius(eps, by), ["id", *neighbours.dimensions(points), *by, *([eps] if isinstance(eps, str) else [])]
    counts = near.counts(points.select(*kept))
    core = counts.groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= min_points).select("id", F.lit(True).alias("nucleo"))
    marked = checkpoint(points.select(*kept).join(core, "id", "left").na.fill(False, ["nucleo"]))
    parts = grid.connected_components(near.links(marked.where("nucleo").drop("nucleo")))
    labels = marked.join(parts, "id", "left").withColumn("label", F.when(F.col("nucleo"), F.coalesce("label", "id")))
    labels = checkpoint(labels)
    border = near.smallest_labels(labels.where(F.col("label").isNull()), labels.where(F.col("label").isNotNull()))
    nearest = border.groupBy("id").agg(F.min("label").alias("_border"))
    return labels.join(nearest, "id", "left").select(*by, "id", F.coalesce("label", "_border").alias("label"), "nucleo")


def numbered(clusters: DataFrame, by: list[str] | None = None) -> DataFrame:
    """DBSCAN labels as 0, 1, ... (per group) in the order of their smallest core id; noise is −1."""
    by = by or []
    names = clusters.where(F.col("label").isNotNull()).select(*by, "label").distinct()
    numbers = global_position(names, [F.col("label")], "_number", by)
    return clusters.join(numbers, [*by, "label"], "left").select(
        *by, "id", F.coalesce(F.col("_number") - 1, F.lit(-1)).alias("cluster"), "nucleo"
    )


def dbscan_summary(clusters: DataFrame, by: list[str] | None = None) -> DataFrame:
    return clusters.groupBy(*(by or [])).agg(
        F.countDistinct("label").alias("clusters"), F.count(F.when(F.col("label").isNull(), 1)).alias("ruido")
    )


# Hierarchy ---------------------------------------------------------------------------------


def hierarchical(points: DataFrame, k: int = 3, seed: int = SEED) -> DataFrame:
    """Points with ``label``, the leaf of a divisive tree: the largest cluster is cut in two until there are ``k``.

    Labels are numbered by their centres, so that they repeat between runs. Fewer than ``k``
    different points give fewer labels.
    """
    if k < 2:
        return points.withColumn("label", F.lit(0))
    axes = neighbours.dimensions(points)
    model = BisectingKMeans(k=k, seed=seed, maxIter=50, featuresCol="features", predictionCol="_leaf").fit(_assembled(points))
    leaves = checkpoint(model.transform(_assembled(points)).drop("features"))
    centres = leaves.groupBy("_leaf").agg(*[F.avg(c).alias(c) for c in axes])  # k rows
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*axes, "_leaf")) - 1
    return leaves.join(F.broadcast(centres.select("_leaf", number.alias("label"))), "_leaf").drop("_leaf")


def tree_costs(points: DataFrame, ks: list[int], seed: int = SEED) -> DataFrame:
    """(k, inercia): the sum of squares within the leaves of the divisive tree, for each number of leaves."""
    axes = neighbours.dimensions(points)
    rows = []
    for k in ks:
        cut = hierarchical(points, k, seed)
        rows.append((k, float(cluster_moments(cut.select("id", *axes, "label"), ["label"])["label"].within.sum())))
    return points.sparkSession.createDataFrame(rows, "k int, inercia double")
