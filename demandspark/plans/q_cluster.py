"""Checked queries: scaling and PCA (ML1-ML6), K-Means family (CLU1-3, CLU7, CLU10, CLU11),
and the distance operators (JN9, JN10, CLU4-6, CLU8, CLU9)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from demandspark.operators import clean, cluster, neighbors, scale, ward
from demandspark.plans import api
from demandspark.plans.common import round_doubles
from demandspark.plans.registry import query, r4
from demandspark.session import cut_lineage
from demandspark.sources import fixtures as fx

DP = fx.with_ctes(fx.SQL_DEMAND_PANEL)
MEAS = list(fx.MEASURES)
EMB = """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings),
pairs AS (SELECT a.id, b.id AS nbr_id, b.label AS nbr_label,
                 sqrt(round(power(list_distance(a.vec, b.vec), 2), 9)) AS distance FROM v a, v b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, nbr_id) AS rank FROM pairs)
"""


def _z_sql(c):
    return (f"CASE WHEN stddev_pop({c}) OVER () = 0 THEN 0.0 "
            f"ELSE ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () END")


@query("ml1_standardize", DP + "SELECT row_id, " + ", ".join(
    f"{r4(_z_sql(c))} AS {c}" for c in MEAS) + " FROM demand_panel")
def ml1_standardize(spark, sf):
    return round_doubles(scale.standardize(fx.demand_panel(spark, sf), MEAS).select("row_id", *MEAS))


_TRAIN = "local_time < TIMESTAMP '2024-01-20 00:00:00'"


@query("ml2_fit_train_apply_all", DP + ", st AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in MEAS) + f" FROM demand_panel WHERE {_TRAIN})\n"
    "SELECT row_id, " + ", ".join(
    f"{r4(f'CASE WHEN s_{c} = 0 THEN 0.0 ELSE ({c} - m_{c}) / s_{c} END')} AS {c}" for c in MEAS)
    + " FROM demand_panel, st")
def ml2_fit_train_apply_all(spark, sf):
    p = fx.demand_panel(spark, sf)
    model = scale.fit_scaler(p.filter(F.col("local_time") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")),
                             MEAS)
    model = scale.ScalerModel.from_json(model.to_json())  # the model round-trips as a small document
    return round_doubles(model.transform(p).select("row_id", *MEAS))


@query("ml6_assemble_features", DP + "SELECT row_id, " + ", ".join(
    f"{r4(c)} AS f{i}" for i, c in enumerate(MEAS))
    + " FROM demand_panel WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in MEAS))
def ml6_assemble_features(spark, sf):
    v = scale.assemble(fx.demand_panel(spark, sf), MEAS)
    arr = vector_to_array("features")
    return round_doubles(v.select("row_id", *[arr[i].alias(f"f{i}") for i in range(len(MEAS))]))


def cluster_input(spark, sf):
    """The clustering program's input: imputed panel, 7 standardised features, assembled."""
    p = fx.with_calendar(fx.demand_panel(spark, sf))
    p = clean.impute_median(p, ["temperature", "humidity"])
    cols = list(scale.CLUSTER_FEATURES)
    z = scale.standardize(p, cols, suffix="_z")
    # iterative fits read this frame many times: written once
    return cut_lineage(scale.assemble(z, [f"{c}_z" for c in cols])), cols


@query("ml3_pca_scores")
def ml3_pca_scores(spark, sf):
    data, cols = cluster_input(spark, sf)
    res = scale.pca(data, [f"{c}_z" for c in cols], k=2)
    return res.scores.select("row_id", "pc1", "pc2")


@query("ml3_pca_loadings")
def ml3_pca_loadings(spark, sf):
    data, cols = cluster_input(spark, sf)
    res = scale.pca(data, [f"{c}_z" for c in cols], k=2)
    ev = res.explained_pct
    return res.loadings.withColumns({"explained_pc1_pct": F.lit(ev[0]), "explained_pc2_pct": F.lit(ev[1])})


@query("ml4_ml5_pca_frame_and_centres")
def ml4_ml5_pca_frame_and_centres(spark, sf):
    data, cols = cluster_input(spark, sf)
    res = scale.pca(data, [f"{c}_z" for c in cols], k=2)
    fit = cluster.kmeans(data, 6, n_init=10)
    labelled = cluster.assign(fit, res.scores, "kmeans_cluster")
    frame = labelled.select("row_id", "pc1", "pc2", "demand", "temperature", "hour", "day_of_week",
                            "kmeans_cluster", F.lit(False).alias("is_centre"))
    cent = scale.project(res, cluster.centres(fit, spark))
    cent = cent.select(F.lit(None).cast("long").alias("row_id"), "pc1", "pc2",
                       *[F.lit(None).cast(t).alias(c) for c, t in (("demand", "double"), ("temperature", "double"),
                                                                    ("hour", "int"), ("day_of_week", "int"))],
                       F.col("cluster").alias("kmeans_cluster"), F.lit(True).alias("is_centre"))
    return frame.unionByName(cent)


@query("clu1_kmeans")
def clu1_kmeans(spark, sf):
    data, _ = cluster_input(spark, sf)
    fit = cluster.kmeans(data, 6, n_init=10, seed=42)
    return cluster.assign(fit, data, "kmeans_cluster").select("row_id", "kmeans_cluster")


@query("clu2_kmeans_sweep")
def clu2_kmeans_sweep(spark, sf):
    data, _ = cluster_input(spark, sf)
    return cluster.kmeans_sweep(data, range(2, 15), n_init=10, seed=42).withColumnRenamed(
        "silhouette", "silhouette_squared")


@query("clu3_choose_k")
def clu3_choose_k(spark, sf):
    data, _ = cluster_input(spark, sf)
    return cluster.choose_k(cluster.kmeans_sweep(data, range(2, 15), n_init=10, seed=42))


@query("clu3_choose_k_rule", DP + """, sweep AS (
  SELECT CAST(hour(local_time) + 2 AS INTEGER) AS k, avg(demand) AS silhouette FROM demand_panel GROUP BY 1),
best AS (SELECT k FROM sweep ORDER BY silhouette DESC, k LIMIT 1)
SELECT best.k AS best_k, least(best.k + 1, (SELECT max(k) FROM sweep)) AS reference_rule_k FROM best""")
def clu3_choose_k_rule(spark, sf):
    """The rule on a score per K that SQL can state: the mean demand of each hour stands for the silhouette."""
    hours = fx.with_calendar(fx.demand_panel(spark, sf)).groupBy((F.col("hour") + 2).cast("int").alias("k"))
    return cluster.choose_k(hours.agg(F.avg("demand").alias("silhouette")))


_CLUSTERED = DP + "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS not_nearest, " \
    "CAST(least(6, count(DISTINCT row_id)) AS BIGINT) AS clusters FROM demand_panel"


@query("clu1_labels_are_nearest", _CLUSTERED)
def clu1_labels_are_nearest(spark, sf):
    """Every row is labelled, with a centre that no other centre is nearer than, and no cluster is empty."""
    data, _ = cluster_input(spark, sf)
    fit = cluster.kmeans(data, 6, n_init=10, seed=42)
    x = vector_to_array("features")
    d2 = F.array(*[sum(((x[i] - float(v)) ** 2 for i, v in enumerate(c)), F.lit(0.0)) for c in fit.centres])
    rows = cluster.assign(fit, data, "label").select("label", d2.alias("d2"))
    return rows.agg(F.count("label").alias("rows"),
                    F.count_if(F.get("d2", F.col("label")) > F.array_min("d2")).alias("not_nearest"),
                    F.count_distinct("label").alias("clusters"))


@query("clu7_hierarchical")
def clu7_hierarchical(spark, sf):
    data, _ = cluster_input(spark, sf)
    return cluster.hierarchical(data, k=5).select("row_id", "hierarchical_cluster")


@query("clu7_ward_linkage")
def clu7_ward_linkage(spark, sf):
    """The merge tree over all rows (dendrogram): as many merges as there are features, less one."""
    data, _ = cluster_input(spark, sf)
    return ward.fit(data).linkage(spark)


@query("clu10_silhouette_fast")
def clu10_silhouette_fast(spark, sf):
    data, _ = cluster_input(spark, sf)
    fit = cluster.kmeans(data, 6, n_init=10)
    s = cluster.silhouette_fast(cluster.assign(fit, data, "label"))
    return spark.createDataFrame([(6, s)], "k int, silhouette double")


# --- distance operators ------------------------------------------------------------------

def _emb(spark, sf):
    return neighbors.embedding_points(fx.vectors(spark, sf))


@query("jn9_knn_join", EMB + f"""SELECT id, CAST(rank AS INTEGER) AS rank, nbr_id, {r4('distance')} AS distance
FROM ranked WHERE rank <= 5""")
def jn9_knn_join(spark, sf):
    return round_doubles(neighbors.knn(_emb(spark, sf), 5, tile_size=128))


@query("clu6_k_distance", EMB + f"""SELECT id, {r4('distance')} AS k_distance,
  CAST(row_number() OVER (ORDER BY distance, id) - 1 AS BIGINT) AS position FROM ranked WHERE rank = 20""")
def clu6_k_distance(spark, sf):
    kd = neighbors.k_distance(_emb(spark, sf), 20, tile_size=128)
    return round_doubles(kd.select("id", "k_distance", "position"))


@query("clu8_knn_label_smoothing", EMB + """SELECT id, nbr_label AS smoothed_label FROM (
  SELECT id, nbr_label, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, nbr_label) AS rn
  FROM ranked WHERE rank <= 5 GROUP BY id, nbr_label) WHERE rn = 1""")
def clu8_knn_label_smoothing(spark, sf):
    pts = _emb(spark, sf)
    out = neighbors.knn_smooth(pts, pts.select("id", "label"), 5, tile_size=128)
    return out.select("id", F.col("smoothed_label").cast("int").alias("smoothed_label"))


@query("clu9_silhouette_exact", """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings),
d AS (SELECT a.id, a.label AS lab, b.label AS olab, sqrt(round(power(list_distance(a.vec, b.vec), 2), 9)) AS dist
      FROM v a, v b WHERE a.id <> b.id),
per AS (SELECT id, lab, olab, avg(dist) AS m FROM d GROUP BY id, lab, olab),
sizes AS (SELECT label, count(*) AS n FROM v GROUP BY label),
s AS (SELECT v.id, CASE WHEN sizes.n = 1 THEN 0.0 ELSE
        (min(CASE WHEN olab <> lab THEN m END) - max(CASE WHEN olab = lab THEN m END)) /
        greatest(min(CASE WHEN olab <> lab THEN m END), max(CASE WHEN olab = lab THEN m END)) END AS s
      FROM v JOIN sizes ON sizes.label = v.label JOIN per ON per.id = v.id GROUP BY v.id, sizes.n)
SELECT """ + r4("avg(s)") + """ AS silhouette, CAST(count(*) AS BIGINT) AS points FROM s""")
def clu9_silhouette_exact(spark, sf):
    return round_doubles(neighbors.silhouette(_emb(spark, sf), tile_size=128))


def _dbscan_points(spark, sf):
    p = fx.demand_panel(spark, sf).na.drop(subset=["demand", "temperature"])
    z = scale.standardize(p, ["demand", "temperature"])
    return neighbors.vectorize(z, ["demand", "temperature"]).select("id", "vec")


_Z2 = DP + """, base AS (SELECT row_id, demand, temperature FROM demand_panel
                          WHERE demand IS NOT NULL AND temperature IS NOT NULL),
z AS (SELECT row_id, (demand - avg(demand) OVER ()) / stddev_pop(demand) OVER () AS z1,
             (temperature - avg(temperature) OVER ()) / stddev_pop(temperature) OVER () AS z2 FROM base)
"""


@query("jn10_eps_neighbour_counts", _Z2 + """
SELECT a.row_id AS id, CAST(count(*) AS BIGINT) AS neighbours FROM z a JOIN z b
  ON abs(a.z1 - b.z1) <= 0.5 AND abs(a.z2 - b.z2) <= 0.5
 AND round((a.z1 - b.z1) * (a.z1 - b.z1) + (a.z2 - b.z2) * (a.z2 - b.z2), 9) <= 0.25
GROUP BY a.row_id""")
def jn10_eps_neighbour_counts(spark, sf):
    return neighbors.neighbour_counts(_dbscan_points(spark, sf), 0.5, dims=[0, 1], tile_size=1024)


def _cluster_points(spark, sf):
    """All rows with their seven imputed and standardised features."""
    data, cols = cluster_input(spark, sf)
    return neighbors.vectorize(data, [f"{c}_z" for c in cols]).select("id", "vec")


@query("clu4_dbscan")
def clu4_dbscan(spark, sf):
    return neighbors.dbscan(_cluster_points(spark, sf), eps=0.5, min_samples=20)


@query("clu5_dbscan_summary")
def clu5_dbscan_summary(spark, sf):
    return neighbors.dbscan_summary(neighbors.dbscan(_cluster_points(spark, sf), eps=0.5, min_samples=20))


# On the embeddings these give about 20 clusters, and border points between two clusters.
EPS_E, MIN_E = 1.15, 4
_DBSCAN_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
near AS (SELECT a.id, b.id AS nbr FROM v a, v b WHERE round(power(list_distance(a.vec, b.vec), 2), 9) <= {EPS_E} * {EPS_E}),
core AS (SELECT id FROM near GROUP BY id HAVING count(*) >= {MIN_E}),
links AS (SELECT near.id, nbr FROM near JOIN core ON core.id = near.id JOIN core c ON c.id = nbr),
reach(id, lab) AS (SELECT id, id FROM core UNION SELECT links.nbr, reach.lab FROM reach JOIN links ON links.id = reach.id),
comp AS (SELECT id, min(lab) AS lab FROM reach GROUP BY id),
numbered AS (SELECT id, CAST(dense_rank() OVER (ORDER BY lab) - 1 AS BIGINT) AS label FROM comp),
border AS (SELECT near.id, min(label) AS label FROM near JOIN numbered ON numbered.id = nbr
           WHERE near.id NOT IN (SELECT id FROM core) GROUP BY near.id),
labels AS (SELECT v.id, coalesce(numbered.label, border.label, -1) AS label, numbered.id IS NOT NULL AS core
           FROM v LEFT JOIN numbered ON numbered.id = v.id LEFT JOIN border ON border.id = v.id)
"""


@query("clu4_dbscan_embeddings", _DBSCAN_SQL + "SELECT id, label, core FROM labels")
def clu4_dbscan_embeddings(spark, sf):
    return neighbors.dbscan(_emb(spark, sf).select("id", "vec"), eps=EPS_E, min_samples=MIN_E)


@query("clu5_dbscan_summary_embeddings", _DBSCAN_SQL + f"""
SELECT CAST(count(DISTINCT CASE WHEN label <> -1 THEN label END) AS BIGINT) AS clusters,
       CAST(count(*) FILTER (WHERE label = -1) AS BIGINT) AS noise,
       {r4("avg(CASE WHEN label = -1 THEN 1.0 ELSE 0.0 END) * 100")} AS noise_pct FROM labels""")
def clu5_dbscan_summary_embeddings(spark, sf):
    labels = neighbors.dbscan(_emb(spark, sf).select("id", "vec"), eps=EPS_E, min_samples=MIN_E)
    return round_doubles(neighbors.dbscan_summary(labels))


@query("clu11_compare_algorithms")
def clu11_compare_algorithms(spark, sf):
    data, cols = cluster_input(spark, sf)
    fit = cluster.kmeans(data, 6, n_init=10)
    points = neighbors.vectorize(cluster.assign(fit, data, "label"), [f"{c}_z" for c in cols]).select("id", "vec", "label")
    return api.compare_labels(data, points, 6)
