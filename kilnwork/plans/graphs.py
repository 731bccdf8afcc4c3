"""Queries of the graph operators over ub_sample_data (users sharing at least 5 businesses) and of clustering over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnwork.operators import cluster as K
from kilnwork.operators import graph as G
from kilnwork.operators.pairs import held_common_counts
from kilnwork.operators.relational import baskets
from kilnwork.plans.registry import Registry
from kilnwork.sources.staging import stage
from kilnwork.sources.tables import table

SHARED = 5
CLUSTERS = 5
_E = f"""ub AS (SELECT DISTINCT user_id u, business_id b FROM ub_sample_data WHERE user_id <> '' AND business_id <> ''),
e AS (SELECT x.u a, y.u b, count(*) n FROM ub x JOIN ub y ON x.b = y.b AND x.u < y.u GROUP BY 1, 2 HAVING count(*) >= {SHARED}),
arc AS (SELECT a src, b dst FROM e UNION ALL SELECT b, a FROM e)"""
_CC = _E + """, reach(id, r) AS (SELECT DISTINCT src, src FROM arc UNION SELECT dst, r FROM reach JOIN arc ON src = id),
cc AS (SELECT id, min(r) component FROM reach GROUP BY 1)"""
_BFS = _E + """, bfs(root, id, dist) AS (SELECT DISTINCT src, src, 0 FROM arc UNION
SELECT root, dst, dist + 1 FROM bfs JOIN arc ON src = id WHERE dist < 60 AND NOT EXISTS (SELECT 1 FROM recurring.bfs o WHERE o.root = bfs.root AND o.id = dst)),
lv AS (SELECT root, id, min(dist) dist FROM bfs GROUP BY 1, 2)"""
_LV = _BFS.replace(" AND NOT EXISTS (SELECT 1 FROM recurring.bfs o WHERE o.root = bfs.root AND o.id = dst)", "").replace("dist < 60", "dist < (SELECT count(DISTINCT src) FROM arc)")
_LPA = _E + ", l0 AS (SELECT DISTINCT src id, src label FROM arc)" + "".join(
    f""", v{i} AS (SELECT src, label, count(*) n FROM arc JOIN l{i} ON id = dst GROUP BY 1, 2),
l{i + 1} AS (SELECT src id, min(label) label FROM v{i} WHERE (src, n) IN (SELECT (src, max(n)) FROM v{i} GROUP BY src) GROUP BY 1)"""
    for i in range(5)
)
_PT = "pt AS (SELECT vec_id id, label, embedding::DOUBLE[] x FROM embeddings)"
_DIST = "list_distance({}, {})"
_KM = "WITH " + _PT + f", c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY md5(id::VARCHAR || ':2021'), id) - 1)::INTEGER cluster, x c FROM (SELECT * FROM pt ORDER BY md5(id::VARCHAR || ':2021'), id LIMIT {CLUSTERS}))"
_ASSIGN = ", a{0} AS MATERIALIZED (SELECT id, x, arg_min(cluster, (round(list_distance(x, c), 9), cluster)) cluster FROM pt CROSS JOIN c{0} GROUP BY 1, 2)"
_NEXT = """, c{1} AS MATERIALIZED (SELECT c{0}.cluster, coalesce(n, c{0}.c) c FROM c{0} LEFT JOIN (SELECT cluster, list(v ORDER BY dim) n FROM
(SELECT cluster, dim, avg(v) v FROM (SELECT cluster, unnest(x) v, generate_subscripts(x, 1) dim FROM a{0}) GROUP BY 1, 2) GROUP BY 1) USING (cluster))"""
ROUNDS = 10
_M = ", m AS (SELECT label cluster, dim - 1 dim, count(*) n, sum(v) total, sum(v * v) squares FROM (SELECT label, unnest(x) v, generate_subscripts(x, 1) dim FROM pt) GROUP BY 1, 2)"


def _edges(s, d):
    rows = baskets(table(s, d, "ub_sample_data"), 1)
    return stage(held_common_counts(rows, "item", "basket", SHARED), "edges")


def _points(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), F.col("label").alias("cluster"))


def register(out: Registry) -> None:
    q = out.add

    @q("cooccurrence_edges", "WITH " + _E + " SELECT a, b, n FROM e")
    def _(s, d):
        return _edges(s, d)

    @q("graph_degrees", "WITH " + _E + " SELECT src id, count(*) degree FROM arc GROUP BY 1")
    def _(s, d):
        return G.degrees(_edges(s, d))

    @q("label_propagation", "WITH " + _LPA + " SELECT label, count(*) size, string_agg(id, ' ' ORDER BY id) members FROM l5 GROUP BY 1")
    def _(s, d):
        return G.communities(G.label_propagation(_edges(s, d)))

    @q("connected_components", "WITH RECURSIVE " + _CC + " SELECT id, component FROM cc")
    def _(s, d):
        return G.connected_components(_edges(s, d))

    @q("components_by_size", "WITH RECURSIVE " + _CC + " SELECT component, count(*) size, (row_number() OVER (PARTITION BY count(*) ORDER BY component))::INTEGER place FROM cc GROUP BY 1")
    def _(s, d):
        return G.sized(G.connected_components(_edges(s, d)))

    @q("bfs_levels", "WITH RECURSIVE " + _LV + " SELECT root, id, dist FROM lv")
    def _(s, d):
        return G.levels(_edges(s, d)).select("root", "id", "dist")

    @q(
        "modularity",
        "WITH RECURSIVE " + _CC + """, dg AS (SELECT src id, count(*) k FROM arc GROUP BY 1), m AS (SELECT 2 * count(*) m2 FROM e),
        l AS (SELECT p.component, count(*) inn FROM e JOIN cc p ON p.id = a JOIN cc q ON q.id = e.b AND p.component = q.component GROUP BY 1),
        k AS (SELECT component, sum(k) ends FROM dg JOIN cc USING (id) GROUP BY 1)
        SELECT round(sum(2 * coalesce(inn, 0) / m2 - (ends / m2) * (ends / m2)), 6) modularity FROM k LEFT JOIN l USING (component) CROSS JOIN m""",
    )
    def _(s, d):
        edges = _edges(s, d)
        return G.modularity(edges, G.connected_components(edges))

    # numbers of shortest paths by level from every root; an edge on a level's way down carries what the nodes below it hand up
    brandes = _LV + """, p(root, id, dist, paths) AS (SELECT root, id, dist, 1::DOUBLE FROM lv WHERE dist = 0
        UNION ALL SELECT * FROM (SELECT l.root, l.id, l.dist, sum(p.paths) OVER (PARTITION BY l.root, l.id) paths FROM p JOIN arc ON arc.src = p.id JOIN lv l ON l.root = p.root AND l.id = arc.dst AND l.dist = p.dist + 1
        QUALIFY row_number() OVER (PARTITION BY l.root, l.id) = 1)),
        down AS (SELECT x.root, x.id up, y.id low, y.dist, x.paths / y.paths share FROM p x JOIN arc ON src = x.id JOIN p y ON y.root = x.root AND y.id = dst AND y.dist = x.dist + 1),
        way(root, up, low, low0, flow) AS (SELECT root, up, low, low, share FROM down UNION ALL
        SELECT * FROM (SELECT w.root, d.up, d.low, w.low0, sum(w.flow) OVER (PARTITION BY w.root, d.up, d.low, w.low0) * d.share flow FROM way w JOIN down d ON d.root = w.root AND d.low = w.up
        QUALIFY row_number() OVER (PARTITION BY w.root, d.up, d.low, w.low0) = 1))
        SELECT least(up, low) a, greatest(up, low) b, round(sum(flow) / 2, 6) betweenness FROM way GROUP BY 1, 2"""

    @q("edge_betweenness", "WITH RECURSIVE " + brandes)
    def _(s, d):
        return G.ranked_edges(G.betweenness(_edges(s, d)).withColumn("betweenness", F.round("betweenness", 6)))

    @q("girvan_newman")
    def _(s, d):
        return G.sized(G.girvan_newman(_edges(s, d)))

    @q("vector_distance", "WITH " + _PT + """, ce AS (SELECT label, list(v ORDER BY dim) c FROM (SELECT label, dim, avg(v) v FROM (SELECT label, unnest(x) v, generate_subscripts(x, 1) dim FROM pt) GROUP BY 1, 2) GROUP BY 1)
        SELECT id vec_id, round(list_distance(x, c), 4) dist FROM pt JOIN ce USING (label)""")
    def _(s, d):
        points = _points(s, d)
        centers = K.summaries(points).select("cluster", "center")
        return points.join(F.broadcast(centers), "cluster").select(F.col("id").alias("vec_id"), F.round(K.distance(F.col("features"), F.col("center")), 4).alias("dist"))  # a row a label

    @q("kmeans_assign", _KM + "".join(_ASSIGN.format(i) + _NEXT.format(i, i + 1) for i in range(ROUNDS)) + _ASSIGN.format(ROUNDS) + f" SELECT id vec_id, cluster FROM a{ROUNDS}")
    def _(s, d):
        return K.kmeans(_points(s, d).drop("cluster"), CLUSTERS, ROUNDS, 0.0).select(F.col("id").alias("vec_id"), "cluster")

    @q("cluster_moments", "WITH " + _PT + _M + " SELECT cluster, dim::INTEGER dim, n, round(total, 4) total, round(squares, 4) squares FROM m")
    def _(s, d):
        return K.moments(_points(s, d)).select("cluster", "dim", "n", F.round("total", 4).alias("total"), F.round("squares", 4).alias("squares"))

    @q(
        "mahalanobis_assign",
        "WITH " + _PT + _M + """, z AS (SELECT cluster, list(total / n ORDER BY dim) c, list(greatest(squares / n - (total / n) * (total / n), 1e-9) ORDER BY dim) v FROM m GROUP BY 1),
        y AS (SELECT id, cluster, sqrt(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]) / v[i]))) dist, sqrt(len(x)) root FROM pt CROSS JOIN z)
        SELECT id vec_id, CASE WHEN min(dist) < 1.0 * any_value(root) THEN arg_min(cluster, dist) ELSE -1 END cluster FROM y GROUP BY 1""",
    )
    def _(s, d):
        points = _points(s, d)
        return K.admit(points.drop("cluster"), K.summaries(points), 1.0).select(F.col("id").alias("vec_id"), F.coalesce("cluster", F.lit(-1)).alias("cluster"))

    @q("bfr_points", "WITH " + _PT + ", k AS (SELECT id % 5 chunk, count(*) n FROM pt GROUP BY 1) SELECT (row_number() OVER (ORDER BY chunk))::INTEGER round_id, (sum(n) OVER (ORDER BY chunk))::BIGINT points FROM k")
    def _(s, d):
        """Of each round: the points in all three sets together, which must be those seen."""
        points = _points(s, d).drop("cluster").withColumn("chunk", F.col("id") % 5)
        rounds = K.chunked_clusters(points, "chunk", CLUSTERS)[0]
        return rounds.select("round_id", (F.col("nof_point_discard") + F.col("nof_point_compression") + F.col("nof_point_retained")).alias("points"))

    @q("bfr_rounds")
    def _(s, d):
        points = _points(s, d).drop("cluster").withColumn("chunk", F.col("id") % 5)
        return K.chunked_clusters(points, "chunk", CLUSTERS)[0]

    @q("bfr_clusters")
    def _(s, d):
        points = _points(s, d).drop("cluster").withColumn("chunk", F.col("id") % 5)
        return K.chunked_clusters(points, "chunk", CLUSTERS)[1].select(F.col("id").alias("vec_id"), "cluster")
