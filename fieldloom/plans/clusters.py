"""Queries on clusterings of the canopy's features and on their quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from fieldloom.operators import clustering as C
from fieldloom.operators import metrics as Q
from fieldloom.operators import morphology as M
from fieldloom.operators import seeding as S
from fieldloom.operators import zones as Z
from fieldloom.plans.rasters import pixels, rounded, zoned
from fieldloom.plans.registry import query
from fieldloom.session import stored
from fieldloom.sources.raster import hash_order

K = 3
_N = list(Z.NAMES)


def points(spark, sf_dir):
    """Scaled features of the canopy, rounded so that every engine clusters the same numbers; stored, as fits read them again and again."""
    return stored(rounded(Z.min_max(Z.features(Z.canopy(pixels(spark, sf_dir)))), *Z.NAMES, places=9))


def hard(spark, sf_dir):
    """The points labelled by threshold zone, for metrics of given labels."""
    labelled = zoned(spark, sf_dir).filter("zone > 0").select("row", "col", (F.col("zone") - 1).alias("label"))
    return points(spark, sf_dir).join(labelled, ["row", "col"])


_PT = " pt AS (SELECT \"row\", col, zone, ndre, " + ", ".join(f"round(coalesce(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0), 9) AS f{i + 1}" for i, c in enumerate(("ndre", "ndvi", "nir", "r", "nir"))) + " FROM z WHERE ndre > 0.1)"
_D = lambda p, c: " + ".join(f"({p}.{f} - {c}.{f}) * ({p}.{f} - {c}.{f})" for f in _N)
_C0 = " c0 AS (SELECT i AS label, " + ", ".join(f"round(quantile_cont({f}, [{', '.join(str((i + 0.5) / K) for i in range(K))}])[i + 1], 8) AS {f}" for f in _N) + f" FROM pt, (SELECT unnest(range({K})) i) GROUP BY i)"


#: The state of an iteration is one row: f1_0 is centre 0's first feature.
_WIDE = [(f, i) for i in range(K) for f in _N]
_START = ", ".join(f"max({f}) FILTER (label = {i}) AS {f}_{i}" for f, i in _WIDE)
_APARTS = ", ".join("(" + " + ".join(f"({f} - {f}_{i}) * ({f} - {f}_{i})" for f in _N) + f") AS d{i}" for i in range(K))
_HELD = ", ".join(f"any_value({f}_{i}) AS o{f}_{i}" for f, i in _WIDE)
_NARROW = " UNION ALL ".join(f"SELECT {i} AS label, " + ", ".join(f"{f}_{i} AS {f}" for f in _N) + " FROM last_step" for i in range(K))


def _steps(means: str, move: str, go_on: str) -> str:
    """Recursive steps from c0 till `go_on` fails, then the last centres as cf and all points' squared distances as ef."""
    news = ", ".join(f"{f}_{i}" for f, i in _WIDE)
    near = f'SELECT "row", col, {", ".join(_N)}, {_APARTS}'
    return f"""{_PT},{_C0}, tol AS (SELECT 1e-4 * ({" + ".join(f"var_pop({f})" for f in _N)}) / {len(_N)} AS enough FROM pt),
 steps AS (SELECT 0 AS step, 1e9 AS move, enough, {_START} FROM c0, tol GROUP BY enough
 UNION ALL SELECT step + 1, {move}, enough, {news} FROM (SELECT step, enough, {means}, {_HELD} FROM (SELECT step, enough, {", ".join(f"{f}_{i}" for f, i in _WIDE)}, {near.removeprefix("SELECT ")} FROM pt, steps WHERE {go_on}) GROUP BY step, enough)),
 last_step AS (SELECT * FROM steps ORDER BY step DESC LIMIT 1), cf AS ({_NARROW}), ef AS ({near} FROM pt, last_step)"""


_LABEL = "CASE WHEN " + " WHEN ".join(" AND ".join(f"d{i} <= d{j}" for j in range(K) if j != i) + f" THEN {i}" for i in range(K)) + " END"
_LLOYD = _steps(
    ", ".join(f"coalesce(round(avg({f}) FILTER (({_LABEL}) = {i}), 8), any_value({f}_{i})) AS {f}_{i}" for f, i in _WIDE),
    " + ".join(f"({f}_{i} - o{f}_{i}) ** 2" for f, i in _WIDE),
    "move > enough AND step < 300",
) + f', lab AS (SELECT "row", col, {_LABEL} AS label, least({", ".join(f"d{i}" for i in range(K))}) AS d2 FROM ef)'


@query("SELECT CAST(label AS INT) AS label, " + ", ".join(f"round({f}, 6) AS {f}" for f in _N) + " FROM cf", _LLOYD, True)
def lloyd_centroids(spark, sf_dir):
    c = C.lloyd(points(spark, sf_dir), K)
    return rounded(spark.createDataFrame([(i, *x) for i, x in enumerate(c)], "label int, " + ", ".join(f"{f} double" for f in _N)), *_N)


@query('SELECT "row", col, CAST(label AS INT) AS label FROM lab', _LLOYD, True)
def nearest_centroid_labels(spark, sf_dir):
    p = points(spark, sf_dir)
    return C.nearest_centre(p, C.lloyd(p, K)).select("row", "col", "label")


@query("SELECT round(sum(d2), 6) AS inertia FROM lab", _LLOYD, True)
def inertia(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(Q.inertia(p, C.lloyd(p, K)), "inertia")


@query('SELECT label, row_number() OVER (ORDER BY avg(ndre), label) AS zone FROM (SELECT CAST(col % 4 AS INT) AS label, ndre FROM f WHERE ndre > 0.1) GROUP BY label')
def zone_order(spark, sf_dir):
    return Z.order_labels(Z.canopy(pixels(spark, sf_dir)).withColumn("label", (F.col("col") % 4).cast("int"))).withColumn("zone", F.col("zone").cast("long"))


@query("""SELECT "row", col, CAST(coalesce(m.zone, 1) AS INT) AS zone FROM (SELECT "row", col, CAST(col % 4 AS INT) label, ndre FROM f WHERE ndre > 0.1) p
 LEFT JOIN (SELECT label, row_number() OVER (ORDER BY avg(ndre), label) zone FROM (SELECT CAST(col % 4 AS INT) AS label, ndre FROM f WHERE ndre > 0.1 AND col % 4 <> 2) GROUP BY label) m USING (label)""")
def zones_with_default(spark, sf_dir):
    p = Z.canopy(pixels(spark, sf_dir)).withColumn("label", (F.col("col") % 4).cast("int"))
    return Z.map_labels(p, Z.order_labels(p.filter("label <> 2"))).select("row", "col", "zone")


_VAR = " + ".join(f"var_pop({f})" for f in _N)
_LB = " hd AS (SELECT *, zone - 1 label FROM pt), mo AS (SELECT label, count(*) n, " + ", ".join(f"avg({f}) m_{f}, var_pop({f}) v_{f}" for f in _N) + " FROM hd GROUP BY label)"
_VSUM = " + ".join(f"v_{f}" for f in _N)


@query(f"SELECT round((1 - (SELECT sum(n * ({_VSUM})) FROM mo) / count(*) / ({_VAR})) * 100, 6) AS vri FROM pt", f"{_PT},{_LB}")
def variance_reduction(spark, sf_dir):
    return rounded(Q.variance_reduction(hard(spark, sf_dir)), "vri")


@query("SELECT round(sum(n * (" + " + ".join(f"(m_{f} - g_{f}) ** 2" for f in _N) + f")) / (count(*) - 1) / (sum(n * ({_VSUM})) / (max(tot) - count(*))), 4) AS ch FROM mo, (SELECT count(*) tot, " + ", ".join(f"avg({f}) g_{f}" for f in _N) + " FROM pt)", f"{_PT},{_LB}")
def calinski_harabasz(spark, sf_dir):
    return rounded(Q.calinski_harabasz(hard(spark, sf_dir)), "ch", places=4)


_DB = " sp AS (SELECT hd.label, avg(sqrt(" + " + ".join(f"(hd.{f} - m_{f}) ** 2" for f in _N) + ")) s, " + ", ".join(f"any_value(m_{f}) m_{f}" for f in _N) + " FROM hd JOIN mo ON mo.label = hd.label GROUP BY hd.label)"


@query("SELECT round(avg(r), 6) AS db FROM (SELECT a.label, max((a.s + b.s) / sqrt(" + " + ".join(f"(a.m_{f} - b.m_{f}) ** 2" for f in _N) + ")) r FROM sp a JOIN sp b ON a.label <> b.label GROUP BY a.label)", f"{_PT},{_LB},{_DB}")
def davies_bouldin(spark, sf_dir):
    return rounded(Q.davies_bouldin(hard(spark, sf_dir)), "db")


@query("""SELECT round(avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette, count(*) AS n FROM (SELECT i, max(own_n) n, max(CASE WHEN own THEN total / greatest(own_n - 1, 1) END) a, min(CASE WHEN NOT own THEN total / cnt END) b FROM
 (SELECT x.i, x.label = y.label own, y.label, sum(sqrt(""" + _D("x", "y") + """)) total, count(*) cnt, CASE WHEN x.label = y.label THEN count(*) END own_n FROM sm x, sm y GROUP BY x.i, x.label, y.label) GROUP BY i)""",
       f"""{_PT},{_LB}, sm AS (SELECT *, row_number() OVER () i FROM (SELECT * FROM hd ORDER BY md5(CAST("row" AS VARCHAR) || ',' || CAST(col AS VARCHAR)), "row", col LIMIT 5000))""")
def silhouette_sample(spark, sf_dir):
    return rounded(Q.silhouette(hard(spark, sf_dir), 5000), "silhouette")


@query("SELECT round(min(n) / max(n), 6) AS balance, round(-sum(p * log2(p + 1e-12)), 6) AS entropy FROM (SELECT n, n / sum(n) OVER () p FROM (SELECT count(*) n FROM z WHERE zone > 0 GROUP BY zone))")
def zone_balance_entropy(spark, sf_dir):
    return rounded(Q.balance(zoned(spark, sf_dir), 3), "balance", "entropy")


def _both_ways() -> str:
    from fieldloom.plans.rasters import _ZONE_CELLS, _components

    eight = _components(_ZONE_CELLS, 1)
    four = _components(_ZONE_CELLS, 0)
    for name in ("cells", "isl", "rn", "ed", "re", "comp", "cs"):
        import re

        four = re.sub(rf"\b{name}\b", f"{name}4", four)
    return f"{eight},{four}"


@query("SELECT round((SELECT avg(v) FROM (SELECT count(*) / sum(size) v FROM cs GROUP BY grp)), 9) AS per_zone, round((SELECT 1000 * count(*) / sum(size) FROM cs4), 9) AS per_1000", _both_ways(), True)
def fragmentation(spark, sf_dir):
    return rounded(Q.fragmentation(zoned(spark, sf_dir)), "per_zone", "per_1000", places=9)


@query('SELECT round(count(*) FILTER (n = 9) / count(*), 9) AS smoothness FROM (SELECT p."row", p.col, count(*) n FROM z p JOIN z q ON q.zone = p.zone AND q."row" BETWEEN p."row" - 1 AND p."row" + 1 AND q.col BETWEEN p.col - 1 AND p.col + 1 WHERE p.zone > 0 GROUP BY 1, 2)')
def smoothness(spark, sf_dir):
    return rounded(Q.smoothness(zoned(spark, sf_dir)), "smoothness", places=9)


@query()
def compactness(spark, sf_dir):
    return Q.compactness(zoned(spark, sf_dir))


_SHARE = [f"(1.0 / d{i}) / ({' + '.join(f'1.0 / d{j}' for j in range(K))})" for i in range(K)]
_FUZZY = _steps(
    ", ".join(f"round(sum(({_SHARE[i]}) * ({_SHARE[i]}) * {f}) / sum(({_SHARE[i]}) * ({_SHARE[i]})), 8) AS {f}_{i}" for f, i in _WIDE),
    "greatest(" + ", ".join(f"abs({f}_{i} - o{f}_{i})" for f, i in _WIDE) + ")",
    "move >= 0.005 AND step < 100",
) + ", uf AS (SELECT *, " + ", ".join(f"{_SHARE[i]} AS u{i}" for i in range(K)) + " FROM ef)"


def fuzzy(spark, sf_dir):
    p = points(spark, sf_dir)
    centres, _ = C.fuzzy_means(p, K)
    return C.memberships(p, centres), centres


@query('SELECT "row", col, round(u0, 6) AS u0, round(u1, 6) AS u1, round(u2, 6) AS u2 FROM uf', _FUZZY, True)
def fuzzy_memberships(spark, sf_dir):
    u, _ = fuzzy(spark, sf_dir)
    return u.select("row", "col", *[F.round(F.col("u")[i], 6).alias(f"u{i}") for i in range(K)])


_APART = "(SELECT min(" + _D("a", "b") + ") FROM cf a JOIN cf b ON a.label < b.label)"


@query(f"""SELECT round(avg(u0*u0+u1*u1+u2*u2), 6) AS pc, round(avg(-(u0*ln(u0+1e-12)+u1*ln(u1+1e-12)+u2*ln(u2+1e-12))), 6) AS pe, round(avg(u0*u0*d0+u1*u1*d1+u2*u2*d2) / ({_APART} + 1e-12), 6) AS xb,
 round(avg(1 - t), 6) AS uncertainty, round(100 * avg(CAST(1 - t > 0.35 AS INT)), 6) AS pct_uncertain, round(100 * avg(CAST(s > 0.30 AS INT)), 6) AS pct_transition, round(100 * avg(CAST(t > 0.70 AS INT)), 6) AS pct_crisp
 FROM (SELECT *, greatest(u0, u1, u2) t, list_sort([u0, u1, u2])[2] s FROM uf)""", _FUZZY, True)
def fuzzy_indices(spark, sf_dir):
    u, centres = fuzzy(spark, sf_dir)
    t = Q.fuzzy_indices(u, centres)
    return rounded(t, *t.columns)


_SOFT = " UNION ALL ".join(f"SELECT {i + 1} AS zone, '{f}' AS feature, round(sum(u{i}*{f})/sum(u{i}), 6) AS mean, round(sqrt(greatest(sum(u{i}*{f}*{f})/sum(u{i}) - (sum(u{i}*{f})/sum(u{i})) ** 2, 0)), 6) AS std FROM uf" for i in range(K) for f in _N)


@query(_SOFT, _FUZZY, True)
def soft_zone_stats(spark, sf_dir):
    return rounded(Q.soft_zone_stats(fuzzy(spark, sf_dir)[0]), "mean", "std")


@query("SELECT CAST(label AS INT) AS label, count(*) AS n, " + ", ".join(f"round(avg({f}), 6) AS mean_{f}, round(stddev_pop({f}), 6) AS std_{f}" for f in _N) + " FROM hd GROUP BY label", f"{_PT},{_LB}")
def hard_zone_stats(spark, sf_dir):
    t = Q.hard_zone_stats(hard(spark, sf_dir))
    return rounded(t, *[c for c in t.columns if c not in ("label", "n")])


@query('SELECT "row", col FROM uf WHERE list_sort([u0, u1, u2])[2] > 0.30', _FUZZY, True)
def transition_pixels(spark, sf_dir):
    return fuzzy(spark, sf_dir)[0].filter(F.element_at(F.array_sort("u"), -2) > 0.30).select("row", "col")


@query('SELECT "row", col, round(u1 + 0.5 * u2, 6) AS x, round(u2 * 0.8660254037844386, 6) AS y FROM uf', _FUZZY, True)
def ternary_projection(spark, sf_dir):
    u = F.col("u")
    return fuzzy(spark, sf_dir)[0].select("row", "col", F.round(u[1] + 0.5 * u[2], 6).alias("x"), F.round(u[2] * 0.8660254037844386, 6).alias("y"))


@query('SELECT CAST("row" / 10 AS INT) AS "row", CAST(col / 10 AS INT) AS col, round(1 - greatest(u0, u1, u2), 6) AS uncertainty FROM uf WHERE "row" % 10 = 0 AND col % 10 = 0', _FUZZY, True)
def uncertainty_map(spark, sf_dir):
    from fieldloom.sources.raster import decimate_nearest

    return decimate_nearest(fuzzy(spark, sf_dir)[0], 10).select("row", "col", F.round(1 - F.array_max("u"), 6).alias("uncertainty"))


def soil_samples(spark, sf_dir, n: int = 30):
    """Points spread over the most uncertain quarter of the canopy."""
    u = fuzzy(spark, sf_dir)[0].withColumn("uncertainty", F.round(1 - F.array_max("u"), 9))
    return C.farthest_points(Z.percentile_target(u, "uncertainty", 0.75), "col", "row", n)


@query()
def soil_sampling_points(spark, sf_dir):
    return soil_samples(spark, sf_dir)


@query()
def soil_sample_zones(spark, sf_dir):
    met = soil_samples(spark, sf_dir).join(zoned(spark, sf_dir).select("row", "col", "zone"), ["row", "col"])
    return Z.histogram(met, 3)


@query()
def fuzziness_sweep(spark, sf_dir):
    p, out = points(spark, sf_dir), []
    for m in (1.5, 2.0, 2.5, 3.0):
        centres, steps = C.fuzzy_means(p, K, m, 100)
        u = C.memberships(p, centres, m)
        labelled = u.withColumn("label", (F.array_position("u", F.array_max("u")) - 1).cast("int"))
        one = Q.fuzzy_indices(u, centres).crossJoin(Q.silhouette(labelled).drop("n"))  # one row each
        out.append(one.withColumn("m", F.lit(m)).withColumn("iterations", F.lit(steps)))
    return reduce(lambda a, b: a.unionByName(b), out)


@query()
def k_sweep(spark, sf_dir):
    p, out = points(spark, sf_dir), []
    for k, found in S.sweep_restarts(p, list(range(2, 7))).items():
        centres = S.least_inertia(*found)
        labelled = C.nearest_centre(p, centres)
        one = Q.inertia(p, centres).crossJoin(Q.calinski_harabasz(labelled)).crossJoin(Q.davies_bouldin(labelled)).crossJoin(Q.silhouette(labelled).drop("n"))  # one row each
        out.append(one.withColumn("k", F.lit(k)))
    return reduce(lambda a, b: a.unionByName(b), out)


@query()
def kmeans_restarts(spark, sf_dir):
    """Ten starts of K-means from parallel seeds, run to convergence, and the one kept."""
    report = S.restarts(points(spark, sf_dir), K)[1]
    report["best"] = report.index == report["inertia"].to_numpy().argmin()
    return spark.createDataFrame(report, "start int, iterations int, inertia double, converged boolean, best boolean")


def _quality(labelled, name):
    one = Q.silhouette(labelled).drop("n").crossJoin(Q.davies_bouldin(labelled)).crossJoin(Q.calinski_harabasz(labelled)).crossJoin(Q.variance_reduction(labelled))  # one row each
    sizes = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg((F.min("n") / F.max("n")).alias("balance"))
    return one.crossJoin(sizes).withColumn("method", F.lit(name))


@query()
def clustering_quality(spark, sf_dir):
    """One row for each of the six methods."""
    # labels are stored, as each measure reads them again and a label's own expression is too long to be compiled into most of them
    return reduce(lambda a, b: a.unionByName(b), [_quality(stored(t), n) for n, t in C.fit_all(points(spark, sf_dir), K).items()])


@query()
def method_zones(spark, sf_dir):
    """Zone sizes and mean index of each method's zones, ordered by the index."""
    out = []
    for name, t in C.fit_all(points(spark, sf_dir), K).items():
        z = Z.map_labels(t, Z.order_labels(t, "f1"), None)
        out.append(z.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.avg("f1").alias("mean_index")).withColumn("method", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b), out)


def _spatial(zone_map, name):
    parts = stored(Q.zone_parts(zone_map))
    return Q.balance(zone_map, 3).crossJoin(Q.fragmentation(zone_map, parts)).crossJoin(Q.smoothness(zone_map)).crossJoin(Q.compactness(zone_map, parts)).withColumn("stage", F.lit(name))  # one row each


@query()
def spatial_quality(spark, sf_dir):
    """Spatial measures of the zone map before and after islands are smoothed away."""
    z = stored(zoned(spark, sf_dir).select("row", "col", "zone"))
    return _spatial(z, "raw").unionByName(_spatial(stored(M.smooth_zones(z, 12)), "smoothed"))


@query()
def smoothing_effect(spark, sf_dir):
    """Variance reduction before and after smoothing, and its drop in points."""
    p = points(spark, sf_dir)
    raw = Q.variance_reduction(hard(spark, sf_dir)).withColumnRenamed("vri", "raw")
    z = M.smooth_zones(zoned(spark, sf_dir).select("row", "col", "zone"), 12).filter("zone > 0").select("row", "col", (F.col("zone") - 1).alias("label"))
    after = Q.variance_reduction(p.join(z, ["row", "col"])).withColumnRenamed("vri", "smoothed")
    return raw.crossJoin(after).select(F.round("raw", 2).alias("raw"), F.round("smoothed", 2).alias("smoothed"), F.round(F.col("raw") - F.col("smoothed"), 2).alias("drop"))  # one row each


@query("SELECT CAST(i AS INT) AS id, " + ", ".join(f"round({f}, 6) AS {f}" for f in _N) + " FROM (SELECT *, row_number() OVER (ORDER BY f1) i FROM cf)", _FUZZY, True)
def centre_profile(spark, sf_dir):
    c = C.by_first(fuzzy(spark, sf_dir)[1])
    return rounded(spark.createDataFrame([(i + 1, *x) for i, x in enumerate(c)], "id int, " + ", ".join(f"{f} double" for f in _N)), *_N)


@query("""SELECT metric, arg_max(method, CASE WHEN metric IN ('db', 'inertia') THEN -value ELSE value END) AS best FROM (SELECT 'm' || (col % 3) AS method, avg(ndre) AS vri, avg(ndvi) AS ch, stddev_pop(nir) AS db FROM f GROUP BY 1) UNPIVOT (value FOR metric IN (vri, ch, db)) GROUP BY metric""")
def best_per_metric(spark, sf_dir):
    """The best method of each metric, by its direction."""
    t = pixels(spark, sf_dir).groupBy(F.concat(F.lit("m"), (F.col("col") % 3).cast("string")).alias("method")).agg(F.avg("ndre").alias("vri"), F.avg("ndvi").alias("ch"), F.stddev_pop("nir").alias("db"))
    long = t.unpivot("method", ["vri", "ch", "db"], "metric", "value")
    return long.groupBy("metric").agg(F.max_by("method", F.when(F.col("metric").isin("db", "inertia"), -F.col("value")).otherwise(F.col("value"))).alias("best"))


@query("""SELECT "row", col FROM f WHERE ndre > 0.1 ORDER BY md5(CAST("row" AS VARCHAR) || ',' || CAST(col AS VARCHAR)), "row", col LIMIT 30000""")
def random_sample(spark, sf_dir):
    return Z.canopy(pixels(spark, sf_dir)).orderBy(hash_order(), "row", "col").limit(30_000).select("row", "col")
