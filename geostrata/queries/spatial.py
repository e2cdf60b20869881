"""Grids, neighbours, weights, autocorrelation and rings."""

from pyspark.sql import functions as F

from geostrata.functions.columns import correlation, haversine_km, hex_cell, hex_center, hex_ring_cells, ring_weight, square_cell
from geostrata.operators import evaluate as E
from geostrata.operators import moran as M
from geostrata.operators import rings as G
from geostrata.operators import weights as W
from geostrata.operators.distance import knn_edges
from geostrata.queries.registry import L, R, plain, query, view
from geostrata.queries.sqltext import bijected, FIRST_EXPOSURE, HEX_DISK, PAIRS, RING_W, haversine, hex_axial, hex_cell as hex_sql, hex_disk


@query("haversine", f"SELECT {L('id')} AS id, {R(haversine('lat', 'lng', '36.25', '-99.75'))} AS km FROM fx_points")
def haversine_query(spark, sf):
    return plain(view(spark, sf, "fx_points").select("id", haversine_km("lat", "lng", F.lit(36.25), F.lit(-99.75)).alias("km")))


@query("grid_cell", f"SELECT {L('id')} AS id, {hex_sql(resolution=8)} AS cell FROM fx_points")
def grid_cell(spark, sf):
    return plain(view(spark, sf, "fx_points").select("id", hex_cell("lat", "lng", 8).alias("cell")))


_q, _r = hex_axial("lat", "lng", 8)
CENTRES = f"""hx AS (SELECT id, value, CAST({_q} AS BIGINT) AS q, CAST({_r} AS BIGINT) AS r FROM fx_points),
cl AS (SELECT (q + 4194304) * 8388608 + r + 4194304 AS cell, q, r, SUM(value) AS v, COUNT(*) AS n FROM hx GROUP BY q, r),
ce AS (SELECT *, DEGREES(r * 1.5 * 0.531414 / 6371.0088) AS lat, DEGREES((q + r / 2.0) * SQRT(3) * 0.531414 / (6371.0088 * COS(RADIANS(37.0)))) AS lng FROM cl)"""


@query("cell_centroid", f"WITH {CENTRES} SELECT {L('cell')} AS cell, {R('lat')} AS lat, {R('lng')} AS lng FROM ce")
def cell_centroid(spark, sf):
    cells = view(spark, sf, "fx_points").select(hex_cell("lat", "lng", 8).alias("cell")).distinct()
    lat, lng = hex_center("cell", 8)
    return plain(cells.select("cell", lat.alias("lat"), lng.alias("lng")))


def cell_sums(spark, sf):
    """One row per hexagon with the summed value and its centre."""
    cells = view(spark, sf, "fx_points").groupBy(hex_cell("lat", "lng", 8).alias("cell")).agg(F.round(F.sum("value"), 6).alias("value"), F.count("*").alias("n"))
    lat, lng = hex_center("cell", 8)
    return cells.withColumns({"lat": lat, "lng": lng})


@query("cell_agg", f"WITH {CENTRES} SELECT {L('cell')} AS cell, {R('v')} AS value, {L('n')} AS n FROM ce")
def cell_agg(spark, sf):
    return plain(cell_sums(spark, sf).select("cell", "value", "n"))


@query("cell_top", f"WITH {CENTRES} SELECT {L('cell')} AS cell, {R('v')} AS value FROM ce ORDER BY ROUND(v, 6) DESC, cell LIMIT 10")
def cell_top(spark, sf):
    return plain(cell_sums(spark, sf).orderBy(F.col("value").desc(), "cell").limit(10).select("cell", "value"))


@query("k_ring", f"""WITH {CENTRES}, {HEX_DISK} SELECT {L('e.cell + d.o')} AS cell, {L('COUNT(*)')} AS n FROM ce e, disk d GROUP BY 1""")
def k_ring(spark, sf):
    cells = cell_sums(spark, sf).select(F.explode(hex_ring_cells("cell", 5)).alias("cell"))
    return plain(cells.groupBy("cell").agg(F.count("*").alias("n")))


CONTIG = f"""{CENTRES}, {hex_disk(1)}, nb AS (SELECT a.cell AS src, b.cell AS dst FROM ce a JOIN disk d ON d.o <> 0 JOIN ce b ON b.cell = a.cell + d.o)"""


def contiguity(spark, sf):
    return W.contiguity_edges(cell_sums(spark, sf).select("cell"))


@query("nb_contiguity", f"WITH {CONTIG} SELECT {L('src')} AS src, {L('dst')} AS dst FROM nb")
def nb_contiguity(spark, sf):
    return plain(contiguity(spark, sf))


WEIGHTED = f"{CONTIG}, w AS (SELECT src, dst, 1.0 / COUNT(*) OVER (PARTITION BY src) AS w FROM nb)"


@query("weights_row_std", f"WITH {WEIGHTED} SELECT {L('src')} AS src, {L('dst')} AS dst, {R('w')} AS w FROM w")
def weights_row_std(spark, sf):
    return plain(W.row_standardised(contiguity(spark, sf)))


SUMMARY = """SELECT {n} AS n, {mean} AS mean_neighbors, {isl} AS islands, {bad} AS bad_rows FROM (SELECT e.cell, COUNT(w.dst) AS deg, SUM(w.w) AS tot FROM ce e LEFT JOIN w ON w.src = e.cell GROUP BY e.cell)""".format(
    n=L("COUNT(*)"), mean=R("AVG(deg)"), isl=L("SUM(CASE WHEN deg = 0 THEN 1 ELSE 0 END)"), bad=L("SUM(CASE WHEN ABS(tot - 1) > 1e-8 THEN 1 ELSE 0 END)"))


@query("weights_summary", f"WITH {WEIGHTED} {SUMMARY}")
def weights_summary(spark, sf):
    cells = cell_sums(spark, sf)
    return plain(W.weights_summary(cells, W.row_standardised(contiguity(spark, sf)), "cell"))


LAG = f"""{WEIGHTED}, lg AS (SELECT e.cell, ANY_VALUE(e.v) AS x, COALESCE(SUM(w.w * b.v), 0) AS wx FROM ce e LEFT JOIN w ON w.src = e.cell LEFT JOIN ce b ON b.cell = w.dst GROUP BY e.cell),
mo AS (SELECT l.cell, l.x - m.mx AS z FROM lg l, (SELECT AVG(v) AS mx FROM ce) m),
wz AS (SELECT a.cell, ANY_VALUE(a.z) AS z, COALESCE(SUM(w.w * b.z), 0) AS wz FROM mo a LEFT JOIN w ON w.src = a.cell LEFT JOIN mo b ON b.cell = w.dst GROUP BY a.cell)"""


@query("spatial_lag", f"WITH {LAG} SELECT {L('cell')} AS cell, {R('x')} AS value, {R('wx')} AS lag FROM lg")
def spatial_lag(spark, sf):
    w = W.row_standardised(contiguity(spark, sf))
    return plain(W.spatial_lag(cell_sums(spark, sf), w, {"lag": "value"}, "cell").select("cell", "value", "lag"))


@query("moran_global", f"WITH {LAG} SELECT {L('COUNT(*)')} AS n, {R('SUM(z * wz) / SUM(z * z)')} AS moran_i FROM wz")
def moran_global(spark, sf):
    return plain(M.moran(cell_sums(spark, sf), W.row_standardised(contiguity(spark, sf)), "value", "cell"))


QUAD = "CASE WHEN x >= mx AND wx >= mw THEN 'HH' WHEN x < mx AND wx < mw THEN 'LL' WHEN x >= mx THEN 'HL' ELSE 'LH' END"


@query("moran_scatter", f"""WITH {LAG}, m AS (SELECT AVG(x) AS mx, AVG(wx) AS mw FROM lg)
SELECT {QUAD} AS quadrant, {L('COUNT(*)')} AS n, {R('AVG(x)')} AS x, {R('AVG(wx)')} AS wx, {L('SUM(CASE WHEN x > 0 AND wx > 0 THEN 1 ELSE 0 END)')} AS positive FROM lg, m GROUP BY 1""")
def moran_scatter(spark, sf):
    s = M.moran_scatter(cell_sums(spark, sf), W.row_standardised(contiguity(spark, sf)), "value", "cell")
    pos = F.sum(F.when((F.col("x") > 0) & (F.col("wx") > 0), 1).otherwise(0))
    return plain(s.groupBy("quadrant").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("wx").alias("wx"), pos.alias("positive")))


@query("lag_corr", f"WITH {LAG} SELECT {R('CORR(x, wx)')} AS lag_corr FROM lg")
def lag_corr(spark, sf):
    w = W.row_standardised(contiguity(spark, sf))
    return plain(W.spatial_lag(cell_sums(spark, sf), w, {"lag": "value"}, "cell").agg(correlation("value", "lag").alias("lag_corr")))


@query("assert_spatial", f"""WITH {LAG}, s AS ({SUMMARY}) SELECT (SELECT {L('COUNT(*) - COUNT(cell)')} FROM ce) AS null_cells, s.bad_rows, s.islands,
  (SELECT {L('CASE WHEN ABS(SUM(z * wz) / SUM(z * z)) <= 1 THEN 1 ELSE 0 END')} FROM wz) AS moran_in_range FROM s""")
def assert_spatial(spark, sf):
    cells, w = cell_sums(spark, sf), W.row_standardised(contiguity(spark, sf))
    tag = lambda d: d.withColumn("_one", F.lit(1))
    nulls = cells.agg(F.sum(F.when(F.col("cell").isNull(), 1).otherwise(0)).alias("null_cells"))
    ok = M.moran(cells, w, "value", "cell").select((F.abs("moran_i") <= 1).alias("moran_in_range"))
    s = W.weights_summary(cells, w, "cell").select("bad_rows", "islands")
    return plain(tag(nulls).join(tag(s), "_one").join(tag(ok), "_one").drop("_one"))


# --- nearest neighbours ------------------------------------------------------------------------


def _knn_sql(metric, k, src="fx_dim", node="entity", cond="lat IS NOT NULL"):
    if metric == "plane":
        d = "SQRT((a.lng - b.lng) * (a.lng - b.lng) + (a.lat - b.lat) * (a.lat - b.lat))"
    else:
        xyz = lambda t: (f"COS(RADIANS({t}.lat)) * COS(RADIANS({t}.lng))", f"COS(RADIANS({t}.lat)) * SIN(RADIANS({t}.lng))", f"SIN(RADIANS({t}.lat))")
        d = "SQRT(" + " + ".join(f"POW({p} - {q}, 2)" for p, q in zip(xyz("a"), xyz("b"))) + ")"
    return f"""kp AS (SELECT a.{node} AS src, b.{node} AS dst, ROUND({d}, 9) AS d FROM {src} a JOIN {src} b ON a.{node} <> b.{node} WHERE a.{cond} AND b.{cond}),
kn AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY src ORDER BY d, dst) AS rk FROM kp QUALIFY rk <= {k})"""


def located(spark, sf):
    return view(spark, sf, "fx_dim").filter("lat is not null").withColumnRenamed("entity", "id")


@query("nb_knn", f"WITH {_knn_sql('plane', 6)} SELECT {L('src')} AS src, {L('dst')} AS dst, {R('d', 9)} AS d, {L('rk')} AS rank FROM kn")
def nb_knn(spark, sf):
    return plain(knn_edges(located(spark, sf), 6), 9)


@query("nb_knn_sphere", f"WITH {_knn_sql('sphere', 4)} SELECT {L('src')} AS src, {L('dst')} AS dst, {R('d', 9)} AS d, {L('rk')} AS rank FROM kn")
def nb_knn_sphere(spark, sf):
    return plain(knn_edges(located(spark, sf), 4, metric="sphere"), 9)


def _value_nodes(spark, sf):
    return located(spark, sf).withColumn("value", (F.col("last_year") - F.col("first_year")).cast("double") + F.col("lat"))


def _knn_moran(k, value="(last_year - first_year + lat)"):
    return f"""m{k} AS (SELECT SUM(z * wz) / SUM(z * z) AS i, COUNT(*) AS n FROM (SELECT s.entity, ANY_VALUE(s.z) AS z, SUM(t.z) / COUNT(*) AS wz FROM nz s JOIN kn ON kn.src = s.entity AND kn.rk <= {k}
  JOIN nz t ON t.entity = kn.dst GROUP BY s.entity))"""


NZ = "nz AS (SELECT entity, {v} - AVG({v}) OVER () AS z FROM fx_dim WHERE lat IS NOT NULL)"


@query("moran_knn", f"WITH {_knn_sql('plane', 8)}, {NZ.format(v='(last_year - first_year + lat)')}, {_knn_moran(8)} SELECT {L('n')} AS n, {R('i')} AS moran_i FROM m8")
def moran_knn(spark, sf):
    nodes = _value_nodes(spark, sf)
    return plain(M.moran(nodes, W.knn_weights(nodes, 8), "value"))


@query("moran_inference", f"""
WITH {_knn_sql('plane', 6)}, {NZ.format(v='(last_year - first_year + lat)')}, {_knn_moran(6)},
p AS (SELECT LEAST(src, dst) AS a, GREATEST(src, dst) AS b, COUNT(*) / 6.0 AS bw FROM kn GROUP BY 1, 2),
d AS (SELECT id, SUM(c) AS t FROM (SELECT src AS id, 1.0 AS c FROM kn WHERE rk = 1 UNION ALL SELECT dst, 1 / 6.0 FROM kn) GROUP BY id),
c AS (SELECT n * 1.0 AS n, i, n * 1.0 AS s0, (SELECT SUM(bw * bw) FROM p) AS s1, (SELECT SUM(t * t) FROM d) AS s2 FROM m6),
v AS (SELECT *, -1 / (n - 1) AS e, (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - 1 / ((n - 1) * (n - 1)) AS vn FROM c)
SELECT {L('n')} AS n, {R('i')} AS moran_i, {R('e')} AS e_i, {R('vn', 8)} AS var_norm, {R('(i - e) / SQRT(vn)', 5)} AS z_norm FROM v""")
def moran_inference(spark, sf):
    nodes = _value_nodes(spark, sf)
    got = M.moran_inference(nodes, W.knn_weights(nodes, 6), "value")
    out = got.select("n", F.round("moran_i", 6).alias("moran_i"), F.round("e_i", 6).alias("e_i"), F.round("var_norm", 8).alias("var_norm"), F.round("z_norm", 5).alias("z_norm"))
    return plain(out, 8)


_RANKED = "rn AS MATERIALIZED (SELECT entity AS id, ROW_NUMBER() OVER (ORDER BY entity) - 1 AS k, (last_year - first_year + lat) - AVG(last_year - first_year + lat) OVER () AS z FROM fx_dim WHERE lat IS NOT NULL)"


@query("moran_perm", f"""WITH {_knn_sql('plane', 8)}, {_RANKED}, {bijected('rn', 199)},
ed AS MATERIALIZED (SELECT a.k AS s, b.k AS d FROM kn JOIN rn a ON a.id = kn.src JOIN rn b ON b.id = kn.dst),
ir AS (SELECT x.r, SUM(x.z * y.z) / 8 / (SELECT SUM(z * z) FROM rn) AS i FROM ed JOIN sl x ON x.slot = ed.s JOIN sl y ON y.slot = ed.d AND y.r = x.r GROUP BY x.r),
ob AS (SELECT i AS o FROM ir WHERE r = 0)
SELECT (SELECT {L('COUNT(*)')} FROM rn) AS n, {R('o')} AS moran_i, {R('(COUNT(*) FILTER (r > 0 AND i >= o - 1e-12) + 1) / 200.0')} AS p_value, CAST(199 AS BIGINT) AS permutations FROM ir, ob GROUP BY o""")
def moran_perm(spark, sf):
    nodes = _value_nodes(spark, sf)
    return plain(M.moran_permutation(nodes, W.knn_weights(nodes, 8), "value", permutations=199, min_nodes=10))


@query("moran_matrix", f"""
WITH {CENTRES}, {hex_disk(1)}, rw AS (SELECT entity, (last_year - first_year + lat) AS raw, LN(1 + last_year - first_year + lat) AS lg FROM fx_dim WHERE lat IS NOT NULL),
{_knn_sql('plane', 8)}
""" + " UNION ALL ".join(
    f"""SELECT 'knn{k}' AS weights, '{n}' AS scale, {R('SUM(z * wz) / SUM(z * z)')} AS moran_i FROM (SELECT s.entity, ANY_VALUE(s.{c} - (SELECT AVG({c}) FROM rw)) AS z, AVG(t.{c} - (SELECT AVG({c}) FROM rw)) AS wz
    FROM rw s JOIN kn ON kn.src = s.entity AND kn.rk <= {k} JOIN rw t ON t.entity = kn.dst GROUP BY s.entity)""" for k in (4, 8) for n, c in (("raw", "raw"), ("log1p", "lg")))
    + " UNION ALL " + " UNION ALL ".join(f"""SELECT 'contiguity', '{n}', {R('SUM(z * wz) / SUM(z * z)')} FROM (SELECT a.cell, ANY_VALUE({e.format(t='a')} - (SELECT AVG({e.format(t='ce')}) FROM ce)) AS z,
    COALESCE(AVG(CASE WHEN b.cell IS NOT NULL THEN {e.format(t='b')} - (SELECT AVG({e.format(t='ce')}) FROM ce) END), 0) AS wz FROM ce a JOIN disk d ON d.o <> 0 LEFT JOIN ce b ON b.cell = a.cell + d.o GROUP BY a.cell)"""
    for n, e in (("raw", "{t}.v"), ("log1p", "LN(1 + {t}.v)"))))
def moran_matrix(spark, sf):
    nodes = _value_nodes(spark, sf).select("id", "lat", "lng", F.col("value").alias("raw"), F.log1p("value").alias("log1p"))
    cells = cell_sums(spark, sf).select(F.col("cell").alias("id"), F.col("value").alias("raw"), F.log1p("value").alias("log1p"))
    near = knn_edges(nodes, 8)
    sets = [("contiguity", cells, W.row_standardised(contiguity(spark, sf)))]
    sets += [(f"knn{k}", nodes, W.row_standardised(near.filter(F.col("rank") <= k).select("src", "dst"))) for k in (4, 8)]
    out = None
    for name, d, w in sets:
        for scale in ("raw", "log1p"):
            row = M.moran(d, w, scale).select(F.lit(name).alias("weights"), F.lit(scale).alias("scale"), "moran_i")
            out = row if out is None else out.unionByName(row)
    return plain(out)


@query("spatial_robustness", f"""
WITH g AS (SELECT dec, ROUND_EVEN(CASE dec WHEN 2 THEN lat * 100 ELSE lat * 10 END, 0) AS gy, ROUND_EVEN(CASE dec WHEN 2 THEN lng * 100 ELSE lng * 10 END, 0) AS gx, AVG((last_year - first_year) + lat) AS v
  FROM fx_dim, (SELECT UNNEST([1, 2]) AS dec) WHERE lat IS NOT NULL GROUP BY 1, 2, 3),
i AS (SELECT *, (gy + 100000) * 1000000 + gx + 100000 AS id FROM g),
p AS (SELECT a.dec, a.id AS src, b.id AS dst, ROW_NUMBER() OVER (PARTITION BY a.dec, a.id ORDER BY ROUND(SQRT((a.gx - b.gx) * (a.gx - b.gx) + (a.gy - b.gy) * (a.gy - b.gy)), 9), b.id) AS rk FROM i a JOIN i b ON a.dec = b.dec AND a.id <> b.id QUALIFY rk <= 8),
z AS (SELECT dec, id, v - AVG(v) OVER (PARTITION BY dec) AS z FROM i),
w AS (SELECT s.dec, k, s.id, ANY_VALUE(s.z) AS z, AVG(t.z) AS wz FROM z s JOIN (SELECT UNNEST([4, 8]) AS k) ON TRUE JOIN p ON p.dec = s.dec AND p.src = s.id AND p.rk <= k JOIN z t ON t.dec = s.dec AND t.id = p.dst GROUP BY 1, 2, 3),
m AS (SELECT dec, k, SUM(z * wz) / SUM(z * z) AS i FROM w GROUP BY 1, 2)
SELECT {L('dec')} AS decimals, {L('k')} AS k, {R('i')} AS moran_i, (SELECT CASE WHEN MAX(i) > 0 AND MIN(i) < 0 THEN 'danger' WHEN MAX(i) - MIN(i) > 0.1 THEN 'warn' ELSE 'ok' END FROM m) AS level FROM m""")
def spatial_robustness(spark, sf):
    return plain(M.robustness(_value_nodes(spark, sf), "lat", "lng", "value"))


# --- rings -------------------------------------------------------------------------------------

EXPOSE = f"""pe AS (SELECT e.entity, e.acq_year, {haversine('e.lat', 'e.lng', 'b.lat', 'b.lng')} AS d FROM fx_dim e JOIN fx_dim b ON b.class = e.class AND b.entity <> e.entity
  WHERE e.acq_year IS NOT NULL AND e.lat IS NOT NULL AND b.lat IS NOT NULL),
xp AS (SELECT f.entity, f.acq_year, SUM(CASE WHEN d < 10 THEN 1 ELSE 0 END) AS n10, {', '.join(f'SUM(CASE WHEN d >= {a} AND d < {b} THEN 1 ELSE 0 END) AS r{a}_{b}' for a, b in ((0, 1), (1, 3), (3, 5), (5, 10), (0, 2), (2, 5)))}
  FROM fx_dim f LEFT JOIN pe ON pe.entity = f.entity WHERE f.acq_year IS NOT NULL AND f.lat IS NOT NULL GROUP BY 1, 2)"""
RING_COLS = {f"same_ind_ring_{a}_{b}km": f"r{a}_{b}" for a, b in ((0, 1), (1, 3), (3, 5), (5, 10), (0, 2), (2, 5))}


def exposure(spark, sf):
    return G.ring_exposure(view(spark, sf, "fx_dim"), keep=["acq_year"], rings=tuple(dict.fromkeys(G.FINE + G.COARSE)))


@query("ring_exposure", f"WITH {EXPOSE} SELECT {L('entity')} AS entity, {L('acq_year')} AS acq_year, {L('n10')} AS n_same_ind_10km, " + ", ".join(f"{L(v)} AS {k}" for k, v in RING_COLS.items()) + " FROM xp")
def ring_exposure(spark, sf):
    return plain(exposure(spark, sf))


@query("ring_density", f"WITH {EXPOSE} " + " UNION ALL ".join(
    f"SELECT '{a}-{b}' AS ring, {R(f'AVG(r{a}_{b})')} AS mean_count, {R(f'AVG(r{a}_{b}) / (PI() * ({b * b} - {a * a}))')} AS per_km2 FROM xp" for a, b in ((0, 1), (1, 3), (3, 5), (5, 10))))
def ring_density(spark, sf):
    return plain(G.ring_density(exposure(spark, sf)))


@query("ring_weight", f"WITH p AS (SELECT id, {haversine('lat', 'lng', '36.25', '-99.75')} AS d FROM fx_points) SELECT {L('id')} AS id, {R('CASE WHEN d <= 1 THEN 1.0 WHEN d <= 3 THEN 0.6 WHEN d <= 5 THEN 0.3 WHEN d <= 10 THEN 0.1 ELSE 0.0 END')} AS w FROM p")
def ring_weight_query(spark, sf):
    d = haversine_km("lat", "lng", F.lit(36.25), F.lit(-99.75))
    return plain(view(spark, sf, "fx_points").select("id", ring_weight(d, G.WEIGHTED, closed="right").alias("w")))


def _event_counts(spark, sf, edges, closed="left"):
    dim = view(spark, sf, "fx_dim")
    events = dim.filter("acq_year IS NOT NULL AND lat IS NOT NULL").withColumnRenamed("acq_year", "event_year")
    return G.event_counts(dim.filter("acq_year IS NULL AND lat IS NOT NULL"), events, edges, closed=closed)


@query("event_pairs", f"""WITH {PAIRS} SELECT {L('entity')} AS entity, {L('year')} AS event_year, {', '.join(f"{L(f'SUM(CASE WHEN {c} THEN 1 ELSE 0 END)')} AS ring_{j}" for j, c in enumerate(('d <= 1', 'd > 1 AND d <= 3', 'd > 3 AND d <= 5', 'd > 5 AND d <= 10')))}
FROM pr WHERE d <= 10 GROUP BY 1, 2""")
def event_pairs(spark, sf):
    return plain(_event_counts(spark, sf, (0, 1, 3, 5, 10), "right"))


@query("first_exposure", f"WITH {FIRST_EXPOSURE} SELECT {L('entity')} AS entity, {L('fe')} AS first_event_year, {R('s')} AS strength_t0 FROM ex")
def first_exposure(spark, sf):
    return plain(G.first_exposure(_event_counts(spark, sf, (0, 1, 3, 5, 10))))


@query("first_exposure_coarse", f"""WITH {PAIRS}, pw AS (SELECT entity, year, SUM(CASE WHEN d < 2 THEN 1.0 WHEN d < 5 THEN 0.6 ELSE 0.2 END) AS w, MIN(year) OVER (PARTITION BY entity) AS fe FROM pr WHERE d < 10 GROUP BY entity, year)
SELECT {L('entity')} AS entity, {L('fe')} AS first_event_year, {R('w')} AS strength_t0 FROM pw WHERE year = fe""")
def first_exposure_coarse(spark, sf):
    edges = (0, 1, 2, 3, 5, 10)
    return plain(G.first_exposure(_event_counts(spark, sf, edges), G.COARSE_LINEAR, edges))


SPILL = f"""{CENTRES}, tp AS (SELECT cell, ROUND(v, 6) AS cv, lat AS la, lng AS ln FROM ce ORDER BY ROUND(v, 6) DESC, cell LIMIT 100),
sd AS (SELECT t.cell, t.cv, ROUND(e.v, 6) AS v, {haversine('t.la', 't.ln', 'e.lat', 'e.lng')} AS d FROM tp t, ce e)"""


def _ring_sql(a, b):
    c = f"d >= {a} AND d < {b}"
    return (f"{R(f'SUM(CASE WHEN {c} THEN v ELSE 0 END)', 4)} AS spill_{a}_{b}km, {L(f'SUM(CASE WHEN {c} THEN 1 ELSE 0 END)')} AS cells_{a}_{b}km, "
            f"{R(f'AVG(CASE WHEN {c} THEN v END) + 1e-7', 4)} AS spillden_{a}_{b}km")


@query("ring_spillover", f"WITH {SPILL} SELECT {L('cell')} AS center_cell, {R('cv', 4)} AS center_value, {', '.join(_ring_sql(a, b) for a, b in ((0, 1), (1, 3), (3, 5), (5, 10)))} FROM sd GROUP BY cell, cv")
def ring_spillover(spark, sf):
    got = G.ring_spillover(cell_sums(spark, sf))
    dens = [c for c in got.columns if c.startswith("spillden")]
    return plain(got.withColumns({c: F.col(c) + 1e-7 for c in dens}), 4)  # keeps halves off the rounding edge


@query("ring_decay_flag", f"""WITH {SPILL}, m AS (SELECT {', '.join(f'AVG(m{j}) AS m{j}' for j in range(4))} FROM (SELECT cell, {', '.join(f'AVG(CASE WHEN d >= {a} AND d < {b} THEN v END) AS m{j}' for j, (a, b) in enumerate(((0, 1), (1, 3), (3, 5), (5, 10))))} FROM sd GROUP BY cell))
SELECT {L('CASE WHEN m1 <= m0 AND m2 <= m1 AND m3 <= m2 THEN 1 ELSE 0 END')} AS decaying FROM m""")
def ring_decay_flag(spark, sf):
    s = G.ring_spillover(cell_sums(spark, sf))
    names = ("0_1", "1_3", "3_5", "5_10")
    row = s.agg(*[F.avg(f"spillden_{n}km").alias(n) for n in names])
    lines = F.array(*[F.struct(F.lit(j).alias("ring"), F.col(f"`{n}`").alias("mean_value")) for j, n in enumerate(names)])
    return plain(G.decay_flag(row.select(F.inline(lines))))


@query("geo_density_grid", f"""
SELECT CASE WHEN acq_year IS NULL THEN 'alive' ELSE 'closed' END AS event, CAST(CAST(FLOOR(lat / 0.1) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(FLOOR(lng / 0.1) AS BIGINT) AS VARCHAR) AS cell, {L('COUNT(*)')} AS n FROM fx_dim WHERE lat IS NOT NULL GROUP BY 1, 2""")
def geo_density_grid(spark, sf):
    kind = F.when(F.col("acq_year").isNull(), "alive").otherwise("closed")
    d = view(spark, sf, "fx_dim").filter("lat is not null")
    return plain(d.groupBy(kind.alias("event"), square_cell("lat", "lng", 0.1).alias("cell")).agg(F.count("*").alias("n")))


@query("ladder_compare", f"""
WITH {LAG}, {_knn_sql('plane', 8)}, {NZ.format(v='(last_year - first_year + lat)')}, {_knn_moran(8)}, r AS (SELECT 'cells' AS dataset, SUM(z * wz) / SUM(z * z) AS i FROM wz UNION ALL SELECT 'entities', i FROM m8)
SELECT arg_max(dataset, i) AS strongest, {R('MAX(i)')} AS strongest_i, arg_min(dataset, i) AS weakest, {R('MIN(i)')} AS weakest_i, {L('COUNT(*)')} AS datasets FROM r""")
def ladder_compare(spark, sf):
    nodes = _value_nodes(spark, sf)
    a = M.moran(cell_sums(spark, sf), W.row_standardised(contiguity(spark, sf)), "value", "cell").select(F.lit("cells").alias("dataset"), "moran_i")
    b = M.moran(nodes, W.knn_weights(nodes, 8), "value").select(F.lit("entities").alias("dataset"), "moran_i")
    return plain(E.ladder_compare(a.unionByName(b)))
