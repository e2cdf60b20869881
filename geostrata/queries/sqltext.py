"""SQL fragments shared by several equivalents."""

import math

from geostrata.functions.columns import EARTH_RADIUS_KM, HEX_EDGE_KM
from geostrata.operators.moran import KEYS, PRIME, ROUNDS, SPREAD
from geostrata.operators.twfe import COLLINEAR


def haversine(lat1, lng1, lat2, lng2):
    return (
        f"(2 * {EARTH_RADIUS_KM} * ASIN(SQRT(LEAST(1.0, POW(SIN(RADIANS({lat2} - {lat1}) / 2), 2)"
        f" + COS(RADIANS({lat1})) * COS(RADIANS({lat2})) * POW(SIN(RADIANS({lng2} - {lng1}) / 2), 2)))))"
    )


RING_W = "CASE WHEN d < 1 THEN 1.0 WHEN d < 3 THEN 0.6 WHEN d < 5 THEN 0.3 WHEN d < 10 THEN 0.1 ELSE 0.0 END"

PAIRS = f"""pr AS (SELECT a.entity, e.acq_year AS year, {haversine('a.lat', 'a.lng', 'e.lat', 'e.lng')} AS d
  FROM fx_dim a JOIN fx_dim e ON a.class = e.class WHERE a.acq_year IS NULL AND a.lat IS NOT NULL AND e.acq_year IS NOT NULL AND e.lat IS NOT NULL AND a.first_year <= e.acq_year)"""

FIRST_EXPOSURE = f"""{PAIRS}, pw AS (SELECT entity, year, SUM({RING_W}) AS w, MIN(year) OVER (PARTITION BY entity) AS fe FROM pr WHERE d < 10 GROUP BY entity, year),
ex AS (SELECT entity, fe, w AS s FROM pw WHERE year = fe)"""


def hex_axial(lat, lng, resolution=7, lat0=37.0):
    edge = HEX_EDGE_KM[resolution]
    x = f"(RADIANS({lng}) * {EARTH_RADIUS_KM * math.cos(math.radians(lat0))!r})"
    y = f"(RADIANS({lat}) * {EARTH_RADIUS_KM!r})"
    q = f"(({x} * {math.sqrt(3) / 3!r} - {y} * {1 / 3!r}) / {edge!r})"
    r = f"({y} * {2 / 3!r} / {edge!r})"
    s = f"(-{q} - {r})"
    rnd = lambda v: f"ROUND_EVEN({v}, 0)"
    dq, dr, ds = (f"ABS({rnd(v)} - {v})" for v in (q, r, s))
    q_out = f"CASE WHEN {dq} > {dr} AND {dq} > {ds} THEN -{rnd(r)} - {rnd(s)} ELSE {rnd(q)} END"
    r_out = f"CASE WHEN {dq} > {dr} AND {dq} > {ds} THEN {rnd(r)} WHEN {dr} > {ds} THEN -{rnd(q)} - {rnd(s)} ELSE {rnd(r)} END"
    return q_out, r_out


def hex_cell(lat="lat", lng="lng", resolution=7):
    q, r = hex_axial(lat, lng, resolution)
    return f"((CAST({q} AS BIGINT) + 4194304) * 8388608 + CAST({r} AS BIGINT) + 4194304)"


HEX_CELL = hex_cell()


def hex_disk(k=5, name="disk"):
    return (
        f"{name} AS (SELECT a.v * 8388608 + b.v AS o, a.v AS dq, b.v AS dr FROM (SELECT UNNEST(RANGE({-k}, {k + 1})) AS v) a,"
        f" (SELECT UNNEST(RANGE({-k}, {k + 1})) AS v) b WHERE ABS(a.v + b.v) <= {k})"
    )


HEX_DISK = hex_disk()


def demean_steps(source, columns, rounds=30, entity="entity", time="year"):
    """CTEs that take entity and period means off in turn until both vanish; the last one is ``dx``."""
    keys = f"{entity}, {time}"
    ctes, prev = [], source
    for i in range(rounds):
        by = entity if i % 2 == 0 else time
        name = "dx" if i == rounds - 1 else f"dx{i}"
        cols = ", ".join(f"{c} - AVG({c}) OVER (PARTITION BY {by}) AS {c}" for c in columns)
        ctes.append(f"{name} AS MATERIALIZED (SELECT {keys}, {cols} FROM {prev})")
        prev = name
    return ",\n".join(ctes)


def clustered_ols(source, y, xs, raw, entity="entity"):
    """CTEs for least squares with clustered errors: ``gj`` (i, coef) and ``ce`` (i, std_err).

    Gauss-Jordan elimination on the moment matrix in long form (row, column, value). A regressor of which the earlier
    ones leave too little of its sum of squares in ``raw`` is passed over: coefficient and error are null.
    """
    k = len(xs)
    names = [*xs, y]
    moments = " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, SUM({names[i]} * {names[j]}) AS v FROM {source}" for i in range(k) for j in range(k + 1)
    )
    eye = " UNION ALL ".join(f"SELECT {i}, {k + 1 + j}, {1.0 if i == j else 0.0}" for i in range(k) for j in range(k))
    steps, prev = [f"g0 AS MATERIALIZED ({moments} UNION ALL {eye})"], "g0"
    for p in range(k):
        left = f"(SELECT v FROM {prev} WHERE i = {p} AND j = {p})"
        steps.append(f"kp{p} AS MATERIALIZED (SELECT {p} AS i, {left} AS pivot, {left} > {COLLINEAR!r} * (SELECT SUM({xs[p]} * {xs[p]}) FROM {raw}) AS kept)")
        steps.append(
            f"g{p + 1} AS MATERIALIZED (SELECT a.i, a.j, CASE WHEN NOT q.kept THEN a.v WHEN a.i = {p} THEN a.v / q.pivot ELSE a.v - f.v * r.v / q.pivot END AS v FROM {prev} a "
            f"JOIN {prev} r ON r.i = {p} AND r.j = a.j JOIN {prev} f ON f.i = a.i AND f.j = {p}, kp{p} q)"
        )
        prev = f"g{p + 1}"
    steps.append("kp AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT i, kept FROM kp{p}" for p in range(k)) + ")")
    steps.append(f"gj AS MATERIALIZED (SELECT g.i, CASE WHEN kept THEN v END AS coef FROM {prev} g JOIN kp ON kp.i = g.i WHERE j = {k})")
    fitted = " + ".join(f"{x} * (SELECT COALESCE(coef, 0) FROM gj WHERE i = {i})" for i, x in enumerate(xs))
    steps.append(f"iv AS (SELECT g.i, g.j - {k + 1} AS j, v FROM {prev} g JOIN kp a ON a.i = g.i JOIN kp b ON b.i = g.j - {k + 1} WHERE a.kept AND b.kept)")
    steps.append(f"rs AS MATERIALIZED (SELECT *, {y} - ({fitted}) AS r FROM {source})")
    score = ", ".join(f"SUM({x} * r) AS u{i}" for i, x in enumerate(xs))
    steps.append(f"us AS MATERIALIZED (SELECT {entity}, {score} FROM rs GROUP BY {entity})")
    meat = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, SUM(u{i} * u{j}) AS v FROM us" for i in range(k) for j in range(k))
    steps.append(f"mt AS MATERIALIZED ({meat})")
    steps.append(f"sz AS (SELECT COUNT(*) * 1.0 AS n, COUNT(DISTINCT {entity}) * 1.0 AS g, (SELECT COUNT(*) FROM kp WHERE kept) AS k FROM {source})")
    steps.append(
        "cv AS (SELECT a.i, SQRT(SUM(a.v * m.v * b.v) * ANY_VALUE((g / (g - 1)) * ((n - 1) / (n - k)))) AS std_err "
        "FROM iv a JOIN mt m ON m.i = a.j JOIN iv b ON b.i = m.j AND b.j = a.i, sz GROUP BY a.i)"
    )
    steps.append("ce AS (SELECT kp.i, std_err FROM kp LEFT JOIN cv ON cv.i = kp.i)")
    return ",\n".join(steps)


def hash_draw(*columns, seed=42):
    """The 52-bit number that a row draws."""
    text = " || '|' || ".join([f"COALESCE(CAST({c} AS VARCHAR), '')" for c in columns] + [f"'{seed}'"])
    return f"CAST(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) AS DOUBLE)"


def kept_sample(source, event, key, by=None, times=2, name="ks"):
    """A CTE with all event rows and ``times`` as many others, those that draw the smallest numbers (per ``by``)."""
    part = f"PARTITION BY {by}" if by else ""
    return f"""{name}_h AS (SELECT *, {hash_draw(*key)} AS draw FROM {source}),
{name}_r AS (SELECT *, RANK() OVER (PARTITION BY {by + ', ' if by else ''}{event} ORDER BY draw) AS rk, SUM({event}) OVER ({part}) AS all_events FROM {name}_h),
{name} AS MATERIALIZED (SELECT * FROM {name}_r WHERE {event} = 1 OR rk <= {times} * all_events)"""


def fisher_steps(source, k, link, by="w", rounds=12, ridge=None):
    """CTEs of Fisher scoring for every group ``by``; the last is ``bt`` (by, b0.., s0..): coefficients and errors.

    ``source`` has a row per observation: ``by``, weight ``wt``, event ``e`` and ``x0`` .. with ``x0`` = 1. ``ridge`` is a
    penalty per unit of weight on all but the first. Every round solves the normal equations by elimination.
    """
    span, pen = range(k), (lambda i: f" + {ridge!r} * tw" if ridge and i else "")
    ctes, prev = [f"b_0 AS (SELECT {by}, " + ", ".join(
        (f"LN(SUM(wt * e) / (SUM(wt) - SUM(wt * e)))" if link == "logit" else "LN(-LN(1 - SUM(wt * e) / SUM(wt)))") + " AS b0" if i == 0 else f"CAST(0 AS DOUBLE) AS b{i}" for i in span
    ) + f" FROM {source} GROUP BY {by})"], "b_0"
    prob = "1 / (1 + EXP(-eta))" if link == "logit" else "1 - EXP(-EXP(eta))"
    slope = "p * (1 - p)" if link == "logit" else "EXP(eta - EXP(eta))"
    for t in range(1, rounds + 1):
        eta = " + ".join(f"b{i} * x{i}" for i in span)
        ctes.append(f"""q_{t} AS (SELECT {by}, wt, e, {', '.join(f'x{i}' for i in span)}, p, {slope} AS d FROM (SELECT *, GREATEST(1e-15, LEAST(1 - 1e-15, {prob})) AS p FROM (SELECT s.*, {eta} AS eta FROM {source} s JOIN {prev} b ON b.{by} = s.{by})))""")
        sums = [f"SUM(wt * d * d / (p * (1 - p)) * x{i} * x{j}) AS h{i}_{j}" for i in span for j in range(i, k)]
        sums += [f"SUM(wt * (e - p) * d / (p * (1 - p)) * x{i}) AS g{i}" for i in span] + ["SUM(wt) AS tw"]
        ctes.append(f"m_{t} AS MATERIALIZED (SELECT {by}, {', '.join(sums)} FROM q_{t} GROUP BY {by})")
        full = [f"h{min(i, j)}_{max(i, j)}{pen(i) if i == j else ''} AS a{i}_{j}" for i in span for j in span]
        full += [f"g{i}" + (f" - {ridge!r} * tw * b{i}" if ridge and i else "") + f" AS a{i}_{k}" for i in span]
        last, width = t == rounds, k + 1
        if last:
            full += [f"CAST({1.0 if i == j else 0.0} AS DOUBLE) AS a{i}_{k + 1 + j}" for i in span for j in span]
            width = 2 * k + 1
        ctes.append(f"e_{t}_0 AS MATERIALIZED (SELECT m.{by}, {', '.join(f'b{i}' for i in span)}, {', '.join(full)} FROM m_{t} m JOIN {prev} b ON b.{by} = m.{by})")
        for c in span:
            new = [f"a{i}_{j} - a{i}_{c} * a{c}_{j} / a{c}_{c} AS a{i}_{j}" if i != c else f"a{c}_{j} / a{c}_{c} AS a{c}_{j}" for i in span for j in range(c + 1, width)]
            ctes.append(f"e_{t}_{c + 1} AS MATERIALIZED (SELECT {by}, {', '.join(f'b{i}' for i in span)}, {', '.join(new)} FROM e_{t}_{c})")
        done = [f"b{i} + a{i}_{k} AS b{i}" for i in span] + ([f"SQRT(a{i}_{k + 1 + i}) AS s{i}" for i in span] if last else [])
        prev = "bt" if last else f"b_{t}"
        ctes.append(f"{prev} AS MATERIALIZED (SELECT {by}, {', '.join(done)} FROM e_{t}_{k})")
    return ",\n".join(ctes)


def bijected(source, replicates, seed=0, walks=10):
    """CTEs that send rank ``k`` of ``source (id, k, z)`` to a slot in every replicate; the last is ``sl`` (r, slot, z)."""
    def moved(x, key):
        t = f"(({x} * {SPREAD} + {key}) % {PRIME})"
        return f"((({t} * {t}) % {PRIME} * {t} + {key}) % {PRIME})"

    ctes = [f"ab AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT n, CAST(CEIL(SQRT(n)) AS BIGINT) AS a FROM (SELECT COUNT(*) AS n FROM {source})))",
            f"wk0 AS MATERIALIZED (SELECT g.r, s.z, s.k + ab.n AS v, ab.* FROM {source} s, (SELECT UNNEST(RANGE(1, {replicates + 1})) AS r) g, ab)"]
    for w in range(walks):
        at = "v - n" if w == 0 else "v"  # every rank goes through once, then what left 0 .. n-1
        ctes.append(f"wk{w + 1}_0 AS MATERIALIZED (SELECT r, z, n, a, b, ({at}) // b AS lo, ({at}) % b AS ro FROM wk{w} WHERE v >= n)")
        for q in range(ROUNDS):
            key = f"((r * {KEYS[0]} + {q * KEYS[1] + seed * KEYS[2] + 1}) * {SPREAD} % {PRIME})"
            new = f"(lo + {moved('ro', key)}) % a AS lo, ro" if q % 2 == 0 else f"lo, (ro + {moved('lo', key)}) % b AS ro"
            ctes.append(f"wk{w + 1}_{q + 1} AS MATERIALIZED (SELECT r, z, n, a, b, {new} FROM wk{w + 1}_{q})")
        ctes.append(f"wk{w + 1} AS MATERIALIZED (SELECT r, z, n, a, b, lo * b + ro AS v FROM wk{w + 1}_{ROUNDS})")
    slots = " UNION ALL ".join(f"SELECT r, v AS slot, z FROM wk{w + 1} WHERE v < n" for w in range(walks))
    ctes.append(f"sl AS MATERIALIZED ({slots} UNION ALL SELECT 0, k, z FROM {source})")
    return ",\n".join(ctes)
