"""Angles, torsion pairs, backbone geometry and prediction reports."""

import math

from pyspark.sql import functions as F

from torsia.functions import geometry as geo
from torsia.functions.angles import torus_distance
from torsia.operators import circular as ops
from torsia.operators import columns as cols
from torsia.operators.quantiles import nan_percentiles
from torsia.session import cut

from . import query
from .columns import _chain_pairs
from .tables import EVENTS, SITES, event_rows, r6, sites, table

_MEAN_SQL = """SELECT state, count(*) AS n, atan2(avg(sin(phi)), avg(cos(phi))) AS m,
  sqrt(avg(sin(phi))**2 + avg(cos(phi))**2) AS rho FROM ev GROUP BY state"""


@query(
    "circular_mean",
    f"""WITH {EVENTS}, m AS ({_MEAN_SQL}) SELECT state, n, round(CASE WHEN m < 0 THEN m + 2*pi() ELSE m END, 6) + 0.0 AS mean,
      round(rho, 6) + 0.0 AS length FROM m""",
)
def _(spark, sf):
    out = ops.circular_mean(event_rows(spark, sf), ["state"], "phi")
    return out.select("state", "n", r6(F.col("mean")).alias("mean"), r6(F.col("length")).alias("length"))


@query(
    "von_mises_moments",
    f"""WITH {EVENTS}, m AS ({_MEAN_SQL.replace('state', 'node')}) SELECT node, n, round(CASE WHEN n >= 2 THEN CASE WHEN m < 0 THEN m + 2*pi() ELSE m END END, 5) + 0.0 AS mu,
      round(CASE WHEN n >= 2 THEN least(5000.0, CASE WHEN rho < 2.0/3.0 THEN rho * (2 - rho*rho) / (1 - rho*rho) ELSE (rho + 1) / (4 * rho * (1 - rho)) END) END, 5) + 0.0 AS kappa FROM m""",
)
def _(spark, sf):
    out = ops.von_mises_moments(event_rows(spark, sf), ["node"], "phi")
    return out.select("node", "n", r6(F.col("mu"), 5).alias("mu"), r6(F.col("kappa"), 5).alias("kappa"))


@query(
    "bivariate_moments",
    f"""WITH {EVENTS}, s AS (SELECT node, count(*) AS n, avg(cos(phi)) AS c1, avg(sin(phi)) AS s1, avg(cos(psi)) AS c2, avg(sin(psi)) AS s2,
        avg(cos(2*phi)) AS cc1, avg(sin(2*phi)) AS ss1, avg(cos(2*psi)) AS cc2, avg(sin(2*psi)) AS ss2,
        avg(cos(phi-psi)) AS cm, avg(sin(phi-psi)) AS sm, avg(cos(phi+psi)) AS cp, avg(sin(phi+psi)) AS sp FROM ev GROUP BY node),
      m AS (SELECT *, atan2(s1, c1) AS m1, atan2(s2, c2) AS m2 FROM s),
      v AS (SELECT *, 0.5 - 0.5*(cos(2*m1)*cc1 + sin(2*m1)*ss1) AS v1, 0.5 - 0.5*(cos(2*m2)*cc2 + sin(2*m2)*ss2) AS v2,
        0.5*(cos(m1-m2)*cm + sin(m1-m2)*sm - cos(m1+m2)*cp - sin(m1+m2)*sp) AS v12 FROM m),
      k AS (SELECT *, (v2 - v12) / (v1*v2 - v12*v12) AS k1, (v1 - v12) / (v1*v2 - v12*v12) AS k2, -v12 / (v1*v2 - v12*v12) AS k3 FROM v)
    SELECT node, n, round(CASE WHEN n < 10 OR k1 >= 0 THEN m1 ELSE m1 - pi() END, 4) + 0.0 AS mu_phi,
      round(CASE WHEN n < 10 OR k2 >= 0 THEN m2 ELSE m2 - pi() END, 4) + 0.0 AS mu_psi,
      round(CASE WHEN n < 10 THEN 0.5 ELSE abs(k1) END, 4) + 0.0 AS k1, round(CASE WHEN n < 10 THEN 0.5 ELSE abs(k2) END, 4) + 0.0 AS k2,
      round(CASE WHEN n < 10 THEN 0.0 ELSE k3 END, 4) + 0.0 AS k3 FROM k""",
)
def _(spark, sf):
    out = ops.bivariate_moments(event_rows(spark, sf), ["node"])
    return out.select("node", "n", *[r6(F.col(c), 4).alias(c) for c in ("mu_phi", "mu_psi", "k1", "k2", "k3")])


_MVN = ("l_quantity", "l_discount", "l_tax")
_MVN_COV = [(a, b) for i, a in enumerate(_MVN) for b in _MVN[i:]]


@query(
    "mvn_moments",
    "SELECT l_suppkey, count(*) AS n, "
    + ", ".join(f"round(avg({c}), 6) + 0.0 AS mean_{c}" for c in _MVN)
    + ", "
    + ", ".join(f"round(covar_pop({a}, {b}), 6) + 0.0 AS cov_{a}_{b}" for a, b in _MVN_COV)
    + " FROM lineitem GROUP BY l_suppkey",
)
def _(spark, sf):
    out = ops.mvn_moments(table(spark, sf, "lineitem"), ["l_suppkey"], _MVN)
    return out.select("l_suppkey", "n", *[r6(F.col(c)).alias(c) for c in out.columns[2:]])


_CHAIN = f"""{SITES}, p AS (SELECT o_custkey AS family, o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders),
  ap AS (SELECT p.family, p.a, p.b, x.col, x.aa AS aa_a, y.aa AS aa_b, x.phi AS phi_a, x.psi AS psi_a, y.phi AS phi_b, y.psi AS psi_b,
    sqrt(2.0 * abs(2.0 - cos(x.phi - y.phi) - cos(x.psi - y.psi))) AS torus
    FROM p JOIN sites x ON x.protein = p.a JOIN sites y ON y.protein = p.b AND y.col = x.col)"""


@query(
    "torsion_distance",
    f"""WITH {_CHAIN} SELECT family, round(sqrt(avg((cos(phi_b) - cos(phi_a))**2 + (sin(phi_b) - sin(phi_a))**2)), 6) + 0.0 AS chord,
      round(avg(torus) FILTER (torus IS NOT NULL), 6) + 0.0 AS mean, round(coalesce(quantile_cont(CASE WHEN phi_a IS NOT NULL AND phi_b IS NOT NULL THEN torus END, 0.9), sqrt(8.0)), 6) + 0.0 AS p90
    FROM ap GROUP BY family""",
)
def _(spark, sf):
    pairs = cut(cols.aligned_pairs(sites(spark, sf), _chain_pairs(spark, sf)))
    out = None
    for how, name in (("chord", "chord"), ("mean", "mean"), ("percentile", "p90")):
        part = ops.torsion_distance(pairs, ["family"], how).select("family", r6(F.col("distance")).alias(name))
        out = part if out is None else out.join(part, "family")
    return out


_DIST = "(b % 97) / 50.0"
_BINS = " ".join(
    f"WHEN {_DIST} >= {lo} AND {_DIST} < {hi} THEN {lo}::DOUBLE" for lo, hi in zip(ops.EDGES[:-1], (*ops.EDGES[1:-1], 1e9))
)


def _divergence(spark, sf):
    dist = _chain_pairs(spark, sf).withColumn("distance", (F.col("b") % 97) / 50.0)
    return ops.distance_by_divergence(sites(spark, sf), dist)


@query(
    "distance_by_divergence",
    f"""WITH {_CHAIN}, r AS (SELECT CASE {_BINS} END AS lower, torus FROM ap WHERE phi_a IS NOT NULL AND phi_b IS NOT NULL)
    SELECT lower, count(*) AS n, round(avg(torus), 6) + 0.0 AS mean FROM r WHERE lower IS NOT NULL GROUP BY lower""",
)
def _(spark, sf):
    bins, _ = _divergence(spark, sf)
    return bins.select("lower", "n", r6(F.col("mean")).alias("mean"))


@query(
    "divergence_density",
    f"""WITH {_CHAIN}, r AS (SELECT CASE {_BINS} END AS lower, torus FROM ap WHERE phi_a IS NOT NULL AND phi_b IS NOT NULL),
      c AS (SELECT lower, CAST(least(floor(torus / (sqrt(8.0) / 40)), 39) + 1 AS BIGINT) AS cell, count(*) AS n FROM r WHERE lower IS NOT NULL GROUP BY ALL)
    SELECT lower, cell, n, round(n / sum(n) OVER (PARTITION BY lower) / (sqrt(8.0) / 40), 6) + 0.0 AS density FROM c""",
)
def _(spark, sf):
    _, density = _divergence(spark, sf)
    return density.select("lower", "cell", "n", r6(F.col("density")).alias("density"))


_RADII = (0.25, 0.5, 1.0, 1.5, 2.0)


@query(
    "radius_benchmark",
    f"""WITH {_CHAIN}, r AS (SELECT family, torus FROM ap WHERE phi_a IS NOT NULL AND phi_b IS NOT NULL)
    SELECT family, count(*) AS n, round(avg(torus), 6) + 0.0 AS mean, round(quantile_cont(torus, 0.5), 6) + 0.0 AS median,
    """
    + ", ".join(
        f"round(CASE WHEN count(*) > 1 THEN least(1.0, count(*) FILTER (torus <= {r}) / (count(*) - 1)) * 100 END, 6) + 0.0 AS within_{str(r).replace('.', '_')}"
        for r in _RADII
    )
    + " FROM r GROUP BY family",
)
def _(spark, sf):
    pairs = cols.aligned_pairs(sites(spark, sf), _chain_pairs(spark, sf))
    d = pairs.select(
        "family", torus_distance(F.col("phi_a"), F.col("psi_a"), F.col("phi_b"), F.col("psi_b")).alias("distance")
    ).filter("distance is not null")
    out = ops.radius_benchmark(d, ["family"])
    return out.select("family", "n", *[r6(F.col(c)).alias(c) for c in out.columns[2:]])


@query(
    "nan_percentile",
    """WITH v AS (SELECT l_suppkey, CASE WHEN l_discount = 0 THEN 0.0 ELSE l_tax / l_discount END AS v FROM lineitem)
    SELECT l_suppkey, round(quantile_cont(v, 0.5), 6) + 0.0 AS median, round(quantile_cont(v, 0.95), 6) + 0.0 AS p95 FROM v GROUP BY 1""",
)
def _(spark, sf):
    v = F.when(F.col("l_discount") == 0, float("nan")).otherwise(F.col("l_tax") / F.col("l_discount"))
    rows = table(spark, sf, "lineitem").select("l_suppkey", v.alias("v"))
    out = nan_percentiles(rows, ["l_suppkey"], "v", {"median": 0.5, "p95": 0.95}, rows_per_block=30)
    return out.select("l_suppkey", r6(F.col("median")).alias("median"), r6(F.col("p95")).alias("p95"))


@query(
    "percentile_rank",
    """SELECT o_custkey, round(CASE WHEN count(*) > 5 THEN avg(CASE WHEN o_totalprice < 200000 THEN 1.0 ELSE 0.0 END) ELSE -1.0 END, 6) + 0.0 AS rank
    FROM orders GROUP BY 1""",
)
def _(spark, sf):
    out = ops.percentile_rank_of(table(spark, sf, "orders"), ["o_custkey"], "o_totalprice", F.lit(200000.0))
    return out.select("o_custkey", r6(F.col("rank")).alias("rank"))


@query(
    "mann_whitney",
    """WITH r AS (SELECT l_returnflag AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rk
        FROM lineitem WHERE l_returnflag IN ('A', 'R')),
      s AS (SELECT CAST(count(*) FILTER (g = 'A') AS DOUBLE) AS a, CAST(count(*) FILTER (g = 'R') AS DOUBLE) AS b, sum(rk) FILTER (g = 'A') AS t FROM r)
    SELECT CAST(a AS BIGINT) AS n1, CAST(b AS BIGINT) AS n2, CAST(t - a * (a + 1) / 2 AS DOUBLE) AS u,
      round((t - a * (a + 1) / 2 - a * b / 2) / sqrt(a * b / ((a + b) * (a + b - 1)) * ((a + b)**3 - (a + b)) / 12), 6) + 0.0 AS z FROM s""",
)
def _(spark, sf):
    out = ops.mann_whitney(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag", "A", "R")
    return out.withColumn("z", r6(F.col("z")))


def _grid_sql(n: int, source: str) -> str:
    def cell(a: str) -> str:
        return f"CAST(round_even(1 + ({a} + pi()) / (2*pi()) * {n - 1}, 0) AS BIGINT)"

    return f"""h AS (SELECT {cell('phi')} AS x, {cell('psi')} AS y, count(*) AS n FROM {source} GROUP BY ALL)"""


@query(
    "torsion_histogram",
    f"""WITH {EVENTS}, {_grid_sql(24, 'ev')} SELECT x, y, n, round(n / sum(n) OVER (), 6) + 0.0 AS share, round(n / max(n) OVER (), 6) + 0.0 AS of_max FROM h""",
)
def _(spark, sf):
    out = ops.torsion_histogram(event_rows(spark, sf), 24)
    return out.select("x", "y", "n", r6(F.col("share")).alias("share"), r6(F.col("of_max")).alias("of_max"))


@query(
    "torsion_histogram_where",
    f"""WITH {SITES}, c AS (SELECT *, lead(aa) OVER (PARTITION BY protein ORDER BY col) AS nxt FROM sites),
      f AS (SELECT * FROM c WHERE phi IS NOT NULL AND aa <> 'P' AND nxt IN ('A', 'C', 'D', 'E', 'F')), {_grid_sql(25, 'f')}
    SELECT x, y, n, round(n / sum(n) OVER (), 6) + 0.0 AS share FROM h""",
)
def _(spark, sf):
    out = ops.torsion_histogram(
        sites(spark, sf), 25, where=lambda aa, nxt: (aa != "P") & nxt.isin(*"ACDEF"), rows_per_block=4
    )
    return out.select("x", "y", "n", r6(F.col("share")).alias("share"))


@query(
    "torus_smooth",
    f"""WITH {EVENTS}, {_grid_sql(24, 'ev')}, o AS (SELECT unnest(generate_series(-6, 6)) AS d),
      k AS (SELECT d, 1.0 / (1.0 + (d / 2.0)**2) / (SELECT sum(1.0 / (1.0 + (d / 2.0)**2)) FROM o) AS w FROM o)
    SELECT CAST((x + a.d - 1 + 24) % 24 + 1 AS BIGINT) AS x, CAST((y + b.d - 1 + 24) % 24 + 1 AS BIGINT) AS y, round(sum(n * a.w * b.w), 6) + 0.0 AS value
    FROM h CROSS JOIN k a CROSS JOIN k b GROUP BY 1, 2""",
)
def _(spark, sf):
    out = ops.torus_smooth(ops.torsion_histogram(event_rows(spark, sf), 24), 24)
    return out.select("x", "y", r6(F.col("value")).alias("value"))


# --- structures ---

_POINTS = {
    "N": ("q", "d", "t"),
    "CA": ("q + 1 + p * 0.1", "d + 0.5", "t - 0.3"),
    "C": ("q + 0.2", "d + 1.2 + p * 0.2", "t + 0.9"),
}
_RES_SQL = """SELECT l_orderkey AS pdb, CAST(l_linenumber AS BIGINT) AS resnum, min(l_quantity) AS q, min(l_discount) * 100 AS d, min(l_tax) * 100 AS t,
  CAST(min(l_partkey) % 7 AS DOUBLE) AS p, min(l_partkey) % 22 = 20 AS no_ca FROM lineitem GROUP BY l_orderkey, l_linenumber"""


def _residue_rows(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_quantity").alias("q"), (F.min("l_discount") * 100).alias("d"), (F.min("l_tax") * 100).alias("t"),
        (F.min("l_partkey") % 7).cast("double").alias("p"), (F.min("l_partkey") % 22 == 20).alias("no_ca"),
    ).withColumnsRenamed({"l_orderkey": "pdb"}).withColumns(
        {"resnum": F.col("l_linenumber").cast("bigint"), "chain": F.lit("A"), "resname": F.lit("GLY")}
    )


def _atoms(spark, sf):
    rows = _residue_rows(spark, sf)
    atoms = F.array(*[
        F.struct(F.lit(a).alias("atom"), *[F.expr(e).cast("double").alias(v) for v, e in zip("xyz", xyz)])
        for a, xyz in _POINTS.items()
    ])
    out = rows.withColumn("_a", F.explode(atoms)).filter("not (no_ca and _a.atom = 'CA')")
    return out.select("pdb", "chain", "resnum", "resname", "_a.*", F.col("p").alias("bfactor"))


def _sub(a, b):
    return tuple(f"({a}.{k} - {b}.{k})" for k in "xyz")


def _dot(u, v):
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(u, v)) + ")"


def _cross(u, v):
    return tuple(f"({u[i]} * {v[j]} - {u[j]} * {v[i]})" for i, j in ((1, 2), (2, 0), (0, 1)))


def _len_sql(a, b):
    return f"sqrt({_dot(_sub(a, b), _sub(a, b))})"


def _ang_sql(a, b, c):
    u, v = _sub(a, b), _sub(c, b)
    x = f"({_dot(u, v)} / sqrt({_dot(u, u)} * {_dot(v, v)}))"
    return f"acos(CASE WHEN {x} > 1 THEN 1.0 WHEN {x} < -1 THEN -1.0 ELSE {x} END)"


def _dih_sql(a, b, c, d):
    u, v, w = _sub(b, a), _sub(c, b), _sub(d, c)
    n1, n2 = _cross(u, v), _cross(v, w)
    return f"atan2(sqrt({_dot(v, v)}) * {_dot(u, n2)}, {_dot(n1, n2)})"


_GEO = {
    "phi": _dih_sql("pc", "n", "ca", "c"), "psi": _dih_sql("n", "ca", "c", "nn"), "omega": _dih_sql("pca", "pc", "n", "ca"),
    "ba1": _ang_sql("pca", "pc", "n"), "ba2": _ang_sql("pc", "n", "ca"), "ba3": _ang_sql("n", "ca", "c"),
    "bl1": _len_sql("pc", "n"), "bl2": _len_sql("n", "ca"), "bl3": _len_sql("ca", "c"),
}


def _pt(a: str) -> str:
    x, y, z = _POINTS[a]
    s = f"struct_pack(x := {x}, y := {y}, z := {z})"
    return f"CASE WHEN NOT no_ca THEN {s} END" if a == "CA" else s


@query(
    "backbone_geometry",
    f"""WITH r AS ({_RES_SQL}), s AS (SELECT pdb, resnum, {_pt('N')} AS n, {_pt('CA')} AS ca, {_pt('C')} AS c FROM r),
      j AS (SELECT s.pdb, s.resnum, s.n, s.ca, s.c, a.ca AS pca, a.c AS pc, b.n AS nn FROM s
        LEFT JOIN s a ON a.pdb = s.pdb AND a.resnum = s.resnum - 1 LEFT JOIN s b ON b.pdb = s.pdb AND b.resnum = s.resnum + 1)
    SELECT pdb, resnum, {', '.join(f'round({e}, 5) + 0.0 AS {k}' for k, e in _GEO.items())} FROM j""",
)
def _(spark, sf):
    out = ops.backbone_geometry(_atoms(spark, sf))
    return out.select("pdb", "resnum", *[r6(F.col(c), 5).alias(c) for c in _GEO])


@query(
    "geometry_functions",
    f"""WITH r AS ({_RES_SQL}), s AS (SELECT pdb, resnum, {_pt('N')} AS n, {_pt('CA')} AS ca, {_pt('C')} AS c, struct_pack(x := 3.0, y := resnum * 1.0, z := -2.0) AS o FROM r)
    SELECT pdb, resnum, round({_len_sql('n', 'o')}, 5) + 0.0 AS distance, round({_ang_sql('n', 'ca', 'o')}, 5) + 0.0 AS angle, round({_dih_sql('n', 'ca', 'c', 'o')}, 5) + 0.0 AS dihedral FROM s""",
)
def _(spark, sf):
    o = F.struct(F.lit(3.0).alias("x"), (F.col("resnum") * 1.0).alias("y"), F.lit(-2.0).alias("z"))
    points = {a: F.struct(*[F.expr(e).cast("double").alias(v) for v, e in zip("xyz", xyz)]) for a, xyz in _POINTS.items()}
    points["CA"] = F.when(~F.col("no_ca"), points["CA"])
    rows = _residue_rows(spark, sf).select("pdb", "resnum", *[p.alias(f"at_{a}") for a, p in points.items()], o.alias("at_O"))
    n, ca, c, far = (F.col(f"at_{a}") for a in ("N", "CA", "C", "O"))
    return rows.select(
        "pdb", "resnum", r6(geo.distance(n, far), 5).alias("distance"), r6(geo.bond_angle(n, ca, far), 5).alias("angle"),
        r6(geo.dihedral(n, ca, c, far), 5).alias("dihedral"),
    )


@query(
    "fill_missing_residues",
    f"""WITH r AS ({_RES_SQL}), m AS (SELECT pdb, max(resnum) AS hi FROM r GROUP BY pdb),
      g AS (SELECT pdb, unnest(generate_series(1, hi)) AS resnum FROM m)
    SELECT g.pdb, g.resnum, CASE WHEN r.q IS NULL THEN 'X' ELSE 'G' END AS aa, r.q FROM g LEFT JOIN r ON r.pdb = g.pdb AND r.resnum = g.resnum""",
)
def _(spark, sf):
    rows = _residue_rows(spark, sf).select("pdb", "chain", "resnum", F.lit("G").alias("aa"), "q")
    return ops.fill_missing_residues(rows, rows_per_block=4).select("pdb", "resnum", "aa", "q")


@query(
    "longest_chain",
    """WITH c AS (SELECT c_nationkey, c_custkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
    SELECT CAST(c_nationkey AS BIGINT) AS pdb, first(c_custkey ORDER BY n DESC, c_custkey) AS chain, max(n) AS n FROM c GROUP BY c_nationkey""",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return ops.longest_chain(rows.select(F.col("c_nationkey").cast("bigint").alias("pdb"), F.col("c_custkey").alias("chain")))


@query(
    "structure_quality",
    """WITH l AS (SELECT o_custkey AS pdb, o_orderkey AS k, o_orderstatus AS s FROM orders)
    SELECT pdb,
      coalesce(first(CAST((k % 5) || '.' || (k % 89 + 10) AS DOUBLE) ORDER BY k) FILTER (k % 4 = 0), -1.0) AS resolution,
      coalesce(first(CAST('0.' || (k % 89 + 10) AS DOUBLE) ORDER BY k) FILTER (k % 4 = 1), -1.0) AS rvalue,
      coalesce(first(CAST('.' || (k % 89 + 10) AS DOUBLE) ORDER BY k) FILTER (k % 4 = 2), -1.0) AS freervalue,
      count(*) FILTER (k % 4 = 3 AND s = 'F') = 0 AS valid FROM l GROUP BY pdb""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    text = (k % 89 + 10).cast("string")
    line = (
        F.when(k % 4 == 0, F.concat(F.lit("REMARK   2 RESOLUTION.    "), (k % 5).cast("string"), F.lit("."), text, F.lit(" ANGSTROMS.")))
        .when(k % 4 == 1, F.concat(F.lit("REMARK   3   R VALUE            (WORKING SET) : 0."), text))
        .when(k % 4 == 2, F.concat(F.lit("REMARK   3   FREE R VALUE                     : ."), text))
        .otherwise(F.concat(F.lit("TITLE     STRUCTURE OF A "), F.when(F.col("o_orderstatus") == "F", "MUTANT").otherwise("NATIVE"), F.lit(" PROTEIN")))
    )
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("pdb"), k.alias("line_no"), line.alias("line"))
    return ops.structure_quality(rows)


# --- predictions ---


@query(
    "nearest_named",
    """WITH d AS (SELECT l_orderkey AS a, l_suppkey AS b, l_extendedprice AS distance FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 5000)
    SELECT o_orderkey AS a, first(b ORDER BY distance, b) FILTER (b IS NOT NULL) AS nearest, min(distance) AS distance
    FROM orders LEFT JOIN d ON d.a = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1""",
)
def _(spark, sf):
    dist = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_extendedprice").alias("distance")
    )
    targets = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("a"))
    others = table(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("b"), F.col("s_suppkey").alias("rank"))
    return ops.nearest_named(dist, targets, others)


@query(
    "fallback_angles",
    f"""WITH {SITES}, t AS (SELECT family, col, arg_min(phi, protein) FILTER (phi IS NOT NULL) AS phi, arg_min(psi, protein) FILTER (phi IS NOT NULL) AS psi FROM sites GROUP BY ALL),
      h AS (SELECT family, col, arg_max(phi, protein) AS phi, arg_max(psi, protein) AS psi FROM sites WHERE aa IN ('A','C','D','E','F','G','H') GROUP BY ALL)
    SELECT s.family AS protein, s.col, s.protein AS iter,
      round(sqrt(2.0 * (2.0 - cos(t.phi - coalesce(h.phi, s.phi)) - cos(t.psi - CASE WHEN h.phi IS NULL THEN s.psi ELSE h.psi END))), 5) + 0.0 AS distance
    FROM sites s JOIN t ON t.family = s.family AND t.col = s.col LEFT JOIN h ON h.family = s.family AND h.col = s.col
    WHERE t.phi IS NOT NULL AND coalesce(h.phi, s.phi) IS NOT NULL""",
)
def _(spark, sf):
    s = sites(spark, sf)
    seen = F.when(F.col("phi").isNotNull(), F.col("protein"))
    truth = s.groupBy(F.col("family").alias("protein"), "col").agg(
        F.min_by("phi", seen).alias("phi"), F.min_by("psi", seen).alias("psi")
    )
    homolog = s.filter(F.col("aa").isin(*"ACDEFGH")).groupBy(F.col("family").alias("protein"), "col").agg(
        F.max_by("phi", "protein").alias("phi"), F.max_by("psi", "protein").alias("psi")
    )
    samples = s.select(F.col("family").alias("protein"), F.col("protein").alias("iter"), "col", "phi", "psi")
    return ops.fallback_angles(truth, homolog, samples).withColumn("distance", r6(F.col("distance"), 5))


@query(
    "residual_vs_bfactor",
    f"""WITH {SITES} SELECT family, protein, col, col % 3 AS state, CAST(protein % 50 AS DOUBLE) AS b_ca,
      round(sqrt(2.0 * (2.0 - cos(phi - (col % 3) * 0.5) - cos(psi + (col % 3) * 0.3))), 6) + 0.0 AS distance FROM sites WHERE phi IS NOT NULL""",
)
def _(spark, sf):
    s = sites(spark, sf).withColumns({"state": F.col("col") % 3, "b_ca": (F.col("protein") % 50).cast("double")})
    centres = s.select("state").distinct().select(
        "state", (F.col("state") * 0.5).alias("mu_phi"), (F.col("state") * -0.3).alias("mu_psi")
    )
    return ops.residual_vs_bfactor(s, centres).withColumn("distance", r6(F.col("distance")))
