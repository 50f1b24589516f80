"""Summaries of angles, torsion pairs, backbone geometry and angle maps."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from torsia.functions.angles import TWO_PI, chord_distance, mod2pi, pimod, torus_distance
from torsia.functions.geometry import bend, cross, dot, minus, twist
from torsia.functions.letters import residue_code
from torsia.session import cut

from .columns import aligned_pairs
from .ordered import ROWS_PER_BLOCK, neighbour
from .quantiles import exact_percentiles

SQRT8 = math.sqrt(8.0)


def circular_mean(df: DataFrame, keys: Sequence[str], theta: str) -> DataFrame:
    """(n, mean in [0, 2pi), resultant length) per key; mean null where undefined."""
    c, s = F.avg(F.cos(theta)), F.avg(F.sin(theta))
    sums = df.groupBy(*keys).agg(F.count(theta).alias("n"), c.alias("_c"), s.alias("_s"))
    length = F.sqrt(F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s"))
    return sums.select(
        *keys, "n", F.when(length > 0, mod2pi(F.atan2("_s", "_c"))).alias("mean"), length.alias("length")
    )


def von_mises_moments(df: DataFrame, keys: Sequence[str], theta: str, most: float = 5000.0) -> DataFrame:
    """mu and kappa by the two-branch approximation; null below two values."""
    m = circular_mean(df, keys, theta)
    # Rounding can carry the resultant above 1.
    rho, enough = F.least(F.col("length"), F.lit(1.0)), F.col("n") >= 2
    wide = rho * (2.0 - rho * rho) / F.nullif(1.0 - rho * rho, F.lit(0.0))
    tight = (rho + 1.0) / F.nullif(4.0 * rho * (1.0 - rho), F.lit(0.0))
    kappa = F.coalesce(F.when(rho < 2.0 / 3.0, wide).otherwise(tight), F.lit(most))
    return m.select(
        *keys,
        "n",
        F.when(enough, F.col("mean")).alias("mu"),
        F.when(enough, F.least(kappa, F.lit(most))).alias("kappa"),
    )


def bivariate_moments(df: DataFrame, keys: Sequence[str], phi: str = "phi", psi: str = "psi") -> DataFrame:
    """Moment estimates (mu_phi, mu_psi, k1, k2, k3) of the cosine form, per key."""
    a, b = F.col(phi), F.col(psi)
    sums = {
        "c1": F.cos(a), "s1": F.sin(a), "c2": F.cos(b), "s2": F.sin(b),
        "cc1": F.cos(2.0 * a), "ss1": F.sin(2.0 * a), "cc2": F.cos(2.0 * b), "ss2": F.sin(2.0 * b),
        "cm": F.cos(a - b), "sm": F.sin(a - b), "cp": F.cos(a + b), "sp": F.sin(a + b),
    }
    m = (
        df.filter(a.isNotNull() & b.isNotNull())
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"_{k}") for k, v in sums.items()])
    )
    c = {k: F.col(f"_{k}") for k in sums}
    m = m.withColumns({"_m1": F.atan2(c["s1"], c["c1"]), "_m2": F.atan2(c["s2"], c["c2"])})
    m1, m2 = F.col("_m1"), F.col("_m2")
    spread1 = 0.5 - 0.5 * (F.cos(2.0 * m1) * c["cc1"] + F.sin(2.0 * m1) * c["ss1"])
    spread2 = 0.5 - 0.5 * (F.cos(2.0 * m2) * c["cc2"] + F.sin(2.0 * m2) * c["ss2"])
    cross = 0.5 * (
        F.cos(m1 - m2) * c["cm"] + F.sin(m1 - m2) * c["sm"] - F.cos(m1 + m2) * c["cp"] - F.sin(m1 + m2) * c["sp"]
    )
    m = m.withColumns({"_v1": spread1, "_v2": spread2, "_v12": cross})
    det = F.nullif(F.col("_v1") * F.col("_v2") - F.col("_v12") * F.col("_v12"), F.lit(0.0))
    k1, k2 = (F.col("_v2") - F.col("_v12")) / det, (F.col("_v1") - F.col("_v12")) / det
    few = F.col("n") < 10

    def mean(mu: Column, k: Column) -> Column:
        return F.when(~few & (k < 0), mu - math.pi).otherwise(mu)

    return m.select(
        *keys, "n", mean(m1, k1).alias("mu_phi"), mean(m2, k2).alias("mu_psi"),
        F.when(few, 0.5).otherwise(F.abs(k1)).alias("k1"),
        F.when(few, 0.5).otherwise(F.abs(k2)).alias("k2"),
        F.when(few, 0.0).otherwise(-F.col("_v12") / det).alias("k3"),
    )


def mvn_moments(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Means and maximum-likelihood covariances of the rows with all values present."""
    whole = df.na.drop(subset=list(columns))
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(c).alias(f"mean_{c}") for c in columns]
    for i, a in enumerate(columns):
        aggs += [F.covar_pop(a, b).alias(f"cov_{a}_{b}") for b in columns[i:]]
    return whole.groupBy(*keys).agg(*aggs)


def torsion_distance(pairs: DataFrame, keys: Sequence[str], how: str = "mean", p: float = 0.9) -> DataFrame:
    """Distance of pairs (phi_a, psi_a, phi_b, psi_b) per key.

    ``chord``: root mean square of the chord of phi; ``mean``: mean torus
    distance; ``percentile``: its percentile, sqrt(8) if there is no pair.
    """
    torus = torus_distance(F.col("phi_a"), F.col("psi_a"), F.col("phi_b"), F.col("psi_b"))
    if how == "chord":
        d = chord_distance(F.col("phi_a"), F.col("phi_b"))
        value = F.sqrt(F.avg(d * d))
    elif how == "mean":
        value = F.avg(torus)
    elif how == "percentile":
        measured = pairs.select(*keys, torus.alias("_d"))
        found = exact_percentiles(measured, keys, "_d", {"distance": p})
        every = measured.select(*keys).distinct()
        return every.join(found, list(keys), "left").na.fill(SQRT8, ["distance"])
    else:
        raise ValueError(f"unknown distance {how!r}")
    return pairs.groupBy(*keys).agg(value.alias("distance"))


EDGES = (0.05, 0.1, 0.2, 0.4, 0.8, 1.6, math.inf)


def distance_by_divergence(
    sites: DataFrame, dist: DataFrame, edges: Sequence[float] = EDGES, cells: int = 40, same_letter: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Torus distances of aligned sites by path distance of their proteins.

    ``dist(family, a, b, distance)`` names the pairs and their distances. Bins
    are half open and come from a CASE over a few edges, so no range join is
    needed. Returns (lower, upper, n, mean) and (lower, cell, n, density); the
    last of the cells on [0, sqrt 8] is closed.
    """
    d = F.col("distance")
    lower = F.lit(None).cast("double")
    upper = F.lit(None).cast("double")
    for lo, hi in zip(edges[:-1], edges[1:]):
        here = (d >= lo) & (d < hi)
        lower, upper = F.when(here, lo).otherwise(lower), F.when(here, hi).otherwise(upper)
    binned = dist.withColumns({"lower": lower, "upper": upper}).filter("lower is not null")
    pairs = aligned_pairs(sites, binned).join(binned, ["family", "a", "b"])
    torus = torus_distance(F.col("phi_a"), F.col("psi_a"), F.col("phi_b"), F.col("psi_b"))
    rows = pairs.withColumn("torus", torus).filter("torus is not null")
    if same_letter:
        rows = rows.filter("aa_a = aa_b and aa_a not in ('-', 'X')")
    cell = F.least(F.floor(F.col("torus") / (SQRT8 / cells)), F.lit(cells - 1)).cast("bigint") + 1
    # One pass: counts per (bin, cell) are few, so both tables come from them.
    counts = cut(
        rows.groupBy("lower", "upper", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.sum("torus").alias("_s"))
    )
    bins = counts.groupBy("lower", "upper").agg(F.sum("n").alias("n"), (F.sum("_s") / F.sum("n")).alias("mean"))
    density = counts.join(bins.select("lower", F.col("n").alias("_all")), "lower").select(
        "lower", "cell", "n", (F.col("n") / F.col("_all") / (SQRT8 / cells)).alias("density")
    )
    return bins, density


def radius_benchmark(distances: DataFrame, keys: Sequence[str], radii: Sequence[float] = (0.25, 0.5, 1.0, 1.5, 2.0)) -> DataFrame:
    """Mean, median and percent of distances within each radius.

    The share is count / (n - 1), at most 100, as in the published table; null when n is 1.
    """
    aggs = [F.count("distance").alias("n"), F.avg("distance").alias("mean")]
    aggs += [F.sum((F.col("distance") <= r).cast("bigint")).alias(f"_w{i}") for i, r in enumerate(radii)]
    median = exact_percentiles(distances, keys, "distance", {"median": 0.5})
    found = distances.groupBy(*keys).agg(*aggs).join(median, list(keys))

    def share(i: int) -> Column:
        return F.when(F.col("n") > 1, F.least(F.lit(1.0), F.col(f"_w{i}") / (F.col("n") - 1)) * 100.0)

    return found.select(
        *keys, "n", "mean", "median", *[share(i).alias("within_" + str(r).replace(".", "_")) for i, r in enumerate(radii)]
    )


def percentile_rank_of(df: DataFrame, keys: Sequence[str], value: str, x: Column, least: int = 5) -> DataFrame:
    """Share of values below x, -1 when there are ``least`` or fewer."""
    return df.groupBy(*keys).agg(
        F.when(F.count(value) > least, F.avg((F.col(value) < x).cast("double"))).otherwise(-1.0).alias("rank")
    )


def mann_whitney(df: DataFrame, x: str, group: str, first: str, second: str) -> DataFrame:
    """U of the first group and z, ties at their average rank and uncorrected in z.

    Equal values are counted before ranking. The running count goes over
    distinct values in blocks, so no task sorts the whole column.
    """
    from .ordered import running

    rows = df.filter(F.col(x).isNotNull() & F.col(group).isin(first, second))
    counts = rows.groupBy(F.col(x).alias("_x")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum((F.col(group) == first).cast("bigint")).alias("_n1")
    ).withColumn("_all", F.lit(0))
    ranked = running(counts, ["_all"], "_x", {"_upto": ("sum", F.col("_n"))})
    rank = F.col("_upto") - (F.col("_n") - 1) / 2.0
    sums = ranked.agg(
        F.sum(F.col("_n1")).alias("n1"), F.sum(F.col("_n") - F.col("_n1")).alias("n2"), F.sum(F.col("_n1") * rank).alias("_r")
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    total = n1 + n2
    u = F.col("_r") - n1 * (n1 + 1.0) / 2.0
    sd = F.sqrt(n1 * n2 / (total * (total - 1.0)) * (total * total * total - total) / 12.0)
    return sums.select("n1", "n2", u.alias("u"), ((u - n1 * n2 / 2.0) / sd).alias("z"))


Where = Callable[[Column, Column], Column]


def torsion_histogram(sites: DataFrame, n: int, where: Where | None = None, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Counts on an n x n grid of (phi, psi): (x, y, n, share, of_max).

    A cell is the nearest of n grid points, halves to even. ``where`` gets the
    residue and the next residue as Columns and gives a condition.
    """
    if where is not None:
        sites = neighbour(
            sites.select("family", "protein", "col", "aa", "phi", "psi"),
            ["family", "protein"], "col", {"_next": "aa"}, 1, rows_per_block,
        ).filter(where(F.col("aa"), F.col("_next")))

    def cell(a: str) -> Column:
        return F.rint(1.0 + (pimod(F.col(a)) + math.pi) / TWO_PI * (n - 1)).cast("bigint")

    # At most n * n rows from here on.
    counts = cut(
        sites.filter("phi is not null and psi is not null")
        .groupBy(cell("phi").alias("x"), cell("psi").alias("y"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    both = counts.agg(F.sum("n").alias("_all"), F.max("n").alias("_max"))
    return counts.join(F.broadcast(both)).select(
        "x", "y", "n", (F.col("n") / F.col("_all")).alias("share"), (F.col("n") / F.col("_max")).alias("of_max")
    )


def torus_smooth(grid: DataFrame, n: int, value: str = "n", dim: int = 13, scale: float = 2.0) -> DataFrame:
    """Average of grid cells (x, y in 1..n) with a Cauchy kernel that wraps at the edges."""
    half = dim // 2
    offsets = F.sequence(F.lit(-half), F.lit(half))
    spread = grid.select("x", "y", F.col(value).cast("double").alias("_v"), F.explode(offsets).alias("dx")).select(
        "*", F.explode(offsets).alias("dy")
    )

    def weight(d: Column) -> Column:
        return 1.0 / (1.0 + (d / scale) * (d / scale))

    one = sum(1.0 / (1.0 + (k / scale) ** 2) for k in range(-half, half + 1))
    moved = spread.select(
        (F.pmod(F.col("x") + F.col("dx") - 1, F.lit(n)) + 1).cast("bigint").alias("x"),
        (F.pmod(F.col("y") + F.col("dy") - 1, F.lit(n)) + 1).cast("bigint").alias("y"),
        (F.col("_v") * weight(F.col("dx")) * weight(F.col("dy")) / (one * one)).alias("_w"),
    )
    return moved.groupBy("x", "y").agg(F.sum("_w").alias("value"))


# --- structures -----------------------------------------------------------


def backbone_geometry(atoms: DataFrame) -> DataFrame:
    """phi, psi, omega, three bond angles and three lengths per residue.

    ``atoms(pdb, chain, resnum, resname, atom, x, y, z, bfactor)``. A missing atom gives
    null. Where there are such columns, models are chains of their own and a residue is
    a number with an insertion code (``model``, ``icode``; both are returned). Of alternate
    locations an atom has the one of greatest ``occupancy``, the least ``altloc`` on ties, and
    the letter goes with the CA (else N, C).

    A neighbour is the residue before or after in the file (``line_no``), else by
    number and code, if the number differs by at most one. All works on one shuffle
    by chain: a chain has at most as many residues as the format has numbers. Rows with
    ``line_no`` come dealt out by structure from ``parse_atoms`` and are not dealt again.
    """
    has = lambda *names: [c for c in names if c in atoms.columns]
    chain = ["pdb", *has("model"), "chain"]
    keys = [*chain, "resnum", *has("icode")]
    value = F.struct("x", "y", "z", "bfactor", "resname")
    rank = F.struct(*[F.col(c) for c in has("occupancy")], *[-F.ascii(c) for c in has("altloc")], "x", "y", "z")
    three = ("N", "CA", "C")
    cols = [F.max_by(value, F.when(F.col("atom") == a, rank)).alias(f"_{a}") for a in three]
    at = [F.min("line_no").alias("_line")] if has("line_no") else []
    dealt = atoms if at else atoms.repartition(*chain)
    res = dealt.groupBy(*keys).agg(F.min("resname").alias("_resname"), *cols, *at)
    found = lambda a, f: F.col(f"_{a}")[f]
    res = res.select(
        *keys, *(["_line"] if at else []),
        F.coalesce(*[found(a, "resname") for a in ("CA", "N", "C")], "_resname").alias("resname"),
        *[F.when(F.col(f"_{a}").isNotNull(), F.struct(*[found(a, v) for v in "xyz"])).alias(a) for a in three],
        *[found(a, "bfactor").alias(f"b_{a.lower()}") for a in three],
    )
    order = ["_line"] if at else ["resnum", *[F.coalesce(c, F.lit("")) for c in has("icode")]]
    along = Window.partitionBy(*chain).orderBy(*order)
    before = (F.col("resnum") - F.lag("resnum").over(along)).between(0, 1)
    after = (F.lead("resnum").over(along) - F.col("resnum")).between(0, 1)
    j = res.select(
        "*",
        *[F.when(before, F.lag(a).over(along)).alias(f"p{a}") for a in ("CA", "C")],
        F.when(after, F.lead("N").over(along)).alias("nN"),
    )
    # Bonds and their normals become plain columns once, and nulls pass through
    # the arithmetic, so each angle is a short expression on them.
    bonds = {"v0": ("pC", "pCA"), "v1": ("N", "pC"), "v2": ("CA", "N"), "v3": ("C", "CA"), "v4": ("nN", "C")}
    j = j.withColumns(
        {f"{v}{k}": d for v, (to, at) in bonds.items() for k, d in zip("xyz", minus(F.col(to), F.col(at)))}
    )

    def vec(name: str):
        return tuple(F.col(f"{name}{k}") for k in "xyz")

    normals = {"n0": ("v0", "v1"), "n1": ("v1", "v2"), "n2": ("v2", "v3"), "n3": ("v3", "v4")}
    j = j.withColumns(
        {f"{n}{k}": c for n, (u, v) in normals.items() for k, c in zip("xyz", cross(vec(u), vec(v)))}
    )

    def length(v: str) -> Column:
        return F.sqrt(dot(vec(v), vec(v)))

    return j.select(
        *keys,
        residue_code(F.col("resname")).alias("aa"),
        twist(vec("v1"), vec("v2"), vec("n1"), vec("n2")).alias("phi"),
        twist(vec("v2"), vec("v3"), vec("n2"), vec("n3")).alias("psi"),
        twist(vec("v0"), vec("v1"), vec("n0"), vec("n1")).alias("omega"),
        bend(vec("v0"), vec("v1")).alias("ba1"),
        bend(vec("v1"), vec("v2")).alias("ba2"),
        bend(vec("v2"), vec("v3")).alias("ba3"),
        length("v1").alias("bl1"),
        length("v2").alias("bl2"),
        length("v3").alias("bl3"),
        "b_n", "b_ca", "b_c",
    )


def fill_missing_residues(residues: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Number gaps become X rows with nulls, from min(1, first number) on."""
    chain = ["pdb", "chain"]
    seen = neighbour(residues.select(*chain, "resnum"), chain, "resnum", {"_prev": "resnum"}, -1, rows_per_block)
    start = F.coalesce(F.col("_prev") + 1, F.least(F.lit(1), F.col("resnum")))
    gaps = (
        seen.withColumn("_from", start)
        .filter(F.col("_from") < F.col("resnum"))
        .select(*chain, F.explode(F.sequence(F.col("_from"), F.col("resnum") - 1)).alias("resnum"))
        .withColumn("aa", F.lit("X"))
    )
    return residues.unionByName(gaps, allowMissingColumns=True)


def longest_chain(residues: DataFrame) -> DataFrame:
    """The chain with most residues of each structure, first letter on ties."""
    counts = residues.groupBy("pdb", "chain").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("pdb").agg(F.min_by(F.struct("chain", "n"), F.struct((-F.col("n")).alias("m"), "chain")).alias("_b"))
    return best.select("pdb", F.col("_b")["chain"].alias("chain"), F.col("_b")["n"].alias("n"))


def structure_quality(lines: DataFrame) -> DataFrame:
    """First resolution, R value and free R value per structure (-1 if none), and
    whether TITLE, SOURCE, REMARK and COMPND lines are free of keywords."""
    from torsia.functions.letters import has_unnatural_word

    line = F.col("line")

    # A remark holds its number in columns 8 to 10 and its text from there on.
    remark = F.when(line.startswith("REMARK"), F.trim(F.substring(line, 11, 200)))
    after_colon = F.substring_index(remark, ":", -1)

    def first(label: str, text: Column, name: str) -> Column:
        found = F.when(remark.startswith(label), F.regexp_extract(F.trim(text), r"^\d*\.?\d+", 0))
        value = found.try_cast("double")
        return F.coalesce(F.min_by(value, F.when(value.isNotNull(), F.col("line_no"))), F.lit(-1.0)).alias(name)

    head = F.trim(line).rlike("^(TITLE|SOURCE|REMARK|COMPND)")
    return lines.groupBy("pdb").agg(
        first("RESOLUTION.", F.when(remark.contains("ANGSTROMS"), F.substring_index(remark, "RESOLUTION.", -1)), "resolution"),
        first("R VALUE", F.when(remark.contains(":"), after_colon), "rvalue"),
        first("FREE R VALUE ", F.when(remark.contains(":"), after_colon), "freervalue"),
        (~F.bool_or(head & has_unnatural_word(line))).alias("valid"),
    )


# --- predictions against truth --------------------------------------------


def nearest_named(dist: DataFrame, targets: DataFrame, others: DataFrame) -> DataFrame:
    """Closest other protein of each target by ``dist(a, b, distance)``.

    ``targets(a)``, ``others(b, rank)``: first in the list on ties, nulls if no
    other has a distance.
    """
    near = (
        dist.join(others.select("b", "rank"), "b")
        .groupBy("a")
        .agg(F.min_by(F.struct("b", "distance"), F.struct("distance", "rank")).alias("_near"))
    )
    return targets.select("a").join(near, "a", "left").select(
        "a", F.col("_near")["b"].alias("nearest"), F.col("_near")["distance"].alias("distance")
    )


def fallback_angles(truth: DataFrame, homolog: DataFrame, samples: DataFrame) -> DataFrame:
    """Per iteration and column, distance to the homolog's angles where it has them,
    else to the sample's. All need (protein, col, phi, psi); samples also ``iter``."""
    keys = ["protein", "col"]

    def named(df: DataFrame, s: str, *more: str) -> DataFrame:
        return df.select(*keys, *more, F.col("phi").alias(f"phi_{s}"), F.col("psi").alias(f"psi_{s}"))

    j = (
        named(samples, "s", "iter")
        .join(named(truth, "t"), keys)
        .join(named(homolog, "h"), keys, "left")
    )
    to_h = torus_distance(F.col("phi_t"), F.col("psi_t"), F.col("phi_h"), F.col("psi_h"))
    to_s = torus_distance(F.col("phi_t"), F.col("psi_t"), F.col("phi_s"), F.col("psi_s"))
    return j.select(*keys, "iter", F.coalesce(to_h, to_s).alias("distance")).filter("distance is not null")


def residual_vs_bfactor(sites: DataFrame, centres: DataFrame) -> DataFrame:
    """Torus distance of each site to the centre of its state, beside its temperature factor."""
    j = sites.join(centres.select("state", "mu_phi", "mu_psi"), "state")
    d = torus_distance(F.col("phi"), F.col("psi"), F.col("mu_phi"), F.col("mu_psi"))
    return j.select("family", "protein", "col", "state", "b_ca", d.alias("distance")).filter("distance is not null")
