"""Angles, geometry and structure text on values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from torsia.functions import angles as A
from torsia.operators import circular as C
from torsia.sources import structures


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


def test_torus_distance_edges(spark):
    lit = F.lit
    assert one(spark, A.torus_distance(lit(1.0), lit(2.0), lit(1.0), lit(2.0))) == 0.0
    far = one(spark, A.torus_distance(lit(0.0), lit(0.0), lit(math.pi), lit(math.pi)))
    assert abs(far - math.sqrt(8.0)) < 1e-12
    assert one(spark, A.torus_distance(lit(None).cast("double"), lit(0.0), lit(0.0), lit(0.0))) is None


def test_pimod_edges(spark):
    got = [one(spark, A.pimod(F.lit(v))) for v in (-math.pi, 0.0, math.pi, 3 * math.pi)]
    assert [round(v, 9) for v in got] == [round(v, 9) for v in (math.pi, 0.0, math.pi, math.pi)]


def test_circular_mean_across_zero(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", -0.1), ("b", 3.0)], "k string, t double")
    got = {r.k: r.mean for r in C.circular_mean(df, ["k"], "t").collect()}
    assert min(got["a"], 2 * math.pi - got["a"]) < 1e-9 and abs(got["b"] - 3.0) < 1e-9


def atoms(spark, rows):
    return spark.createDataFrame(rows, "pdb string, chain string, resnum bigint, resname string, atom string, x double, y double, z double, bfactor double")


def test_flat_backbone(spark):
    # All atoms in a plane, zig-zag: every torsion is 180 degrees.
    zigzag = [(float(i), float(i % 2), 0.0) for i in range(9)]
    rows = [("p", "A", i // 3 + 1, "GLY", ("N", "CA", "C")[i % 3], *p, 1.0) for i, p in enumerate(zigzag)]
    got = {r.resnum: r for r in C.backbone_geometry(atoms(spark, rows)).collect()}
    assert abs(abs(got[2].phi) - math.pi) < 1e-9 and abs(abs(got[2].psi) - math.pi) < 1e-9
    assert abs(got[2].ba3 - math.pi / 2) < 1e-9 and abs(got[2].bl2 - math.sqrt(2)) < 1e-9
    assert got[1].phi is None and got[3].psi is None


def test_number_gap_and_missing_atom(spark):
    rows = [("p", "A", n, "ALA", a, float(n), float(k * k), float(k), 0.0) for n in (3, 4, 6) for k, a in enumerate(("N", "CA", "C")) if (n, a) != (4, "CA")]
    geo = C.backbone_geometry(atoms(spark, rows))
    got = {r.resnum: r for r in geo.collect()}
    assert got[4].phi is None and got[6].phi is None and got[4].bl1 is not None
    filled = {r.resnum: r.aa for r in C.fill_missing_residues(geo).collect()}
    assert filled == {1: "X", 2: "X", 3: "A", 4: "A", 5: "X", 6: "A"}


def test_structure_quality_first_value_wins(spark):
    lines = [
        "REMARK   2 RESOLUTION.    1.80 ANGSTROMS.", "REMARK   2 RESOLUTION.    9.90 ANGSTROMS.",
        "REMARK   3   R VALUE            (WORKING SET) : 0.180", "REMARK   3   FREE R VALUE                     : 0.22", "ATOM   MUTANT",
    ]
    rows = [("ok", i, s) for i, s in enumerate(lines)] + [("bad", 0, "TITLE     A MUTANT THING"), ("bad", 1, "REMARK nothing")]
    got = {r.pdb: r for r in C.structure_quality(spark.createDataFrame(rows, "pdb string, line_no int, line string")).collect()}
    assert (got["ok"].resolution, got["ok"].rvalue, got["ok"].freervalue, got["ok"].valid) == (1.8, 0.18, 0.22, True)
    assert (got["bad"].resolution, got["bad"].valid) == (-1.0, False)


def test_atom_line(spark):
    line = "ATOM      2  CA AGLY A  12A     11.104  -6.134   2.500  1.00 13.50           C"
    hetero = "HETATM    9  O   HOH B 301      0.000   0.000   0.000  1.00  5.00           O"
    got = structures.parse_atoms(spark.createDataFrame([("p", line), ("p", hetero), ("p", "TER")], "pdb string, line string")).collect()
    assert len(got) == 2
    a = next(r for r in got if not r.hetero)
    assert (a.atom, a.resname, a.chain, a.resnum, a.icode, a.x, a.y, a.bfactor) == ("CA", "GLY", "A", 12, "A", 11.104, -6.134, 13.5)


def test_divergence_bins_are_half_open(spark):
    sites = spark.createDataFrame(
        [("f", p, 1, "A", x, 0.0) for p, x in (("a", 0.0), ("b", 1.0), ("c", 2.0))],
        "family string, protein string, col bigint, aa string, phi double, psi double",
    )
    dist = spark.createDataFrame([("f", "a", "b", 0.1), ("f", "a", "c", 0.04), ("f", "b", "c", 99.0)], "family string, a string, b string, distance double")
    bins, density = C.distance_by_divergence(sites, dist)
    got = {r.lower: r.n for r in bins.collect()}
    assert got == {0.1: 1, 1.6: 1}
    assert density.count() == 2


@pytest.mark.parametrize("n", [1, 4])
def test_radius_share(spark, n):
    df = spark.createDataFrame([("k", 0.1 * i) for i in range(n)], "k string, distance double")
    r = C.radius_benchmark(df, ["k"]).head()
    assert r.within_2_0 is None if n == 1 else r.within_2_0 == 100.0


def test_models_locations_and_insertions(spark):
    def line(name, alt, res, num, code, x, share, b=1.0):
        return f"ATOM  {1:5d}  {name:<3}{alt}{res} A{num:4d}{code}   {x:8.3f}{0:8.3f}{0:8.3f}{share:6.2f}{b:6.2f}"

    text = [line(a, " ", "GLY", 52, " ", k, 1) for k, a in enumerate(("N", "CA", "C"))]
    text += [line("N", " ", "ALA", 52, "A", 4, 1), line("CA", "B", "SER", 52, "A", 6, 0.3), line("CA", "A", "ALA", 52, "A", 5, 0.7, 9.0)]
    text += [line("C", " ", "ALA", 52, "A", 7, 1)] + [line(a, " ", "TRP", 53, " ", 9 + k, 1) for k, a in enumerate(("N", "CA", "C"))]
    text += ["MODEL        2"] + [line(a, " ", "LYS", 52, " ", 50 + k, 1) for k, a in enumerate(("N", "CA", "C"))]
    rows = [("p", k, t) for k, t in enumerate(text)] + [("q", 1, text[0])]
    for block in (4, 1000):
        atoms = structures.parse_atoms(spark.createDataFrame(rows, "pdb string, line_no bigint, line string"), block)
        got = {(r.pdb, r.model, r.resnum, r.icode): r for r in C.backbone_geometry(atoms).collect()}
        assert sorted(got) == [("p", 1, 52, ""), ("p", 1, 52, "A"), ("p", 1, 53, ""), ("p", 2, 52, ""), ("q", 1, 52, "")]
        inserted = got[("p", 1, 52, "A")]
        assert (inserted.aa, inserted.bl1, inserted.bl2, inserted.b_ca) == ("A", 2.0, 1.0, 9.0)
        assert got[("p", 1, 53, "")].bl1 == 2.0 and got[("p", 2, 52, "")].bl1 is None and got[("p", 2, 52, "")].aa == "K"
        first = structures.first_model(atoms)
        assert first.filter("pdb = 'p' and model = 1").count() == 10 and first.count() == 11
    plan = C.backbone_geometry(spark.createDataFrame([("p", "A", 1, "GLY", "N", 0.0, 0.0, 0.0, 1.0)], "pdb string, chain string, resnum bigint, resname string, atom string, x double, y double, z double, bfactor double"))
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
