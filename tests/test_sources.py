"""Files read and written on small fixtures."""

import json

from pyspark.sql import functions as F

from torsia import session
from torsia.operators import events as E
from torsia.sources import families, fasta, structures, tables, text
from __spark_entry__ import queries
from torsia.sources.text import ordered_text


def test_fasta_records(spark, tmp_path):
    (tmp_path / "x.fas").write_text(">one desc a>b\nAC\nde-\n>empty\n>two\nFF")
    got = [(r.seq_no, r.name, r.sequence) for r in fasta.read_fasta(spark, str(tmp_path / "x.fas")).orderBy("seq_no").collect()]
    assert got == [(1, "one desc a>b", "ACde-"), (2, "empty", ""), (3, "two", "FF")]


def test_fasta_lines(spark, tmp_path):
    (tmp_path / "db.txt").write_text(">1abc_A mol:protein\nACD\nEFG\n>2abc_B\nHIK\n")
    got = [(r.name, r.sequence) for r in fasta.read_fasta(spark, str(tmp_path / "db.txt"), lines=True, rows_per_block=2).orderBy("seq_no").collect()]
    assert got == [("1abc_A mol:protein", "ACD"), ("1abc_A mol:protein", "EFG"), ("2abc_B", "HIK")]


def test_line_numbers_over_splits(spark, tmp_path):
    (tmp_path / "long.txt").write_text("\n".join(f"line {i}" for i in range(1, 5001)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = text.ordered_text(spark, str(tmp_path / "long.txt"))
        assert df.filter(F.concat(F.lit("line "), F.col("no").cast("string")) != F.col("line")).count() == 0
        assert df.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def protein(name, seq, aligned, phi_psi):
    return {"name": name, "sequence": seq, "aligned_sequence": aligned, "aligned_phi_psi": phi_psi, "aligned_omega": [3.0] * len(aligned)}


def test_family_documents(spark, tmp_path):
    missing = [-1000.0, -1000.0]
    doc = {"newick_tree": "(a:1);", "proteins": [protein("a", "AC", "A-C", [[0.5, -1000.0], missing, [4.0, 1.0]])]}
    (tmp_path / "f1.fam").write_text(json.dumps(doc, indent=1))
    (tmp_path / "old.fam").write_text(json.dumps([protein("b", "D", "D", [missing])]))
    (tmp_path / "note.txt").write_text("no family")
    rows = families.read_families(spark, str(tmp_path))
    assert sorted((r.family, r["name"], r.seq_no) for r in rows.collect()) == [("f1", "a", 1), ("old", "b", 1)]
    got = {(r.protein, r.col): r for r in families.sites(rows).collect()}
    assert len(got) == 4
    first, last = got[("a", 1)], got[("a", 3)]
    assert first.phi == 0.5 and first.psi is None and first.phi_observed and not first.psi_observed
    assert abs(last.phi - (4.0 - 6.283185307179586)) < 1e-12 and last.b_ca is None
    assert got[("b", 1)].phi is None and got[("a", 2)].aa == "-"


def test_pair_masks(spark, tmp_path):
    record = ">1\nAC\nDEF\n0.1,0.2\n1.1,1.2\n0.3,0.4,-1000\n1.3,1.4,1.5\nHE\nHHH\n#.#\n###\n"
    (tmp_path / "pairs.txt").write_text(record)
    got = {(r.side, r.col): (r.aa, r.phi, r.ss) for r in structures.read_pairs(spark, str(tmp_path / "pairs.txt")).collect()}
    assert got == {
        (1, 1): ("A", 0.1, "H"), (1, 2): (None, None, None), (1, 3): ("C", 0.2, "E"),
        (2, 1): ("D", 0.3, "H"), (2, 2): ("E", 0.4, "H"), (2, 3): ("F", None, "H"),
    }


def test_header_files(spark, tmp_path):
    (tmp_path / "fam1.ali").write_text(">P1;1ABCa\nx\n>P1;2xyz\n")
    (tmp_path / "fam2.ali").write_text(">P1;3abc\n")
    got = sorted((r.family, r.pdb, r.chain) for r in structures.read_alignment_headers(spark, str(tmp_path)).collect())
    assert got == [("fam1", "1abc", "A"), ("fam1", "2xyz", "")]


def test_traces_by_blanks_and_run_from_file(spark, tmp_path):
    (tmp_path / "one.log").write_text("# sampler\n\niter  alpha   beta\n 1  0.5  2\n2   1e-3  nan\n")
    (tmp_path / "two.b.log").write_text("beta\titer\tlog lik\n7\t1\t-3.5\n\t2\t-4\n")
    got = {(r.run, r.iter, r.param): r.value for r in tables.read_trace(spark, str(tmp_path), run=None).collect()}
    assert str(got.pop(("one", 2, "beta"))) == "nan"
    assert got == {
        ("one", 1, "alpha"): 0.5, ("one", 1, "beta"): 2.0, ("one", 2, "alpha"): 0.001,
        ("two.b", 1, "beta"): 7.0, ("two.b", 1, "log lik"): -3.5, ("two.b", 2, "log lik"): -4.0,
    }


def test_trace_columns_found_at_run_time(spark, tmp_path):
    long = spark.createDataFrame([(1, "p", 1.0), (1, "q", 2.0), (2, "p", 3.0)], "iter bigint, param string, value double")
    path = str(tmp_path / "t")
    tables.write_trace(tables.trace_wide(long), path)
    got = sorted((r.iter, r.param, r.value) for r in tables.read_trace(spark, path).collect())
    assert got == [(1, "p", 1.0), (1, "q", 2.0), (2, "p", 3.0)]


def test_kept_tail_sizes(spark):
    rows = [(str(n), i, float(i)) for n in (1, 2, 3, 10) for i in range(1, n + 1)]
    trace = spark.createDataFrame(rows, "run string, iter bigint, value double")
    for parts, want in ((2, {"1": 1, "2": 2, "3": 3, "10": 6}), (3, {"1": 1, "2": 2, "3": 3, "10": 8})):
        got = {r.run: r["count"] for r in E.kept_tail(trace, ["run"], parts, 4).groupBy("run").count().collect()}
        assert got == want


def test_equal_times_in_tracks(spark):
    rows = [("b", "x", 1, 0.0, 1), ("b", "y", 1, 0.0, 7), ("b", "x", 1, 0.5, 2), ("b", "y", 1, 0.5, 8)]
    jumps = spark.createDataFrame(rows, "node string, track string, col bigint, t double, state int")
    got = [(r.t, r.track, r.state_x, r.state_y) for r in E.interleave_tracks(jumps, ["node"], ("x", "y")).orderBy("t", F.desc("track")).collect()]
    assert (0.5, "y", 1, 8) in got and (0.5, "x", 2, 8) in got and got[-1][0] == 1.0 and got[-1][1] is None


def test_shared_folder_is_the_sessions(spark):
    assert session.scratch_path(spark, "a").startswith(session.shared_dir(spark))
    assert session.scratch_path(spark, "a") != session.scratch_path(spark, "a")


def test_numbering_text_does_not_shuffle_it(spark, tmp_path):
    path = str(tmp_path / "text")
    spark.range(20000).selectExpr("concat(id, repeat('x', 50)) AS value").coalesce(1).write.text(path)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        out = ordered_text(spark, path)
        assert [r["line"][: len(str(r["no"] - 1))] for r in out.orderBy("no").limit(3).collect()] == ["0", "1", "2"]
        assert "SortMergeJoin" not in out._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_models_start_before_their_lines(spark, tmp_path):
    """Lines of two models of each structure as text and back; a line without a number stays before the first model."""
    rows = spark.sql("SELECT * FROM VALUES (7L, 2L, 5.0D, 'F'), (7L, 1L, 4.0D, 'O'), (7L, 1L, 3.0D, 'P'), (8L, 3L, 1.0D, 'O') t(l_orderkey, l_linenumber, l_quantity, l_linestatus)")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    found = queries()["structure_models"](spark, str(tmp_path))
    got = sorted((r["pdb"], r["model"], r["resnum"], r["icode"], r["aa"]) for r in found.collect())
    assert got == [(7, 1, 1, "", "G"), (7, 1, 1, "A", "S"), (7, 2, 1, "", "G"), (7, 2, 1, "A", "S"), (8, 1, 2, "", "G"), (8, 2, 2, "", "G")]
