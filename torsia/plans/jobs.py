"""Data-set jobs made of the operators. Alignments and trees are inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torsia.functions.angles import MISSING
from torsia.functions.letters import RESIDUES, canonical, structure_name, upper_ascii
from torsia.operators import trees as trees_ops
from torsia.operators.circular import backbone_geometry, fill_missing_residues, longest_chain, structure_quality
from torsia.operators.columns import constrained_subset, position_map
from torsia.operators.filters import blind_marks, hide_marked, quality_pass
from torsia.operators.ordered import ROWS_PER_BLOCK, numbered
from torsia.operators.similarity import (
    best_homologs,
    dedup_exact,
    kmer_counts,
    non_redundant,
    random_entries,
    similar_pairs,
)
from torsia.session import cut
from torsia.sources.structures import first_model

CHAIN = ["pdb", "chain"]


def letters_of(df: DataFrame, keys: Sequence[str], column: str = "aligned_sequence") -> DataFrame:
    """(keys, col, aa): one row per letter of each aligned sequence."""
    letters = F.filter(F.split(column, ""), lambda x: x != "")
    return df.select(*keys, F.posexplode(letters).alias("_i", "aa")).select(
        *keys, (F.col("_i") + 1).cast("bigint").alias("col"), "aa"
    )


def chain_residues(atoms: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Geometry of every chain with number gaps filled and ``pos`` counted from 1; of models only the first."""
    own = atoms.filter(~F.col("hetero")) if "hetero" in atoms.columns else atoms
    own = first_model(own).drop("model") if "model" in own.columns else own
    # Stored: filling and numbering count the rows of a chain first, and each count would deal all atoms out again.
    filled = fill_missing_residues(cut(backbone_geometry(own)), rows_per_block).na.fill("X", ["aa"])
    order = ["resnum", "icode"] if "icode" in filled.columns else "resnum"
    return numbered(filled, CHAIN, order, "pos", rows_per_block)


def chain_sequences(residues: DataFrame) -> DataFrame:
    """(pdb, chain, sequence): a chain is one row, as long as the molecule."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "aa")))
    return residues.groupBy(*CHAIN).agg(F.array_join(F.transform(ordered, lambda x: x["aa"]), "").alias("sequence"))


def build_families(
    alignment: DataFrame, trees: DataFrame, atoms: DataFrame, lines: DataFrame, rows_per_block: int = ROWS_PER_BLOCK,
    residues: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Aligned records to protein rows of family documents, and the records that do not fit.

    ``alignment(family, seq_no, name, aligned_sequence)``, ``trees(family,
    newick_tree)``. A name like ``pdb1abc_A`` points to a structure; if that is
    of good quality its angles are laid on the alignment, else they are missing.
    A record whose letters are not those of the structure keeps no angles and is
    reported. ``residues`` are the ``chain_residues`` of the atoms, if they are stored already.
    """
    pdb, chain = structure_name(F.col("name"))
    named = alignment.withColumns({"pdb": F.nullif(pdb, F.lit("")), "chain": F.nullif(chain, F.lit(""))})
    good = quality_pass(structure_quality(lines).filter("valid")).select("pdb", "resolution", "rvalue", "freervalue")
    if residues is None:
        residues = cut(chain_residues(atoms, rows_per_block))
    known = chain_sequences(residues).withColumnRenamed("sequence", "_structure")
    bare = canonical(F.col("aligned_sequence"))
    matched = cut(
        named.withColumn("sequence", bare)
        .join(good, "pdb", "left")
        .join(known, CHAIN, "left")
        .withColumn("_fits", F.col("rvalue").isNotNull() & F.col("_structure").eqNullSafe(F.col("sequence")))
    )
    unfit = matched.filter(F.col("rvalue").isNotNull() & F.col("_structure").isNotNull() & ~F.col("_fits")).select(
        "family", "name", "sequence", F.col("_structure").alias("structure_sequence")
    )
    cells = position_map(
        letters_of(matched, ["family", "name", "seq_no", "pdb", "chain", "_fits"]).withColumn(
            "protein", F.col("name")
        ),
        rows_per_block,
    )
    angles = residues.drop("aa", "resnum")
    laid = cells.join(
        angles.withColumn("_fits", F.lit(True)), [*CHAIN, "pos", "_fits"], "left"
    )

    def value(c: str, missing: float = MISSING) -> Column:
        return F.coalesce(F.col(c), F.lit(missing))

    cell = F.struct(
        "col", (F.col("aa") != "-").alias("filled"),
        F.array(value("phi"), value("psi")).alias("phi_psi"), value("omega").alias("omega"),
        F.array(*[value(f"ba{i}") for i in (1, 2, 3)]).alias("bond_angles"),
        F.array(*[value(f"bl{i}") for i in (1, 2, 3)]).alias("bond_lengths"),
        value("b_n", 0.0).alias("Ntempfactor"), value("b_ca", 0.0).alias("CAtempfactor"), value("b_c", 0.0).alias("Ctempfactor"),
    )
    # One protein per row: an array as long as the alignment is wide.
    arrays = laid.groupBy("family", "name").agg(F.array_sort(F.collect_list(cell)).alias("_cells"))
    fields = ("phi_psi", "omega", "bond_angles", "bond_lengths", "Ntempfactor", "CAtempfactor", "Ctempfactor")
    out = matched.join(arrays, ["family", "name"]).join(trees, "family", "left")
    filled = F.filter("_cells", lambda x: x["filled"])

    def pick(f: str):
        return lambda x: x[f]

    def known_only(c: str) -> Column:
        return F.when(F.col("_fits"), F.col(c))

    return (
        out.select(
            "family", "newick_tree", "seq_no", "name",
            known_only("pdb").alias("pdb"), known_only("chain").alias("chain"),
            *[known_only(c).alias(c) for c in ("resolution", "rvalue", "freervalue")],
            "sequence", "aligned_sequence",
            *[F.transform(filled, pick(f)).alias(f) for f in fields],
            *[F.transform("_cells", pick(f)).alias(f"aligned_{f}") for f in fields],
        ),
        unfit,
    )


def single_families(entries: DataFrame, atoms: DataFrame, lines: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """One document per screened structure: its longest chain, aligned with itself.

    ``entries(pdb)``; only structures of good quality stay.
    """
    chosen = atoms.join(entries.select("pdb").distinct(), "pdb", "left_semi")
    # Used for the choice, the letters and the angles: stored, or each of them deals all atoms out again.
    residues = cut(chain_residues(chosen, rows_per_block))
    best = longest_chain(residues).select(*CHAIN)
    kept = chain_sequences(residues).join(best, CHAIN, "left_semi")
    name = F.concat(F.lit("pdb"), "pdb", F.lit("_"), "chain")
    alignment = kept.select(
        F.concat("pdb", "chain").alias("family"), F.lit(1).cast("bigint").alias("seq_no"), name.alias("name"),
        F.col("sequence").alias("aligned_sequence"),
    )
    trees = alignment.select("family", F.concat(F.lit("("), "name", F.lit(":0.00000);")).alias("newick_tree"))
    rows, _ = build_families(alignment, trees, chosen, lines, rows_per_block, residues)
    return rows.filter("rvalue is not null")


def curate_families(
    headers: DataFrame, atoms: DataFrame, lines: DataFrame, alignment: DataFrame, trees: DataFrame,
    least_aligned: float = 0.90, least_identity: float = 0.05, most_identity: float = 0.95, most: int = 30,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Header lists to documents: one chain per structure, named by quality, a fitting subset per family.

    ``headers(family, pdb, chain)``, blank chain for the longest one;
    ``alignment(family, pdb, chain, aligned_sequence)``.
    """
    residues = cut(chain_residues(atoms, rows_per_block))
    longest = longest_chain(residues).select("pdb", F.col("chain").alias("_longest"))
    named = headers.join(longest, "pdb").withColumn(
        "chain", F.when(F.col("chain") == "", F.col("_longest")).otherwise(F.col("chain"))
    )
    first = named.groupBy("family", "pdb").agg(F.min("chain").alias("chain"))
    good = quality_pass(structure_quality(lines).filter("valid")).select("pdb", F.lit(True).alias("_good"))
    prefix = F.when(F.coalesce(F.col("_good"), F.lit(False)), "pdb").otherwise("seq")
    members = cut(
        first.join(alignment, ["family", *CHAIN])
        .join(good, "pdb", "left")
        .select(
            "family", F.concat(prefix, "pdb", F.lit("_"), "chain").alias("protein"), "aligned_sequence", *CHAIN,
            (~F.coalesce(F.col("_good"), F.lit(False))).cast("int").alias("_later"),
        )
    )
    # Structures first, then by name: a rank that is unique within a family.
    ranked = members.withColumn("rank", F.struct("_later", "protein"))
    cells = letters_of(members, ["family", "protein"])
    subset = constrained_subset(cells, ranked, least_aligned, least_identity, most_identity, most)
    chosen = members.join(subset.select("family", "protein"), ["family", "protein"], "left_semi")
    numbered_rows = chosen.select(
        "family", F.xxhash64("protein").alias("seq_no"), F.col("protein").alias("name"), "aligned_sequence"
    )
    # Only chains of chosen members are laid out.
    met = residues.join(members.join(subset, ["family", "protein"], "left_semi").select(*CHAIN).distinct(), CHAIN, "left_semi")
    rows, _ = build_families(numbered_rows, trees, atoms, lines, rows_per_block, cut(met))
    return rows


def random_families(
    entries: DataFrame, n: int = 250, keep: Sequence[int] = (0,), min_len: int = 100, apart: float = 0.1,
    k2: float = 0.2, k3: float = 0.2,
) -> tuple[DataFrame, DataFrame]:
    """Families around screened seeds: (seed_no, members), and family counts by size.

    Seeds are sampled, screened and kept apart; every entry goes to the seed it
    is most like, so families share no entry. ``entries(seq_no, name,
    description, pdb, sequence, rvalue, freervalue)``.
    """
    seeds = cut(random_entries(entries, n, keep, min_len))
    texts = seeds.select(F.col("seq_no").alias("id"), "sequence")
    apart_seeds = non_redundant(seeds, similar_pairs(texts, texts, 3, apart, self_join=True), structure="pdb")
    queries = cut(apart_seeds.select(F.col("seq_no").alias("query_no"), "sequence"))
    plain = entries.select("seq_no", "name", "pdb", "sequence")
    hits = best_homologs(plain, queries, k2, k3)
    quality = entries.select("seq_no", "rvalue", "freervalue")
    good = (F.col("rvalue") > 0) & (F.col("rvalue") < 0.25) & (F.col("freervalue") > 0) & (F.col("freervalue") < 0.25)
    members = cut(hits.join(quality, "seq_no").select(
        F.col("query_no").alias("seed_no"), "seq_no", "pdb", "score3", good.alias("has_structure")
    ))
    sizes = members.groupBy("seed_no").agg(
        F.sum(F.col("has_structure").cast("bigint")).alias("structures"),
        F.sum((~F.col("has_structure")).cast("bigint")).alias("sequences"),
    )
    return members, sizes.groupBy("structures", "sequences").agg(F.count(F.lit(1)).alias("families"))


def kmer_vectors(df: DataFrame, k: int = 2) -> DataFrame:
    """(id, vector): shares of all 20^k words as one dense row."""
    shares = kmer_counts(df, k, "clean", share=True)
    place = F.lit(0)
    for i in range(1, k + 1):
        place = place * 20 + (F.instr(F.lit(RESIDUES), F.substring("kmer", i, 1)) - 1)
    found = shares.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(place.cast("int"), "n"))).alias("_m"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(20**k - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    return found.select("id", cells.alias("vector"))


def representatives(sequences: DataFrame, nodes: DataFrame, n: int, k: int = 2, least_support: float = 0.99) -> DataFrame:
    """Pruned tree of n spread-out, well-supported representatives.

    ``sequences(seq_no, name, sequence)``, ``nodes`` with names and support. At
    most n leaves are left after the spread selection, so the pairs tested for
    support are bounded by the parameter.
    """
    distinct = cut(dedup_exact(sequences.select("seq_no", "name", "sequence")))
    first = distinct.agg(F.min("seq_no")).head()[0]
    vectors = cut(kmer_vectors(distinct.select(F.col("seq_no").alias("id"), "sequence"), k))
    start = vectors.filter(F.col("id") >= first).agg(F.min("id")).head()[0]
    picked = trees_ops.spread_selection(vectors, n, start)
    chosen = picked.join(distinct, picked["id"] == distinct["seq_no"]).select("rank", "name")
    bound, _ = trees_ops.bind_leaves(nodes, chosen)
    bound = cut(bound.select("tree", "node", "rank"))
    anc = trees_ops.ancestors(nodes)
    pairs = bound.select("tree", F.col("node").alias("a"), F.col("rank").alias("ra")).join(
        bound.select("tree", F.col("node").alias("b"), F.col("rank").alias("rb")), "tree"
    ).filter("ra < rb")
    weak = trees_ops.pair_support(nodes, anc, pairs).filter(F.col("support") < least_support)

    def place(rank: str, node: str) -> Column:
        # A leaf of one tree never stands for that of another.
        return F.struct(F.col(rank).alias("rank"), "tree", F.col(node).alias("node"))

    clash = weak.join(pairs, ["tree", "a", "b"]).select(place("ra", "a").alias("id_a"), place("rb", "b").alias("id_b"))
    kept = non_redundant(bound.select(place("rank", "node").alias("seq_no"), "tree", "node"), clash)
    return trees_ops.prune(nodes, anc, kept.select("tree", "node"))


def load_alignment(sequences: DataFrame, nodes: DataFrame, blinded: DataFrame) -> DataFrame:
    """An alignment without structures as sites bound to the leaves of a tree.

    ``sequences(family, seq_no, name, aligned_sequence)``, ``blinded(protein)``.
    """
    # Marks and leaves are joined to whole sequences; letters are told apart last and never shuffled.
    texts = sequences.select("family", F.col("name").alias("protein"), "seq_no", "aligned_sequence")
    marked = blind_marks(texts, blinded, blinded.limit(0))
    tips = trees_ops.leaves(nodes).select("tree", "node", F.col("name").alias("protein"))
    bound = marked.join(tips, "protein")
    rows = letters_of(bound, ["protein", "family", "seq_no", "_all", "_angles", "tree", "node"])
    hidden = hide_marked(rows.withColumn("aa", upper_ascii(F.col("aa"))))
    return hidden.select("protein", "family", "seq_no", "col", "aa", "tree", "node")
