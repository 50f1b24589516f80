"""Statistics of alignment columns, letters and pairs of aligned proteins."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from torsia.functions.letters import RESIDUES, md5_number
from torsia.session import cut

from .ordered import ROWS_PER_BLOCK, block_count, neighbour, numbered, running
from .quantiles import exact_percentiles

GAP, UNKNOWN = "-", "X"
LETTER_LIST = tuple(RESIDUES)


def is_residue(c: Column) -> Column:
    return c.isin(*LETTER_LIST)


def each_letter(df: DataFrame, name: str = "aa", letters: Sequence[str] = LETTER_LIST) -> DataFrame:
    """Every row once per letter of a fixed alphabet."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(x) for x in letters])))


# --- counts ---------------------------------------------------------------


def category_freqs(
    df: DataFrame, keys: Sequence[str], cat: str, letters: Sequence[str] = LETTER_LIST, pseudo: float = 0.1
) -> DataFrame:
    """Smoothed share of every letter per key: (keys, cat, n, share)."""
    counts = df.filter(F.col(cat).isin(list(letters))).groupBy(*keys, cat).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_t"))
    full = each_letter(totals, cat, letters).join(counts, [*keys, cat], "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    return full.select(
        *keys, cat, n.alias("n"), ((n + pseudo) / (F.col("_t") + pseudo * len(letters))).alias("share")
    )


def leaf_letter_counts(sites: DataFrame) -> DataFrame:
    return sites.filter(is_residue(F.col("aa"))).groupBy("family", "col", "aa").agg(F.count(F.lit(1)).alias("n"))


def column_consensus(samples: DataFrame, keys: Sequence[str] = ("protein",)) -> DataFrame:
    """Most frequent letter per column, first letter on ties, and the string of them.

    Counting comes first, so only one row per (key, column) is gathered.
    """
    counts = samples.filter(is_residue(F.col("aa"))).groupBy(*keys, "col", "aa").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*keys, "col").agg(F.min_by("aa", F.struct((-F.col("n")).alias("m"), "aa")).alias("aa"))
    ordered = F.array_sort(F.collect_list(F.struct("col", "aa")))
    return best.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["aa"]), "").alias("consensus"))


def fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """Hashes of all rows, whatever their order and counting repeats: (rows, hash, total)."""
    cols = columns or df.columns
    row = md5_number(*cols)
    # A xor alone loses equal rows in pairs, so the hashes are summed as well.
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor(row).alias("hash"), F.sum(row.cast("decimal(20,0)")).cast("string").alias("total")
    )


def family_composition(proteins: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per family counts, and the seven classes of families with a total.

    ``proteins(family, protein, has_structure)``, ``sites(family, protein, aa, phi, psi)``.
    """
    members = proteins.groupBy("family").agg(
        F.count(F.lit(1)).alias("sequences"),
        F.sum(F.col("has_structure").cast("bigint")).alias("structures"),
    )
    residue = ~F.col("aa").isin(GAP, UNKNOWN)
    angle = F.col("phi").isNotNull() | F.col("psi").isNotNull()
    counts = sites.groupBy("family").agg(
        F.sum(residue.cast("bigint")).alias("residues"), F.sum(angle.cast("bigint")).alias("angles")
    )
    families = members.join(counts, "family", "left").na.fill(0, ["residues", "angles"])
    s, t = F.col("sequences"), F.col("structures")
    label = (
        F.when((s == 1) & (t == 0), "one sequence")
        .when((s == 2) & (t == 0), "two sequences")
        .when(t == 0, "three or more sequences")
        .when((s == 1) & (t == 1), "one sequence and structure")
        .when(t == 1, "one structure")
        .when(t == 2, "two structures")
        .otherwise("three or more structures")
    )
    families = families.withColumn("class", label)
    classes = (
        families.rollup("class")
        .agg(
            F.count(F.lit(1)).alias("families"),
            F.sum("sequences").alias("sequences"),
            F.sum("structures").alias("structures"),
            F.sum("residues").alias("residues"),
            F.sum("angles").alias("angles"),
        )
        .select(
            F.coalesce("class", F.lit("total")).alias("class"),
            "families",
            "sequences",
            "structures",
            "residues",
            "angles",
            (F.col("residues") / F.col("sequences")).alias("residues_per_sequence"),
            F.when(F.col("structures") > 0, F.col("angles") / F.col("structures")).alias("angles_per_structure"),
        )
    )
    return families, classes


# --- shape of an alignment ------------------------------------------------


def drop_gap_columns(sites: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Remove columns that hold only gaps and number the others from 1.

    Where no family is hot, its rows are dealt out and sorted once and numbered as
    they stand; a hot one has its columns numbered in blocks and joined back.
    """
    if block_count(sites, ["family"], rows_per_block) <= 1:
        column = Window.partitionBy("family", "col")
        held = sites.filter("family is not null").withColumn("_any", F.max((F.col("aa") != GAP).cast("int")).over(column))
        along = Window.partitionBy("family").orderBy("col")
        out = held.filter("_any = 1").withColumn("_new", F.dense_rank().over(along).cast("bigint")).filter("col is not null")
        return out.select(*[F.col("_new").alias("col") if c == "col" else F.col(c) for c in sites.columns])
    kept = (
        sites.groupBy("family", "col")
        .agg(F.max((F.col("aa") != GAP).cast("int")).alias("_any"))
        .filter("_any = 1")
        .select("family", "col")
    )
    renumbered = numbered(kept, ["family"], "col", "_new", rows_per_block)
    out = sites.join(renumbered, ["family", "col"])
    return out.select(*[F.col("_new").alias("col") if c == "col" else F.col(c) for c in sites.columns])


def trim_family(sites: DataFrame) -> DataFrame:
    """Cut the columns before the first and after the last residue of any protein."""
    filled = F.when(~F.col("aa").isin(GAP, UNKNOWN), F.col("col"))
    span = sites.groupBy("family").agg(F.min(filled).alias("_lo"), F.max(filled).alias("_hi"))
    out = sites.join(span, "family").filter(F.col("col").between(F.col("_lo"), F.col("_hi")))
    return out.select(
        *[(F.col("col") - F.col("_lo") + 1).alias("col") if c == "col" else F.col(c) for c in sites.columns]
    )


def position_map(sites: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """``pos``: running number of the filled columns of a protein, 0 at gaps."""
    filled = (F.col("aa") != GAP).cast("bigint")
    out = running(sites, ["family", "protein"], "col", {"_pos": ("sum", filled)}, rows_per_block)
    return out.withColumn("pos", F.when(F.col("aa") == GAP, F.lit(0)).otherwise(F.col("_pos"))).drop("_pos")


def project_to_alignment(values: DataFrame, sites: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Spread ``values(family, protein, pos, value)`` over the columns, null at gaps."""
    at = position_map(sites, rows_per_block).select("family", "protein", "col", "aa", "pos")
    return at.join(values, ["family", "protein", "pos"], "left").select("family", "protein", "col", "aa", "value")


def context(sites: DataFrame, offset: int = 1, name: str = "next_aa", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Residue of the following (or, with -1, preceding) column as a new column."""
    return neighbour(sites, ["family", "protein"], "col", {name: "aa"}, offset, rows_per_block)


def column_patterns(sites: DataFrame, rows_per_family: int = 100_000) -> DataFrame:
    """Groups of identical columns: (family, col, first_col, weight).

    A column is summed up in two order-free 64-bit hashes and a count. Then every
    column is compared letter by letter with the first of its group; one that differs
    stands for itself. Where no family has more than ``rows_per_family`` rows, a column's
    letters go along with its hashes. Letters of a larger one are never gathered, but
    joined to those of the first column.
    """
    key = F.xxhash64("protein", "aa")
    other = F.xxhash64(F.lit(7), F.col("aa"), F.col("protein"))
    hashes = [F.bit_xor(key).alias("h1"), F.bit_xor(other).alias("h2"), F.count(F.lit(1)).alias("n")]
    if not block_count(sites, ["family"], rows_per_family):
        letters = F.array_sort(F.collect_set(F.struct("protein", "aa"))).alias("_letters")
        marks = sites.filter("family is not null").groupBy("family", "col").agg(*hashes, letters)
        alike = Window.partitionBy("family", "h1", "h2", "n")
        first = marks.withColumn("_first", F.min("col").over(alike)).withColumn("_theirs", F.min_by("_letters", "col").over(alike))
        lone = F.col("col").isNotNull() & (F.col("_letters") != F.col("_theirs"))
        sound = first.select("family", "col", F.when(lone, F.col("col")).otherwise(F.col("_first")).alias("first_col"))
        weight = F.count(F.lit(1)).over(Window.partitionBy("family", "first_col")).alias("weight")
        return sound.filter("first_col is not null").select("family", "col", "first_col", weight)
    # One row per column from here on.
    marks = cut(sites.groupBy("family", "col").agg(*hashes))
    firsts = marks.groupBy("family", "h1", "h2", "n").agg(F.min("col").alias("first_col"))
    placed = cut(marks.join(firsts, ["family", "h1", "h2", "n"]).select("family", "col", "first_col"))
    pairs = placed.filter("col <> first_col")
    mine = sites.select("family", "col", "protein", "aa").join(pairs, ["family", "col"])
    theirs = sites.select("family", F.col("col").alias("first_col"), "protein", F.col("aa").alias("_aa"))
    unlike = (
        mine.join(theirs, ["family", "first_col", "protein"], "left")
        .filter(~F.col("aa").eqNullSafe(F.col("_aa")))
        .select("family", "col")
        .distinct()
        .withColumn("_unlike", F.lit(True))
    )
    sound = cut(
        placed.join(unlike, ["family", "col"], "left").select(
            "family", "col", F.when(F.col("_unlike"), F.col("col")).otherwise(F.col("first_col")).alias("first_col")
        )
    )
    weights = sound.groupBy("family", "first_col").agg(F.count(F.lit(1)).alias("weight"))
    return sound.join(weights, ["family", "first_col"]).select("family", "col", "first_col", "weight")


# --- pairs of proteins ----------------------------------------------------


def aligned_pairs(sites: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sites of the given pairs (family, a, b) side by side, one row per column.

    Pairs are an input, so the work is (pairs x columns). Nothing here lists
    all pairs of a family; for totals over all pairs use ``column_pair_counts``.
    """
    cols = [c for c in sites.columns if c not in ("family", "protein", "col", "seq_no")]

    def side(s: str) -> DataFrame:
        return sites.select(
            "family", F.col("protein").alias(s), "col", *[F.col(c).alias(f"{c}_{s}") for c in cols]
        )

    return pairs.select("family", "a", "b").join(side("a"), ["family", "a"]).join(side("b"), ["family", "b", "col"])


def column_pair_counts(sites: DataFrame) -> DataFrame:
    """How many protein pairs of a family show letters (aa_a, aa_b) in a column.

    Counts over all pairs without making them: with n of one letter and m of
    another there are n * m pairs, and n * (n - 1) / 2 of equal letters. Each
    column joins its letter counts only, at most one row per letter.
    """
    counts = sites.groupBy("family", "col", "aa").agg(F.count(F.lit(1)).alias("n"))
    a = counts.select("family", "col", F.col("aa").alias("aa_a"), F.col("n").alias("n_a"))
    b = counts.select("family", "col", F.col("aa").alias("aa_b"), F.col("n").alias("n_b"))
    same = F.col("aa_a") == F.col("aa_b")
    n = F.when(same, F.floor(F.col("n_a") * (F.col("n_a") - 1) / 2)).otherwise(F.col("n_a") * F.col("n_b"))
    return (
        a.join(b, ["family", "col"])
        .filter(F.col("aa_a") <= F.col("aa_b"))
        .select("family", "col", "aa_a", "aa_b", n.cast("bigint").alias("pairs"))
        .filter("pairs > 0")
    )


def pair_measures(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share aligned and share identical of aligned pairs (aa_a, aa_b)."""
    a, b = F.col("aa_a"), F.col("aa_b")
    shown = (a != GAP) | (b != GAP)
    gap = shown & ((a == GAP) | (b == GAP))
    both = is_residue(a) & is_residue(b)
    return (
        rows.groupBy(*keys)
        .agg(
            F.sum(shown.cast("bigint")).alias("_shown"),
            F.sum(gap.cast("bigint")).alias("_gaps"),
            F.sum(both.cast("bigint")).alias("_both"),
            F.sum((both & (a == b)).cast("bigint")).alias("_same"),
        )
        .select(
            *keys,
            F.when(F.col("_shown") > 0, (F.col("_shown") - F.col("_gaps")) / F.col("_shown")).alias("aligned"),
            F.when(F.col("_both") > 0, F.col("_same") / F.col("_both")).otherwise(0.0).alias("identity"),
        )
    )


Rule = Callable[[dict[str, Column]], Column]


def subset_score(
    sites: DataFrame,
    members: DataFrame,
    least_aligned: float = 0.90,
    least_identity: float = 0.05,
    most_identity: float = 0.95,
    most: int = 30,
    rule: Rule | None = None,
) -> DataFrame:
    """Score proposed subsets, ``members(family, subset, protein, good_structure, candidates)``.

    Valid subsets score structures * candidates + sequences, others
    -candidates - 1. A subset of more than ``most`` members is invalid by the
    rule itself, so pairs are made only within subsets of at most that many; the
    measures of a larger one are null, which says that they were not taken. A
    subset without a pair has 1, 1 and 0. ``rule`` may turn the aggregates,
    nulls included, into another score.
    """
    keys = ["family", "subset"]
    totals = members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("size"),
        F.sum(F.col("good_structure").cast("bigint")).alias("structures"),
        F.max("candidates").alias("candidates"),
    )
    usable = members.join(totals.filter(F.col("size") <= most).select(*keys), keys, "left_semi")
    rows = usable.select(*keys, "protein").join(
        sites.select("family", "protein", "col", "aa"), ["family", "protein"]
    )
    a = rows.withColumnsRenamed({"protein": "a", "aa": "aa_a"})
    b = rows.withColumnsRenamed({"protein": "b", "aa": "aa_b"})
    pairs = pair_measures(a.join(b, [*keys, "col"]).filter("a < b"), [*keys, "a", "b"])
    ranges = pairs.groupBy(*keys).agg(
        F.min("aligned").alias("least_aligned"),
        F.min("identity").alias("least_identity"),
        F.max("identity").alias("most_identity"),
    )
    out = totals.join(ranges, keys, "left").withColumns(
        {
            name: F.when(F.col("size") <= most, F.coalesce(F.col(name), F.lit(lone)))
            for name, lone in (("least_aligned", 1.0), ("least_identity", 1.0), ("most_identity", 0.0))
        }
    ).withColumns(
        {
            "sequences": F.col("size") - F.col("structures"),
        }
    )
    valid = (
        (F.col("least_aligned") >= least_aligned)
        & (F.col("least_identity") >= least_identity)
        & (F.col("most_identity") <= most_identity)
        & (F.col("size") <= most)
    )
    plain = F.when(valid, F.col("structures") * F.col("candidates") + F.col("sequences")).otherwise(
        -F.col("candidates") - 1
    )
    score = rule({c: F.col(c) for c in out.columns}) if rule else plain
    return out.withColumns({"valid": valid, "score": score})


def constrained_subset(
    sites: DataFrame,
    members: DataFrame,
    least_aligned: float = 0.90,
    least_identity: float = 0.05,
    most_identity: float = 0.95,
    most: int = 30,
) -> DataFrame:
    """Per family, members in order as long as every pair of the subset fits.

    ``members(family, protein, rank)``, unique rank within a family. A member
    joins when it fits all that joined before. So each round takes the first
    open member of every family and closes the open ones that do not fit it:
    at most ``most`` rounds, and a round compares one protein with the rest.
    Cells are stored once; each round reads those, not what they are made from.
    """
    open_rows = cut(members.select("family", "protein", "rank"))
    cells = cut(sites.select("family", "protein", "col", "aa"))
    chosen = []
    for _ in range(most):
        if open_rows.isEmpty():
            break
        first = cut(open_rows.groupBy("family").agg(F.min_by("protein", "rank").alias("protein"), F.min("rank").alias("rank")))
        chosen.append(first)
        rest = open_rows.join(first, ["family", "protein"], "left_anti")
        a = cells.join(first.select("family", "protein"), ["family", "protein"]).select(
            "family", F.col("protein").alias("a"), "col", F.col("aa").alias("aa_a")
        )
        b = cells.join(rest.select("family", "protein"), ["family", "protein"]).select(
            "family", "protein", "col", F.col("aa").alias("aa_b")
        )
        fits = pair_measures(b.join(a, ["family", "col"]), ["family", "protein"]).filter(
            (F.col("aligned") >= least_aligned) & F.col("identity").between(least_identity, most_identity)
        )
        open_rows = cut(rest.join(fits.select("family", "protein"), ["family", "protein"], "left_semi"))
    out = None
    for c in chosen:
        out = c if out is None else out.unionByName(c)
    return members.limit(0).select("family", "protein", "rank") if out is None else out


def mapped_pairs(a: DataFrame, b: DataFrame, mapping: DataFrame) -> DataFrame:
    """Values of ``a(id, pos, value)`` and ``b`` met through ``mapping(id, pos_a, pos_b)``."""
    left = a.select("id", F.col("pos").alias("pos_a"), F.col("value").alias("value_a"))
    right = b.select("id", F.col("pos").alias("pos_b"), F.col("value").alias("value_b"))
    joined = mapping.filter("pos_a is not null and pos_b is not null").join(left, ["id", "pos_a"]).join(right, ["id", "pos_b"])
    return joined.filter("value_a is not null and value_b is not null")


def identity(pred: DataFrame, real: DataFrame, keys: Sequence[str], known: str = "residue") -> DataFrame:
    """Share of positions with the right letter per key and draw, with mean and sd over draws.

    ``pred(keys, draw, pos, letter)``, ``real(keys, pos, letter)``. ``known``
    counts positions whose real letter is a residue, or only is no gap.
    """
    counts = is_residue(F.upper("real")) if known == "residue" else F.col("real") != GAP
    joined = pred.join(real.withColumnRenamed("letter", "real"), [*keys, "pos"]).filter(counts)
    per_draw = joined.groupBy(*keys, "draw").agg(F.avg((F.col("letter") == F.col("real")).cast("double")).alias("_m"))
    return per_draw.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("draws"), F.avg("_m").alias("mean"), F.stddev_samp("_m").alias("sd")
    )


# --- chains of states -----------------------------------------------------


def transitions(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    state: str,
    states: Sequence[str],
    pseudo: float = 0.1,
    mixture: bool = False,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Counts of state to next state with row shares and start shares.

    (from_state, to_state, n, share, start): ``n`` holds the pseudo-count,
    ``start`` is the share of ``from_state`` in the column sums. ``mixture``
    puts the column shares in every row.
    """
    steps = neighbour(df, keys, order, {"to_state": state}, 1, rows_per_block).filter("to_state is not null")
    counts = cut(steps.groupBy(F.col(state).alias("from_state"), "to_state").agg(F.count(F.lit(1)).alias("_n")))
    one = df.sparkSession.range(1)
    grid = each_letter(each_letter(one, "from_state", states), "to_state", states).drop("id")
    full = grid.join(counts, ["from_state", "to_state"], "left").select(
        "from_state", "to_state", (F.coalesce(F.col("_n"), F.lit(0)) + F.lit(pseudo)).alias("n")
    )
    # At most |states| squared rows from here on.
    rows = full.groupBy("from_state").agg(F.sum("n").alias("_row"))
    cols = full.groupBy("to_state").agg(F.sum("n").alias("_col"))
    total = full.agg(F.sum("n").alias("_all"))
    start = cols.select(F.col("to_state").alias("from_state"), F.col("_col").alias("_start"))
    out = full.join(rows, "from_state").join(cols, "to_state").join(start, "from_state").join(F.broadcast(total))
    share = F.col("_col") / F.col("_all") if mixture else F.col("n") / F.col("_row")
    return out.select("from_state", "to_state", "n", share.alias("share"), (F.col("_start") / F.col("_all")).alias("start"))


# --- association of letters with classes ----------------------------------


def chi_square(n11: Column, n12: Column, n21: Column, n22: Column) -> dict[str, Column]:
    """Expected counts and statistic of a 2x2 table; NaN when a margin is empty."""
    r1, r2, c1, c2 = n11 + n12, n21 + n22, n11 + n21, n12 + n22
    total = r1 + r2
    e = [F.when(total > 0, r * c / total).otherwise(float("nan")) for r in (r1, r2) for c in (c1, c2)]
    bad = (r1 == 0) | (r2 == 0) | (c1 == 0) | (c2 == 0)
    terms = [(o - x) * (o - x) / F.when(x > 0, x) for o, x in zip((n11, n12, n21, n22), e)]
    stat = F.when(bad, F.lit(float("nan"))).otherwise(sum(terms[1:], terms[0]))
    return {"chi2": stat, "e11": e[0], "e12": e[1], "e21": e[2], "e22": e[3]}


def column_association(sites: DataFrame, classes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """2x2 table of letter against class per column and letter, and per ``keys`` of the sites (a family, say).

    ``classes(protein, class)`` with 1 or 2. Rows 1/2: other letter / letter;
    columns 1/2: the classes. The sign is minus when letter and class 2 meet
    more often than expected.
    """
    known = sites.filter(F.col("aa") != GAP).join(classes.filter(F.col("class").isin(1, 2)), "protein")
    cls1 = (F.col("class") == 1).cast("bigint")
    cls2 = (F.col("class") == 2).cast("bigint")
    at = [*keys, "col"]
    letters = known.groupBy(*at, "aa").agg(F.sum(cls1).alias("n21"), F.sum(cls2).alias("n22"))
    totals = letters.groupBy(*at).agg(F.sum("n21").alias("_c1"), F.sum("n22").alias("_c2"))
    full = each_letter(totals).join(letters, [*at, "aa"], "left").na.fill(0, ["n21", "n22"])
    table = full.select(
        *at, "aa", (F.col("_c1") - F.col("n21")).alias("n11"), (F.col("_c2") - F.col("n22")).alias("n12"), "n21", "n22"
    )
    c = chi_square(*[F.col(n).cast("double") for n in ("n11", "n12", "n21", "n22")])
    out = table.select("*", *[v.alias(k) for k, v in c.items()])
    signed = F.when(F.isnan("chi2"), 0.0).when(F.col("n22") > F.col("e22"), -F.col("chi2")).otherwise(F.col("chi2"))
    return out.withColumn("chi2", signed)


def log_factorial(n: Column) -> Column:
    """ln n!, exact below 10 and by Stirling's series from there on (error under 1e-12)."""
    small = F.element_at(
        F.array(*[F.lit(math.lgamma(i + 1)) for i in range(10)]), F.least(n, F.lit(9)).cast("int") + 1
    )
    x = n.cast("double") + 1.0
    series = (
        (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2.0 * math.pi)
        + 1.0 / (12.0 * x) - 1.0 / (360.0 * x * x * x) + 1.0 / (1260.0 * x * x * x * x * x)
    )
    return F.when(n < 10, small).otherwise(series)


#: Terms of the exact test that one row sums.
TERMS_PER_ROW = 4096


def fisher_exact(table: DataFrame, two_sided: str = "central") -> DataFrame:
    """Exact p-value and its natural log for the tables (n11, n12, n21, n22).

    ``central``: twice the smaller tail, at most 1; ``lower`` and ``upper``: one
    tail of n11. Every term of a tail counts: tails are cut into rows of
    ``TERMS_PER_ROW`` terms, summed per distinct table against the tail's largest
    term, so the log holds where the p-value itself is below the smallest double.
    Terms sum to less than 1e-18 of the largest one beyond a distance of
    sqrt(n (ln(n + 1) + 42) / 2) from it, n the least margin (Hoeffding's bound
    for draws without replacement; the terms' logs are concave, and the largest is
    at least 1 / (n + 1)), and end there: the work follows the spread, not the
    counts. Logs of factorials cancel, so about 16 digits less those of the counts
    hold. Null where a count is null or negative.
    """
    counts = ["n11", "n12", "n21", "n22"]
    n11, n12, n21, n22 = (F.col(f"_{n}") for n in counts)
    r, c = n11 + n12, n11 + n21
    t = r + n21 + n22
    base = (
        log_factorial(F.col("_r")) + log_factorial(F.col("_t") - F.col("_r"))
        + log_factorial(F.col("_c")) + log_factorial(F.col("_t") - F.col("_c")) - log_factorial(F.col("_t"))
    )

    def log_term(k: Column) -> Column:
        return (
            F.col("_base") - log_factorial(k) - log_factorial(F.col("_r") - k) - log_factorial(F.col("_c") - k)
            - log_factorial(F.col("_t") - F.col("_r") - F.col("_c") + k)
        )

    def pieces(side: str, first: Column, last: Column) -> Column:
        # The terms rise up to the mode and fall after it.
        mode = F.floor((F.col("_r") + 1.0) * (F.col("_c") + 1.0) / (F.col("_t") + 2.0)).cast("bigint")
        top = F.greatest(first, F.least(last, mode))
        first, last = F.greatest(first, top - F.col("_far")), F.least(last, top + F.col("_far"))
        starts = F.sequence(first, last, F.lit(TERMS_PER_ROW).cast("bigint"))
        return F.transform(
            starts,
            lambda k: F.struct(
                F.lit(side).alias("side"), k.alias("first"),
                F.least(k + F.lit(TERMS_PER_ROW - 1), last).alias("last"), top.alias("top"),
            ),
        )

    margin = F.least("_r", "_c", F.col("_t") - F.col("_r"), F.col("_t") - F.col("_c")).cast("double")
    tables = (
        table.select(*[F.col(n).cast("bigint").alias(f"_{n}") for n in counts])
        .filter(F.least(n11, n12, n21, n22) >= 0).dropna().distinct()
        .withColumns({"_r": r, "_c": c, "_t": t})
        .withColumns({"_base": base, "_lo": F.greatest(F.lit(0), F.col("_r") + F.col("_c") - F.col("_t")), "_hi": F.least("_r", "_c")})
        .withColumn("_far", F.ceil(F.sqrt(margin * (F.ln(margin + 1.0) + 42.0) / 2.0)).cast("bigint") + 3)
    )
    rows = tables.withColumn(
        "_p", F.explode(F.concat(pieces("lower", F.col("_lo"), n11), pieces("upper", n11, F.col("_hi"))))
    ).withColumn("_top", log_term(F.col("_p.top")))
    part = F.aggregate(
        F.sequence(F.col("_p.first"), F.col("_p.last")), F.lit(0.0), lambda acc, k: acc + F.exp(log_term(k) - F.col("_top"))
    )
    own = [f"_{n}" for n in counts]
    tails = rows.select(*own, F.col("_p.side").alias("_side"), "_top", part.alias("_part")).groupBy(*own).agg(
        *[
            (F.max(F.when(F.col("_side") == s, F.col("_top"))) + F.ln(F.sum(F.when(F.col("_side") == s, F.col("_part"))))).alias(s)
            for s in ("lower", "upper")
        ]
    )
    log_p = {
        "lower": F.col("lower"), "upper": F.col("upper"),
        "central": F.least(F.col("lower"), F.col("upper")) + math.log(2.0),
    }[two_sided]
    found = tails.select(*own, F.least(F.lit(0.0), log_p).alias("log_p_value"))
    same = [F.col(n).cast("bigint") == F.col(f"_{n}") for n in counts]
    joined = table.join(found, same, "left").drop(*own)
    return joined.withColumn("p_value", F.exp("log_p_value"))


def trait_transition_chi2(draws: DataFrame, nodes: DataFrame, traits: DataFrame, letter: str) -> DataFrame:
    """Signed chi-squares of letter against trait over the edges of a tree.

    ``draws(draw, node, aa)``, ``nodes(node, parent)``, ``traits(node, trait)``
    with 1 or 2. Per draw three tables: letter lost, gained, held. Reported are
    median, 5% and 95% over draws, NaN as 0.
    """
    edges = nodes.filter("parent is not null").join(traits.filter(F.col("trait").isin(1, 2)), "node").select("node", "parent", "trait")
    child = draws.select("draw", "node", (F.col("aa") == letter).alias("_to"))
    above = draws.select("draw", F.col("node").alias("parent"), (F.col("aa") == letter).alias("_from"))
    rows = edges.join(child, "node").join(above, ["draw", "parent"])
    was, now, trait = F.col("_from"), F.col("_to"), F.col("trait")
    tables = {
        "lost": (was & ~now, was & now),
        "gained": (~was & ~now, ~was & now),
        "held": (~now, now),
    }
    sums, chis = [], []
    for name, (first, second) in tables.items():
        for i, cond in enumerate((first, second), 1):
            for t in (1, 2):
                sums.append(F.sum((cond & (trait == t)).cast("double")).alias(f"{name}{i}{t}"))
    per_draw = rows.groupBy("draw").agg(*sums)
    for name in tables:
        c = chi_square(*[F.col(f"{name}{i}{t}") for i in (1, 2) for t in (1, 2)])
        signed = F.when(F.isnan(c["chi2"]), 0.0).when(F.col(f"{name}22") > c["e22"], c["chi2"]).otherwise(-c["chi2"])
        chis.append(signed.alias(name))
    scored = per_draw.select("draw", *chis).unpivot(["draw"], list(tables), "table", "chi2")
    shares = {"median": 0.5, "p05": 0.05, "p95": 0.95}
    found = exact_percentiles(scored, ["table"], "chi2", shares)
    # Three rows, one per table, into one.
    return found.agg(
        *[F.max(F.when(F.col("table") == n, F.col(s))).alias(f"{n}_{s}") for n in tables for s in shares]
    )
