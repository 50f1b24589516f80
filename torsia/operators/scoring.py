"""Scores of sites, chains and trees under given parameters."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torsia.functions import folds
from torsia.functions.densities import bivariate_log_norm, von_mises_log_norm
from torsia.functions.letters import RESIDUES
from torsia.session import cut, split

from .columns import is_residue
from .ordered import numbered
from .trees import FEW_PARENTS, KEY, tree_sums, without_relays

NEG_INF = float("-inf")


def log_sum_exp(df: DataFrame, keys: Sequence[str], column: str, name: str = "lse") -> DataFrame:
    """Stable log of the sum of exponentials per key; null and -inf count as nothing.

    Both steps aggregate partially, so a hot key costs one row per task.
    """
    x = F.col(column)
    tops = df.groupBy(*keys).agg(F.max(x).alias("_top"))
    near = df.filter(x.isNotNull() & (x > NEG_INF)).join(tops.filter(F.col("_top") > NEG_INF), list(keys))
    sums = near.groupBy(*keys).agg(F.max("_top").alias("_m"), F.sum(F.exp(x - F.col("_top"))).alias("_s"))
    return tops.join(sums, list(keys), "left").select(
        *keys, F.when(F.col("_s").isNotNull(), F.col("_m") + F.ln("_s")).otherwise(F.lit(NEG_INF)).alias(name)
    )


# --- densities of sites ---------------------------------------------------

PARAMS = (
    "state bigint, aa string, p_aa double, mu_phi double, mu_psi double, k1 double, k2 double, k3 double, "
    "log_norm double, norm_phi double, norm_psi double"
)


def parameter_row(state: int, aa: str, p_aa: float, mu_phi: float, mu_psi: float, k1: float, k2: float, k3: float) -> tuple:
    """A row of PARAMS with its normalisers worked out."""
    return (
        state, aa, p_aa, mu_phi, mu_psi, k1, k2, k3,
        bivariate_log_norm(k1, k2, k3), von_mises_log_norm(k1), von_mises_log_norm(k2),
    )


def _model(params: DataFrame) -> DataFrame:
    """(key, states, ids): per residue, and for '*', each state's list of parameter rows, and which states these are."""
    fields = [c for c in params.columns if c not in ("state", "aa")]
    row = F.struct(*fields)
    by_state = params.groupBy("aa", "state").agg(F.collect_list(row).alias("_l"))
    any_aa = params.groupBy("state").agg(F.collect_list(row).alias("_l")).select(F.lit("*").alias("aa"), "state", "_l")
    both = by_state.unionByName(any_aa)
    listed = F.array_sort(F.collect_list(F.struct("state", "_l")))
    return both.groupBy(F.col("aa").alias("_key")).agg(
        F.transform(listed, lambda x: x["_l"]).alias("_states"), F.transform(listed, lambda x: x["state"]).alias("_ids")
    )


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a table that was counted and is no longer than ``rows``."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def emissions(sites: DataFrame, params: DataFrame, letters: bool = True) -> DataFrame:
    """``e``: log score of a site under each state, in the order of ``state_ids``.

    ``params`` has one row per state and residue. Two observed angles use the
    joint density, one its own, none adds nothing. A site without residue is
    averaged over the residues of the state. With ``letters`` the log share of
    the residue is added. The parameters come to the sites as one row per
    residue, so no shuffle of sites is needed.
    """
    phi, psi = F.col("phi"), F.col("psi")

    def density(p: Column) -> Column:
        a, b = phi - p["mu_phi"], psi - p["mu_psi"]
        joint = p["k1"] * F.cos(a) + p["k2"] * F.cos(b) - p["k3"] * F.cos(a - b) - p["log_norm"]
        return (
            F.when(phi.isNotNull() & psi.isNotNull(), joint)
            .when(phi.isNotNull(), p["k1"] * F.cos(a) - p["norm_phi"])
            .when(psi.isNotNull(), p["k2"] * F.cos(b) - p["norm_psi"])
            .otherwise(0.0)
        )

    known = is_residue(F.col("aa"))

    def state_score(rows: Column) -> Column:
        one = density(rows[0]) + (F.ln(rows[0]["p_aa"]) if letters else F.lit(0.0))
        logs = F.transform(rows, lambda p: F.ln(p["p_aa"]) + density(p))
        top = F.array_max(logs)
        mixed = top + F.ln(F.aggregate(logs, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))
        return F.when(known, one).when(phi.isNull() & psi.isNull(), 0.0).otherwise(mixed)

    keyed = sites.withColumn("_key", F.when(known, F.col("aa")).otherwise("*"))
    model = cut(_model(params))
    return keyed.join(_small(model, 21), "_key").select(
        "family", "protein", "col", F.transform("_states", state_score).alias("e"), F.col("_ids").alias("state_ids")
    )


def score_sites(sites: DataFrame, params: DataFrame) -> DataFrame:
    """(family, protein, col, state, loglik); a state without parameters for the site's residue gives no row."""
    e = emissions(sites, params, letters=False)
    each = e.select("family", "protein", "col", "state_ids", F.posexplode("e").alias("_k", "loglik"))
    return each.select("family", "protein", "col", F.get("state_ids", F.col("_k")).alias("state"), "loglik")


def family_loglik(scores: DataFrame) -> DataFrame:
    """Path and observation scores per family and in total (family null)."""
    return scores.rollup("family").agg(
        F.sum("path").alias("path"), F.sum("observation").alias("observation"),
        (F.sum("path") + F.sum("observation")).alias("total"),
    )


# --- chains ---------------------------------------------------------------


def _const(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _starts(initial: Sequence[float], odd: np.ndarray) -> np.ndarray:
    """What enters a chain's first column; where that has no number, the first state alone."""
    return np.where(odd[:, None], np.eye(len(initial))[0], np.asarray(initial, dtype=float))


#: Blocks whose matrices, and columns, meet in one row: the most neighbours multiplied at once.
FAN = 64
#: Columns that meet in one row of ``hmm_loglik``.
STRIP = 16_384


def _strips(e: DataFrame, k: Column) -> DataFrame:
    """Sites of a protein in runs of columns, each one bounded row."""
    return e.groupBy("family", "protein", k.alias("k")).agg(F.array_sort(F.collect_list(F.struct("col", "e"))).alias("cells"))


def _block_numbers(width: int) -> Column:
    return F.transform(F.col("cells")["col"], lambda c: F.floor((c - 1) / width))


def _runs(block: pa.Array, e: pa.Array, s: int) -> tuple:
    """Columns of a batch of strips, and their blocks: (weights, tops, starts of blocks, blocks without number, first and number of blocks per strip, whole)."""
    scores, at, whole = folds.cells_of(e, s)
    number = block.flatten()
    null = number.is_null().to_numpy(zero_copy_only=False)
    number = number.fill_null(0).to_numpy(zero_copy_only=False)
    new = np.ones(len(number), dtype=bool)
    new[1:] = (number[1:] != number[:-1]) | (null[1:] != null[:-1])
    new[at[:-1]] = True
    begins = np.flatnonzero(new)
    first = np.searchsorted(begins, at)
    return *folds.weights_of(scores), np.append(begins, len(number)), null[begins], first[:-1], np.diff(first), whole


def _strip_matrix(transition: Sequence[Sequence[float]], initial: Sequence[float], width: int) -> Column:
    """What a strip does to the vector before it, see ``functions.folds``: a matrix per block of ``width`` columns, and their product.

    Each numpy step takes one column of all blocks of a batch, or one block of all strips.
    """
    moves = np.asarray(transition, dtype=float)

    @F.arrow_udf("array<double>")
    def matrix(block: pa.Array, e: pa.Array) -> pa.Array:
        weights, tops, at, null, first, n, whole = _runs(block, e, len(initial))
        rows, logs = folds.matrices(weights, tops, at, _starts(initial, null), moves)
        # Columns without a number have no place before others.
        return folds.packed(*folds.products(rows, logs, first, n), whole & ~(null[first] & (n > 1)))

    return matrix(_block_numbers(width), F.col("cells")["e"])


def hmm_loglik(
    e: DataFrame, transition: Sequence[Sequence[float]], initial: Sequence[float], width: int = 1024
) -> DataFrame:
    """Forward score of each protein from its ``emissions``.

    A run of columns becomes one small matrix; the product of the matrices of a
    protein gives its score. Matrices of neighbours are multiplied where their columns
    lie, 16,384 columns to a row. So a long chain is folded by many tasks, and what
    meets in one task is one matrix per row.
    """
    s = len(initial)
    strip = F.floor(F.floor((F.col("col") - 1) / width) / max(1, STRIP // width))
    mats = _strips(e.filter("family is not null and protein is not null"), strip).select(
        "family", "protein", F.col("k").alias("block"), _strip_matrix(transition, initial, width).alias("m")
    )
    per = mats.groupBy("family", "protein").agg(F.array_sort(F.collect_list(F.struct("block", "m"))).alias("ms"))

    @F.arrow_udf("double")
    def total(block: pa.Array, ms: pa.Array) -> pa.Array:
        rows, logs, whole = folds.unpacked(ms.flatten(), s)
        at = np.concatenate([[0], np.cumsum(ms.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        bad = np.concatenate([[0], np.cumsum(~whole)])
        n = np.diff(at)
        # Columns without a number have no place before others.
        odd = block.flatten().is_null().to_numpy(zero_copy_only=False)[at[:-1]] & (n > 1)
        v, out = np.tile(np.eye(s + 1)[0], (len(n), 1)), np.zeros(len(n))
        for t in range(n.max(initial=0)):
            live = np.flatnonzero(n > t)
            v[live], log = folds.through(v[live], rows[at[live] + t], logs[at[live] + t])
            out[live] += log
        return pa.array(out + np.log(v.sum(axis=1)), mask=odd | (bad[at[1:]] > bad[at[:-1]]))

    return per.select("family", "protein", total(F.col("ms")["block"], F.col("ms")["m"]).alias("loglik"))


def hmm_posterior(
    e: DataFrame, transition: Sequence[Sequence[float]], initial: Sequence[float], width: int = 256, fan: int = FAN
) -> DataFrame:
    """(family, protein, col, posterior): probability of each state per column.

    Forward vectors enter a block from the left and backward vectors from the
    right; both come from the block matrices. Up to ``fan`` neighbouring blocks are one
    row, in which their matrices are multiplied from both ends; within a block two short
    folds reach every column. Where a chain has several such rows, their products are
    multiplied ``fan`` by ``fan`` until one is left, and the vectors handed down again the
    same way, in a logarithmic number of rounds.
    """
    s = len(initial)
    moves = np.asarray(transition, dtype=float)
    chain = ["family", "protein"]
    strip = F.floor(F.floor((F.col("col") - 1) / width) / fan)
    known = e.filter("family is not null and protein is not null").withColumn("k", strip)
    # One row per chain where none has more than one strip; columns without a number go to the first of a chain.
    spans = known.groupBy(*chain).agg(F.min("k").alias("_low"), F.max("k").alias("_high"))
    long = (spans.agg(F.max(F.col("_high") - F.col("_low"))).head()[0] or 0) > 0
    if long:
        known = known.join(spans, chain).withColumn("k", F.coalesce("k", "_low"))
    else:
        known = known.withColumn("k", F.lit(0).cast("bigint"))
    strips = _strips(known, F.col("k"))
    blocks = _block_numbers(width)

    @F.arrow_udf("array<array<double>>")
    def shares(block: pa.Array, e: pa.Array, enter: pa.Array, leave: pa.Array) -> pa.Array:
        weights, tops, at, null, first, n, whole = _runs(block, e, s)
        start = _starts(initial, null)
        rows, logs = folds.matrices(weights, tops, at, start, moves)
        into, out = np.zeros((len(null), s + 1)), np.zeros((len(null), s))
        (v, left), (w, right) = folds.rows_of(enter, s + 1), folds.rows_of(leave, s)
        good = np.repeat(left & right & whole, n)
        for t in range(n.max(initial=0)):
            live = np.flatnonzero(n > t)
            here, last = first[live] + t, first[live] + n[live] - 1 - t
            into[here], out[last] = v[live], w[live]
            v[live], w[live] = folds.through(v[live], rows[here], logs[here])[0], folds.back(rows[last], logs[last], w[live])
        # A column without a number stands before the others with no move to them: what follows the next block is not known.
        odd = np.flatnonzero(null[first] & (n > 1))
        after = first[odd] + 1
        start[after], into[after] = rows[first[odd], 0], np.eye(s + 1)[0]
        late = np.zeros(len(null), dtype=bool)
        for i in odd:
            late[first[i] + 2 : first[i] + n[i]] = True
        good &= ~late
        found = folds.posterior(weights, at, into, out, start, moves)
        mask = np.repeat(~np.repeat(good, np.diff(at)), s)
        offsets = np.concatenate([[0], np.cumsum(block.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * s), pa.array(found.reshape(-1), mask=mask))
        return pa.ListArray.from_arrays(pa.array(offsets), flat)

    begin, end = _const(np.eye(s + 1)[0]), _const([1.0] * s)
    if long:
        strips = cut(strips)
        ends = _handed(strips.select(*chain, "k", _strip_matrix(transition, initial, width).alias("m")), chain, s, fan, begin, end)
        strips = strips.join(ends, [*chain, "k"])
    else:
        strips = strips.withColumns({"_in": begin, "_out": end})
    found = strips.select(*chain, F.inline(F.arrays_zip(
        F.col("cells")["col"].alias("col"), shares(blocks, F.col("cells")["e"], "_in", "_out").alias("posterior"))))
    return found.toDF(*chain, "col", "posterior").filter("col is not null")


def _handed(level: DataFrame, chain: Sequence[str], s: int, fan: int, begin: Column, end: Column) -> DataFrame:
    """(chain, k, _in, _out): vectors that enter matrices (chain, k, m) from the left and from the right."""

    @F.arrow_udf("array<double>")
    def multiplied(ms: pa.Array) -> pa.Array:
        rows, logs, whole = folds.unpacked(ms.flatten(), s)
        n = ms.value_lengths().to_numpy(zero_copy_only=False)
        first = np.cumsum(n) - n
        bad = np.concatenate([[0], np.cumsum(~whole)])
        return folds.packed(*folds.products(rows, logs, first, n), bad[first + n] == bad[first])

    @F.arrow_udf("array<struct<_in:array<double>,_out:array<double>>>")
    def ends(ms: pa.Array, enter: pa.Array, leave: pa.Array) -> pa.Array:
        rows, logs, whole = folds.unpacked(ms.flatten(), s)
        n = ms.value_lengths().to_numpy(zero_copy_only=False)
        first = np.cumsum(n) - n
        into, out = np.zeros((len(rows), s + 1)), np.zeros((len(rows), s))
        known, after = np.zeros(len(rows), dtype=bool), np.zeros(len(rows), dtype=bool)
        (v, left), (w, right) = folds.rows_of(enter, s + 1), folds.rows_of(leave, s)
        for t in range(n.max(initial=0)):
            live = np.flatnonzero(n > t)
            here, last = first[live] + t, first[live] + n[live] - 1 - t
            into[here], out[last], known[here], after[last] = v[live], w[live], left[live], right[live]
            v[live], w[live] = folds.through(v[live], rows[here], logs[here])[0], folds.back(rows[last], logs[last], w[live])
            left[live] &= whole[here]
            right[live] &= whole[last]
        each = pa.StructArray.from_arrays([folds.lists(into, known), folds.lists(out, after)], names=["_in", "_out"])
        return pa.ListArray.from_arrays(pa.array(np.append(first, len(rows)).astype(np.int32)), each)

    levels, fan = [], max(2, fan)
    while True:
        level = cut(level)
        levels.append(level)
        if (level.groupBy(*chain).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).head()[0] or 0) <= 1:
            break
        kids = F.array_sort(F.collect_list(F.struct("k", "m")))
        up = level.groupBy(*chain, F.floor(F.col("k") / fan).alias("up")).agg(kids.alias("kids"))
        # Runs on both sides of 0 never meet by division: few enough are taken together.
        if (up.groupBy(*chain).agg(F.sum(F.size("kids")).alias("n")).agg(F.max("n")).head()[0] or 0) <= fan:
            up = level.withColumn("up", F.lit(0).cast("bigint")).groupBy(*chain, "up").agg(kids.alias("kids"))
        level = up.select(*chain, F.col("up").alias("k"), "kids", multiplied(F.col("kids")["m"]).alias("m"))
    found = levels[-1].select(*chain, "k", begin.alias("_in"), end.alias("_out"))
    for level in levels[:0:-1]:
        j = level.join(found, [*chain, "k"])
        each = F.arrays_zip(F.col("kids")["k"].alias("k"), ends(F.col("kids")["m"], "_in", "_out").alias("v"))
        found = cut(j.select(*chain, F.explode(each).alias("_z")).select(*chain, F.col("_z")["k"].alias("k"), F.col("_z")["v"]["_in"].alias("_in"), F.col("_z")["v"]["_out"].alias("_out")))
    return found


#: Logs of shares are summed as whole numbers of this part, so equal products tie exactly.
SCORE_UNIT = 1 << 30
#: States of a chain: the residues in order, a gap, and what stands before the first column.
GAP_STATE, BEFORE = len(RESIDUES), len(RESIDUES) + 1


def chain_moves(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, b, n, f, t, lp): scores of the moves into column b of n, from what the draws do; b counts from 0.

    Only columns next to each other are joined: a letter that is no residue, and a
    column that a draw doesn't have, is a gap, a state like any other.
    """
    keys = list(keys)
    state = F.when(is_residue(F.col("aa")), F.instr(F.lit(RESIDUES), F.col("aa")) - 1).otherwise(GAP_STATE)
    seen = samples.groupBy(*keys, "iter", "col").agg(F.min(state).alias("s"))
    span = seen.groupBy(*keys).agg(F.min("col").alias("_lo"), (F.max("col") - F.min("col") + 1).alias("n"))
    draws = seen.select(*keys, "iter").distinct().join(span, keys)
    grid = draws.select(*keys, "iter", "n", "_lo", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("b"))
    full = cut(
        grid.withColumn("col", F.col("_lo") + F.col("b")).join(seen, [*keys, "iter", "col"], "left")
        .select(*keys, "iter", "n", "b", F.coalesce("s", F.lit(GAP_STATE)).alias("s"))
    )
    before = full.select(*keys, "iter", (F.col("b") + 1).alias("b"), F.col("s").alias("f"))
    moves = full.withColumnRenamed("s", "t").join(before, [*keys, "iter", "b"], "left").withColumn("f", F.coalesce("f", F.lit(BEFORE)))
    counts = moves.groupBy(*keys, "n", "b", "f", "t").agg(F.count(F.lit(1)).alias("_c"))
    out = counts.groupBy(*keys, "b", "f").agg(F.sum("_c").alias("_all"))
    lp = F.round(F.ln(F.col("_c") / F.col("_all")) * SCORE_UNIT).cast("bigint")
    return counts.join(out, [*keys, "b", "f"]).select(*keys, "b", "n", "f", "t", lp.alias("lp"))


def chain_viterbi(samples: DataFrame, keys: Sequence[str] = ("protein",)) -> DataFrame:
    """(keys, sequence): most probable string per key, from the draws' start and column-to-column shares.

    ``samples(keys, iter, col, aa)``. Moves between neighbouring columns are rows of
    small matrices under (maximum, plus). Neighbouring matrices are multiplied two by
    two until one is left; on the way back, each block gets the best scores with which
    it is entered. That gives every column's scores, and so its best moves, in a
    logarithmic number of rounds. The moves that lead to the best end are the path
    from there to the root of a tree, found by doubling as well. No row holds a chain
    but the string itself. Ties go to the first letter, from the end on; the gap comes
    last and is written as a hyphen.
    """
    keys = list(keys)
    moves = cut(chain_moves(samples, keys))
    levels, most = [moves], moves.agg(F.max("n")).head()[0] or 1
    while most > 1:
        m = levels[-1]
        up = [*keys, F.floor(F.col("b") / 2).alias("b"), F.ceil(F.col("n") / 2).alias("n")]
        even = m.filter(F.col("b") % 2 == 0)
        left = even.select(*up, "f", F.col("t").alias("_mid"), F.col("lp").alias("_first"))
        right = m.filter(F.col("b") % 2 == 1).select(*up[:-1], F.col("f").alias("_mid"), "t", "lp")
        pairs = left.join(right, [*keys, "b", "_mid"]).groupBy(*keys, "b", "n", "f", "t").agg(F.max(F.col("_first") + F.col("lp")).alias("lp"))
        alone = even.filter(F.col("b") == F.col("n") - 1).select(*up, "f", "t", "lp")
        levels.append(cut(pairs.unionByName(alone)))
        most = -(-most // 2)
    enter = moves.select(*keys).distinct().select(
        *keys, F.lit(0).cast("bigint").alias("b"), F.lit(BEFORE).alias("f"), F.lit(0).cast("bigint").alias("score")
    )
    for m in levels[-2::-1]:
        here = enter.withColumn("b", 2 * F.col("b"))
        through = here.join(m.filter(F.col("b") < F.col("n") - 1), [*keys, "b", "f"])
        right = through.groupBy(*keys, (F.col("b") + 1).alias("b"), F.col("t").alias("f")).agg(F.max(F.col("score") + F.col("lp")).alias("score"))
        enter = cut(here.unionByName(right))
    reached = enter.join(moves, [*keys, "b", "f"]).groupBy(*keys, "b", "n", "t").agg(
        F.max(F.struct((F.col("score") + F.col("lp")).alias("score"), (-F.col("f")).alias("back"))).alias("_w")
    )
    steps = cut(reached.select(*keys, "b", "n", "t", F.col("_w")["score"].alias("score"), (-F.col("_w")["back"]).alias("f")))
    ends = steps.filter(F.col("b") == F.col("n") - 1).groupBy(*keys).agg(F.max(F.struct("score", (-F.col("t")).alias("back"))).alias("_e"))
    width = BEFORE + 1
    nodes = steps.join(ends, keys).select(
        F.struct(*keys).alias("tree"), (F.col("b") * width + F.col("t")).alias("node"),
        F.when(F.col("b") > 0, (F.col("b") - 1) * width + F.col("f")).alias("parent"),
        ((F.col("b") == F.col("n") - 1) & (F.col("t") == -F.col("_e")["back"])).cast("int").alias("end"),
    )
    path = tree_sums(nodes, {"ends": F.col("end")}).filter("ends > 0")
    place = F.struct((F.col("node") / width).cast("bigint").alias("b"), (F.col("node") % width).cast("int").alias("t"))
    letters = F.transform(F.array_sort(F.collect_list(place)), lambda x: F.substring(F.lit(RESIDUES + "-"), x["t"] + 1, F.lit(1)))
    return path.groupBy("tree").agg(F.array_join(letters, "").alias("sequence")).select("tree.*", "sequence")


def stationary(transitions: DataFrame, squarings: int = 7) -> DataFrame:
    """(state, share): first row of a large power, 2^squarings, of a transition table.

    ``transitions(from_state, to_state, share)``. Each squaring is a join and a
    sum over (number of states) squared rows.
    """
    m = cut(transitions.select("from_state", "to_state", "share"))
    for _ in range(squarings):
        right = m.select(F.col("from_state").alias("_mid"), F.col("to_state").alias("_to"), F.col("share").alias("_p"))
        m = cut(
            m.join(right, m["to_state"] == right["_mid"])
            .groupBy("from_state", F.col("_to").alias("to_state"))
            .agg(F.sum(F.col("share") * F.col("_p")).alias("share"))
        )
    top = m.agg(F.min("from_state").alias("_f"))
    return m.join(F.broadcast(top), F.col("from_state") == F.col("_f")).select(F.col("to_state").alias("state"), "share")


# --- trees ----------------------------------------------------------------


def rate_eigen(rates: np.ndarray, freqs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, values, right) of the rate matrix of symmetric rates and frequencies, one change per unit time."""
    q = rates * freqs[None, :]
    np.fill_diagonal(q, 0.0)
    np.fill_diagonal(q, -q.sum(axis=1))
    q /= -(freqs * np.diag(q)).sum()
    root = np.sqrt(freqs)
    values, vectors = np.linalg.eigh((root[:, None] * q) / root[None, :])
    return vectors / root[:, None], values, vectors.T * root[None, :]


def tree_site_loglik(
    nodes: DataFrame, cells: DataFrame, letters: str,
    eigen: tuple[np.ndarray, np.ndarray, np.ndarray], freqs: Sequence[float], rates: Sequence[float] = (1.0,),
) -> DataFrame:
    """(tree, col, loglik) of leaf letters ``cells(tree, node, col, aa)``.

    One join and one aggregate per level of the tree. A row holds the log
    scores of all letters of a (node, column, rate class); messages of children
    are added in logs by plain sums, which aggregate partially. A letter that
    is not one of ``letters`` counts as unknown. The transition matrix of a
    branch is worked out in its node row from the one eigen system. Inner nodes
    of one child are left out first, their branches added up.
    """
    s = len(letters)
    left, values, right = eigen
    short = cut(without_relays(nodes))
    depth = tree_sums(short, {}, {"depth": F.col("parent").isNotNull().cast("int")})
    joined = split(short, short.count(), KEY).join(depth, KEY)
    placed = cut(joined.select(*KEY, "parent", "branch_length", "depth"))
    per_node = split(placed, placed.count(), KEY).groupBy(*KEY, "depth").agg(F.count(F.lit(1)).alias("_n"))
    sizes = {r["depth"]: r for r in per_node.groupBy("depth").agg(F.sum("_n").alias("nodes"), F.max("_n").alias("most")).collect()}
    deepest = max(sizes)
    classes = F.array(*[F.struct(F.lit(i).alias("cls"), F.lit(float(r)).alias("rate")) for i, r in enumerate(rates)])
    hit = [F.when((F.col("aa") == a) | ~F.col("aa").isin(*letters), 0.0).otherwise(NEG_INF) for a in letters]
    # Letters are joined to their branches once, as one letter and one branch to a row.
    given = cut(cells.select(*KEY, "col", "aa"))
    n = given.count()
    on_tree = cut(split(given, n, KEY).join(placed, KEY).select("tree", "node", "parent", "col", "aa", "branch_length", "depth"))
    tipped = {r["depth"]: r["n"] for r in on_tree.groupBy("depth").agg(F.count(F.lit(1)).alias("n")).collect()}

    def tips(d: int) -> DataFrame:
        at = on_tree.filter(F.col("depth") == d)
        if d and sizes[d]["most"] > 1:
            # A node that comes twice counts its letters, and its branch, twice.
            at = at.join(placed.filter(F.col("depth") == d).select(*KEY), KEY)
        at = at.select(
            "tree", "node", "parent", "col", "branch_length", F.array(*hit).alias("l"), F.explode(classes).alias("_c")
        )
        return at.select("tree", "node", "parent", "col", "branch_length", "l", F.col("_c")["cls"].alias("cls"), F.col("_c")["rate"].alias("rate"))

    level, inner_rows = None, 0
    for d in range(deepest, 0, -1):
        j = tips(d) if d in tipped or level is None else None
        if level is not None:
            edge = placed.filter(F.col("depth") == d)
            up = split(level, inner_rows, KEY).join(edge, KEY).select("tree", "node", "parent", "col", "branch_length", "l", "cls", "rate")
            j = up if j is None else j.unionByName(up)
        t = F.col("branch_length") * F.col("rate")
        top = F.array_max("l")
        # exp(values t) first, then the two fixed matrices around it.
        w = F.transform("l", lambda x: F.exp(x - top))
        inner = [
            F.exp(F.lit(float(values[k])) * t) * _dot(_const(right[k]), F.col("_w")) for k in range(s)
        ]
        msg = [
            top + F.ln(F.greatest(sum((F.lit(float(left[a, k])) * F.get("_g", F.lit(k)) for k in range(1, s)),
                                      F.lit(float(left[a, 0])) * F.get("_g", F.lit(0))), F.lit(1e-300)))
            for a in range(s)
        ]
        sent = j.withColumn("_w", w).withColumn("_g", F.array(*inner)).select(
            "tree", F.col("parent").alias("node"), "col", "cls", "rate", *[m.alias(f"_m{a}") for a, m in enumerate(msg)]
        )
        # Many parents make many groups: dealt out by size. Few parents are hot: their sums aggregate partially.
        if d - 1 in sizes and sizes[d - 1]["nodes"] > FEW_PARENTS:
            sent = split(sent, tipped.get(d, 0) * len(rates) + inner_rows, ["tree", "node", "col"])
        level = cut(
            sent.groupBy("tree", "node", "col", "cls", "rate")
            .agg(*[F.sum(f"_m{a}").alias(f"_m{a}") for a in range(s)])
            .select("tree", "node", "col", F.array(*[F.col(f"_m{a}") for a in range(s)]).alias("l"), "cls", "rate")
        )
        inner_rows = level.count()
    rows = tips(0) if level is None else level
    top = F.array_max("l")
    total = top + F.ln(_dot(F.transform("l", lambda x: F.exp(x - top)), _const(freqs)))
    per_class = rows.select("tree", "col", total.alias("x"))
    best = per_class.groupBy("tree", "col").agg(F.max("x").alias("_t"))
    mean = F.max("_t") + F.ln(F.sum(F.exp(F.col("x") - F.col("_t"))) / float(len(rates)))
    return per_class.join(best, ["tree", "col"]).groupBy("tree", "col").agg(mean.alias("loglik"))


def weighted_loglik(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Total per tree of pattern scores times pattern weights (tree, col, weight)."""
    return scores.join(weights, ["tree", "col"]).groupBy("tree").agg(F.sum(F.col("loglik") * F.col("weight")).alias("loglik"))
