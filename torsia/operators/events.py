"""Jumps along branches, and traces of a sampler."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torsia.session import cut

from .columns import each_letter
from .ordered import ROWS_PER_BLOCK, neighbour, numbered, running
from .quantiles import exact_percentiles


def intervals(jumps: DataFrame, keys: Sequence[str], t: str = "t", state: str = "state", end: float = 1.0,
              rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Dwell time and next state of each jump; the last dwell ends at ``end``."""
    out = neighbour(jumps, keys, t, {"_t": t, "next_state": state}, 1, rows_per_block)
    return out.withColumn("dwell", F.coalesce(F.col("_t"), F.lit(end)) - F.col(t)).drop("_t")


def collapse_repeats(jumps: DataFrame, keys: Sequence[str], t: str = "t", state: str = "state",
                     rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Drop jumps to the state already held; the first row of a path stays."""
    marked = jumps.withColumn("_held", F.struct(F.col(state).alias("s")))
    out = neighbour(marked, keys, t, {"_was": "_held"}, -1, rows_per_block)
    return out.filter(F.col("_was").isNull() | ~F.col("_was")["s"].eqNullSafe(F.col(state))).drop("_held", "_was")


def state_at(jumps: DataFrame, grid: DataFrame, keys: Sequence[str], t: str = "t", state: str = "state",
             rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """State at each grid time: last jump at or before it, the first state if none.

    Jumps and grid go into one ordered stream per key and the state is carried
    forward, so no range of jumps is joined with a range of times.
    """
    a = jumps.select(*keys, t, F.lit(0).alias("_kind"), F.struct(F.col(state).alias("s")).alias("_s"))
    b = grid.select(*keys, t, F.lit(1).alias("_kind"), F.lit(None).cast(a.schema["_s"].dataType).alias("_s"))
    carried = running(a.unionByName(b), keys, [t, "_kind"], {"_last": ("last", F.col("_s"))}, rows_per_block)
    first = jumps.groupBy(*keys).agg(F.min_by(state, t).alias("_first"))
    held = F.when(F.col("_last").isNotNull(), F.col("_last")["s"]).otherwise(F.col("_first"))
    return carried.filter("_kind = 1").join(first, list(keys), "left").select(*keys, t, held.alias(state))


def interleave_tracks(
    jumps: DataFrame, keys: Sequence[str], tracks: Sequence[str], t: str = "t", end: float = 1.0,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Jumps of several tracks in one order, each with every track's state after it.

    ``jumps(keys, track, col, t, state)``. Columns: keys, step time ``t``,
    ``track``, ``state_<track>`` and ``before``, the time since the step before.
    A closing row at ``end`` has a null track. At equal times the later track of
    the list comes first, and within a track the lower column.
    """
    order = F.lit(None).cast("int")
    for i, name in enumerate(tracks):
        order = F.when(F.col("track") == name, len(tracks) - i).otherwise(order)
    ranked = jumps.filter(F.col("track").isin(list(tracks))).withColumn("_order", order)
    closing = ranked.select(*keys).distinct().withColumns(
        {t: F.lit(end), "_order": F.lit(len(tracks) + 1), "col": F.lit(None).cast("bigint")}
    )
    rows = ranked.select(*keys, "track", "col", t, "state", "_order").unionByName(closing, allowMissingColumns=True)
    by = [t, "_order", "col"]
    filled = running(
        rows, keys, by,
        {f"state_{n}": ("last", F.when(F.col("track") == n, F.col("state"))) for n in tracks}, rows_per_block,
    )
    out = neighbour(filled, keys, by, {"_t": t}, -1, rows_per_block)
    return out.select(
        *keys, t, "track", "col", *[f"state_{n}" for n in tracks], (F.col(t) - F.coalesce(F.col("_t"), F.lit(0.0))).alias("before")
    )


def symmetric_rates(dwells: DataFrame, states: Sequence[str], count0: float = 0.01, time0: float = 0.001) -> DataFrame:
    """(a, b, rate): jumps between a and b in either direction over the time spent in
    either, with starting counts; the diagonal is minus the row sum.

    ``dwells(state, next_state, dwell)`` is reduced to one row per pair of states at once.
    """
    pairs = cut(dwells.groupBy("state", "next_state").agg(F.count(F.lit(1)).alias("_n"), F.sum("dwell").alias("_t")))
    jumps = pairs.filter("next_state <> state").select(F.col("state").alias("a"), F.col("next_state").alias("b"), "_n")
    spent = pairs.groupBy("state").agg(F.sum("_t").alias("_t"))
    one = dwells.sparkSession.range(1)
    grid = each_letter(each_letter(one, "a", states), "b", states).drop("id").filter("a <> b")
    full = (
        grid.join(jumps, ["a", "b"], "left")
        .join(spent.withColumnRenamed("state", "a"), "a", "left")
        .select(
            "a", "b", (F.coalesce(F.col("_n"), F.lit(0)) + F.lit(count0)).alias("n"),
            (F.coalesce(F.col("_t"), F.lit(0.0)) + time0).alias("t"),
        )
    )
    back = full.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("n2"), F.col("t").alias("t2"))
    rates = full.join(back, ["a", "b"]).select("a", "b", ((F.col("n") + F.col("n2")) / (F.col("t") + F.col("t2"))).alias("rate"))
    diagonal = rates.groupBy("a").agg((-F.sum("rate")).alias("rate")).select("a", F.col("a").alias("b"), "rate")
    return rates.unionByName(diagonal)


def exit_rate(dwells: DataFrame, rates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per branch: sum of rate x dwell and number of jumps. ``rates(state, rate)``."""
    return dwells.join(rates, "state").groupBy(*keys).agg(
        F.sum(F.col("rate") * F.col("dwell")).alias("exit"),
        F.count("next_state").alias("jumps"),
    )


def branch_substitutions(jumps: DataFrame, columns: int | Column, keys: Sequence[str] = ("node", "track")) -> DataFrame:
    """Jumps per branch and track beyond the first entry of each path, and per site."""
    paths = jumps.groupBy(*keys, "col").agg((F.count(F.lit(1)) - 1).alias("_n"))
    n = columns if isinstance(columns, Column) else F.lit(columns)
    return paths.groupBy(*keys).agg(F.sum("_n").alias("jumps")).withColumn("per_site", F.col("jumps") / n)


# --- traces ---------------------------------------------------------------


def kept_tail(trace: DataFrame, keys: Sequence[str], parts: int = 2, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Rows from index max(1, n div parts) on, per run and parameter."""
    placed = numbered(trace, keys, "iter", "_i", rows_per_block)
    sizes = trace.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    start = F.greatest(F.lit(1), F.floor(F.col("_n") / parts))
    return placed.join(sizes, list(keys)).filter(F.col("_i") >= start).drop("_i", "_n")


def trace_summary(trace: DataFrame, keys: Sequence[str] = ("run", "param"), rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    kept = kept_tail(trace, keys, 2, rows_per_block)
    return kept.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")
    )


def branch_posterior(trace: DataFrame, nodes: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Per branch: input length, mean and median of the kept samples of each measure.

    ``trace(node, param, iter, value)``, ``nodes(node, branch_length)``.
    """
    kept = cut(kept_tail(trace, ["node", "param"], 2, rows_per_block))
    keys = ["node", "param"]
    median = exact_percentiles(kept, keys, "value", {"median": 0.5}, rows_per_block)
    stats = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).join(median, keys)
    return stats.join(nodes.select("node", "branch_length"), "node")


def expanding_tail(trace: DataFrame, keys: Sequence[str] = ("run", "param"), parts: int = 2,
                   rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """At each iteration i, mean and sd of the tail kept so far, rows max(1, i div parts) to i.

    Running sums give it without any window of growing size: the tail is the
    sum up to i less the sum up to its start, met by an equi-join on the index.
    Values are summed in two parts, multiples of 1/1024 (without any rounding up
    to 8e12) and the small rest, so long traces don't blur the difference.
    """
    sums = {}
    for name, x in (("s", F.col("value")), ("q", F.col("value") * F.col("value"))):
        coarse = F.rint(x * 1024.0) / 1024.0
        sums |= {f"_{name}": ("sum", coarse), f"_{name}_rest": ("sum", x - coarse)}
    r = cut(running(trace, keys, "iter", {"_i": ("count", F.lit(1)), **sums}, rows_per_block))
    before = r.select(*keys, (F.col("_i") + 1).alias("_start"), *[F.col(n).alias(f"{n}_0") for n in sums])
    start = F.greatest(F.lit(1), F.floor(F.col("_i") / parts)).cast("bigint")
    j = r.withColumn("_start", start).join(before, [*keys, "_start"], "left")
    n = (F.col("_i") - F.col("_start") + 1).cast("double")
    inside = {c: F.col(c) - F.coalesce(F.col(f"{c}_0"), F.lit(0.0)) for c in sums}
    s, q = inside["_s"] + inside["_s_rest"], inside["_q"] + inside["_q_rest"]
    var = F.greatest((q - s * s / n) / (n - 1.0), F.lit(0.0))
    return j.select(
        *keys, "iter", n.cast("bigint").alias("n"), (s / n).alias("mean"), F.when(n > 1, F.sqrt(var)).alias("sd")
    )


#: Digits of a rank: 16 values each.
DIGIT_BITS = 4


def _same(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join on columns of one name, nulls included; the right ones go."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") for c in on], *[c for c in right.columns if c not in on])
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(named, cond, how).drop(*[f"_r_{c}" for c in on])


def expanding_median(trace: DataFrame, keys: Sequence[str] = ("run", "param"), parts: int = 2,
                     rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(keys, iter, n, median): median at each iteration i of the tail kept so far, rows max(1, i div parts) to i.

    Order statistics of a sliding range by the digits of ranks. Each value has its
    rank within the trace. The values whose ranks share their leading digits form a
    node, in the order of the trace, and each row of a node knows how many up to it
    have which next digit. An iteration asks a node with a stretch of its rows: the
    counts at both ends tell the next digit of the wanted rank, and which stretch of
    the node below to go on with. So all iterations walk down together, two
    equi-joins a digit; no row is copied to the iterations whose tail holds it.

    Null values count as rows of the trace and are no value; a tail without values
    has a null median. ``n`` counts rows.
    """
    keys = list(keys)
    rows = trace.select(*keys, "iter", "value")
    placed = cut(running(rows, keys, "iter", {"_i": ("count", F.lit(1)), "_c": ("count", F.col("value"))}, rows_per_block))
    known = placed.filter("value is not null").select(*keys, "_c", "value")
    ranked = cut(numbered(known, keys, ["value", "_c"], "_rank", rows_per_block).withColumn("_rank", F.col("_rank") - 1))
    most = ranked.agg(F.max("_rank")).head()[0] or 0
    before = placed.select(*keys, (F.col("_i") + 1).alias("_start"), F.col("_c").alias("_from"))
    start = F.greatest(F.lit(1), F.floor(F.col("_i") / parts)).cast("bigint")
    tails = _same(placed.withColumn("_start", start), before, [*keys, "_start"], "left")
    tails = cut(tails.select(
        *keys, "iter", "_i", (F.col("_i") - F.col("_start") + 1).alias("n"), F.coalesce("_from", F.lit(0)).alias("_from"), F.col("_c").alias("_to")
    ))
    values = F.col("_to") - F.col("_from")
    # The middle one, or the two middle ones, counted from 0.
    middle = F.array_distinct(F.array(F.floor((values - 1) / 2), F.floor(values / 2)))
    asked = tails.filter("_to > _from").select(*keys, "_i", "_from", "_to", F.lit(0).cast("bigint").alias("_node"), F.explode(middle).alias("_k"))
    size = 1 << DIGIT_BITS
    for level in range(max(1, -(-int(most).bit_length() // DIGIT_BITS)) - 1, -1, -1):
        digit = F.shiftright("_rank", DIGIT_BITS * level).bitwiseAND(size - 1)
        node = ranked.select(*keys, "_c", F.shiftright("_rank", DIGIT_BITS * (level + 1)).alias("_node"), digit.alias("_digit"))
        counts = {f"_{d}": ("sum", (F.col("_digit") == d).cast("bigint")) for d in range(size)}
        here = running(node, [*keys, "_node"], "_c", {"_at": ("count", F.lit(1)), **counts}, rows_per_block)
        here = cut(here.select(*keys, "_node", "_at", F.array(*counts).alias("_upto")))
        ends = asked
        for end in ("_from", "_to"):
            side = here.withColumnsRenamed({"_at": end, "_upto": f"{end}_upto"})
            ends = _same(ends, side, [*keys, "_node", end], "left")
        none = F.array_repeat(F.lit(0).cast("bigint"), size)
        ends = ends.withColumns({c: F.coalesce(c, none) for c in ("_from_upto", "_to_upto")})
        inside = F.zip_with("_to_upto", "_from_upto", lambda b, a: b - a)
        # Passes the digits whose values all lie before the wanted one.
        walk = F.aggregate(
            inside,
            F.struct(F.lit(0).alias("d"), F.col("_k").alias("k"), F.lit(False).alias("found")),
            lambda acc, x: F.when(acc["found"], acc).when(acc["k"] < x, F.struct(acc["d"].alias("d"), acc["k"].alias("k"), F.lit(True).alias("found")))
            .otherwise(F.struct((acc["d"] + 1).alias("d"), (acc["k"] - x).alias("k"), F.lit(False).alias("found"))),
        )
        asked = ends.withColumn("_w", walk).select(
            *keys, "_i", F.get("_from_upto", F.col("_w")["d"]).alias("_from"), F.get("_to_upto", F.col("_w")["d"]).alias("_to"),
            (F.col("_node") * size + F.col("_w")["d"]).alias("_node"), F.col("_w")["k"].alias("_k"),
        )
    found = _same(asked.select(*keys, "_i", F.col("_node").alias("_rank")), ranked.select(*keys, "_rank", "value"), [*keys, "_rank"], "inner")
    medians = found.groupBy(*keys, "_i").agg(F.avg("value").alias("median"))
    return _same(tails, medians, [*keys, "_i"], "left").select(*keys, "iter", "n", "median")


def running_rate(trace: DataFrame, keys: Sequence[str], accepted: str = "accepted",
                 rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Accepted so far over tried so far, per key and row."""
    out = running(
        trace, keys, "iter", {"_a": ("sum", F.col(accepted).cast("double")), "_n": ("count", F.lit(1))}, rows_per_block
    )
    return out.withColumn("rate", F.col("_a") / F.col("_n")).drop("_a", "_n")


def fill_mapping(mapping: DataFrame, keys: Sequence[str], rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Each position without a target takes that of the nearest mapped one, left first on ties.

    ``mapping(keys, pos, target)``, target null or 0 where there is none.
    """
    here = F.when(F.col("target") > 0, F.struct("pos", "target"))
    m = mapping.withColumn("_neg", -F.col("pos"))
    left = running(m, keys, "pos", {"_l": ("last", here)}, rows_per_block)
    both = running(left, keys, "_neg", {"_r": ("last", here)}, rows_per_block)
    dl, dr = F.col("pos") - F.col("_l")["pos"], F.col("_r")["pos"] - F.col("pos")
    pick = (
        F.when(F.col("_l").isNull(), F.col("_r")["target"])
        .when(F.col("_r").isNull() | (dl <= dr), F.col("_l")["target"])
        .otherwise(F.col("_r")["target"])
    )
    return both.select(*keys, "pos", F.coalesce(pick, F.lit(0)).cast("bigint").alias("target"))


def invert_mapping(mapping: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, target, pos): the last position that maps to each target."""
    return mapping.filter("target > 0").groupBy(*keys, "target").agg(F.max("pos").alias("pos"))
