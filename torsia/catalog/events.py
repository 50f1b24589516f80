"""Jumps, intervals and traces."""

from pyspark.sql import functions as F

from torsia.operators import events as ops
from torsia.streaming.traces import trace_stream, write_trace_parts

from . import query
from .tables import EVENTS, event_rows, r6, table

STATES = ("click", "error", "purchase", "signup", "view")
_STATES_SQL = "st(s) AS (VALUES " + ", ".join(f"('{s}')" for s in STATES) + ")"
# Small on purpose: the larger users are then scanned in blocks.
BLOCK = 40
_IV = """iv AS (SELECT node, event_id, t, state, lead(state) OVER w AS next_state, coalesce(lead(t) OVER w, 1.0) - t AS dwell
  FROM ev WINDOW w AS (PARTITION BY node ORDER BY t))"""


def _dwells(spark, sf):
    return ops.intervals(event_rows(spark, sf), ["node"], rows_per_block=BLOCK)


@query("intervals", f"WITH {EVENTS}, {_IV} SELECT event_id, next_state, round(dwell, 9) + 0.0 AS dwell FROM iv")
def _(spark, sf):
    return _dwells(spark, sf).select("event_id", "next_state", r6(F.col("dwell"), 9).alias("dwell"))


@query(
    "collapse_repeats",
    f"""WITH {EVENTS} SELECT node, event_id, state FROM ev QUALIFY lag(state) OVER (PARTITION BY node ORDER BY t) IS DISTINCT FROM state""",
)
def _(spark, sf):
    return ops.collapse_repeats(event_rows(spark, sf), ["node"], rows_per_block=BLOCK).select("node", "event_id", "state")


@query(
    "state_at",
    f"""WITH {EVENTS}, u AS (SELECT node, arg_min(state, t) AS f FROM ev GROUP BY node),
      g AS (SELECT node, f, unnest(generate_series(0, 30)) * 86400000000 AS t_us FROM u)
    SELECT g.node, g.t_us, coalesce(ev.state, g.f) AS state FROM g ASOF LEFT JOIN ev ON g.node = ev.node AND g.t_us >= ev.t_us""",
)
def _(spark, sf):
    rows = event_rows(spark, sf)
    days = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda d: d.cast("bigint") * 86400000000)
    grid = rows.select("node").distinct().select("node", F.explode(days).alias("t_us"))
    return ops.state_at(rows, grid, ["node"], "t_us", "state", BLOCK)


@query(
    "interleave_tracks",
    f"""WITH {EVENTS}, r AS (SELECT node, t, state AS track, value FROM ev UNION ALL SELECT DISTINCT node, 1.0, NULL, NULL FROM ev)
    SELECT node, round(t, 9) + 0.0 AS t, track, {', '.join(f"last_value(CASE WHEN track = '{s}' THEN value END IGNORE NULLS) OVER w AS state_{s}" for s in STATES)},
      round(t - coalesce(lag(t) OVER (PARTITION BY node ORDER BY t), 0.0), 9) + 0.0 AS before
    FROM r WINDOW w AS (PARTITION BY node ORDER BY t ROWS UNBOUNDED PRECEDING)""",
)
def _(spark, sf):
    rows = event_rows(spark, sf).select(
        "node", F.col("state").alias("track"), F.lit(1).cast("bigint").alias("col"), "t", F.col("value").alias("state")
    )
    out = ops.interleave_tracks(rows, ["node"], STATES, rows_per_block=BLOCK).drop("col")
    return out.withColumns({"t": r6(F.col("t"), 9), "before": r6(F.col("before"), 9)})


@query(
    "symmetric_rates",
    f"""WITH {EVENTS}, {_IV}, {_STATES_SQL},
      g AS (SELECT a.s AS a, b.s AS b, 0.01 + (SELECT count(*) FROM iv WHERE state = a.s AND next_state = b.s) AS n, 0.001 + coalesce((SELECT sum(dwell) FROM iv WHERE state = a.s), 0) AS t
        FROM st a CROSS JOIN st b WHERE a.s <> b.s),
      r AS (SELECT g.a, g.b, (g.n + h.n) / (g.t + h.t) AS rate FROM g JOIN g h ON h.a = g.b AND h.b = g.a)
    SELECT a, b, round(rate, 5) + 0.0 AS rate FROM (SELECT * FROM r UNION ALL SELECT a, a, -sum(rate) FROM r GROUP BY a)""",
)
def _(spark, sf):
    return ops.symmetric_rates(_dwells(spark, sf), STATES).withColumn("rate", r6(F.col("rate"), 5))


@query(
    "exit_rate",
    f"""WITH {EVENTS}, {_IV} SELECT node, round(sum(dwell * length(state) / 10.0), 6) + 0.0 AS exit, count(next_state) AS jumps FROM iv GROUP BY node""",
)
def _(spark, sf):
    dwells = _dwells(spark, sf)
    rates = dwells.select("state").distinct().withColumn("rate", F.length("state") / 10.0)
    return ops.exit_rate(dwells, rates, ["node"]).withColumn("exit", r6(F.col("exit")))


@query(
    "branch_substitutions",
    f"""WITH {EVENTS} SELECT node, state AS track, count(*) - count(DISTINCT hour) AS jumps, round((count(*) - count(DISTINCT hour)) / 24.0, 6) + 0.0 AS per_site FROM ev GROUP BY ALL""",
)
def _(spark, sf):
    rows = event_rows(spark, sf).select("node", F.col("state").alias("track"), F.col("hour").alias("col"), "t")
    return ops.branch_substitutions(rows, 24).withColumn("per_site", r6(F.col("per_site")))


def _trace(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("run"), F.col("event_type").alias("param"), F.col("event_id").alias("iter"), "value"
    )


_TRACE = """tr AS (SELECT CAST(user_id AS VARCHAR) AS run, event_type AS param, event_id AS iter, value,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events)"""


@query(
    "trace_summary",
    f"""WITH {_TRACE} SELECT run, param, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS sd
    FROM tr WHERE i >= greatest(1, n // 2) GROUP BY ALL""",
)
def _(spark, sf):
    out = ops.trace_summary(_trace(spark, sf), rows_per_block=5)
    return out.withColumns({"mean": r6(F.col("mean")), "sd": r6(F.col("sd"))})


@query(
    "branch_posterior",
    f"""WITH {_TRACE} SELECT CAST(run AS BIGINT) AS node, param, count(*) AS n, round(avg(value), 6) + 0.0 AS mean,
      round(quantile_cont(value, 0.5), 6) + 0.0 AS median, any_value(c_acctbal) AS branch_length
    FROM tr JOIN customer ON c_custkey = CAST(run AS BIGINT) WHERE i >= greatest(1, n // 2) GROUP BY ALL""",
)
def _(spark, sf):
    trace = _trace(spark, sf).withColumn("node", F.col("run").cast("bigint"))
    nodes = table(spark, sf, "customer").select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("branch_length"))
    out = ops.branch_posterior(trace, nodes, rows_per_block=5)
    return out.withColumns({"mean": r6(F.col("mean")), "median": r6(F.col("median"))})


@query(
    "expanding_tail",
    f"""WITH {_TRACE} SELECT a.run, a.param, a.iter, count(*) AS n, round(avg(b.value), 5) + 0.0 AS mean, round(stddev_samp(b.value), 4) + 0.0 AS sd
    FROM tr a JOIN tr b ON a.run = b.run AND a.param = b.param AND b.i BETWEEN greatest(1, a.i // 3) AND a.i GROUP BY ALL""",
)
def _(spark, sf):
    out = ops.expanding_tail(_trace(spark, sf), parts=3, rows_per_block=5)
    return out.withColumns({"mean": r6(F.col("mean"), 5), "sd": r6(F.col("sd"), 4)})


@query(
    "expanding_median",
    f"""WITH {_TRACE} SELECT a.run, a.param, a.iter, count(*) AS n, round(quantile_cont(b.value, 0.5), 6) + 0.0 AS median
    FROM tr a JOIN tr b ON a.run = b.run AND a.param = b.param AND b.i BETWEEN greatest(1, a.i // 2) AND a.i GROUP BY ALL""",
)
def _(spark, sf):
    return ops.expanding_median(_trace(spark, sf)).withColumn("median", r6(F.col("median")))


@query(
    "running_rate",
    """SELECT user_id, event_id AS iter, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END)
      OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS rate FROM events""",
)
def _(spark, sf):
    rows = table(spark, sf, "events").select(
        "user_id", F.col("event_id").alias("iter"), (F.col("event_type") == "purchase").cast("int").alias("accepted")
    )
    return ops.running_rate(rows, ["user_id"], rows_per_block=BLOCK).select("user_id", "iter", r6(F.col("rate")).alias("rate"))


_MAP = """m AS (SELECT user_id, event_id AS pos, event_id % 4 AS target FROM events)"""


def _mapping(spark, sf):
    return table(spark, sf, "events").select("user_id", F.col("event_id").alias("pos"), (F.col("event_id") % 4).alias("target"))


@query(
    "fill_mapping",
    f"""WITH {_MAP}, w AS (SELECT *, max(CASE WHEN target > 0 THEN pos END) OVER (PARTITION BY user_id ORDER BY pos) AS l,
        min(CASE WHEN target > 0 THEN pos END) OVER (PARTITION BY user_id ORDER BY pos DESC) AS r FROM m)
    SELECT user_id, pos, coalesce(CASE WHEN l IS NULL THEN r % 4 WHEN r IS NULL OR pos - l <= r - pos THEN l % 4 ELSE r % 4 END, 0) AS target FROM w""",
)
def _(spark, sf):
    return ops.fill_mapping(_mapping(spark, sf), ["user_id"], rows_per_block=BLOCK)


@query("invert_mapping", f"WITH {_MAP} SELECT user_id, target, max(pos) AS pos FROM m WHERE target > 0 GROUP BY ALL")
def _(spark, sf):
    return ops.invert_mapping(_mapping(spark, sf), ["user_id"])


@query(
    "trace_stream",
    """SELECT CAST(user_id AS VARCHAR) AS run, event_type AS param, count(*) AS n, round(avg(value), 6) + 0.0 AS mean,
      min(value) AS least, max(value) AS most FROM events GROUP BY ALL""",
)
def _(spark, sf):
    folder = write_trace_parts(_trace(spark, sf))
    return trace_stream(spark, folder).withColumn("mean", r6(F.col("mean")))
