"""Trie of conversations' beginnings, found by peeling off last turns.

A node of depth d is a distinct sequence of first d turns. Its key is a sum over
the turns of a number drawn from a turn's place, role and text (two sums of 60
bits each), so taking the last turn's number away gives the key of the node
above. A row carries its path: the numbers and lengths of its turns.

Peeling goes from the greatest depth to the root. Conversations that end at a node
are one row from the start, by their key. At depth d the rows that end there join
the nodes that survive from depth d + 1; rows with one key are merged, with partial
sums before the shuffle, into the nodes of depth d. Each node is written once,
complete with members, children, leaves and savings below it, and handed on without
its last turn, so nodes are found and summed up in the same pass.

Deep stretches of depths are peeled at once where nothing can merge in them: a row
whose beginning at the stretch's foot is that of no other row meets none on the
way down, and its nodes are written in one go. The other rows go through the upper
and then the lower half of the stretch. Below depth SHALLOW every depth is a round
of its own, and so is one of a short stretch with rows that meet.

Members that end at a node are told by a hash of their ids in ascending order.
Ids are first joined into strings of one BLOCK of the id range each, so a node
where a third of all conversations end is some short strings to the task that
hashes them in order, in constant memory.

Defined results: null roles and texts are empty; turns go by number, null first,
equal numbers by role and text; rows without conversation id belong to no
conversation; repeated rows are turns of their own; a turn's length counts code
points; an empty table has no conversation and so no root. The rounds are about the
depths in which different conversations meet, and logarithmic in the greatest depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from torsia.session import scratch_path

from .common import written

#: Ids of a node's ending members that are joined into one string, by range.
BLOCK = 512
SUM = "decimal(38,0)"
#: Places of a turn's two numbers in the hexadecimal digest.
HALVES = ((1, 15), (16, 15))


def decimal_id(c: Column) -> Column:
    return c.cast("string")


def rebuilt(
    talk: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, span: int = 100, most: int = 6
) -> tuple[DataFrame, DataFrame]:
    """(c, at, role, text) turns of the rebuilt conversations, ``at`` ascending, and (c) of all conversations.

    A conversation begins with the first crc32(id) modulo ``most`` turns of the
    first one of its span, and goes on with its own turns after as many.
    """
    turns = talk.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("c"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    order = W.partitionBy("c").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = written(turns.select("c", F.row_number().over(order).cast("long").alias("at"), "role", "text"), "turns")
    heads = turns.select("c").distinct().withColumn("h", F.crc32(decimal_id(F.col("c")).cast("binary")) % most)
    own = turns.join(heads, "c").filter("at > h").select("c", "at", "role", "text")
    # At most ``most`` - 1 turns of one conversation in ``span`` are lent, to at most ``span`` others.
    lent = turns.filter((F.col("at") < most) & (F.col("c") % span == 0)).withColumnRenamed("c", "b")
    taken = (
        heads.withColumn("b", F.col("c") - F.col("c") % span)
        .join(lent, "b")
        .filter("at <= h")
        .select("c", "at", "role", "text")
    )
    return own.unionByName(taken), heads.select("c")


def paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(c, depth, k1, k2, path) of every conversation; ``turns`` as (c, at, role, text)."""
    place = F.row_number().over(W.partitionBy("c").orderBy("at"))
    # Lengths stand between place, role and text, so no two turns share a string.
    told = F.concat_ws(":", F.col("place").cast("string"), F.length("role").cast("string"), "role", "text")
    digest = turns.withColumn("place", place).select("c", "place", F.md5(told).alias("m"), F.length("text").alias("n"))
    numbers = [F.conv(F.substr("m", F.lit(a), F.lit(n)), 16, 10).cast("long") for a, n in HALVES]
    step = F.struct("place", numbers[0].alias("a"), numbers[1].alias("b"), F.col("n").cast("long").alias("n"))
    lists = digest.groupBy("c").agg(F.sort_array(F.collect_list(step)).alias("path"))  # numbers, no texts
    lists = convs.join(lists, "c", "left").withColumn("path", F.coalesce("path", F.expr("cast(array() AS " + PATH + ")")))

    def total(field: str) -> Column:
        return F.aggregate("path", F.lit(0).cast(SUM), lambda x, s: (x + s[field]).cast(SUM))

    return lists.select("c", F.size("path").alias("depth"), total("a").alias("k1"), total("b").alias("k2"), "path")


PATH = "array<struct<place:int,a:bigint,b:bigint,n:bigint>>"
NODE = f"depth bigint, k1 {SUM}, k2 {SUM}, c bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint"
ROW = f"{NODE}, path {PATH}"
COLUMNS = ("depth", "k1", "k2", "c", "n_convs", "n_children", "n_leaves", "saved", "path")
#: Depths up to here are rounds of their own, and so are the depths of stretches up to SHORT.
SHALLOW, SHORT = 8, 2


def tail_sum(field: str, depth: int) -> Column:
    """Sum over the turns of a path beyond ``depth``."""
    return F.aggregate(F.slice("path", depth + 1, 1 << 30), F.lit(0).cast(SUM), lambda x, s: (x + s[field]).cast(SUM))


def cut_to(rows: DataFrame, depth: int, counted: bool = False) -> DataFrame:
    """Rows without the turns beyond ``depth``, of which each has some: one child of the node above.

    What those turns save is added, unless it is ``counted`` already.
    """
    lost = F.lit(0).cast("long") if counted else (F.col("n_convs") - 1) * tail_sum("n", depth).cast("long")
    return rows.select(
        F.lit(depth).cast("long").alias("depth"),
        (F.col("k1") - tail_sum("a", depth)).cast(SUM).alias("k1"),
        (F.col("k2") - tail_sum("b", depth)).cast(SUM).alias("k2"),
        "c",
        "n_convs",
        F.lit(1).cast("long").alias("n_children"),
        F.greatest("n_leaves", F.lit(1)).alias("n_leaves"),
        (F.col("saved") + lost).alias("saved"),
        F.slice("path", 1, depth).alias("path"),
    )


def merged(rows: DataFrame) -> DataFrame:
    """One row per node of a depth, from what ends there and the nodes below; its own turn isn't counted as saved yet."""
    return rows.groupBy("depth", "k1", "k2").agg(
        F.min("c").alias("c"),
        *[F.sum(x).alias(x) for x in ("n_convs", "n_children", "n_leaves", "saved")],
        F.any_value("path").alias("path"),
    )


def nodes_down_to(rows: DataFrame, depth: int) -> DataFrame:
    """The nodes that a row which meets no other passes, from its own to the one below ``depth``."""
    steps = rows.select(*COLUMNS[:-1], F.explode(F.slice("path", depth + 1, 1 << 30)).alias("s"))
    on = W.partitionBy("c").orderBy(F.col("s.place").desc())
    so_far = on.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = on.rowsBetween(W.unboundedPreceding, -1)

    def key(k: str, field: str) -> Column:
        return (F.col(k) - F.coalesce(F.sum(F.col(f"s.{field}").cast(SUM)).over(before), F.lit(0))).cast(SUM)

    own = F.col("s.place") == F.col("depth")
    return steps.select(
        F.col("s.place").cast("long").alias("depth"),
        key("k1", "a").alias("k1"),
        key("k2", "b").alias("k2"),
        "c",
        "n_convs",
        F.when(own, F.col("n_children")).otherwise(1).alias("n_children"),
        F.greatest("n_leaves", F.lit(1)).alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.sum("s.n").over(so_far)).alias("saved"),
        F.col("s.a").alias("a"),
        F.col("s.b").alias("b"),
    )


class Peeling:
    """Writes the nodes of one depth or stretch after the other."""

    def __init__(self, spark: SparkSession):
        self.spark, self.out, self.parts = spark, scratch_path(spark, "nodes"), 0

    def write(self, nodes: DataFrame) -> str:
        path = f"{self.out}/part={self.parts}"
        nodes.write.parquet(path)
        self.parts += 1
        return path

    def level(self, rows: DataFrame, depth: int) -> DataFrame:
        """Merges the rows of one depth; returns them cut to the depth above."""
        last = F.element_at("path", -1)
        nodes = merged(rows).select(
            *COLUMNS[:6],
            F.greatest("n_leaves", F.lit(1)).alias("n_leaves"),
            (F.col("saved") + (F.col("n_convs") - 1) * last["n"]).alias("saved"),
            "path",
            last["a"].alias("a"),
            last["b"].alias("b"),
        )
        return cut_to(self.spark.read.schema(ROW).parquet(self.write(nodes)), depth - 1, counted=True)

    def stretch(self, rows: DataFrame, low: int, high: int) -> DataFrame | None:
        """Peels rows of depths in (low, high]; returns what is left at depth ``low``."""
        if high - low <= SHORT or high <= SHALLOW:
            left = None
            for d in range(high, low, -1):
                here = both(rows.filter(F.col("depth") == d), left)
                left = self.level(here, d)
            return left
        rows = written(rows, "stretch")
        total = rows.count()
        if not total:
            return None
        foot = [(F.col(k) - tail_sum(f, low)).cast(SUM).alias(u) for k, f, u in (("k1", "a", "u1"), ("k2", "b", "u2"))]
        alone = (
            rows.select(*foot, F.struct(*COLUMNS).alias("row"))
            .groupBy("u1", "u2")
            .agg(F.count(F.lit(1)).alias("n"), F.any_value("row").alias("row"))
            .filter("n = 1")
            .select("row.*")
        )
        alone = written(alone, "alone")
        self.write(nodes_down_to(alone, low))
        left = cut_to(alone, low)
        if alone.count() < total:
            rest = written(rows.join(alone.select("c"), "c", "left_anti").select(*COLUMNS), "rest")
            middle = (low + high) // 2
            upper = self.stretch(rest.filter(F.col("depth") > middle), middle, high)
            lower = self.stretch(both(rest.filter(F.col("depth") <= middle), upper), low, middle)
            left = both(left, lower)
        return left


def both(a: DataFrame, b: DataFrame | None) -> DataFrame:
    return a if b is None else a.unionByName(b)


def peeled(convs: DataFrame) -> DataFrame:
    """All nodes, (node columns, keys of the node above as u1 and u2)."""
    spark = convs.sparkSession
    ended = convs.groupBy("depth", "k1", "k2").agg(
        F.min("c").alias("c"), F.count(F.lit(1)).alias("n_convs"), F.any_value("path").alias("path")
    )
    zero = F.lit(0).cast("long")
    ended = ended.select(
        F.col("depth").cast("long").alias("depth"), "k1", "k2", "c", "n_convs",
        zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved"), "path",
    )
    # In the order of depth, so a round reads few parts beside what ends there.
    ended = written(ended.repartitionByRange("depth", "c").sortWithinPartitions("depth"), "ended")
    depth = ended.agg(F.max("depth")).first()[0]
    peeling, left = Peeling(spark), None
    while depth:
        low = depth - 1 if depth <= SHALLOW else max(SHALLOW, depth // 2)
        here = ended.filter((F.col("depth") > low) & (F.col("depth") <= depth))
        left = peeling.stretch(both(here, left), low, depth)
        depth = low
    root = merged(both(ended.filter(F.col("depth") == 0), left)).select(
        *COLUMNS[:6], F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved", zero.alias("a"), zero.alias("b")
    )
    peeling.write(root)
    nodes = spark.read.schema(f"{NODE}, a bigint, b bigint").parquet(peeling.out)
    return nodes.select("*", (F.col("k1") - F.col("a")).cast(SUM).alias("u1"), (F.col("k2") - F.col("b")).cast(SUM).alias("u2"))


def ends(convs: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes where conversations end."""
    block = F.floor(F.col("c") / BLOCK)
    strings = (
        convs.groupBy("depth", "k1", "k2", block.alias("block"))
        .agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("c")), decimal_id)).alias("ids"))
        .repartition("k1", "k2")
        .sortWithinPartitions("depth", "k1", "k2", "block")
    )
    schema = f"depth long, k1 {SUM}, k2 {SUM}, ends_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            done: list[tuple] = []
            for d, k1, k2, ids in zip(*(b.column(c).to_pylist() for c in ("depth", "k1", "k2", "ids"))):
                if (d, k1, k2) == key:
                    state.update(b",")
                else:
                    if state is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (d, k1, k2), hashlib.sha256()
                state.update(ids.encode())
            yield batch(done)
        if state is not None:
            yield batch([(*key, state.hexdigest())])

    kinds = (pa.int64(), pa.decimal128(38, 0), pa.decimal128(38, 0), pa.string())

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(columns, kinds)], ["depth", "k1", "k2", "ends_sha256"]
        )

    return strings.select("depth", "k1", "k2", "ids").mapInArrow(run, schema)


def prefix_trie(
    talk: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    convs = written(paths(*rebuilt(talk, conv_col, turn_col, role_col, text_col)), "paths")
    nodes = peeled(convs)
    up = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("c").alias("parent_conv_id")
    )
    none = hashlib.sha256(b"").hexdigest()
    return (
        nodes.join(up, ["depth", "u1", "u2"], "left")
        .join(ends(convs), ["depth", "k1", "k2"], "left")
        .select(
            F.col("c").alias("conv_id"),
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
        )
    )
