"""Near-duplicates by BagMinHash, banding and exact verification.

A document is a bag of five-word shingles. Each shingle drives Poisson processes
in time, one per dyadic range of weights (0,1], (1,2], (2,4], (4,8] and so on,
with a rate as wide as the range. A point falls on a random one of REGISTERS
registers and, in its range, on one cell of the discretised weights, found by
halving the range; it counts if the cell lies below the shingle's weight. The
first point of each register, over all shingles, is the signature: two bags
share a register with exactly their weighted Jaccard similarity. Processes end
once they are later than all registers of their document.

Texts with equal words form one class by digest. Signatures of one text per class
are cut into BANDS bands. In each band bucket all members are paired with the
least one, a star instead of all pairs, and verified on the whole bags. Buckets
that overlap form a cluster, verified links form components. In a cluster with
several components the members outside the largest one are outliers: each is
compared with all members of its cluster, in blocks of outliers against slices of
members, through an inverted index of the block's shingles. No pairs are written,
only links. So all links of a cluster are known up to components.

Defined results: null and empty texts and texts of punctuation have no shingle
and form one class; texts of one to four words have one shingle; copies share a
class; a null id never names a class that has other ids; an empty table gives no
rows. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, free, matched, text_rows, texts_of, written
from .components import components
from .shingles import U64, bag, from_blob, mix, overlap, shingles, to_blob, words

SIMILAR = 0.8
#: A pair at 0.8 shares none of 32 bands of 4 with probability 5e-8.
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Outliers of a block and members of a slice, on average.
OUTLIERS, MEMBERS = 256, 2000


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers above 0 and at most 1."""
    return ((x >> U64(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """(bags, registers) first times; infinite where a bag is empty."""
    sig = np.full((len(bags), registers), np.inf)
    if not bags or not sum(len(b[0]) for b in bags):
        return sig
    owner = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    item = np.concatenate([b[0] for b in bags]).astype(U64)
    weight = np.concatenate([b[1] for b in bags]).astype(np.int64)
    doc, seed, low, high, most = [], [], [], [], []
    lo, hi, level = 0, 1, 1
    alive = np.arange(len(item))
    while len(alive):
        doc.append(owner[alive])
        seed.append(mix(item[alive] + U64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
        low.append(np.full(len(alive), lo))
        high.append(np.full(len(alive), hi))
        most.append(weight[alive])
        alive = alive[weight[alive] > hi]
        lo, hi, level = hi, 2 * hi, level + 1
    doc, seed, low, high, most = (np.concatenate(x) for x in (doc, seed, low, high, most))
    time = np.zeros(len(doc))
    step = 0
    flat = sig.reshape(-1)
    while len(doc):
        step += 1
        draw = mix(seed + U64(step * 0xD1342543DE82EF95 & (1 << 64) - 1))
        time = time - np.log(_uniform(draw)) / (high - low)
        draw = mix(draw)
        place = (draw >> U64(32)) % U64(registers)
        # Halving the range k times is the same as k bits of a uniform cell number.
        cell = low + (draw & U64(0xFFFFFFFF)).astype(np.int64) % (high - low)
        good = cell < most
        np.minimum.at(flat, doc[good] * registers + place[good].astype(np.int64), time[good])
        on = time <= sig.max(axis=1)[doc]
        doc, seed, low, high, most, time = (x[on] for x in (doc, seed, low, high, most, time))
    return sig


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(bags, bands) numbers; a band's number depends on which band it is."""
    bits = sig.view(U64).reshape(len(sig), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), bits.shape[:2]).copy()
    for r in range(bits.shape[2]):
        key = mix(key * U64(0x9E3779B97F4A7C15) + bits[:, :, r])
    return key.view(np.int64)


def text_digest(text: str) -> bytes:
    return blake2b(words(text).tobytes(), digest_size=16).digest()


def signed(docs: DataFrame) -> DataFrame:
    """(id, digest, empty, bands) of each row of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column("id")
            for at in range(0, b.num_rows, 500):
                own = [words(t) for t in texts_of(b.slice(at, 500))]
                bags = [np.unique(shingles(w), return_counts=True) for w in own]
                keys = band_keys(signatures(bags))
                n = len(own)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        names.slice(at, n),
                        pa.array([blake2b(w.tobytes(), digest_size=16).digest() for w in own], pa.binary()),
                        pa.array([len(w) == 0 for w in own]),
                        lists,
                    ],
                    ["id", "digest", "empty", "bands"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, digest binary, empty boolean, bands array<long>")


def bags_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, bag) of the texts with the digests of ``nodes`` (node, id, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([text_digest(t) for t in texts], pa.binary()),
                    pa.array([to_blob(bag(t)) for t in texts], pa.binary()),
                ],
                ["digest", "bag"],
            )

    wanted = nodes.select(F.col("id").alias("_id")).distinct()
    near = docs.join(matched(wanted), F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    bags = near.select("text").mapInArrow(run, "digest binary, bag binary")
    return bags.join(matched(nodes.select("node", "digest")), "digest").select("node", "bag").dropDuplicates(["node"])


def verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            like = [
                overlap(from_blob(x), from_blob(y))
                for x, y in zip(t.column("bag_a").to_pylist(), t.column("bag_b").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [t.column("a"), t.column("b"), pa.array(like, pa.float64())], ["a", "b", "similarity"]
            )

    both = pairs.join(matched(bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a"))), "a").join(
        matched(bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b"))), "b"
    )
    return both.select("a", "b", "bag_a", "bag_b").mapInArrow(run, "a long, b long, similarity double")


def classes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR
) -> DataFrame:
    """(row, id, class_id, class_size, kept) per row of ``df``; the kept one is the class's least id."""
    batch_rows(df.sparkSession)
    docs = text_rows(df, id_col, text_col)
    rows = written(signed(docs).withColumn("row", F.monotonically_increasing_id()), "signed")
    return _classes(rows, docs, least)


def _classes(rows: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    nodes = written(
        rows.groupBy("digest").agg(
            F.min("row").alias("node"),
            F.min_by("id", "row").alias("id"),
            F.first("empty").alias("empty"),
            F.first("bands").alias("bands"),  # the same in each copy
        ),
        "nodes",
    )
    entries = nodes.filter(~F.col("empty")).select("node", F.explode("bands").alias("key"))
    hubs = written(
        entries.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1),
        "hubs",
    )
    members = written(entries.join(matched(hubs), "key").select("key", "hub", "n", "node"), "members")
    stars = members.filter(F.col("node") != F.col("hub")).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    stars = written(stars.distinct(), "stars")
    ends = stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).distinct()
    bags = written(bags_of(docs, nodes.join(matched(ends), "node").select("node", "id", "digest")), "bags")
    links = written(verified(stars, bags).filter(F.col("similarity") >= least).select("a", "b"), "links")
    # Each run of the rounds starts from the stars of the one before, which hold its components.
    roots = components(links)
    merged = roots.select(F.col("root").alias("a"), F.col("node").alias("b"))
    more = written(outlying(bags, components(merged.unionByName(stars)), roots, least), "links")
    if not more.isEmpty():
        roots = components(merged.unionByName(more))
    of = (
        rows.select("row", "id", "digest")
        .join(matched(nodes.select("digest", "node")), "digest")
        .join(matched(roots), "node", "left")
        .select("row", "id", F.coalesce("root", "node").alias("root"))
    )
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    named = of.groupBy("root").agg(first, F.count(F.lit(1)).alias("class_size"))
    return of.join(matched(named), "root").select(
        "row",
        "id",
        F.col("first.id").alias("class_id"),
        "class_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
    )


def outlying(bags: DataFrame, clusters: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """(a, b): links of cluster members outside their cluster's largest component."""
    of = bags.select("node").join(matched(clusters.withColumnRenamed("root", "cluster")), "node", "left")
    of = of.join(matched(roots), "node", "left").select(
        "node", F.coalesce("cluster", "node").alias("cluster"), F.coalesce("root", "node").alias("root")
    )
    sizes = of.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n"))
    told = (
        sizes.groupBy("cluster")
        .agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("main"))
        .filter(F.col("all") > F.col("main.n"))
        .select(
            "cluster",
            F.col("main.root").alias("main"),
            F.ceil((F.col("all") - F.col("main.n")) / OUTLIERS).alias("blocks"),
            F.ceil(F.col("all") / MEMBERS).alias("slices"),
        )
    )
    mixed = written(of.join(matched(told), "cluster"), "mixed")
    own = F.xxhash64("node")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = mixed.filter(F.col("root") != F.col("main")).select(
        "node", "cluster", F.pmod(own, F.col("blocks")).alias("block"), each("slices").alias("slice")
    )
    right = mixed.select("node", "cluster", each("blocks").alias("block"), F.pmod(own, F.col("slices")).alias("slice"))
    keys = ["cluster", "block", "slice"]

    def compare(_, outliers: pa.Table, members: pa.Table) -> pa.Table:
        a, b = [], []
        if outliers.num_rows:
            names, index = outliers.column("node").to_pylist(), Index(outliers.column("bag").to_pylist())
            for node, blob in zip(members.column("node").to_pylist(), members.column("bag").to_pylist()):
                near = [names[k] for k in index.similar(from_blob(blob), least)]
                b += [x for x in near if x != node]
                a += [node] * sum(x != node for x in near)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def with_bags(dealt: DataFrame):
        # Joined after dealing, so that a bag is copied once per block or slice and no more.
        # New names keep the two sides, which share their source, apart.
        both = dealt.join(matched(bags), "node")
        return both.select(*[F.col(c).alias(c) for c in ("node", "bag", *keys)]).groupBy(*keys)

    return with_bags(left).cogroup(with_bags(right)).applyInArrow(compare, "a long, b long")


class Index:
    """Shingles of some bags with their owners, to find the similar ones of a further bag."""

    def __init__(self, blobs: list[bytes]):
        bags = [from_blob(x) for x in blobs]
        value = np.concatenate([b[0] for b in bags])
        order = np.argsort(value, kind="stable")
        self.value = value[order]
        self.count = np.concatenate([b[1] for b in bags])[order]
        self.owner = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])[order]
        self.total = np.array([b[1].sum() for b in bags])

    def similar(self, other: tuple[np.ndarray, np.ndarray], least: float) -> list[int]:
        lo = np.searchsorted(self.value, other[0])
        many = np.searchsorted(self.value, other[0], side="right") - lo
        at = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
        both = np.minimum(self.count[at], np.repeat(other[1], many))
        shared = np.bincount(self.owner[at], both, len(self.total))
        return np.flatnonzero(shared >= least * (self.total + other[1].sum() - shared)).tolist()


def drop_near_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR
) -> DataFrame:
    """One row of each class, with its columns as they were."""
    batch_rows(df.sparkSession)
    (number,) = free(df, "_row")
    kept = written(df.withColumn(number, F.monotonically_increasing_id()), "numbered")
    docs = kept.select(F.col(number).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = written(signed(docs).withColumn("row", F.col("id")), "signed")
    gone = _classes(rows, docs, least).filter(~F.col("kept")).select(F.col("row").alias(number))
    return kept.join(written(gone, "gone"), number, "left_anti").select(*df.columns)
