"""k-mer counts, similarity joins and the screens built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torsia.functions.letters import (
    RESIDUES,
    UNNATURAL_WORDS,
    canonical,
    has_unnatural_word,
    length_ratio_ok,
)
from torsia.session import cut

from .overlaps import around, band, links_above, pairs_above, word_vectors


def dedup_exact(df: DataFrame) -> DataFrame:
    """Distinct sequences by SHA-256 of the cleaned letters, first in file order.

    Sequences that hold X are dropped first. ``min_by`` aggregates partially, so
    many copies of one sequence cost nothing extra in the shuffle.
    """
    clean = df.withColumn("sequence", canonical(F.col("sequence"))).filter(~F.col("sequence").contains("X"))
    rest = [c for c in df.columns if c != "seq_no"]
    return (
        clean.withColumn("digest", F.sha2("sequence", 256))
        .groupBy("digest")
        .agg(
            F.min("seq_no").alias("seq_no"),
            F.min_by(F.struct(*rest), "seq_no").alias("_row"),
            F.count(F.lit(1)).alias("copies"),
        )
        .select("seq_no", *[F.col("_row")[c].alias(c) for c in rest], "digest", "copies")
    )


def kmer_counts(df: DataFrame, k: int, mode: str = "skip", id_col: str = "id", share: bool = False) -> DataFrame:
    """Rows (id, kmer, n) of k-letter windows of ``sequence``.

    ``clean`` deletes bad letters first, so windows span them; ``skip`` drops
    windows that hold one. With ``share`` the column ``n`` is a share of all windows.
    """
    if mode not in ("clean", "skip"):
        raise ValueError(f"unknown mode {mode!r}")
    text = F.regexp_replace("sequence", f"[^{RESIDUES}]", "") if mode == "clean" else F.col("sequence")
    # A look-ahead finds overlapping windows in one pass over the text.
    found = F.regexp_extract_all(text, F.lit(f"(?=([{RESIDUES}]{{{k}}}))"), F.lit(1))
    windows = df.select(id_col, F.explode(found).alias("kmer"))
    counts = windows.groupBy(id_col, "kmer").agg(F.count(F.lit(1)).alias("n"))
    if not share:
        return counts
    total = counts.groupBy(id_col).agg(F.sum("n").alias("_t"))
    return counts.join(total, id_col).select(id_col, "kmer", (F.col("n") / F.col("_t")).alias("n"))


def _word_number(kmer: Column, k: int) -> Column:
    """Base-20 number of a k-letter word, plain arithmetic that stays in generated code."""
    total = F.lit(0).cast("bigint")
    for i in range(1, k + 1):
        total = total * 20 + (F.instr(F.lit(RESIDUES), F.substring(kmer, i, 1)) - 1)
    return total


# Room for the occurrence number of a word within one sequence.
OCCURRENCES = 1 << 32


def _tokens(counts: DataFrame, k: int, side: str) -> DataFrame:
    """(id_side, tokens_side): the windows of a sequence as distinct numbers.

    The i-th occurrence of a word is one token, so the number of tokens two
    sequences share is the sum of the smaller counts. One row per sequence; it
    holds no more than the sequence itself has letters.
    """
    base = _word_number(F.col("kmer"), k) * OCCURRENCES
    return counts.groupBy("id").agg(
        F.flatten(F.collect_list(F.sequence(base, base + F.col("n") - 1))).alias("tokens")
    ).select(F.col("id").alias(f"id_{side}"), F.col("tokens").alias(f"tokens_{side}"))


def _scored(pairs: DataFrame, ka: DataFrame, kb: DataFrame, k: int) -> DataFrame:
    joined = pairs.select("id_a", "id_b").join(_tokens(ka, k, "a"), "id_a").join(_tokens(kb, k, "b"), "id_b")
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    # One struct, so that the intersection is worked out once and not again in a filter.
    made = joined.select(
        "id_a", "id_b", F.explode(F.array(F.struct(shared.alias("o"), (F.size("tokens_a") + F.size("tokens_b")).alias("t")))).alias("_s")
    )
    return made.select("id_a", "id_b", (F.col("_s")["o"] / (F.col("_s")["t"] - F.col("_s")["o"])).alias("score"))


def pair_scores(pairs: DataFrame, a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """k-mer score of given pairs (id_a, id_b): shared windows over the union of windows."""
    return _scored(pairs, kmer_counts(a, k), kmer_counts(b, k), k)


def text_classes(df: DataFrame) -> DataFrame:
    """(id, rep): rows of equal ``digest`` share the least id of theirs as representative; null ones stand alone."""
    least = df.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"))
    return df.select("id", "digest").join(least, "digest", "left").select("id", F.coalesce("rep", "id").alias("rep"))


def _texts(df: DataFrame, k: int) -> DataFrame:
    """(id, sequence, digest, windows) written once; windows are counted from the runs of good letters."""
    runs = F.transform(F.split("sequence", f"[^{RESIDUES}]+"), lambda r: F.greatest(F.length(r) - (k - 1), F.lit(0)).cast("bigint"))
    windows = F.coalesce(F.aggregate(runs, F.lit(0).cast("bigint"), lambda acc, n: acc + n), F.lit(0).cast("bigint"))
    return cut(df.select("id", "sequence", F.sha2("sequence", 256).alias("digest"), windows.alias("windows")))


def _reachable(df: DataFrame, other: DataFrame, size: Column, factor: float) -> DataFrame:
    """Rows of a size within the factor of some row of the other side, and a few more."""
    bands = other.filter(size > 0).select(band(size, factor).alias("_b")).distinct().select(around(F.col("_b")).alias("_b")).distinct()
    return df.filter(size > 0).withColumn("_b", band(size, factor)).join(bands, "_b", "left_semi").drop("_b")


def _similar(
    a: DataFrame, b: DataFrame, k: int, cutoff: float, length_ratio: float | None, self_join: bool, strict: bool
) -> DataFrame:
    """(id_a, id_b, score) of distinct texts (id, sequence, windows); of a self join each pair once, in any order."""
    if self_join:
        return pairs_above(cut(word_vectors(a, k)), None, cutoff, length_ratio, strict)
    # Texts too long or too short for all of the other side go before any window is listed.
    a, b = _reachable(a, b, F.col("windows"), 1.0 / cutoff), _reachable(b, a, F.col("windows"), 1.0 / cutoff)
    if length_ratio is not None and 0.0 < length_ratio < 1.0:
        size = F.length("sequence")
        a, b = _reachable(a, b, size, 1.0 / length_ratio), _reachable(b, a, size, 1.0 / length_ratio)
    return pairs_above(cut(word_vectors(a, k)), cut(word_vectors(b, k)), cutoff, length_ratio, strict)


def similar_pairs(
    a: DataFrame,
    b: DataFrame,
    k: int,
    cutoff: float,
    length_ratio: float | None = None,
    self_join: bool = False,
    strict: bool = True,
) -> DataFrame:
    """Pairs (id_a, id_b, score) whose k-mer score is above ``cutoff``.

    The score is the weighted Jaccard share: windows in common over windows in
    either. Both sides need (id, sequence). ``self_join`` keeps id_a < id_b.

    Equal texts are compared once and told apart again at the end, so copies
    cost rows of the result only; ``similar_links`` doesn't list them at all.
    Texts meet in blocks of like size (``overlaps``): sizes must agree within
    the factor c, so only neighbouring size classes meet. Each two blocks are one
    task, which bounds the windows in common of all its pairs by products of
    matrices and counts them where the bound reaches the score.
    """
    if not 0.0 < cutoff <= 1.0:
        raise ValueError("cutoff lies in (0, 1]")
    ta = _texts(a, k)
    tb = ta if self_join else _texts(b, k)
    ca = cut(text_classes(ta))
    cb = ca if self_join else cut(text_classes(tb))
    ra = ta.join(ca.filter("id = rep").select("id"), "id", "left_semi")
    rb = ra if self_join else tb.join(cb.filter("id = rep").select("id"), "id", "left_semi")
    found = _similar(ra, rb, k, cutoff, length_ratio, self_join, strict)
    ma = ca.select(F.col("id").alias("_a"), F.col("rep").alias("id_a"))
    mb = cb.select(F.col("id").alias("_b"), F.col("rep").alias("id_b"))
    told = found.join(ma, "id_a").join(mb, "id_b")
    if not self_join:
        return told.select(F.col("_a").alias("id_a"), F.col("_b").alias("id_b"), "score")
    out = told.select(F.least("_a", "_b").alias("id_a"), F.greatest("_a", "_b").alias("id_b"), "score")
    if strict and cutoff >= 1.0:
        return out
    # Copies of one text have the score 1 if the text has any window.
    known = ra.filter("windows > 0").select(F.col("id").alias("rep"))
    one, two = (ca.join(known, "rep", "left_semi").select(F.col("id").alias(c), "rep") for c in ("id_a", "id_b"))
    return out.unionByName(one.join(two, "rep").filter("id_a < id_b").select("id_a", "id_b", F.lit(1.0).alias("score")))


def similar_links(df: DataFrame, k: int, cutoff: float, length_ratio: float | None = None, strict: bool = True) -> DataFrame:
    """(id, rep, copies, links): each row's class of equal texts and how many other rows score above ``cutoff``.

    ``copies`` is the size of the class. Links between classes are counted from
    pairs of representatives and sizes, so a text held by a third of all rows
    costs one row in the comparison and one per copy in the result. Rows without
    any window, null ones too, have no links.
    """
    if not 0.0 < cutoff <= 1.0:
        raise ValueError("cutoff lies in (0, 1]")
    texts = _texts(df, k)
    classes = cut(text_classes(texts))
    sizes = cut(classes.groupBy("rep").agg(F.count(F.lit(1)).alias("copies")))
    reps = texts.join(sizes.select(F.col("rep").alias("id")), "id", "left_semi")
    vectors = cut(word_vectors(reps, k).join(sizes.select(F.col("rep").alias("id"), "copies"), "id"))
    away = links_above(vectors, cutoff, length_ratio, strict).withColumnRenamed("id", "rep")
    own = F.col("copies") - 1 if not strict or cutoff < 1.0 else F.lit(0)
    known = reps.select(F.col("id").alias("rep"), (F.col("windows") > 0).alias("_has"))
    per = (
        sizes.join(away, "rep", "left")
        .join(known, "rep", "left")
        .select("rep", "copies", (F.coalesce("away", F.lit(0)) + F.when(F.col("_has"), own).otherwise(0)).alias("links"))
    )
    return classes.join(per, "rep").select("id", "rep", "copies", "links")


def best_homologs(
    entries: DataFrame,
    queries: DataFrame,
    k2: float = 0.2,
    k3: float = 0.2,
    length_ratio: float = 0.5,
    words: Sequence[str] = UNNATURAL_WORDS,
    limit: int | None = None,
) -> DataFrame:
    """Best query per entry, then one hit per structure in file order.

    ``entries(seq_no, name, pdb, sequence)`` with optional rvalue and
    freervalue, ``queries(query_no, sequence)``. The cheap filters come first
    (words, length ratio), then the 3-mer score with its candidate filter; the
    2-mer score is worked out only for the few pairs left.
    """
    kept = entries.filter(~has_unnatural_word(F.col("name"), words))
    a = kept.select(F.col("seq_no").alias("id"), "sequence")
    b = queries.select(F.col("query_no").alias("id"), "sequence")
    hits3 = cut(similar_pairs(a, b, 3, k3, length_ratio))
    # Two-letter windows are counted for sequences with a hit only.
    met = [d.join(hits3.select(F.col(c).alias("id")).distinct(), "id", "left_semi") for d, c in ((a, "id_a"), (b, "id_b"))]
    hits2 = pair_scores(hits3, *met, 2).filter(F.col("score") > k2)
    hits = hits3.join(hits2.withColumnRenamed("score", "score2"), ["id_a", "id_b"])
    best = hits.groupBy("id_a").agg(
        F.max_by(
            F.struct(F.col("id_b").alias("query_no"), "score", "score2"),
            F.struct("score", (-F.col("id_b")).alias("first")),
        ).alias("_best")
    )
    rows = kept.join(best, kept["seq_no"] == best["id_a"]).select(
        *kept.columns,
        F.col("_best")["query_no"].alias("query_no"),
        F.col("_best")["score"].alias("score3"),
        F.col("_best")["score2"].alias("score2"),
    )
    if {"rvalue", "freervalue"} <= set(rows.columns):
        r, f = F.col("rvalue"), F.col("freervalue")
        rows = rows.filter((r > 0) & (r < 0.25) & (f > 0) & (f < 0.25))
    cols = [c for c in rows.columns if c != "pdb"]
    first = rows.groupBy("pdb").agg(F.min_by(F.struct(*cols), "seq_no").alias("_first"))
    out = first.select("pdb", *[F.col("_first")[c].alias(c) for c in cols])
    return out if limit is None else out.orderBy("seq_no").limit(limit)


def non_redundant(
    entries: DataFrame,
    pairs: DataFrame,
    given: DataFrame | None = None,
    structure: str | None = None,
) -> DataFrame:
    """Entries accepted by a walk in file order, none like one accepted before.

    ``entries(seq_no, ...)``, ``pairs(id_a, id_b)`` similar entries,
    ``given(id)`` entries that clash with a set fixed beforehand. With
    ``structure`` only one entry per value of that column is taken.

    Rounds give the answer of the walk: accept every open entry that has no
    open neighbour before it, then close the neighbours of those. Entries of
    one structure clash with each other; that is settled by a minimum per
    structure, never by listing the pairs of the group.
    """
    spark = entries.sparkSession
    group = F.col(structure) if structure else F.lit(None).cast("string")
    state = entries.select(F.col("seq_no").alias("id"), group.alias("grp"))
    if given is not None:
        state = state.join(given.select("id").distinct(), "id", "left_anti")
    edges = cut(
        pairs.select(F.least("id_a", "id_b").alias("lo"), F.greatest("id_a", "id_b").alias("hi"))
        .filter("lo <> hi")
        .distinct()
    )
    open_rows = cut(state)
    accepted = []
    while True:
        live = edges.join(open_rows.select(F.col("id").alias("lo")), "lo", "left_semi").join(
            open_rows.select(F.col("id").alias("hi")), "hi", "left_semi"
        )
        later = live.select(F.col("hi").alias("id")).distinct()
        ready = open_rows.join(later, "id", "left_anti")
        if structure:
            # First open entry of each structure; it must also be free of similar ones.
            first = open_rows.filter("grp is not null").groupBy("grp").agg(F.min("id").alias("_first"))
            ready = ready.join(first, "grp", "left").filter("grp is null or id = _first").drop("_first")
        taken = cut(ready.select("id", "grp"))
        if taken.isEmpty():
            break
        accepted.append(taken)
        near = live.join(taken.select(F.col("id").alias("lo")), "lo", "left_semi").select(F.col("hi").alias("id"))
        left = open_rows.join(taken.select("id").union(near).distinct(), "id", "left_anti")
        if structure:
            left = left.join(taken.filter("grp is not null").select("grp").distinct(), "grp", "left_anti")
        open_rows = cut(left.select("id", "grp"))
        if open_rows.isEmpty():
            break
    ids = None
    for t in accepted:
        ids = t.select("id") if ids is None else ids.union(t.select("id"))
    if ids is None:
        ids = spark.createDataFrame([], "id bigint")
    return entries.join(ids, entries["seq_no"] == ids["id"], "left_semi")


def random_entries(entries: DataFrame, n: int = 250, keep: Sequence[int] = (0,), min_len: int = 100) -> DataFrame:
    """Screened, hash-sampled entries of good quality, first one per structure."""
    from .filters import candidate_entries, exclude_keywords, hash_sample, quality_pass

    rows = quality_pass(
        hash_sample(exclude_keywords(candidate_entries(entries, min_len), "description"), ["name"], n, keep)
    )
    cols = [c for c in rows.columns if c != "pdb"]
    return (
        rows.groupBy("pdb")
        .agg(F.min_by(F.struct(*cols), "seq_no").alias("_first"))
        .select("pdb", *[F.col("_first")[c].alias(c) for c in cols])
    )
