"""Row filters and relabelling of entries, families and sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torsia.functions.angles import null_to_sentinel as _null_to_sentinel
from torsia.functions.angles import sentinel_to_null as _sentinel_to_null
from torsia.functions.letters import (
    UNNATURAL_WORDS,
    canonical,
    entry_name,
    has_unnatural_word,
    md5_number,
    structure_name,
    upper_ascii,
)

from .ordered import ROWS_PER_BLOCK, numbered


def exclude_keywords(df: DataFrame, column: str, words: Sequence[str] = UNNATURAL_WORDS) -> DataFrame:
    return df.filter(~has_unnatural_word(F.col(column), words))


def quality_pass(df: DataFrame, strict: bool = True, limit: float = 0.25) -> DataFrame:
    """R and free R in (0, limit); without ``strict`` free R has no lower bound."""
    r, free = F.col("rvalue"), F.col("freervalue")
    ok = (r > 0) & (r < limit) & (free < limit)
    return df.filter(ok & (free > 0) if strict else ok)


def candidate_entries(df: DataFrame, min_len: int = 100, marker: str = "mol:protein") -> DataFrame:
    return df.filter(F.col("description").contains(marker) & (F.length("sequence") >= min_len))


def split_entry_name(df: DataFrame, column: str = "name", structure: bool = False) -> DataFrame:
    pdb, chain = (structure_name if structure else entry_name)(F.col(column))
    return df.withColumns({"pdb": pdb, "chain": chain})


def sentinel_to_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: _sentinel_to_null(F.col(c)) for c in columns})


def null_to_sentinel(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: _null_to_sentinel(F.col(c)) for c in columns})


def blind_marks(rows: DataFrame, proteins: DataFrame, structures: DataFrame) -> DataFrame:
    """``rows(protein, ...)`` with ``_all`` and ``_angles``, true where the lists name the protein, else null."""
    a = proteins.select("protein").distinct().withColumn("_all", F.lit(True))
    b = structures.select("protein").distinct().withColumn("_angles", F.lit(True))
    return rows.join(a, "protein", "left").join(b, "protein", "left")


def hide_marked(sites: DataFrame) -> DataFrame:
    """Sites with the marks of ``blind_marks``, hidden by them; the marks go."""
    hide = F.coalesce(F.col("_all"), F.lit(False))
    hide_angles = hide | F.coalesce(F.col("_angles"), F.lit(False))
    changed = {"aa": F.when(hide & (F.col("aa") != "-"), "X").otherwise(F.col("aa"))}
    for c in ("phi", "psi", "omega"):
        if c in sites.columns:
            changed[c] = F.when(~hide_angles, F.col(c))
    return sites.withColumns(changed).drop("_all", "_angles")


def blind(sites: DataFrame, proteins: DataFrame, structures: DataFrame) -> DataFrame:
    """Hide residue and angles of ``proteins``, angles only of ``structures``.

    Both lists have a column ``protein``. They are joined, not collected, so
    they may be of any length; small ones are broadcast by the optimiser.
    """
    return hide_marked(blind_marks(sites, proteins, structures)).select(*sites.columns)


def hash_sample(df: DataFrame, keys: Sequence[str], n: int, keep: Sequence[int]) -> DataFrame:
    """Keep ``keep`` of ``n`` slots. The slot depends on the keys only, so a rerun or a
    different partitioning keeps the same rows."""
    return df.filter((md5_number(*keys) % n).isin(list(keep)))


def class_from_name(df: DataFrame, column: str, rules: Sequence[tuple[str, int]] = (("_D_", 1), ("_S_", 2))) -> DataFrame:
    """Class by the first mark found in the name, 0 if none."""
    c: Column = F.lit(0)
    for mark, value in reversed(list(rules)):
        c = F.when(F.col(column).contains(mark), value).otherwise(c)
    return df.withColumn("class", c.cast("bigint"))


def motif_score(letters: DataFrame, weights: DataFrame) -> DataFrame:
    """Share of the total weight at positions whose letter is the wanted one.

    ``letters(id, pos, letter)``, ``weights(pos, letter, weight)``; the weights
    are a motif, one row per position.
    """
    total = weights.agg(F.sum("weight").alias("total"))
    hits = letters.join(weights, ["pos", "letter"], "left")
    return (
        hits.groupBy("id")
        .agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("hit"))
        .join(F.broadcast(total))  # one row
        .select("id", (F.col("hit") / F.col("total")).alias("score"))
    )


def check_alignment(df: DataFrame) -> DataFrame:
    """Rows whose alignment, without gaps, is not the sequence of the structure."""
    bare = canonical(F.col("aligned_sequence"))
    same = bare.eqNullSafe(upper_ascii(F.col("sequence")))
    return df.filter(~same).select(
        *df.columns, F.length(bare).alias("aligned_length"), F.length("sequence").alias("sequence_length")
    )


def rename_and_mask(
    df: DataFrame, blinded: DataFrame, copies: int = 2, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Names become seq1, seq2, ... in order; blinded rows lose their letters and
    are written once more per dummy copy."""
    one = df.withColumn("_all", F.lit(0))
    marked = (
        numbered(one, ["_all"], "seq_no", "no", rows_per_block)
        .drop("_all")
        .join(blinded.select("name").distinct().withColumn("_blind", F.lit(True)), "name", "left")
    )
    blind_row = F.coalesce(F.col("_blind"), F.lit(False))
    masked = F.when(blind_row, F.regexp_replace("sequence", "[^-]", "X")).otherwise(F.col("sequence"))
    many = F.when(blind_row, F.sequence(F.lit(0), F.lit(copies))).otherwise(F.array(F.lit(0)))
    base = F.concat(F.lit("seq"), F.col("no").cast("string"))
    return marked.withColumn("copy", F.explode(many)).select(
        F.col("name").alias("old_name"),
        F.when(F.col("copy") > 0, F.concat(base, F.lit("_"), F.col("copy").cast("string")))
        .otherwise(base)
        .alias("name"),
        masked.alias("sequence"),
    )


def union_sources(dfs: Sequence[DataFrame]) -> DataFrame:
    """Several sources as one table, order kept as ``source_no``."""
    out = None
    for i, df in enumerate(dfs):
        part = df.withColumn("source_no", F.lit(i).cast("bigint"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def blind_lists(names: DataFrame, mode: str, given: DataFrame | None = None) -> DataFrame:
    """Which proteins to hide: (protein, scope), scope ``all`` or ``structure``.

    ``every``: all fully; ``structures``: all, angles only; ``except``: all
    but the given ones; ``given``: the given ones.
    """
    names = names.select("protein").distinct()
    if mode == "structures":
        return names.withColumn("scope", F.lit("structure"))
    if mode == "every":
        chosen = names
    elif mode == "except":
        chosen = names.join(given.select("protein").distinct(), "protein", "left_anti")
    elif mode == "given":
        chosen = names.join(given.select("protein").distinct(), "protein", "left_semi")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return chosen.withColumn("scope", F.lit("all"))


def first_n(families: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n in the given order: Spark plans a top-n, not a full sort."""
    return families.orderBy(*order).limit(n)
