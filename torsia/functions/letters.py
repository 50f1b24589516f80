"""Residue letters, sequence cleaning and entry names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The twenty residues in alphabetical order, and their long names.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
THREE_LETTER = {
    "A": "ALA", "C": "CYS", "D": "ASP", "E": "GLU", "F": "PHE", "G": "GLY", "H": "HIS",
    "I": "ILE", "K": "LYS", "L": "LEU", "M": "MET", "N": "ASN", "P": "PRO", "Q": "GLN",
    "R": "ARG", "S": "SER", "T": "THR", "V": "VAL", "W": "TRP", "Y": "TYR",
}
# Descriptions with these words are not natural proteins.
UNNATURAL_WORDS = ("mutant", "recombinant", "synthetic", "humanized", "humanised")


_LOWER = "abcdefghijklmnopqrstuvwxyz"


def upper_ascii(c: Column) -> Column:
    """Upper case of a-z only, so that no other letter can turn into residues."""
    return F.translate(c, _LOWER, _LOWER.upper())


def canonical(c: Column, mode: str = "degap") -> Column:
    """One cleaning rule for sequences.

    ``degap`` drops ``-`` and upper-cases; ``mask`` also turns every other
    letter that is no residue into X; ``drop`` deletes those instead; ``rna``
    trims, drops ``-``, upper-cases and writes T for U.
    """
    if mode == "rna":
        return F.translate(upper_ascii(F.translate(F.trim(c), "-", "")), "U", "T")
    bare = upper_ascii(F.translate(c, "-", ""))
    if mode == "degap":
        return bare
    if mode == "mask":
        return F.regexp_replace(bare, f"[^{RESIDUES}]", "X")
    if mode == "drop":
        return F.regexp_replace(bare, f"[^{RESIDUES}]", "")
    raise ValueError(f"unknown mode {mode!r}")


def letter_index(c: Column) -> Column:
    """1..20 for a residue, 0 for anything else."""
    one = F.length(c) == 1
    return F.when(one, F.instr(F.lit(RESIDUES), c)).otherwise(0).cast("bigint")


def kmer_index(c: Column) -> Column:
    """Base-20 rank of a word of residues from 0, -1 if a letter is bad."""
    digits = F.transform(
        F.filter(F.split(c, ""), lambda x: x != ""),
        lambda x: F.instr(F.lit(RESIDUES), x) - 1,
    )
    value = F.aggregate(digits, F.lit(0).cast("bigint"), lambda acc, d: acc * 20 + d)
    return F.when(F.exists(digits, lambda d: d < 0), F.lit(-1).cast("bigint")).otherwise(value)


def residue_code(c: Column, to: str = "one") -> Column:
    """Three-letter name to one letter or back; unknown is X or XXX."""
    pairs = THREE_LETTER.items() if to == "three" else ((v, k) for k, v in THREE_LETTER.items())
    table = F.create_map(*[F.lit(x) for kv in pairs for x in kv])
    return F.coalesce(F.try_element_at(table, c), F.lit("XXX" if to == "three" else "X"))


def has_unnatural_word(c: Column, words=UNNATURAL_WORDS) -> Column:
    return F.lower(c).rlike("|".join(words))


def entry_name(header: Column) -> tuple[Column, Column]:
    """(pdb, chain) from the first word of a header, ``1abc_A ...``."""
    word = F.split(F.trim(header), r"\s+")[0]
    parts = F.split(word, "_")
    return parts[0], F.try_element_at(parts, F.lit(2))


def structure_name(name: Column) -> tuple[Column, Column]:
    """(pdb, chain) from ``pdb1abc_A``; blanks where the name is another."""
    parts = F.split(name, "_")
    head, tail = parts[0], F.try_element_at(parts, F.lit(2))
    ok = head.startswith("pdb") & (F.length(head) == 7) & (F.length(tail) > 0)
    blank = F.when(name.isNotNull(), F.lit(""))
    return F.when(ok, F.substring(head, 4, 4)).otherwise(blank), F.when(ok, F.substring(tail, 1, 1)).otherwise(blank)


def length_ratio_ok(a: Column, b: Column, cutoff: float = 0.5) -> Column:
    r = F.when(b > 0, a / b)
    return (r >= cutoff) & (r <= 1.0 / cutoff)


def md5_number(*columns: str) -> Column:
    """A number below 2^60 from the columns' texts: the first 15 digits of their md5.

    Each text stands behind its length and a null is a dash, so no two rows share a
    string. Any engine with md5 gives the same.
    """
    texts = [F.col(c).cast("string") for c in columns]
    told = F.concat(*[F.coalesce(F.concat(F.length(t), F.lit(":"), t), F.lit("-")) for t in texts])
    return F.conv(F.substring(F.md5(told.cast("binary")), 1, 15), 16, 10).cast("bigint")
