"""Sequences and alignments: complement, CIGAR projection, codons, pileup letters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Nucleotide letters and their complements.
NUCLEOTIDES, COMPLEMENTS = "ATGCatgc", "TACGtacg"

# The bacterial genetic code (table 11), codons in the order T, C, A, G of each place.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def genetic_code() -> dict[str, str]:
    codons = (a + b + c for a in BASES for b in BASES for c in BASES)
    return dict(zip(codons, AMINO_ACIDS, strict=True))


def fourfold() -> list[str]:
    """Codons whose third base never changes the amino acid."""
    code = genetic_code()
    return sorted(x for x in code if len({code[x[:2] + b] for b in BASES}) == 1)


def translated(codon: Column) -> Column:
    """Amino acid of an upper-case codon; null for anything else."""
    pairs = [F.lit(x) for item in sorted(genetic_code().items()) for x in item]
    return F.try_element_at(F.create_map(*pairs), codon)


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), NUCLEOTIDES, COMPLEMENTS)


def is_nucleotide(base: Column, any_case: bool = True) -> Column:
    return base.rlike("^[ATGCatgc]$" if any_case else "^[ATGC]$")


def reference_accession(text: Column) -> Column:
    """First RefSeq-like accession in a text, or ''."""
    return F.regexp_extract(text, r"\w\w_\w+\d+", 0)


def without_reference_gaps(seq: Column, ref: Column) -> Column:
    """The letters of seq where ref holds a nucleotide."""
    at = F.sequence(F.lit(1), F.greatest(F.length(ref), F.lit(1)))
    kept = F.filter(at, lambda i: F.substr(ref, i, F.lit(1)).rlike("^[ATGCatgc]$"))
    return F.array_join(F.transform(kept, lambda i: F.substr(seq, i, F.lit(1))), "")


def map_to_reference(seq: Column, cigar: Column, gap: str = "*") -> Column:
    """A read's letters laid on the reference: M, X and = copy, I and S skip, D and N leave gaps, H and P nothing.

    cigar: array<struct<op:string,len:int>>.
    """
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        copies, skips, leaves = x["op"].isin("M", "X", "="), x["op"].isin("I", "S"), x["op"].isin("D", "N")
        return F.struct(
            (acc["at"] + F.when(copies | skips, x["len"]).otherwise(0)).alias("at"),
            F.concat(acc["out"], F.when(copies, F.substr(seq, acc["at"], x["len"])).when(leaves, F.repeat(F.lit(gap), x["len"])).otherwise("")).alias("out"),
        )

    return F.aggregate(cigar, start, step)["out"]


def codon_read(seq: Column, qual: Column, cigar: Column, least: int = 30) -> Column:
    """The codon programs' projection: low-quality letters are '-', and a read whose copied and clipped lengths do not add up to its own (any insertion) is empty."""
    spans = F.aggregate(F.filter(cigar, lambda x: x["op"].isin("M", "X", "=", "S")), F.lit(0), lambda a, x: a + x["len"])
    at = F.sequence(F.lit(1), F.greatest(F.length(seq), F.lit(1)))
    masked = F.array_join(F.transform(at, lambda i: F.when(F.get(qual, i - 1) < least, "-").otherwise(F.substr(seq, i, F.lit(1)))), "")
    return F.when((spans == F.length(seq)) & (spans == F.size(qual)), map_to_reference(masked, cigar, "-")).otherwise("")


def joined_mates(left: Column, left_pos: Column, right: Column, right_pos: Column) -> Column:
    """Mates as one sequence: a gap is filled with '*', in an overlap the left mate's letters win."""
    space = right_pos - left_pos - F.length(left)
    tail = F.when(-space >= F.length(right), F.lit("")).otherwise(F.substr(right, 1 - space, F.length(right)))
    return F.when(space >= 0, F.concat(left, F.repeat(F.lit("*"), F.greatest(space, F.lit(0))), right)).otherwise(F.concat(left, tail))


def back_translated(protein: Column, nucleotides: Column) -> Column:
    """Codons for an aligned protein: '-' is '---', each letter the next codon; a trailing stop codon is not used."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
    letters = F.filter(F.split(protein, ""), lambda x: x != "")

    def step(acc: Column, x: Column) -> Column:
        gap = x == "-"
        return F.struct((acc["at"] + F.when(gap, 0).otherwise(3)).alias("at"), F.concat(acc["out"], F.when(gap, "---").otherwise(F.substr(nucleotides, acc["at"], F.lit(3)))).alias("out"))

    return F.aggregate(letters, start, step)["out"]


def _without_indels(bases: str, two_digits: bool) -> str:
    out, i = [], 0
    while i < len(bases):
        if bases[i] in "+-":
            k = i + 1
            while k < len(bases) and bases[k].isdigit():
                k += 1
            size = int(bases[i + 1 : k] or 0)
            i = k + size if two_digits else i + 2 + size
        else:
            out.append(bases[i])
            i += 1
    return "".join(out)


def pileup_letters(bases: Column, ref: Column | None = None, compat: bool = True) -> Column:
    """The letters of a pileup column: read marks and indels removed; with ``ref``, '.' and ',' become it and letters upper case.

    ``compat`` keeps the original's span of start..start+2+N for an indel, which
    leaves one letter over when N has two digits, so that the row's length check
    drops it; without it such rows decode fully.
    """

    @F.arrow_udf("string")
    def strip(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([None if x is None else _without_indels(x, not compat) for x in column.to_pylist()], pa.string())

    plain = strip(F.regexp_replace(F.regexp_replace(bases, r"\^.", ""), r"\$", ""))
    if ref is None:
        return plain
    return F.upper(F.regexp_replace(plain, "[.,]", ref))


def masked_qualities(letters: Column, quals: Column, least: int = 30) -> Column:
    """Letters whose raw quality byte is below ``least`` become '*'. Printable qualities start at 33, so with the default none is masked."""
    at = F.sequence(F.lit(1), F.greatest(F.length(letters), F.lit(1)))
    return F.array_join(F.transform(at, lambda i: F.when(F.ascii(F.substr(quals, i, F.lit(1))) < least, "*").otherwise(F.substr(letters, i, F.lit(1)))), "")


# Codes of positions within a codon.
NON_CODING, FIRST, SECOND, THIRD, FOURFOLD, CODING = 0, 1, 2, 3, 4, 5


def position_type(flag: int, default: int = CODING) -> int:
    """The position type that a command-line number stands for."""
    return flag if flag in (NON_CODING, FIRST, SECOND, THIRD, FOURFOLD) else default


def of_type(pos_type: Column, wanted: int) -> Column:
    """Coding takes every codon position; third positions include the fourfold ones."""
    kinds = {CODING: (FIRST, SECOND, THIRD, FOURFOLD), THIRD: (THIRD, FOURFOLD)}.get(wanted, (wanted,))
    return pos_type.isin(*kinds)


def snp_text(pos: Column, letters: Column) -> Column:
    """A site as a line for people: its place and the letters over it."""
    return F.concat(F.lit("Pos: "), pos.cast("string"), F.lit(", Bases: "), letters)
