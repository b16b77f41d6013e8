"""Column functions on headers, sequences, index specifications and structure paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Standard atomic weights of the elements in protein structures.
MASSES = {"H": 1.008, "C": 12.011, "N": 14.007, "O": 15.999, "P": 30.974, "S": 32.06, "SE": 78.971, "NA": 22.990, "MG": 24.305, "CL": 35.45, "K": 39.098, "CA": 40.078, "FE": 55.845, "ZN": 65.38}


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def header_key(line: str | Column) -> Column:
    """The first token of a header, without its '>'."""
    return F.regexp_extract(F.regexp_replace(_c(line), "^>", ""), r"^\s*(\S*)", 1)


def strip_insertions(seq: str | Column) -> Column:
    """A sequence without its lower-case letters."""
    return F.regexp_replace(_c(seq), r"\p{Ll}", "")


def strict_residues(seq: str | Column) -> Column:
    """Only upper-case letters and gaps of a sequence."""
    return F.regexp_replace(_c(seq), r"[^\p{Lu}-]", "")


def expand_indices(spec: object, default: list[int] | None = None) -> list[int]:
    """Residue numbers of a range, a list of ranges or a list of numbers; nothing given: default."""
    if not spec:
        return list(default or [])
    out: list[int] = []
    for part in [spec] if isinstance(spec, dict) else spec:
        out += range(int(part["start"]), int(part["end"]) + 1) if isinstance(part, dict) else [int(part)]
    return out


def group_path(path: str | Column) -> Column:
    """P5: the alignment file of a structure's group."""
    return F.concat(F.substring_index(_c(path), "_unrelaxed", 1), F.lit(".a3m"))


def structure_path(group: str | Column, model: int = 1, seed: int = 42) -> Column:
    """P5, the other way: the first-ranked structure file of an alignment file."""
    return F.concat(F.regexp_replace(_c(group), r"\.a3m$", ""), F.lit(f"_unrelaxed_rank_001_alphafold2_ptm_model_{model}_seed_{seed:03d}.pdb"))


def seed_of(path: str | Column) -> Column:
    """The number after seed_ in the file name, else 0."""
    found = F.regexp_extract(F.substring_index(_c(path), "/", -1), r"seed_([0-9]+)", 1)
    return F.coalesce(F.nullif(found, F.lit("")).cast("int"), F.lit(0))


def number_after(path: str | Column, name: str) -> Column:
    """The number of a folder or file called name_<number>, as an int; null without one."""
    return F.nullif(F.regexp_extract(_c(path), rf"(?:^|/){name}_([0-9]+)", 1), F.lit("")).cast("int")


def round_of(path: str | Column) -> Column:
    return number_after(path, "round")


def iteration_of(path: str | Column) -> Column:
    return number_after(path, "Iteration")


def bin_label(bins: str | Column) -> Column:
    """bin_ and the sorted numbers of an array of bins."""
    return F.concat(F.lit("bin_"), F.array_join(F.array_sort(_c(bins)), "_"))


def gap_fraction(seq: str | Column, query_length: str | Column, gap: str = "-") -> Column:
    """Gaps of a sequence by the length of the query; null for an empty query."""
    gaps = F.length(_c(seq)) - F.length(F.replace(_c(seq), F.lit(gap), F.lit("")))
    return F.try_divide(gaps.cast("double"), _c(query_length).cast("double"))


def element_mass(element: str | Column) -> Column:
    """P10: the atomic mass of an element symbol; null if it is not known."""
    masses = F.create_map(*[F.lit(x) for pair in MASSES.items() for x in pair])
    return F.try_element_at(masses, F.upper(F.trim(_c(element))))
