"""Metrics of structures from atom tables.

An atom table has a row an atom: structure_id, model, record, chain, res_seq, atom_name, element, x, y, z,
b_factor. Every metric is an aggregate by structure; the reference structure's atoms and the residue lists
are small tables of one protein.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import superpose as sp
from ..functions.text import element_mass, expand_indices
from ..storage import small

KEY = "structure_id"


def _is_ca(df: DataFrame) -> DataFrame:
    return df.where((F.col("record") == "ATOM") & (F.col("atom_name") == "CA"))


def plddt(atoms: DataFrame, residues: list[int], local: list[int] | None = None) -> DataFrame:
    """A1, A2: mean b_factor of CA atoms in residues (plddt) and in local (local_plddt); null without any."""
    mean = lambda r: F.avg(F.when(F.col("res_seq").isin(list(r)), F.col("b_factor")))
    more = [mean(local).alias("local_plddt")] if local else []
    return _is_ca(atoms).groupBy(KEY).agg(mean(residues).alias("plddt"), *more)


def seq_count(members: DataFrame, keys: list[str], query: bool = True) -> DataFrame:
    """A3: members of a group, with its query record."""
    return members.groupBy(*keys).agg((F.count("*") + int(query)).alias("seq_count"))


def center_columns(name: str, residues: list[int], where: Column | None = None) -> list[Column]:
    """A4: aggregates <name>_x, _y, _z, the mass-weighted centre of the atoms of residues, and <name>_n, the residues found."""
    mine = F.col("res_seq").isin(list(residues))
    mine = mine & where if where is not None else mine
    mass = F.when(mine, element_mass("element"))
    out = [F.try_divide(F.sum(F.col(a) * mass), F.sum(mass)).alias(f"{name}_{a}") for a in sp.AXES]
    return [*out, F.countDistinct(F.when(mine, F.col("res_seq"))).alias(f"{name}_n")]


def center_of_mass(atoms: DataFrame, residues: list[int]) -> DataFrame:
    """A4: structure_id, x, y, z; null without atoms."""
    return atoms.groupBy(KEY).agg(*center_columns("c", residues)).select(KEY, *[F.col(f"c_{a}").alias(a) for a in sp.AXES])


def _vector(a: str, b: str) -> list[Column]:
    return [F.col(f"{a}_{x}") - F.col(f"{b}_{x}") for x in sp.AXES]


def _dot(u: list[Column], v: list[Column]) -> Column:
    return sum((p * q for p, q in zip(u, v, strict=True)), F.lit(0.0))


def _distance_sums(set1: list[int], set2: list[int], chain: str = "A", prefix: str = "") -> tuple[list[Column], Column]:
    """Aggregates of atoms, and the distance as a column of them."""
    own, a, b = (F.col("chain") == chain) & (F.col("model") == 1), f"{prefix}a", f"{prefix}b"
    d = _vector(a, b)
    whole = (F.col(f"{a}_n") == len(set(set1))) & (F.col(f"{b}_n") == len(set(set2)))
    return [*center_columns(a, set1, own), *center_columns(b, set2, own)], F.when(whole, F.sqrt(_dot(d, d)))


def residue_distance(atoms: DataFrame, set1: list[int], set2: list[int], chain: str = "A", name: str = "distance") -> DataFrame:
    """G1: distance of the centres of two residue sets in the first model; null if any residue is missing."""
    sums, value = _distance_sums(set1, set2, chain)
    return atoms.groupBy(KEY).agg(*sums).select(KEY, value.alias(name))


def _angle_sums(domain1: list[int], domain2: list[int], hinge: list[int], prefix: str = "") -> tuple[list[Column], Column]:
    """Aggregates of atoms, and the angle as a column of them."""
    a, b, h = (f"{prefix}{x}" for x in "abh")
    u, v = _vector(a, h), _vector(b, h)
    cosine = F.try_divide(_dot(u, v), F.sqrt(_dot(u, u)) * F.sqrt(_dot(v, v)))
    value = F.when(cosine.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))
    return [*center_columns(a, domain1), *center_columns(b, domain2), *center_columns(h, hinge)], value


def domain_angle(atoms: DataFrame, domain1: list[int], domain2: list[int], hinge: list[int], name: str = "angle") -> DataFrame:
    """Angle in degrees at the hinge's centre; missing residues are passed over, an empty set gives null."""
    sums, value = _angle_sums(domain1, domain2, hinge)
    return atoms.groupBy(KEY).agg(*sums).select(KEY, value.alias(name))


def _points(df: DataFrame, prefix: str, chain: str | None, keys: list[str]) -> DataFrame:
    """Coordinates by key; of repeated keys the last line counts."""
    rows = df if chain is None else df.where((F.col("chain") == chain) & (F.col("model") == 1))
    order = F.col("line_no") if "line_no" in df.columns else F.lit(0)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*sp.AXES), order).alias("_p")).select(*keys, *[F.col(f"_p.{a}").alias(f"{prefix}{a}") for a in sp.AXES])


def match_atoms(ref: DataFrame, target: DataFrame, chain: str | None = "A") -> DataFrame:
    """Atoms of a target and the reference paired by residue number and atom name; the reference is one structure."""
    pairs = _points(target, "t", chain, [KEY, "res_seq", "atom_name"])
    return pairs.join(F.broadcast(_points(ref, "r", chain, ["res_seq", "atom_name"])), ["res_seq", "atom_name"])


def rmsd(pairs: DataFrame) -> DataFrame:
    """Root-mean-square of paired coordinates as they are."""
    square = sum(((F.col(f"t{a}") - F.col(f"r{a}")) ** 2 for a in sp.AXES), F.lit(0.0))
    return pairs.groupBy(KEY).agg(F.sqrt(F.avg(square)).alias("rmsd"))


def _poses(pairs: DataFrame) -> DataFrame:
    """By structure: the sums of its pairs, the root and the rotation."""
    sums = pairs.groupBy(KEY).agg(*sp.cross_sums("t", "r"))
    sums = sums.withColumns(sp.polynomial()).withColumn("root", sp.largest_root())
    return sums.withColumn("q", sp.quaternion())


def superposed(sup: DataFrame, moved: DataFrame) -> DataFrame:
    """Pairs moved, with their targets superposed on the reference over the pairs sup; poses without a rotation give null."""
    pose = _poses(sup).select(KEY, "q", *[f"m_{p}{a}" for p in "tr" for a in sp.AXES])
    both = moved.join(pose, KEY)
    return both.select(KEY, "res_seq", "atom_name", *[c.alias(f"t{a}") for a, c in sp.rotated("t", "r").items()], *[f"r{a}" for a in sp.AXES])


def ca_rmsd(atoms: DataFrame, ref: DataFrame, sup: list[int], rms: list[int] | None = None, chain: str = "A", name: str = "rmsd") -> DataFrame:
    """RMSD over the CA atoms of rms after superposition over those of sup, and n_pairs.

    Only residues that both structures have are paired. With equal sets the RMSD follows from the sums
    alone, in one pass; else atoms are moved. A pose that the points don't determine gives null.
    """
    pairs = match_atoms(_is_ca(ref), _is_ca(atoms), chain)
    if rms is None or sorted(set(rms)) == sorted(set(sup)):
        return _poses(pairs.where(F.col("res_seq").isin(list(sup)))).select(KEY, sp.least_rmsd().alias(name), F.col("n_pairs").cast("long").alias("n_pairs"))
    return _moved_rmsd(pairs.where(F.col("res_seq").isin(list(sup))), pairs.where(F.col("res_seq").isin(list(rms))), name)


def _moved_rmsd(sup: DataFrame, moved: DataFrame, name: str) -> DataFrame:
    at = superposed(sup, moved)
    square = sum(((F.col(f"t{a}") - F.col(f"r{a}")) ** 2 for a in sp.AXES), F.lit(0.0))
    return at.groupBy(KEY).agg(F.sqrt(F.avg(square)).alias(name), F.count("*").alias("n_pairs"))


def all_atom_rmsd(atoms: DataFrame, ref: DataFrame, sup: list[int], rms: list[int], chain: str = "A", name: str = "all_atom_rmsd") -> DataFrame:
    """Superposition over CA atoms, RMSD over all matched atoms of rms."""
    every = match_atoms(ref.where("record = 'ATOM'"), atoms.where("record = 'ATOM'"), chain)
    return _moved_rmsd(every.where((F.col("atom_name") == "CA") & F.col("res_seq").isin(list(sup))), every.where(F.col("res_seq").isin(list(rms))), name)


def tm_score_paired(atoms: DataFrame, ref: DataFrame, chain: str = "A", name: str = "tm_paired") -> DataFrame:
    """The TM sum over residues paired by number after superposition, by the reference's length.

    It doesn't search alignments, so it is a lower bound of an aligner's score; scores of an aligner (G6)
    come in as a metric column.
    """
    own = _is_ca(ref).where((F.col("chain") == chain) & (F.col("model") == 1))
    length = own.agg(F.countDistinct("res_seq").cast("double").alias("_l"))
    pairs = match_atoms(_is_ca(ref), _is_ca(atoms), chain)
    at = superposed(pairs, pairs).crossJoin(F.broadcast(length))  # one row
    square = sum(((F.col(f"t{a}") - F.col(f"r{a}")) ** 2 for a in sp.AXES), F.lit(0.0))
    return at.groupBy(KEY).agg((F.sum(_tm_sum(F.col("_l"), square)) / F.max("_l")).alias(name))


#: One-letter codes of the standard residues.
ONE_LETTER = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V"}
BOND = 1.8


def protein_sequence(atoms: DataFrame) -> DataFrame:
    """structure_id and seq, the one-letter sequence of residues bonded to a neighbour, first model.

    Residues follow each other by their first line; C of one within 1.8 of N of the next is a bond.
    """
    order = F.col("line_no") if "line_no" in atoms.columns else F.col("res_seq")
    at = lambda atom: F.max(F.when(F.col("atom_name") == atom, F.struct(*sp.AXES)))
    residues = atoms.where((F.col("model") == 1) & (F.col("record") == "ATOM")).groupBy(KEY, "chain", "res_seq", *(["icode"] if "icode" in atoms.columns else [])).agg(F.min(order).alias("first"), F.first("res_name").alias("res_name"), at("N").alias("n"), at("C").alias("c"))
    w = W.partitionBy(KEY, "chain").orderBy("first")
    d = lambda a, b: F.sqrt(sum(((a[x] - b[x]) ** 2 for x in sp.AXES), F.lit(0.0)))
    bonded = (d(F.lag("c").over(w), F.col("n")) < BOND).alias("back"), (d(F.col("c"), F.lead("n").over(w)) < BOND).alias("ahead")
    codes = F.create_map(*[F.lit(x) for pair in ONE_LETTER.items() for x in pair])
    found = residues.select(KEY, "chain", "first", F.try_element_at(codes, F.col("res_name")).alias("letter"), *bonded)
    found = found.where("letter IS NOT NULL AND (coalesce(back, false) OR coalesce(ahead, false))")
    letters = F.array_sort(F.collect_list(F.struct("chain", "first", "letter")))
    return found.groupBy(KEY).agg(F.array_join(F.transform(letters, lambda s: s["letter"]), "").alias("seq"))


def _distance(c: dict, prefix: str) -> tuple[list[Column], Column]:
    i = c["indices"]
    return _distance_sums(expand_indices(i["set1"]), expand_indices(i["set2"]), prefix=prefix)


def _angle(c: dict, prefix: str) -> tuple[list[Column], Column]:
    i = c["indices"]
    return _angle_sums(*[expand_indices(i[k]) for k in ("domain1", "domain2", "hinge")], prefix=prefix)


#: Aggregates and value of the criterion types that one pass over the atoms serves.
CENTRED: dict[str, Callable[[dict, str], tuple[list[Column], Column]]] = {"distance": _distance, "angle": _angle}
#: Criterion types that superpose structures on a reference.
SUPERPOSED = ("rmsd", "all_atom_rmsd", "tmscore")


def _tm_sum(length: Column, square: Column) -> Column:
    """One residue's part of a TM sum: by the squared distance of a pair and the reference's length."""
    d0 = F.when(length > 15, F.greatest(F.lit(0.5), 1.24 * F.cbrt(length - 15) - 1.8)).otherwise(0.5)
    return 1 / (1 + square / (d0 * d0))


def _reference_points(refs: dict[str, DataFrame], criteria: dict[int, dict], whole: list[int], chain: str) -> DataFrame:
    """criterion, res_seq, atom_name, rx, ry, rz, sup (the pose is made by it), mov (it is measured after the move) and length: a few atoms of one protein a criterion."""
    out = []
    for i, c in criteria.items():
        points = _points(refs[c["ref_pdb"]].where("record = 'ATOM'"), "r", chain, ["res_seq", "atom_name"])
        is_ca, tm = F.col("atom_name") == "CA", c["type"] == "tmscore"
        among = lambda name: F.lit(True) if tm else F.col("res_seq").isin(expand_indices(c.get(name), whole))  # noqa: B023, E731
        every = "all_atom_rmsd" in (c["type"], c.get("method"))
        points = points.withColumns({"sup": is_ca & among("superposition_indices"), "mov": (F.lit(True) if every else is_ca) & among("rmsd_indices")}).where("sup OR mov")
        out.append(points.select(F.lit(i).alias("criterion"), "res_seq", "atom_name", *[f"r{a}" for a in sp.AXES], "sup", "mov", F.count_if("sup").over(W.partitionBy(F.lit(i))).cast("double").alias("length")))
    return reduce(DataFrame.unionByName, out)


def superposed_metrics(atoms: DataFrame, refs: dict[str, DataFrame], criteria: dict[int, dict], whole: list[int], chain: str = "A") -> DataFrame:
    """G3, G4 and G6b of many criteria at once: structure_id and m_<number>, the value of each of criteria.

    The atoms that any criterion names are dealt by structure once. Conditional cross sums by structure and criterion
    give every pose, and every RMSD over the same or other atoms; TM sums take one more look at the pairs. So neither
    scans nor exchanges grow with the criteria.
    """
    points = small(_reference_points(refs, criteria, whole, chain))
    own = atoms.where((F.col("record") == "ATOM") & (F.col("chain") == chain) & (F.col("model") == 1)).join(points.select("res_seq", "atom_name"), ["res_seq", "atom_name"], "left_semi")
    pairs = _points(own.repartition(KEY), "t", chain, [KEY, "res_seq", "atom_name"]).join(points, ["res_seq", "atom_name"])
    sums = pairs.groupBy(KEY, "criterion").agg(*sp.cross_sums("t", "r", F.col("sup")), *sp.cross_sums("t", "r", F.col("mov"), "v_"))
    poses = sums.where("n_pairs > 0").withColumns(sp.polynomial()).withColumn("root", sp.largest_root()).withColumn("q", sp.quaternion())
    same = [i for i, c in criteria.items() if c["type"] != "tmscore" and "all_atom_rmsd" not in (c["type"], c.get("method")) and set(expand_indices(c.get("superposition_indices"), whole)) == set(expand_indices(c.get("rmsd_indices"), whole))]
    by_sums = [i for i, c in criteria.items() if c["type"] != "tmscore"]
    values = poses.where(F.col("criterion").isin(by_sums)).select(KEY, "criterion", F.when(F.col("criterion").isin(same), sp.least_rmsd()).otherwise(sp.moved_rmsd("t", "r", "v_")).alias("value"))
    if len(by_sums) < len(criteria):
        pose = poses.where(~F.col("criterion").isin(by_sums)).select(KEY, "criterion", "q", *[f"m_{p}{a}" for p in "tr" for a in sp.AXES])
        moved = pairs.where("mov").join(pose, [KEY, "criterion"])
        square = sum(((c - F.col(f"r{a}")) ** 2 for a, c in sp.rotated("t", "r").items()), F.lit(0.0))
        tm = moved.groupBy(KEY, "criterion").agg((F.sum(_tm_sum(F.col("length"), square)) / F.max("length")).alias("value"))
        values = values.unionByName(tm)
    return values.groupBy(KEY).agg(*[F.max(F.when(F.col("criterion") == i, F.col("value"))).alias(f"m_{i}") for i in criteria])


def all_metrics(atoms: DataFrame, refs: dict[str, DataFrame], criteria: dict, threshold: float = 0.0, drop_incomplete: bool = False) -> DataFrame:
    """PDB, plddt, [local_plddt] and a column a criterion, of structures above the confidence threshold.

    Confidence and the sums behind all distances and angles come from one pass of conditional aggregates, all
    superpositions from another one over the atoms of structures that pass. Unknown types are skipped. A metric that can't be computed is null; drop_incomplete drops such rows, but for distances.
    """
    basics = criteria.get("basics", {})
    whole, local = expand_indices(basics.get("full_index")), expand_indices(basics.get("local_index"))
    known = [c for c in criteria["filter_criteria"] if c["type"] in (*CENTRED, *SUPERPOSED)]
    centred = {i: CENTRED[c["type"]](c, f"_{i}") for i, c in enumerate(known) if c["type"] in CENTRED}
    ca = (F.col("record") == "ATOM") & (F.col("atom_name") == "CA")
    mean = lambda residues: F.avg(F.when(ca & F.col("res_seq").isin(list(residues)), F.col("b_factor")))
    sums = atoms.groupBy(KEY).agg(mean(whole).alias("plddt"), *([mean(local).alias("local_plddt")] if local else []), *[s for sums, _ in centred.values() for s in sums])
    out = sums.where((F.col("plddt") > threshold) & (F.col("plddt") != 0))
    out = out.select(KEY, "plddt", *(["local_plddt"] if local else []), *[value.alias(known[i]["name"]) for i, (_, value) in centred.items()])
    others = {i: c for i, c in enumerate(known) if i not in centred}
    if others:
        found = superposed_metrics(atoms.join(out.select(KEY), KEY, "left_semi"), refs, others, whole)
        out = out.join(found.withColumnsRenamed({f"m_{i}": c["name"] for i, c in others.items()}), KEY, "left")
    out = out.select(KEY, "plddt", *(["local_plddt"] if local else []), *[F.when(~F.isnan(c["name"]), F.col(c["name"])).alias(c["name"]) for c in known])
    needed = [c["name"] for c in known if c["type"] != "distance"]
    out = out.dropna(subset=needed) if drop_incomplete and needed else out
    return out.withColumnRenamed(KEY, "PDB")
