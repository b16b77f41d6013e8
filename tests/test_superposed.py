"""Superpositions of many criteria in one aggregate, against singular value decomposition and one by one."""

from __future__ import annotations

import numpy as np
import pytest

from strandvote.operators import structure
from tests.test_operators import svd_rmsd

SCHEMA = "structure_id string, line_no long, model int, record string, atom_name string, element string, chain string, res_seq int, x double, y double, z double, b_factor double"
N = 20
FULL = {"start": 1, "end": N}


def atoms_of(spark, sets):
    """CA at the point, N beside it; one CA is listed twice, another in a second model."""
    rows = []
    for s, xyz in sets.items():
        rows.append((s, 0, 1, "ATOM", "CA", "C", "A", 1, 99.0, 99.0, 99.0, 50.0))
        for i, (x, y, z) in enumerate(xyz.tolist(), 1):
            rows += [(s, 2 * i, 1, "ATOM", "CA", "C", "A", i, x, y, z, 50.0), (s, 2 * i + 1, 1, "ATOM", "N", "N", "A", i, x + 0.5 * (i % 3), y + 1.0, z - 0.3 * i, 50.0)]
        rows.append((s, 999, 2, "ATOM", "CA", "C", "A", 2, -50.0, 0.0, 0.0, 50.0))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(5)
    first, second = rng.normal(size=(N, 3)) * 8, rng.normal(size=(N, 3)) * 8 + 40
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    sets = {"first": first, "second": second, "turned": first @ (q * np.sign(np.linalg.det(q))) - 7, "near": first + rng.normal(size=first.shape) * 0.4, "short": second[:9] + 0.1, "two": first[:2]}
    return sets, atoms_of(spark, sets)


def criteria_of(n):
    part = [
        {"name": "whole", "type": "rmsd", "ref_pdb": "first"}, {"name": "moved", "type": "rmsd", "ref_pdb": "first", "superposition_indices": {"start": 1, "end": 8}},
        {"name": "every", "type": "all_atom_rmsd", "ref_pdb": "first", "superposition_indices": [{"start": 2, "end": 6}, 9], "rmsd_indices": {"start": 3, "end": 19}},
        {"name": "tm", "type": "tmscore", "ref_pdb": "first"}, {"name": "tm2", "type": "tmscore", "ref_pdb": "second"}, {"name": "back", "type": "rmsd", "ref_pdb": "second", "rmsd_indices": {"start": 1, "end": 5}},
    ]
    part[2]["superposition_indices"] = [2, 3, 4, 5, 6, 9]
    return {"basics": {"full_index": FULL}, "filter_criteria": part[:n]}


def test_equals_svd_and_single_operators(case):
    sets, atoms = case
    refs = {k: atoms.where(f"structure_id = '{k}'") for k in ("first", "second")}
    got = {r["PDB"]: r for r in structure.all_metrics(atoms, refs, criteria_of(6)).collect()}
    first, second = sets["first"], sets["second"]
    for name in ("first", "second", "turned", "near"):
        p, r = sets[name], got[name]
        assert r["whole"] == pytest.approx(svd_rmsd(p, first, slice(None), slice(None)), abs=1e-6), name
        assert r["moved"] == pytest.approx(svd_rmsd(p, first, slice(0, 8), slice(None)), abs=1e-6), name
        assert r["back"] == pytest.approx(svd_rmsd(p, second, slice(None), slice(0, 5)), abs=1e-6), name
    # all atoms: CA of some residues make the pose, both atoms of others are measured
    i = np.arange(1, N + 1)
    beside = np.stack([0.5 * (i % 3), np.ones(N), -0.3 * i], 1)
    both = lambda p: np.concatenate([p, p + beside])
    sup, rms = [k - 1 for k in (2, 3, 4, 5, 6, 9)], [*range(2, 19), *range(N + 2, N + 19)]
    for name in ("first", "second", "turned", "near"):
        assert got[name]["every"] == pytest.approx(svd_rmsd(both(sets[name]), both(first), sup, rms), abs=1e-6), name
    whole = list(range(1, N + 1))
    every = {r["structure_id"]: r["all_atom_rmsd"] for r in structure.all_atom_rmsd(atoms, refs["first"], [2, 3, 4, 5, 6, 9], list(range(3, 20))).collect()}
    tm = {r["structure_id"]: r["tm_paired"] for r in structure.tm_score_paired(atoms, refs["first"]).collect()}
    tm2 = {r["structure_id"]: r["tm_paired"] for r in structure.tm_score_paired(atoms, refs["second"]).collect()}
    moved = {r["structure_id"]: r["m"] for r in structure.ca_rmsd(atoms, refs["first"], whole[:8], whole, name="m").collect()}
    for name in sets:
        for column, want in (("every", every), ("tm", tm), ("tm2", tm2), ("moved", moved)):
            assert got[name][column] == (None if want.get(name) is None else pytest.approx(want[name], abs=1e-6)), (name, column)


def test_exchanges_do_not_grow_with_criteria(case):
    _, atoms = case
    refs = {k: atoms.where(f"structure_id = '{k}'") for k in ("first", "second")}
    count = lambda n: structure.all_metrics(atoms, refs, criteria_of(n))._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(structure_id")
    assert count(2) == count(3) and count(4) == count(6)  # the first TM score adds one more look at the pairs


def test_no_criterion_and_no_structure(case):
    _, atoms = case
    refs = {"first": atoms.where("structure_id = 'first'")}
    assert structure.all_metrics(atoms.limit(0), refs, criteria_of(2)).count() == 0
    assert structure.all_metrics(atoms, refs, {"basics": {"full_index": FULL}, "filter_criteria": []}).columns == ["PDB", "plddt"]
    # a reference without any of the residues leaves its metrics null
    none = criteria_of(1)
    none["filter_criteria"][0] |= {"superposition_indices": [900], "rmsd_indices": [900]}
    assert {r["whole"] for r in structure.all_metrics(atoms, refs, none).collect()} == {None}
