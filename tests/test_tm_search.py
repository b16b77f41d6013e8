"""TM search against the same search written plainly with singular value decomposition."""

from __future__ import annotations

import numpy as np
import pytest

from strandvote.operators import structure, tm_search
from tests.test_operators import points


def pose(p, q):
    a, b = p - p.mean(0), q - q.mean(0)
    u, _, vt = np.linalg.svd(a.T @ b)
    r = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
    return lambda x: (x - p.mean(0)) @ r + q.mean(0)


def plain(p, ref, least, rounds=20):
    n, length = len(p), len(ref)
    q = ref[:n]
    d0 = max(0.5, 1.24 * np.cbrt(length - 15) - 1.8) if length > 15 else 0.5
    cut, best = min(8.0, max(4.5, d0)), 0.0
    size, sizes = n, []
    for k in range(int(np.log2(n / least)) + 1 if n > least else 1):
        sizes.append(n // 2**k)
    for size in sizes:
        for start in sorted({*range(0, n - size + 1, max(1, size // 2)), n - size}):
            chosen = np.zeros(n, bool)
            chosen[start : start + size] = True
            for _ in range(rounds):
                d2 = ((pose(p[chosen], q[chosen])(p) - q) ** 2).sum(1)
                best = max(best, (1 / (1 + d2 / d0**2)).sum() / length)
                near = d2 <= max(cut**2, np.sort(d2)[min(3, n) - 1])
                if (near == chosen).all():
                    break
                chosen = near
    return best


def test_equals_a_plain_search(spark):
    rng = np.random.default_rng(4)
    ref = np.cumsum(rng.normal(size=(40, 3)) * 2.2, 0)
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    hinge = ref.copy()
    hinge[20:] = (ref[20:] - ref[20]) @ turn + ref[20]
    sets = {"ref": ref, "hinge": hinge, "noise": ref @ turn + rng.normal(size=ref.shape), "other": np.cumsum(rng.normal(size=(40, 3)) * 2.2, 0), "short": hinge[:13], "five": ref[:5] + rng.normal(size=(5, 3))}
    atoms = points(spark, sets)
    reference = atoms.where("structure_id = 'ref'")
    got = {r["structure_id"]: r["tm_searched"] for r in tm_search.tm_score_searched(atoms, reference).collect()}
    once = {r["structure_id"]: r["tm_paired"] for r in structure.tm_score_paired(atoms, reference).collect()}
    for name, p in sets.items():
        assert got[name] == pytest.approx(plain(p, ref, tm_search.LEAST), abs=1e-6), name
        assert got[name] >= once[name] - 1e-12, name
    assert got["ref"] == pytest.approx(1) and got["hinge"] > once["hinge"] + 0.1


def test_open_poses_and_no_structure(spark):
    atoms = points(spark, {"ref": [(i, i % 2, i % 3) for i in range(20)], "one": [(1, 2, 3)]})
    reference = atoms.where("structure_id = 'ref'")
    got = {r["structure_id"]: r["tm_searched"] for r in tm_search.tm_score_searched(atoms, reference).collect()}
    assert got["ref"] == pytest.approx(1) and got["one"] is None
    assert tm_search.tm_score_searched(atoms.limit(0), reference).count() == 0


def test_roots_are_made_once(spark, monkeypatch):
    """A condition on the rotation, moved below the roots, made the plan hold a root for each of their uses: over 150 s (stopped) on 500 structures."""
    plans = []

    def noted(df, tag):
        plans.append((tag, df._jdf.queryExecution().optimizedPlan().toString()))
        return stored(df, tag)

    stored = tm_search.stored
    monkeypatch.setattr(tm_search, "stored", noted)
    atoms = points(spark, {"ref": [(i, i % 2, i % 3) for i in range(20)], "two": [(i, i % 3, i % 2) for i in range(20)]})
    assert tm_search.tm_score_searched(atoms, atoms.where("structure_id = 'ref'"), rounds=1).count() == 2
    assert max(len(plan) for _, plan in plans) < 100_000
