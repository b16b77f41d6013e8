"""Least-squares superposition from sums alone (Theobald 2005; Liu, Agrafiotis and Theobald 2010).

The largest root of the characteristic polynomial of a symmetric 4 x 4 matrix of cross sums gives the
least RMSD; the matching eigenvector, a column of the adjugate, is the rotation as a quaternion.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
NEWTON_STEPS = 50


def cross_sums(target: str, ref: str, where: Column | None = None, prefix: str = "") -> list[Column]:
    """Aggregates of paired coordinates (columns target + axis and ref + axis): n, means, centred cross sums and e0.

    where: only of the rows that meet it, of which there may be none; prefix: of the names.
    """
    at = {f"{p}{a}": F.col(f"{p}{a}") if where is None else F.when(where, F.col(f"{p}{a}")) for p in (target, ref) for a in AXES}
    n = (F.count("*") if where is None else F.nullif(F.count_if(where), F.lit(0))).cast("double")
    out = [n.alias(f"{prefix}n_pairs")]
    out += [F.avg(c).alias(f"{prefix}m_{name}") for name, c in at.items()]
    out += [(F.sum(at[target + a] * at[ref + b]) - F.sum(at[target + a]) * F.sum(at[ref + b]) / n).alias(f"{prefix}s_{a}{b}") for a, b in product(AXES, AXES)]
    spread = sum((F.sum(c * c) - F.sum(c) * F.sum(c) / n for c in at.values()), F.lit(0.0))
    return [*out, (spread / 2).alias(f"{prefix}e0")]


def matrix() -> list[list[Column]]:
    s = {f"{a}{b}": F.col(f"s_{a}{b}") for a, b in product(AXES, AXES)}
    k00 = s["xx"] + s["yy"] + s["zz"]
    k01, k02, k03 = s["yz"] - s["zy"], s["zx"] - s["xz"], s["xy"] - s["yx"]
    k11, k22, k33 = s["xx"] - s["yy"] - s["zz"], s["yy"] - s["xx"] - s["zz"], s["zz"] - s["xx"] - s["yy"]
    k12, k13, k23 = s["xy"] + s["yx"], s["zx"] + s["xz"], s["yz"] + s["zy"]
    return [[k00, k01, k02, k03], [k01, k11, k12, k13], [k02, k12, k22, k23], [k03, k13, k23, k33]]


def _det3(m: list[list[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def _minor(m: list[list[Column]], row: int, col: int) -> list[list[Column]]:
    return [[m[r][c] for c in range(4) if c != col] for r in range(4) if r != row]


def _det4(m: list[list[Column]]) -> Column:
    return m[0][0] * _det3(_minor(m, 0, 0)) - m[0][1] * _det3(_minor(m, 0, 1)) + m[0][2] * _det3(_minor(m, 0, 2)) - m[0][3] * _det3(_minor(m, 0, 3))


def polynomial() -> dict[str, Column]:
    """c2, c1, c0 of the characteristic polynomial."""
    s = [[F.col(f"s_{a}{b}") for b in AXES] for a in AXES]
    square = sum((x * x for row in s for x in row), F.lit(0.0))
    return {"c2": -2.0 * square, "c1": -8.0 * _det3(s), "c0": _det4(matrix())}


def largest_root() -> Column:
    """Newton steps from e0 on columns c2, c1, c0."""
    c2, c1, c0 = F.col("c2"), F.col("c1"), F.col("c0")

    def step(x: Column, _: Column) -> Column:
        value = ((x * x + c2) * x + c1) * x + c0
        slope = (4.0 * x * x + 2.0 * c2) * x + c1
        return x - F.coalesce(F.try_divide(value, slope), F.lit(0.0))

    return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.col("e0"), step)


def least_rmsd() -> Column:
    """RMSD of the superposed points themselves, from e0, root and n_pairs."""
    return F.sqrt(F.greatest(F.lit(0.0), 2.0 * (F.col("e0") - F.col("root")) / F.col("n_pairs")))


def quaternion() -> Column:
    """Array (w, x, y, z), from the column of the adjugate of K - root * I with the largest norm; null if all vanish."""
    k = matrix()
    root = F.col("root")
    m = [[k[r][c] - root if r == c else k[r][c] for c in range(4)] for r in range(4)]
    columns = [F.array(*[(_det3(_minor(m, c, r)) if (r + c) % 2 == 0 else -_det3(_minor(m, c, r))) for r in range(4)]) for c in range(4)]
    size = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    best = F.array_max(F.transform(F.array(*columns), lambda v: F.struct(size(v).alias("size"), v.alias("v"))))
    scale = F.greatest(F.abs(F.col("e0")), F.lit(1e-12))
    # the adjugate is of the third power of the sums; a vanishing one leaves the rotation open
    return F.when(F.sqrt(best["size"]) > 1e-10 * scale * scale * scale, F.transform(best["v"], lambda x: x / F.sqrt(best["size"])))


def rotation(q: str = "q") -> dict[str, tuple[Column, Column, Column]]:
    """Rows of the rotation of a quaternion."""
    w, x, y, z = (F.element_at(q, i) for i in range(1, 5))
    return {
        "x": (w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y)),
        "y": (2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x)),
        "z": (2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z),
    }


def rotated(target: str, ref: str, q: str = "q") -> dict[str, Column]:
    """Coordinates of a target atom after the superposition on the reference."""
    centred = [F.col(f"{target}{a}") - F.col(f"m_{target}{a}") for a in AXES]
    return {a: sum((r * c for r, c in zip(row, centred, strict=True)), F.col(f"m_{ref}{a}")) for a, row in rotation(q).items()}


def moved_rmsd(target: str, ref: str, prefix: str, q: str = "q") -> Column:
    """RMSD of the rows of the sums of prefix, moved by the pose of the other ones, from sums alone.

    A moved point is off by the rotated distance from its set's mean less its partner's, plus what the pose
    leaves between the two means.
    """
    rows = rotation(q)
    turned = sum((rows[b][i] * F.col(f"{prefix}s_{a}{b}") for i, a in enumerate(AXES) for b in AXES), F.lit(0.0))
    off = [F.col(f"{prefix}m_{target}{a}") - F.col(f"m_{target}{a}") for a in AXES]
    left = {b: sum((r * o for r, o in zip(row, off, strict=True)), F.col(f"m_{ref}{b}") - F.col(f"{prefix}m_{ref}{b}")) for b, row in rows.items()}
    square = 2.0 * (F.col(f"{prefix}e0") - turned) / F.col(f"{prefix}n_pairs") + sum((x * x for x in left.values()), F.lit(0.0))
    return F.when(square.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), square)))
