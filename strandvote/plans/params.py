"""Parameters of the stages (T12). Values are the published defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Enrichment:
    iterations: int = 8
    shuffles: int = 10
    group_size: int = 16
    plddt: float = 75.0
    quantile: float = 0.2
    combine_threshold: float = 0.5
    coverage: float = 0.8
    select: int | None = None
    criteria: tuple[str, ...] = ()
    seed: int = 42


@dataclass(frozen=True)
class Splits:
    group_size: int = 10
    rounds: int = 1
    coverage: float = 0.8
    select: int | None = None
    plddt: float = 75.0
    seed: int = 42


@dataclass(frozen=True)
class Voting:
    bins: int = 30
    lo: float | None = None
    hi: float | None = None
    focused: bool = False
    threshold: float = 0.0
    plddt: float = 0.0


@dataclass(frozen=True)
class Recompile:
    bins: tuple[int, ...] = ()
    combine: bool = False
    models: int = 5
    seeds: int = 8
    seed: int = 42


@dataclass(frozen=True)
class Comparison:
    plddt: float = 70.0


@dataclass(frozen=True)
class Pipeline:
    enrichment: Enrichment = field(default_factory=Enrichment)
    splits: Splits = field(default_factory=Splits)
    voting: Voting = field(default_factory=Voting)
    recompile: Recompile = field(default_factory=Recompile)
    comparison: Comparison = field(default_factory=Comparison)


def from_dict(settings: dict) -> Pipeline:
    """Parameters from nested settings; a name that doesn't exist is an error."""
    parts = {"enrichment": Enrichment, "splits": Splits, "voting": Voting, "recompile": Recompile, "comparison": Comparison}
    return Pipeline(**{name: parts[name](**values) for name, values in settings.items()})
