"""Settings with the values that take effect."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Blocking caps (targets per key), weights of key kinds, candidates per entity, pair sampling, split, threshold grid."""

    cap: int = 300
    cap_number: int = 200
    top: int = 15
    weights: tuple[tuple[str, int], ...] = (("exact", 12), ("bigram", 6), ("first", 4), ("salient", 3), ("number", 2))
    negatives_train: int = 10
    negatives_valid: int = 15
    sample: int = 40_000
    valid_tenths: int = 2
    beta: float = 0.5
    grid: tuple[int, int, int] = (10, 94, 2)
    default_threshold: float = 0.65
    seed: int = 42
    trees: int = 300
    rate: float = 0.05
    depth: int = 7
    least_in_node: int = 20
    subsample: float = 0.8
    embedding: int = 256


DEFAULT = Settings()
