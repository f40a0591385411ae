"""Dense linear algebra on small matrices in the driver, and seeded random draws."""

from __future__ import annotations

import numpy as np


def symmetric_eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and their vectors as columns, of which the largest entry is positive."""
    values, vectors = np.linalg.eigh(np.asarray(matrix, float))
    values, vectors = values[::-1], vectors[:, ::-1]
    top = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.sign(vectors[top, np.arange(vectors.shape[1])])


def top_eigen(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = symmetric_eigen(matrix)
    return values[:k], vectors[:, :k]


def variance_ratios(values: np.ndarray) -> np.ndarray:
    kept = np.maximum(values, 0)
    return kept / kept.sum() if kept.sum() > 0 else kept


def cumulative_variance_ratio(values: np.ndarray) -> np.ndarray:
    return np.cumsum(variance_ratios(values))


def components_for_variance(values: np.ndarray, ratio: float) -> int:
    """The fewest leading components whose share of the variance reaches a ratio."""
    return int(min(len(values), np.searchsorted(cumulative_variance_ratio(values), ratio - 1e-12) + 1))


def condition_number(values: np.ndarray) -> float:
    low = np.abs(values).min()
    return float(np.abs(values).max() / low) if low > 0 else float("inf")


def reconstruct(values: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return (vectors * values) @ vectors.T


def regularize(matrix: np.ndarray, by: float = 1e-6) -> np.ndarray:
    return matrix + by * np.eye(len(matrix))


class RandomState:
    """Seeded draws; children and jumps depend on the seed alone."""

    def __init__(self, seed: int) -> None:
        self.seed, self._rng = seed, np.random.default_rng(seed)

    def next_double(self) -> float:
        return float(self._rng.random())

    next_float = next_double

    def next_int(self, bound: int) -> int:
        return int(self._rng.integers(bound))

    def next_bool(self, chance: float = 0.5) -> bool:
        return bool(self._rng.random() < chance)

    def next_gaussian(self, mean: float = 0.0, deviation: float = 1.0) -> float:
        return float(self._rng.normal(mean, deviation))

    def next_gaussian_pair(self) -> tuple[float, float]:
        a, b = self._rng.normal(size=2)
        return float(a), float(b)

    def shuffled(self, items: list) -> list:
        return [items[i] for i in self._rng.permutation(len(items))]

    def shuffle(self, items: list) -> None:
        items[:] = self.shuffled(items)

    def sample_indices(self, n: int, count: int) -> list[int]:
        return self._rng.choice(n, min(n, count), replace=False).tolist()

    def sample(self, items: list, count: int) -> list:
        return [items[i] for i in self.sample_indices(len(items), count)]

    def choice(self, items: list) -> object:
        return items[self.next_int(len(items))] if items else None

    def weighted_choice(self, weights: list[float]) -> int | None:
        total = sum(weights)
        return int(np.searchsorted(np.cumsum(weights), self._rng.random() * total, "right")) if total > 0 else None

    def random_array(self, n: int, low: float = 0.0, high: float = 1.0) -> np.ndarray:
        return self._rng.uniform(low, high, n)

    def unit_vector(self, dimension: int) -> np.ndarray:
        v = self._rng.normal(size=dimension)
        return v / np.linalg.norm(v)

    def advance(self, draws: int) -> None:
        self._rng.random(draws)

    def child(self, index: int) -> RandomState:
        return RandomState(int(np.random.SeedSequence([self.seed, index]).generate_state(1, np.uint64)[0]))
