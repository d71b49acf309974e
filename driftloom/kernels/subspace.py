"""The adaptive subspace: leverage-scored admission to a sketch, and a basis that follows it."""

from __future__ import annotations

from collections import deque
from typing import NamedTuple

import numpy as np

from ..config import StreamConfig


class Step(NamedTuple):
    """What one observation did."""

    leverage: float
    prob: float
    accepted: bool
    weight: float
    leverage_weight: float
    updated: bool
    rank_changed: bool
    rank: int
    error: float
    threshold: float
    candidate_rank: int


def projection(cfg: StreamConfig) -> np.ndarray:
    """The (width, size) matrix of a configuration, from its projection seed."""
    p = cfg.projection
    if p.kind == "identity":
        return np.eye(p.width)
    rng = np.random.default_rng(cfg.seed if p.seed is None else p.seed)
    if p.kind == "dense":
        return rng.normal(0.0, 1.0 / np.sqrt(p.size), size=(p.width, p.size))
    u, tail = rng.random((p.width, p.size)), 1.0 / (2.0 * p.sparsity)
    return np.sqrt(p.sparsity / p.size) * ((u < tail).astype(float) - (u > 1.0 - tail))


def energy_rank(spectrum: np.ndarray, share: float, least: int, most: int) -> int:
    """The smallest rank whose eigenvalues hold `share` of the first `most`, within least..most."""
    s = np.maximum(spectrum[:most], 0.0)
    if s.sum() <= 1e-15:
        return least
    return int(np.clip(np.searchsorted(np.cumsum(s) / s.sum(), share) + 1, least, most))


class Subspace:
    """Sketch window, rolling second moments, basis, spectrum and threshold of one stream."""

    def __init__(self, cfg: StreamConfig) -> None:
        k = cfg.projection.size
        self.cfg, self.rank = cfg, cfg.rank.first
        self.rng = np.random.default_rng(cfg.seed)
        self.window: deque[tuple[np.ndarray, float]] = deque()
        self.moment, self.mass = np.zeros((k, k)), 0.0
        self.basis, self.spectrum = np.eye(k)[:, : self.rank], np.ones(self.rank)
        self.scores: deque[float] = deque()
        self.score_sum = 0.0
        self.threshold: float | None = None
        self.error, self.candidate, self.calm = 0.0, cfg.rank.first, 0
        self.seen = self.accepted = self.refreshes = 0

    def _score(self, z: np.ndarray) -> tuple[float, float]:
        """Ridge leverage under the current basis, and n times its normalized probability."""
        h = self.basis.T @ z
        lev = max(float((h * h / (np.maximum(self.spectrum, 0.0) + self.cfg.admission.ridge)).sum()), 0.0)
        n, floor = len(self.scores) + 1, self.cfg.admission.floor
        total = self.score_sum + lev + floor
        q = 1.0 / n if total <= 1e-15 else min(max((lev + floor / n) / total, 0.0), 1.0)
        self.scores.append(lev)
        self.score_sum += lev
        if len(self.scores) > self.cfg.admission.window:
            self.score_sum -= self.scores.popleft()
        return lev, n * q

    def _admission(self, influence: float) -> tuple[float, bool, float, float]:
        """(probability, admitted, sketch weight, leverage weight)."""
        c = self.cfg.admission
        tilt = 1.0 if self.threshold is None else min(max(0.5 + influence / (1.0 + influence), c.lightest), c.heaviest)
        if c.mode == "weight":
            return 1.0, True, tilt, tilt
        if c.mode == "off":
            return 1.0, True, 1.0, 1.0
        rate = c.rate * (influence if c.mode == "sample" else 1.0)
        p = min(max(rate, c.least), c.most)
        ok = bool(self.rng.random() <= p)
        return p, ok, (1.0 / max(p, 1e-12) if ok else 0.0), (tilt if c.mode == "sample" else 1.0)

    def _admit(self, z: np.ndarray, w: float) -> None:
        if len(self.window) == self.cfg.admission.window:
            old, was = self.window.popleft()
            self.moment -= (was * old)[:, None] * old
            self.mass -= was
        self.window.append((z.copy(), w))
        self.moment += (w * z)[:, None] * z
        self.mass += w
        self.accepted += 1

    def _refresh(self) -> None:
        c = self.cfg.rank
        cov = self.moment / max(self.mass, 1e-12)
        values, vectors = np.linalg.eigh((cov + cov.T) / 2.0)
        values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
        self.candidate = energy_rank(values, c.energy, c.least, c.most)
        energy = max(float(np.trace(cov)), 0.0)
        kept = float(np.einsum("ij,ik,kj->", self.basis, cov, self.basis))
        self.error = 0.0 if energy <= 1e-24 else float(np.sqrt(max(energy - kept, 0.0) / energy))
        if self.threshold is None:  # the first refresh sets the threshold and keeps the rank
            self.threshold, self.calm = self.error, 0
        else:
            if self.error > self.threshold * (1.0 + c.tolerance):
                self.rank, self.calm = max(self.rank, self.candidate), 0
            else:
                self.calm += 1
                if self.calm >= c.patience:
                    self.rank, self.calm = min(self.rank, self.candidate), 0
            self.threshold = c.smoothing * self.threshold + (1.0 - c.smoothing) * self.error
        self.rank = int(np.clip(self.rank, c.least, c.most))
        self.basis, self.spectrum = vectors[:, : self.rank].copy(), values[: self.rank].copy()
        self.refreshes += 1

    def observe(self, z: np.ndarray) -> Step:
        self.seen += 1
        lev, influence = self._score(z)
        p, ok, w, tilt = self._admission(influence)
        before, due = self.rank, False
        if ok:
            self._admit(z, w)
            due = len(self.window) >= max(self.cfg.rank.most + 2, 64) and self.accepted % self.cfg.rank.interval == 0
        if due:
            self._refresh()
        return Step(lev, p, ok, w, tilt, due, self.rank != before, self.rank, self.error, self.threshold or 0.0, self.candidate)

    def adapt(self, z: np.ndarray) -> np.ndarray:
        return (z @ self.basis) @ self.basis.T

    def nbytes(self) -> int:
        rows = sum(z.nbytes + 8 for z, _ in self.window)
        return rows + 8 * len(self.scores) + self.basis.nbytes + self.spectrum.nbytes + 64
