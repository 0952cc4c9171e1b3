"""A generative model of overlapping voters, fitted by expectation-maximisation to how often each pattern of votes occurs."""

from __future__ import annotations

import numpy as np


def likelihood(votes: np.ndarray, counts: np.ndarray, share: float, table: np.ndarray) -> float:
    """Log likelihood of the patterns under ``share`` and ``table`` (class, vote + 1, voter), voters independent within a class."""
    at = np.arange(votes.shape[1])
    both = [np.log(s) + np.log(table[y, votes + 1, at]).sum(1) for y, s in ((0, 1 - share), (1, share))]
    return float(counts @ np.logaddexp(*both))


def fit(votes: np.ndarray, counts: np.ndarray | None = None, rounds: int = 40, prior: float = 0.2, clamp: float = 0.02) -> dict:
    """``votes``: patterns of -1, 0 (abstains), 1; ``counts``: how many rows cast each (one, if None). Estimates the share of class 1, how
    often each voter casts each vote in each class (its accuracy), and correlations of voters within classes; a voter counts the
    less the more others repeat it. Returns posterior (of class 1 per pattern), accuracy, correlation, weight, share, and the log
    likelihoods of the rounds before correlations are weighed."""
    n, j = votes.shape
    if not n or not j:
        return {"posterior": np.zeros(n), "accuracy": np.zeros(j), "correlation": np.eye(j), "weight": np.ones(j), "share": prior, "likelihood": []}
    counts = np.ones(n) if counts is None else np.asarray(counts, float)
    one = [(votes == v).astype(float) for v in (-1, 0, 1)]
    lead = votes.sum(1)
    p = np.where(lead > 0, 0.9, np.where(lead < 0, 0.1, prior))
    weight, correlation, known = np.ones(j), np.eye(j), []
    for step in range(rounds):
        of = [(1 - p) * counts, p * counts]
        share = float(np.clip(of[1].sum() / counts.sum(), 1e-4, 1 - 1e-4))
        table = np.array([[(q @ one[v] + clamp) / (q.sum() + 3 * clamp) for v in range(3)] for q in of])
        if step >= rounds // 2:
            total = np.zeros((j, j))
            for y, q in enumerate(of):
                if q.sum() < 2:
                    continue
                r = votes - q @ votes / q.sum()
                c = (r * q[:, None]).T @ r / q.sum()
                d = np.sqrt(np.clip(np.diag(c), 1e-9, None))
                total += (share if y else 1 - share) * c / np.outer(d, d)
            correlation = np.clip(total, -1, 1)
            repeated = np.clip(correlation - 0.1, 0, None)
            np.fill_diagonal(repeated, 0)
            weight = 1 / (1 + repeated.sum(1))
        else:
            known.append(likelihood(votes, counts, share, table))
        gain = np.log(table[1]) - np.log(table[0])
        z = np.log(share / (1 - share)) + sum(one[v] @ (gain[v] * weight) for v in range(3))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    cast = np.maximum(1e-9, counts @ np.abs(votes))
    right = ((p * counts) @ one[2] + ((1 - p) * counts) @ one[0]) / cast
    return {"posterior": p, "accuracy": right, "correlation": correlation, "weight": weight, "share": share, "likelihood": known}


def of_patterns(votes: list[list[int]], counts: list[int], prior: float) -> tuple[dict[tuple[int, ...], float], dict]:
    """The posterior of each pattern, and the model."""
    made = fit(np.array(votes, int).reshape(len(votes), -1), np.array(counts, float), prior=prior)
    return {tuple(v): float(p) for v, p in zip(votes, made["posterior"], strict=True)}, made
