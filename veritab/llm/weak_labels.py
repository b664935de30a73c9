"""Expectation-maximisation over votes of overlapping labellers that may abstain.

Only how often each pattern of votes occurs matters, and there are at most 3 ** labellers
patterns, so the counts over all rows come to the driver whatever the input's size.
"""

from __future__ import annotations

import numpy as np

ABSTAIN = -1


class LabelModel:
    """Two classes; labellers vote 0 or 1 independently of each other given the class; abstaining says nothing."""

    def fit(self, patterns: np.ndarray, counts: np.ndarray, prior: float = 0.5, start: tuple[float, float] = (0.2, 0.8), rounds: int = 200, tolerance: float = 1e-8) -> LabelModel:
        """patterns: rows of votes; counts: how often each occurs.

        start holds every labeller's chance of voting 1 for class 0 and class 1 at first; that says which
        class is which. A labeller's chance for class 0 never rises above that for class 1, so the classes
        can't swap.
        """
        votes = np.asarray(patterns)
        counts = np.asarray(counts, np.float64)
        spoken, ones = votes >= 0, votes == 1
        self.prior = prior
        self.ones = np.repeat(np.array([[start[0]], [start[1]]]), votes.shape[1], axis=1)  # by class and labeller
        last = None
        for self.rounds in range(1, rounds + 1):
            p = self.posterior(votes)
            total = float((counts * self._log_total).sum())
            w = np.stack([counts * (1 - p), counts * p])
            self.prior = float(np.clip(w[1].sum() / max(1e-9, counts.sum()), 0.01, 0.99)) if counts.sum() else prior
            # a vote of each kind is added where the labeller starts, so that rates stay off 0 and 1
            self.ones = (w @ ones + 2 * np.array([[start[0]], [start[1]]])) / (w @ spoken + 2)
            swapped = self.ones[0] > self.ones[1]
            mean = self.ones.mean(axis=0)
            self.ones[:, swapped] = mean[swapped]
            if last is not None and abs(total - last) <= tolerance * max(1.0, abs(last)):
                break
            last = total
        return self

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row of votes; the prior where all abstain."""
        votes = np.asarray(votes).reshape(-1, self.ones.shape[1])
        yes, no = (votes == 1).astype(float), (votes == 0).astype(float)
        ones = np.clip(self.ones, 1e-6, 1 - 1e-6)
        log = np.log(ones) @ yes.T + np.log(1 - ones) @ no.T + np.log([[1 - self.prior], [self.prior]])
        top = log.max(axis=0, initial=-np.inf)
        self._log_total = top + np.log(np.exp(log - top).sum(axis=0))
        return np.exp(log[1] - self._log_total)

    def accuracies(self, votes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each labeller, when it votes, agrees with the posterior."""
        p, votes = self.posterior(votes), np.asarray(votes)
        right = np.where(votes == 1, p[:, None], 1 - p[:, None])
        w = np.asarray(counts, np.float64)[:, None] * (votes >= 0)
        return (right * w).sum(axis=0) / np.maximum(1e-9, w.sum(axis=0))
