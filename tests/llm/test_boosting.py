import numpy as np
import pytest

from spendscope.llm import boosting as b


def by_hand(x, y, trees, depth, rate, ridge, weight):
    """The same trees by trying every cut of every feature at every node."""
    share = (y * weight).sum() / weight.sum()
    logit = np.full(len(y), np.log(share / (1 - share)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)

        def grow(rows, level):
            if level == depth:
                logit[rows] += rate * g[rows].sum() / (h[rows].sum() + ridge)
                return
            best, cut = 1e-9, None
            score = lambda r: g[r].sum() ** 2 / (h[r].sum() + ridge)
            for j in range(x.shape[1]):
                for value in np.unique(x[:, j])[:-1]:
                    left, right = rows[x[rows, j] <= value], rows[x[rows, j] > value]
                    gain = score(left) + score(right) - score(rows)
                    if gain > best + 1e-12:
                        best, cut = gain, (j, value)
            left = rows if cut is None else rows[x[rows, cut[0]] <= cut[1]]
            grow(left, level + 1)
            grow(np.setdiff1d(rows, left), level + 1)

        grow(np.arange(len(y)), 0)
    return logit


@pytest.mark.parametrize("seed", range(5))
def test_trees_equal_those_by_hand(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, (80, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 3) ^ (rng.random(80) < 0.1)).astype(int)
    weight = rng.integers(1, 4, 80).astype(float)
    got = b.fit(x, y, trees=6, depth=2, rate=0.3, bins=64, ridge=1.0, weight=weight).logits(x)
    assert got == pytest.approx(by_hand(x, y, 6, 2, 0.3, 1.0, weight), abs=1e-9)


@pytest.mark.parametrize("labels, sign", [([0, 0], -1), ([1, 1], 1), ([], 0)])
def test_one_label_or_none_is_a_constant(labels, sign):
    trees = b.fit(np.zeros((len(labels), 2)), np.array(labels, int))
    assert (np.sign(trees.logits(np.zeros((3, 2)))) == sign).all()
