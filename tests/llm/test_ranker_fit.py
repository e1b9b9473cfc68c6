"""The ranker's fit against plain gradient steps on the same pairs."""

import numpy as np

from matrixloom.llm import quality

RIDGE = 1e-2


def descent(d: np.ndarray, rounds: int = 20_000) -> np.ndarray:
    """Least mean of log(1 + exp(-w . d)) + RIDGE / 2 |w|^2, by steps that gain momentum."""
    step = 1 / (0.25 * np.linalg.norm(d, 2) ** 2 / len(d) + RIDGE)
    w = last = np.zeros(d.shape[1])
    keep = (1 - np.sqrt(step * RIDGE)) / (1 + np.sqrt(step * RIDGE))
    for _ in range(rounds):
        at = w + keep * (w - last)
        grad = RIDGE * at - (d / (1 + np.exp(d @ at))[:, None]).mean(0)
        last, w = w, at - step * grad
        if np.abs(grad).max() < 1e-12:
            break
    return w


def test_fit_is_the_least_loss():
    rng = np.random.default_rng(5)
    y = (rng.random(160) < 0.6).astype(int)
    x = rng.random((160, len(quality.FEATURES))) + 0.15 * y[:, None] * rng.random(len(quality.FEATURES))
    got = quality.fit(x, y, pairs=600, ridge=RIDGE)

    e = np.concatenate((x, np.sqrt(x)), axis=1)
    z = np.clip((e - e.mean(0)) / (e.std(0) + 1e-6), -8, 8)
    draw = np.random.default_rng(7)
    d = z[draw.choice(np.flatnonzero(y == 1), 600)] - z[draw.choice(np.flatnonzero(y == 0), 600)]
    w = descent(d)
    merit = z @ w
    cut = np.quantile(merit, (y == 0).mean())
    score = 1 / (1 + np.exp(-(merit - cut) - np.log(3 / 7)))
    assert np.abs(got.score(x) - score).max() < 1e-6
    assert abs((score >= 0.3).mean() - (y == 1).mean()) < 0.02
