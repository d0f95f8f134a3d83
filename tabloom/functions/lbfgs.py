"""Limited-memory quasi-Newton minimisation of a smooth function."""

from __future__ import annotations

import numpy as np


def minimise(of, start: np.ndarray, max_iter: int, tol: float, memory: int = 10) -> np.ndarray:
    """L-BFGS with backtracking; ``of`` gives value and gradient."""
    x, (value, slope), past = start, of(start), []
    for _ in range(max_iter):
        step, kept = -slope, []
        for s, y in reversed(past):
            a = (s @ step) / (s @ y)
            kept.append(a)
            step = step - a * y
        if past:
            s, y = past[-1]
            step = step * ((s @ y) / (y @ y))
        for (s, y), a in zip(past, reversed(kept)):
            step = step + s * (a - (y @ step) / (s @ y))
        rate, down = 1.0 if past else min(1.0, 1.0 / max(np.abs(slope).sum(), 1e-30)), slope @ step
        for _ in range(30):
            new_value, new_slope = of(x + rate * step)
            if new_value <= value + 1e-4 * rate * down:
                break
            rate /= 2
        else:
            return x
        s, y = rate * step, new_slope - slope
        if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
            past = [*past[1 - memory:], (s, y)]
        gain, x, value, slope = value - new_value, x + s, new_value, new_slope
        if gain <= tol * max(abs(value), 1e-12):
            break
    return x
