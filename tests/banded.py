"""The not-a-knot spline of one series, solved in one place."""

import numpy as np


def spline_values(x, y, at):
    """The not-a-knot cubic spline through (x, y), solved for the second derivatives by elimination along the bands: time and memory grow with the knots alone."""
    n = len(x)
    inside = (at >= x[0]) & (at <= x[-1])
    if n < 4:
        return np.where(inside, np.interp(at, x, y), np.nan)
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    # Rows 1 to n - 2 hold the bands below, on and above the diagonal; the ends' conditions leave m[0] and m[n - 1] out of them.
    low, mid, high, r = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), 6 * np.diff(slope)
    mid[0], high[0] = mid[0] + h[0] * (h[0] + h[1]) / h[1], h[1] - h[0] * h[0] / h[1]
    mid[-1], low[-1] = mid[-1] + h[-1] * (h[-1] + h[-2]) / h[-2], h[-2] - h[-1] * h[-1] / h[-2]
    low, mid, high, r = low.tolist(), mid.tolist(), high.tolist(), r.tolist()
    for i in range(1, n - 2):
        f = low[i] / mid[i - 1]
        mid[i] -= f * high[i - 1]
        r[i] -= f * r[i - 1]
    m = [0.0] * n
    m[n - 2] = r[n - 3] / mid[n - 3]
    for i in range(n - 4, -1, -1):
        m[i + 1] = (r[i] - high[i] * m[i + 2]) / mid[i]
    m = np.array(m)
    m[0] = ((h[0] + h[1]) * m[1] - h[0] * m[2]) / h[1]
    m[-1] = ((h[-1] + h[-2]) * m[-2] - h[-1] * m[-3]) / h[-2]
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    t, u = at - x[k], x[k + 1] - at
    got = (m[k] * u**3 + m[k + 1] * t**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * u + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * t
    return np.where(inside, got, np.nan)
