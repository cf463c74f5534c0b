"""Shared helpers of the tests: columns in order, and made-up bars for literal checks."""

import datetime as dt


def column(df, name, order=("sym", "d")):
    return [r[name] for r in df.orderBy(*order).collect()]


def random_bars(spark, syms=2, rows=300, seed=0, skip=()):
    """Random-walk bars with distinct prices."""
    import numpy as np

    out = []
    start = dt.date(2019, 1, 1)
    for s in range(syms):
        rng = np.random.default_rng(seed + s)
        close = 20.0 * np.exp(np.cumsum(rng.normal(0, 0.02, rows)))
        open_ = close * (1 + rng.normal(0, 0.005, rows))
        high = np.maximum(open_, close) * (1 + rng.uniform(0.0001, 0.01, rows))
        low = np.minimum(open_, close) * (1 - rng.uniform(0.0001, 0.01, rows))
        vol = rng.integers(1_000, 9_000, rows).astype(float)
        for i in range(rows):
            if (s, i) in skip:
                continue
            out.append((f"S{s}", start + dt.timedelta(days=i), open_[i], high[i], low[i], close[i], vol[i], vol[i] * close[i], 1))
    return spark.createDataFrame(
        [tuple(float(v) if isinstance(v, float) or hasattr(v, "dtype") else v for v in r) for r in out],
        "sym string, d date, open double, high double, low double, close double, vol double, amount double, n long",
    )
