"""Shared by all tests."""

import numpy as np

DATA = "/root/testdata/sf0.001"


def tidy(df):
    """Rows in a comparable form."""
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: repr(list(v)) if isinstance(v, (list, np.ndarray)) else None if v is None or v != v else str(v))
        elif df[c].dtype.kind == "f":
            df[c] = df[c].round(6) + 0.0
    return sorted(map(tuple, df.astype(object).where(df.notna(), None).values.tolist()), key=repr)
