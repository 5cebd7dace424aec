"""Comparison of a query with its SQL twin."""

import math
from collections import Counter

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if type(v).__name__ == "Decimal":
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else int(v) if v.is_integer() else repr(v)
    return v if isinstance(v, (int, str)) else str(v)


def bag(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)
