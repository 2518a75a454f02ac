import math


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(df):
    return [tuple(norm(x) for x in r) for r in df.collect()], df.columns


def sort_key(r):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)


def same_rows(a_rows, a_cols, b_rows, b_cols):
    assert sorted(a_cols) == sorted(b_cols), (a_cols, b_cols)
    order = [b_cols.index(c) for c in a_cols]
    b_rows = [tuple(r[i] for i in order) for r in b_rows]
    return sorted(a_rows, key=sort_key) == sorted(b_rows, key=sort_key)
