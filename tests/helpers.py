"""Small frames and row comparison."""

import datetime as dt


def d(text):
    return dt.date.fromisoformat(text) if text else None


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def table(df, key, *columns):
    """{key: (columns...)}; key may be a name or a list of names."""
    names = [key] if isinstance(key, str) else key
    out = {}
    for r in df.collect():
        k = tuple(r[n] for n in names)
        out[k[0] if len(k) == 1 else k] = tuple(r[c] for c in columns) if len(columns) != 1 else r[columns[0]]
    return out
