"""Order-free comparison of a Spark result with a DuckDB statement over the same tables."""

import numpy as np

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, bool | np.bool_):
        return str(bool(value))
    return float(value) if isinstance(value, int | float | np.number) else str(value)


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(str([plain(x) for x in r]) for r in frame[cols].astype(object).where(frame[cols].notna(), None).values.tolist())


def duck(data=DATA):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def mcl(edges, inflation=2.0, rounds=100):
    """Markov clusters of one component by dense matrices; of values equal but for rounding the least row owns a column."""
    names = sorted(set(edges["a"]) | set(edges["b"]))
    at = {x: i for i, x in enumerate(names)}
    m = np.eye(len(names))
    for a, b in zip(edges["a"], edges["b"], strict=True):
        m[at[a], at[b]] = m[at[b], at[a]] = 1.0
    m /= m.sum(0)
    for _ in range(rounds):
        new = (m @ m) ** inflation
        new[new < 1e-8] = 0
        new /= new.sum(0)
        if np.abs(new - m).max() < 1e-9:
            break
        m = new
    owner = (m >= m.max(0) * (1 - 1e-6)).argmax(0)
    return [[names[i] for i in np.flatnonzero(owner == o)] for o in sorted(set(owner))]
