import numpy as np


def vector(df, column=None, size=None):
    rows = sorted(df.collect(), key=lambda r: r["vid"])
    column = column or next(c for c in df.columns if c != "vid")
    out = np.zeros(size or len(rows))
    for r in rows:
        out[r["vid"]] = r[column]
    return out


def table(df, column, shape, row="vid", col="label_id"):
    out = np.zeros(shape)
    for r in df.collect():
        out[r[row], r[col]] = r[column]
    return out


def chances(kind, z, x, y, selfloops=False):
    t = z * np.outer(x, y)
    p = t / (1 + t) if kind == "fitness" else -np.expm1(-t)
    if not selfloops:
        np.fill_diagonal(p, 0)
    return p


def layers(kind, z, x, y, selfloops=False):
    z = np.broadcast_to(z, x.shape[1])
    return np.array([chances(kind, z[k], x[:, k], y[:, k], selfloops) for k in range(x.shape[1])])


def either(p):
    """Chance of a link in either direction; the diagonal counts once."""
    u = p + p.T - p * p.T
    np.fill_diagonal(u, np.diag(p))
    return u


def log_likelihood(p, adj, selfloops=False):
    keep = np.ones_like(p, bool) if selfloops else ~np.eye(len(p), dtype=bool)
    with np.errstate(divide="ignore"):
        return np.where(adj > 0, np.log(p), np.log1p(-p))[keep].sum()
