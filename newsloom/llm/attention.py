"""A small causal self-attention model over token classes, in numpy.

Each of the most frequent subword ids is a class of its own, the others share classes
by frequency, where an id has its share of the class's training count. Classes stand in
groups of SIZE, and the model predicts an id as group, class within the group, id within
the class, so the whole vocabulary has a probability at the cost of two short softmaxes.
Ids that begin a word (or end a text) and ids that go on in one never share a group; the
former come first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WINDOW, STRIDE, DIM, HIDDEN = 32, 24, 16, 32
SIZE, GROUPS = 32, 32  # classes in a group, and groups; half of them for each kind


@dataclass
class Classes:
    """of[id] is an id's class; within[id] the log probability of the id in its class; classes under ``begin`` begin words."""

    of: np.ndarray
    within: np.ndarray
    n: int
    begin: int
    end: int

    @classmethod
    def by_counts(cls, counts: np.ndarray, begins: np.ndarray, end: int, shared: int = 32) -> Classes:
        own_counts = counts.astype(np.float64) + 0.5
        rank = counts.copy()
        rank[end] = counts.sum() + 1  # always alone
        of, half = np.empty(len(counts), np.int64), SIZE * GROUPS // 2
        for base, kind in ((0, True), (half, False)):
            own = np.flatnonzero(begins == kind)
            own = own[np.argsort(-rank[own], kind="stable")]
            head, rest = own[: half - shared], own[half - shared :]
            of[head] = base + np.arange(len(head))
            edges = np.geomspace(1, len(rest), shared + 1).astype(int)[1:] if len(rest) else []
            of[rest] = base + half - shared + np.searchsorted(edges, np.arange(len(rest)), side="right").clip(max=shared - 1)
        return cls(of, np.log(own_counts / np.bincount(of, own_counts)[of]), 2 * half, half, int(of[end]))


SHAPES = {"emb": (SIZE * GROUPS, DIM), "pos": (WINDOW, DIM), "qkv": (DIM, 3 * DIM), "o": (DIM, DIM), "w1": (DIM, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, DIM), "gw": (DIM, GROUPS), "gb": (GROUPS,), "cw": (GROUPS, DIM, SIZE), "cb": (GROUPS, SIZE)}
WEIGHTS = sum(int(np.prod(s)) for s in SHAPES.values())


def views(x: np.ndarray) -> dict[str, np.ndarray]:
    """The weights as views of one array."""
    out, at = {}, 0
    for k, s in SHAPES.items():
        size = int(np.prod(s))
        out[k] = x[at : at + size].reshape(s)
        at += size
    return out


def start(counts: np.ndarray, seed: int = 5) -> np.ndarray:
    """First weights: small and random, with the log frequencies of groups and classes as biases."""
    rng, flat = np.random.default_rng(seed), np.zeros(WEIGHTS, np.float32)
    p = views(flat)
    for k, s in SHAPES.items():
        if k not in ("b1", "gb", "cb"):
            scale = 0.5 if k == "emb" else 0.1 if k == "pos" else 0.02 if k in ("gw", "cw") else s[0] ** -0.5
            p[k][:] = rng.standard_normal(s) * scale
    c = counts.reshape(GROUPS, SIZE) + 0.5
    p["gb"][:], p["cb"][:] = np.log(c.sum(1) / c.sum()), np.log(c / c.sum(1, keepdims=True))
    return flat


_mask = np.tril(np.ones((WINDOW, WINDOW), np.float32))
_SCALE = DIM**-0.5


def _scaled(qkv: np.ndarray) -> np.ndarray:
    """The weights of queries, keys and values, those of queries scaled, so that their products need not be."""
    out = qkv.copy()
    out[:, :DIM] *= _SCALE
    return out


def _attend(p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, ...]:
    """What each place of inputs (batch, WINDOW) reads: embeddings, scaled queries, keys, values, weights, context."""
    b = len(x)
    e = p["emb"][x]
    e += p["pos"]
    e = e.reshape(-1, DIM)
    qkv = (e @ _scaled(p["qkv"])).reshape(b, WINDOW, 3 * DIM)
    q, k, v = qkv[:, :, :DIM], qkv[:, :, DIM : 2 * DIM], qkv[:, :, 2 * DIM :]
    a = np.matmul(q, k.transpose(0, 2, 1))
    np.minimum(a, 30, out=a)
    np.exp(a, out=a)
    a *= _mask
    a *= 1 / (a.reshape(-1, WINDOW) @ np.ones(WINDOW, a.dtype)).reshape(b, WINDOW, 1)
    return e, q, k, v, a, np.matmul(a, v).reshape(-1, DIM)


def _and_one(m: np.ndarray) -> np.ndarray:
    """m with a column of ones, the input of a bias."""
    out = np.ones((len(m), m.shape[1] + 1), m.dtype)
    out[:, :-1] = m
    return out


def _biased(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weights with their biases as a last row."""
    return np.concatenate([w, b[..., None, :]], axis=-2)


def _mixed(p: dict[str, np.ndarray], e: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The states after attention, the first layer after it and the last states, of places with embeddings e and context c."""
    h = c @ p["o"]
    h += e
    u = h @ p["w1"]
    u += p["b1"]
    np.maximum(u, 0, out=u)
    m = u @ p["w2"]
    m += h
    return h, u, m


def forward(p: dict[str, np.ndarray], x: np.ndarray, places: np.ndarray | slice = np.s_[:]) -> np.ndarray:
    """The last hidden state of places of inputs (batch, WINDOW), of all of them if none are given."""
    e, *_, c = _attend(p, x)
    return _mixed(p, e[places], c[places])[2]


def _exp(z: np.ndarray) -> np.ndarray:
    np.minimum(z, 60, out=z)
    return np.exp(z, out=z)


def _by_group(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Places in the order of the groups of y, their groups, and (group, from, to) in them."""
    g = (y // SIZE).astype(np.uint8)
    order = np.argsort(g, kind="stable")  # of bytes: a radix sort
    g = g[order]
    edge = np.searchsorted(g, np.arange(GROUPS + 1)).tolist()
    return order, g.astype(np.int64), [(k, a, z) for k, (a, z) in enumerate(zip(edge, edge[1:], strict=False)) if z > a]


def _class_exp(p: dict[str, np.ndarray], m: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """P(class | group) up to a factor of each place, for states with a column of ones in the order of groups."""
    c, w = np.empty((len(m), SIZE), m.dtype), _biased(p["cw"], p["cb"])
    for k, a, z in runs:
        np.matmul(m[a:z], w[k], out=c[a:z])
    return _exp(c)


def log_probabilities(p: dict[str, np.ndarray], m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln P(class y) for hidden states m, and ln P(a class that begins a word)."""
    order, g, runs = _by_group(y)
    m, row = _and_one(m[order]), np.arange(len(m)) * SIZE
    z = _exp(m @ _biased(p["gw"], p["gb"]))
    both = z @ np.stack([np.ones(GROUPS, z.dtype), (np.arange(GROUPS) < GROUPS // 2).astype(z.dtype)], axis=1)
    total = both[:, 0] + 1e-30
    c = _class_exp(p, m, runs)
    inside = c.reshape(-1)[row + y[order] % SIZE] / (c @ np.ones(SIZE, c.dtype) + 1e-30)
    hit, begins = np.empty(len(m)), np.empty(len(m))
    hit[order] = (z.reshape(-1)[row + g] / total).astype(np.float64) * inside
    begins[order] = both[:, 1] / total
    return np.log(np.maximum(hit, 1e-30)), np.log(np.maximum(begins, 1e-30))


def gradient(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, w: np.ndarray, g: dict[str, np.ndarray]) -> float:
    """Mean loss over places with weight w; its gradient is written into g.

    Places without weight are read as context; what follows attention is not taken for them.
    """
    b = len(x)
    e, q, k, v, a, c = _attend(p, x)
    y, w = y.ravel(), w.ravel()
    need = np.flatnonzero(w)
    order, group, runs = _by_group(y[need])
    need = need[order]
    w, row, inside = (w[need] / max(w.sum(), 1)).astype(e.dtype), np.arange(len(need)) * SIZE, y[need] % SIZE
    cn = c[need]
    h, u, m = _mixed(p, e[need], cn)
    m = _and_one(m)

    def against(z: np.ndarray, at: np.ndarray) -> np.ndarray:
        """P(at) of each place; z, up to a factor a distribution, becomes the gradient of its inputs."""
        flat, total = z.reshape(-1), z @ np.ones(z.shape[1], z.dtype) + z.dtype.type(1e-30)
        hit = flat[at] / total
        z *= (w / total)[:, None]
        flat[at] -= w
        return hit

    z = _exp(m @ _biased(p["gw"], p["gb"]))
    hit = against(z, row + group)
    gm = m.T @ z
    g["gw"][:], g["gb"][:] = gm[:-1], gm[-1]
    dm = z @ p["gw"].T
    z = _class_exp(p, m, runs)
    hit *= against(z, row + inside)
    gm, back = np.zeros((GROUPS, DIM + 1, SIZE), m.dtype), np.empty_like(dm)
    for i, s, t in runs:
        np.matmul(m[s:t].T, z[s:t], out=gm[i])
        np.matmul(z[s:t], p["cw"][i].T, out=back[s:t])
    g["cw"][:], g["cb"][:] = gm[:, :-1], gm[:, -1]
    dm += back
    g["w2"][:] = u.T @ dm
    du = dm @ p["w2"].T
    du *= u > 0
    g["w1"][:] = h.T @ du
    g["b1"][:] = np.ones(len(du), du.dtype) @ du
    dm += du @ p["w1"].T
    g["o"][:] = cn.T @ dm
    dh, dc = np.zeros_like(e), np.zeros_like(c)
    dh[need] = dm
    dc[need] = dm @ p["o"].T
    along = ((dc * c) @ np.ones(DIM, c.dtype)).reshape(b, WINDOW, 1)  # of each place, the sum of its weights' gradients
    dc = dc.reshape(b, WINDOW, DIM)
    ds = np.matmul(dc, v.transpose(0, 2, 1))
    ds -= along
    ds *= a
    dqkv = np.empty((b, WINDOW, 3 * DIM), e.dtype)
    np.matmul(ds, k, out=dqkv[:, :, :DIM])
    np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[:, :, DIM : 2 * DIM])
    np.matmul(a.transpose(0, 2, 1), dc, out=dqkv[:, :, 2 * DIM :])
    dqkv = dqkv.reshape(-1, 3 * DIM)
    g["qkv"][:] = _scaled(e.T @ dqkv)
    dh += dqkv @ _scaled(p["qkv"]).T
    g["pos"][:] = dh.reshape(b, WINDOW, DIM).sum(0)
    ids = x.ravel().astype(np.uint16)
    order = np.argsort(ids, kind="stable")  # of two bytes: a radix sort
    ids = ids[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    g["emb"][:] = 0
    g["emb"][ids[first]] = np.add.reduceat(dh[order], first, axis=0)
    return float(-(np.log(hit + 1e-30) * w).sum())


def train(flat: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, rate: float, seed: int = 0) -> np.ndarray:
    """One pass of Adam over windows in a seeded order; the batches of few windows are smaller."""
    flat, d = flat.astype(np.float32), np.empty(WEIGHTS, np.float32)
    p, g = views(flat), views(d)
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    order = np.random.default_rng(seed).permutation(len(x))
    batch = int(np.clip(len(x) // 64, 16, 64))
    for t, at in enumerate(range(0, len(x), batch), 1):
        i = order[at : at + batch]
        gradient(p, x[i], y[i], w[i], g)
        first += 0.1 * (d - first)
        d *= d
        d -= second
        d *= 0.01
        second += d
        flat -= (rate / (1 - 0.9**t)) * first / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return flat


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first place, places not to score) of overlapping windows over documents of these lengths.

    Windows start STRIDE apart; each scores the places that the one before did not reach,
    and reads the WINDOW - STRIDE places before them as context.
    """
    n = np.where(lengths <= WINDOW, (lengths > 0).astype(np.int64), 1 + -(-(lengths - WINDOW) // STRIDE))
    doc = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return doc, k * STRIDE, np.where(k > 0, WINDOW - STRIDE, 0)


def inputs(y: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """What stands before each place of documents of these lengths (the end, before the first), and where each document starts."""
    starts = np.cumsum(lengths) - lengths
    x = np.concatenate([[end], y[:-1]])
    x[starts] = end
    return x, starts


def score(flat: np.ndarray, classes: Classes, y: np.ndarray, lengths: np.ndarray, batch: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """ln P(class) of each of y, and ln P(a class that begins a word) there.

    y holds the classes of documents of these lengths one after the other; each place is
    scored once, from the window that gives it the most context.
    """
    p = views(flat.astype(np.float32))
    x, starts = inputs(y, lengths, classes.end)
    doc, first, skip = windows(lengths)
    out, begins = np.zeros(len(y)), np.zeros(len(y))
    place = np.arange(WINDOW)
    for a in range(0, len(doc), batch):
        d, f, s = doc[a : a + batch], first[a : a + batch], skip[a : a + batch]
        at = f[:, None] + place
        real = at < lengths[d][:, None]
        at = (starts[d][:, None] + np.where(real, at, 0)).ravel()
        need = np.flatnonzero((real & (place >= s[:, None])).ravel())
        m = forward(p, x[at].reshape(-1, WINDOW), need)
        out[at[need]], begins[at[need]] = log_probabilities(p, m, y[at[need]])
    return out, begins
