"""Triangulations, arcs between nearest nodes, and values integrated from arcs to nodes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siltgrid.session import spread


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (n, 3) of distinct points by incremental insertion, along a coarse boustrophedon order.

    Points on one line have no triangles. Each insertion walks to its triangle from the last one, so time grows little
    faster than the number of points.
    """
    p = np.asarray(points, float)
    n = len(p)
    if n < 3:
        return np.empty((0, 3), int)
    lo, hi = p.min(0), p.max(0)
    size = max(float((hi - lo).max()), 1e-9)
    q = np.vstack([(p - (lo + hi) / 2) / size, [[-1e4, -1e4], [1e4, -1e4], [0, 1e4]]])
    strip = np.floor((q[:n, 1] + 0.5) * np.sqrt(n) / 2).astype(int)
    order = np.lexsort((np.where(strip % 2 == 0, q[:n, 0], -q[:n, 0]), strip))
    tri: dict[int, tuple[int, int, int]] = {0: (n, n + 1, n + 2)}
    edge: dict[tuple[int, int], int] = {(n, n + 1): 0, (n + 1, n + 2): 0, (n + 2, n): 0}
    xs, ys = q[:, 0].tolist(), q[:, 1].tolist()
    fresh, last = 1, 0

    def turn(a, b, c):
        return (xs[b] - xs[a]) * (ys[c] - ys[a]) - (ys[b] - ys[a]) * (xs[c] - xs[a])

    def in_circle(t, d):
        a, b, c = tri[t]
        ax, ay, bx, by, cx, cy = xs[a] - xs[d], ys[a] - ys[d], xs[b] - xs[d], ys[b] - ys[d], xs[c] - xs[d], ys[c] - ys[d]
        return (ax * ax + ay * ay) * (bx * cy - cx * by) - (bx * bx + by * by) * (ax * cy - cx * ay) + (cx * cx + cy * cy) * (ax * by - bx * ay) > 1e-14

    for d in order.tolist():
        t = last
        for _ in range(4 * n + 16):  # walk towards d
            a, b, c = tri[t]
            step = next(((u, v) for u, v in ((a, b), (b, c), (c, a)) if turn(u, v, d) < 0), None)
            if step is None:
                break
            t = edge.get((step[1], step[0]), t)
        bad, stack = {t}, [t]
        while stack:
            a, b, c = tri[stack.pop()]
            for u, v in ((a, b), (b, c), (c, a)):
                o = edge.get((v, u))
                if o is not None and o not in bad and in_circle(o, d):
                    bad.add(o)
                    stack.append(o)
        rim = [(u, v) for k in bad for u, v in ((tri[k][0], tri[k][1]), (tri[k][1], tri[k][2]), (tri[k][2], tri[k][0])) if edge.get((v, u)) not in bad]
        for k in bad:
            a, b, c = tri.pop(k)
            for e in ((a, b), (b, c), (c, a)):
                edge.pop(e, None)
        for u, v in rim:
            tri[fresh] = (u, v, d)
            edge[u, v] = edge[v, d] = edge[d, u] = fresh
            last = fresh
            fresh += 1
    return np.array([t for t in tri.values() if max(t) < n and abs(turn(*t)) > 1e-15], int).reshape(-1, 3)


def edges_of(triangles: np.ndarray) -> np.ndarray:
    """Distinct undirected edges of triangles."""
    if not len(triangles):
        return np.empty((0, 2), int)
    e = np.sort(np.concatenate([triangles[:, [0, 1]], triangles[:, [1, 2]], triangles[:, [2, 0]]]), axis=1)
    return np.unique(e, axis=0)


def integrate(edges: np.ndarray, difference: np.ndarray, n: int, weight: np.ndarray | None = None, rounds: int | None = None) -> np.ndarray:
    """Least-squares node values (n, k) whose differences along edges are given, by conjugate gradients.

    The least node of every component stays 0, so disconnected parts are solved side by side. Ends when the residual is 1e-10 of
    its start, and raises if that takes more than `rounds`, by default 2000 and twenty for each node.
    """
    b = difference if difference.ndim == 2 else difference[:, None]
    w = np.ones(len(edges)) if weight is None else weight
    i, j = edges[:, 0], edges[:, 1]
    root = np.arange(n)
    while True:  # least label of each component
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            break
        root = new
    free = root != np.arange(n)

    def apply(x):
        d = (x[j] - x[i]) * w[:, None]
        out = np.zeros_like(x)
        np.add.at(out, j, d)
        np.add.at(out, i, -d)
        out[~free] = 0
        return out

    rhs = np.zeros((n, b.shape[1]))
    np.add.at(rhs, j, b * w[:, None])
    np.add.at(rhs, i, -b * w[:, None])
    rhs[~free] = 0
    x, r = np.zeros_like(rhs), rhs.copy()
    p, rs = r.copy(), (r * r).sum(0)
    start = np.maximum(rs, 1e-300)
    for _ in range(2000 + 20 * n if rounds is None else rounds):
        if (rs <= 1e-20 * start).all():
            break
        ap = apply(p)
        den = (p * ap).sum(0)
        a = np.divide(rs, den, out=np.zeros_like(rs), where=den > 0)
        x += a * p
        r -= a * ap
        new = (r * r).sum(0)
        p = r + np.divide(new, rs, out=np.zeros_like(rs), where=rs > 0) * p
        rs = new
    if not (rs <= 1e-20 * start).all():
        raise ArithmeticError(f"no convergence over {n} nodes: residual {float(np.sqrt((rs / start).max())):.1e} of its start")
    return x if difference.ndim == 2 else x[:, 0]


ARC = T.StructType([T.StructField("patch", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def delaunay_arcs(points: DataFrame, patch: str, id_column: str, x: str = "x", y: str = "y", lines: bool = False) -> DataFrame:
    """(patch, a, b): edges of the triangulation of each patch; a patch is a bounded spatial partition with its halo, and
    points at one place are one node (the smallest id). lines: points without any triangle are linked in their order."""

    def one(table: pa.Table) -> pa.Table:
        f = table.to_pandas().dropna().sort_values(id_column).drop_duplicates([x, y])
        e = edges_of(delaunay(f[[x, y]].to_numpy(float)))
        if lines and not len(e):
            order = np.lexsort((f[y].to_numpy(float), f[x].to_numpy(float)))
            e = np.stack([order[:-1], order[1:]], 1)
        ids = f[id_column].to_numpy(np.int64)
        key = table.column(patch)[0].as_py()
        a, b = ids[e[:, 0]], ids[e[:, 1]]
        return pa.table({"patch": pa.array([key] * len(e), pa.int64()), "a": np.minimum(a, b), "b": np.maximum(a, b)})

    return spread(points.select(patch, id_column, x, y), patch).groupBy(patch).applyInArrow(one, ARC)


def integrate_arcs(arcs: DataFrame, patch: str, difference: str) -> DataFrame:
    """(patch, node, value array): node values whose differences along arcs are the given arrays, by least squares in each patch.

    All right-hand sides of a patch are solved together; the smallest node of each connected part is 0.
    """
    schema = T.StructType([T.StructField("patch", T.LongType()), T.StructField("node", T.LongType()), T.StructField("value", T.ArrayType(T.DoubleType()))])

    def one(table: pa.Table) -> pa.Table:
        a, b = (table.column(c).to_numpy() for c in "ab")
        d = np.stack([np.asarray(v, float) for v in table.column(difference).to_pylist()])
        nodes, at = np.unique(np.r_[a, b], return_inverse=True)
        x = integrate(np.stack([at[: len(a)], at[len(a) :]], 1), np.nan_to_num(d), len(nodes))
        key = table.column(patch)[0].as_py()
        return pa.table({"patch": pa.array([key] * len(nodes), pa.int64()), "node": nodes, "value": pa.array(x.tolist(), pa.list_(pa.float64()))})

    return spread(arcs.select(patch, "a", "b", difference), patch).groupBy(patch).applyInArrow(one, schema)


def nearest_nodes(grid_shape: tuple[int, int], nodes: np.ndarray) -> np.ndarray:
    """Number of the nearest node of each grid cell; equally near nodes give the lowest number.

    nodes: (k, 2) cells. Rings of cells grow outwards from the nodes: a distance transform row by row.
    """
    rows, cols = grid_shape
    best = np.full(grid_shape, np.inf)
    owner = np.zeros(grid_shape, int)
    by_row: dict[int, list[int]] = {}
    for k, (i, _) in enumerate(nodes):
        by_row.setdefault(int(i), []).append(k)
    jj = np.arange(cols)
    for i, ks in by_row.items():
        ks = np.array(ks)
        d = np.abs(jj[:, None] - nodes[ks, 1][None, :])
        m = d.argmin(1)
        line, who = d[jj, m].astype(float) ** 2, ks[m]
        dist = line[None, :] + (np.arange(rows)[:, None] - i) ** 2
        better = (dist < best) | (dist == best) & (who[None, :] < owner)
        best = np.where(better, dist, best)
        owner = np.where(better, np.broadcast_to(who, grid_shape), owner)
    return owner


def grid_arcs(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arcs between nodes whose cells touch: (arcs, row incidence, column incidence).

    Incidences hold the signed 1-based arc between vertically (rows - 1, cols) and horizontally (rows, cols - 1) touching cells, 0
    within a node; the sign is positive where the first cell's node is the arc's lower one.
    """
    found = []
    for a, b in ((owner[:-1], owner[1:]), (owner[:, :-1], owner[:, 1:])):
        found.append(np.stack([np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]], 1))
    arcs = np.unique(np.concatenate(found), axis=0) if sum(map(len, found)) else np.empty((0, 2), int)
    number = {tuple(e): k + 1 for k, e in enumerate(arcs.tolist())}

    def signed(a, b):
        out = np.zeros(a.shape, int)
        for at in zip(*np.nonzero(a != b)):
            u, v = int(a[at]), int(b[at])
            out[at] = number[min(u, v), max(u, v)] * (1 if u < v else -1)
        return out

    return arcs, signed(owner[:-1], owner[1:]), signed(owner[:, :-1], owner[:, 1:])
