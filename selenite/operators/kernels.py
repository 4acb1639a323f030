"""Numeric kernels in numpy for one job's points at a time: thinned ties, a few hundred rows each."""

from __future__ import annotations

import numpy as np


def polygon_area(p: np.ndarray) -> float:
    if len(p) < 3:
        return 0.0
    q = p - p[0]
    return abs(float((q[:, 0] * np.roll(q[:, 1], -1) - np.roll(q[:, 0], -1) * q[:, 1]).sum())) / 2


def clipped(p: np.ndarray, normal: np.ndarray, limit: float) -> np.ndarray:
    """The part of a convex polygon with normal . point <= limit."""
    d = p @ normal - limit
    out = []
    for i in range(len(p)):
        j = (i + 1) % len(p)
        if d[i] <= 0:
            out.append(p[i])
        if (d[i] < 0 < d[j]) or (d[j] < 0 < d[i]):
            out.append(p[i] + (p[j] - p[i]) * d[i] / (d[i] - d[j]))
    return np.array(out).reshape(-1, 2)


def voronoi_areas(sites: np.ndarray, width: float, height: float) -> np.ndarray:
    """Areas of the cells of distinct sites within the canvas, by half-planes from the nearest neighbour outwards.

    A bisector further away than the cell reaches can't cut it, which ends the search early.
    """
    areas = np.zeros(len(sites))
    for i, s in enumerate(sites):
        cell = np.array([[0, 0], [width, 0], [width, height], [0, height]], float)
        away = ((sites - s) ** 2).sum(1)
        for j in np.argsort(away, kind="stable"):
            if j == i:
                continue
            if away[j] > 4 * ((cell - s) ** 2).sum(1).max():
                break
            normal = sites[j] - s
            cell = clipped(cell, normal, normal @ (sites[j] + s) / 2)
        areas[i] = polygon_area(cell)
    return areas


def hull(p: np.ndarray) -> np.ndarray:
    """Convex hull by a monotone chain."""
    pts = sorted({(float(x), float(y)) for x, y in p})
    if len(pts) < 3:
        return np.array(pts)

    def half(seq):
        out = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def kernel(r2: np.ndarray) -> np.ndarray:
    return np.where(r2 > 0, 0.5 * r2 * np.log(np.where(r2 > 0, r2, 1)), 0.0)


def spline_fit(c: np.ndarray, v: np.ndarray, smoothing: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and affine part (1, x, y) of the regularised thin-plate spline through values v at points c."""
    n = len(c)
    centre, scale = c.mean(0), max(float(np.abs(c - c.mean(0)).max()), 1e-9)
    z = (c - centre) / scale
    k = kernel(((z[:, None] - z) ** 2).sum(2)) + smoothing / scale**2 * np.eye(n)
    p = np.column_stack([np.ones(n), z])
    m = np.block([[k, p], [p.T, np.zeros((3, 3))]])
    sol = np.linalg.solve(m, np.vstack([v, np.zeros((3, v.shape[1]))]))
    return sol[:n], sol[n:]


def spline_apply(at: np.ndarray, c: np.ndarray, w: np.ndarray, a: np.ndarray) -> np.ndarray:
    centre, scale = c.mean(0), max(float(np.abs(c - c.mean(0)).max()), 1e-9)
    z, q = (c - centre) / scale, (at - centre) / scale
    return kernel(((q[:, None] - z) ** 2).sum(2)) @ w + np.column_stack([np.ones(len(q)), q]) @ a


def _normaliser(p: np.ndarray) -> np.ndarray:
    m = p.mean(0)
    s = np.sqrt(2) / max(np.sqrt(((p - m) ** 2).sum(1)).mean(), 1e-12)
    return np.array([[s, 0, -s * m[0]], [0, s, -s * m[1]], [0, 0, 1]])


def dlt(src: np.ndarray, dst: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray | None:
    """Homography from points to points by normalised direct linear transform."""
    a, b = _normaliser(src), _normaliser(dst)
    x, y = src @ a[:2, :2].T + a[:2, 2], dst @ b[:2, :2].T + b[:2, 2]
    one, nil = np.ones(len(x)), np.zeros(len(x))
    r1 = np.column_stack([x, one, nil, nil, nil, -y[:, 0] * x[:, 0], -y[:, 0] * x[:, 1], -y[:, 0]])
    r2 = np.column_stack([nil, nil, nil, x, one, -y[:, 1] * x[:, 0], -y[:, 1] * x[:, 1], -y[:, 1]])
    rows = np.vstack([r1, r2])
    if weight is not None:
        rows = rows * np.sqrt(np.concatenate([weight, weight]))[:, None]
    h = np.linalg.inv(b) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ a
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 and np.isfinite(h).all() else None


def projected(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.column_stack([p, np.ones(len(p))]) @ h.T
    ok = np.abs(q[:, 2:]) > 1e-12
    return np.where(ok, q[:, :2] / np.where(ok, q[:, 2:], 1), np.inf)


def _quartets(n: int, tries: int, seed: int) -> np.ndarray:
    """Rows of four different numbers below n; they depend on the seed alone."""
    r = np.random.default_rng(seed)
    if n < 32:
        return r.random((tries, n)).argsort(1)[:, :4]
    k = np.sort(r.integers(0, n, (2 * tries, 4)), axis=1)
    return k[(np.diff(k, axis=1) > 0).all(1)][:tries]


def _from_quartets(src: np.ndarray, dst: np.ndarray, k: np.ndarray) -> np.ndarray:
    """A homography for each row of k: one stacked null space of normalised direct linear transforms."""
    a, b = _normaliser(src), _normaliser(dst)
    x, y = (src @ a[:2, :2].T + a[:2, 2])[k], (dst @ b[:2, :2].T + b[:2, 2])[k]
    one = np.ones((*k.shape, 1))
    p = np.concatenate([x, one], 2)
    nil = np.zeros_like(p)
    rows = np.concatenate([np.concatenate([p, nil, -y[:, :, :1] * p], 2), np.concatenate([nil, p, -y[:, :, 1:] * p], 2)], 1)
    h = np.linalg.inv(b) @ np.linalg.svd(rows)[2][:, -1].reshape(-1, 3, 3) @ a
    ok = (np.abs(h[:, 2, 2]) > 1e-12) & np.isfinite(h).all((1, 2))
    return h[ok] / h[ok, 2, 2][:, None, None]


def robust_homography(src: np.ndarray, dst: np.ndarray, limit: float = 3.5, tries: int = 1500, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray]:
    """A homography from src to dst that most points agree on, and the mask of those within the limit.

    Hypotheses from four points are scored by a smooth loss marginalised over noise up to the limit, so
    no noise level has to be chosen; the best is refined by weighted fits over all points. The random
    draws depend on the seed alone. Of equally good hypotheses the first one counts.
    """
    n = len(src)
    none = np.zeros(n, bool)
    if n < 4:
        return None, none
    levels = limit / 3 * np.arange(1, 5) / 4
    ends = np.column_stack([src, np.ones(n)])

    def weights(h):
        """For a stack of homographies the weight and squared error of each point."""
        q = ends @ h.transpose(0, 2, 1)
        ok = np.abs(q[..., 2]) > 1e-12
        d2 = ((q[..., :2] / np.where(ok, q[..., 2], 1)[..., None] - dst) ** 2).sum(2)
        d2 = np.where(ok & np.isfinite(d2), d2, 1e18)
        w = sum(np.exp(-d2 / (2 * v * v)) * (d2 < 9 * v * v) for v in levels) / len(levels)
        return w, d2

    h = _from_quartets(src, dst, _quartets(n, tries, seed))
    if not len(h):
        return None, none
    step = max(1, (1 << 20) // n)
    score = np.concatenate([weights(h[i : i + step])[0].sum(1) for i in range(0, len(h), step)])
    best, top = h[score.argmax()], score.max()
    for _ in range(5):
        w = weights(best[None])[0][0]
        if (w > 1e-6).sum() < 4:
            break
        try:
            better = dlt(src[w > 1e-6], dst[w > 1e-6], w[w > 1e-6])
        except np.linalg.LinAlgError:
            break
        if better is None or weights(better[None])[0].sum() < top:
            break
        best, top = better, weights(better[None])[0].sum()
    return best, weights(best[None])[1][0] <= limit**2


def _blurred(v: np.ndarray, sigma: float) -> np.ndarray:
    k = np.arange(-int(3 * sigma + 1), int(3 * sigma + 1) + 1)
    g = np.exp(-(k**2) / (2 * sigma * sigma))
    g /= g.sum()
    for axis in (0, 1):
        pad = [(len(k) // 2,) * 2 if i == axis else (0, 0) for i in (0, 1)]
        w = np.lib.stride_tricks.sliding_window_view(np.pad(v, pad, mode="reflect" if min(v.shape) > len(k) // 2 else "edge"), len(k), axis)
        v = w @ g
    return v


def keypoints(v: np.ndarray, most: int = 10_000, contrast: float = 0.03, edge: float = 10.0, octaves: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Extrema of differences of Gaussians (x, y, response), strongest first, and a 128-value descriptor of each.

    Each further octave looks at the picture halved once more, as long as it has room for a descriptor.
    """
    img, found, described = v.astype(float) / 255, [], []
    for k in range(octaves):
        if k and min(img.shape) < 16:
            break
        p, d = _octave(img, contrast, edge)
        p[:, :2] *= 2**k
        found.append(p)
        described.append(d)
        if k + 1 < octaves:
            img = _blurred(img, 1.6)[::2, ::2]
    p, d = np.concatenate(found), np.concatenate(described)
    order = np.lexsort((p[:, 0], p[:, 1], -p[:, 2]))[:most]
    return p[order], d[order]


def _octave(img: np.ndarray, contrast: float, edge: float) -> tuple[np.ndarray, np.ndarray]:
    stack = [_blurred(img, 1.6 * 2 ** (i / 3)) for i in range(6)]
    dog = np.stack([b - a for a, b in zip(stack, stack[1:])])
    found = []
    for k in range(1, len(dog) - 1):
        c = dog[k, 1:-1, 1:-1]
        around = np.stack([dog[k + i, 1 + y : dog.shape[1] - 1 + y, 1 + x : dog.shape[2] - 1 + x] for i in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1) if (i, y, x) != (0, 0, 0)])
        peak = ((c > around.max(0)) | (c < around.min(0))) & (np.abs(c) > contrast / 3)
        d = dog[k]
        xx, yy = d[1:-1, 2:] + d[1:-1, :-2] - 2 * c, d[2:, 1:-1] + d[:-2, 1:-1] - 2 * c
        xy = (d[2:, 2:] + d[:-2, :-2] - d[2:, :-2] - d[:-2, 2:]) / 4
        det = xx * yy - xy * xy
        flat = (det > 0) & ((xx + yy) ** 2 * edge < (edge + 1) ** 2 * det)
        y, x = np.nonzero(peak & flat)
        found.append(np.column_stack([x + 1, y + 1, np.abs(c[y, x]), np.full(len(x), k)]))
    p = np.concatenate(found) if found else np.zeros((0, 4))
    gy, gx = np.gradient(stack[1])
    mag, ang = np.hypot(gx, gy), np.arctan2(gy, gx)
    desc = np.zeros((len(p), 128))
    off = np.arange(-8, 8) + 0.5
    for n, (x, y, *_) in enumerate(p):
        ys, xs = np.clip((y + off).astype(int), 0, img.shape[0] - 1), np.clip((x + off).astype(int), 0, img.shape[1] - 1)
        m, a = mag[np.ix_(ys, xs)], ang[np.ix_(ys, xs)]
        w = m * np.exp(-(off[:, None] ** 2 + off**2) / 128)
        main = np.argmax(np.bincount(((a + np.pi) / (2 * np.pi) * 36).astype(int).ravel() % 36, w.ravel(), 36)) / 36 * 2 * np.pi - np.pi
        cell = (np.arange(16) // 4)[:, None] * 4 + np.arange(16) // 4
        bins = ((a - main) % (2 * np.pi) / (2 * np.pi) * 8).astype(int) % 8
        h = np.bincount((cell * 8 + bins).ravel(), w.ravel(), 128)
        h = np.minimum(h / max(np.linalg.norm(h), 1e-12), 0.2)
        desc[n] = h / max(np.linalg.norm(h), 1e-12)
    return p[:, :3], desc


def _at(v: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values between samples; places outside are those of the border."""
    y, x = np.clip(y, 0, v.shape[0] - 1), np.clip(x, 0, v.shape[1] - 1)
    y0, x0 = np.minimum(y.astype(int), max(v.shape[0] - 2, 0)), np.minimum(x.astype(int), max(v.shape[1] - 2, 0))
    fy, fx = y - y0, x - x0
    y1, x1 = np.minimum(y0 + 1, v.shape[0] - 1), np.minimum(x0 + 1, v.shape[1] - 1)
    return (v[y0, x0] * (1 - fx) + v[y0, x1] * fx) * (1 - fy) + (v[y1, x0] * (1 - fx) + v[y1, x1] * fx) * fy


def _level(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, radius: int, steps: int, stop: float) -> tuple[np.ndarray, np.ndarray]:
    """One level of track(): all points step together, those that have settled drop out."""
    gy, gx = np.gradient(a)
    oy, ox = (g.ravel() for g in np.mgrid[-radius : radius + 1, -radius : radius + 1])
    y, x = p[:, 1, None] + oy, p[:, 0, None] + ox
    t, dx, dy = _at(a, y, x), _at(gx, y, x), _at(gy, y, x)
    xx, xy, yy = (dx * dx).sum(1), (dx * dy).sum(1), (dy * dy).sum(1)
    det = xx * yy - xy * xy
    ok = (xx + yy - np.sqrt((xx - yy) ** 2 + 4 * xy * xy)) / 2 >= 1e-6
    out, live = q.copy(), np.flatnonzero(ok)
    for _ in range(steps):
        if not len(live):
            break
        e = t[live] - _at(b, out[live, 1, None] + oy, out[live, 0, None] + ox)
        ex, ey = (dx[live] * e).sum(1), (dy[live] * e).sum(1)
        d = np.column_stack([yy[live] * ex - xy[live] * ey, xx[live] * ey - xy[live] * ex]) / det[live, None]
        out[live] += d
        live = live[np.abs(d).max(1) >= stop]
    return out, ok


def track(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, radius: int = 10, steps: int = 40, stop: float = 1e-3, levels: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Iterative least squares: where the window around each p in a lies in b, begun at q; and whether it stayed inside.

    Begun on pictures that were halved `levels` times (as often as they stay larger than a window) and refined
    on each larger one.
    """
    if not len(p):
        return q.astype(float).copy(), np.zeros(0, bool)
    stack = [(a.astype(float), b.astype(float))]
    while len(stack) <= levels and min(*stack[-1][0].shape, *stack[-1][1].shape) >= 4 * radius:
        stack.append(tuple(_blurred(v, 1.0)[::2, ::2] for v in stack[-1]))
    scale = 0.5 ** (len(stack) - 1)
    out = q * scale
    for k in range(len(stack) - 1, -1, -1):
        out, ok = _level(*stack[k], p * scale, out, radius, steps, stop)
        if k:
            out, scale = out * 2, scale * 2
    return out, ok & np.isfinite(out).all(1) & (out >= 0).all(1) & (out[:, 0] < b.shape[1]) & (out[:, 1] < b.shape[0])
