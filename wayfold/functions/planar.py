"""Planar geometry of lines and rings as numpy arrays of shape (n, 2), in metres."""

from __future__ import annotations

import math

import numpy as np

EPS = 1e-9


def lengths(line: np.ndarray) -> np.ndarray:
    """Distance along the line of each of its places."""
    return np.append(0.0, np.cumsum(np.hypot(*np.diff(line, axis=0).T))) if len(line) else np.zeros(0)


def interpolate(line: np.ndarray, along: np.ndarray) -> np.ndarray:
    """The places at distances along the line, its ends beyond them."""
    at = lengths(line)
    return np.stack([np.interp(along, at, line[:, 0]), np.interp(along, at, line[:, 1])], 1)


def feet(points: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each point its distance to the line, the distance along to its foot and the foot's segment; of
    equally near segments the first."""
    if len(line) == 1:
        return np.hypot(*(points - line[0]).T), np.zeros(len(points)), np.zeros(len(points), int)
    a, d = line[:-1], np.diff(line, axis=0)
    squared = (d**2).sum(1)
    t = np.clip(((points[:, None] - a) * d).sum(2) / np.where(squared > 0, squared, 1), 0, 1)
    off = points[:, None] - (a + t[..., None] * d)
    distance = np.hypot(off[..., 0], off[..., 1])
    best = distance.argmin(1)
    rows = np.arange(len(points))
    return distance[rows, best], lengths(line)[best] + t[rows, best] * np.sqrt(squared[best]), best


def signed(points: np.ndarray, line: np.ndarray, tangent: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Signed distance, positive on the left, and distance along. The side is that of the foot's segment
    (the one that ends at or after the foot), or of the chord ``tangent`` metres around the foot."""
    distance, along, _ = feet(points, line)
    at = lengths(line)
    if tangent is None:
        i = np.clip(np.searchsorted(at[1:], along, "left"), 0, len(line) - 2)
        before, after = line[i], line[i + 1]
    else:
        before, after = interpolate(line, np.maximum(along - tangent, 0)), interpolate(line, np.minimum(along + tangent, at[-1]))
    d, p = after - before, points - interpolate(line, along)
    return distance * np.sign(d[:, 0] * p[:, 1] - d[:, 1] * p[:, 0]), along


def mean_distance(a: np.ndarray, b: np.ndarray, samples: int = 11) -> float:
    """The larger of the mean distances of evenly spaced places of each line to the other."""
    one = lambda x, y: feet(interpolate(x, np.linspace(0, lengths(x)[-1], samples)), y)[0].mean()
    return float(max(one(a, b), one(b, a)))


def merged(starts: np.ndarray, ends: np.ndarray) -> float:
    """Length of the union of intervals."""
    if not len(starts):
        return 0.0
    order = np.argsort(starts)
    s, e = starts[order], ends[order]
    reach = np.maximum.accumulate(np.append(-np.inf, e))[:-1]
    return float(np.maximum(e - np.maximum(s, reach), 0).sum())


def cut(p: np.ndarray, q: np.ndarray, other: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Where, as shares of the way from p to q, a leg lies within ``radius`` of another line: it is cut by the
    rectangle beside and the discs about the ends of each segment."""
    c, e = (other[:-1], other[1:]) if len(other) > 1 else (other, other)
    d = q - p
    length = float(np.hypot(*d))
    if not length or not len(c):
        return np.zeros(0), np.zeros(0)
    axis = e - c
    size = np.hypot(*axis.T)
    unit = axis / np.where(size > 0, size, 1)[:, None]
    lo, hi = [], []
    for centre in (c, e):
        f = p - centre
        b, k = f @ d / length**2, ((f**2).sum(1) - radius**2) / length**2
        root = np.sqrt(np.maximum(b * b - k, 0))
        has = b * b - k > 0
        lo.append((-b - root)[has])
        hi.append((-b + root)[has])
    f = p - c  # along and beside each axis a place of the leg is linear in its share
    first, last = np.zeros(len(c)), np.ones(len(c))
    along = (unit * f).sum(1), unit @ d, np.zeros(len(c)), size
    beside = unit[:, 0] * f[:, 1] - unit[:, 1] * f[:, 0], unit[:, 0] * d[1] - unit[:, 1] * d[0], np.full(len(c), -radius), np.full(len(c), radius)
    for start, slope, least, most in (along, beside):
        flat = np.abs(slope) < EPS
        out = flat & ((start < least - EPS) | (start > most + EPS))
        steep = np.where(flat, 1, slope)
        x, y = (least - start) / steep, (most - start) / steep
        first = np.where(out, 2.0, np.where(flat, first, np.maximum(first, np.minimum(x, y))))
        last = np.where(flat, last, np.minimum(last, np.maximum(x, y)))
    has = (size > 0) & (first < last)
    lo, hi = np.clip(np.concatenate([*lo, first[has]]), 0, 1), np.clip(np.concatenate([*hi, last[has]]), 0, 1)
    return lo[hi > lo], hi[hi > lo]


def covered(line: np.ndarray, other: np.ndarray, radius: float) -> float:
    """Length of the line that lies within ``radius`` of another."""
    return sum(merged(*cut(p, q, other, radius)) * float(np.hypot(*(q - p))) for p, q in zip(line[:-1], line[1:], strict=True))


def overlap(a: np.ndarray, b: np.ndarray, radius: float) -> float:
    """Share of the shorter line (of equals the first) within ``radius`` of the longer one; 0 if empty."""
    la, lb = (lengths(x)[-1] if len(x) else 0.0 for x in (a, b))
    if not la or not lb:
        return 0.0
    short, long, size = (a, b, la) if la <= lb else (b, a, lb)
    return min(1.0, covered(short, long, radius) / size)


def simplified(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices that Douglas and Peucker's method keeps: farthest places first, no recursion."""
    keep = np.zeros(len(line), bool)
    keep[[0, -1]] = True
    todo = [(0, len(line) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        distance = feet(line[i + 1 : j], line[[i, j]])[0]
        k = int(distance.argmax())
        if distance[k] > tolerance:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return np.flatnonzero(keep)


def open_ring(ring: np.ndarray) -> np.ndarray:
    return ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring


def closed_ring(ring: np.ndarray) -> np.ndarray:
    return ring if len(ring) and (ring[0] == ring[-1]).all() else np.concatenate([ring, ring[:1]])


def signed_area(ring: np.ndarray) -> float:
    r = open_ring(ring)
    if len(r) < 3:
        return 0.0
    x, y = (r - r[0]).T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def area(rings: list[np.ndarray]) -> float:
    """Of an outer ring and its holes."""
    return max(0.0, abs(signed_area(rings[0])) - sum(abs(signed_area(h)) for h in rings[1:])) if rings else 0.0


def ring_centroid(ring: np.ndarray) -> np.ndarray:
    """By area; the mean of the places where there is none."""
    r = open_ring(ring)
    x, y = (r - r[0]).T
    cross = x * np.roll(y, -1) - np.roll(x, -1) * y
    if abs(cross.sum()) < EPS:
        return r.mean(0)
    return r[0] + np.array([((x + np.roll(x, -1)) * cross).sum(), ((y + np.roll(y, -1)) * cross).sum()]) / (3 * cross.sum())


def line_centroid(line: np.ndarray) -> np.ndarray:
    """By length; the first place of a line without length."""
    size = np.hypot(*np.diff(line, axis=0).T)
    return ((line[:-1] + line[1:]) / 2 * size[:, None]).sum(0) / size.sum() if size.sum() > 0 else line[0]


def clipped(subject: np.ndarray, convex: np.ndarray) -> np.ndarray:
    """The part of a ring within a convex ring, as an open ring (empty if there is none)."""
    clip = open_ring(convex)
    out, turn = open_ring(subject).tolist(), 1.0 if signed_area(clip) > 0 else -1.0
    # few places a ring: numbers are faster than arrays
    for (ax, ay), (bx, by) in zip(clip.tolist(), np.roll(clip, -1, 0).tolist(), strict=True):
        if not out:
            break
        dx, dy = bx - ax, by - ay
        side = [turn * (dx * (y - ay) - dy * (x - ax)) for x, y in out]
        kept, p, sp = [], out[-1], side[-1]
        for q, sq in zip(out, side, strict=True):
            if (sp >= -EPS) != (sq >= -EPS):
                t = sp / (sp - sq)
                kept.append([p[0] + (q[0] - p[0]) * t, p[1] + (q[1] - p[1]) * t])
            if sq >= -EPS:
                kept.append(q)
            p, sp = q, sq
        out = kept
    return np.array(out, float).reshape(-1, 2)


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise and open."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(rows):
        out: list[np.ndarray] = []
        for r in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (r[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (r[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(r)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def buffered_hull(points: np.ndarray, radius: float, per_quadrant: int = 16) -> np.ndarray:
    """The hull with a margin, its corners round: the hull of circles about the hull's corners."""
    angles = np.arange(4 * per_quadrant) * math.pi / 2 / per_quadrant
    ring = radius * np.stack([np.cos(angles), np.sin(angles)], 1)
    return hull((hull(points)[:, None] + ring).reshape(-1, 2))


def in_rings(point, outers: list[np.ndarray], inners: list[np.ndarray] = ()) -> bool:
    """Even-odd: in any outer ring and in no inner one."""

    def inside(ring):
        r = open_ring(ring)
        x1, y1, (x2, y2) = r[:, 0], r[:, 1], np.roll(r, -1, 0).T
        crosses = (y1 > point[1]) != (y2 > point[1])
        with np.errstate(all="ignore"):
            at = (x2 - x1) * (point[1] - y1) / (y2 - y1) + x1
        return int((crosses & (point[0] < at)).sum()) % 2 == 1

    return any(inside(r) for r in outers) and not any(inside(r) for r in inners)


def on_edge(point, ring: np.ndarray) -> bool:
    """Whether the point lies on the ring itself."""
    return bool(feet(np.array([point], float), closed_ring(ring))[0][0] <= EPS)


# The same of many lines at once: arrays of shape (k, n, 2), padded with their last places, which changes no measure.


def lengths_each(lines: np.ndarray) -> np.ndarray:
    step = np.diff(lines, axis=1)
    return np.concatenate([np.zeros((len(lines), 1)), np.cumsum(np.hypot(step[..., 0], step[..., 1]), axis=1)], 1)


def interpolate_each(values: np.ndarray, at: np.ndarray, along: np.ndarray) -> np.ndarray:
    """Of each row the places at distances ``along`` (k, r), where ``values`` lie at ``at``; its ends beyond them."""
    rows = np.arange(len(at))[:, None]
    i = np.maximum((at[:, None] <= along[..., None]).sum(2) - 1, 0)
    j = np.minimum(i + 1, at.shape[1] - 1)
    gap = at[rows, j] - at[rows, i]
    slope = (values[rows, j] - values[rows, i]) / np.where(gap > 0, gap, 1)[..., None]
    return slope * np.where(gap > 0, along - at[rows, i], 0)[..., None] + values[rows, i]


def feet_each(points: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``feet`` of points (k, r, 2): distances and distances along."""
    a, d = lines[:, None, :-1], np.diff(lines, axis=1)[:, None]
    squared = (d**2).sum(3)
    t = np.clip(((points[:, :, None] - a) * d).sum(3) / np.where(squared > 0, squared, 1), 0, 1)
    off = points[:, :, None] - (a + t[..., None] * d)
    distance = np.hypot(off[..., 0], off[..., 1])
    best = distance.argmin(2)[..., None]
    take = lambda x: np.take_along_axis(np.broadcast_to(x, distance.shape), best, 2)[..., 0]
    return take(distance), take(lengths_each(lines)[:, None, :-1]) + take(t) * np.sqrt(take(squared))


def signed_each(points: np.ndarray, lines: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``signed`` of a point (k, 2) each, without a tangent."""
    distance, along = (x[:, 0] for x in feet_each(points[:, None], lines))
    at, rows = lengths_each(lines), np.arange(len(lines))
    i = np.clip((at[:, 1:] < along[:, None]).sum(1), 0, np.maximum(sizes - 2, 0))
    d, p = lines[rows, i + 1] - lines[rows, i], points - interpolate_each(lines, at, along[:, None])[:, 0]
    return distance * np.sign(d[:, 0] * p[:, 1] - d[:, 1] * p[:, 0]), along


def mean_distance_each(a: np.ndarray, b: np.ndarray, samples: int = 11) -> np.ndarray:
    def one(x, y):
        at = lengths_each(x)
        return feet_each(interpolate_each(x, at, np.linspace(0, at[:, -1], samples, axis=1)), y)[0].mean(1)

    return np.maximum(one(a, b), one(b, a))


def cut_each(p: np.ndarray, q: np.ndarray, other: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """``cut`` of a leg (k, 2) each, as disjoint intervals in order; those that end where they start are none."""
    c, e = other[:, :-1], other[:, 1:]
    d = (q - p)[:, None]
    squared = (d**2).sum(2)
    safe = np.where(squared > 0, squared, 1)
    axis = e - c
    size = np.hypot(axis[..., 0], axis[..., 1])
    unit = axis / np.where(size > 0, size, 1)[..., None]
    lo, hi = [], []
    for centre in (c, e):
        f = p[:, None] - centre
        b, k = (f * d).sum(2) / safe, ((f**2).sum(2) - radius**2) / safe
        root = np.sqrt(np.maximum(b * b - k, 0))
        has = (b * b - k > 0) & (squared > 0)
        lo.append(np.where(has, -b - root, 0))
        hi.append(np.where(has, -b + root, 0))
    f = p[:, None] - c
    first, last = np.zeros(size.shape), np.ones(size.shape)
    along = (unit * f).sum(2), (unit * d).sum(2), np.zeros(size.shape), size
    beside = unit[..., 0] * f[..., 1] - unit[..., 1] * f[..., 0], unit[..., 0] * d[..., 1] - unit[..., 1] * d[..., 0], -radius, radius
    for start, slope, least, most in (along, beside):
        flat = np.abs(slope) < EPS
        out = flat & ((start < least - EPS) | (start > most + EPS))
        steep = np.where(flat, 1, slope)
        x, y = (least - start) / steep, (most - start) / steep
        first = np.where(out, 2.0, np.where(flat, first, np.maximum(first, np.minimum(x, y))))
        last = np.where(flat, last, np.minimum(last, np.maximum(x, y)))
    has = (size > 0) & (first < last) & (squared > 0)
    lo, hi = (np.clip(np.concatenate(x, 1), 0, 1) for x in ([*lo, np.where(has, first, 0)], [*hi, np.where(has, last, 0)]))
    order = np.argsort(lo, axis=1, kind="stable")
    lo, hi = np.take_along_axis(lo, order, 1), np.take_along_axis(hi, order, 1)
    reach = np.concatenate([np.zeros((len(lo), 1)), np.maximum.accumulate(hi, 1)[:, :-1]], 1)
    lo = np.maximum(lo, reach)
    return lo, np.maximum(hi, lo)


def overlap_each(a: np.ndarray, b: np.ndarray, radius: float) -> np.ndarray:
    """``overlap`` of lines that are padded to one width."""
    la, lb = lengths_each(a)[:, -1], lengths_each(b)[:, -1]
    swap = (la > lb)[:, None, None]
    short, long, size = np.where(swap, b, a), np.where(swap, a, b), np.minimum(la, lb)
    total = np.zeros(len(a))
    for i in range(a.shape[1] - 1):
        p, q = short[:, i], short[:, i + 1]
        lo, hi = cut_each(p, q, long, radius)
        total += (hi - lo).sum(1) * np.hypot(*(q - p).T)
    return np.where(size > 0, np.minimum(1.0, total / np.where(size > 0, size, 1)), 0.0)
