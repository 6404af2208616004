"""Intrinsic triangulations of one mesh: mollification, a tufted double cover and flips to Delaunay.

A triangulation is kept by its edges' lengths alone. Faces that are needles get all edges
lengthened by the least amount that leaves every triangle inequality slack. The double cover
gives each face a front and a back and joins, around every edge, the sides that look into the
same wedge, so any set of triangles becomes a closed manifold. Edges whose opposite angles
add up to more than a half turn are flipped in the unfolded plane until none is left;
cotangent weights then are not negative.
"""

from __future__ import annotations

from collections import deque

import numpy as np

#: Slack of triangle inequalities, as a share of the mean edge length.
SLACK = 1e-5


def mollified(length: np.ndarray, slack: float = SLACK) -> np.ndarray:
    """(faces, 3) edge lengths, all made longer by the least amount that leaves a slack in every triangle."""
    if not len(length):
        return length
    a, b, c = length.T
    short = np.max([a - b - c, b - c - a, c - a - b])
    return length + max(0.0, slack * length.mean() + short)


class Cover:
    """Half-edges 3 t + c of triangles: vertices, lengths and glued partners (-1 at boundaries)."""

    def __init__(self, start: np.ndarray, length: np.ndarray, glue: np.ndarray):
        self.start, self.length, self.glue = start, length, glue

    def corner_cotangents(self) -> np.ndarray:
        """Of the angle opposite to each half-edge."""
        a = self.length.reshape(-1, 3)
        b, c = np.roll(a, -1, 1), np.roll(a, -2, 1)
        return ((b * b + c * c - a * a) / (4 * self.areas()[:, None])).ravel()

    def areas(self) -> np.ndarray:
        a, b, c = np.sort(self.length.reshape(-1, 3), 1)[:, ::-1].T  # stable for needles
        return 0.25 * np.sqrt(np.maximum((a + (b + c)) * (c - (a - b)) * (c + (a - b)) * (a + (b - c)), 1e-300))

    def flip_to_delaunay(self, eps: float = 1e-10, plane: np.ndarray | None = None) -> int:
        """Flips made; edges at boundaries and between a triangle and itself stay. Positions in the ``plane`` are used where they are known."""
        start, length, glue = self.start.tolist(), self.length.tolist(), self.glue.tolist()
        place = None if plane is None else plane.tolist()

        def cot(h: int) -> float:
            t = h - h % 3
            if place is not None:
                (ix, iy), (jx, jy), (kx, ky) = place[start[h]], place[start[t + (h + 1) % 3]], place[start[t + (h + 2) % 3]]
                ix, iy, jx, jy = ix - kx, iy - ky, jx - kx, jy - ky
                return (ix * jx + iy * jy) / max(ix * jy - iy * jx, 1e-300)
            a, b, c = length[h], length[t + (h + 1) % 3], length[t + (h + 2) % 3]
            x, y, z = sorted((a, b, c), reverse=True)
            area = 0.25 * max((x + (y + z)) * (z - (x - y)) * (z + (x - y)) * (x + (y - z)), 1e-300) ** 0.5
            return (b * b + c * c - a * a) / (4 * area)

        flips, todo = 0, deque(h for h in range(len(start)) if glue[h] > h)
        waiting = [glue[h] > h for h in range(len(start))]
        while todo:
            h = todo.popleft()
            waiting[h] = False
            g = glue[h]
            if g < 0 or g // 3 == h // 3 or cot(h) + cot(g) >= -eps:
                continue
            t, u = h - h % 3, g - g % 3
            h1, h2, g1, g2 = t + (h + 1) % 3, t + (h + 2) % 3, u + (g + 1) % 3, u + (g + 2) % 3
            # h runs i to j, with apex k; g runs j to i, with apex m: laid out along h
            base = length[h]
            kx = (base**2 + length[h2] ** 2 - length[h1] ** 2) / (2 * base)
            mx = (base**2 + length[g1] ** 2 - length[g2] ** 2) / (2 * base)
            ky, my = max(length[h2] ** 2 - kx**2, 0.0) ** 0.5, max(length[g1] ** 2 - mx**2, 0.0) ** 0.5
            across = ((kx - mx) ** 2 + (ky + my) ** 2) ** 0.5
            k, m, i, j = start[h2], start[g2], start[h], start[g]
            outer = [(h1, j), (h2, k), (g1, i), (g2, m)]
            size, partner = [length[x] for x, _ in outer], [glue[x] for x, _ in outer]
            # t becomes m, j, k and u becomes k, i, m
            new = {h1: t + 1, h2: u, g1: u + 1, g2: t}
            for (old, v), long, p in zip(outer, size, partner, strict=True):
                at = new[old]
                start[at], length[at], glue[at] = v, long, new.get(p, p)
            for old, p in zip((h1, h2, g1, g2), partner, strict=True):
                if p >= 0 and p not in new:
                    glue[p] = new[old]
            start[t + 2], start[u + 2] = k, m
            length[t + 2] = length[u + 2] = across
            glue[t + 2], glue[u + 2] = u + 2, t + 2
            flips += 1
            for x in (t, t + 1, u, u + 1):
                if glue[x] >= 0 and not waiting[x]:
                    waiting[x] = True
                    todo.append(x)
        self.start, self.length, self.glue = np.array(start), np.array(length, float), np.array(glue)
        return flips

    def laplacian(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, weight, mass): half a cotangent at both ends of each half-edge, a third of each triangle's area at its corners."""
        i, j = self.start, np.roll(self.start.reshape(-1, 3), -1, 1).ravel()
        w = self.corner_cotangents() / 2
        mass = np.bincount(i, np.repeat(self.areas() / 3, 3), n)
        return i, j, w, mass


def single_cover(faces: np.ndarray, length: np.ndarray) -> Cover:
    """The mesh itself; edges of other than two faces are boundaries, and so are edges whose faces run the same way."""
    start, end = faces.ravel(), np.roll(faces, -1, 1).ravel()
    glue = np.full(len(start), -1)
    order = np.lexsort((start > end, np.maximum(start, end), np.minimum(start, end)))
    lo, hi = np.minimum(start, end)[order], np.maximum(start, end)[order]
    first = np.flatnonzero(np.append(True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))) if len(order) else np.zeros(0, int)
    for a in first[np.diff(np.append(first, len(order))) == 2]:
        p, q = order[a], order[a + 1]
        if start[p] == end[q]:
            glue[p], glue[q] = q, p
    return Cover(start, length.ravel(), glue)


def tufted_cover(points: np.ndarray, faces: np.ndarray, length: np.ndarray) -> Cover:
    """Front and back of every face; around each edge, in order of angle, a face's side is joined with the next face's side that looks at it."""
    n = len(faces)
    start, end, apex = faces.ravel(), np.roll(faces, -1, 1).ravel(), np.roll(faces, -2, 1).ravel()
    forward = start < end
    lo, hi = np.minimum(start, end), np.maximum(start, end)
    axis = points[hi] - points[lo]
    axis = axis / np.maximum(np.linalg.norm(axis, axis=1, keepdims=True), 1e-300)
    out = points[apex] - points[lo]
    out = out - (out * axis).sum(1, keepdims=True) * axis
    helper = np.eye(3)[np.abs(axis).argmin(1)]
    one = np.cross(axis, helper)
    one = one / np.maximum(np.linalg.norm(one, axis=1, keepdims=True), 1e-300)
    angle = np.arctan2((out * np.cross(axis, one)).sum(1), (out * one).sum(1))
    order = np.lexsort((np.arange(3 * n), angle, hi, lo))
    edge = np.flatnonzero(np.append(True, (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1]))) if n else np.zeros(0, int)
    size = np.diff(np.append(edge, 3 * n))
    following = np.arange(3 * n) + 1
    following[edge + size - 1] = edge
    after = np.empty(3 * n, int)
    after[order] = order[following]
    # half-edge 3 f + c of the front keeps its place; that of the back, run the other way, is 3 (n + f) + 2 - c
    c = np.arange(3 * n) % 3
    back = 3 * (n + np.arange(3 * n) // 3) + 2 - c
    front = np.arange(3 * n)
    ahead = np.where(forward, front, back)  # the side that looks at growing angles runs from lo to hi
    behind = np.where(forward, back, front)
    glue = np.empty(6 * n, int)
    glue[ahead], glue[behind[after]] = behind[after], ahead
    starts, lengths = np.empty(6 * n, int), np.empty(6 * n)
    starts[front], starts[back] = start, end
    lengths[front] = lengths[back] = length.ravel()
    return Cover(starts, lengths, glue)


def robust_laplacian(points: np.ndarray, faces: np.ndarray, slack: float = SLACK, tufted: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, weight, mass) by the flipped, mollified triangulation, of the double cover (halved) or of the mesh itself."""
    sides = np.linalg.norm(points[faces] - points[np.roll(faces, -1, 1)], axis=2) if len(faces) else np.zeros((0, 3))
    cover = (lambda x: tufted_cover(points, faces, x)) if tufted else (lambda x: single_cover(faces, x))
    c = cover(mollified(sides, slack))
    c.flip_to_delaunay()
    i, j, w, mass = c.laplacian(len(points))
    share = 0.5 if tufted else 1.0
    return i, j, w * share, mass * share


def swept(xy: np.ndarray) -> np.ndarray:
    """Some triangulation of plane points, taken from left to right: each sees a stretch of the outline so far, found by a walk from the point before it."""
    order = np.lexsort((xy[:, 1], xy[:, 0])).tolist()
    p = xy.tolist()

    def turn(a: int, b: int, c: int) -> float:
        return (p[b][0] - p[a][0]) * (p[c][1] - p[a][1]) - (p[b][1] - p[a][1]) * (p[c][0] - p[a][0])

    apart = [order[0]] if order else []  # one of several points at one place
    for i in order[1:]:
        if p[i] != p[apart[-1]]:
            apart.append(i)
    m = next((m for m in range(2, len(apart)) if turn(apart[0], apart[m - 1], apart[m])), None)
    if m is None:
        return np.zeros((0, 3), np.int64)
    c = apart[m]
    line = apart[:m] if turn(apart[0], apart[m - 1], c) > 0 else apart[:m][::-1]
    out = [(a, b, c) for a, b in zip(line, line[1:])]
    ring = [*line, c]
    after, before = dict(zip(ring, [*ring[1:], ring[0]])), dict(zip([*ring[1:], ring[0]], ring))
    last = c
    for q in apart[m + 1 :]:
        hi = lo = last
        while turn(hi, after[hi], q) < 0:
            out.append((after[hi], hi, q))
            hi = after[hi]
        while turn(before[lo], lo, q) < 0:
            out.append((lo, before[lo], q))
            lo = before[lo]
        after[lo], before[q], after[q], before[hi] = q, lo, hi, q
        last = q
    return np.array(out, np.int64)


def delaunay(xy: np.ndarray) -> np.ndarray:
    """(triangles, 3) of plane points: swept and flipped; points at one place are one."""
    faces = swept(xy)
    c = single_cover(faces, np.linalg.norm(xy[faces] - xy[np.roll(faces, -1, 1)], axis=2))
    c.flip_to_delaunay(1e-9, xy - xy.mean(0))
    t = c.start.reshape(-1, 3)
    first = t.argmin(1)[:, None]
    return np.take_along_axis(t, (first + np.arange(3)) % 3, 1)[np.lexsort(np.take_along_axis(t, (first + np.arange(3)) % 3, 1).T[::-1])]


def stars(offsets: np.ndarray) -> np.ndarray:
    """(triangles, 2) places of the neighbours that a point at the origin shares Delaunay triangles with; ``offsets`` (k, 2) in its tangent plane.

    Inversion at the origin turns circles through it into lines: two neighbours share an empty circle with the point where their images are next to each other on the images' convex hull.
    """
    square = (offsets**2).sum(1)
    fine = np.flatnonzero(square > 1e-24 * max(square.max(initial=0), 1e-300))
    if len(fine) < 2:
        return np.zeros((0, 2), int)
    q = offsets[fine] / square[fine, None]
    order = np.lexsort((q[:, 1], q[:, 0]))
    hull: list[int] = []
    for side in (order, order[::-1]):
        base = len(hull)
        for p in side.tolist():
            while len(hull) - base >= 2 and (q[hull[-1], 0] - q[hull[-2], 0]) * (q[p, 1] - q[hull[-2], 1]) - (q[hull[-1], 1] - q[hull[-2], 1]) * (q[p, 0] - q[hull[-2], 0]) <= 0:
                hull.pop()
            hull.append(p)
        hull.pop()
    h = np.array(hull)
    after = np.roll(h, -1)
    turn = q[h, 0] * q[after, 1] - q[h, 1] * q[after, 0]  # the hull's other lines have the origin on their far side: no triangle
    long = np.linalg.norm(q[h], axis=1) * np.linalg.norm(q[after], axis=1)
    return np.stack([fine[h], fine[after]], 1)[turn > 1e-9 * long]
