"""Exact distances on triangle meshes by windows of light, for one mesh and source.

A window is a stretch of an edge that a source, or a vertex where shortest paths may bend,
sees along straight lines through unfolded faces; its light comes from a point in the plane
of the next face. A round carries all windows across their faces at once, shortens the
distances of the vertices that they reach, and lets bending vertices send light anew.
Windows that vertices already beat along the edge, or whose origin has come nearer, are
dropped; distances along edges are the first bounds. Rounds end when no window is left.
"""

from __future__ import annotations

import numpy as np


class Surface:
    """Half-edges of a mesh: 3 f + c runs from corner c of face f to the next; faces that repeat others' vertices count once."""

    def __init__(self, points: np.ndarray, faces: np.ndarray):
        if len(faces):
            faces = faces[np.sort(np.unique(np.sort(faces, 1), axis=0, return_index=True)[1])]
            corner = points[faces]
            twice = np.linalg.norm(np.cross(corner[:, 1] - corner[:, 0], corner[:, 2] - corner[:, 0]), axis=1)
            sides = np.linalg.norm(corner - np.roll(corner, -1, 1), axis=2)
            faces = faces[twice > 1e-12 * sides.max(1) ** 2]  # no light passes a face without area
        self.n, self.faces = len(points), faces
        self.start, self.end = faces.ravel(), np.roll(faces, -1, 1).ravel()
        self.apex = np.roll(faces, -2, 1).ravel()
        length = lambda a, b: np.linalg.norm(points[a] - points[b], axis=1)
        self.length = length(self.start, self.end)
        to_start, to_end = length(self.start, self.apex), length(self.end, self.apex)
        self.cx = (to_start**2 + self.length**2 - to_end**2) / np.maximum(2 * self.length, 1e-300)
        self.cy = np.sqrt(np.maximum(to_start**2 - self.cx**2, 0))
        edge = np.unique(np.sort(np.stack([self.start, self.end], 1), 1), axis=0, return_inverse=True)[1].ravel() if len(faces) else np.zeros(0, int)
        self.uses = np.bincount(edge)
        order = np.argsort(edge, kind="stable")
        self.first = (np.cumsum(self.uses) - self.uses)[edge]
        self.same, self.count = order, self.uses[edge]
        angle = np.zeros(self.n)
        np.add.at(angle, self.start, np.arctan2(self.cy, self.cx))
        self.bends = angle > 2 * np.pi - 1e-9
        for v in (self.start, self.end):
            self.bends[v[self.count != 2]] = True
        self.eps = 1e-10 * max(float(self.length.mean()) if len(faces) else 0.0, 1e-300)

    def across(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in h, half-edge) of the other faces at the edges of half-edges ``h``."""
        at = np.repeat(np.arange(len(h)), self.count[h])
        k = np.arange(len(at)) - np.repeat(np.cumsum(self.count[h]) - self.count[h], self.count[h])
        other = self.same[self.first[h][at] + k]
        fine = other != h[at]
        return at[fine], other[fine]


def distances(s: Surface, source: int) -> np.ndarray:
    """Distances of all vertices from one; infinite where no path leads."""
    dist = np.full(s.n, np.inf)
    dist[source] = 0
    along = (np.concatenate([s.start, s.end]), np.concatenate([s.end, s.start]), np.tile(s.length, 2))

    def relax() -> None:
        while True:
            was = dist.copy()
            np.minimum.at(dist, along[1], dist[along[0]] + along[2])
            if (dist >= was - s.eps).all():
                return

    relax()
    sent = np.full(s.n, np.inf)  # the distances that vertices sent light with
    light = [np.zeros(0, int), *(np.zeros(0) for _ in range(5)), np.zeros(0, int)]
    while True:
        again = np.isfinite(dist) & (dist < sent - s.eps) & s.bends
        again[source] = sent[source] > 0
        if again.any():
            sent[again] = dist[again]
            h = np.flatnonzero(again[s.apex])  # the edges opposite to them
            at, other = s.across(h)
            h = h[at]
            flip = s.start[other] != s.start[h]
            x = np.where(flip, s.length[h] - s.cx[h], s.cx[h])
            new = (other, np.zeros(len(h)), s.length[other], x, -s.cy[h], dist[s.apex[h]], s.apex[h])
            light = [np.concatenate(z) for z in zip(light, new, strict=True)]
        h, t0, t1, x, y, sigma, root = light
        far0, far1 = np.hypot(x - t0, y), np.hypot(x - t1, y)
        alive = (sigma <= sent[root] + s.eps) & (y < 0) & (t1 - t0 > 1e-12 * s.length[h])
        alive &= (dist[s.start[h]] + t1 >= sigma + far1 - s.eps) & (dist[s.end[h]] + s.length[h] - t0 >= sigma + far0 - s.eps)
        if not alive.any():
            return dist
        h, t0, t1, x, y, sigma, root = (z[alive] for z in (h, t0, t1, x, y, sigma, root))
        cx, cy, long = s.cx[h], s.cy[h], s.length[h]
        meet = x + (cx - x) * -y / np.maximum(cy - y, 1e-300)  # where the apex is seen through the edge
        seen = (meet >= t0 - 1e-9 * long) & (meet <= t1 + 1e-9 * long)
        np.minimum.at(dist, s.apex[h[seen]], sigma[seen] + np.hypot(cx - x, cy - y)[seen])
        relax()
        light = [np.concatenate(z) for z in zip(*(_carried(s, side, h, t0, t1, x, y, sigma, root, meet) for side in (0, 1)), strict=True)]


def _carried(s: Surface, side: int, h, t0, t1, x, y, sigma, root, meet) -> list[np.ndarray]:
    """Windows on the edge from the apex to the start (side 0) or the end (side 1) of half-edges ``h``, in the frames of the faces beyond."""
    lo, hi = (t0, np.minimum(t1, meet)) if side == 0 else (np.maximum(t0, meet), t1)
    some = hi > lo
    h, lo, hi, x, y, sigma, root = (z[some] for z in (h, lo, hi, x, y, sigma, root))
    c, out = h % 3, h - h % 3 + (h % 3 + (2 if side == 0 else 1)) % 3
    corner = np.zeros(len(h)) if side == 0 else s.length[h]
    ax, ay = s.cx[h] - corner, s.cy[h]  # from the corner to the apex
    sx, size = x - corner, np.hypot(s.cx[h] - corner, s.cy[h])
    place = []
    for t in (lo, hi):
        # the ray from (sx, y) through (t - corner, 0) meets the line along (ax, ay)
        dx = t - corner - sx
        cross = dx * ay + y * ax
        step = (y * ax - sx * ay) / np.where(np.abs(cross) > 1e-300, cross, np.inf)
        place.append(np.clip(((sx + step * dx) * ax + (y - step * y) * ay) / size, 0, size))
    # rays through the corner itself, and the one through the apex
    near = np.abs(lo - corner) < 1e-15 if side == 0 else np.abs(hi - corner) < 1e-15
    if side == 0:
        place[0] = np.where(near, 0.0, place[0])
    else:
        place[1] = np.where(near, 0.0, place[1])
    u0, u1 = np.minimum(*place), np.maximum(*place)
    px, py = (sx * ax + y * ay) / size, -np.abs(sx * ay - y * ax) / size
    at, other = s.across(out)
    u0, u1, px, py, size, sigma, root, h = (z[at] for z in (u0, u1, px, py, size, sigma, root, h))
    flip = s.start[other] != (s.start[h] if side == 0 else s.end[h])
    return [other, np.where(flip, size - u1, u0), np.where(flip, size - u0, u1), np.where(flip, size - px, px), py, sigma, root]
