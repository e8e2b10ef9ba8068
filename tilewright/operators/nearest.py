"""Kernels for many points and many segments, in numpy: the nearest segment, and the segments that a ray crosses.

Segments lie in a tree: in Morton order, FAN of them make a node, FAN nodes one of the next level. A node is
told by a chord, the diagonal of its box that its segments keep closer to, and by how far they leave it. What a
node's segments are away at least is the chord's distance less that, and less a bound on how far distances on
the local plane do not add up. So a point goes down only into nodes that can hold its nearest segment, also where
thousands lie in a line at almost one distance; nothing near is left out.
"""

from __future__ import annotations

import numpy as np

KM_NORTH, KM_EAST = 110.9, 111.32
#: In a flat plane a degree east has at least the length that it has here: at a pole it has none, and an offset no end.
MOST_LAT = 89.0
FAN, POINTS, PAIRS = 8, 4096, 1_000_000


def _spread(v: np.ndarray) -> np.ndarray:
    """The bits of numbers under 2^20, each with a free bit before it."""
    v = v.astype(np.int64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | v << shift) & mask
    return v


def _off(x, y, a_x, a_y, b_x, b_y) -> np.ndarray:
    """Kilometres from points to segments where a degree east has its greatest length."""
    px, py, dx, dy = (x - a_x) * KM_EAST, (y - a_y) * KM_NORTH, (b_x - a_x) * KM_EAST, (b_y - a_y) * KM_NORTH
    n = dx * dx + dy * dy
    t = np.clip((px * dx + py * dy) / np.where(n == 0, 1.0, n), 0.0, 1.0)
    return np.hypot(px - t * dx, py - t * dy)


class Tree:
    """Segments (rows a_lon, a_lat, b_lon, b_lat). flat: a point's plane has the east scale of its own latitude; else it is that of the middle between it and a segment's start, as lines.segment_distance has it."""

    def __init__(self, segs: np.ndarray, flat: bool = False):
        mid = np.stack([segs[0] + segs[2], segs[1] + segs[3]]) / 2
        low = mid.min(1, keepdims=True, initial=np.inf)
        span = (mid - low).max(initial=0.0)  # one scale for both axes: nodes are about square, however long and thin a line is
        at = ((mid - low) / (span or 1.0) * ((1 << 20) - 1)).astype(np.int64)
        self.order = np.argsort(_spread(at[0]) | _spread(at[1]) << 1, kind="stable")
        self.segs, self.flat = np.ascontiguousarray(segs[:, self.order]), flat
        self.place = np.argsort(self.order)  # of each segment as given, where it is kept
        a_x, a_y, b_x, b_y = self.segs
        box = np.stack([np.minimum(a_x, b_x), np.minimum(a_y, b_y), -np.maximum(a_x, b_x), -np.maximum(a_y, b_y)])
        self.levels, size, n = [], 1, len(a_x)
        while box.shape[1] > FAN:
            size *= FAN
            box = np.minimum.reduceat(box, np.arange(0, box.shape[1], FAN), axis=1)
            w, s, e, north = box[0], box[1], -box[2], -box[3]
            first, count = np.arange(0, n, size), np.diff(np.r_[np.arange(0, n, size), n])
            leave = []
            for c_y, d_y in ((s, north), (north, s)):
                chord = [np.repeat(c, count) for c in (w, c_y, e, d_y)]
                leave.append(np.maximum.reduceat(np.maximum(_off(a_x, a_y, *chord), _off(b_x, b_y, *chord)), first))
            up = leave[0] <= leave[1]
            chords = np.stack([w, np.where(up, s, north), e, np.where(up, north, s)])
            self.levels.append((chords, np.minimum(*leave), w, s, e, north, np.minimum(first + size // 2, n - 1)))

    def _away(self, lon, lat, seg) -> np.ndarray:
        a_lon, a_lat, b_lon, b_lat = seg
        first = KM_EAST * np.cos(np.radians(np.minimum(np.abs(lat), MOST_LAT) if self.flat else (lat + a_lat) / 2))
        second = first if self.flat else KM_EAST * np.cos(np.radians((b_lat + a_lat) / 2))
        px, py, dx, dy = (lon - a_lon) * first, (lat - a_lat) * KM_NORTH, (b_lon - a_lon) * second, (b_lat - a_lat) * KM_NORTH
        n = dx * dx + dy * dy
        t = np.where(n == 0, 0.0, np.clip((px * dx + py * dy) / np.where(n == 0, 1.0, n), 0.0, 1.0))
        return np.sqrt((px - t * dx) ** 2 + (py - t * dy) ** 2)

    def nearest(self, lon: np.ndarray, lat: np.ndarray, clamp_km: float, enough: float = -1.0) -> tuple[np.ndarray, np.ndarray]:
        """Of each point the distance to its nearest segment, at most the clamp, and that segment (-1: none is nearer than it).

        Where a segment is nearer than enough, no nearer one is looked for.
        """
        km, which = np.full(len(lon), clamp_km), np.full(len(lon), -1)
        # points that lie together go down together
        todo = [np.arange(a, min(a + POINTS, len(lon))) for a in range(0, len(lon), POINTS)] if self.segs.shape[1] else []
        while todo:
            of = todo.pop()
            found = self._down(lon[of], lat[of], clamp_km, enough, len(of) == 1)
            if found is None:
                todo += [of[: len(of) // 2], of[len(of) // 2 :]]
            else:
                km[of], which[of] = found
        near = which >= 0
        which[near] = self.order[which[near]]
        return km, which

    def _down(self, lon, lat, clamp_km, enough, alone):
        """The walk of some points; None if it meets too many pairs and they can be parted."""
        top = len(self.levels)
        nodes = len(self.levels[-1][1]) if top else self.segs.shape[1]
        p, k = np.repeat(np.arange(len(lon)), nodes), np.tile(np.arange(nodes), len(lon))
        least = np.full(len(lon), clamp_km)
        for level in range(top - 1, -1, -1):
            chords, leave, w, s, e, n, middle = self.levels[level]
            x, y = lon[p], lat[p]
            np.minimum.at(least, p, self._away(x, y, self.segs[:, middle[k]]))
            if enough > 0:
                open_ = least[p] >= enough
                p, k, x, y = p[open_], k[open_], x[open_], y[open_]
            wk, sk, ek, nk = w[k], s[k], e[k], n[k]
            slack = leave[k] + 1e-9
            if not self.flat:
                far_x, far_y = np.maximum(np.abs(x - wk), np.abs(x - ek)), np.maximum(np.abs(y - sk), np.abs(y - nk))
                slack += KM_EAST * (far_x * np.radians(nk - sk) + (ek - wk) * np.radians(far_y + nk - sk))
            keep = self._away(x, y, chords[:, k]) - slack <= least[p]
            p, k = p[keep], k[keep]
            below = len(self.levels[level - 1][1]) if level else self.segs.shape[1]
            if len(p) * FAN > PAIRS and not alone:
                return None
            p, k = np.repeat(p, FAN), (k[:, None] * FAN + np.arange(FAN)).ravel()
            p, k = p[k < below], k[k < below]
        which = np.full(len(lon), -1)
        if len(p):
            km = self._away(lon[p], lat[p], self.segs[:, k])
            np.minimum.at(least, p, km)
            hit = np.flatnonzero((km == least[p]) & (km < clamp_km))
            which[p[hit][::-1]] = k[hit][::-1]
        return least, which


def crossed(lon: np.ndarray, lat: np.ndarray, segs: np.ndarray) -> np.ndarray:
    """How many segments a ray eastwards from each point crosses (half-open at vertices).

    Segments are kept by powers of two of their height; of each class a point meets those that begin within
    that height south of it, so at most about twice as many as lie at its latitude.
    """
    a_lon, a_lat, b_lon, b_lat = segs
    out = np.zeros(len(lon), np.int64)
    low, tall = np.minimum(a_lat, b_lat), np.abs(b_lat - a_lat)
    use = np.flatnonzero(tall > 0)
    classes = np.frexp(tall[use])[1]
    for c in np.unique(classes):
        mine = use[classes == c]
        mine = mine[np.argsort(low[mine], kind="stable")]
        begins, height = low[mine], float(2.0**c)
        first, last = np.searchsorted(begins, lat - height, "left"), np.searchsorted(begins, lat, "right")
        count = np.maximum(last - first, 0)
        ends = np.cumsum(count)
        a = 0
        while a < len(lon):
            z = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")), a + 1)
            n = count[a:z]
            p = np.repeat(np.arange(a, z), n)
            s = mine[np.repeat(first[a:z] - (np.cumsum(n) - n), n) + np.arange(len(p))]
            y = lat[p]
            on = (a_lat[s] <= y) != (b_lat[s] <= y)
            p, s, y = p[on], s[on], y[on]
            east = a_lon[s] + (y - a_lat[s]) / (b_lat[s] - a_lat[s]) * (b_lon[s] - a_lon[s]) > lon[p]
            out[a:z] += np.bincount(p[east] - a, minlength=z - a)
            a = z
    return out
