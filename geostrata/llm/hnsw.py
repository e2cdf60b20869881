"""Hierarchical navigable small-world graph over unit vectors in one task, in array operations.

Points are inserted in growing batches: a batch is searched in the graph of the points before it and compared with
itself, so all points of a batch go through the levels side by side.
"""

from __future__ import annotations

import numpy as np

LINKS = 16
BUILD_BEAM = 64
BATCH = 1024
CELLS = 16_000_000  # of the visited table


class Graph:
    """``x``: unit vectors; ``levels``: top level by point; ``near[level]``: neighbours by point, -1 where none."""

    def __init__(self, x: np.ndarray, levels: np.ndarray | None = None, near: list[np.ndarray] | None = None):
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        if levels is None:
            u = np.random.default_rng(n).random(n)
            levels = np.floor(-np.log(1 - u) / np.log(LINKS)).astype(np.int64)
        self.levels = levels
        self.entry = int(np.argmax(levels)) if n else -1
        self.near = near if near is not None else self._build()

    def _build(self) -> list[np.ndarray]:
        n = len(self.x)
        self.near = [np.full((n, LINKS * (1 if level else 2)), -1, np.int32) for level in range(int(self.levels.max(initial=0)) + 1)]
        order = np.argsort(-self.levels, kind="stable")  # upper levels are complete before lower ones fill up
        at, size = 0, 32
        while at < n:
            batch = order[at:at + size]
            self._insert(batch, order[:at])
            at, size = at + len(batch), min(BATCH, size * 2)
        return self.near

    def _insert(self, batch: np.ndarray, before: np.ndarray) -> None:
        q = self.x[batch]
        start = np.full(len(batch), self.entry)
        inner = q @ q.T
        np.fill_diagonal(inner, -np.inf)
        for level in range(len(self.near) - 1, -1, -1):
            here = self.levels[batch] >= level
            if len(before):
                ids, sims = self.beam(q, start, level, BUILD_BEAM if here.any() else 1)
                start = ids[:, 0]
            if not here.any():
                continue
            mine, own = batch[here], inner[np.ix_(here, here)]
            width = min(len(mine), BUILD_BEAM)
            best = np.argpartition(-own, width - 1, 1)[:, :width]
            near_ids, near_sims = mine[best], np.take_along_axis(own, best, 1)
            near_ids = np.where(np.isfinite(near_sims), near_ids, -1)
            if len(before):
                ok = (ids[here] >= 0) & (self.levels[np.maximum(ids[here], 0)] >= level)
                near_ids = np.concatenate([np.where(ok, ids[here], -1), near_ids], 1)
                near_sims = np.concatenate([np.where(ok, sims[here], -np.inf), near_sims], 1)
            chosen = self._diverse(near_ids, near_sims, LINKS)
            self.near[level][mine, : chosen.shape[1]] = chosen
            self._link_back(mine, chosen, level)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, near ones first, those nearer to the row's point than to any chosen before."""
        width = min(ids.shape[1], 2 * BUILD_BEAM)
        order = np.argsort(-sims, 1, kind="stable")[:, :width]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        out = np.full((len(ids), most), -1, np.int32)
        for a in range(0, len(ids), 256):
            part, s = ids[a:a + 256], sims[a:a + 256]
            v = self.x[np.maximum(part, 0)]
            between = v @ v.transpose(0, 2, 1)
            closest = np.full(part.shape, -np.inf, np.float32)  # similarity to the chosen ones
            count = np.zeros(len(part), np.int64)
            rows = np.arange(len(part))
            spare = np.zeros(part.shape, bool)
            for j in range(width):
                real = (part[:, j] >= 0) & (count < most)
                take = real & (s[:, j] > closest[:, j])
                spare[:, j] = real & ~take
                out[a + rows[take], count[take]] = part[take, j]
                count[take] += 1
                closest[take] = np.maximum(closest[take], between[take, j])
            for j in range(width):  # room left: the nearest of the others
                fill = spare[:, j] & (count < most)
                out[a + rows[fill], count[fill]] = part[fill, j]
                count[fill] += 1
        return out

    def _link_back(self, points: np.ndarray, chosen: np.ndarray, level: int) -> None:
        row, col = np.nonzero(chosen >= 0)
        target, source = chosen[row, col], points[row]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        whose, first, count = np.unique(target, return_index=True, return_counts=True)
        table = self.near[level]
        more = np.full((len(whose), int(count.max(initial=0))), -1, np.int64)
        more[np.repeat(np.arange(len(whose)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        for a in range(0, len(whose), 512):
            w = whose[a:a + 512]
            ids = np.concatenate([table[w], more[a:a + 512]], 1)
            ids.sort(1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            ids[ids == w[:, None]] = -1
            sims = np.einsum("acd,ad->ac", self.x[np.maximum(ids, 0)], self.x[w])
            sims[ids < 0] = -np.inf
            keep = min(ids.shape[1], 2 * BUILD_BEAM)
            top = np.argsort(-sims, 1, kind="stable")[:, :keep]
            ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
            full = (ids >= 0).sum(1) > table.shape[1]
            new = np.full((len(w), table.shape[1]), -1, np.int32)
            width = min(keep, table.shape[1])
            new[:, :width] = ids[:, :width]
            if full.any():
                new[full] = self._diverse(ids[full], sims[full], table.shape[1])
            table[w] = new

    def beam(self, q: np.ndarray, start: np.ndarray, level: int, width: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Best ``width`` points of a level reached from ``start`` for each query, and their similarities."""
        out_ids, out_sims = np.full((len(q), width), -1, np.int64), np.full((len(q), width), -np.inf, np.float32)
        step = max(1, CELLS // max(1, len(self.x)))
        for a in range(0, len(q), step):
            out_ids[a:a + step], out_sims[a:a + step] = self._beam(q[a:a + step], start[a:a + step], level, width, wide)
        return out_ids, out_sims

    def _beam(self, q, start, level, width, wide):
        b = len(q)
        seen = np.zeros((b, len(self.x)), bool)
        seen[np.arange(b), start] = True
        ids, sims = np.full((b, width), -1, np.int64), np.full((b, width), -np.inf, np.float32)
        ids[:, 0], sims[:, 0] = start, np.einsum("bd,bd->b", q, self.x[start])
        done = np.ones((b, width), bool)
        done[:, 0] = False
        wide = min(wide, width)
        alive = np.arange(b)
        while len(alive):
            open_ = np.where(done[alive], -np.inf, sims[alive])
            pick = np.argpartition(-open_, wide - 1, 1)[:, :wide] if wide < width else np.tile(np.arange(width), (len(alive), 1))
            real = np.take_along_axis(open_, pick, 1) > -np.inf
            going = real.any(1)
            alive, pick, real = alive[going], pick[going], real[going]
            if not len(alive):
                break
            done[alive[:, None], pick] |= real
            frm = np.where(real, ids[alive[:, None], pick], -1)
            nb = self.near[level][np.maximum(frm, 0)]
            nb = np.where(frm[:, :, None] >= 0, nb, -1).reshape(len(alive), -1)
            nb = np.sort(nb, 1)
            nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = -1
            new = (nb >= 0) & ~seen[alive[:, None], np.maximum(nb, 0)]
            r, c = np.nonzero(new)
            seen[alive[r], nb[r, c]] = True
            found = np.full(nb.shape, -np.inf, np.float32)
            found[r, c] = np.einsum("kd,kd->k", self.x[nb[r, c]], q[alive[r]])
            all_ids = np.concatenate([ids[alive], np.where(new, nb, -1)], 1)
            all_sims = np.concatenate([sims[alive], found], 1)
            all_done = np.concatenate([done[alive], ~new], 1)
            top = np.argpartition(-all_sims, width - 1, 1)[:, :width]
            ids[alive], sims[alive], done[alive] = (np.take_along_axis(z, top, 1) for z in (all_ids, all_sims, all_done))
        order = np.argsort(-sims, 1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Down the levels with one path each, then a beam on the lowest."""
        start = np.full(len(q), self.entry)
        for level in range(len(self.near) - 1, 0, -1):
            start = self.beam(q, start, level, 1)[0][:, 0]
        return self.beam(q, start, 0, min(width, len(self.x)))
