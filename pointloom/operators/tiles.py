"""Search inside tiles: Spark deals tiles with their borders to tasks, numpy searches one tile after the other.

A tile is a cube of ``SIDE`` grid cells an axis; its border is one cell wide.  Rows arrive sorted by tile, those that
ask (the tile's own points) before the rest, and are taken in blocks, so memory follows the tile's own points, not its
surroundings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells of a tile per axis, and with the border.
SIDE, WIDE = 4, 6
#: Rows held at once, and distances computed at once.
BLOCK, DISTANCES = 1 << 16, 1 << 20
_STRIPS = np.array([a * WIDE * WIDE + b * WIDE for a in (-1, 0, 1) for b in (-1, 0, 1)])
PAIR_SUMS = ("xx", "yy", "zz", "xy", "xz", "yz")


def blocks(batches, tile: list[str]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """``(whether a tile begins, rows of one tile)``; a tile of over ``BLOCK`` rows comes in several blocks."""
    held: list[pa.RecordBatch] = []
    last = None

    def parts(rows: list[pa.RecordBatch]):
        nonlocal last
        whole = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        new = np.zeros(whole.num_rows - 1, bool)
        for c in tile:
            column = whole.column(c)
            new |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
        at = [0, *(np.flatnonzero(new) + 1).tolist(), whole.num_rows]
        key = lambda i: tuple(whole.column(c)[i].as_py() for c in tile)
        first = last != key(0)
        last = key(whole.num_rows - 1)
        return whole, at, first

    def flush(rows):
        whole, at, first = parts(rows)
        for i, (a, b) in enumerate(zip(at, at[1:])):
            yield first if i == 0 else True, whole.slice(a, b - a)

    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(at, BLOCK)
            held.append(piece)
            size += piece.num_rows
            if size >= BLOCK:
                yield from flush(held)
                held, size = [], 0
    if size:
        yield from flush(held)


def tiles(batches, tile: list[str], ask: str) -> Iterator[Iterator[pa.RecordBatch]]:
    """The blocks of each tile; the first one holds all rows that ask."""
    pending: list[pa.RecordBatch] = []
    stream = blocks(batches, tile)
    ahead = next(stream, None)
    while ahead is not None:
        def one():
            nonlocal ahead
            pending[:] = [ahead[1]]
            ahead = next(stream, None)
            while ahead is not None and not ahead[0] and pending[-1].column(ask)[-1].as_py():
                pending.append(ahead[1])
                ahead = next(stream, None)
            yield pa.Table.from_batches(pending).combine_chunks().to_batches()[0] if len(pending) > 1 else pending[0]
            while ahead is not None and not ahead[0]:
                block = ahead[1]
                ahead = next(stream, None)
                yield block

        yield one()


def smallest(d2: np.ndarray, want: int) -> np.ndarray:
    """Columns of the ``want`` smallest values of each row in order; equal values keep the order of their columns."""
    if d2.shape[1] <= want:
        return np.argsort(d2, axis=1, kind="stable")
    picked = np.argpartition(d2, want - 1, axis=1)[:, :want]
    last = np.take_along_axis(d2, picked[:, -1:], axis=1)
    # Where values equal to the last one are left out, the choice among them is made by a full sort.
    tied = np.flatnonzero(np.count_nonzero(d2 <= last, axis=1) > want)
    picked.sort(axis=1)
    order = np.argsort(np.take_along_axis(d2, picked, axis=1), axis=1, kind="stable")
    picked = np.take_along_axis(picked, order, axis=1)
    if len(tied):
        picked[tied] = np.argsort(d2[tied], axis=1, kind="stable")[:, :want]
    return picked


class Nearest:
    """The ``want`` nearest candidates of each asking point, with ties by id, over any number of blocks."""

    def __init__(self, xyz: np.ndarray, cells: np.ndarray, want: int):
        self.xyz, self.want = xyz, want
        order = np.argsort(cells, kind="stable")
        edge = np.flatnonzero(np.diff(cells[order])) + 1
        self.groups = [(int(cells[g[0]]), g) for g in np.split(order, edge)]
        self.d2 = np.full((len(xyz), want), np.inf)
        self.ids = np.full((len(xyz), want), np.iinfo(np.int64).max)
        self.at = np.full((len(xyz), want, 3), np.nan)
        self.pairs = 0
        self._begun = False

    def add(self, xyz: np.ndarray, ids: np.ndarray, cells: np.ndarray) -> None:
        """Offer candidates; each meets the asking points of its own and the adjacent cells."""
        order = np.lexsort((ids, cells))
        xyz, ids, cells = xyz[order], ids[order], cells[order]
        for cell, members in self.groups:
            strips = cell + _STRIPS
            lows, highs = np.searchsorted(cells, strips - 1, "left"), np.searchsorted(cells, strips + 1, "right")
            near = np.concatenate([np.arange(a, b) for a, b in zip(lows.tolist(), highs.tolist())])
            if not len(near):
                continue
            near = near[np.argsort(ids[near], kind="stable")]
            step = max(1, DISTANCES // len(near))
            for s in range(0, len(members), step):
                self._meet(members[s : s + step], xyz[near], ids[near])
        self._begun = True

    def _meet(self, who: np.ndarray, xyz: np.ndarray, ids: np.ndarray) -> None:
        self.pairs += len(who) * len(ids)
        own = self.xyz[who]
        d2 = None
        for axis in range(3):
            gap = xyz[None, :, axis] - own[:, axis, None]
            d2 = gap * gap if d2 is None else d2 + gap * gap
        pick = smallest(d2, self.want)
        d2, found, at = np.take_along_axis(d2, pick, axis=1), ids[pick], xyz[pick]
        if self._begun:
            d2, found, at = (np.concatenate([old[who], new], axis=1) for old, new in ((self.d2, d2), (self.ids, found), (self.at, at)))
            pick = np.lexsort((found, d2), axis=1)[:, : self.want]
            d2, found = np.take_along_axis(d2, pick, axis=1), np.take_along_axis(found, pick, axis=1)
            at = np.take_along_axis(at, pick[:, :, None], axis=1)
        have = d2.shape[1]
        self.d2[who, :have], self.ids[who, :have], self.at[who, :have] = d2, found, at


#: Pairs of a cell's asking points and its candidates from which boxes are settled by bounds first.
PAIRS = 1 << 16


class Within:
    """Weight of the candidates within ``r`` of each asking point, over any number of blocks.

    Where a cell has many pairs, asking points and candidates are grouped in boxes of a quarter of the radius: a box whose farthest
    corner is near enough for all points of the other counts whole, one whose nearest is too far drops, and only the
    rest are compared point by point.
    """

    def __init__(self, xyz: np.ndarray, cells: np.ndarray, r: float, strict: bool):
        self.xyz, self.r2, self.strict, self.box = xyz, r * r, strict, r / 4
        order = np.argsort(cells, kind="stable")
        self.groups = [(int(cells[g[0]]), g) for g in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1)]
        self.weight = np.zeros(len(xyz), np.int64)
        self.pairs = 0

    def add(self, xyz: np.ndarray, weight: np.ndarray, cells: np.ndarray) -> None:
        order = np.argsort(cells, kind="stable")
        xyz, weight, cells = xyz[order], weight[order], cells[order]
        for cell, members in self.groups:
            strips = cell + _STRIPS
            lows, highs = np.searchsorted(cells, strips - 1, "left"), np.searchsorted(cells, strips + 1, "right")
            near = np.concatenate([np.arange(a, b) for a, b in zip(lows.tolist(), highs.tolist())])
            if len(near) * len(members) > PAIRS:
                self._bounded(members, xyz[near], weight[near])
            elif len(near):
                self._meet(members, xyz[near], weight[near])

    def _meet(self, who: np.ndarray, xyz: np.ndarray, weight: np.ndarray) -> None:
        step = max(1, DISTANCES // len(xyz))
        for s in range(0, len(who), step):
            own = self.xyz[who[s : s + step]]
            self.pairs += len(own) * len(xyz)
            d2 = None
            for axis in range(3):
                gap = own[:, axis, None] - xyz[None, :, axis]
                d2 = gap * gap if d2 is None else d2 + gap * gap
            hit = d2 < self.r2 if self.strict else d2 <= self.r2
            self.weight[who[s : s + step]] += hit @ weight

    def _boxes(self, xyz: np.ndarray):
        """Rows by box, where each box starts, and its corners."""
        _, box = np.unique(np.floor(xyz / self.box).astype(np.int64), axis=0, return_inverse=True)
        order = np.argsort(box.ravel(), kind="stable")
        start = np.concatenate([[0], np.flatnonzero(np.diff(box.ravel()[order])) + 1])
        return order, start, np.minimum.reduceat(xyz[order], start), np.maximum.reduceat(xyz[order], start)

    def _bounded(self, members: np.ndarray, xyz: np.ndarray, weight: np.ndarray) -> None:
        order, start, low, high = self._boxes(xyz)
        xyz, weight = xyz[order], weight[order]
        total, stop = np.add.reduceat(weight, start), np.concatenate([start[1:], [len(xyz)]])
        own, begin, own_low, own_high = self._boxes(self.xyz[members])
        for a, b, lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(members)], own_low, own_high):
            who = members[own[a:b]]
            far = np.maximum(hi - low, high - lo)
            gap = np.maximum(0, np.maximum(low - hi, lo - high))
            inside = (far * far).sum(axis=1) <= self.r2 * (1 - 1e-9)
            open_ = np.flatnonzero(~inside & ((gap * gap).sum(axis=1) <= self.r2 * (1 + 1e-9)))
            self.weight[who] += total[inside].sum()
            if len(open_):
                rows = np.concatenate([np.arange(x, y) for x, y in zip(start[open_].tolist(), stop[open_].tolist())])
                self._meet(who, xyz[rows], weight[rows])


def within_in_tiles(scene: str, tile: list[str], r: float, strict: bool) -> Callable:
    """Task function: rows ``scene, x, y, z, _rel, _ask, _w`` sorted by tile, asking ones (no weight) first; gives ``_found`` of each asking point."""

    def run(batches):
        for parts in tiles(batches, tile, "_ask"):
            found = None
            for block in parts:
                xyz = np.column_stack([block.column(a).to_numpy() for a in "xyz"])
                cells, weight = block.column("_rel").to_numpy(), block.column("_w").to_numpy()
                if found is None:
                    asking = np.flatnonzero(block.column("_ask").to_numpy(zero_copy_only=False))
                    found = False
                    if len(asking):
                        head, found = block.take(pa.array(asking)), Within(xyz[asking], cells[asking], r, strict)
                        rest = np.setdiff1d(np.arange(len(cells)), asking, assume_unique=True)
                        xyz, cells, weight = xyz[rest], cells[rest], weight[rest]
                if found and len(cells):
                    found.add(xyz, weight, cells)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [head.column(scene), *[head.column(a) for a in "xyz"], pa.array(found.weight)], names=[scene, "x", "y", "z", "_found"])

    return run


def list_columns(found: Nearest, own: np.ndarray, rows: np.ndarray, k: int) -> dict[str, pa.Array]:
    """Packed neighbour lists: ids, squared distances and coordinates of each of ``rows``."""
    count = len(rows)
    offsets = pa.array(np.arange(count + 1, dtype=np.int32) * k)
    packed = lambda v: pa.ListArray.from_arrays(offsets, pa.array(v[rows, :k].ravel()))
    return {"ids": packed(found.ids), "d2s": packed(found.d2), **{f"n{a}": packed(found.at[:, :, i]) for i, a in enumerate("xyz")}}


def sum_columns(drop_self: bool) -> Callable:
    """Number, last and summed squared distance and sum of ids of the neighbours; with ``drop_self`` as in :func:`moment_columns`."""

    def columns(found: Nearest, own: np.ndarray, rows: np.ndarray, k: int) -> dict[str, pa.Array]:
        ids, d2 = found.ids[rows, :k], found.d2[rows, :k]
        if drop_self:
            order = np.argsort(ids == own[rows, None], axis=1, kind="stable")[:, : k - 1]
            ids, d2 = np.take_along_axis(ids, order, axis=1), np.take_along_axis(d2, order, axis=1)
        have = ids.shape[1]
        last = d2[:, -1] if have else np.full(len(rows), np.nan)
        return {"n": pa.array(np.full(len(rows), have, np.int64)), "d2_last": pa.array(last), "d2_sum": pa.array(d2.sum(axis=1)), "ids": pa.array(ids.sum(axis=1))}

    return columns


def moment_columns(small: int, drop_self: bool) -> Callable:
    """Sums over the first ``small`` (``s_``) and over all (``b_``) neighbours relative to the point, and the ids of the first.

    With ``drop_self`` the point is no neighbour of its own; of lists that do not hold it the last entry goes.
    """

    def columns(found: Nearest, own: np.ndarray, rows: np.ndarray, k: int) -> dict[str, pa.Array]:
        ids, at = found.ids[rows, :k], found.at[rows, :k]
        if drop_self:
            order = np.argsort(ids == own[rows, None], axis=1, kind="stable")[:, : k - 1]
            ids, at = np.take_along_axis(ids, order, axis=1), np.take_along_axis(at, order[:, :, None], axis=1)
        first = min(small, ids.shape[1])
        rel = at - found.xyz[rows, None, :]
        out = {"ids": pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * first), pa.array(ids[:, :first].ravel()))}
        for prefix, part in (("s_", rel[:, :first]), ("b_", rel)):
            out[f"{prefix}n"] = pa.array(np.full(len(rows), part.shape[1], np.int64))
            for i, a in enumerate("xyz"):
                out[f"{prefix}s{a}"] = pa.array(part[:, :, i].sum(axis=1))
            for pair in PAIR_SUMS:
                a, b = ("xyz".index(c) for c in pair)
                out[f"{prefix}s{pair}"] = pa.array(np.einsum("ij,ij->i", part[:, :, a], part[:, :, b]))
        heights = at[:, :first, 1]
        empty = np.full(len(rows), np.nan)
        out["hi"] = pa.array(heights.max(axis=1) if first else empty)
        out["lo"] = pa.array(heights.min(axis=1) if first else empty)
        return out

    return columns


SUM_SCHEMA = "n long, d2_last double, d2_sum double, ids long"
LIST_SCHEMA = "ids array<long>, d2s array<double>, nx array<double>, ny array<double>, nz array<double>"
MOMENT_SCHEMA = "ids array<long>, " + ", ".join(
    f"{p}n long, " + ", ".join(f"{p}s{c} double" for c in ("x", "y", "z", *PAIR_SUMS)) for p in ("s_", "b_")) + ", hi double, lo double"


def nearest_in_tiles(scene: str, key: str, tile: list[str], columns: Callable) -> Callable:
    """Task function: rows ``scene, key, x, y, z, _rel`` (cell in the tile), ``_ask, _k, _reach`` sorted by tile, asking ones first.

    Gives ``settled`` and ``columns`` of each asking point: settled are those whose last neighbour lies within ``_reach``, beyond
    which the border does not cover; of the others only the keys come back.
    """

    def run(batches):
        for parts in tiles(batches, tile, "_ask"):
            found = None
            for block in parts:
                xyz = np.column_stack([block.column(a).to_numpy() for a in "xyz"])
                ids, cells = block.column(key).to_numpy().astype(np.int64), block.column("_rel").to_numpy()
                if found is None:
                    asking = np.flatnonzero(block.column("_ask").to_numpy(zero_copy_only=False))
                    if not len(asking):
                        found = False
                    else:
                        k, reach = block.column("_k")[0].as_py(), block.column("_reach")[0].as_py()
                        head, own = block.take(pa.array(asking)), ids[asking]
                        found = Nearest(xyz[asking], cells[asking], k)
                if found:
                    found.add(xyz, ids, cells)
            if not found:
                continue
            settled = found.d2[:, k - 1] <= reach
            for flag, rows in ((True, np.flatnonzero(settled)), (False, np.flatnonzero(~settled))):
                if not len(rows):
                    continue
                own_rows = head.take(pa.array(rows))
                made = columns(found, own, rows, k)
                if not flag:
                    made = {name: pa.nulls(len(rows), a.type) for name, a in made.items()}
                named = {c: own_rows.column(c) for c in (scene, key, "x", "y", "z")} | {"settled": pa.array(np.full(len(rows), flag))} | made
                yield pa.RecordBatch.from_arrays(list(named.values()), names=list(named))

    return run
