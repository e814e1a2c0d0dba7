"""Search inside whole scenes: Spark deals scenes of up to ``WHOLE`` rows to tasks, numpy searches one after the other.

A small scene needs no grid, no border and no second look: its points lie in leaves, halved along their widest axis, and the
boxes of the leaves tell which of them can matter.  Larger scenes go tile by tile (:mod:`~pointloom.operators.tiles`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.graph import merged
from .tiles import DISTANCES, blocks, smallest

#: Rows up to which a task holds a scene; rows of a task at least, and on average at most.
WHOLE, FEWEST, DEALT = 1 << 14, 1 << 15, 1 << 17
#: Points of a leaf.
LEAF = 48


def wholes(batches, by: list[str]) -> Iterator[pa.RecordBatch]:
    """All rows of one group after the other; rows arrive sorted by group."""
    pending: list[pa.RecordBatch] = []
    joined = lambda: pa.Table.from_batches(pending).combine_chunks().to_batches()[0] if len(pending) > 1 else pending[0]
    for first, block in blocks(batches, by):
        if first and pending:
            yield joined()
            pending = []
        pending.append(block)
    if pending:
        yield joined()


def coordinates(rows: pa.RecordBatch, dims) -> np.ndarray:
    """Coordinates as doubles, zero on missing axes; nulls are NaN."""
    at = np.zeros((rows.num_rows, 3))
    for i, d in enumerate(dims):
        at[:, i] = pc.cast(rows.column(d), pa.float64()).to_numpy(zero_copy_only=False)
    return at


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distance of every row of ``a`` to every row of ``b``."""
    total = None
    for axis in range(3):
        gap = b[None, :, axis] - a[:, axis, None]
        total = gap * gap if total is None else total + gap * gap
    return total


class Leaves:
    """Points in leaves of up to ``LEAF``, with the corners of the leaves' boxes."""

    def __init__(self, xyz: np.ndarray):
        self.xyz, self.members = xyz, []
        parts = [np.arange(len(xyz))] if len(xyz) else []
        while parts:
            part = parts.pop()
            if len(part) <= LEAF:
                self.members.append(part)
                continue
            own = xyz[part]
            along = own[:, np.argmax(own.max(axis=0) - own.min(axis=0))]
            order = np.argpartition(along, len(part) // 2)
            parts += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
        self.low = np.array([xyz[m].min(axis=0) for m in self.members]).reshape(-1, 3)
        self.high = np.array([xyz[m].max(axis=0) for m in self.members]).reshape(-1, 3)

    def gap(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Squared distance of each leaf's box from a box.

        Subtraction, product and sum round monotonically, so it never exceeds the computed distance of two points of the boxes.
        """
        g = np.maximum(np.maximum(self.low - high, low - self.high), 0.0)
        return g[:, 0] * g[:, 0] + g[:, 1] * g[:, 1] + g[:, 2] * g[:, 2]

    def span(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Squared distance of the farthest corners of each leaf's box and a box."""
        g = np.maximum(self.high - low, high - self.low)
        return g[:, 0] * g[:, 0] + g[:, 1] * g[:, 1] + g[:, 2] * g[:, 2]


def _first_copies(xyz: np.ndarray, most: int) -> np.ndarray:
    """Whether a point is among the first ``most`` of its location."""
    order = np.lexsort((xyz[:, 2], xyz[:, 1], xyz[:, 0]))
    new = np.ones(len(xyz), bool)
    new[1:] = (xyz[order[1:]] != xyz[order[:-1]]).any(axis=1)
    place = np.arange(len(xyz))
    kept = np.empty(len(xyz), bool)
    kept[order] = place - np.maximum.accumulate(np.where(new, place, 0)) < most
    return kept


def nearest(ask: Leaves, given: Leaves, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and rows of the ``k`` nearest given points of every asking point; ties go to the smaller row.

    ``given`` has at least ``k`` points.  The leaves next to a leaf give a bound on its points' last neighbour; only leaves
    within that bound are compared.
    """
    kept = _first_copies(given.xyz, k)
    offered = [m[kept[m]] for m in given.members]
    sizes = np.array([len(m) for m in offered])
    d2, rows = np.empty((len(ask.xyz), k)), np.empty((len(ask.xyz), k), np.int64)
    for who, low, high in zip(ask.members, ask.low, ask.high):
        own, gap = ask.xyz[who], given.gap(low, high)
        order = np.argsort(gap, kind="stable")
        some = order[: np.searchsorted(np.cumsum(sizes[order]), 2 * k) + 1]
        near = np.concatenate([offered[j] for j in some])
        reach = np.partition(squared(own, given.xyz[near]), k - 1, axis=1)[:, k - 1].max()
        near = np.concatenate([offered[j] for j in np.flatnonzero(gap <= reach)])
        at = given.xyz[near]
        off = np.maximum(np.maximum(low - at, at - high), 0.0)
        near = np.sort(near[off[:, 0] * off[:, 0] + off[:, 1] * off[:, 1] + off[:, 2] * off[:, 2] <= reach])
        step = max(1, DISTANCES // len(near))
        for s in range(0, len(who), step):
            all_ = squared(own[s : s + step], given.xyz[near])
            pick = smallest(all_, k)[:, :k]
            d2[who[s : s + step]], rows[who[s : s + step]] = np.take_along_axis(all_, pick, axis=1), near[pick]
    return d2, rows


def counted(ask: Leaves, given: Leaves, weight: np.ndarray, r: float, strict: bool = False) -> np.ndarray:
    """Weight of the given points within ``r`` of every asking point; leaves wholly within count by their sums."""
    r2 = r * r
    totals = np.array([weight[m].sum() for m in given.members], np.int64)
    found = np.zeros(len(ask.xyz), np.int64)
    for who, low, high in zip(ask.members, ask.low, ask.high):
        inside = given.span(low, high) <= r2 * (1 - 1e-9)
        open_ = np.flatnonzero(~inside & (given.gap(low, high) <= r2 * (1 + 1e-9)))
        found[who] = totals[inside].sum()
        if len(open_):
            near = np.concatenate([given.members[j] for j in open_])
            step = max(1, DISTANCES // len(near))
            for s in range(0, len(who), step):
                d2 = squared(ask.xyz[who[s : s + step]], given.xyz[near])
                found[who[s : s + step]] += (d2 < r2 if strict else d2 <= r2) @ weight[near]
    return found


def dense_parts(xyz: np.ndarray, r: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Cluster (-1: none) and whether it is a core point of every point; clusters are numbered by their first core point."""
    leaves, r2 = Leaves(xyz), r * r
    core = counted(leaves, leaves, np.ones(len(xyz), np.int64), r) >= least
    cores = [m[core[m]] for m in leaves.members]
    label = np.arange(len(xyz))
    for i, who in enumerate(cores):
        if not len(who):
            continue
        later = i + np.flatnonzero(leaves.gap(leaves.low[i], leaves.high[i])[i:] <= r2 * (1 + 1e-9))
        near = np.concatenate([cores[j] for j in later])
        # What is one part already needs no distances.
        near = near if (label[who] != label[who[0]]).any() else near[label[near] != label[who[0]]]
        step = max(1, DISTANCES // max(1, len(near)))
        for s in range(0, len(who) if len(near) else 0, step):
            part = who[s : s + step]
            p, q = np.nonzero((squared(xyz[part], xyz[near]) <= r2) & (label[part][:, None] != label[near][None, :]))
            if len(p):
                label = merged(label, label[part][p], label[near][q])
    cluster = np.full(len(xyz), -1, np.int64)
    if core.any():
        cluster[core] = np.unique(label[core], return_inverse=True)[1].ravel()
        for i, m in enumerate(leaves.members):
            who = m[~core[m]]
            if not len(who):
                continue
            near = np.concatenate([cores[j] for j in np.flatnonzero(leaves.gap(leaves.low[i], leaves.high[i]) <= r2 * (1 + 1e-9))])
            step = max(1, DISTANCES // max(1, len(near)))
            for s in range(0, len(who) if len(near) else 0, step):
                part = who[s : s + step]
                reached = np.where(squared(xyz[part], xyz[near]) <= r2, cluster[near][None, :], len(xyz)).min(axis=1)
                cluster[part] = np.where(reached < len(xyz), reached, -1)
    return cluster, core


# ------------------------------------------------------------------ task functions

def _in_order(rows: pa.RecordBatch, key: str) -> pa.RecordBatch:
    return rows.take(pc.sort_indices(rows.column(key)))


def nearest_in_scenes(scene: str, key: str, want: int, columns: Callable, keep: tuple[str, ...] = (), radius: float | None = None) -> Callable:
    """Rows ``scene, key, x, y, z, *keep`` sorted by scene; gives ``columns`` of the ``want`` nearest points of every point.

    With ``radius`` also ``within``, the number of other points in it.
    """

    def run(batches):
        for rows in wholes(batches, [scene]):
            rows = _in_order(rows, key)
            xyz, ids = coordinates(rows, "xyz"), rows.column(key).to_numpy().astype(np.int64)
            k, leaves = min(want, len(ids)), Leaves(xyz)
            d2, near = nearest(leaves, leaves, k)
            made = columns(SimpleNamespace(xyz=xyz, d2=d2, ids=ids[near], at=xyz[near]), ids, np.arange(len(ids)), k)
            named = {scene: rows.column(scene), key: rows.column(key)} | {a: pa.array(xyz[:, i]) for i, a in enumerate("xyz")}
            named |= {c: rows.column(c) for c in keep} | made
            if radius is not None:
                named["within"] = pa.array(counted(leaves, leaves, np.ones(len(ids), np.int64), radius) - 1)
            yield pa.RecordBatch.from_arrays(list(named.values()), names=list(named))

    return run


def spread_in_scenes(scene: str, key: str, value: str) -> Callable:
    """Rows with ``ids``, one scene after the other; gives ``spread``, the population std of ``value`` over the rows that ``ids`` names, in place of it.

    Rows without ids are left out.
    """

    def run(batches):
        for rows in wholes(batches, [scene]):
            rows = rows.filter(pc.greater(pc.list_value_length(rows.column("ids")), 0))
            if not rows.num_rows:
                continue
            own, lists = rows.column(key).to_numpy().astype(np.int64), rows.column("ids")
            order = np.argsort(own, kind="stable")
            at = order[np.searchsorted(own, lists.flatten().to_numpy(), sorter=order)].reshape(len(own), -1)
            spread = rows.column(value).to_numpy(zero_copy_only=False)[at].std(axis=1)
            rest = [c for c in rows.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in rest], pa.array(spread)], names=[*rest, "spread"])

    return run


def counted_in_scenes(scene: str, keep: list[str], dims: list[str], r: float) -> Callable:
    """Rows ``scene, *keep, *dims`` sorted by scene; gives ``scene, *keep, n``, the number of other points within ``r``."""

    def run(batches):
        for rows in wholes(batches, [scene]):
            leaves = Leaves(coordinates(rows, dims))
            n = counted(leaves, leaves, np.ones(rows.num_rows, np.int64), r) - 1
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in (scene, *keep)] + [pa.array(n)], names=[scene, *keep, "n"])

    return run


def weighed_in_scenes(scene: str, r: float, strict: bool) -> Callable:
    """Rows ``scene, x, y, z, _ask, _w`` sorted by scene; gives ``_found``, the weight within ``r`` of each asking location."""

    def run(batches):
        for rows in wholes(batches, [scene]):
            asks = rows.column("_ask").to_numpy(zero_copy_only=False)
            if not asks.any():
                continue
            xyz, weight = coordinates(rows, "xyz"), rows.column("_w").to_numpy()
            found = counted(Leaves(xyz[asks]), Leaves(xyz[~asks]), weight[~asks], r, strict)
            own = rows.filter(pa.array(asks))
            yield pa.RecordBatch.from_arrays([own.column(c) for c in (scene, *"xyz")] + [pa.array(found)], names=[scene, *"xyz", "_found"])

    return run


def near_in_scenes(scene: str, columns: list[str], dims: list[str], r: float, strict: bool, keep: bool) -> Callable:
    """Left (``_ask``) and right rows sorted by scene; gives the left rows with (``keep``) or without a right one within ``r``."""

    def run(batches):
        for rows in wholes(batches, [scene]):
            asks = rows.column("_ask").to_numpy(zero_copy_only=False)
            xyz = coordinates(rows, dims)
            known = ~np.isnan(xyz).any(axis=1)
            left = np.flatnonzero(asks & known)
            chosen = np.zeros(len(asks), bool)
            given = xyz[~asks & known]
            chosen[left] = counted(Leaves(xyz[left]), Leaves(given), np.ones(len(given), np.int64), r, strict) > 0
            yield rows.select(columns).filter(pa.array(asks & (chosen if keep else ~chosen)))

    return run


def matched_in_scenes(scene: str, key: str, left: list[str], hits: list[str]) -> Callable:
    """Left (``_ask``) and right rows sorted by scene; gives the left rows with ``nn_d2`` and the columns ``hits`` of the nearest right row."""

    def run(batches):
        for rows in wholes(batches, [scene]):
            asks, xyz = rows.column("_ask").to_numpy(zero_copy_only=False), coordinates(rows, "xyz")
            known = ~np.isnan(xyz).any(axis=1)
            who = np.flatnonzero(asks)
            given = np.flatnonzero(~asks & known)
            given = given[pc.sort_indices(rows.column(key).take(pa.array(given))).to_numpy()]
            d2, hit, found = np.full(len(who), np.nan), np.zeros(len(who), np.int64), np.zeros(len(who), bool)
            if len(given):
                found = known[who]
                near = nearest(Leaves(xyz[who[found]]), Leaves(xyz[given]), 1)
                d2[found], hit[found] = near[0][:, 0], given[near[1][:, 0]]
            take = pa.array(hit, mask=~found)
            own = rows.take(pa.array(who))
            arrays = [own.column(c) for c in left] + [pa.array(d2, mask=~found), rows.column(key).take(take)] + [rows.column(c).take(take) for c in hits]
            yield pa.RecordBatch.from_arrays(arrays, names=[*left, "nn_d2", "nn_id", *hits])

    return run


def planes_in_scenes(scene: str, tolerance: float) -> Callable:
    """Points and planes (``_plane``: ``h, a, b, c, d``) sorted by scene; gives the plane with most points within ``tolerance`` (ties: the smallest ``h``)."""

    def run(batches):
        for rows in wholes(batches, [scene]):
            given = rows.column("_plane").to_numpy(zero_copy_only=False)
            if given.all() or not given.any():
                continue
            planes = _in_order(rows.filter(pa.array(given)), "h")
            a, b, c, d = (planes.column(n).to_numpy(zero_copy_only=False)[:, None] for n in "abcd")
            x, y, z = coordinates(rows.filter(pa.array(~given)), "xyz").T
            inliers, step = np.empty(len(a), np.int64), max(1, DISTANCES // len(x))
            for s in range(0, len(a), step):
                k = slice(s, s + step)
                inliers[k] = (np.abs(a[k] * x + b[k] * y + c[k] * z + d[k]) <= tolerance).sum(axis=1)
            best = int(inliers.argmax())
            won = planes.slice(best, 1)
            yield pa.RecordBatch.from_arrays(
                [won.column(scene), won.column("h"), pa.array(inliers[best : best + 1]), *[won.column(n) for n in "abcd"]],
                names=[scene, "h", "inliers", *"abcd"])

    return run


def dense_in_scenes(scene: str, key: str, dims: list[str], eps: float, min_pts: int) -> Callable:
    """Rows sorted by scene; gives them with ``cluster_id`` and ``is_core``."""

    def run(batches):
        for rows in wholes(batches, [scene]):
            rows = _in_order(rows, key)
            xyz = coordinates(rows, dims)
            known = np.flatnonzero(~np.isnan(xyz).any(axis=1))
            cluster, core = np.full(len(xyz), -1, np.int64), np.zeros(len(xyz), bool)
            cluster[known], core[known] = dense_parts(xyz[known], eps, min_pts)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(cluster, mask=cluster < 0), pa.array(core)], names=[*rows.schema.names, "cluster_id", "is_core"])

    return run


def components_in_scenes(scene: str) -> Callable:
    """Cells ``i, j`` sorted by scene; gives them with ``component``, numbered by the smallest cell of each 4-connected part."""

    def run(batches):
        for rows in wholes(batches, [scene]):
            at = np.stack([pc.cast(rows.column(c), pa.int64()).to_numpy() for c in "ij"], axis=1)
            found, place = np.unique(at, axis=0, return_inverse=True)
            # Numbers of the cells row by row, with a free column between two rows.
            low, high = found.min(axis=0), found.max(axis=0)
            number = (found[:, 0] - low[0]) * (high[1] - low[1] + 2) + found[:, 1] - low[1]
            label = np.arange(len(found))
            for step in (1, int(high[1] - low[1]) + 2):
                next_ = np.minimum(np.searchsorted(number, number + step), len(number) - 1)
                a = np.flatnonzero(number[next_] == number + step)
                label = merged(label, label[a], label[next_[a]])
            part = np.unique(label, return_inverse=True)[1].ravel()[place.ravel()].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(part)], names=[*rows.schema.names, "component"])

    return run
