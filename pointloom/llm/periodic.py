"""Periodic runs of words, found through minimizers at several scales."""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_LENGTH = 24
LEAST_EXPONENT = 3
#: Periods up to this are found by comparing the text with itself at the lag.
DIRECT = 16
#: Words that are searched at once (a longer text alone).
BLOCK = 1 << 18
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of two hashes in order."""
    z = a * _MIX[0] + b
    z ^= z >> np.uint64(29)
    z *= _MIX[1]
    z ^= z >> np.uint64(32)
    z *= _MIX[2]
    return z ^ (z >> np.uint64(31))


def gram_hashes(ids: np.ndarray, sizes: list[int]):
    """``(size, hashes of all runs of that many words)`` for ascending sizes, doubling from hashes of single words."""
    h, have = _pair(ids.astype(np.uint64), np.full(len(ids), np.uint64(1))), 1
    for size in sizes:
        while 2 * have <= size:
            h, have = _pair(h[: len(h) - have], h[have:]), 2 * have
        extra = size - have
        yield size, (_pair(h[: len(h) - extra], h[extra:]) if extra else h)


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over every ``width`` consecutive values: prefixes and suffixes of blocks, combined."""
    n = len(x)
    blocks = np.concatenate([x, np.full(-n % width, x[-1])]).reshape(-1, width)
    left = op.accumulate(blocks, axis=1).ravel()
    right = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[: n - width + 1], left[width - 1 : n])


def minimizers(h: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the smallest value of some ``width`` consecutive ones (all of equal ones)."""
    if len(h) <= width:
        return np.flatnonzero(h == h.min()) if len(h) == width else np.zeros(0, np.int64)
    low = _slide(h, width, np.minimum)
    edge = np.zeros(width - 1, h.dtype)
    return np.flatnonzero(_slide(np.concatenate([edge, low, edge]), width, np.maximum) == h)


def _stretch(ids: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """Longest stretch around ``at`` in which words ``lag`` apart are equal: start and end of it."""
    step, lo, hi = 32, at, at
    while hi + lag < len(ids):
        width = min(step, len(ids) - lag - hi)
        bad = np.flatnonzero(ids[hi : hi + width] != ids[hi + lag : hi + lag + width])
        hi += int(bad[0]) if len(bad) else width
        if len(bad):
            break
        step *= 2
    step = 32
    while lo > 0:
        width = min(step, lo)
        bad = np.flatnonzero(ids[lo - width : lo] != ids[lo - width + lag : lo + lag])
        lo -= width - 1 - int(bad[-1]) if len(bad) else width
        if len(bad):
            break
        step *= 2
    return lo, hi + lag


def _long_enough(length: int, period: int, least_length: int, exponent: int) -> bool:
    return length >= max(least_length, exponent * period)


def _direct(ids: np.ndarray, lag: int, least: int) -> list[tuple[int, int]]:
    """Stretches ``(start, end)`` of at least ``least`` words in which words ``lag`` apart are equal."""
    same = np.concatenate([[False], ids[lag:] == ids[:-lag], [False]])
    turn = np.flatnonzero(same[1:] != same[:-1])
    start, end = turn[::2], turn[1::2] + lag
    long = end - start >= least
    return list(zip(start[long].tolist(), end[long].tolist()))


def scales(longest: int, exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """``(shortest period, longest period, window)`` of each scale, for periods above ``DIRECT`` in texts of ``longest`` words.

    Hashed grams are as long as the scale's longest period L.  Let q be the period of a run, S the scale's
    shortest.  In the run no gram of L >= q words occurs twice less than q apart (else the period were shorter).  Windows of w
    grams at the run's start and one period later have equal content if w + L <= (exponent - 1) q + 1, so
    w = (exponent - 1) S + 1 - L words fit, the first window's minimum comes again q later, and nothing equal lies between.
    """
    out, top = [], DIRECT
    while exponent * (top + 1) <= longest:
        low, top = top + 1, top * 3 // 2
        out.append((low, top, (exponent - 1) * low + 1 - top))
    return out


def find_runs(ids: np.ndarray, bounds: np.ndarray, least_length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """Maximal runs ``(start, length, period)`` by start, then period, of texts laid end to end.

    ``ids`` numbers the words; texts are separated by numbers that occur once.  ``bounds`` has the end of each text in
    ``ids``; texts come longest first, so that each scale looks only at those that can hold a run of its periods.
    """
    found: dict[tuple[int, int], int] = {}

    def add(start: int, end: int, period: int) -> None:
        # A stretch with several periods keeps the smallest: the others are its multiples.
        found[start, end] = min(period, found.get((start, end), period))

    lengths = np.diff(np.concatenate([[0], bounds])) - 1
    if not len(lengths) or lengths[0] < least_length:
        return []

    def holding(least: int) -> np.ndarray:
        texts = int(np.searchsorted(-lengths, -least, side="right"))
        return ids[: bounds[texts - 1]] if texts else ids[:0]

    for lag in range(1, DIRECT + 1):
        least = max(least_length, exponent * lag)
        part = holding(least)
        if len(part) > lag:
            for start, end in _direct(part, lag, least):
                add(start, end, lag)
    for low, top, width in scales(int(lengths[0]), exponent):
        part = holding(max(least_length, exponent * low))
        if len(part) < top:
            break
        for _, h in gram_hashes(part, [top]):
            places = minimizers(h, width)
            places = places[np.argsort(h[places], kind="stable")]
            twin = h[places[1:]] == h[places[:-1]]
            a, lag = places[:-1][twin], np.diff(places)[twin]
            seed = (lag >= low) & (lag <= top)
            a, lag = a[seed], lag[seed]
            by = np.lexsort((a, lag))
            done = (0, 0)
            for at, d in zip(a[by].tolist(), lag[by].tolist()):
                if done[0] == d and at + d < done[1]:
                    continue  # inside the stretch just extended
                start, end = _stretch(part, at, d)
                done = (d, end)
                if _long_enough(end - start, d, least_length, exponent):
                    add(start, end, d)
    return sorted((start, end - start, period) for (start, end), period in found.items())


def plant(ids: np.ndarray, h: int) -> np.ndarray:
    """Positions of the original words that stand in the text with a planted run (hash ``h`` of its id)."""
    n, g = len(ids), h // 10
    place = np.arange(n)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        place[a:] = a + (place[a:] - a) % p
    return place


def describe(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """Digest of a text's runs: count, the run of greatest exponent, all runs, and the text with every run cut to its first period."""
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            edge[start + period] += 1
            edge[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
    place = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *place, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest())


NAMES = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def _block(texts: list[list[bytes]], least_length: int, exponent: int) -> list[tuple]:
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    numbers: dict[bytes, int] = {}
    flat = [numbers.setdefault(w, len(numbers)) for i in order for w in [*texts[i], None]]
    ids = np.array(flat, np.int64)
    ends = np.cumsum([len(texts[i]) + 1 for i in order])
    ids[ends - 1] = len(numbers) + np.arange(len(ends))  # a separator of its own after every text
    out: list = [None] * len(texts)
    starts = np.concatenate([[0], ends[:-1]])
    mine: list[list] = [[] for _ in texts]
    for start, length, period in find_runs(ids, ends, least_length, exponent):
        t = int(np.searchsorted(ends, start, side="right"))
        mine[t].append((start - int(starts[t]), length, period))
    for t, i in enumerate(order):
        out[i] = describe(texts[i], mine[t])
    return out


def periodic_runs(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT, planted: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and the columns ``NAMES``.

    A run is a maximal stretch of words with smallest period q and at least ``max(least_length, exponent * q)`` words.
    ``planted`` lays a run into the texts whose id hashes to a multiple of ten before the search.  ``start, length, period,
    exponent_milli`` belong to the run with the greatest exponent and are null where there is none; ``collapsed_sha256`` hashes the
    text in which every run is cut to its first period.

    Texts are searched in blocks of ``BLOCK`` words, a longer one alone, in memory in proportion to it.  Null and empty texts have no words and no
    runs (both digests are those of the empty string); rows without an id have a null id, whose hash is that of the empty string; repeated rows give repeated
    results; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    if exponent < 3:
        raise ValueError("an exponent of 3 at least")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_id).cast("string").alias("name"), F.col(text).cast("binary").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    types = ["long"] * 5 + ["string"] * 2

    def found(batch, lo, hi, texts):
        columns = zip(*_block(texts, least_length, exponent))
        arrays = [pa.array(c, pa.int64() if t == "long" else pa.string()) for c, t in zip(columns, types)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *arrays], names=["doc_id", *NAMES])

    def run(batches):
        for batch in batches:
            names, lo, size, texts = batch.column("name"), 0, 0, []
            for i, value in enumerate(batch.column("text")):
                words = (value.as_py() or b"").split()
                if planted:
                    place = plant(words, zlib.crc32((names[i].as_py() or "").encode()))
                    words = [words[k] for k in place.tolist()] if words else words
                if texts and size + len(words) > BLOCK:
                    yield found(batch, lo, i, texts)
                    lo, size, texts = i, 0, []
                texts.append(words)
                size += len(words)
            if texts:
                yield found(batch, lo, batch.num_rows, texts)

    return rows.mapInArrow(run, "doc_id {}, {}".format(id_type, ", ".join(f"{n} {t}" for n, t in zip(NAMES, types))))
