"""Exact removal of repeated byte strings with a sparse suffix array, sorted deep-shallow."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.lineage import cut, with_small

from .periodic import minimizers

LENGTH = 100
#: Bytes compared symbol by symbol before blind tries take over.
SHALLOW = 16
#: Bytes of text that are hashed at once.
CHUNK = 1 << 18
#: Suffixes sorted at once; a group of suffixes with one anchor that is larger is dealt out window by window instead.
GROUP = 20_000
_ODD = np.random.default_rng(12).integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)


def gram(length: int) -> int:
    """Bytes of an anchor: any ``length`` bytes hold one, among at most 61 places, so that a window's place fits a bit mask."""
    return max(length - 60, 2 * length // 5)


# ------------------------------------------------------------------ anchors

def _mixed(z: np.ndarray) -> np.ndarray:
    z = z ^ (z >> np.uint64(29))
    z *= _ODD[60]
    z ^= z >> np.uint64(32)
    z *= _ODD[61]
    z ^= z >> np.uint64(30)
    return z


def byte_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every ``size`` consecutive bytes, from overlapping eight-byte words."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    if size < 8:
        words = [data[k : len(data) - size + 1 + k].astype(np.uint64) * _ODD[k] for k in range(size)]
        return _mixed(sum(words[1:], words[0]))
    word = _mixed(np.ndarray((len(data) - 7,), "<u8", data.tobytes(), 0, (1,)) * _ODD[62])
    n = len(data) - size + 1
    total = np.zeros(n, np.uint64)
    for k, at in enumerate([*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]):
        total += word[at : at + n] * _ODD[k]
    return _mixed(total)


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``(hash, place, low, high, content hash)`` of the anchors of one text (at least ``length`` bytes).

    Every window of ``length`` bytes has one anchor: the leftmost of its ``gram(length)``-byte strings with the smallest hash,
    so equal windows have equal anchors in equal places.  ``low..high`` are the first and last start of the windows of an anchor.  The
    content hash covers all bytes of its windows and the place of the anchor in them.
    """
    k = gram(length)
    width = length - k + 1
    h = byte_hashes(data, k)
    at = minimizers(h, width)
    value = h[at]
    low, high = np.maximum(at - width + 1, 0), np.minimum(at, len(data) - length)
    # The windows of an anchor hold no smaller hash and, to its left, no equal one; a window's own anchor is among ``at``.
    for step in range(1, len(at)):
        gap = at[step:] - at[:-step]
        near = gap < width
        if not near.any():
            break
        before = near & (value[:-step] <= value[step:])
        np.maximum(low[step:], np.where(before, at[:-step] + 1, 0), out=low[step:])
        after = near & (value[step:] < value[:-step])
        np.minimum(high[:-step], np.where(after, at[step:] - width, len(data)), out=high[:-step])
    used = low <= high
    at, value, low, high = at[used], value[used], low[used], high[used]
    # Grams every k bytes and the last one cover the content.
    last = high + length - k
    content = _mixed((at - low).astype(np.uint64) * _ODD[50] + (high - at).astype(np.uint64) * _ODD[51])
    for j in range(-(-(2 * length - k) // k) + 1):
        content = _mixed(content * _ODD[52] + h[np.minimum(low + j * k, last)])
    return value, at, low, high, content


def _anchored(length: int):
    """Anchors of each batch of texts; see :func:`_judged` for ``known``.

    Repeats within the batch are settled at once, so a frequent gram sends at most one or two rows a batch to the task that
    compares it over batches.
    """

    def run(batches):
        for batch in batches:
            texts, found = batch.column("text"), []
            for i in range(batch.num_rows):
                value = texts[i].as_py() or b""
                data = np.frombuffer(value, np.uint8)
                # Long texts by chunks of whole windows; an anchor on a border has some of its windows in either.
                for lo in range(0, len(data) - length + 1, CHUNK):
                    value, at, low, high, content = anchors(data[lo : lo + CHUNK + length - 1], length)
                    found.append((np.full(len(at), i), value, at + lo, at - low, at - high, content))
            if not found:
                continue
            who, value, at, most, least, content = (np.concatenate(c) for c in zip(*found))
            rows = list(zip(batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist()))
            rank = np.empty(len(rows), np.int64)
            rank[sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i]))] = np.arange(len(rows))
            # Rows with the same id and text are one document.
            key: dict = {}
            rank = np.array([key.setdefault(r, int(k)) for r, k in zip(rows, rank)])
            order = np.lexsort((at, rank[who], content, value))
            who, value, at, most, least, content = (c[order] for c in (who, value, at, most, least, content))
            head = np.concatenate([[True], value[1:] != value[:-1]])
            first = head | np.concatenate([[True], content[1:] != content[:-1]])
            group = np.cumsum(head) - 1
            several = (np.bincount(group, weights=first) > 1)[group]
            own = np.concatenate([[False], (rank[who][1:] == rank[who][:-1]) & (at[1:] == at[:-1])]) & ~first
            known = np.where(own, 4, np.where(~first, 2, np.where(several, 1, 0)))
            sign = np.flatnonzero(several & head)
            pick = np.concatenate([np.flatnonzero(known < 4), sign])
            known = np.concatenate([known[known < 4], np.full(len(sign), 3)])
            # Settled repeats need neither hash any more, one of several contents not its own.
            value, content = np.where(known == 2, 0, value[pick].view(np.int64)), np.where((known == 1) | (known == 2), 0, content[pick].view(np.int64))
            packed = at[pick] << 16 | most[pick] << 9 | least[pick] << 2 | known
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(who[pick])), batch.column("tie").take(pa.array(who[pick])), pa.array(value), pa.array(content), pa.array(packed)],
                names=["doc_id", "tie", "anchor", "content", "packed"],
            )

    return run


def _judged(found: DataFrame) -> DataFrame:
    """Verdicts on anchors: ``doc_id, tie, anchor, at, most, least``, with ``anchor`` null where all windows are known to be repeats.

    ``known`` is 0 for the first of a content that is the batch's only one of its gram, 1 for the first of one of several contents, 2 for
    later equal ones, 3 for a row that tells other batches that there are several contents.  Only 0 and 3 are compared over batches; the others
    are dealt out evenly.  A gram that occurs once is dropped; equal contents are repeats of the first of
    them; first ones of a gram with several contents are left to the suffix sort.
    """
    known = F.col("packed").bitwiseAND(F.lit(3))
    salted = found.withColumn("salt", F.when(known.isin(0, 3), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("doc_id", "packed"), F.lit(1 << 30))))
    row = [F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("packed")]
    by = Window.partitionBy("anchor", "salt").orderBy("content", *row)
    everyone = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nth = Window.partitionBy("anchor", "salt", "content").orderBy(*row)
    several = (F.min("content").over(everyone) != F.max("content").over(everyone)) | (F.max(known).over(everyone) == 3)
    seen = salted.withColumns({"several": several, "known": known}).withColumn("nth", F.rank().over(nth))
    repeat = (F.col("known") == 2) | ((F.col("known") == 0) & (F.col("nth") > 1))
    unsure = (F.col("known") == 1) | ((F.col("known") == 0) & (F.col("nth") == 1) & F.col("several"))
    part = lambda shift, bits: F.shiftright("packed", shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    return seen.where(repeat | unsure).select(
        "doc_id", "tie", F.when(unsure, F.col("anchor")).alias("anchor"), F.shiftright("packed", 16).alias("at"), part(9, 7).alias("most"), part(2, 7).alias("least")
    )


# ------------------------------------------------------------------ deep-shallow sorting

def shallow_sort(symbols: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Multikey quicksort of rows of symbols: ``(order, groups)``; groups ``(start, end)`` in the order agree in all symbols.

    Every group of rows that agree so far is split by a pivot into smaller, equal and greater, and the equal part moves to the
    next symbol; all groups of a round are split together.
    """
    n, depths = symbols.shape
    order = np.arange(n)
    start, end, depth = np.array([0]), np.array([n]), np.array([0])
    deep: list[tuple[int, int]] = []
    while True:
        done = depth == depths
        deep += list(zip(start[done & (end - start > 1)].tolist(), end[done & (end - start > 1)].tolist()))
        live = ~done & (end - start > 1)
        start, end, depth = start[live], end[live], depth[live]
        if not len(start):
            return order, sorted(deep)
        size = end - start
        group = np.repeat(np.arange(len(size)), size)
        inside = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
        place = start[group] + inside
        value = symbols[order[place], depth[group]]
        ends = [symbols[order[p], depth] for p in (start, (start + end) // 2, end - 1)]
        pivot = np.maximum(np.minimum(ends[0], ends[1]), np.minimum(np.maximum(ends[0], ends[1]), ends[2]))[group]
        side = 3 * group + np.where(value < pivot, 0, np.where(value == pivot, 1, 2))
        order[place] = order[place[np.argsort(side, kind="stable")]]
        sizes = np.bincount(side, minlength=3 * len(size))
        stop = np.cumsum(sizes.reshape(-1, 3), axis=1).ravel() + np.repeat(start, 3)
        start, end, depth = stop - sizes, stop, np.repeat(depth, 3) + np.tile([0, 1, 0], len(size))


def common_prefix(a: bytes, b: bytes) -> int:
    """Bytes that two byte strings of one length share at the front."""
    differ = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (differ.bit_length() + 7) // 8


def blind_trie(texts: list[bytes], members: list[int]) -> tuple[list[int], list[int]]:
    """``(order, lcp)`` of the members (of one length) by a blind trie; ``lcp`` is with the one before (the first: 0).

    A node knows the depth at which its texts part and a child per byte there; a leaf lists equal texts.  To insert, any
    leaf is sought by branching bytes alone, one comparison with it gives the depth of the split, and the path is
    cut there.
    """
    root: object = [members[0]]
    for m in members[1:]:
        text, node = texts[m], root
        while isinstance(node, tuple):
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        shared = common_prefix(text, texts[node[0]])
        if shared == len(text):
            node.append(m)
            continue
        parent, node = None, root
        while isinstance(node, tuple) and node[0] < shared:
            parent, node = node, node[1][text[node[0]]]
        if isinstance(node, tuple) and node[0] == shared:
            node[1][text[shared]] = [m]
            continue
        below = node
        while isinstance(below, tuple):
            below = next(iter(below[1].values()))
        split = (shared, {texts[below[0]][shared]: node, text[shared]: [m]})
        if parent is None:
            root = split
        else:
            parent[1][text[parent[0]]] = split
    order, lcp, stack = [], [], [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if isinstance(node, tuple):
            kids = sorted(node[1])
            stack += [(node[1][b], node[0]) for b in kids[:0:-1]] + [(node[1][kids[0]], shared)]
        else:
            order += node
            lcp += [shared] + [len(texts[m]) for m in node[1:]]
    return order, lcp


def deep_shallow(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(order, lcp)`` of texts of ``width`` bytes: multikey quicksort to ``SHALLOW`` bytes, then blind tries."""
    size = -(-min(width, SHALLOW) // 8) * 8
    padded = np.frombuffer(b"".join(t[:SHALLOW].ljust(size, b"\0") for t in texts), ">u8").reshape(len(texts), -1).astype(np.uint64)
    order, groups = shallow_sort(padded)
    lcp = np.zeros(len(texts), np.int64)
    for start, end in groups:
        members, shared = blind_trie(texts, order[start:end].tolist())
        order[start:end], lcp[start:end] = members, shared
    inner = np.zeros(len(texts), bool)
    for start, end in groups:
        inner[start + 1 : end] = True
    for i in np.flatnonzero(~inner)[1:].tolist():
        lcp[i] = common_prefix(texts[order[i - 1]], texts[order[i]])
    return order, lcp


def repeated_windows(before: list[bytes], after: list[bytes], most: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """Bit ``o`` of each mask: the window that starts ``o`` bytes before the anchor equals one of an earlier record.

    Two windows at one place before their anchors are equal if the suffixes from the anchors share what is left of the window and the texts
    read backward from them share ``o`` bytes: neighbours in two sorted arrays whose common prefixes are long
    enough form classes, and the first record of a pair of classes is the earliest.
    """
    n, reach = len(after), length - gram(length)
    forward = deep_shallow([t.ljust(length, b"\0") for t in after], length)
    backward = deep_shallow([t[::-1].ljust(reach, b"\0") for t in before], reach)

    def classes(order, lcp, shared):
        out = np.empty(n, np.int64)
        out[order] = np.cumsum(lcp < shared)
        return out

    mask = np.zeros(n, np.int64)
    for o in range(reach + 1):
        here = np.flatnonzero((least <= o) & (o <= most))
        if len(here) > 1:
            pair = classes(*forward, length - o)[here] * np.int64(n + 1) + classes(*backward, o)[here]
            order = np.argsort(pair, kind="stable")
            again = order[1:][pair[order[1:]] == pair[order[:-1]]]
            mask[here[again]] |= np.int64(1) << np.int64(o)
    return mask


def _suffix_records(length: int):
    """``doc_id, tie, anchor, at, most, least, before, after`` of the anchors in ``spots`` of each text."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            who = []
            for i, (text, spots) in enumerate(zip(batch.column("text"), batch.column("spots"))):
                data = text.as_py()
                for s in spots.as_py():
                    at, most, least = s["at"], s["most"], s["least"]
                    who.append(i)
                    for column, value in zip(out, (s["anchor"], at, most, least, data[at - most : at], data[at : at - least + length])):
                        column.append(value)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            take = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("tie").take(take), *[pa.array(c, t) for c, t in zip(out, types)]],
                names=["doc_id", "tie", "anchor", "at", "most", "least", "before", "after"],
            )

    return run


def _ranges(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """First and last start of the repeated windows of records that are ordered by anchor and age."""
    # Rows with the same id and text asked for the same suffixes; one of each is compared.
    keys = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tie", "at", "most"))))
    batch = batch.take(pa.array([i for i, k in enumerate(keys) if not i or k != keys[i - 1]]))
    most, least = (batch.column(c).to_numpy().astype(np.int64) for c in ("most", "least"))
    mask = repeated_windows(batch.column("before").to_pylist(), batch.column("after").to_pylist(), most, least, length)
    hit = np.flatnonzero(mask)
    bits = (mask[hit, None] >> np.arange(62) & 1).astype(np.int8)
    edge = np.diff(np.pad(bits, ((0, 0), (1, 1))), axis=1)
    who, low = np.nonzero(edge == 1)
    high = np.nonzero(edge == -1)[1] - 1
    at = batch.column("at").to_numpy()[hit[who]]
    take = pa.array(hit[who])
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").take(take), batch.column("tie").take(take), pa.array(at - high), pa.array(at - low)], names=["doc_id", "tie", "lo", "hi"]
    )


def _sorted_groups(length: int):
    """:func:`_ranges` over whole anchors, about ``GROUP`` records at a time."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < GROUP:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            anchor = whole.column("anchor").to_numpy()
            end = int(np.searchsorted(anchor, anchor[-1], side="left"))
            if end:
                yield _ranges(whole.slice(0, end), length)
            held = [whole.slice(end)]
        if held and sum(b.num_rows for b in held):
            yield _ranges(pa.Table.from_batches(held).combine_chunks().to_batches()[0], length)

    return run


def _dealt_out(records: DataFrame, length: int) -> DataFrame:
    """The same ranges for anchors with very many different surroundings: one row per window, equal ones meet by partial aggregation."""
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie", "lo")
    whole = F.concat("before", "after")
    windows = records.select("*", F.explode(F.sequence("least", "most")).alias("o")).select(
        "doc_id", "tie", (F.col("at") - F.col("o")).alias("lo"), F.substring(whole, F.col("most") - F.col("o") + 1, F.lit(length)).alias("window"))
    windows = windows.withColumn("row", row)
    first = windows.groupBy("window").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return windows.join(first, "window").where("row <> first").select("doc_id", "tie", "lo", F.col("lo").alias("hi"))


# ------------------------------------------------------------------ removal

def _cut_texts(length: int):
    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for text, known, extra in zip(batch.column("text"), batch.column("known"), batch.column("extra")):
                data = text.as_py() or b""
                pairs = [(r["lo"], r["hi"]) for c in (known, extra) for r in c.as_py() or ()]
                spans: list[list[int]] = []
                for lo, hi in sorted(pairs):
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], hi + length)
                    else:
                        spans.append([lo, hi + length])
                kept, last = hashlib.sha256(), 0
                for lo, hi in spans:
                    kept.update(data[last:lo])
                    last = hi
                kept.update(data[last:])
                for column, value in zip(out, (len(data), sum(b - a for a, b in spans), spans, kept.hexdigest())):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(out, types)]], names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"]
            )

    return run


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, tie, text``: the text as bytes; ``tie`` parts rows whose id is missing or has several texts (0 for all others)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    mark = F.xxhash64("text")
    shared = rows.where("doc_id IS NOT NULL").select("doc_id", mark.alias("h")).groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    marked = with_small(rows, shared.where("a <> b").select("doc_id", F.lit(True).alias("_shared")), "doc_id")
    tie = F.when(F.col("doc_id").isNull() | F.col("_shared"), mark).otherwise(F.lit(0).cast("long"))
    return marked.select("doc_id", tie.alias("tie"), "text")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept_sha256`` of every row: each byte covered by a ``length``-byte string that also starts earlier goes.

    Earlier is a smaller id, or the same text and a smaller start.  ``spans`` has the removed runs as ``[start, end)``; all
    strings are judged on the whole input.  Every window of ``length`` bytes has one anchor chosen by content (:func:`anchors`), so
    equal windows meet at their anchors and only one suffix in about thirty is shuffled.  Of anchors with equal surroundings the earliest stays as it is;
    those with several different ones are sorted deep-shallow, forward and backward (:func:`repeated_windows`).  Anchors with over ``group``
    different surroundings are compared window by window instead, which no task holds whole.

    Null and empty texts have no bytes and lose none.  Rows with the same id and text are one document and get the same result; of one id
    the text with the smaller hash is earlier; rows without an id come last, by hash.  An empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    rows = keyed(docs, doc_id, text)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    key = f"doc_id {id_type}, tie long"
    found = rows.mapInArrow(_anchored(length), f"{key}, anchor long, content long, packed long")
    lo, hi = F.col("at") - F.col("most"), F.col("at") - F.col("least")
    spot = F.struct("anchor", "at", "most", "least")
    unsure = F.col("anchor").isNotNull()
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")
    per_row = _judged(found).groupBy(row.alias("row")).agg(
        F.collect_list(F.when(~unsure, F.struct(lo.alias("lo"), hi.alias("hi")))).alias("known"), F.collect_list(F.when(unsure, spot)).alias("spots"))
    verdicts = cut(per_row)
    # Both joins need the texts by row: as one query with the same columns they share one shuffle.
    texts = rows.withColumn("row", row)
    wanted = texts.join(verdicts.where("size(spots) > 0").select("row", "spots"), "row")
    records = wanted.select("doc_id", "tie", "text", "spots").mapInArrow(
        _suffix_records(length), f"{key}, anchor long, at long, most int, least int, before binary, after binary")
    sizes = verdicts.select(F.explode("spots.anchor").alias("anchor")).groupBy("anchor").count().where(F.col("count") > group)
    placed = with_small(records, sizes.select("anchor", F.lit(True).alias("_large")), "anchor")
    large = F.col("_large").isNotNull()
    order = ["anchor", F.col("doc_id").asc_nulls_last(), "tie", "at", "most"]
    small = placed.where(~large).drop("_large").repartition("anchor").sortWithinPartitions(*order)
    ranges = small.mapInArrow(_sorted_groups(length), f"{key}, lo long, hi long").unionByName(_dealt_out(placed.where(large), length))
    extra = ranges.groupBy(row.alias("row")).agg(F.collect_list(F.struct("lo", "hi")).alias("extra"))
    spans = verdicts.select("row", "known").where("size(known) > 0").join(extra, "row", "full")
    merged = texts.join(spans, "row", "left").select("doc_id", "tie", "text", "known", "extra")
    return merged.mapInArrow(_cut_texts(length), f"doc_id {id_type}, n_bytes long, n_removed long, spans array<array<long>>, kept_sha256 string")
