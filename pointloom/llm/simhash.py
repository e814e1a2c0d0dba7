"""SimHash near-duplicate groups, linked through one-wildcard segment variants."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.graph import connected_components
from pointloom.functions.lineage import cut

BITS = 64
SHINGLE = 3
MAX_BITS = 2
#: Buckets with more fingerprints than this are joined on two wildcards instead of pair by pair.
CROWD = 64


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text, repeats included (no word: 0).

    A-Z is lower-cased and words are what white space (0x20, 0x09-0x0D) separates;
    a text with fewer words than a shingle is one shingle.
    """
    found = text.lower().split()
    if not found:
        return 0
    data = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[shingle - 1 :] or [len(data)]
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(BITS, np.int64), len(ends)
    for at in range(0, n, 1 << 14):
        hashes = np.array([digest(data[a:b], 42) for a, b in zip(starts[at : at + (1 << 14)], ends[at : at + (1 << 14)])], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "simhash", keep: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` and the signed 64-bit fingerprint of each row (null text: that of no words, 0)."""
    kept = docs.select(*[F.col(c) for c in (docs.columns if keep is None else keep)], F.col(text).cast("binary").alias("_text"))
    schema = f"{name} long"
    keys = [f.name for f in kept.schema.fields if f.name != "_text"]
    columns = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name in keys), schema])

    def run(batches):
        for batch in batches:
            values = [fingerprint(x or b"", shingle) for x in batch.column("_text").to_pylist()]
            signed = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), signed], names=[*keys, name])

    return kept.mapInArrow(run, columns)


def hex_digits(fp) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """Fewest segments ``(shift, width)`` of which one differs by at most one bit: ``max_bits // 2 + 1``."""
    n = max_bits // 2 + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _mask(shift: int, width: int) -> int:
    value = ((1 << width) - 1) << shift
    return value - (1 << 64) if value >= 1 << 63 else value


def _without_bit(fp: Column, bit: Column) -> Column:
    return fp.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))


def _variants(s: int, shift: int, width: int) -> Column:
    """Segment ``s`` of ``fp`` as it is (bit -1) and with each of its bits deleted."""
    own = F.col("fp").bitwiseAND(F.lit(_mask(shift, width)))
    row = lambda bit, value: F.struct(F.lit(s).alias("s"), bit.alias("bit"), value.alias("value"))
    bits = F.sequence(F.lit(shift), F.lit(shift + width - 1))
    return F.concat(F.array(row(F.lit(-1), own)), F.transform(bits, lambda bit: row(bit, _without_bit(own, bit))))


def near_links(prints: DataFrame, fp: str = "fp", max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints that connect all pairs within ``max_bits`` bits.

    Every fingerprint gives, for each segment, the segment itself (variant -1) and one
    variant per deleted bit.  Two fingerprints within ``max_bits`` bits agree in a
    segment or in a variant of one, so an equality join finds them and the whole
    distance is verified; a deletion variant pairs only fingerprints that differ in
    its bit, so equal segments meet once.  A bucket of more than ``crowd``
    fingerprints is not paired: its members are keyed once more on the whole
    fingerprint with ``max_bits`` wildcards, and members of such a key, which lie
    within the bound by construction, are linked in a chain.  This is exact too, and linear
    in the bucket.  The keys are merged and never broadcast: the planner takes an exploded table
    for as large as the file it comes from, and a fingerprint has 66 keys.
    """
    distinct = prints.select(F.col(fp).alias("fp"))
    variants = [_variants(s, shift, width) for s, (shift, width) in enumerate(_segments(max_bits))]
    key = ["s", "bit", "value"]
    index = distinct.select("fp", F.explode(F.concat(*variants)).alias("v")).select("fp", "v.*")
    sizes = index.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut(index.join(sizes.hint("merge"), key))
    # In a bucket of a deleted bit, rows without the bit meet rows with it.
    side = F.when(F.col("bit") < 0, F.lit(0)).otherwise(F.call_function("shiftrightunsigned", "fp", F.greatest("bit", F.lit(0))).bitwiseAND(F.lit(1)))
    few = shared.where(F.col("n") <= crowd).withColumn("side", side)
    left = few.where((F.col("bit") < 0) | (F.col("side") == 0)).select(*key, F.col("fp").alias("a"))
    right = few.where((F.col("bit") < 0) | (F.col("side") == 1)).select(*key, F.col("fp").alias("b"))
    same = ((left["bit"] >= 0) | (F.col("a") < F.col("b"))) & (_distance("a", "b") <= max_bits)
    pairs = left.join(right.hint("merge"), [left[k] == right[k] for k in key] + [same]).select("a", "b")
    crowded = shared.where(F.col("n") > crowd).select("fp", "s", "bit")
    return pairs.union(_crowd_links(crowded, max_bits))


def _crowd_links(crowded: DataFrame, max_bits: int) -> DataFrame:
    """Chains over the members of crowded buckets that agree but for ``max_bits`` named bits."""
    bits = F.sequence(F.lit(0), F.lit(BITS - 1))
    # The wildcards of a bucket: its own deleted bit and as many others as are left.
    state = crowded.select("fp", F.when(F.col("bit") >= 0, F.array("bit")).otherwise(F.array().cast("array<int>")).alias("wild")).distinct()
    for _ in range(max_bits):
        grown = F.when(
            F.size("wild") < max_bits,
            F.transform(F.filter(bits, lambda i: ~F.array_contains("wild", i)), lambda i: F.array_sort(F.concat("wild", F.array(i)))),
        ).otherwise(F.array("wild"))
        state = state.select("fp", F.explode(grown).alias("wild")).distinct()
    masked = F.aggregate("wild", F.col("fp"), _without_bit)
    keyed = state.select("fp", "wild", masked.alias("rest"))
    # A key with this few wildcards holds at most 2 ** max_bits fingerprints.
    members = keyed.groupBy("wild", "rest").agg(F.sort_array(F.collect_set("fp")).alias("m")).where(F.size("m") > 1)
    chain = F.arrays_zip(F.slice("m", F.lit(1), F.size("m") - 1).alias("a"), F.slice("m", F.lit(2), F.size("m") - 1).alias("b"))
    return members.select(F.explode(chain).alias("e")).select("e.a", "e.b")


def fingerprint_groups(printed: DataFrame, max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """``fp, group, component_id`` of every distinct fingerprint of a written table ``doc_id, fp``.

    ``group`` is a fingerprint that names the component, ``component_id`` the smallest id in it.
    """
    nodes = cut(printed.groupBy("fp").agg(F.min("doc_id").alias("low")))
    rooted = connected_components(cut(near_links(nodes, "fp", max_bits, crowd).distinct()))
    lows = rooted.join(nodes.withColumnRenamed("fp", "node"), "node").select("node", "root", "low")
    groups = lows.groupBy("root").agg(F.min("low").alias("group_low"))
    linked = lows.join(groups, "root").select(F.col("node").alias("fp"), "root", "group_low")
    return nodes.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("group"), F.coalesce("group_low", "low").alias("component_id"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    ``component_id`` is the smallest id reachable over links of at most ``max_bits``
    differing bits.  Equal fingerprints are one node, so copies cost nothing in the
    join; the graph has a node per distinct fingerprint that has a neighbour.
    Null texts count as empty (fingerprint zero, linked like any other); a null id
    never names a group unless the group has no other id; an empty table gives an
    empty result; further columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    printed = cut(with_fingerprint(rows, "text", "fp", keep=["doc_id"]))
    classes = fingerprint_groups(printed, max_bits, crowd).drop("group")
    return printed.join(classes, "fp").select("doc_id", hex_digits("fp").alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the near copies: one row of every group stays, that with the smallest id.

    A row is known by its id and the hash of its text, so rows that share an id but not the text
    are judged apart.  Of equal ids in a group the smallest text hash stays, rows without an id come last, and of
    repeated rows one stays; an empty table stays empty.  Other columns pass through, whatever their names.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"))
    printed = cut(with_fingerprint(rows, "text", "fp", keep=["doc_id", "hash"]))
    placed = printed.join(fingerprint_groups(printed).drop("component_id"), "fp").select("group", row_key("doc_id", "hash").alias("row"))
    return keep_best(docs, placed, doc_id, text)


def row_key(doc_id: str, hash_) -> Column:
    """Order and identity of a row: rows without an id last, then the id, then the hash of the text."""
    return F.struct(F.col(doc_id).isNull().alias("last"), F.col(doc_id).alias("doc_id"), (F.col(hash_) if isinstance(hash_, str) else hash_).alias("hash"))


def keep_best(docs: DataFrame, placed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the first row of every group of ``placed`` (``group, row``, one row per row of ``docs``)."""
    names = docs.columns
    best = placed.groupBy("group").agg(F.min("row").alias("best"))
    drop = placed.join(best, "group").where("row <> best").select("row").distinct()
    own = row_key(doc_id, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    kept = docs.withColumn("_row", own).join(drop.withColumnRenamed("row", "_row"), "_row", "left_anti")
    if placed.groupBy("row").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["_row"])
    return kept.select(*names)
