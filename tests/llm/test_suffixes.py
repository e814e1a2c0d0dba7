"""Removal of repeated byte strings: sorting kernels and whole results against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm import suffixes

SCHEMA = "doc_id long, text string"


def brute(rows, length):
    """Rows ``(id, text)``: per row n_bytes, spans, digest of what is kept."""
    data = {(i is None, i or 0, t): (t or "").encode() for i, t in rows}
    order = sorted(data, key=lambda k: k[:2])
    seen, out = set(), {}
    for k in order:
        b, drop, mine = data[k], set(), []
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                drop.update(range(s, s + length))
            seen.add(w)
        cut = sorted(drop)
        spans = [[c, c + 1] for c in cut[:1]]
        for c in cut[1:]:
            if c == spans[-1][1]:
                spans[-1][1] += 1
            else:
                spans.append([c, c + 1])
        kept = bytes(x for i, x in enumerate(b) if i not in drop)
        out[k] = (len(b), len(cut), spans, hashlib.sha256(kept).hexdigest())
    return [(i, *out[i is None, i or 0, t]) for i, t in rows]


def result(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def prose(rng, n, words="alpha beta gamma delta ümlaut eta theta iota".split()):
    return " ".join(rng.choice(words, n)) if n else ""


def corpus(seed):
    rng = np.random.default_rng(seed)
    shared = [prose(rng, 40) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [prose(rng, int(rng.integers(0, 60)))]
        for _ in range(int(rng.integers(0, 4))):
            parts += [shared[int(rng.integers(4))], prose(rng, int(rng.integers(0, 20)))]
        rows.append((i * 7 % 61, "\n".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1] + " x"), (102, "a" * 700), (103, "ab" * 300 + "a" * 150), (104, None), (105, ""), (106, "short"), (106, "short"),
             (107, rows[9][1]), (107, rows[9][1]), (None, rows[9][1]), (108, "\0" * 250), (109, "x" * 99), (110, "\0" * 130 + shared[0])]
    return rows


@pytest.mark.parametrize("length, group", [(100, 20_000), (100, 3), (40, 20_000), (20, 4)])
def test_remove_repeats_equals_brute_force(spark, length, group, monkeypatch):
    rows = corpus(length + group)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("spans", F.lit(1)).withColumn("anchor", F.lit("x")).withColumn("row", F.lit(0))
    assert result(suffixes.remove_repeats(docs, length=length, group=group)) == sorted(brute(rows, length), key=repr)


def test_one_id_with_several_texts(spark):
    rng = np.random.default_rng(2)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(1, a), (1, a + " " + b), (1, a), (2, b)]
    got = result(suffixes.remove_repeats(spark.createDataFrame(rows, SCHEMA)))
    whole = [r for r in got if r[0] == 1 and r[1] == len(a.encode())]
    assert len(whole) == 2 and whole[0] == whole[1]
    # One of the two texts of id 1 keeps the passage, the other loses it; id 2 has only what id 1 has.
    assert sorted({r[2] for r in got if r[0] == 1} | {0}) == sorted({0, max(r[2] for r in got if r[0] == 1)})
    assert [r[2] for r in got if r[0] == 2] == [len(b.encode())]


def test_empty_table_and_long_text(spark, monkeypatch):
    assert suffixes.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    rng = np.random.default_rng(3)
    long = "".join(rng.choice(list("abcdefgh "), 600_000))
    rows = [(1, long), (2, "begin " + long[1000:590_000])]
    got = {r[0]: r for r in result(suffixes.remove_repeats(spark.createDataFrame(rows, SCHEMA)))}
    assert got[1][2] == 0 and got[2][2] == 589_000 and got[2][3] == [[6, 589_006]]


def test_chunks_and_frequent_anchors(spark, monkeypatch):
    found = []
    rng = np.random.default_rng(4)
    data = np.frombuffer(rng.choice(list("ab"), 5000).tobytes(), np.uint8)
    value, at, low, high, content = suffixes.anchors(data, 100)
    for a, lo, hi in zip(at, low, high):
        found += range(lo, hi + 1)
    assert sorted(found) == list(range(len(data) - 99))


@pytest.mark.parametrize("width", [3, 16, 60, 100])
def test_deep_shallow_sorts(width):
    rng = np.random.default_rng(width)
    texts = [bytes(rng.choice([0, 1, 200], width).tolist()) for _ in range(300)] + [b"\1" * width] * 40
    texts += [t[: width // 2] + bytes(rng.integers(0, 256, width - width // 2).tolist()) for t in texts[:100]]
    order, lcp = suffixes.deep_shallow(texts, width)
    got = [texts[i] for i in order]
    assert got == sorted(texts) and sorted(order.tolist()) == list(range(len(texts)))
    for i in range(1, len(got)):
        shared = next((k for k in range(width) if got[i][k] != got[i - 1][k]), width)
        assert lcp[i] == shared


def test_blind_trie_needs_few_comparisons(monkeypatch):
    calls = []
    monkeypatch.setattr(suffixes, "common_prefix", lambda a, b, f=suffixes.common_prefix: calls.append(1) or f(a, b))
    rng = np.random.default_rng(9)
    texts = [b"p" * 50 + bytes(rng.integers(0, 256, 50).tolist()) for _ in range(200)]
    order, _ = suffixes.blind_trie(texts, list(range(200)))
    assert [texts[i] for i in order] == sorted(texts) and len(calls) == 199


def test_whole_query_equals_brute_force(spark):
    from pointloom.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()]
    want = [(r[0], r[1], r[2], len(r[3]), r[4]) for r in brute(docs, 100)]
    assert result(queries.QUERIES["op12_suffix_array"](spark, sf)) == sorted(want, key=repr)
