"""Periodic runs against brute force."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm import periodic


def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def brute_row(doc_id, text, planted=True):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", text or "") if w]
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if planted and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    place = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *place, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def texts(seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(12)]
    prose = lambda n, v=vocabulary: " ".join(rng.choice(v, n)) if n else ""
    out = [None, "", "one", "x " * 200, "a b " * 40 + "a", prose(800), prose(600, ["a", "b"]), prose(2000, ["a"] * 30 + ["b"])]
    for q in [1, 2, 7, 8, 9, 15, 16, 17, 18, 23, 24, 25, 36, 37, 53, 80, 133, 200]:
        block, reps = prose(q), int(rng.integers(2, 6))
        run = " ".join([block] * reps) + " " + " ".join(block.split()[: int(rng.integers(0, q))])
        out += [f"{prose(int(rng.integers(0, 30)))} {run} {prose(int(rng.integers(0, 30)))}", " ".join([run, prose(5), run, run])]
    # A period that repeats a shorter piece inside, and runs that overlap.
    piece = prose(20)
    block = f"{piece} {piece} {prose(7)}"
    out += [" ".join([block] * 4), " ".join(["a b c"] * 12 + ["c d e"] * 12), " ".join([" ".join(["u v"] * 13 + ["z"])] * 4)]
    return out


@pytest.mark.parametrize("seed, block", [(0, periodic.BLOCK), (1, 500)])
def test_runs_equal_brute_force(spark, seed, block, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts(seed))] + [(None, "p q " * 30), (3, "x " * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1)).withColumn("name", F.lit("x")).coalesce(2)
    got = sorted([tuple(r) for r in periodic.periodic_runs(docs, planted=True).collect()], key=repr)
    assert got == sorted([brute_row(*r) for r in rows], key=repr)


def test_kernel_on_random_words_with_planted_runs():
    rng = np.random.default_rng(5)
    for trial in range(60):
        many = [[b"%d" % w for w in rng.integers(0, int(rng.integers(1, 9)), int(rng.integers(0, 400)))] for _ in range(4)]
        planted = []
        for w in many:
            if len(w) > 10:
                a, p = int(rng.integers(len(w))), int(rng.integers(1, 90))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            planted.append(w)
        for words, got in zip(planted, periodic._block(planted, 24, 3)):
            assert got == periodic.describe(words, brute_runs(words)), trial


def test_whole_query_equals_brute_force(spark):
    from pointloom.llm import queries

    sf = "/root/testdata/sf0.001"
    got = sorted([tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, sf).collect()])
    docs = queries.table(spark, sf, "documents").select("doc_id", "text").collect()
    assert got == sorted(brute_row(*r) for r in docs)


def test_empty_table_and_long_run(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    words = [f"v{i % 70_001}" for i in range(300_000)]
    row = periodic.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert (row["n_runs"], row["start"], row["length"], row["period"], row["exponent_milli"]) == (1, 0, 300_000, 70_001, 4285)
