"""Merkle fingerprints against a brute-force version."""

import hashlib
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm import merkle
from pointloom.llm.text import held, place


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def root(text):
    leaves, sections, run = [sha(p) for p in text.split("\n")], [], []
    for k, (p, h) in enumerate(zip(text.split("\n"), leaves)):
        run.append(h)
        if k == len(leaves) - 1 or not p or int(h[:7], 16) % merkle.SECTION_MODULUS == 0:
            sections.append(sha("".join(run)))
            run = []
    return sha("".join(sections))


def pieces(paragraphs):
    found = set()
    for p in paragraphs:
        w = re.findall(r"[^\x20\x09-\x0D]+", p)
        found |= {tuple(w[i:i + 4]) for i in range(max(len(w) - 3, 1))} if w else set()
    return found


def likeness(a, b):
    if a == b:
        return 1.0
    p, q = set(a.split("\n")), set(b.split("\n"))
    both, x, y = pieces(p & q), pieces(p - q), pieces(q - p)
    total = 2 * len(both) + len(x) + len(y)
    return 2 * (len(both) + len(x & y)) / total if total else 0.0


def some_texts(n, seed=4):
    rng = np.random.default_rng(seed)
    words = ["a", "be", "sea", "\u00e9t\u00e9", "\U0001f600x", "dee", "e\u00a0f", "gee"]
    gaps = [" ", "  ", "\n", "\n\n", "\t", "\r\n"]
    return ["".join(words[rng.integers(8)] + gaps[rng.integers(6)] for _ in range(rng.integers(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("block_docs", [3, 400])
def test_every_column_against_brute_force(spark, monkeypatch, block_docs):
    monkeypatch.setattr(merkle.with_next, "__defaults__", ("doc_id", "text", block_docs))
    texts = some_texts(40) + ["", None, " \n\t", "x", "\n", "one two three", *some_texts(2)]
    rows = [(i * 7 % 53 - 9, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tree", F.lit(1)).withColumn("next_text", F.lit("q"))
    got = {r["doc_id"]: r for r in merkle.compare_with_next(docs).collect()}
    order = [(d, t or "") for d, t in sorted(rows, reverse=True)]
    assert len(got) == len(order)
    for k, (d, t) in enumerate(order):
        after, third = order[(k + 1) % len(order)][1], len(t) // 3
        changed = t[: len(t) - third] + after[:third]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(changed))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (root(t), root(changed))
        assert r["near_edited"] == pytest.approx(likeness(t, changed)) and r["near_next"] == pytest.approx(likeness(t, after))
        theirs = set(changed.split("\n"))
        assert r["n_differing"] == (0 if t == changed else sum(p not in theirs for p in t.split("\n")))


def pair(spark, a, b):
    df = merkle.with_tree(merkle.with_tree(spark.createDataFrame([(a, b)], "a string, b string"), "a", "ta"), "b", "tb")
    return df.select(merkle.likeness(F.col("ta"), F.col("tb")).alias("l"), merkle.differing(F.col("ta"), F.col("tb")).alias("d")).first()


def test_a_word_in_front_moves_little(spark):
    text = " ".join(f"w{i}" for i in range(100))
    assert pair(spark, text, "new " + text)["l"] > 0.9
    assert pair(spark, text, text.replace("w50 ", ""))["l"] > 0.9


def test_many_paragraphs_are_linear(spark):
    a = [f"line {i} of a long text" for i in range(16_000)]
    b = [f"{x} too" if i % 100 == 0 else x for i, x in enumerate(a)]
    pair(spark, "x", "y")
    begun = time.time()
    got = pair(spark, "\n".join(a), "\n".join(b))
    assert time.time() - begun < 10
    assert got["d"] == list(range(0, 16_000, 100)) and 0.95 < got["l"] < 1


def test_binary_search(spark):
    values = [-5, 0, 0, 3, 8, 8, 9]
    df = spark.createDataFrame([(values[:n], v) for n in range(8) for v in range(-6, 11)], "s array<long>, v long")
    for r in df.select("s", "v", place(F.col("s"), F.col("v")).alias("p"), place(F.col("s"), F.col("v"), upto=True).alias("u"), held(F.col("s"), F.col("v")).alias("h")).collect():
        assert (r["p"], r["u"], r["h"]) == (sum(x < r["v"] for x in r["s"]), sum(x <= r["v"] for x in r["s"]), r["v"] in r["s"])
