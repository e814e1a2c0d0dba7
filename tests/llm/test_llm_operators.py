"""Operators against brute force, round trips and edge cases."""

import itertools
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.functions.graph import connected_components
from pointloom.llm import hosts, licenses, lm, merkle, mixing, packing, quality, simhash, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n)) if n else ""


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(1, 400)
    rows = [(1, base, "en", "a", 0), (2, base.replace("alpha", "Alpha"), "en", "a", 0), (3, base + " omega", "en", "b", 0), (4, prose(2, 90), None, None, None),
            (5, None, "en", "b", 0), (6, "", "en", None, 0), (7, " \t\n ", "en", "c", 0), (8, "one", "en", "c", 0), (8, "one", "en", "c", 0),
            (9, "x " * 5000, "de", "a", 0), (None, prose(3, 60), "de", "a", 0), (10, prose(4, 3000) + "\n" + prose(4, 3000), "fr", "d", 0), (11, "É " + prose(5, 70) + " $ # <b>", "fr", "d", 0)]
    return table(spark, rows).withColumn("fp", F.lit("mine")).withColumn("component_id", F.lit(0)).withColumn("size_", F.lit(1)).cache()


def rows_of(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=repr)


def components_of(n, edges):
    root = list(range(n))
    for a, b in edges:
        a, b = root[a], root[b]
        root = [min(a, b) if r in (a, b) else r for r in root]
    return root


# ------------------------------------------------------------------ 1

def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    texts = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()]
    edges = [(i, j) for (i, (_, a)), (j, (_, b)) in itertools.combinations(enumerate(texts), 2) if bin(a ^ b).count("1") <= 2]
    root = components_of(len(texts), edges)
    low = {r: min((texts[i][0] for i in range(len(texts)) if root[i] == r and texts[i][0] is not None), default=None) for r in set(root)}
    want = sorted(((d, f"{f:016x}", low[root[i]]) for i, (d, f) in enumerate(texts)), key=repr)
    assert sorted([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got], key=repr) == want


@pytest.mark.parametrize("crowd", [1, 64])
@pytest.mark.parametrize("max_bits", [1, 2, 3])
def test_links_are_complete_on_both_paths(spark, crowd, max_bits):
    rng = np.random.default_rng(max_bits)
    centres = rng.integers(0, 2**63, 3)
    prints = {int(c) ^ int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))) for c in centres for _ in range(12)}
    signed = sorted(p - (1 << 64) if p >= 1 << 63 else p for p in prints)
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), "fp", max_bits, crowd).collect()
    near = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= max_bits
    assert all(near(r["a"], r["b"]) for r in links)
    at = {p: i for i, p in enumerate(signed)}
    every = [(i, j) for i, j in itertools.combinations(range(len(signed)), 2) if near(signed[i], signed[j])]
    assert components_of(len(signed), [(at[r["a"]], at[r["b"]]) for r in links]) == components_of(len(signed), every)
    if crowd == 64:
        assert {tuple(sorted((at[r["a"]], at[r["b"]]))) for r in links} == set(every)


def test_exploded_keys_are_not_broadcast(spark, monkeypatch):
    """A small table of fingerprints has 66 keys a row, which no plan may send to the driver on the size of its file."""
    prints = simhash.cut(spark.range(3000).select(F.xxhash64("id").alias("fp")))
    plans, own = [], simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df: plans.append(df) or own(df))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    try:
        plans.append(simhash.near_links(prints))
        assert len(plans) == 2 and not any("BroadcastHashJoin" in p._jdf.queryExecution().executedPlan().toString() for p in plans)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_one_document_of_each_group_stays(spark, docs):
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {1, 4, 5, 8, 10, 11} <= set(ids) and 2 not in ids and 6 not in ids and ids.count(8) == 1


def test_rows_that_share_an_id_are_judged_by_their_text(spark):
    a, b, c = prose(21, 300), prose(22, 300), prose(23, 300)
    rows = [(1, a), (2, a), (None, a), (None, b), (None, b), (None, c), (7, prose(24, 300)), (7, prose(25, 300)), (8, ""), (9, None), (10, prose(26, 300)), (10, prose(26, 300))]
    kept = simhash.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string").withColumn("group", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "group"]
    want = [(1, a), (None, b), (None, c), (7, prose(24, 300)), (7, prose(25, 300)), (8, ""), (10, prose(26, 300))]
    assert rows_of(kept, "doc_id", "text") == sorted(want, key=repr)


# ------------------------------------------------------------------ 2

def test_merkle_tree_and_edits(spark):
    a = "\n".join(prose(i, 30) for i in range(40))
    b = a.replace("alpha", "omega", 1)
    df = spark.createDataFrame([(a, b), (a, a), ("", None), ("x", "y")], "a string, b string")
    trees = merkle.with_tree(merkle.with_tree(df, "a", "ta"), "b", "tb")
    rows = trees.select("a", "b", "ta", "tb", merkle.differing(F.col("ta"), F.col("tb")).alias("d"), merkle.likeness(F.col("ta"), F.col("tb")).alias("l")).collect()
    differing = [i for i, (x, y) in enumerate(zip(a.split("\n"), b.split("\n"))) if x != y]
    assert rows[0]["d"] == differing and 0.9 < rows[0]["l"] < 1 and rows[0]["ta"]["root"] != rows[0]["tb"]["root"]
    assert rows[1]["d"] == [] and rows[1]["l"] == 1 and rows[1]["ta"]["root"] == rows[1]["tb"]["root"]
    assert rows[2]["l"] == 1 and rows[3]["l"] == 0
    sections = rows[0]["ta"]["sections"]
    assert [s["first"] for s in sections] == [0, *np.cumsum([s["size"] for s in sections])[:-1].tolist()] and sum(s["size"] for s in sections) == 40


@pytest.mark.parametrize("block_docs", [2, 400])
def test_next_document_in_falling_order(spark, block_docs):
    rows = [(i, f"text {i}") for i in (3, 8, 1, 99, 42, 7, 5, 1000)]
    got = merkle.with_next(spark.createDataFrame(rows, "doc_id long, text string"), block_docs=block_docs).collect()
    order = sorted(rows, reverse=True)
    assert {(r["doc_id"], r["next_text"]) for r in got} == {(d, order[(i + 1) % len(order)][1]) for i, (d, _) in enumerate(order)}


def test_merkle_edge_cases(spark, docs):
    got = merkle.compare_with_next(docs).collect()
    assert len(got) == docs.count() and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert merkle.compare_with_next(docs.limit(0)).count() == 0
    one = merkle.compare_with_next(docs.where("doc_id = 4")).first()
    assert one["near_next"] == 1.0 and one["n_chars"] > 0


# ------------------------------------------------------------------ 3

def test_packing_round_trip(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, capacity=512).collect()
    coded = [(r["doc_id"], [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0]) for r in docs.collect()]
    want = sorted(((d, k, a, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for d, ids in coded for k, a in enumerate(range(0, len(ids), 512)) for c in [ids[a : a + 512]]), key=repr)
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows], key=repr) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1].tolist()] and sum(n for _, n in places) <= 512
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_word_tokens_equal_whole_text_tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, words = Tokenizer.from_file(path), packing.WordTokens(path, cached=20)
    for text in ("", "  ", "it's I'LL x'll!! don't", "<|endoftext|>a <|startoftext|>!!", "ÀÉ naïve café é a̸ ≮", "1a2 b3,4.5 \x1c y z 日本。 😀!!", prose(1, 300)):
        split = packing.split_words(text)
        words.learn([split])
        assert np.frombuffer(words.encode(split), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_sum_of_squares_rule():
    def brute(lengths, cap):
        gaps = []
        for s in lengths:
            def cost(g):
                c = {}
                for x in g:
                    if 0 < x:
                        c[x] = c.get(x, 0) + 1
                return sum(v * v for v in c.values())
            options = sorted((cost([*gaps[:i], g - s, *gaps[i + 1 :]]), g) for i, g in enumerate(gaps) if g >= s)
            if options:
                gaps[gaps.index(options[0][1])] = options[0][1] - s
            else:
                gaps.append(cap - s)
        return gaps

    rng = np.random.default_rng(0)
    for cap in (7, 20):
        lengths = rng.integers(1, cap + 1, 60)
        bins = packing.sum_of_squares(lengths, cap)
        left = cap - np.bincount(bins, lengths)
        assert sorted(left.tolist()) == sorted(map(float, brute(lengths.tolist(), cap)))
    n = rng.integers(1, 2049, 5000)
    assert packing.pack(n).max() + 1 <= 1.02 * math.ceil(n.sum() / 2048)


# ------------------------------------------------------------------ 4

def test_license_inheritance(spark):
    files = [("src/LICENSE", "Released under the MIT License."), ("src/a/b.txt", "text only"), ("src/x/COPYING.txt", "words\nLicensed under the Apache License, Version 2.0.\nmore"),
             ("src/x/y/z.py", "Licensed under CC BY-NC 4.0.\ncode"), ("src/x/y/w.py", "code"), ("other/q.py", None), ("top.py", ""), (None, "text"), ("src/x/y/w.py", "code"), ("srcx/a", "b")]
    got = licenses.scan_files(spark.createDataFrame(files, "path string, text string").withColumn("depth", F.lit(1)))
    rows = {(r["path"], r["license"], r["origin"], r["from_dir"]) for r in got.collect()}
    assert rows == {
        ("src/LICENSE", "MIT", "own", None), ("src/a/b.txt", "MIT", "inherited", "src"), ("src/x/COPYING.txt", "Apache-2.0", "own", None),
        ("src/x/y/z.py", "CC-BY-NC-4.0", "own", None), ("src/x/y/w.py", "Apache-2.0", "inherited", "src/x"), ("other/q.py", None, "none", None),
        ("top.py", None, "none", None), (None, None, "none", None), ("srcx/a", None, "none", None),
    } and got.count() == len(files)
    assert licenses.scan_files(spark.createDataFrame([], "path string, text string")).count() == 0


def test_license_score_is_a_tf_idf_cosine(spark):
    lines = ["Licensed under the Apache License, Version 2.0.", "licensed under the license of the moon", "copyright nobody",
             "the license the license gnu general public 2 of the the moon", "bsd and apache and mit license v2.0 of 1999, all rights reserved"]
    files = spark.createDataFrame([(f"f{i}", x) for i, x in enumerate(lines)], "path string, text string")
    vec = licenses.template_vectors(files).first()
    tok = lambda s: re.findall(r"[a-z0-9]+(?:\.[0-9]+)?", re.sub(licenses.NOISE, "", s.lower()))
    df = lambda t: sum(t in tok(x) for x in lines)
    known = {t for _, _, x in licenses.TEMPLATES for t in tok(x)}
    idf = lambda t: math.log((len(lines) + 1) / (df(t) + 1)) + 1 if t in known else math.log(len(lines) + 1) + 1
    assert vec["idf"] == {t: pytest.approx(idf(t), abs=1e-8) for t in known}

    def cosine(a, b):
        w = lambda x, t: idf(t) * tok(x).count(t)
        norm = lambda x: math.sqrt(sum(w(x, t) ** 2 for t in set(tok(x))))
        return sum(w(a, t) * w(b, t) for t in set(tok(a)) & set(tok(b))) / norm(a) / norm(b)

    got = licenses.scan_files(files, threshold=0.0).orderBy("path").collect()
    for r, line in zip(got, lines):
        rank = lambda n: 0 if n in licenses.RESERVED else 1 if n in licenses.FAMILIES else 2
        fits = [(rank(n), round(cosine(line, x), 6), n) for n, needs, x in licenses.TEMPLATES if set(needs.split()) <= set(tok(line))]
        want = max(fits)[1:] if fits else (None, None)
        assert (r["score"], r["own_license"]) == (want[0] and pytest.approx(want[0], abs=2e-6), want[1])


# ------------------------------------------------------------------ 5

def test_network_gradients():
    rng = np.random.default_rng(1)
    net = {k: v.astype(np.float64) for k, v in toxicity.initial(3).items()}
    rows = np.stack([rng.integers(0, n, (3, 6)) for n in toxicity.BUCKETS], axis=2)
    mask, y, w = np.array([[1] * 6, [1] * 4 + [0] * 2, [1] + [0] * 5], bool), np.array([1.0, 0, 1]), np.array([1.0, 2, 1])
    _, grads = toxicity.gradients(net, rows, mask, y, w)
    for name, at in (("uf", (1, 20)), ("ub", (2, 3)), ("wf", (0, 9)), ("wb", (3, 1)), ("cf", (5,)), ("v", (3,)), ("o", (9,)), ("k", (0,))):
        sides = []
        for d in (1e-3, -1e-3):
            net[name][at] += d
            sides.append(toxicity.gradients(net, rows, mask, y, w)[0])
            net[name][at] -= d
        assert grads[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-3, rel=2e-2, abs=1e-5)


def test_windows_cover_whole_texts():
    place, text = toxicity.windows(np.array([0, 1, 32, 33, 100]))
    for t, (first, n) in enumerate(((0, 0), (0, 1), (1, 32), (33, 33), (66, 100))):
        seen = place[text == t]
        assert set(seen[seen >= 0].tolist()) == set(range(first, first + n))


def test_toxicity_learns_and_scores_everything(spark, docs):
    rng = np.random.default_rng(0)
    texts = [" ".join([*rng.choice(WORDS, 80), *(["vilewort"] if i % 4 == 0 else []), *rng.choice(WORDS, 40)]).encode() for i in range(400)]
    labels = np.array([float(i % 4 == 0) for i in range(400)])
    model = toxicity.fit(texts[:300], labels[:300])
    assert ((model.scores(texts[300:]) >= 0.5) == labels[300:]).mean() >= 0.98
    scored = toxicity.score_toxicity(docs.select("doc_id", "text", "fp"), model)
    assert scored.columns == ["doc_id", "fp", "score", "predicted"] and scored.where("score BETWEEN 0 AND 1").count() == docs.count()
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    assert toxicity.fit([b"a"], np.array([1.0])).scores([b"", b"x"]).tolist() == [0.75, 0.75] and toxicity.fit([], np.zeros(0)).scores([b""]).tolist() == [0.5]


# ------------------------------------------------------------------ 6

def test_rules_compile_to_the_same_probability(spark, docs):
    rng = np.random.default_rng(0)
    x = rng.random((400, len(quality.FEATURES)))
    y = ((x[:, 1] > 0.3) & (x[:, 3] < 0.6)).astype(float)
    ensemble = quality.fit(x, y)
    assert ((ensemble.probability(x) > 0.5) == y).mean() > 0.97 and 0 < len(ensemble.rules) < 200
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], list(quality.FEATURES)).select(F.struct(*quality.FEATURES).alias("s"))
    got = [r[0] for r in frame.select(ensemble.column(F.col("s"))).collect()]
    assert np.allclose(got, ensemble.probability(x))
    scored = quality.score_quality(docs, ensemble)
    assert scored.columns == [*docs.columns, "score", "predicted"] and scored.where("score BETWEEN 0 AND 1").count() == docs.count()
    assert quality.fit(x[:0], y[:0]).probability(x[:1])[0] == 0.5 and quality.fit(x[:3], np.ones(3)).probability(x[:1])[0] > 0.8


def test_training_leaves_held_out_labels_alone(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (1, None)], "doc_id long, quality int")
    ids = {r["doc_id"] for r in quality.labelled_sample(labels, "quality").collect()}
    assert ids == {i for i in range(100) if zlib.crc32(str(i).encode()) % 5}


# ------------------------------------------------------------------ 7

def test_bits_of_all_words_sum_to_one():
    mixer = lm.Mixer.empty()
    mixer.learn([b"ab", b"abc", b"b"] * 20)
    slots, bits, sizes = lm.bit_slots([bytes([b]) for b in range(256)])
    p = mixer.probability(slots)
    total = np.multiply.reduceat(np.where(bits == 1, p, 1 - p), np.cumsum(sizes) - sizes)
    assert total.sum() == pytest.approx(1.0, abs=1e-9)


def test_language_model_counts_and_base(spark, docs):
    got = lm.score_documents(docs, head_words=5).collect()
    rows = docs.select("doc_id", "text").collect()
    low = lambda t: re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    counts = {}
    for r in rows:
        if not held(r["doc_id"]):
            for w in [*low(r["text"]), None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted([(r["doc_id"], held(r["doc_id"]), len(low(r["text"])) + 1, sum(w in counts for w in [*low(r["text"]), None]), n,
                    round(sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in [*low(r["text"]), None]), 5)) for r in rows], key=repr)
    assert sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got], key=repr) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    whole = {(r["doc_id"], round(r["score"], 6)) for r in lm.score_documents(docs).collect()}
    assert whole == {(r["doc_id"], round(r["score"], 6)) for r in got}, "the broadcast head changes nothing"
    assert lm.score_documents(docs.limit(0)).count() == 0


def test_long_words_are_coded_in_pieces():
    words = [b"abcdefghij" * 30 + b"x", b"q", b"z" * 70, b"", b"ab"]
    slots, bits, sizes = lm.bit_slots([lm._symbol(w) for w in words])
    got = list(lm.coded(words, 16))
    assert np.array_equal(np.concatenate([g[1] for g in got], axis=1), slots) and np.array_equal(np.concatenate([g[2] for g in got]), bits)
    assert max(len(g[2]) for g in got) <= 8 * 16 and {len(g[0]) for g in got} == {1, 2}
    places, found = np.concatenate([g[0] for g in got]), np.concatenate([g[3] for g in got])
    assert np.bincount(places, found).tolist() == sizes.tolist()


def test_mixing_weights_learn_from_every_training_word(spark, monkeypatch):
    monkeypatch.setattr(lm, "LESSON", 50)
    rng = np.random.default_rng(5)
    words = sorted({bytes(rng.choice(list(b"abcdef"), rng.integers(2, 9)).tolist()) for _ in range(600)})
    vocabulary = spark.createDataFrame([(bytearray(w), 2, int(i % 7 > 0)) for i, w in enumerate(words)], "word binary, n_all long, n_train long").repartition(3)
    zeros, ones = lm.bit_tables(vocabulary)
    known = [w for i, w in enumerate(words) if i % 7]
    assert lm.unpacked_counts(zeros[0]).sum() + lm.unpacked_counts(ones[0]).sum() == pytest.approx(8 * sum(len(w) + 1 for w in known), rel=0.01)
    mixer = lm.train(vocabulary)
    alone = lm.Mixer.of_counts(zeros, ones)
    assert np.abs(mixer.weights - alone.weights).max() > 1e-3
    used, hit = lm.Mixer.of_counts(zeros, ones, learning=True).learn(known)
    # A gate that any training word uses has learnt, the others keep their start.
    assert np.array_equal((mixer.weights != alone.weights).any(axis=1), used > 0) and used.sum() == 8 * sum(len(w) + 1 for w in known)
    unseen = [w for i, w in enumerate(words) if i % 7 == 0]
    assert mixer.log10_words(unseen).sum() > alone.log10_words(unseen).sum()


def test_contexts_count_every_training_token():
    """Terms of tokens by brute force over all tokens of their two words before; they leave a distribution one."""
    rng = np.random.default_rng(6)
    texts = [rng.integers(4, size=rng.integers(1, 60)).tolist() for _ in range(80)]
    texts += [texts[0], texts[1], texts[1]]
    held = rng.random(len(texts)) < 0.25
    ids = np.array([xxhash.xxh64_intdigest(b"w%d" % w) for t in texts for w in t], np.uint64)
    sizes = np.array([len(t) for t in texts])
    train = np.repeat(~held, sizes)
    bucket, keys = lm.context_keys(ids, np.cumsum(sizes) - sizes, 2)
    context = [(s[i], s[i + 1]) for t in texts for s in [[-1, -1, *t]] for i in range(len(t))]
    word = [w for t in texts for w in t]
    assert len(set(zip(context, bucket.tolist()))) == len(set(context)) and len(set(bucket.tolist())) > 1
    u, v = lm.context_terms(keys, train)
    count, hits, trials = {}, {}, {}
    for c, w, t in zip(context, word, train):
        if t:
            count.setdefault(c, {}).setdefault(w, 0)
            count[c][w] += 1
    for found in count.values():
        k = (sum(found.values()) - 1).bit_length()
        for n in found.values():
            trials[k], hits[k] = trials.get(k, 0) + n, hits.get(k, 0) + n * (n > 1)
    for c, w, t, x, y in zip(context, word, train, u, v):
        found = dict(count.get(c, {}))
        if t:  # left out itself
            found[w] -= 1
        total = sum(found.values())
        k = total.bit_length()
        trust = hits.get(k, 0) / (trials.get(k, 0) + 1) if total else 0
        assert x == pytest.approx(1 - trust) and y == pytest.approx(trust * found.get(w, 0) / max(1, total))
        assert sum(x * 0.25 + trust * found.get(o, 0) / max(1, total) for o in range(4)) == pytest.approx(1)


def test_texts_that_occur_twice_are_scored_apart(spark):
    """The score knows the order of words of the whole corpus: copies lie above texts of the same words in an order of their own."""
    rng = np.random.default_rng(9)
    texts = [rng.choice([f"w{i}" for i in range(200)], 80).tolist() for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100 + i, " ".join(t)) for i, t in enumerate(texts[:20])]
    rows += [(200 + i, " ".join(rng.permutation(t))) for i, t in enumerate(texts[20:40])]
    got = {r["doc_id"]: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    twice = [got[i]["score"] for i in range(20) if not got[100 + i]["held_out"]]
    shuffled = [got[i]["score"] for i in range(20, 40)]
    assert len(twice) > 10 and min(twice) > max(shuffled) and len(got) == 100


def test_recall_follows_the_document():
    earlier, a, b = lm.recall_terms(np.array([0, 1, 0, 0, 2]))
    assert earlier.tolist() == [0, 0, 1, 2, 0] and a[0] == 1 and np.all(a + b <= 1 + 1e-12)


# ------------------------------------------------------------------ 8

def test_mixing_targets_and_epochs(spark):
    rows = [(i, prose(i, 20 + i % 30), "en", s, 0) for i, s in enumerate(["a"] * 200 + ["b"] * 300 + ["c"] * 500 + [None] * 40)]
    got = mixing.mix_sources(table(spark, rows)).collect()
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"] and r["source_size"] > 0
    weight, open_, want = {"a": 5.0, "b": 2.0, "c": 1.0, None: 5.0}, set(sizes), {}
    total = 1.5 * sum(sizes.values())
    while True:
        share = {s: (total - sum(want.values())) * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    want |= share
    assert target == {s: pytest.approx(t) for s, t in want.items()}
    assert all(abs(taken[s] - target[s]) <= 25 for s in sizes)
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix_sources(table(spark, rows).repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}


def test_mixing_edge_cases(spark, docs):
    out = mixing.mix_sources(docs)
    assert out.count() == docs.count() and out.columns[: len(docs.columns)] == docs.columns
    assert mixing.mixed_documents(docs).columns == docs.columns and mixing.mixed_documents(docs.limit(0)).count() == 0
    empty = mixing.mix_sources(docs.where("doc_id in (5, 6)")).collect()
    assert [r["taken"] for r in empty] == [0, 0]


# ------------------------------------------------------------------ 9

def test_archives_round_trip(spark, tmp_path):
    big = "<p>" + prose(1, 200)
    rows = [(3, "http://a/\nx", big), (1, None, big), (2, "http://b", "short"), (4, "http://c", "short"), (5, "u", None), (6, "u", "é" * 80), (7, "u", "é" * 80), (None, "u", big), (9, "u", "Z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w", archive_bytes=10_000)
    got = warc.read_archives(manifest)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    kinds = {(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got.collect()}
    assert kinds == {(3, len(big), "revisit", 1), (1, len(big), "response", None), (2, 5, "response", None), (4, 5, "response", None), (5, 0, "response", None),
                     (6, 160, "response", None), (7, 160, "revisit", 6), (None, len(big), "revisit", 1), (9, 300_000, "response", None)}
    payloads = {r["page_id"]: bytes(r["payload"]).decode() for r in got.where("record_type = 'response'").collect()}
    assert payloads[1] == big and payloads[6] == "é" * 80 and payloads[5] == ""
    assert warc.read_archives(warc.write_archives(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_damaged_archives_are_noticed(tmp_path):
    archive = warc.Archive(str(tmp_path / "a.zst"))
    for i in range(50):
        archive.add(warc.record_bytes(i, "u", prose(i, 50).encode(), __import__("hashlib").sha256(prose(i, 50).encode()).hexdigest(), None))
    path = archive.close()[0]
    assert [warc.parse_record(r)["page_id"] for r in warc.read_archive(path)] == list(range(50))
    data = (tmp_path / "a.zst").read_bytes()
    (tmp_path / "a.zst").write_bytes(data[:-3])
    with pytest.raises(ValueError):
        list(warc.read_archive(path))


# ------------------------------------------------------------------ 10

def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), len(covered)


def test_rule_counts_match_brute_force(spark, docs):
    extra = table(spark, [(20, "a b c a b c a b\nx\nx\n \nx", None, "z", 0), (21, "a a a a", None, "z", 0), (22, "a b c d", None, "z", 0)])
    both = docs.select(*extra.columns).union(extra)
    got = hosts.document_counts(both).select("text", "_counts.*").collect()
    assert all(tuple(r)[1:] == brute_counts(r["text"]) for r in got)


def test_host_verdicts(spark):
    good, bad = prose(1, 80), "x " * 80
    rows = [(i, good if i % 10 else bad, "en", "good", 0) for i in range(200)] + [(1000 + i, bad if i % 10 else good, "en", "bad", 0) for i in range(100)] + [(5000, bad, "en", "tiny", 0), (5001, good, "en", None, 0)]
    kept = {r["doc_id"]: r["kept"] for r in hosts.quality_rules(table(spark, rows)).collect()}
    assert kept[1] and not kept[0] and not kept[1000] and kept[5001] and len(kept) == len(rows)
    assert hosts.quality_rules(table(spark, rows).limit(0)).count() == 0


# ------------------------------------------------------------------ graph

@pytest.mark.parametrize("shape", ["chain", "star", "random", "horseshoe"])
def test_components_of_any_shape(spark, shape):
    rng = np.random.default_rng(3)
    n = 600
    edges = {
        "chain": [(i, i + 1) for i in range(n - 1)], "star": [(n - 1, i) for i in range(n - 1)],
        "random": rng.integers(0, n, (n // 2, 2)).tolist(), "horseshoe": [(i, i + 2) for i in range(n - 2)] + [(n - 1, n - 2)],
    }[shape]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame([tuple(map(int, e)) for e in edges], "a long, b long")).collect()}
    root = components_of(n, edges)
    assert got == {i: root[i] for i in {x for e in edges for x in e}}
