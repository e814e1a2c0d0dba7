"""Toxicity: a bidirectional gated recurrent network with attention pooling over overlapping windows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import labelled_sample

#: Labelled documents the network learns from at most (those with the smallest id hashes).
MAX_LABELLED = 6_000
#: Bytes of whole texts it learns from at most.
MAX_BYTES = 16 << 20
WINDOW, STRIDE = 32, 16
#: Hash buckets of whole words, and of character inputs: first 4, first 6 and last 4 bytes.
BUCKETS = (1 << 17, 1 << 14, 1 << 16, 1 << 14)
#: Buckets in fewer training texts than this stay without effect.
MIN_TEXTS = 6
WIDTH, HIDDEN = 8, 8
#: Optimiser steps of a round at least.
LEAST_STEPS = 80
#: Share of each kind of input that a training step hides, so that parts of words count where the word is new.
HIDE = (0.8, 0.6, 0.3, 0.6)
#: One of this many training texts calibrates a network that did not learn from it.
FOLDS = 4
#: Bytes of text that are turned into windows at a time.
CHUNK_BYTES = 1 << 20
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))
# Letters, digits and everything beyond ASCII are word bytes.
_IS_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


# ------------------------------------------------------------------ inputs

def word_inputs(texts: list[bytes]):
    """Bucket rows ``[word, 4]`` of all words of some texts and the number of words of each text."""
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    inside = _IS_WORD[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts = np.flatnonzero(edge == 1)
    ends = np.flatnonzero(edge == -1)
    limits = np.cumsum([len(t) + 1 for t in texts])
    per_text = np.diff(np.searchsorted(starts, limits), prepend=0)
    with np.errstate(over="ignore"):
        powers = np.full(len(data), _R, np.uint64)
        powers[0] = 1
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.cumprod(powers, dtype=np.uint64), dtype=np.uint64)])
        powers[1:] = _R_INVERSE
        back = np.cumprod(powers, dtype=np.uint64)

        def bucket(a, b, kind):
            h = (sums[b] - sums[a]) * back[a] * np.uint64(0xC2B2AE3D27D4EB4F)
            h ^= h >> np.uint64(31)
            h *= np.uint64(0x9FB21C651E98DF25)
            return (h >> np.uint64(40)).astype(np.int64) % BUCKETS[kind]

        rows = np.stack([
            bucket(starts, ends, 0), bucket(starts, np.minimum(ends, starts + 4), 1),
            bucket(starts, np.minimum(ends, starts + 6), 2), bucket(np.maximum(starts, ends - 4), ends, 3),
        ], axis=1).astype(np.int32)
    return rows, per_text


def _chunks(texts: list[bytes]):
    """Ranges of texts of at most ``CHUNK_BYTES``, or of one text."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK_BYTES):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def windows(per_text: np.ndarray):
    """Word index per window and place (-1: none) and the text of each window.

    Windows of ``WINDOW`` words begin every ``STRIDE`` words and cover a text to its end; a text without words has none.
    """
    n = np.where(per_text > 0, 1 + np.maximum(0, -(-(per_text - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(per_text)), n)
    order = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    first = (np.cumsum(per_text) - per_text)[text] + order * STRIDE
    place = first[:, None] + np.arange(WINDOW)
    limit = np.cumsum(per_text)[text]
    return np.where(place < limit[:, None], place, -1), text


# ------------------------------------------------------------------ network

def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def initial(seed: int = 5) -> dict:
    rng = np.random.default_rng(seed)
    scale = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    net = {f"e{k}": rng.normal(0, 0.05, (n, WIDTH)).astype(np.float32) for k, n in enumerate(BUCKETS)}
    for d in "fb":
        net |= {f"w{d}": scale(WIDTH, 3 * HIDDEN), f"u{d}": scale(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return net | {"v": scale(2 * HIDDEN), "o": scale(2 * HIDDEN), "k": np.zeros(1, np.float32)}


def _run(gates: np.ndarray, mask: np.ndarray, u: np.ndarray, steps, keep: bool):
    """Hidden states of one direction; ``gates`` hold the input part of update, reset and candidate."""
    n = len(gates)
    h, states, saved = np.zeros((n, HIDDEN), np.float32), np.zeros((n, gates.shape[1], HIDDEN), np.float32), []
    for t in steps:
        inner = h @ u
        zr = _sigmoid(gates[:, t, : 2 * HIDDEN] + inner[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN] * mask[:, t, None], zr[:, HIDDEN:]
        c = np.tanh(gates[:, t, 2 * HIDDEN :] + r * inner[:, 2 * HIDDEN :])
        if keep:
            saved.append((t, h, zr, z, r, c, inner[:, 2 * HIDDEN :]))
        h = h + z * (c - h)
        states[:, t] = h
    return states, saved


def forward(net: dict, gates: dict, mask: np.ndarray, keep: bool = False):
    """Logit of each window from the input gates of both directions; a window without words has the bias."""
    length = mask.shape[1]
    parts = {d: _run(gates[d], mask, net[f"u{d}"], range(length) if d == "f" else range(length - 1, -1, -1), keep) for d in "fb"}
    h = np.concatenate([parts["f"][0], parts["b"][0]], axis=2)
    energy = np.where(mask, h @ net["v"], -1e9)
    a = np.exp(energy - energy.max(1, keepdims=True)) * mask
    a /= np.maximum(a.sum(1, keepdims=True), 1e-9)
    pooled = np.einsum("nt,nth->nh", a, h)
    return pooled @ net["o"] + net["k"][0], (parts, h, a, pooled)


def gradients(net: dict, rows: np.ndarray, mask: np.ndarray, labels: np.ndarray, weights: np.ndarray):
    """Loss and its gradients for windows of bucket rows ``[n, t, 4]``."""
    x = sum(net[f"e{k}"][rows[:, :, k]] for k in range(4)) * mask[:, :, None]
    gates = {d: x @ net[f"w{d}"] + net[f"c{d}"] for d in "fb"}
    logit, (parts, h, a, pooled) = forward(net, gates, mask, keep=True)
    p = _sigmoid(logit)
    loss = float(-(weights * np.where(labels == 1, np.log(p + 1e-7), np.log(1 - p + 1e-7))).sum() / weights.sum())
    d_logit = ((p - labels) * weights / weights.sum()).astype(np.float32)
    out = {"o": pooled.T @ d_logit, "k": np.array([d_logit.sum()], np.float32)}
    d_pooled = d_logit[:, None] * net["o"]
    d_a = np.einsum("nth,nh->nt", h, d_pooled)
    d_energy = a * (d_a - (a * d_a).sum(1, keepdims=True))
    out["v"] = np.einsum("nt,nth->h", d_energy, h)
    d_h = a[:, :, None] * d_pooled[:, None, :] + d_energy[:, :, None] * net["v"]
    d_x = np.zeros_like(x)
    for d, cut in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
        u, d_u, d_w, d_c = net[f"u{d}"], np.zeros_like(net[f"u{d}"]), np.zeros_like(net[f"w{d}"]), np.zeros_like(net[f"c{d}"])
        carry = np.zeros((len(x), HIDDEN), np.float32)
        for t, before, zr, z, r, c, inner in reversed(parts[d][1]):
            g = carry + d_h[:, t, cut]
            d_z = g * (c - before) * mask[:, t, None]
            d_cand = g * z * (1 - c * c)
            d_r = d_cand * inner
            d_gate = np.concatenate([d_z * zr[:, :HIDDEN] * (1 - zr[:, :HIDDEN]), d_r * r * (1 - r), d_cand], axis=1)
            d_inner = np.concatenate([d_gate[:, : 2 * HIDDEN], d_cand * r], axis=1)
            d_u += before.T @ d_inner
            d_w += x[:, t].T @ d_gate
            d_c += d_gate.sum(0)
            d_x[:, t] += d_gate @ net[f"w{d}"].T
            carry = g * (1 - z) + d_inner @ u.T
        out |= {f"u{d}": d_u, f"w{d}": d_w, f"c{d}": d_c}
    d_x *= mask[:, :, None]
    flat = d_x.reshape(-1, WIDTH)
    for k, n in enumerate(BUCKETS):
        ids, place = np.unique(rows[:, :, k].ravel(), return_inverse=True)
        total = np.zeros((len(ids), WIDTH), np.float32)
        np.add.at(total, place, flat)
        out[f"e{k}"] = (ids, total)
    return loss, out


class _Adam:
    """Adam; rows of an embedding move only in the steps that use them."""

    def __init__(self, net: dict, rate: float):
        self.net, self.rate, self.t = net, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in net.items()}
        self.s = {k: np.zeros_like(v) for k, v in net.items()}

    def step(self, grads: dict) -> None:
        self.t += 1
        fix1, fix2 = 1 - 0.9**self.t, 1 - 0.99**self.t
        for k, g in grads.items():
            at, g = g if isinstance(g, tuple) else (slice(None), g)
            self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * g
            self.s[k][at] = 0.99 * self.s[k][at] + 0.01 * g * g
            self.net[k][at] -= self.rate * (self.m[k][at] / fix1) / (np.sqrt(self.s[k][at] / fix2) + 1e-8)


def evidence(rows: np.ndarray, text_of_word: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Shrunken log odds of label 1 per bucket, from the texts that hold it (each counts once); NaN for rare buckets."""
    share, out = labels.mean(), []
    for k, n in enumerate(BUCKETS):
        pairs = np.unique(rows[:, k].astype(np.int64) * len(labels) + text_of_word)
        bucket, text = pairs // len(labels), pairs % len(labels)
        ones = np.bincount(bucket, labels[text], n)
        zeros = np.bincount(bucket, minlength=n) - ones
        odds = np.log((ones + 4 * share) / (zeros + 4 * (1 - share))) - np.log(share / (1 - share))
        out.append(np.where(ones + zeros >= MIN_TEXTS, odds, np.nan))
    return out


@dataclass
class Model:
    """Network, slope and intercept from the largest window logit to the document's, and score of an empty text."""

    net: dict
    slope: float = 1.0
    intercept: float = 0.0
    constant: float | None = None

    def window_logits(self, rows: np.ndarray, place: np.ndarray, batch: int = 4096) -> np.ndarray:
        net, out = self.net, []
        for i in range(0, len(place), batch):
            part = place[i : i + batch]
            # Windows follow each other, so a batch needs a run of words; their input parts are computed once.
            low, high = int(part[:, 0].min()), int(part.max()) + 1
            gates = {}
            x = sum(net[f"e{k}"][rows[low:high, k]] for k in range(4))
            for d in "fb":
                gates[d] = np.concatenate([x @ net[f"w{d}"] + net[f"c{d}"], net[f"c{d}"][None]])
            at = np.where(part >= 0, part - low, high - low)
            out.append(forward(net, {d: gates[d][at] for d in "fb"}, part >= 0)[0])
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def tops(self, texts: list[bytes]) -> np.ndarray:
        """Largest window logit of each whole text (without words: the network's bias)."""
        top = np.full(len(texts), self.net["k"][0], np.float64)
        for at, to in _chunks(texts):
            rows, per_text = word_inputs(texts[at:to])
            place, text = windows(per_text)
            if len(place):
                most = np.full(to - at, -np.inf)
                np.maximum.at(most, text, self.window_logits(rows, place))
                top[at:to] = np.where(np.isfinite(most), most, top[at:to])
        return top

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Score of each whole text: the largest logit of its windows, calibrated."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return _sigmoid(self.slope * self.tops(texts) + self.intercept)


def _calibrate(top: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and intercept from the largest window logit to the score.

    The slope is that of a ridge logistic regression (Newton steps, halved while the loss grows).  Wrong labels far from the
    border flatten it and would move its middle, so score 1/2 lies where the fewest texts are misjudged; a missed one counts
    the square root of the ratio of the labels, halfway between plain and balanced accuracy.
    """
    x, w = np.stack([top, np.ones_like(top)], axis=1), np.zeros(2)

    def loss(w):
        z = x @ w
        return (np.logaddexp(0, z) - labels * z).sum() + 5e-3 * (w @ w)

    for _ in range(50):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (p - labels) + 1e-2 * w)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    order = np.argsort(top, kind="stable")
    at, ones = top[order], labels[order]
    # Misjudged texts with the border before the k-th text; borders lie between different logits.
    missed = max(1.0, float(np.sqrt((1 - ones).sum() / max(1.0, ones.sum()))))
    wrong = missed * np.concatenate([[0], np.cumsum(ones)]) + np.concatenate([np.cumsum((1 - ones)[::-1])[::-1], [0]])
    low, high = np.concatenate([[at[0] - 1], at]), np.concatenate([at, [at[-1] + 1]])
    wrong[(low == high)] = np.inf
    best = np.flatnonzero(wrong == wrong.min())
    widest = best[(high - low)[best].argmax()]
    slope = max(float(w[0]), 1e-3)
    return slope, -slope * float(low[widest] + high[widest]) / 2


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 4, rounds: int = 3, seed: int = 5) -> Model:
    """Train on whole texts with one label each and calibrate.

    The network learns from all texts.  Its scores of these say little about other texts, so the calibration comes from a
    network of the same settings that learned without every fourth text, on those it left out.
    Without two kinds of labels the score is a constant.
    """
    labels = np.asarray(labels, np.float64)
    if not len(labels) or labels.min() == labels.max():
        return Model(initial(seed), constant=float((labels.sum() + 0.5) / (len(labels) + 1)) if len(labels) else 0.5)
    model = learn(texts, labels, epochs, rounds, seed)
    out = np.arange(len(labels)) % FOLDS == FOLDS - 1
    judged = [i for i in (0, 1) if 0 < (labels[out] == i).sum() and 0 < (labels[~out] == i).sum()]
    if len(judged) == 2:
        part = learn([t for t, o in zip(texts, out) if not o], labels[~out], epochs, rounds, seed)
        model.slope, model.intercept = _calibrate(part.tops([t for t, o in zip(texts, out) if o]), labels[out])
    else:
        model.slope, model.intercept = _calibrate(model.tops(texts), labels)
    return model


def learn(texts: list[bytes], labels: np.ndarray, epochs: int, rounds: int, seed: int) -> Model:
    """The network of some texts with both labels, not calibrated.

    Which window of a toxic text is toxic isn't labelled.  The first round takes the
    window with the strongest word evidence, later rounds the window the network itself scores
    highest; clean texts give theirs as hard negatives and one more at random.
    """
    rng, net = np.random.default_rng(seed), initial(seed)
    parts = [word_inputs(texts[a:b]) for a, b in _chunks(texts)]
    rows, per_text = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    place, text = windows(per_text)
    odds = evidence(rows, np.repeat(np.arange(len(texts)), per_text), labels)
    rare = {f"e{k}": np.isnan(o) for k, o in enumerate(odds)}
    odds = [np.nan_to_num(o) for o in odds]
    for k, o in enumerate(odds):
        net[f"e{k}"][:, 0] = np.clip(o, -3, 3) * 0.3
        net[f"e{k}"][rare[f"e{k}"]] = 0
    word_odds = np.max([o[rows[:, k]] for k, o in enumerate(odds)], axis=0)
    value = np.where(place >= 0, word_odds[place], -np.inf).max(1)
    optimiser, model = _Adam(net, 0.01), Model(net)
    # A rare bucket has no effect: it stands for a hidden input.
    hidden = {k: (share, int(rare[f"e{k}"].argmax())) for k, share in enumerate(HIDE) if rare[f"e{k}"].any()}
    for turn in range(rounds):
        order = np.lexsort((np.arange(len(text)), -value, text))
        first = order[np.unique(text[order], return_index=True)[1]]
        chosen = np.concatenate([first, rng.choice(len(text), min(len(text), len(first)), replace=False)])
        # A random window of a toxic text says nothing.
        chosen = np.concatenate([first, chosen[len(first) :][labels[text[chosen[len(first) :]]] == 0]])
        y = labels[text[chosen]]
        weigh = np.where(y == 1, 0.5 * len(y) / max(1, y.sum()), 0.5 * len(y) / max(1, (1 - y).sum()))
        batch = 64 if len(chosen) < 4000 else 256
        steps = max(1, len(chosen) // batch)
        for _ in range(max(epochs, -(-LEAST_STEPS // steps))):
            for part in np.array_split(rng.permutation(len(chosen)), steps):
                at = place[chosen[part]]
                seen = rows[at]
                for k, (share, nothing) in hidden.items():
                    seen[:, :, k][rng.random(at.shape) < share] = nothing
                _, grads = gradients(net, seen, at >= 0, y[part], weigh[part])
                for name, dead in rare.items():
                    ids, g = grads[name]
                    grads[name] = ids[~dead[ids]], g[~dead[ids]] + 1e-4 * net[name][ids[~dead[ids]]]
                optimiser.step(grads)
        if turn < rounds - 1:
            value = model.window_logits(rows, place)
    return model


def within_budget(sizes: list[int], most: int, budget: int = MAX_BYTES) -> list[int]:
    """Places of at most ``most`` whole rows of ``budget`` bytes together, in the given order.

    A row that does not fit is left out and the next are still tried; rows of more than 1/64 of the
    budget are tried after all others, so that a few long ones do not take the room of many.
    """
    taken, left = [], budget
    for i in sorted(range(len(sizes)), key=lambda i: sizes[i] > budget // 64):
        if len(taken) < most and sizes[i] <= left:
            taken.append(i)
            left -= sizes[i]
    return sorted(taken)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_LABELLED) -> Model:
    """Fit on at most ``most`` labelled documents of ``MAX_BYTES`` together (the bound of what the driver holds).

    Only the lengths of twice as many come to the driver before rows are chosen, so that others replace rows that are left out.
    """
    sample = labelled_sample(labels, label, most=2 * most)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    # The sample has at most twice ``most`` rows of two numbers.
    rows = own.join(F.broadcast(sample), "doc_id").withColumn("hash", F.xxhash64("text")).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)))
    order = [F.xxhash64("doc_id"), "doc_id", "hash"]
    found = rows.select("doc_id", "hash", "size").orderBy(*order).limit(2 * most).collect()
    chosen = [tuple(found[i])[:2] for i in within_budget([r["size"] for r in found], most)]
    if not chosen:
        return fit([], np.zeros(0))
    kinds = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, hash long"
    taken = rows.join(F.broadcast(docs.sparkSession.createDataFrame(list(dict.fromkeys(chosen)), kinds)), ["doc_id", "hash"])
    texts, given = [], []
    for r in taken.orderBy(*order).limit(len(chosen)).toLocalIterator():
        texts.append(bytes(r["text"] or b""))
        given.append(r["label"])
    return fit(texts, np.array(given, np.float64))


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the text, with ``score`` and ``predicted``.

    Every window of every whole text is scored, windows overlap by half; null texts are empty, and a text
    without words has the score of the network's bias.  Other columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != text]
    rows = docs.select(*kept, F.col(text).cast("binary").alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text), "score double"])

    def run(batches):
        for batch in batches:
            scores = shared.value.scores([t or b"" for t in batch.column("_text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores, pa.float64())], names=[*kept, "score"])

    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
