"""Sum-of-squares packing of token sequences."""

from __future__ import annotations

import math
import os
import re
import string
import zlib
from itertools import filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.lineage import cut

CAPACITY = 2048
END_ID = 0
#: Pieces of less than full length that are packed together by one task.
SHARD_DOCS = 20_000
#: Sequences of one full piece are numbered from here, above those of any shard.
WHOLE_IDS = 1 << 61
#: Words whose ids a Python worker keeps at least, and half of what it keeps at most (about 250 bytes each).
CACHED_WORDS = 500_000


class WordTokens:
    """Ids of whole texts, word by word, with a bounded cache.

    The vocabulary splits at white space, drops it and lower-cases, and no rule of it
    reaches over an ASCII space, so the ids of a text are those of its words in turn.  In a word of letters
    with ASCII punctuation behind it, letters and punctuation are coded apart as well.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cached, self.known, self.runs = Tokenizer.from_file(path), cached, {}, {}
        self.old: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def learn(self, texts: list[list[str]]) -> None:
        """Encode the words of a batch of texts that are not known yet."""
        known, runs = self.known, self.runs
        if len(known) > self.cached or len(runs) > self.cached:
            # The older half goes; what is met again moves over.
            self.old, self.known, self.runs = self.known, {}, {}
            known, runs = self.known, self.runs
        new = set()
        for t in texts:
            new.update(filterfalse(known.__contains__, t))
        met = new & self.old.keys()
        known.update(zip(met, map(self.old.__getitem__, met)))
        new -= met
        plain, wanted, odd = [], set(), []
        for w in new:
            base = w.rstrip(string.punctuation)
            if base.isalpha() or not base:
                tail = w[len(base) :]
                plain.append((w, base, tail))
                wanted.add(base)
                wanted.add(tail)
            else:
                odd.append(w)
        wanted.discard("")
        runs[""] = b""
        self._runs([r for r in wanted if r not in runs])
        for w, base, tail in plain:
            known[w] = runs[base] + runs[tail]
        self._apart(odd, known)

    def _runs(self, new: list[str]) -> None:
        """Ids of runs of one kind of character; each ends with its only end-of-word token."""
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                self._store(part, ids, ends, self.runs)
            else:  # a run that the vocabulary splits after all
                self._apart(part, self.runs)

    def _apart(self, new: list[str], into: dict) -> None:
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            coded = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(coded.ids, "<u4")
            places = np.array(coded.word_ids, np.int64)
            self._store(part, ids, np.searchsorted(places, np.arange(1, len(part) + 1)), into)

    @staticmethod
    def _store(part: list[str], ids: np.ndarray, ends: np.ndarray, into: dict) -> None:
        start, raw = 0, ids.tobytes()
        for w, end in zip(part, (4 * ends).tolist()):
            into[w] = raw[start:end]
            start = end

    def encode(self, text: list[str]) -> bytes:
        return b"".join(map(self.known.__getitem__, text))


_TOKENS: dict[str, WordTokens] = {}


def _tokens(path: str) -> WordTokens:
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def split_words(text: str) -> list[str]:
    """Words between ASCII white space; other white space is left to the tokenizer."""
    if not _OTHER_SPACE.search(text):
        return text.split()
    return _SPACE.split(text)


_SPACE = re.compile(r"[\x20\x09-\x0d]+")
#: What ``str.split`` takes for white space beyond that.
_OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def token_pieces(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document.

    A document is its ids and one end id (null text: the end id alone); only documents
    longer than ``capacity`` are cut, into pieces of ``capacity`` ids of which the last
    may be shorter.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        tokens = _tokens(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [split_words(t) for t in part.column("text").to_pylist()]
                tokens.learn(texts)
                at_row, piece, start, length, crc = [], [], [], [], []
                for i, t in enumerate(texts):
                    raw = tokens.encode(t) + end
                    for k, a in enumerate(range(0, len(raw), 4 * capacity)):
                        cut_out = raw[a : a + 4 * capacity]
                        at_row.append(i)
                        piece.append(k)
                        start.append(a // 4)
                        length.append(len(cut_out) // 4)
                        crc.append(zlib.crc32(cut_out))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(at_row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return rows.mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin of each length, placed in the given order.

    With N(g) open bins of residual gap g, a length s goes into the open bin that makes the
    sum of N(g)^2 smallest: a bin of gap g >= s takes N(g) down and N(g - s) up; bins without a gap are closed and
    do not count.  Of equal choices the tightest gap wins; a bin is opened only if no open one has room.
    """
    counts = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, used = np.empty(len(lengths), np.int64), 0
    for k, s in enumerate(lengths.tolist()):
        gaps = counts[s:capacity]
        after = counts[: capacity - s]
        # N(0) stays 0: a bin that is filled exactly only leaves its gap's count.
        change = np.where(gaps > 0, 2 * (after - gaps + 1), np.iinfo(np.int64).max)
        if s < capacity and gaps[0] > 0:
            change[0] = 1 - 2 * gaps[0]
        best = int(change.argmin()) if s < capacity else -1
        if best >= 0 and gaps[best] > 0:
            gap = s + best
            bin_ = open_bins[gap].pop()
            counts[gap] -= 1
        else:
            gap, bin_, used = capacity, used, used + 1
        rest = gap - s
        if rest:
            open_bins[rest].append(bin_)
            counts[rest] += 1
        out[k] = bin_
    return out


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Sum-of-squares packing of the lengths in falling order."""
    order = np.argsort(-lengths, kind="stable")
    out = np.empty(len(lengths), np.int64)
    out[order] = sum_of_squares(lengths[order], capacity)
    return out


def pack_documents(
    docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece.

    Pieces of full length are sequences of their own and never meet in a task.  The others are dealt by a hash of their content to
    shards of about ``shard_docs`` pieces, and each shard is packed on its own: memory per task does not grow with the
    input and a shard wastes at most its few open sequences.
    Null texts pack their end id; repeated rows are packed as often as they occur;
    an empty table gives an empty result; further columns are ignored.
    """
    pieces = cut(token_pieces(docs, tokenizer_path, doc_id, text, capacity))
    whole = pieces.where(F.col("length") == capacity)
    rest = pieces.where(F.col("length") < capacity)
    shards = max(1, math.ceil(rest.count() / shard_docs))
    dealt = rest.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int"))
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        bins = pack(pdf["length"].to_numpy(), capacity)
        shard = int(pdf["_shard"].iloc[0]) if len(pdf) else 0
        pdf["sequence_id"] = bins + (np.int64(shard) << 32)
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf.drop(columns="_shard")

    packed = dealt.groupBy("_shard").applyInPandas(
        run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    alone = (F.monotonically_increasing_id() + F.lit(WHOLE_IDS)).alias("sequence_id")
    return packed.union(whole.select(*pieces.columns, alone, F.lit(0).cast("long").alias("offset")))
