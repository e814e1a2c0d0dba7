"""Quality rules per document and host verdicts from shrunken failure rates (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.lineage import cut, with_small

from .text import SPACE, let, symbol_count, whole, words

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
MAX_SYMBOLS_PER_WORD_PCT = 10
MAX_DUP_LINES_PCT = 30
#: Share of failing documents, after shrinkage, above which a host is rejected.
MAX_HOST_RATE = 0.6

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _covered(hashes: Column) -> Column:
    """Positions covered by windows of three whose hash occurs twice or more."""
    paired = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def flagged(s: Column) -> Column:
        last = F.size(s) - 1
        kept = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) & (k > 0) | (F.get(s, k + 1)["h"] == x["h"]) & (k < last))
        return F.sort_array(F.transform(kept, lambda x: x["i"]))

    start = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
    step = lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(3), i - acc["at"])).alias("n"))
    return F.aggregate(let(paired, flagged), start, step, lambda acc: acc["n"])


def repeat_words(found: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text, the first time included.

    Windows are compared by a 64-bit hash.  A text whose window hashes are all distinct is settled without a sort.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(found) - 3), lambda i: F.xxhash64(F.get(found, i), F.get(found, i + 1), F.get(found, i + 2))
    )
    counted = let(windows, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(_covered(t)))
    return F.when(F.size(found) < 4, F.lit(0)).otherwise(counted)


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts the rules look at (null text: all zero), in the struct column ``_counts``."""
    filled = F.filter(F.split(whole(text), "\n", -1), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    lines = let(filled, lambda f: F.struct(F.size(f).alias("n"), (F.size(f) - F.size(F.array_distinct(f))).alias("dup")))
    found = let(words(text), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("rep")))
    # Computed per row into two structs first: fields of a struct column do not run its expression again.
    return docs.withColumn("_l", F.explode(F.array(lines))).withColumn("_w", F.explode(F.array(found))).withColumn(
        "_counts",
        F.struct(
            F.col("_w.n").cast("long").alias("n_words"),
            F.length(F.translate(whole(text), SPACE, "")).cast("long").alias("word_chars"),
            symbol_count(text).alias("n_symbols"),
            F.col("_l.n").cast("long").alias("n_lines"), F.col("_l.dup").cast("long").alias("n_dup_lines"),
            F.col("_w.rep").cast("long").alias("n_repeat_words"),
        ),
    ).drop("_l", "_w")


def base_failed() -> Column:
    c = lambda n: F.col(f"_counts.{n}")
    return (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PCT * c("n_words"))


def any_failed() -> Column:
    """A document fails if it breaks any rule; only the host's rate looks at the two rules beyond the base."""
    c = lambda n: F.col(f"_counts.{n}")
    return (
        base_failed() | (100 * c("n_symbols") > MAX_SYMBOLS_PER_WORD_PCT * c("n_words"))
        | (100 * c("n_dup_lines") > MAX_DUP_LINES_PCT * c("n_lines"))
    )


def host_verdicts(counted: DataFrame, host: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``host, n, failed, rate, verdict``: failure rates shrunk by an empirical beta prior.

    The prior's mean is the rate of all documents; its strength comes from how much
    more the hosts' rates vary than chance alone explains (method of moments).  A single
    host, or hosts that do not differ, are shrunk to the common rate.
    """
    per_host = cut(
        counted.groupBy(host).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(any_failed(), F.lit(1))).alias("failed"))
    )
    n, x = F.col("n").cast("double"), F.col("failed").cast("double")
    moments = per_host.agg(
        F.sum("n").cast("double").alias("_n"), F.sum("failed").cast("double").alias("_x"), F.count(F.lit(1)).cast("double").alias("_k"),
        F.sum(x * x / n).alias("_xx"),
    )
    mean = F.col("_x") / F.col("_n")
    spread = F.col("_xx") / F.col("_n") - mean * mean - mean * (1 - mean) * (F.col("_k") - 1) / F.col("_n")
    strength = F.least(F.lit(1e6), F.greatest(F.lit(1.0), mean * (1 - mean) / F.greatest(spread, F.lit(1e-12)) - 1))
    prior = moments.select((mean * strength).alias("_alpha"), strength.alias("_s"))
    # One row by construction of an aggregate without keys.
    rated = per_host.join(F.broadcast(prior)).withColumn("rate", (x + F.col("_alpha")) / (n + F.col("_s")))
    return rated.select(host, "n", "failed", "rate", (F.col("rate") <= max_rate).alias("verdict"))


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``docs`` with ``_counts``, ``base_failed`` and ``kept``.

    ``kept`` is false for a document that fails the base rules and otherwise its host's
    verdict.  Documents without a host (null) form a host of their own.  The counts are
    computed once and written; hosts are partial sums, so a host with a third of all
    documents is no larger to any task than another.  An empty table gives
    an empty result.  The names ``_counts``, ``_host``, ``base_failed`` and ``kept`` are
    reserved; other columns pass through.
    """
    counted = cut(document_counts(docs, text).withColumn("_host", F.struct(F.col(host).alias("host"))))
    verdicts = host_verdicts(counted, "_host", max_rate).select("_host", "verdict")
    judged = with_small(counted, verdicts, "_host")
    return judged.drop("_host").withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.col("verdict")).drop("verdict")
