"""Mixing sources to target weights by exponential-key sampling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.lineage import cut, with_small

from .text import let, symbol_count, word_count

# Weights by the position of a source in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Share of all words that the mix holds, in per cent, and most copies of a source.
SHARE_PCT = 150
MAX_EPOCHS = 2
#: Slices of the sampling key; only the slice on the border of a budget is ranked.
SLICES = 1 << 16


def uniform(seed: int, *keys) -> Column:
    """Uniform in (0, 1) from the first 52 bits of an MD5 of the seed and the keys."""
    named = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    bits = F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def quality_weight(text: str, size: Column) -> Column:
    """1 for plain text, down to 0.1 for a text with a symbol in every fifth word or more."""
    return F.greatest(F.lit(0.1), 1 - 5 * symbol_count(text).cast("double") / F.greatest(size, F.lit(1)).cast("double"))


def source_targets(sized: DataFrame, source: str, weights=WEIGHTS, share_pct: int = SHARE_PCT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target``: shares of ``share_pct`` per cent of all words by weight.

    No target exceeds ``max_epochs`` times its source; what is over is shared by the
    weights of the rest until none is above.  Sorted by cap over weight, the capped
    sources come first, so the common level of the rest is the greatest level that any
    prefix of capped sources leaves.  The table has one row per source; it is the only
    thing ordered as a whole.
    """
    per_source = cut(sized.groupBy(source).agg(F.sum("size").alias("source_size")))
    order = Window.orderBy(F.col(source).asc_nulls_last())
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights))
    weighed = per_source.withColumn("_w", weight).withColumn("_cap", (F.col("source_size") * max_epochs).cast("double"))
    total = weighed.agg((F.sum("source_size").cast("double") * share_pct / 100).alias("_total"))
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), F.col(source).asc_nulls_last())
    prefixed = weighed.join(F.broadcast(total)).withColumns({
        "_before": F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_rest": F.sum("_w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)),
    })
    level = prefixed.agg(F.max((F.col("_total") - F.col("_before")) / F.col("_rest")).alias("_level"))
    return weighed.join(F.broadcast(level)).select(source, "source_size", F.least(F.col("_cap"), F.col("_w") * F.col("_level")).alias("target"))


def mix_sources(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 8,
    weights=WEIGHTS, share_pct: int = SHARE_PCT, max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies, taken``.

    A source takes ``floor(target / source_size)`` complete epochs.  The rest of its
    target is a sample without replacement: keys ``-ln(u) / w`` with a uniform of the id
    and the document's quality weight are sorted and sizes are summed along them;
    a document is in while at least half of it lies inside the budget, so each source
    ends within half a document of its target.  Documents are taken whole.  Sums per key slice find the slice that the
    budget ends in; slices before it are taken, later ones are not, and only that one is
    ranked, so a source with a third of all documents is never sorted in one task.

    Null texts have size 0 and are never taken; a null source is a source; ties of a key
    go by id, then by text hash, and equal rows are interchangeable; an empty table gives an empty result.
    The names of the added columns and those with a leading ``_`` are reserved; other columns pass through.
    """
    names = [c for c in docs.columns]
    key = let(word_count(text), lambda n: F.struct(n.alias("n"), (-F.log(uniform(seed, doc_id)) / quality_weight(text, n)).alias("k")))
    # A generated row keeps its values: filters and joins on the slice do not count the words again.
    keyed = (
        docs.withColumn("_m", F.explode(F.array(key))).withColumn("_source", F.struct(F.col(source).alias("s")))
        .withColumns({"size": F.col("_m.n"), "_key": F.col("_m.k"), "_slice": F.floor(F.col("_m.k") / (F.col("_m.k") + 1) * SLICES).cast("int")})
        .drop("_m")
    )
    slices = cut(keyed.groupBy("_source", "_slice").agg(F.sum("size").alias("size")))
    plain = slices.select(F.col("_source.s").alias("_s"), "size")
    targets = cut(source_targets(plain, "_s", weights, share_pct, max_epochs))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    budgets = targets.withColumn("_epochs", epochs).withColumn("_budget", F.col("target") - F.col("_epochs") * F.col("source_size"))
    along = Window.partitionBy("_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    borders = (
        slices.withColumn("_end", F.sum("size").over(along)).join(budgets.withColumn("_source", F.struct(F.col("_s").alias("s"))).select("_source", "_budget"), "_source")
        .where(F.col("_end") > F.col("_budget")).groupBy("_source").agg(F.min(F.struct("_slice", (F.col("_end") - F.col("size")).alias("before"))).alias("_b"))
    )
    plan = (
        budgets.withColumn("_source", F.struct(F.col("_s").alias("s"))).drop("_s").join(borders, "_source", "left")
        .select("_source", "source_size", "target", "_epochs", "_budget", F.col("_b._slice").alias("_border"), F.col("_b.before").alias("_before"))
    )
    planned = with_small(keyed, plan, "_source")
    out = [*names, "size", "source_size", "target", "copies"]
    # A source whose budget no slice exceeds (all of its words, or none at all) has no border.
    inside = F.when(F.col("_border").isNull(), F.col("_budget") > 0).otherwise(F.col("_slice") < F.col("_border"))
    settled = planned.where(F.col("_border").isNull() | (F.col("_slice") != F.col("_border"))).withColumn("copies", F.col("_epochs") + inside.cast("int"))
    ranked = Window.partitionBy("_source", "_slice").orderBy("_key", F.col(doc_id).asc_nulls_last(), F.xxhash64(F.col(text))).rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("_before") + F.sum("size").over(ranked) - F.col("size")
    border = planned.where(F.col("_slice") == F.col("_border")).withColumn(
        "copies", F.col("_epochs") + (start + F.col("size") / 2 <= F.col("_budget")).cast("int")
    )
    both = settled.select(*out).unionByName(border.select(*out))
    return both.withColumn("taken", (F.col("size") * F.col("copies")).cast("long"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``.

    A document without a word has no share in a mix of words and is left out.
    """
    names = docs.columns
    mixed = mix_sources(docs, **options).where("taken > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*names)
