"""Document fingerprints: Merkle trees over paragraphs and sections (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import WORD, held, let, place, whole

#: A paragraph whose hash is 0 modulo this ends a section, as an empty line does.
SECTION_MODULUS = 8
#: Words of a piece; the pieces of a paragraph estimate its likeness to another.
PIECE_WORDS = 4
#: Documents per block when neighbours in id order are looked up, and blocks at most (8 bytes each in a broadcast row).
BLOCK_DOCS = 400
MAX_BLOCKS = 65_536


def _pieces(paragraphs: Column) -> Column:
    """Distinct hashes of the pieces of some paragraphs: every run of four words, of shorter paragraphs all words.

    Runs begin at every word, so a word put in or taken out changes four of them at most.  A paragraph without
    words has no piece.
    """

    def runs(words: Column) -> Column:
        many = F.greatest(F.size(words) - PIECE_WORDS + 1, F.least(F.size(words), F.lit(1)))
        along = F.arrays_zip(*[F.slice(words, F.lit(1 + k), many).alias(f"w{k}") for k in range(PIECE_WORDS)])
        return F.transform(along, lambda run: F.xxhash64(run))

    hashes = F.transform(paragraphs, lambda p: let(F.regexp_extract_all(p, F.lit(WORD), F.lit(0)), runs))
    return F.array_distinct(F.flatten(hashes))


def tree(text: Column) -> Column:
    """Merkle tree of a text: ``root, sections<first, hash>, paragraphs, leaves``.

    Leaves are SHA-256 of the paragraphs (lines); a section ends with an empty line or
    with a paragraph whose hash says so, so an edit moves no other section's border; a
    section's hash covers its leaves and the root covers the sections.  Equal texts have
    equal roots; a null text is the empty one, with one empty paragraph.
    """

    def of_leaves(paragraphs: Column) -> Column:
        leaves = F.transform(paragraphs, lambda p: F.sha2(p, 256))
        return let(leaves, lambda h: let(_sections(paragraphs, h), lambda s: F.struct(
            F.sha2(F.array_join(F.transform(s, lambda x: x["hash"]), ""), 256).alias("root"),
            s.alias("sections"), paragraphs.alias("paragraphs"), h.alias("leaves"),
        )))

    return let(F.split(whole(text), "\n", -1), of_leaves)


def _sections(paragraphs: Column, leaves: Column) -> Column:
    """``first`` paragraph, ``size`` and ``hash`` of each section."""
    last = F.size(leaves) - 1
    # The first seven hex digits of a leaf decide; they are a bounded integer.
    ends = F.filter(
        F.sequence(F.lit(0), last),
        lambda i: (i == last) | (F.length(F.get(paragraphs, i)) == 0) | (F.conv(F.substring(F.get(leaves, i), 1, 7), 16, 10).cast("int") % SECTION_MODULUS == 0),
    )

    def spans(e: Column) -> Column:
        return F.transform(e, lambda end, k: let(
            F.when(k == 0, F.lit(0)).otherwise(F.get(e, k - 1) + 1),
            lambda first: F.struct(first.alias("first"), (end - first + 1).alias("size"), F.sha2(F.array_join(F.slice(leaves, first + 1, end - first + 1), ""), 256).alias("hash")),
        ))

    return let(ends, spans)


def differing(own: Column, other: Column) -> Column:
    """Indices of the paragraphs of ``own`` whose branch ``other`` lacks.

    Equal roots differ nowhere; sections that the other tree holds are skipped whole, and
    only the paragraphs of the rest are looked at.
    """
    def rest(other_sections: Column, other_leaves: Column) -> Column:
        open_sections = F.filter(own["sections"], lambda s: ~held(other_sections, s["hash"]))
        candidates = F.flatten(F.transform(open_sections, lambda s: F.sequence(s["first"], s["first"] + s["size"] - 1)))
        return F.filter(candidates, lambda i: ~held(other_leaves, F.get(own["leaves"], i)))

    sections = F.sort_array(F.transform(other["sections"], lambda s: s["hash"]))
    missing = let(sections, lambda s: let(F.sort_array(other["leaves"]), lambda h: rest(s, h)))
    return F.when(own["root"] == other["root"], F.array().cast("array<int>")).otherwise(missing)


def likeness(own: Column, other: Column) -> Column:
    """Likeness of two trees, 0 to 1: shared pieces over all pieces (Dice), 1 for equal roots.

    Paragraphs that both trees hold (equal paragraphs have equal leaves) are matched whole; only the others
    are compared piece by piece.  A piece is a run of four words, counted once a text.  Hash sets keep the
    work in proportion to the texts, however many paragraphs they have.
    """
    mine, theirs = own["paragraphs"], other["paragraphs"]
    both = F.size(_pieces(F.array_intersect(mine, theirs))).cast("double")

    def dice(a: Column, b: Column, shared: Column) -> Column:
        total = 2 * shared + F.size(a) + F.size(b)
        return F.when(total > 0, 2 * (shared + F.size(F.array_intersect(a, b))) / total).otherwise(F.lit(0.0))

    only = lambda x, y: _pieces(F.array_except(x, y))
    compared = let(only(mine, theirs), lambda a: let(only(theirs, mine), lambda b: let(both, lambda shared: dice(a, b, shared))))
    return F.when(own["root"] == other["root"], F.lit(1.0)).otherwise(compared)


def with_tree(docs: DataFrame, text: str = "text", name: str = "tree") -> DataFrame:
    """``docs`` with the Merkle tree of each text (null: of the empty text)."""
    return docs.withColumn(name, F.explode(F.array(tree(F.col(text)))))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``doc_id, text, next_text``: the text of the next document in descending id (after the last: the first).

    Ids are cut into blocks of about ``block_docs`` documents at approximate quantiles (at most ``MAX_BLOCKS`` ids in
    one broadcast row; larger tables have longer blocks, which sort with spilling); the largest id of each block is
    also given to the block above, which then holds every neighbour it needs, so no task orders more than a
    block.  Repeated ids go by their text's hash, null ids come last; null texts are empty.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"), F.xxhash64(whole(text)).alias("_tie"))
    counted = docs.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    blocks = max(1, min(MAX_BLOCKS, counted // block_docs))
    cuts = docs.agg(F.percentile_approx(doc_id, [k / blocks for k in range(1, blocks)] or [0.5], 10 * blocks + 100).alias("q")).first()["q"]
    cuts = docs.sparkSession.createDataFrame([(sorted({int(c) for c in cuts or []}),)], "_cuts array<long>")
    # Block 0 holds null ids, higher blocks higher ids.
    block = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(1 + place(F.col("_cuts"), F.col("doc_id"), upto=True))
    placed = rows.join(F.broadcast(cuts)).withColumn("_block", block).drop("_cuts")
    heads = placed.groupBy("_block").agg(F.max(F.struct("doc_id", "_tie")).alias("_head"))
    # One row per block: bounded by MAX_BLOCKS.
    ordered = heads.select("_block", "_head", F.lead("_block").over(Window.orderBy("_block")).alias("_up"), F.max("_block").over(Window.partitionBy(F.lit(1))).alias("_top"), F.min("_block").over(Window.partitionBy(F.lit(1))).alias("_bottom"))
    wanted = F.broadcast(ordered.select("_block", "_head", F.coalesce("_up", "_bottom").alias("_to")))
    seen = placed.join(wanted, "_block")
    is_head = F.struct("doc_id", "_tie").eqNullSafe(F.col("_head"))
    targets = F.when(is_head, F.array(F.struct(F.col("_block").alias("b"), F.lit(0).alias("guest")), F.struct(F.col("_to").alias("b"), F.lit(1).alias("guest")))).otherwise(
        F.array(F.struct(F.col("_block").alias("b"), F.lit(0).alias("guest")))
    )
    dealt = seen.select("doc_id", "text", "_tie", F.explode(targets).alias("t")).select("doc_id", "text", "_tie", "t.*")
    # Within a block ids fall; the guest, the head of the block below (or of the topmost, after the last), comes last.
    along = Window.partitionBy("b").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("_tie").desc())
    return dealt.withColumn("next_text", F.lead("text").over(along)).where("guest = 0").select("doc_id", "text", "next_text")


def edited(text: Column, other: Column) -> Column:
    """The text with its last third (in code points) replaced by as much of the other's beginning (or all of it)."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(other, F.lit(1), third))


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and likenesses to that and to the next text.

    A single document is its own next.  Very long texts and texts of very many paragraphs cost in proportion to
    their length.  Empty texts have the fingerprint of the empty text; an empty table
    gives an empty result; further columns are ignored.
    """
    pairs = with_next(docs, doc_id, text)
    pairs = pairs.withColumn("edited_text", F.explode(F.array(edited(F.col("text"), F.col("next_text")))))
    for name in ("text", "edited_text", "next_text"):
        pairs = with_tree(pairs, name, f"_{name}")
    own, changed, after = F.col("_text"), F.col("_edited_text"), F.col("_next_text")
    return pairs.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited_text"), 256).alias("edited_sha256"),
        own["root"].alias("fingerprint"), changed["root"].alias("edited_fingerprint"),
        likeness(own, changed).alias("near_edited"), likeness(own, after).alias("near_next"),
        F.size(differing(own, changed)).alias("n_differing"),
    )
