"""Shards of the packing follow the pieces, and full pieces pass them by."""

from pointloom.llm import packing, queries


def test_long_documents_are_dealt_to_shards(spark):
    rows = [(i, "word " * (2048 * 3 + 500 + i)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_documents(docs, queries.tokenizer_path(), shard_docs=10).toPandas()
    whole, rest = got[got["length"] == packing.CAPACITY], got[got["length"] < packing.CAPACITY]
    assert len(whole) >= 90 and len(rest) == 30
    assert (whole["sequence_id"] >= packing.WHOLE_IDS).all() and whole["sequence_id"].is_unique and (whole["offset"] == 0).all()
    assert (rest["sequence_id"].to_numpy() >> 32).max() == 2 and not set(rest["sequence_id"]) & set(whole["sequence_id"])
    assert got.groupby("sequence_id")["length"].sum().max() <= packing.CAPACITY and not got.duplicated(["doc_id", "piece"]).any()
