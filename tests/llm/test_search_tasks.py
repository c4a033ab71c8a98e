"""How op 3's work is dealt out: a task prepares a shard once for several chunks of queries."""

from loomarray.llm import search


def test_task_parts():
    """Chunks that grow with the queries don't each prepare every shard again."""
    for chunks, shards, cores, most in ((8, 26, 6, 2), (64, 306, 6, 4), (64, 1, 6, 48), (1, 5, 8, 1), (0, 3, 8, 0), (5, 0, 8, 5)):
        parts = search.task_parts(chunks, shards, cores)
        assert len(parts) == most
        assert [c for p in parts for c in range(chunks)[p]] == list(range(chunks))
        assert all(0 < p.stop - p.start <= search.CHUNKS for p in parts)


def test_chunks_of_a_task(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 23}" for j in range(k % 17))) for k in range(120)], "doc_id long, text string")
    found = lambda: [tuple(r) for r in search.top_k(docs, docs.where("doc_id % 3 = 0"), k=4).orderBy("query_id", "rank").collect()]
    expected = found()
    monkeypatch.setattr(search, "CHUNK", 4)
    monkeypatch.setattr(search, "TASKS", 0)
    assert found() == expected and len(expected) > 100
