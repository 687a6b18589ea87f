"""Literal cases for results that were once wrong."""

from pyspark.sql import functions as F

from groundwork.operators import accounts, embedding, evaluation, fulltext, ingest, ordered, search, segment
from groundwork.session import scratch_dir
from groundwork.sources import sinks
from groundwork.streaming import ingest as streams


def test_recovery_keeps_other_messages(spark):
    docs = spark.createDataFrame(
        [(1, "FAILED", "too many pages"), (2, "PROCESSING", None), (3, "INDEXED", None)],
        "document_id int, status string, error_message string")
    found = {r.document_id: (r.status, r.error_message) for r in ingest.recover_interrupted(docs).collect()}
    assert found[1] == ("FAILED", "too many pages") and found[3] == ("INDEXED", None)
    assert found[2][0] == "FAILED" and found[2][1]


def test_repeated_vectors_set_one_row(spark):
    stored = spark.createDataFrame([(1, None), (2, [1.0])], "chunk_id int, embedding array<float>")
    vectors = spark.createDataFrame([(1, [1.0], 2), (1, [3.0], 1), (9, [1.0], 1)],
                                    "chunk_id int, embedding array<float>, written_at int")
    assert sorted(map(tuple, sinks.update_embeddings(stored, vectors).collect())) == [(1, [1.0]), (2, [1.0])]
    assert sorted(map(tuple, sinks.update_embeddings(stored, vectors.drop("written_at")).collect())) == [
        (1, [3.0]), (2, [1.0])]


def test_short_passages_are_found(spark):
    docs = spark.createDataFrame([(1, "a red green blue b c d e f g h i"), (2, "red"), (3, None), (4, "")],
                                 "doc_id int, text string")
    passages = spark.createDataFrame(
        [(1, "red green blue"), (2, "red"), (3, "ed gre"), (4, "green blue b c d e f g h"), (5, "blue x"), (6, None)],
        "item_id int, text string")
    found = sorted(map(tuple, evaluation.passages_in(passages, docs).collect()))
    assert found == [(1, 1), (2, 1), (2, 2), (3, 1), (4, 1)]


def test_first_append_drops_repeated_chunks(spark, tmp_path):
    fields = {f.name for f in sinks.CHUNK_SCHEMA.fields}
    some = {"string": "s", "bigint": 1, "int": 1, "boolean": True}
    row = {f.name: None if f.nullable else some[f.dataType.simpleString()] for f in sinks.CHUNK_SCHEMA.fields}
    row |= {"document_id": 1, "chunk_hash": "h"}
    assert {"document_id", "chunk_hash"} <= fields
    chunks = spark.createDataFrame([row, row], sinks.CHUNK_SCHEMA)
    path = str(tmp_path / "chunks")
    for _ in range(2):
        sinks.append_new_chunks(spark, chunks, path)
        assert sinks.read_chunks(spark, path).count() == 1


def test_authority_must_name_a_host(spark):
    urls = spark.createDataFrame([(1, "P", "https://host:abc/v1"), (2, "P", "https://"), (3, "P", "https://a_b/v1"),
                                  (4, "P", "https://ok.test:8/v1"), (5, "P", "https://no.test/v1")],
                                 "id int, provider string, url string")
    found = accounts.url_allowlist_audit(urls, {"P": ["ok.test"]}).collect()
    assert {r.id: r.verdict for r in found} == {
        1: "MISSING_HOST", 2: "MALFORMED", 3: "MISSING_HOST", 4: "ALLOWED", 5: "HOST_NOT_ALLOWED"}


def test_a_refused_claim_does_not_hold_the_address(spark):
    users = spark.createDataFrame([(1, "a@x", "A"), (2, "free@x", None)], "user_id int, email string, ext_subject string")
    logins = spark.createDataFrame([(1, "A", "free@x", 1), (2, "B", "free@x", 2), (3, "C", "free@x", 3)],
                                   "login_id int, ext_subject string, email string, ts int")
    found = {r.ext_subject: (r.action, r.reason) for r in accounts.merge_identities(users, logins).collect()}
    assert found == {"A": ("REJECT", "EMAIL_OF_OTHER_ACCOUNT"), "B": ("BIND", None), "C": ("REJECT", "CLAIMED_IN_BATCH")}


def test_only_bad_texts_fail_however_they_are_dealt(spark):
    def model(texts):
        if any("bad" in t for t in texts):
            raise ValueError("refused")
        return [[1.0, 2.0]] * len(texts)

    rows = [(n, None, t) for n, t in enumerate(["a", "bad", "c", " ", "e", "f", "bad too", None])]
    chunks = spark.createDataFrame(rows, "chunk_id int, title string, content string")
    for parts in (1, 3):
        out = embedding.embed_chunks(chunks.repartition(parts), model, dimensions=2, batch_size=4).collect()
        assert {r.chunk_id: r.problem for r in out if r.problem} == {
            1: "FAILED: refused", 3: "BLANK", 6: "FAILED: refused", 7: "BLANK"}
        assert {r.chunk_id for r in out if r.embedding == [1.0, 2.0]} == {0, 2, 4, 5}


def test_ids_that_start_alike_are_spread(spark, monkeypatch):
    ids = spark.range(500).select(F.format_string("doc-%05d", "id").alias("chunk_id"))
    seen = []
    number = ordered.number_rows
    monkeypatch.setattr(embedding, "number_rows", lambda rows, *rest: seen.append(rows) or number(rows, *rest))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = {r.chunk_id: r.batch for r in embedding.keyset_batches(ids, 16).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out == {f"doc-{n:05d}": n // 16 + 1 for n in range(500)}
    assert seen[0].select("_range").distinct().count() > 1


def test_questions_without_letters_are_found_as_they_are(spark):
    chunks = spark.createDataFrame([(1, 1, "t", "a!!!b"), (2, 2, "t", "a ! b"), (3, 3, "t", "a b")],
                                   "chunk_id int, document_id int, title string, content string")
    asked = spark.createDataFrame([(1, "???"), (2, "?"), (3, " "), (4, "????"), (5, None)], "query_id int, query string")
    found = fulltext.lexical_scan(chunks, asked, fulltext.Vocabulary([], []))
    got = sorted((r.query_id, r.chunk_id, r.lexical_score) for r in found.collect())
    assert got == [(1, 1, 30.0), (1, 2, 30.0), (2, 1, 30.0), (2, 2, 30.0), (2, 3, 30.0)]


def test_no_strategy_means_the_registered_one(spark):
    base = scratch_dir(spark, "unnamed-strategy")
    schema = "document_id long, text string, strategy string"
    spark.createDataFrame([(1, "1 - a\nx\n2 - b\ny", None)], schema).write.parquet(f"{base}/in")
    streams.incremental_ingest(streams.watch(spark, f"{base}/in", schema), f"{base}/chunks", f"{base}/state", 2).awaitTermination()
    assert {r.title for r in sinks.read_chunks(spark, f"{base}/chunks").collect()} == {"Pergunta 1 — a", "Pergunta 2 — b"}


def test_stored_chunks_are_embedded_and_searched(spark):
    """Ingest, embed, search over the chunk table itself, several chunks a document."""
    path = scratch_dir(spark, "stored")
    texts = ["".join(f"Planet {w} orbits slowly. " for w in [word] * 60) for word in ("mercury", "venus", "saturn")]
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id long, text string")
    chunks = segment.segment(docs, segment.recursive)
    sinks.append_new_chunks(spark, sinks.stored_chunk_rows(chunks), path, buckets=2)
    stored = sinks.read_chunks(spark, path)
    assert stored.count() == stored.select("chunk_id").distinct().count() > 3
    vectors = embedding.embed_chunks(embedding.missing_vectors(stored), dimensions=32).select("chunk_id", "embedding")
    full = sinks.update_embeddings(stored, vectors)
    assert embedding.missing_vectors(full).count() == 0
    (question,) = embedding.hashing_model(32)(["venus orbits"])
    asked = spark.createDataFrame([(1, "venus orbits", question.tolist())], "query_id int, query string, embedding array<float>")
    found = search.hybrid_search(asked, full, fulltext.Vocabulary([], []), vectors=full, dimensions=32)
    named = search.with_sources(found, full).collect()
    assert named and min(named, key=lambda r: r["rank"])["document_id"] == 1
