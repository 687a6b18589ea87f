"""Queries: sources and sinks, cleaning, duplicates, segmenters, embedding upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions import lexicon as lex
from groundwork.functions import text as tx
from groundwork.operators import audit, embedding, ingest, segment
from groundwork.operators.ordered import number_rows
from groundwork.plans import duck
from groundwork.plans.registry import query
from groundwork.plans.views import Inputs
from groundwork.session import scratch_dir, settle
from groundwork.sources import files, sinks
from groundwork.sources.tables import scan

DIMENSIONS = duck.DIMENSIONS
MAX_PAGES = 6

# -- sources and sinks ---------------------------------------------------------------------


@query("scan_documents", "SELECT doc_id, lang, source, n_chars FROM documents")
def scan_documents(i: Inputs) -> DataFrame:
    return scan(i.spark, f"{i.folder}/documents.parquet", ["doc_id", "lang", "source", "n_chars"])


@query(
    "intake_manifest",
    """SELECT file_name, sha256(body) AS file_hash, strlen(body)::BIGINT AS file_size,
              sha256(body) || '.html' AS storage_path
       FROM (SELECT url AS file_name, html AS body FROM pages
             UNION ALL SELECT 'document-' || doc_id, text FROM documents)
       WHERE body LIKE '<!DOC%'""",
)
def intake_manifest(i: Inputs) -> DataFrame:
    pages = i.pages.select(F.col("url").alias("file_name"), F.col("html").alias("body"))
    texts = i.documents.select(
        F.concat(F.lit("document-"), F.col("doc_id").cast("string")).alias("file_name"),
        F.col("text").alias("body"),
    )
    both = pages.unionByName(texts).select("file_name", F.encode("body", "UTF-8").alias("content"))
    return files.intake_manifest(both, b"<!DOC", ".html")


def rec_docs(i: Inputs) -> DataFrame:
    return i.documents.select(F.col("doc_id").alias("document_id"), "text")


_TRIMMED = duck.trim("text")
REC_VIEWS = {
    "rec_text": f"SELECT doc_id AS document_id, {_TRIMMED} AS t, length({_TRIMMED}) AS n FROM documents",
}


def windows_of(table: str) -> str:
    """Recursive window bounds over ``table(document_id, t, n)``."""
    back = "reverse(substr(t, p0 + 501, 500))"
    shift = rf"coalesce(nullif(length(regexp_extract({back}, '^[^\n.;!]*[\n.;!]')), 0) - 1, 0)"
    end = f"CASE WHEN p0 + 1000 >= n THEN n ELSE p0 + 1000 - ({shift}) END"
    return f"""
    SELECT document_id, t, n, CAST(0 AS BIGINT) AS p0, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS e, n = 0 AS done FROM {table}
    UNION ALL
    SELECT document_id, t, n, CASE WHEN e2 - 150 <= p0 THEN e2 ELSE e2 - 150 END, p0, e2, e2 >= n
    FROM (SELECT document_id, t, n, p0, {end} AS e2 FROM {table}_w WHERE NOT done)"""


def numbered_windows(table: str) -> str:
    content = duck.trim("substr(t, s + 1, e - s)")
    return f"""
    SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY s) AS sequence_number,
           content, s AS char_start, e AS char_end
    FROM (SELECT document_id, s, e, {content} AS content FROM {table}_w WHERE s IS NOT NULL)
    WHERE content <> ''"""


REC_VIEWS["rec_text_w"] = windows_of("rec_text")
REC_VIEWS["rec_chunks"] = numbered_windows("rec_text")


@query(
    "write_chunks",
    """SELECT document_id, sequence_number::INT AS sequence_number, sha256(content) AS chunk_hash,
              'Seção ' || sequence_number AS title, content, embedding IS NULL AS not_embedded
       FROM (SELECT *, NULL AS embedding,
                    row_number() OVER (PARTITION BY document_id, content ORDER BY sequence_number) AS rn
             FROM rec_chunks) WHERE rn = 1""",
    REC_VIEWS,
)
def write_chunks(i: Inputs) -> DataFrame:
    path = scratch_dir(i.spark, "chunks")
    chunks = ingest.dedupe_chunks(segment.segment(rec_docs(i), segment.recursive))
    rows = settle(sinks.stored_chunk_rows(chunks), "cut-chunks")
    sinks.append_new_chunks(i.spark, rows, path, buckets=8)
    sinks.append_new_chunks(i.spark, rows, path, buckets=8)  # finds nothing new
    return sinks.read_chunks(i.spark, path).select(
        "document_id", "sequence_number", "chunk_hash", "title", "content",
        F.col("embedding").isNull().alias("not_embedded"),
    )


@query(
    "replace_document_chunks",
    """SELECT chunk_id, document_id, content FROM chunk_docs
       WHERE document_id NOT IN (SELECT document_id FROM doc_catalog WHERE status = 'FAILED')
       UNION ALL
       SELECT chunk_id, document_id, 'again: ' || content FROM chunk_docs
       WHERE document_id IN (SELECT document_id FROM doc_catalog WHERE status = 'FAILED')""",
)
def replace_document_chunks(i: Inputs) -> DataFrame:
    """Failed documents are ingested again over a chunk table on disk; only their folders are written."""
    path = scratch_dir(i.spark, "chunks")
    failed = i.doc_catalog.where(F.col("status") == "FAILED").select("document_id")
    stored = i.chunk_docs.join(failed.withColumn("again", F.lit(True)), "document_id", "left").withColumn(
        "hash", F.sha2("content", 256))
    content = F.concat(F.lit("again: "), "content")
    shape = ["document_id", F.col("chunk_id").cast("string").alias("chunk_id"), F.col("hash").alias("chunk_hash"),
             "sequence_number", "title", "content", F.lit(None).cast("string").alias("metadata"),
             F.lit(None).cast("array<float>").alias("embedding")]
    sinks.write_chunks(stored.select(*shape), path, buckets=8)
    fresh = stored.where("again").withColumn("content", content).select(*shape)
    sinks.replace_documents(i.spark, path, failed, fresh, buckets=8)
    return sinks.read_chunks(i.spark, path).select(F.col("chunk_id").cast("long").alias("chunk_id"), "document_id", "content")


@query(
    "update_embeddings",
    """SELECT c.chunk_id, c.document_id, len(coalesce(n.embedding, c.embedding)) AS dimensions,
              coalesce(n.embedding, c.embedding)[1]::DOUBLE AS first_value
       FROM vec_chunks c LEFT JOIN (SELECT chunk_id, [0.5::FLOAT, 0.25::FLOAT] AS embedding
         FROM vec_chunks WHERE embedding IS NULL) n USING (chunk_id)""",
)
def update_embeddings(i: Inputs) -> DataFrame:
    new = embedding.missing_vectors(i.vec_chunks).where(F.col("embedding").isNull()).select(
        "chunk_id", F.array(F.lit(0.5), F.lit(0.25)).cast("array<float>").alias("embedding")
    )
    updated = sinks.update_embeddings(i.vec_chunks, new)
    return updated.select(
        "chunk_id", "document_id", F.size("embedding").cast("long").alias("dimensions"),
        F.col("embedding")[0].cast("double").alias("first_value"),
    )


# -- cleaning and duplicates ---------------------------------------------------------------

_CLEAN = duck.trim(r"regexp_replace(text, '\r\n?', chr(10), 'g')")


@query("clean_pages", f"SELECT document_id, page_no, {_CLEAN} AS text FROM turn_pages")
def clean_pages(i: Inputs) -> DataFrame:
    return ingest.clean_pages(i.turn_pages)


@query(
    "assemble_full_text",
    f"""SELECT document_id, string_agg({_CLEAN} || chr(10) || chr(10), '' ORDER BY page_no) AS text,
               count(*)::INT AS total_pages FROM turn_pages GROUP BY document_id""",
)
def assemble_full_text(i: Inputs) -> DataFrame:
    return ingest.assemble_full_text(i.turn_pages).select("document_id", "text", "total_pages")


@query(
    "reject_oversized_docs",
    f"""SELECT document_id, count(*) AS pages,
               CASE WHEN count(*) > {MAX_PAGES} THEN 'FAILED' ELSE 'ACCEPTED' END AS state,
               CASE WHEN count(*) > {MAX_PAGES} THEN 'The PDF has ' || count(*) || ' pages; the maximum allowed is {MAX_PAGES}' END AS reason
        FROM turn_pages GROUP BY document_id""",
)
def reject_oversized_docs(i: Inputs) -> DataFrame:
    return ingest.reject_oversized_docs(i.turn_pages, MAX_PAGES)


def _shown(x: str) -> str:
    return duck.trim(rf"regexp_replace(regexp_replace({x}, '[\p{{Cc}}\p{{Cf}}]', ' ', 'g'), '\s+', ' ', 'g')")


def _cut(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN {duck.trim(f'left({x}, {n})')} ELSE {x} END"


_SEGMENT = r"regexp_replace(raw, '(?s)^.*[/\\]', '')"


@query(
    "sanitize_titles",
    f"""SELECT origin, id, CASE WHEN name IN ('', '.', '..') THEN 'document.pdf' ELSE {_cut("name", 200)} END AS file_name,
               CASE WHEN title <> '' THEN {_cut("title", 255)}
                    WHEN name NOT IN ('', '.', '..') THEN {_cut("name", 200)} ELSE 'document.pdf' END AS title
        FROM (SELECT origin, id, {_shown(_SEGMENT)} AS name, {_shown("t")} AS title
              FROM (SELECT 'page' AS origin, page_id AS id, url AS raw, '' AS t FROM pages
                    UNION ALL SELECT 'document', doc_id, source || '/', text FROM documents))""",
)
def sanitize_titles(i: Inputs) -> DataFrame:
    pages = i.pages.select(
        F.lit("page").alias("origin"), F.col("page_id").alias("id"), F.col("url").alias("raw"), F.lit("").alias("t")
    )
    texts = i.documents.select(
        F.lit("document").alias("origin"), F.col("doc_id").alias("id"),
        F.concat("source", F.lit("/")).alias("raw"), F.col("text").alias("t"),
    )
    named = pages.unionByName(texts).withColumn("file_name", tx.file_name(F.col("raw")))
    return named.select(
        "origin", "id", "file_name", tx.document_title(F.col("t"), F.col("file_name")).alias("title")
    )


@query(
    "classify_uploads",
    """SELECT upload_id, u.file_hash, s.document_id,
              CASE WHEN s.status = 'INDEXED' THEN 'ALREADY_INDEXED'
                   WHEN s.status = 'PROCESSING' OR rn > 1 THEN 'ALREADY_PROCESSING' ELSE 'QUEUED' END AS outcome,
              CASE WHEN s.status IN ('INDEXED', 'PROCESSING') OR rn > 1 THEN 'REUSE'
                   WHEN s.status IS NULL THEN 'CREATE' ELSE 'RESET' END AS action
       FROM (SELECT doc_id AS upload_id, sha256(text) AS file_hash,
                    row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) u
       LEFT JOIN (SELECT file_hash, min(document_id) AS document_id, arg_min(status, document_id) AS status
                  FROM doc_catalog WHERE document_id IN (SELECT doc_id FROM labels) GROUP BY file_hash) s
         ON s.file_hash = u.file_hash""",
)
def classify_uploads(i: Inputs) -> DataFrame:
    uploads = i.documents.select(F.col("doc_id").alias("upload_id"), F.sha2("text", 256).alias("file_hash"))
    labelled = i.labels.select(F.col("doc_id").alias("document_id"))
    held = i.doc_catalog.join(labelled, "document_id", "left_semi")
    stored = held.groupBy("file_hash").agg(
        F.min("document_id").alias("document_id"), F.min_by("status", "document_id").alias("status")
    )
    return ingest.classify_uploads(uploads, stored)


@query(
    "dedupe_files",
    """SELECT document_id, file_hash FROM (
         SELECT doc_id AS document_id, sha256(text) AS file_hash,
                row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
)
def dedupe_files(i: Inputs) -> DataFrame:
    return ingest.dedupe_files(rec_docs(i)).select("document_id", "file_hash")


@query("chunk_hash", "SELECT chunk_id, coalesce(sha256(content), '') AS chunk_hash FROM chunk_docs")
def chunk_hash(i: Inputs) -> DataFrame:
    return i.chunk_docs.select("chunk_id", tx.chunk_hash(F.col("content")).alias("chunk_hash"))


_FIRST_LINES = f"""SELECT document_id, sequence_number, content, chunk_hash FROM (
    SELECT *, row_number() OVER (PARTITION BY document_id, chunk_hash ORDER BY sequence_number) AS rn
    FROM line_chunks WHERE NOT {duck.blank("content")}) WHERE rn = 1"""


@query("dedupe_chunks", _FIRST_LINES)
def dedupe_chunks(i: Inputs) -> DataFrame:
    return ingest.dedupe_chunks(i.line_chunks)


@query(
    "new_chunks_only",
    """SELECT * FROM first_lines f WHERE NOT EXISTS (
         SELECT 1 FROM line_chunks s JOIN labels l ON l.doc_id = s.document_id
         WHERE s.document_id = f.document_id AND s.chunk_hash = f.chunk_hash AND l.quality = 1)""",
    {"first_lines": _FIRST_LINES},
)
def new_chunks_only(i: Inputs) -> DataFrame:
    good = i.labels.where("quality = 1").select(F.col("doc_id").alias("document_id"))
    stored = i.line_chunks.join(good, "document_id", "left_semi")
    return ingest.new_chunks_only(i.line_chunks, stored).select(
        "document_id", "sequence_number", "content", "chunk_hash"
    )


@query(
    "truncate_titles",
    r"""SELECT doc_id, CASE WHEN length(text) > 500 THEN regexp_replace(left(text, 499), '\s+$', '') || '…'
                            ELSE text END AS title FROM documents""",
)
def truncate_titles(i: Inputs) -> DataFrame:
    return i.documents.select("doc_id", tx.truncate_title(F.col("text")).alias("title"))


@query(
    "chunk_metadata_json",
    """SELECT document_id, sequence_number::INT AS sequence_number, 1 AS page, 'RECURSIVE' AS strategy,
              char_start::INT AS char_start, char_end::INT AS char_end, false AS has_question
       FROM rec_chunks""",
    REC_VIEWS,
)
def chunk_metadata_json(i: Inputs) -> DataFrame:
    stored = segment.segment(rec_docs(i), segment.recursive).withColumn("json", segment.chunk_metadata())
    read = "page int, strategy string, charStart int, charEnd int"
    return stored.withColumn("m", F.from_json("json", read)).select(
        "document_id", "sequence_number", "m.page", "m.strategy", F.col("m.charStart").alias("char_start"),
        F.col("m.charEnd").alias("char_end"), F.contains("json", F.lit("question")).alias("has_question"),
    )


@query(
    "ingestion_status",
    f"""SELECT document_id, CASE WHEN count(*) > {MAX_PAGES} THEN 'FAILED' ELSE 'INDEXED' END AS status,
               CASE WHEN count(*) <= {MAX_PAGES} THEN count(*) END AS total_pages,
               CASE WHEN count(*) <= {MAX_PAGES} THEN count(*) ELSE 0 END AS chunks,
               CASE WHEN count(*) > {MAX_PAGES} THEN 'The PDF has ' || count(*) || ' pages; the maximum allowed is {MAX_PAGES}' END AS error_message
        FROM turn_pages GROUP BY document_id""",
)
def ingestion_status(i: Inputs) -> DataFrame:
    verdict = ingest.reject_oversized_docs(i.turn_pages, MAX_PAGES)
    return ingest.ingestion_status(verdict, i.qa_docs.transform(lambda d: segment.segment(d, segment.structured_qa)))


@query(
    "recover_interrupted",
    f"""SELECT document_id, CASE WHEN status = 'PROCESSING' THEN 'FAILED' ELSE status END AS status,
               CASE WHEN status = 'PROCESSING' THEN '{lex.INTERRUPTED_MESSAGE}'
                    WHEN status = 'FAILED' THEN 'pages of ' || title END AS error_message,
               status = 'PROCESSING' AS recovered FROM doc_catalog""",
)
def recover_interrupted(i: Inputs) -> DataFrame:
    message = F.when(F.col("status") == "FAILED", F.concat(F.lit("pages of "), "title"))
    return ingest.recover_interrupted(
        i.doc_catalog.select("document_id", "status", message.alias("error_message")))


@query(
    "reprocess_plan",
    """SELECT r.doc_id AS document_id,
              CASE WHEN d.status IS NULL THEN 'NOT_FOUND' WHEN d.status <> 'FAILED' THEN 'NOT_FAILED'
                   WHEN f.storage_path IS NULL THEN 'FILE_MISSING' ELSE 'QUEUED' END AS outcome
       FROM (SELECT doc_id FROM documents UNION ALL SELECT -1 - item_id FROM benchmark) r
       LEFT JOIN doc_catalog d ON d.document_id = r.doc_id
       LEFT JOIN stored_files f ON f.storage_path = d.storage_path""",
)
def reprocess_plan(i: Inputs) -> DataFrame:
    known = i.documents.select(F.col("doc_id").alias("document_id"))
    unknown = i.benchmark.select((F.lit(-1) - F.col("item_id")).alias("document_id"))
    return ingest.reprocess_plan(known.unionByName(unknown), i.doc_catalog, i.stored_files)


# -- segmenters ----------------------------------------------------------------------------


def _headed_chunks(table: str, heading: str, cut: str) -> str:
    """Pieces of ``table`` from heading to heading, in DuckDB's regular expressions."""
    return f"""
    SELECT document_id, CAST(ord - 1 AS INT) AS sequence_number, item AS raw
    FROM (SELECT document_id, regexp_replace(text, '{cut}', chr(1) || '\\1', 'g') AS marked
          FROM {table} WHERE regexp_matches(text, '{heading}')) m,
         unnest(string_split(marked, chr(1))) WITH ORDINALITY AS t(item, ord)
    WHERE ord > 1"""


_QA = r"(?m)^(\d{1,4})\s*[—–-]\s*(.+)"
_QA_CUT = r"(?m)^(\d{1,4}\s*[—–-]\s*.+)"
_LAW = r"(?mi)^(?:art(?:igo|\.)?\s*(\d+[A-Za-z\-]*))"
_LAW_CUT = r"(?mi)^(art(?:igo|\.)?\s*\d+[A-Za-z\-]*)"


def _qa_columns(strategy: bool = False) -> str:
    number = f"regexp_extract(raw, '{_QA}', 1)"
    title = f"'Pergunta ' || {number} || ' — ' || {duck.trim(f'''regexp_extract(raw, '{_QA}', 2)''')}"
    return f"""document_id, sequence_number, {title} AS title, {duck.trim("raw")} AS content,
               {number}::INT AS question_number"""


def _law_columns() -> str:
    number = f"regexp_extract(raw, '{_LAW}', 1)"
    return f"""document_id, sequence_number, 'Artigo ' || {number} AS title, {duck.trim("raw")} AS content,
               {number} AS article_number"""


@query(
    "segment_structured_qa",
    f"SELECT {_qa_columns()} FROM qa_pieces",
    {"qa_pieces": _headed_chunks("qa_docs", _QA, _QA_CUT)},
)
def segment_structured_qa(i: Inputs) -> DataFrame:
    return segment.segment(i.qa_docs, segment.structured_qa).select(
        "document_id", "sequence_number", "title", "content", "question_number"
    )


@query(
    "segment_legal_sections",
    f"SELECT {_law_columns()} FROM law_pieces",
    {"law_pieces": _headed_chunks("law_docs", _LAW, _LAW_CUT)},
)
def segment_legal_sections(i: Inputs) -> DataFrame:
    return segment.segment(i.law_docs, segment.legal_sections).select(
        "document_id", "sequence_number", "title", "content", "article_number"
    )


@query(
    "segment_recursive",
    """SELECT document_id, sequence_number::INT AS sequence_number, 'Seção ' || sequence_number AS title, content,
              char_start::INT AS char_start, char_end::INT AS char_end FROM rec_chunks""",
    REC_VIEWS,
)
def segment_recursive(i: Inputs) -> DataFrame:
    return segment.segment(rec_docs(i), segment.recursive).select(
        "document_id", "sequence_number", "title", "content", "char_start", "char_end"
    )


_MIXED_VIEWS = {
    "mixed_qa": f"SELECT document_id, text FROM mixed_docs WHERE strategy = 'STRUCTURED_QA' AND regexp_matches(text, '{_QA}')",
    "mixed_law": f"SELECT document_id, text FROM mixed_docs WHERE strategy = 'LEGAL_SECTION' AND regexp_matches(text, '{_LAW}')",
    "mixed_text": f"""SELECT document_id, {duck.trim("text")} AS t, length({duck.trim("text")}) AS n FROM mixed_docs
        WHERE NOT (coalesce(strategy, '') = 'STRUCTURED_QA' AND regexp_matches(text, '{_QA}'))
          AND NOT (coalesce(strategy, '') = 'LEGAL_SECTION' AND regexp_matches(text, '{_LAW}'))""",
    "mixed_text_w": windows_of("mixed_text"),
    "mixed_windows": numbered_windows("mixed_text"),
    "mixed_qa_pieces": _headed_chunks("mixed_qa", _QA, _QA_CUT),
    "mixed_law_pieces": _headed_chunks("mixed_law", _LAW, _LAW_CUT),
}


@query(
    "segment_by_strategy",
    f"""SELECT document_id, sequence_number, title, content, 'STRUCTURED_QA' AS strategy FROM (SELECT {_qa_columns()} FROM mixed_qa_pieces)
        UNION ALL SELECT document_id, sequence_number, title, content, 'LEGAL_SECTION' FROM (SELECT {_law_columns()} FROM mixed_law_pieces)
        UNION ALL SELECT document_id, sequence_number::INT, 'Seção ' || sequence_number, content, 'RECURSIVE' FROM mixed_windows""",
    _MIXED_VIEWS,
)
def segment_by_strategy(i: Inputs) -> DataFrame:
    return segment.segment_by_strategy(i.mixed_docs).select(
        "document_id", "sequence_number", "title", "content", "strategy"
    )


@query(
    "resolve_page",
    f"""SELECT p.document_id, p.page_no AS own_page,
               (SELECT min(q.page_no) FROM turn_pages q
                WHERE q.document_id = p.document_id AND contains({duck.trim("q.text")}, left({duck.trim("p.text")}, 50))) AS page
        FROM turn_pages p""",
)
def resolve_page(i: Inputs) -> DataFrame:
    full = ingest.assemble_full_text(i.turn_pages)
    own = full.select("document_id", "pages", F.explode("pages").alias("own"))
    return own.select(
        "document_id", F.col("own.page_no").alias("own_page"),
        segment.first_page_with(F.col("own.text"), F.col("pages")).alias("page"),
    )


@query(
    "split_words",
    r"""SELECT conv_id, turn, CAST(ord AS INT) AS word_no, item AS word FROM conversations,
               unnest(regexp_extract_all(text, '[^\s]*\s|[^\s]+$')) WITH ORDINALITY AS t(item, ord)""",
)
def split_words(i: Inputs) -> DataFrame:
    pieces = i.conversations.select("conv_id", "turn", F.posexplode(tx.split_words(F.col("text"))).alias("p", "word"))
    return pieces.select("conv_id", "turn", (F.col("p") + 1).alias("word_no"), "word")


# -- embedding upkeep ----------------------------------------------------------------------


@query(
    "embedding_text",
    f"SELECT chunk_id, {duck.trim('title')} || chr(10) || {duck.trim('content')} AS text FROM chunk_docs",
)
def embedding_text(i: Inputs) -> DataFrame:
    return i.chunk_docs.select("chunk_id", tx.embedding_text(F.col("title"), F.col("content")).alias("text"))


@query(
    "validate_vectors",
    f"""SELECT chunk_id, CASE WHEN embedding IS NULL OR len(embedding) <> {DIMENSIONS} THEN 'WRONG_DIMENSION'
               WHEN len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0 THEN 'NOT_FINITE'
               WHEN len(list_filter(embedding, lambda x: x <> 0)) = 0 THEN 'ZERO_MAGNITUDE' ELSE 'OK' END AS problem
        FROM vec_chunks""",
)
def validate_vectors(i: Inputs) -> DataFrame:
    return embedding.validate_vectors(i.vec_chunks, DIMENSIONS).select("chunk_id", "problem")


@query("missing_vectors", f"SELECT chunk_id, document_id FROM vec_chunks WHERE {duck.missing('embedding')}")
def missing_vectors(i: Inputs) -> DataFrame:
    return embedding.missing_vectors(i.vec_chunks).select("chunk_id", "document_id")


@query(
    "keyset_batches",
    "SELECT chunk_id, ceil(row_number() OVER (ORDER BY chunk_id) / 16)::BIGINT AS batch FROM vec_chunks",
)
def keyset_batches(i: Inputs) -> DataFrame:
    return embedding.keyset_batches(i.vec_chunks.select("chunk_id"))


@query(
    "embedding_progress",
    f"""SELECT document_id, count(*) AS total, count(*) FILTER (NOT {duck.missing('embedding')}) AS embedded,
               count(*) FILTER (NOT {duck.missing('embedding')}) >= count(*) AS complete
        FROM vec_chunks GROUP BY document_id""",
)
def embedding_progress(i: Inputs) -> DataFrame:
    return embedding.embedding_progress(i.vec_chunks)


def _vector_columns(vector: str) -> str:
    return f"len({vector}) AS dimensions, round(list_sum(list_transform({vector}, lambda x, i: x::DOUBLE * i)), 4) AS weighted"


_SLOTS = f"SELECT chunk_id, {duck.hashed_words('content')} AS slots FROM chunk_docs"
_VECTORS = duck.unit_vectors("doc_slots")


def _fingerprint(vector) -> list:
    weighted = F.aggregate(
        F.transform(vector, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x
    )
    return [F.size(vector).cast("long").alias("dimensions"), F.round(weighted, 4).alias("weighted")]


@query(
    "hash_embedding",
    f"SELECT chunk_id, {_vector_columns('embedding')} FROM doc_vectors",
    {"doc_slots": _SLOTS, "doc_vectors": _VECTORS},
)
def hash_embedding(i: Inputs) -> DataFrame:
    embedded = embedding.hash_embedding(i.chunk_docs, F.col("content"), DIMENSIONS)
    return embedded.select("chunk_id", *_fingerprint(F.col("embedding")))


_TITLED = f"SELECT chunk_id, {duck.hashed_words('title || chr(10) || content')} AS slots FROM chunk_docs"


@query(
    "embed_chunks",
    f"SELECT chunk_id, {_vector_columns('embedding')}, NULL::STRING AS problem FROM titled_vectors",
    {"titled_slots": _TITLED, "titled_vectors": _VECTORS.replace("doc_slots", "titled_slots")},
)
def embed_chunks(i: Inputs) -> DataFrame:
    embedded = embedding.embed_chunks(i.chunk_docs, dimensions=DIMENSIONS)
    return embedded.select("chunk_id", *_fingerprint(F.col("embedding")), "problem")


@query(
    "estimate_tokens",
    """SELECT source AS batch_id, count(*) AS texts, sum(greatest(1, ceil(length(text) / 4)))::BIGINT AS tokens
       FROM documents GROUP BY source""",
)
def estimate_tokens(i: Inputs) -> DataFrame:
    return audit.estimate_batch_tokens(i.documents.select(F.col("source").alias("batch_id"), "text"))


# Every event stands for one call that sent the document it points at.
_SENT = """SELECT ts // 3600000000 AS minute, count(*) AS texts,
                  sum(greatest(1, ceil(length(d.text) / 4)))::BIGINT AS tokens, ts // 600000000 AS batch
           FROM requests e JOIN documents d ON d.doc_id = e.event_id GROUP BY ALL"""


@query(
    "quota_usage",
    """SELECT minute, sum(least(texts, 4))::BIGINT AS texts, sum(least(tokens, 2500))::BIGINT AS tokens,
              sum(least(texts, 4)) > 4 OR sum(least(tokens, 2500)) > 2500 AS over_budget
       FROM sent GROUP BY minute""",
    {"sent": _SENT},
)
def quota_usage(i: Inputs) -> DataFrame:
    texts = i.documents.select(F.col("doc_id").alias("event_id"), tx.estimate_tokens(F.col("text")).alias("tokens"))
    calls = i.requests.join(texts, "event_id")
    sent = calls.groupBy(
        F.expr("ts div 3600000000").alias("minute"), F.expr("ts div 600000000").alias("batch")
    ).agg(F.count(F.lit(1)).alias("texts"), F.sum("tokens").alias("tokens"))
    return audit.quota_usage(sent, 4, 2500)


_DELAY = r"""regexp_extract(message, '(?i)(?:retry in|"retryDelay"\s*:\s*")\s*([0-9]+(?:\.[0-9]+)?)\s*s', 1)"""


@query(
    "retry_delay",
    f"""SELECT event_id, CASE WHEN seconds <> '' THEN least(ceil(try_cast(seconds AS DOUBLE) * 1000), 3600000)::BIGINT END AS delay_ms
        FROM (SELECT event_id, {_DELAY} AS seconds FROM provider_log)""",
)
def retry_delay(i: Inputs) -> DataFrame:
    return i.provider_log.select("event_id", tx.retry_delay_ms(F.col("message")).alias("delay_ms"))


_REFUSED = f"""
    SELECT batch_id, attempt, CASE WHEN seconds <> '' THEN greatest(least(ceil(try_cast(seconds AS DOUBLE) * 1000), 3600000), 1000)
             ELSE least(15000 * pow(2, least(attempt, 20)), 300000) END::BIGINT AS wait_ms
    FROM (SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY event_id) - 1 AS attempt, {_DELAY} AS seconds
          FROM provider_log WHERE message LIKE '%:%' OR message = 'quota exceeded')"""


@query(
    "quota_wait_audit",
    """SELECT batch_id, attempt, wait_ms, waited_ms,
              CASE WHEN waited_ms <= 1800000 THEN 'WAIT' WHEN waited_ms - wait_ms <= 1800000 THEN 'PAUSED' ELSE 'NOT_REACHED' END AS outcome
       FROM (SELECT *, sum(wait_ms) OVER (PARTITION BY batch_id ORDER BY attempt)::BIGINT AS waited_ms FROM refused)""",
    {"refused": _REFUSED},
)
def quota_wait_audit(i: Inputs) -> DataFrame:
    refused = i.provider_log.where(F.contains("message", F.lit(":")) | (F.col("message") == "quota exceeded"))
    bucket = F.floor(F.col("event_id") / 1000)
    numbered = number_rows(refused, ["batch_id"], [F.col("event_id")], bucket, "n")
    attempts = numbered.select("batch_id", (F.col("n") - 1).alias("attempt"), "message")
    return audit.quota_wait_audit(attempts, bucket_width=10)


@query(
    "failed_runs",
    """SELECT run_id, CASE WHEN max(abort) IS NOT NULL THEN 'FAILED' ELSE 'COMPLETED' END AS state, count(*) AS batches,
              sum(CASE WHEN outcome = 'STORED' THEN chunks ELSE 0 END)::BIGINT AS processed,
              sum(CASE WHEN outcome = 'FAILED' THEN chunks ELSE 0 END)::BIGINT AS failed
       FROM (SELECT *, min(CASE WHEN bad THEN batch_no END) OVER (PARTITION BY run_id) AS abort
             FROM (SELECT *, outcome = 'FAILED' AND lag(outcome) OVER w = 'FAILED' AND lag(outcome, 2) OVER w = 'FAILED' AS bad
                   FROM batch_log WINDOW w AS (PARTITION BY run_id ORDER BY batch_no)))
       WHERE abort IS NULL OR batch_no <= abort GROUP BY run_id""",
)
def failed_runs(i: Inputs) -> DataFrame:
    return audit.failed_runs(i.batch_log, bucket_width=500)
