"""Input views over the given tables, as SQL that Spark and DuckDB both run.

The two dialects differ in a handful of functions; a view asks its dialect for those. Every view
reads its tables whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groundwork.sources.tables import scan, spread

TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}

# Tables whose rows are long texts, and the key that spreads them over the cores.
WIDE = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id"}

STOP_WORDS = "the and of to in is it der die das und la le les de des un une el los las que et y".split()
UBIQUITOUS = "that with for not sch eau ion".split()


class Spark:
    def sha256(self, x): return f"sha2({x}, 256)"
    def epoch_us(self, x): return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {x})"
    def words(self, x, first, last): return f"array_join(slice(split({x}, ' '), {first}, {last - first + 1}), ' ')"
    def joined(self, x, order): return f"listagg({x}, chr(10)) WITHIN GROUP (ORDER BY {order})"
    def pieces(self, x, pattern): return f"regexp_extract_all({x}, r'{pattern}', 0)"
    def lines(self, x): return f"split({x}, '\\n')"
    def numbered(self, table, array): return f"{table} LATERAL VIEW posexplode({array}) t AS pos0, item"
    position = "pos0 + 1"
    def vector(self, body, x): return f"transform(sequence(1, size({x})), i -> CAST({body(f'element_at({x}, i)', 'i')} AS FLOAT))"
    nan = "double('NaN')"
    def front(self, x, n): return f"slice({x}, 1, {n})"


class Duck:
    def sha256(self, x): return f"sha256({x})"
    def epoch_us(self, x): return f"epoch_us({x})"
    def words(self, x, first, last): return f"array_to_string(string_split({x}, ' ')[{first}:{last}], ' ')"
    def joined(self, x, order): return f"string_agg({x}, chr(10) ORDER BY {order})"
    def pieces(self, x, pattern): return f"regexp_extract_all({x}, '{pattern}')"
    def lines(self, x): return f"string_split({x}, chr(10))"
    def numbered(self, table, array): return f"{table}, unnest({array}) WITH ORDINALITY AS t(item, ord)"
    position = "ord"
    def vector(self, body, x): return f"list_transform({x}, lambda v, i: CAST({body('v', 'i')} AS FLOAT))"
    nan = "'NaN'::DOUBLE"
    def front(self, x, n): return f"{x}[1:{n}]"


def _doc_catalog(d):
    return f"""
    SELECT c.doc_id AS document_id, c.source || '-' || CAST(c.doc_id AS STRING) AS title,
           {d.sha256("c.text")} AS file_hash, {d.sha256("c.text")} || '.pdf' AS storage_path,
           CASE WHEN l.toxic = 1 THEN 'PROCESSING' WHEN l.quality = 0 THEN 'FAILED' ELSE 'INDEXED' END AS status,
           CASE c.lang WHEN 'en' THEN 'STRUCTURED_QA' WHEN 'fr' THEN 'LEGAL_SECTION' WHEN 'de' THEN 'RECURSIVE' END AS strategy,
           CAST(c.n_chars AS BIGINT) AS file_size, c.lang, c.source
    FROM documents c LEFT JOIN labels l ON l.doc_id = c.doc_id"""


def _subjects(d):
    return """
    SELECT name AS subject_id, upper(name) AS code, name,
           name NOT IN ('src7', 'src13', 'de') AS active
    FROM (SELECT source AS name FROM documents UNION SELECT lang AS name FROM documents) n"""


def _doc_subjects(d):
    # French texts without a label have no subject, labelled ones two, the rest one.
    return """
    SELECT doc_id AS document_id, source AS subject_id FROM documents WHERE lang <> 'fr'
    UNION ALL
    SELECT c.doc_id AS document_id, c.lang AS subject_id FROM documents c JOIN labels l ON l.doc_id = c.doc_id"""


def _subject_requests(d):
    # By question: nothing, every active subject, only an inactive one, one with an unknown one, three.
    return """
    SELECT b.item_id AS query_id, s.subject_id
    FROM benchmark b JOIN (
      SELECT subject_id, 1 AS kind FROM subjects WHERE active
      UNION ALL SELECT subject_id, 2 AS kind FROM subjects WHERE subject_id = 'src7'
      UNION ALL SELECT subject_id, 3 AS kind FROM subjects WHERE subject_id = 'en'
      UNION ALL SELECT subject_id, 4 AS kind FROM subjects WHERE subject_id IN ('src1', 'src2', 'fr')
    ) s ON b.item_id % 5 = s.kind
    UNION ALL
    SELECT item_id AS query_id, CASE WHEN item_id % 5 = 3 THEN 'unknown' END AS subject_id FROM benchmark"""


def _bench_queries(d):
    return "SELECT item_id AS query_id, text AS query FROM benchmark"


def _chunk_docs(d):
    # Two chunks for longer documents, so that chunks of one document compete and share its visibility.
    title = "source || '-' || CAST(doc_id AS STRING) AS title"
    return f"""
    SELECT doc_id * 2 AS chunk_id, doc_id AS document_id, 1 AS sequence_number, {title}, substr(text, 1, 2000) AS content
    FROM documents
    UNION ALL
    SELECT doc_id * 2 + 1 AS chunk_id, doc_id AS document_id, 2 AS sequence_number, {title}, substr(text, 2001) AS content
    FROM documents WHERE length(text) > 2000"""


def _line_chunks(d):
    return f"""
    SELECT doc_id AS document_id, CAST({d.position} AS INT) AS sequence_number, item AS content,
           {d.sha256("item")} AS chunk_hash
    FROM {d.numbered("documents", d.lines("text"))}"""


def _turn_pages(d):
    return """
    SELECT conv_id AS document_id, CAST(turn + 1 AS INT) AS page_no, text || chr(13) || chr(10) AS text
    FROM conversations"""


def _headed(d, prefix, separator):
    head = f"{prefix} || {separator} || substr(replace(text, chr(10), ' '), 1, 40) || chr(10) || text"
    return f"""
    SELECT conv_id AS document_id,
           CASE WHEN conv_id % 2 = 0 THEN 'Preamble' || chr(10) ELSE '' END || {d.joined(head, 'turn')} AS text
    FROM conversations GROUP BY conv_id"""


def _qa_docs(d):
    return _headed(d, "lpad(CAST(turn + 1 AS STRING), 3, '0')", "' — '")


def _law_docs(d):
    return _headed(d, "'Art. ' || CAST(turn + 1 AS STRING)", "'º '")


def _mixed_docs(d):
    return """
    SELECT document_id * 3 AS document_id, text, 'STRUCTURED_QA' AS strategy FROM qa_docs
    UNION ALL SELECT document_id * 3 + 1 AS document_id, text, 'LEGAL_SECTION' AS strategy FROM law_docs
    UNION ALL SELECT doc_id * 3 + 2 AS document_id, text,
      CASE lang WHEN 'en' THEN 'STRUCTURED_QA' WHEN 'fr' THEN 'LEGAL_SECTION' WHEN 'de' THEN 'UNHEARD_OF' END AS strategy
    FROM documents"""


def _vec_chunks(d):
    zero = d.vector(lambda x, i: "0", "embedding")
    nan = d.vector(lambda x, i: f"CASE WHEN {i} = 1 THEN {d.nan} ELSE {x} END", "embedding")
    return f"""
    SELECT vec_id AS chunk_id, vec_id // 10 AS document_id, label,
           CASE WHEN vec_id % 17 = 0 THEN NULL WHEN vec_id % 19 = 0 THEN {zero}
                WHEN vec_id % 23 = 0 THEN {nan} WHEN vec_id % 29 = 0 THEN {d.front("embedding", 63)}
                ELSE embedding END AS embedding
    FROM embeddings"""


def _sessions(d):
    return """
    SELECT conv_id AS session_id, conv_id % 30 AS user_id, max(turn) * 60 + conv_id AS updated_at
    FROM conversations GROUP BY conv_id"""


def _messages(d):
    return """
    SELECT conv_id AS session_id, conv_id * 1000 + turn AS message_id, role, text, turn,
           CASE WHEN role <> 'assistant' THEN NULL
                WHEN length(text) % 7 = 0 THEN '[]'
                WHEN length(text) % 5 = 0 THEN '[{broken'
                ELSE '[{"documentTitle":"D' || CAST(conv_id AS STRING) || '","pageNumber":' || CAST(turn AS STRING)
                     || '},{"chunkTitle":"second","articleNumber":"12-A"}]' END AS citations
    FROM conversations"""


def _users(d):
    return """
    SELECT c_custkey AS user_id, lower(c_name) || '@' || lower(c_mktsegment) || '.example' AS email,
           CASE WHEN c_nationkey = 0 THEN 'ROLE_ADMIN' WHEN c_nationkey < 5 THEN 'ROLE_OPERATOR' ELSE 'ROLE_USER' END AS role,
           c_acctbal >= 0 AS active,
           CASE WHEN c_nationkey % 3 <> 0 THEN 'sub-' || CAST(c_custkey AS STRING) END AS ext_subject
    FROM customer"""


def _logins(d):
    # Late orders log in under another person's e-mail or an unknown one.
    return f"""
    SELECT o.o_orderkey AS login_id,
           CASE WHEN o.o_orderstatus = 'P' AND o.o_totalprice < 50000 THEN NULL
                ELSE 'sub-' || CAST(o.o_custkey AS STRING) END AS ext_subject,
           CASE WHEN o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'O'
                THEN lower(n.c_name) || '@' || lower(n.c_mktsegment) || '.example'
                WHEN o.o_orderpriority = '2-HIGH' AND o.o_orderstatus = 'O'
                THEN lower(c.c_name) || '@Household.example '
                ELSE lower(c.c_name) || '@' || lower(c.c_mktsegment) || '.example' END AS email,
           o.o_orderpriority <> '5-LOW' AS email_verified,
           CASE WHEN o.o_orderstatus = 'F' THEN lower(c.c_mktsegment) || '.example'
                WHEN o.o_orderstatus = 'O' THEN upper(c.c_mktsegment) || '.EXAMPLE' END AS hosted_domain,
           {d.epoch_us("o.o_orderdate")} AS ts
    FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
    LEFT JOIN customer n ON n.c_custkey = o.o_custkey + 1"""


def _grants(d):
    return f"""
    SELECT o_orderkey AS change_id, o_custkey AS user_id, o_orderpriority AS subject_id,
           CASE o_orderstatus WHEN 'F' THEN 'READ' WHEN 'O' THEN 'WRITE' ELSE 'MANAGE' END AS level,
           o_totalprice < 80000 AS revoke, {d.epoch_us("o_orderdate")} AS ts
    FROM orders"""


def _batch_log(d):
    return """
    SELECT user_id AS run_id, event_id AS batch_no,
           CASE WHEN event_type IN ('error', 'view') THEN 'FAILED' ELSE 'STORED' END AS outcome,
           CAST(16 AS BIGINT) AS chunks
    FROM events"""


def _provider_log(d):
    return """
    SELECT event_id, user_id AS batch_id,
           CASE event_type
             WHEN 'error' THEN '429: please retry in ' || CAST(CAST(value AS DECIMAL(18, 2)) AS STRING) || 's'
             WHEN 'view' THEN '{"error":{"details":[{"retryDelay":"' || CAST(CAST(floor(value * 40) AS BIGINT) AS STRING) || 's"}]}}'
             WHEN 'click' THEN 'quota exceeded'
             ELSE event_type END AS message
    FROM events"""


def _requests(d):
    return f"""
    SELECT event_id, {d.epoch_us("ts")} AS ts,
           CASE WHEN event_type = 'error' THEN 'ip:10.0.0.' || CAST(user_id % 3 AS STRING)
                ELSE 'user:u' || CAST(user_id % 20 AS STRING) || '@example' END AS client, event_type
    FROM events"""


def _ticket_log(d):
    # A redeem or end names a recent event as its ticket, which may be no ticket, or somebody else's.
    return f"""
    SELECT event_id, user_id % 5 AS user_id, {d.epoch_us("ts")} AS ts,
           CASE event_type WHEN 'signup' THEN 'issue' WHEN 'purchase' THEN 'issue'
             WHEN 'view' THEN 'redeem' WHEN 'click' THEN 'redeem' ELSE 'end' END AS kind,
           CASE event_type WHEN 'signup' THEN event_id WHEN 'purchase' THEN event_id
             WHEN 'error' THEN event_id - 2 - event_id % 4 ELSE event_id - 1 - event_id % 3 END AS ticket
    FROM events"""


def _escaped(x):
    quoted = f"replace(replace({x}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34))"
    return f"replace(replace({quoted}, chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r')"


def _stream_lines(d):
    text = _escaped("item")
    return f"""
    SELECT stream_id, seq, provider,
      CASE provider
        WHEN 'GEMINI' THEN 'data: {{"candidates":[{{"content":{{"parts":[{{"text":"' || {text} || '"}}]}}}}]}}'
        WHEN 'OPENAI' THEN 'data: {{"choices":[{{"delta":{{"content":"' || {text} || '"}}}}]}}'
        ELSE 'data: {{"type":"content_block_delta","delta":{{"text":"' || {text} || '"}}}}' END AS line
    FROM (SELECT conv_id * 1000 + turn AS stream_id, CAST({d.position} AS BIGINT) AS seq, item,
                 CASE conv_id % 3 WHEN 0 THEN 'GEMINI' WHEN 1 THEN 'OPENAI' ELSE 'CLAUDE' END AS provider
          FROM {d.numbered("conversations", d.pieces("text", "[^ ]* |[^ ]+$"))} WHERE role = 'assistant') p
    UNION ALL
    SELECT conv_id * 1000 + turn AS stream_id, CAST(1000000 AS BIGINT) AS seq,
      CASE conv_id % 3 WHEN 0 THEN 'GEMINI' WHEN 1 THEN 'OPENAI' ELSE 'CLAUDE' END AS provider,
      CASE WHEN length(text) % 4 = 0 THEN 'error: connection reset'
           ELSE CASE conv_id % 3 WHEN 0 THEN ': end' WHEN 1 THEN 'data: [DONE]' ELSE 'data: {{"type":"message_stop"}}' END END AS line
    FROM conversations WHERE role = 'assistant'"""


def _search_results(d):
    return f"""
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY document_id) AS INT) AS rank,
           document_id AS chunk_id, document_title, chunk_title, content, metadata, similarity, lexical_score, full_text_match
    FROM (SELECT c.doc_id // 4 AS query_id, c.doc_id AS document_id,
             c.source || '-' || CAST(c.doc_id AS STRING) AS document_title,
             CASE WHEN c.lang = 'es' THEN NULL WHEN c.lang = 'de' THEN ' ' ELSE 'Part ' || c.lang END AS chunk_title,
             '  ' || c.text || chr(10) AS content,
             CASE WHEN c.n_chars % 9 = 0 THEN '{{unreadable' WHEN c.n_chars % 9 = 1 THEN NULL
                  WHEN c.n_chars % 9 = 2 THEN '{{"page":' || CAST(c.n_chars AS STRING) || ',"articleNumber":"7-B"}}'
                  ELSE '{{"page":' || CAST(c.n_chars % 50 AS STRING) || ',"questionNumber":' || CAST(c.doc_id AS STRING) || '}}' END AS metadata,
             CASE WHEN c.n_chars % 5 = 0 THEN NULL WHEN c.n_chars % 5 = 1 THEN {d.nan}
                  ELSE CAST(c.n_chars % 70 AS DOUBLE) / 100 END AS similarity,
             CAST(c.n_chars % 11 AS DOUBLE) / 2 AS lexical_score,
             coalesce(l.toxic, 0) = 1 AS full_text_match
          FROM documents c LEFT JOIN labels l ON l.doc_id = c.doc_id) r"""


def _result_queries(d):
    return "SELECT DISTINCT doc_id // 4 AS query_id, 'What about <SOURCE> ' || CAST(doc_id // 4 AS STRING) || ' ? ' AS query FROM documents"


def _stored_files(d):
    # The files of Spanish documents are lost.
    return f"SELECT DISTINCT {d.sha256('text')} || '.pdf' AS storage_path FROM documents WHERE lang <> 'es'"


VIEWS: dict[str, Callable] = {
    "doc_catalog": _doc_catalog, "subjects": _subjects, "doc_subjects": _doc_subjects,
    "subject_requests": _subject_requests, "bench_queries": _bench_queries, "chunk_docs": _chunk_docs,
    "line_chunks": _line_chunks, "turn_pages": _turn_pages, "qa_docs": _qa_docs, "law_docs": _law_docs,
    "mixed_docs": _mixed_docs, "vec_chunks": _vec_chunks, "sessions": _sessions, "messages": _messages,
    "users": _users, "logins": _logins, "grants": _grants, "batch_log": _batch_log,
    "provider_log": _provider_log, "requests": _requests, "ticket_log": _ticket_log,
    "stream_lines": _stream_lines, "search_results": _search_results, "result_queries": _result_queries,
    "stored_files": _stored_files,
}


def _uses(sql: str, names) -> list[str]:
    # Names after FROM, JOIN or a comma of a FROM list; that is how views mention others.
    mentioned = set(re.findall(r"(?:FROM|JOIN)\s+(\w+)", sql))
    return [n for n in names if n in mentioned]


def duck_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """``sql`` for DuckDB with the views it mentions in front."""
    texts = {name: view(Duck()) for name, view in VIEWS.items()} | (extra or {})
    ordered: list[str] = []
    recursive = {name for name, text in texts.items() if name in _uses(text, [name])}

    def need(text: str, inside: str | None = None) -> None:
        for name in _uses(text, texts):
            if name not in ordered and name != inside:
                need(texts[name], name)
                ordered.append(name)

    need(sql)
    if not ordered:
        return sql
    # Materialized, so that a view mentioned twice is computed once.
    heads = ",\n".join(
        f"{name} AS {'' if name in recursive else 'MATERIALIZED '}({texts[name]})" for name in ordered
    )
    return f"WITH RECURSIVE {heads}\n{sql}"


class Inputs:
    """The given tables of a folder and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name not in VIEWS and name not in TABLES:
                raise AttributeError(name)
            self._made[name] = self._view(name) if name in VIEWS else self._table(name)
        return self._made[name]

    def _table(self, name: str) -> DataFrame:
        table = scan(self.spark, f"{self.folder}/{name}.parquet", schema=TABLES[name])
        return spread(table, WIDE[name]) if name in WIDE else table

    def _view(self, name: str) -> DataFrame:
        sql = VIEWS[name](Spark()).replace(" // ", " DIV ")
        used = _uses(sql, [*VIEWS, *TABLES])
        for u in used:
            sql = re.sub(rf"((?:FROM|JOIN)\s+){u}\b", rf"\1{{{u}}}", sql)
        return self.spark.sql(_literal_braces(sql, used), **{u: getattr(self, u) for u in used})


def _literal_braces(sql: str, used: list[str]) -> str:
    """Double the braces that are not placeholders of a used table."""
    doubled = sql.replace("{", "{{").replace("}", "}}")
    for u in used:
        doubled = doubled.replace("{{" + u + "}}", "{" + u + "}")
    return doubled
