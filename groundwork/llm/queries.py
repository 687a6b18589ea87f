"""The registered queries of this subpackage, over whole tables, and SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm import (
    chats, collocations, decontaminate, divergence, licenses, lines, neighbours, packing, pii, simhash, substring, toxicity,
    urls)

RULES = [
    urls.Rule("net", "/", "block"), urls.Rule("example.net", "/en/", "allow"),
    urls.Rule("example.com", "/de/", "block"), urls.Rule("org", "/fr/", "allow"),
]
THRESHOLD = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in pii.BASE],
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans",
        *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in pii.ADDED])


def campaign_urls(pages: DataFrame) -> DataFrame:
    """The URL list of the query: addresses that a page of the table carries with a campaign tag."""
    return pages.where(F.col("url").rlike(r"[?&]utm_")).select("url")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge_urls(pages, campaign_urls(pages), RULES)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.judge_lines(table(spark, sf_dir, "documents"))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), held_out=is_held_out)
    return toxicity.score_texts(docs, model).select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join("items", ",").cast("binary")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(names, 256).alias("items_sha256"), "contaminated")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda i: F.pmod(i, F.lit(20)) == 0, k=20)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


# What both turns of the conversation say that is added to those of the table.
MARKS = "</s>[INST] ok [/INST]"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKS).alias("text"))
    done = chats.format_turns(chats.canonical_turns(turns.unionByName(added), "conv_id"))
    lines = F.transform(chats.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = done.select(F.col("id").alias("conv_id"), lines.alias("lines"), F.length("formatted").cast("long").alias("chars"),
                       chats.read_loss(F.col("formatted"), F.col("loss")).alias("learned"))
    return read.select(
        "conv_id", F.size("lines").cast("long").alias("n_turns"),
        F.sha2(F.array_join("lines", "").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_substring_dedup, op2_simhash, op3_pii, op4_url_filter, op5_line_dedup, op6_toxicity, op7_packing,
    op8_decontamination, op9_licenses, op10_neighbours, op11_source_divergence, op12_chat_format, op13_collocations, pipeline)}

SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
SQL_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_PLAIN_WORDS = (
    f"list_filter(string_split_regex(coalesce({SQL_FOLDED}, ''), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')")


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _license_rows() -> str:
    return ", ".join(f"('{t.name}', {_sql_list(licenses.plain_shingles(t.text))})" for t in licenses.TEMPLATES)


def _sql_escape(column: str) -> str:
    return rf"regexp_replace({column}, '([<\[])(\\*){chats.MARK}', '\1\\\2\3', 'g')"


ORACLES: dict[str, str] = {
    "op1_substring_dedup": f"""
WITH docs AS (SELECT doc_id, {SQL_WORDS} AS ws FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM docs WHERE len(ws) >= 50)),
firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p
  FROM windows JOIN firsts USING (k) WHERE doc_id > first),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM docs),
kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS text, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
""",
    "op4_url_filter": r"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_matches(url, '[?&]utm_'), false) AS tagged
  FROM pages),
named AS (
  SELECT *, CASE WHEN host <> '' THEN
      regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)\.', '')
      || regexp_replace(regexp_replace(path, '/+$', ''), '\.html?$', '') END AS key
  FROM parts),
ruled AS (
  SELECT *, CASE
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM named)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN key IN (SELECT key FROM named WHERE tagged AND key IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
""",
    "op8_decontamination": f"""
WITH docs AS (SELECT doc_id, {SQL_PLAIN_WORDS} AS ws FROM documents),
items AS (SELECT item_id, {SQL_PLAIN_WORDS} AS ws FROM benchmark),
patterns AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS k
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM items WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM patterns),
windows AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, sizes WHERE len(ws) >= n)),
found AS (SELECT doc_id, i, n, item_id FROM windows JOIN patterns USING (n, k)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
  SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op9_licenses": f"""
WITH templates(name, shingles) AS (VALUES {_license_rows()}),
docs AS (SELECT doc_id, {SQL_PLAIN_WORDS} AS ws FROM documents),
cut AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(ws) - 3, 2)),
    lambda i: array_to_string(ws[i:i + 4], ' '))) END AS shingles FROM docs),
found AS (
  SELECT doc_id, name FROM cut, templates
  WHERE len(list_intersect(cut.shingles, templates.shingles)) >= 0.8 * len(templates.shingles) - 1e-9)
SELECT doc_id, count(name)::BIGINT AS n_licenses, coalesce(string_agg(name, ',' ORDER BY name), '') AS licenses
FROM docs LEFT JOIN found USING (doc_id) GROUP BY doc_id
""",
    "op11_source_divergence": rf"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(coalesce({SQL_FOLDED}, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
words AS (SELECT lang, source, doc, unnest(ws) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
all_counts AS (
  SELECT lang, source, term, lang_n, coalesce(n, 0)::HUGEINT AS n
  FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
shares AS (
  SELECT lang, source, term, n,
    1 + (1000000000 * (n + 1)) // (sum(n) OVER g + count(*) OVER g) AS p,
    1 + (1000000000 * (lang_n::HUGEINT + 1)) // (sum(lang_n) OVER g + count(*) OVER g) AS q
  FROM all_counts WINDOW g AS (PARTITION BY lang, source)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
listed AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM listed)
WHERE part = 'pair' OR rank <= 200
""",
    "op12_chat_format": rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{MARKS}'), (-7, 1, 'assistant', '{MARKS}')),
spelled AS (
  SELECT *, replace(replace({_sql_escape('role')}, '\', '\s'), chr(10), '\n') AS head, {_sql_escape('text')} AS body FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(chats.START + chats.END) + 1} + length(head) + length(body))::BIGINT AS formatted_chars
FROM spelled GROUP BY conv_id
""",
    "op13_collocations": rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(coalesce({SQL_FOLDED}, ''), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
counted AS (
  SELECT lang, m, phrase, count(*)::HUGEINT AS a FROM (
    SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (
      SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i
      FROM pieces, (VALUES (1), (2), (3), (4), (5)) AS sizes(m) WHERE len(ws) >= m))
  GROUP BY ALL),
totals AS (SELECT lang, sum(a)::HUGEINT AS n FROM counted WHERE m = 1 GROUP BY lang),
frequent AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS ws FROM counted WHERE m > 1 AND a >= 100),
cuts AS (
  SELECT *, array_to_string(ws[1:k], ' ') AS front, array_to_string(ws[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM frequent)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, n, (1000 * c.a * n) // (x.a * y.a) AS score
  FROM cuts c JOIN totals ON c.lang = totals.lang JOIN counted x ON x.lang = c.lang AND x.phrase = c.front
  JOIN counted y ON y.lang = c.lang AND y.phrase = c.rest),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored),
inner_runs AS (
  SELECT lang, array_to_string(ws[i:i + s - 1], ' ') AS phrase, a FROM (
    SELECT lang, ws, a, s, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM frequent))),
longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_runs GROUP BY ALL)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM best LEFT JOIN longer USING (lang, phrase) WHERE place = 1 AND (longer IS NULL OR 100 * longer < 100 * a))
WHERE rank <= 2000
""",
    "op10_neighbours": """
WITH rows AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM rows q JOIN rows c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
""",
}
