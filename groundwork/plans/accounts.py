"""Queries: catalog, subjects, permissions, identities, constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.operators import accounts, catalog, identities, quality
from groundwork.operators.scope import active_subjects as active_only
from groundwork.plans import duck
from groundwork.plans.registry import query
from groundwork.plans.views import Inputs

# -- catalog -------------------------------------------------------------------------------


@query(
    "catalog_list",
    """SELECT d.document_id, d.title, d.status,
              coalesce((SELECT string_agg(s.name, ',' ORDER BY s.name) FROM doc_subjects t JOIN subjects s ON s.subject_id = t.subject_id
                        WHERE t.document_id = d.document_id), '') AS subjects
       FROM doc_catalog d WHERE EXISTS (SELECT 1 FROM doc_subjects t WHERE t.document_id = d.document_id AND t.subject_id = 'en')
       UNION ALL
       SELECT d.document_id, d.title, d.status,
              coalesce((SELECT string_agg(s.name, ',' ORDER BY s.name) FROM doc_subjects t JOIN subjects s ON s.subject_id = t.subject_id
                        WHERE t.document_id = d.document_id), '')
       FROM doc_catalog d WHERE d.status = 'FAILED'""",
)
def catalog_list(i: Inputs) -> DataFrame:
    docs = i.doc_catalog.select("document_id", "title", "status")
    by_subject = catalog.catalog_list(docs, i.doc_subjects, i.subjects, subject_id="en", status="INDEXED")
    by_status = catalog.catalog_list(docs, i.doc_subjects, i.subjects, status="FAILED")
    both = by_subject.unionByName(by_status)
    return both.withColumn("subjects", F.array_join("subjects", ","))


@query(
    "docs_by_subject",
    """SELECT d.document_id, d.title FROM doc_catalog d JOIN doc_subjects t ON t.document_id = d.document_id
       WHERE t.subject_id = 'src3'""",
)
def docs_by_subject(i: Inputs) -> DataFrame:
    return catalog.docs_by_subject(i.doc_catalog, i.doc_subjects, "src3").select("document_id", "title")


@query(
    "docs_by_status",
    """SELECT document_id, title, (SELECT bool_or(status = 'PROCESSING') FROM doc_catalog) AS any_processing
       FROM doc_catalog WHERE status = 'INDEXED'""",
)
def docs_by_status(i: Inputs) -> DataFrame:
    stuck = catalog.any_processing(i.doc_catalog).scalar()
    found = catalog.docs_by_status(i.doc_catalog, "INDEXED")
    return found.select("document_id", "title", stuck.alias("any_processing"))


@query("active_subjects", "SELECT subject_id, code, name FROM subjects WHERE active")
def active_subjects(i: Inputs) -> DataFrame:
    return active_only(i.subjects).select("subject_id", "code", "name")


@query(
    "catalog_progress",
    f"""SELECT d.document_id, d.status, CASE WHEN d.status = 'INDEXED' THEN p.total END AS total,
               CASE WHEN d.status = 'INDEXED' THEN p.embedded END AS embedded,
               CASE WHEN d.status = 'INDEXED' THEN p.embedded >= p.total END AS complete
        FROM doc_catalog d LEFT JOIN (
          SELECT document_id, count(*) AS total, count(*) FILTER (NOT {duck.missing("embedding")}) AS embedded
          FROM vec_chunks GROUP BY document_id) p ON p.document_id = d.document_id""",
)
def catalog_progress(i: Inputs) -> DataFrame:
    return catalog.catalog_progress(i.doc_catalog.select("document_id", "status"), i.vec_chunks)


@query(
    "toggle_active",
    """SELECT s.subject_id, s.active <> (coalesce(r.n, 0) % 2 = 1) AS active FROM subjects s
       LEFT JOIN (SELECT source AS subject_id, count(*) AS n FROM documents d JOIN labels l ON l.doc_id = d.doc_id
                  WHERE l.toxic = 1 GROUP BY source) r ON r.subject_id = s.subject_id""",
)
def toggle_active(i: Inputs) -> DataFrame:
    toxic = i.labels.where("toxic = 1").select("doc_id")
    requests = i.documents.join(toxic, "doc_id", "left_semi").select(F.col("source").alias("subject_id"))
    return catalog.toggle_active(i.subjects, requests).select("subject_id", "active")


_NEW_CODES = "SELECT doc_id AS request_id, CASE WHEN lang = 'en' THEN upper(source) ELSE upper(lang || '-' || source) END AS code, source AS name FROM documents"


@query(
    "new_subjects",
    """SELECT request_id, code, CASE WHEN rn = 1 AND code NOT IN (SELECT code FROM subjects) THEN 'CREATED' ELSE 'DUPLICATE_CODE' END AS outcome
       FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY request_id) AS rn FROM new_codes)""",
    {"new_codes": _NEW_CODES},
)
def new_subjects(i: Inputs) -> DataFrame:
    code = F.when(F.col("lang") == "en", F.upper("source")).otherwise(F.upper(F.concat_ws("-", "lang", "source")))
    requests = i.documents.select(F.col("doc_id").alias("request_id"), code.alias("code"), F.col("source").alias("name"))
    return catalog.new_subjects(i.subjects, requests).select("request_id", "code", "outcome")


# -- permissions ---------------------------------------------------------------------------

_PRIORITIES = "SELECT DISTINCT subject_id, lower(subject_id) AS name FROM grants"
_LAST_GRANTS = """
    SELECT user_id, subject_id, arg_max(level, change_id) AS level FROM grants WHERE NOT revoke GROUP BY user_id, subject_id"""


@query(
    "permissions_by_user",
    """SELECT g.user_id, string_agg(p.name || ':' || g.level, ',' ORDER BY p.name) AS permissions
       FROM last_grants g JOIN priorities p ON p.subject_id = g.subject_id GROUP BY g.user_id""",
    {"priorities": _PRIORITIES, "last_grants": _LAST_GRANTS},
)
def permissions_by_user(i: Inputs) -> DataFrame:
    subjects = i.grants.select("subject_id", F.lower("subject_id").alias("name")).distinct()
    held = i.grants.where("not revoke").groupBy("user_id", "subject_id").agg(
        F.max_by("level", "change_id").alias("level")
    )
    listed = accounts.permissions_by_user(held, subjects)
    shown = F.transform("permissions", lambda p: F.concat(p["name"], F.lit(":"), p["level"]))
    return listed.select("user_id", F.array_join(shown, ",").alias("permissions"))


# Every customer starts with READ on the first priority, since 1990.
_SINCE = 631152000000000


@query(
    "apply_permission_changes",
    f"""SELECT coalesce(c.user_id, k.user_id) AS user_id, coalesce(c.subject_id, k.subject_id) AS subject_id,
               coalesce(k.level, 'READ') AS level,
               CASE WHEN c.user_id IS NOT NULL AND k.ended IS NULL THEN {_SINCE} ELSE k.started END AS granted_at
        FROM (SELECT user_id, '1-URGENT' AS subject_id FROM users) c
        FULL JOIN (
          SELECT g.user_id, g.subject_id, max(e.ended) AS ended, arg_max(g.revoke, g.o) AS gone,
                 arg_max(g.level, g.o) FILTER (NOT g.revoke) AS level,
                 min(g.ts) FILTER (NOT g.revoke AND (e.ended IS NULL OR g.o > e.ended)) AS started
          FROM ordered g LEFT JOIN (SELECT user_id, subject_id, max(o) AS ended FROM ordered WHERE revoke GROUP BY ALL) e
            ON e.user_id = g.user_id AND e.subject_id = g.subject_id
          GROUP BY g.user_id, g.subject_id) k ON k.user_id = c.user_id AND k.subject_id = c.subject_id
        WHERE NOT coalesce(k.gone, false)""",
    {"ordered": "SELECT *, row_number() OVER (ORDER BY ts, change_id) AS o FROM grants"},
)
def apply_permission_changes(i: Inputs) -> DataFrame:
    current = i.users.select(
        "user_id", F.lit("1-URGENT").alias("subject_id"), F.lit("READ").alias("level"), F.lit(_SINCE).alias("granted_at")
    )
    return accounts.apply_permission_changes(current, i.grants)


# -- identities ----------------------------------------------------------------------------

IDENTITY_VIEWS = {
    "latest": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ext_subject ORDER BY ts DESC, login_id DESC) AS rn
                 FROM logins WHERE ext_subject IS NOT NULL) WHERE rn = 1""",
    "judged": """
        SELECT l.ext_subject, l.email, s.user_id AS s_user, s.email AS s_email, e.user_id AS e_user, e.ext_subject AS e_subject,
               EXISTS (SELECT 1 FROM latest o LEFT JOIN users os ON os.ext_subject = o.ext_subject
                       LEFT JOIN users oe ON oe.email = o.email
                       WHERE o.email = l.email AND (o.ts, o.login_id) < (l.ts, l.login_id)
                         AND (oe.user_id IS NULL OR (os.user_id IS NULL AND oe.ext_subject IS NULL))) AS late
        FROM latest l LEFT JOIN users s ON s.ext_subject = l.ext_subject LEFT JOIN users e ON e.email = l.email""",
    "merged": """
        SELECT ext_subject, email, coalesce(s_user, e_user) AS user_id,
          CASE WHEN s_user IS NOT NULL AND s_email = email THEN 'KEEP'
               WHEN s_user IS NOT NULL AND e_user IS NOT NULL THEN 'REJECT'
               WHEN s_user IS NULL AND e_subject IS NOT NULL THEN 'REJECT'
               WHEN late THEN 'REJECT' WHEN s_user IS NOT NULL THEN 'CHANGE_EMAIL' WHEN e_user IS NOT NULL THEN 'BIND'
               ELSE 'INSERT' END AS action,
          CASE WHEN s_user IS NOT NULL AND s_email = email THEN NULL
               WHEN s_user IS NOT NULL AND e_user IS NOT NULL THEN 'EMAIL_OF_OTHER_ACCOUNT'
               WHEN s_user IS NULL AND e_subject IS NOT NULL THEN 'BOUND_TO_OTHER_SUBJECT'
               WHEN late THEN 'CLAIMED_IN_BATCH' END AS reason
        FROM judged""",
}


@query("merge_identities", "SELECT ext_subject, email, user_id, action, reason FROM merged", IDENTITY_VIEWS)
def merge_identities(i: Inputs) -> DataFrame:
    return accounts.merge_identities(i.users, i.logins)


@query(
    "apply_identities",
    """SELECT u.user_id, coalesce(m.email, u.email) AS email, coalesce(m.ext_subject, u.ext_subject) AS ext_subject
       FROM users u LEFT JOIN merged m ON m.user_id = u.user_id AND m.action <> 'REJECT'
       UNION ALL SELECT user_id, email, ext_subject FROM merged WHERE action = 'INSERT'""",
    IDENTITY_VIEWS,
)
def apply_identities(i: Inputs) -> DataFrame:
    return accounts.apply_identities(i.users, accounts.merge_identities(i.users, i.logins))


# Login by login, with all accounts as two lists: e-mails, and the subjects bound to them.
REPLAY_VIEWS = {
    "in_order": """SELECT *, row_number() OVER (ORDER BY ts, login_id) AS n FROM logins
                   WHERE ext_subject IS NOT NULL AND trim(ext_subject) <> '' AND email IS NOT NULL AND trim(email) <> ''""",
    "replayed": """
        SELECT 0::BIGINT AS n, NULL::BIGINT AS login_id, NULL::STRING AS action, NULL::STRING AS reason,
               list(email ORDER BY user_id) AS emails, list(ext_subject ORDER BY user_id) AS subs FROM users
        UNION ALL
        SELECT n, login_id, CASE WHEN reason IS NOT NULL THEN 'REJECT' WHEN emails[s] = email THEN 'KEEP' WHEN s > 0 THEN 'CHANGE_EMAIL'
                                 WHEN e > 0 THEN 'BIND' ELSE 'INSERT' END, reason,
               CASE WHEN reason IS NOT NULL OR (s = 0 AND e > 0) OR emails[s] = email THEN emails
                    WHEN s > 0 THEN list_concat(list_append(emails[1:s - 1], email), emails[s + 1:]) ELSE list_append(emails, email) END,
               CASE WHEN reason IS NOT NULL OR s > 0 THEN subs
                    WHEN e > 0 THEN list_concat(list_append(subs[1:e - 1], sub), subs[e + 1:]) ELSE list_append(subs, sub) END
        FROM (SELECT *, CASE WHEN s > 0 AND emails[s] <> email AND e > 0 THEN 'EMAIL_OF_OTHER_ACCOUNT'
                             WHEN s = 0 AND e > 0 AND subs[e] IS NOT NULL THEN 'BOUND_TO_OTHER_SUBJECT' END AS reason
              FROM (SELECT l.n, l.login_id, l.email, l.ext_subject AS sub, r.emails, r.subs,
                           coalesce(list_position(r.subs, l.ext_subject), 0) AS s, coalesce(list_position(r.emails, l.email), 0) AS e
                    FROM replayed r JOIN in_order l ON l.n = r.n + 1))""",
}


@query("replay_logins", "SELECT login_id, action, reason FROM replayed WHERE n > 0", REPLAY_VIEWS)
def replay_logins(i: Inputs) -> DataFrame:
    return identities.replay_logins(i.users, i.logins).select("login_id", "action", "reason")


@query(
    "accounts_after",
    """SELECT email, ext_subject FROM (SELECT unnest(emails) AS email, unnest(subs) AS ext_subject
       FROM replayed WHERE n = (SELECT count(*) FROM in_order))""",
    REPLAY_VIEWS,
)
def accounts_after(i: Inputs) -> DataFrame:
    judged = identities.replay_logins(i.users, i.logins)
    return identities.accounts_after(i.users, judged).select("email", "ext_subject")


_DOMAINS = ["household.example", "machinery.example", "building.example"]


@query(
    "admission_audit",
    f"""SELECT l.login_id, CASE
          WHEN l.email IS NULL OR trim(l.email) = '' OR NOT coalesce(l.email_verified, false) THEN 'EMAIL_NOT_VERIFIED'
          WHEN lower(trim(split_part(l.email, '@', -1))) NOT IN ({duck.quoted(_DOMAINS)}) THEN 'DOMAIN_NOT_ALLOWED'
          WHEN l.hosted_domain IS NULL OR lower(trim(l.hosted_domain)) NOT IN ({duck.quoted(_DOMAINS)})
               OR lower(trim(l.hosted_domain)) <> lower(trim(split_part(l.email, '@', -1))) THEN 'HOSTED_DOMAIN_NOT_ALLOWED'
          WHEN l.ext_subject IS NULL THEN 'SUBJECT_MISSING'
          WHEN s.user_id IS NULL AND e.ext_subject IS NOT NULL AND e.ext_subject <> l.ext_subject THEN 'BOUND_TO_OTHER_SUBJECT'
          WHEN NOT CASE WHEN s.user_id IS NULL THEN e.active ELSE s.active END THEN 'ACCOUNT_DISABLED'
          WHEN s.user_id IS NOT NULL AND e.user_id <> s.user_id THEN 'EMAIL_OF_OTHER_ACCOUNT' ELSE 'ADMITTED' END AS verdict
        FROM logins l LEFT JOIN users s ON s.ext_subject = l.ext_subject LEFT JOIN users e ON e.email = l.email""",
)
def admission_audit(i: Inputs) -> DataFrame:
    return accounts.admission_audit(i.logins, i.users, _DOMAINS)


# One plan per account: demote, deactivate or leave, some by the account itself.
_PLANS = """
    SELECT user_id + 1000000 AS change_id, user_id, CASE WHEN user_id % 4 = 0 THEN ' ' || upper(email) ELSE 'boss@example' END AS actor_email,
           CASE WHEN user_id % 2 = 0 THEN 'ROLE_USER' END AS new_role, user_id % 2 = 1 AS deactivate
    FROM (SELECT user_id, email FROM users UNION ALL SELECT -1 - r_regionkey, 'nobody' FROM region) u"""


@query(
    "last_admin_check",
    """SELECT change_id, user_id, outcome, outcome = 'ALLOWED' AND removes AND
              (SELECT count(DISTINCT user_id) FROM planned WHERE outcome = 'ALLOWED' AND removes) >= admins AS together_unsafe
       FROM planned""",
    {
        "plans": _PLANS,
        "planned": """
          SELECT *, CASE WHEN role IS NULL THEN 'NOT_FOUND' WHEN (demotes OR off) AND self THEN 'SELF_CHANGE'
                         WHEN removes AND admins - 1 < 1 THEN 'LAST_ADMIN' ELSE 'ALLOWED' END AS outcome
          FROM (SELECT *, role = 'ROLE_ADMIN' AND active AND (demotes OR off) AS removes FROM (
            SELECT p.change_id, p.user_id, u.role, u.active, lower(trim(p.actor_email)) = lower(u.email) AS self,
                   coalesce(u.role = 'ROLE_ADMIN' AND p.new_role <> 'ROLE_ADMIN', false) AS demotes,
                   coalesce(p.deactivate AND u.active, false) AS off,
                   (SELECT count(*) FROM users WHERE role = 'ROLE_ADMIN' AND active) AS admins
            FROM plans p LEFT JOIN users u ON u.user_id = p.user_id))""",
    },
)
def last_admin_check(i: Inputs) -> DataFrame:
    strangers = i.region.select((F.lit(-1) - F.col("r_regionkey")).cast("long").alias("user_id"), F.lit("nobody").alias("email"))
    everyone = i.users.select("user_id", "email").unionByName(strangers)
    own = F.concat(F.lit(" "), F.upper("email"))
    plans = everyone.select(
        (F.col("user_id") + 1000000).alias("change_id"), "user_id",
        F.when(F.col("user_id") % 4 == 0, own).otherwise("boss@example").alias("actor_email"),
        F.when(F.col("user_id") % 2 == 0, "ROLE_USER").alias("new_role"),
        (F.col("user_id") % 2 == 1).alias("deactivate"),
    )
    return accounts.last_admin_check(i.users, plans)


@query(
    "refresh_roles",
    """SELECT l.login_id AS session_id, l.user_id,
              CASE WHEN u.role IS NULL OR NOT u.active THEN 'REJECT' WHEN l.granted_role <> u.role THEN 'REPLACE' ELSE 'KEEP' END AS action,
              CASE WHEN u.role IS NOT NULL AND u.active THEN u.role END AS role
       FROM (SELECT o_orderkey AS login_id, o_custkey + o_orderkey % 2 * 700 AS user_id,
                    CASE WHEN o_orderstatus = 'F' THEN 'ROLE_OPERATOR' ELSE 'ROLE_USER' END AS granted_role FROM orders) l
       LEFT JOIN users u ON u.user_id = l.user_id""",
)
def refresh_roles(i: Inputs) -> DataFrame:
    granted = F.when(F.col("o_orderstatus") == "F", "ROLE_OPERATOR").otherwise("ROLE_USER")
    sessions = i.orders.select(
        F.col("o_orderkey").alias("session_id"),
        (F.col("o_custkey") + F.col("o_orderkey") % 2 * 700).alias("user_id"),
        granted.alias("granted_role"),
    )
    return accounts.refresh_roles(sessions, i.users)


_HOST = r"regexp_replace(regexp_replace(lower(authority), '^.*@', ''), ':\d*$', '')"


@query(
    "url_allowlist_audit",
    rf"""SELECT id, provider, host, CASE WHEN trim(url) = '' THEN 'DEFAULT' WHEN length(url) > 255 THEN 'TOO_LONG'
             WHEN regexp_matches(url, '[\s<>"{{}}|\\^`]') THEN 'MALFORMED'
             WHEN NOT (scheme = 'https' OR (scheme = 'http' AND provider = 'OLLAMA_LOCAL')) THEN 'SCHEME'
             WHEN contains(authority, '@') THEN 'USER_INFO' WHEN regexp_matches(url, '[?#]') THEN 'QUERY_OR_FRAGMENT'
             WHEN host = '' THEN 'MISSING_HOST'
             WHEN (provider = 'OLLAMA_LOCAL' AND host = 'localhost') OR (provider = 'OPENAI' AND host IN ('api.openai.com', 'ththre.example.com'))
             THEN 'ALLOWED' ELSE 'HOST_NOT_ALLOWED' END AS verdict
        FROM (SELECT *, {_HOST} AS host FROM (
          SELECT *, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
                 regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS authority FROM base_urls))""",
    {
        "base_urls": """
          SELECT page_id AS id, 'OPENAI' AS provider, url FROM pages
          UNION ALL SELECT page_id, 'OLLAMA_LOCAL', regexp_replace(url, '^[a-z]+://[^/]*', 'http://LocalHost:11434') FROM pages
          UNION ALL SELECT page_id, 'OPENAI', regexp_replace(url, '^[a-z]+://[^/]*/', 'https://me:pw@api.openai.com/') FROM pages"""
    },
)
def url_allowlist_audit(i: Inputs) -> DataFrame:
    def variant(provider: str, url) -> DataFrame:
        return i.pages.select(F.col("page_id").alias("id"), F.lit(provider).alias("provider"), url.alias("url"))

    local = F.regexp_replace("url", "^[a-z]+://[^/]*", "http://LocalHost:11434")
    with_password = F.regexp_replace("url", "^[a-z]+://[^/]*/", "https://me:pw@api.openai.com/")
    urls = (
        variant("OPENAI", F.col("url"))
        .unionByName(variant("OLLAMA_LOCAL", local))
        .unionByName(variant("OPENAI", with_password))
    )
    allowed = {"OPENAI": ["api.openai.com", "ththre.example.com"], "OLLAMA_LOCAL": ["localhost"]}
    return accounts.url_allowlist_audit(urls, allowed)


# -- constraints ---------------------------------------------------------------------------


@query(
    "unique_violations",
    """SELECT 'chunk' AS kind, document_id || '/' || chunk_hash AS key, count(*) AS occurrences FROM line_chunks
       GROUP BY document_id, chunk_hash HAVING count(*) > 1
       UNION ALL SELECT 'ext_subject', ext_subject, count(*) FROM logins WHERE ext_subject IS NOT NULL
       GROUP BY ext_subject HAVING count(*) > 1""",
)
def unique_violations(i: Inputs) -> DataFrame:
    chunks = quality.unique_violations(i.line_chunks, ["document_id", "chunk_hash"])
    subjects = quality.unique_violations(i.logins, ["ext_subject"], nulls_allowed=True)
    named = chunks.select(
        F.lit("chunk").alias("kind"), F.concat_ws("/", F.col("document_id").cast("string"), "chunk_hash").alias("key"), "occurrences"
    )
    return named.unionByName(
        subjects.select(F.lit("ext_subject").alias("kind"), F.col("ext_subject").alias("key"), "occurrences")
    )


@query(
    "orphan_rows",
    """SELECT 'label' AS kind, doc_id AS id FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
       UNION ALL SELECT 'order', o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""",
)
def orphan_rows(i: Inputs) -> DataFrame:
    labels = quality.orphan_rows(i.labels, "doc_id", i.embeddings, "vec_id")
    solvent = i.customer.where("c_acctbal >= 0")
    orders = quality.orphan_rows(i.orders, "o_custkey", solvent, "c_custkey")
    return labels.select(F.lit("label").alias("kind"), F.col("doc_id").alias("id")).unionByName(
        orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"))
    )


@query(
    "domain_violations",
    """SELECT document_id, 'strategy' AS column_name, 'REQUIRED' AS rule FROM doc_catalog WHERE strategy IS NULL
       UNION ALL SELECT document_id, 'status', 'NOT_IN_DOMAIN' FROM doc_catalog WHERE status NOT IN ('INDEXED', 'FAILED')
       UNION ALL SELECT document_id, 'title', 'TOO_LONG' FROM doc_catalog WHERE length(title) > 8""",
)
def domain_violations(i: Inputs) -> DataFrame:
    return quality.domain_violations(
        i.doc_catalog, "document_id", required=["strategy"],
        enums={"status": ["INDEXED", "FAILED"]}, limits={"title": 8},
    )
