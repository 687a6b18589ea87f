"""Accounts: permissions, identities, admission, roles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions import lexicon as lex
from groundwork.functions.text import is_blank, trim

ADMIN = "ROLE_ADMIN"


def permissions_by_user(permissions: DataFrame, subjects: DataFrame) -> DataFrame:
    """Per user the list of ``(name, subject_id, level)``, by subject name."""
    named = permissions.join(subjects.select("subject_id", "name"), "subject_id")
    listed = F.array_sort(F.collect_list(F.struct("name", "subject_id", "level")))
    return named.groupBy("user_id").agg(listed.alias("permissions"))


def apply_permission_changes(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Permissions ``user_id, subject_id, level, granted_at`` after a batch of changes.

    ``changes(change_id, user_id, subject_id, level, revoke, ts)`` apply in order of ``ts`` and
    id. A later grant changes the level and keeps the date; a revoke ends the permission.
    """
    key = ["user_id", "subject_id"]
    order = F.struct("ts", "change_id")
    ends = changes.groupBy(*key).agg(
        F.max(F.when(F.col("revoke"), order)).alias("_ended"),
        F.max_by("revoke", order).alias("_gone"),
        F.max_by(F.when(~F.col("revoke"), F.col("level")), F.when(~F.col("revoke"), order)).alias("_level"),
    )
    after_end = F.col("_ended").isNull() | (order > F.col("_ended"))
    starts = (
        changes.where(~F.col("revoke"))
        .join(ends.select(*key, "_ended"), key)
        .where(after_end)
        .groupBy(*key)
        .agg(F.min("ts").alias("_started"))
    )
    changed = ends.join(starts, key, "left")
    merged = current.join(changed, key, "full_outer").where(~F.coalesce("_gone", F.lit(False)))
    kept = F.when(F.col("_ended").isNull(), F.col("granted_at"))
    return merged.select(
        *key,
        F.coalesce("_level", "level").alias("level"),
        F.coalesce(kept, "_started", "granted_at").alias("granted_at"),
    )


def merge_identities(users: DataFrame, logins: DataFrame) -> DataFrame:
    """What the latest login of each external subject does to the accounts.

    ``users(user_id, email, ext_subject)``, ``logins(login_id, ext_subject, email, ts)``. Actions:
    KEEP, CHANGE_EMAIL, BIND, INSERT or REJECT, judged against the accounts before the batch. When
    several subjects claim the same e-mail in one batch, the earliest login wins among those that
    the accounts do not refuse.
    """
    identified = logins.where(~is_blank(F.col("ext_subject")))
    order = F.struct("ts", "login_id")
    latest = identified.groupBy("ext_subject").agg(
        F.max_by(F.struct("login_id", "email", "ts"), order).alias("l")
    )
    latest = latest.select("ext_subject", "l.login_id", "l.email", "l.ts")
    by_subject = users.where(F.col("ext_subject").isNotNull()).select(
        "ext_subject", F.col("user_id").alias("_s_user"), F.col("email").alias("_s_email")
    )
    by_email = users.select(
        "email", F.col("user_id").alias("_e_user"), F.col("ext_subject").alias("_e_subject")
    )
    known, taken = F.col("_s_user").isNotNull(), F.col("_e_user").isNotNull()
    refusal = (
        F.when(known & taken, "EMAIL_OF_OTHER_ACCOUNT")
        .when(taken & F.col("_e_subject").isNotNull(), "BOUND_TO_OTHER_SUBJECT")
    )
    met = (
        latest.join(by_subject, "ext_subject", "left")
        .join(by_email, "email", "left")
        .withColumn("_keeps", F.coalesce(known & (F.col("_s_email") == F.col("email")), F.lit(False)))
        .withColumn("_refusal", F.when(~F.col("_keeps"), refusal))
    )
    # Who keeps an e-mail or is refused it claims nothing.
    claims = met.where(~F.col("_keeps") & F.col("_refusal").isNull())
    first_claim = claims.groupBy("email").agg(F.min(order).alias("_first"))
    joined = met.join(first_claim, "email", "left")
    late = ~F.col("_keeps") & (order != F.col("_first"))
    reason = F.coalesce("_refusal", F.when(late, "CLAIMED_IN_BATCH"))
    action = (
        F.when(F.col("_keeps"), "KEEP")
        .when(reason.isNotNull(), "REJECT")
        .when(known, "CHANGE_EMAIL")
        .when(taken, "BIND")
        .otherwise("INSERT")
    )
    return joined.select(
        "ext_subject", "email", F.coalesce("_s_user", "_e_user").alias("user_id"),
        action.alias("action"), reason.alias("reason"),
    )


def apply_identities(users: DataFrame, merged: DataFrame) -> DataFrame:
    """The accounts after the merge; new ones come without an id."""
    accepted = merged.where(F.col("action") != "REJECT")
    changes = accepted.where(F.col("user_id").isNotNull()).select(
        "user_id", F.col("email").alias("_email"), F.col("ext_subject").alias("_subject")
    )
    updated = users.select("user_id", "email", "ext_subject").join(changes, "user_id", "left").select(
        "user_id",
        F.coalesce("_email", "email").alias("email"),
        F.coalesce("_subject", "ext_subject").alias("ext_subject"),
    )
    inserted = accepted.where(F.col("action") == "INSERT").select("user_id", "email", "ext_subject")
    return updated.unionByName(inserted)


def email_domain(email: Column) -> Column:
    return F.lower(trim(F.substring_index(email, "@", -1)))


def admission_audit(
    logins: DataFrame, users: DataFrame, domains: Sequence[str], require_hosted: bool = True
) -> DataFrame:
    """Each login with the first reason to turn it away, or ``ADMITTED``."""
    by_subject = users.where(F.col("ext_subject").isNotNull()).select(
        "ext_subject", F.col("user_id").alias("_s_user"), F.col("active").alias("_s_active")
    )
    by_email = users.select(
        "email", F.col("user_id").alias("_e_user"), F.col("active").alias("_e_active"),
        F.col("ext_subject").alias("_e_subject"),
    )
    joined = logins.join(by_subject, "ext_subject", "left").join(by_email, "email", "left")
    email, hosted = F.col("email"), F.lower(trim(F.col("hosted_domain")))
    allowed = F.lit(True) if not domains else F.contains(email, F.lit("@")) & email_domain(email).isin(*domains)
    managed = F.lit(True)
    if domains and require_hosted:
        managed = ~is_blank(F.col("hosted_domain")) & hosted.isin(*domains) & (hosted == email_domain(email))
    # An account found by its subject is the account; else the one with the e-mail.
    by_mail = F.col("_s_user").isNull()
    other = by_mail & F.col("_e_subject").isNotNull() & (F.col("_e_subject") != F.col("ext_subject"))
    active = F.when(by_mail, F.col("_e_active")).otherwise(F.col("_s_active"))
    moved = ~by_mail & F.col("_e_user").isNotNull() & (F.col("_e_user") != F.col("_s_user"))
    verdict = (
        F.when(is_blank(email) | ~F.coalesce("email_verified", F.lit(False)), "EMAIL_NOT_VERIFIED")
        .when(~allowed, "DOMAIN_NOT_ALLOWED")
        .when(~managed, "HOSTED_DOMAIN_NOT_ALLOWED")
        .when(is_blank(F.col("ext_subject")), "SUBJECT_MISSING")
        .when(other, "BOUND_TO_OTHER_SUBJECT")
        .when(~active, "ACCOUNT_DISABLED")
        .when(moved, "EMAIL_OF_OTHER_ACCOUNT")
        .otherwise("ADMITTED")
    )
    return joined.select("login_id", verdict.alias("verdict"))


def last_admin_check(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Outcome of planned changes ``change_id, actor_email, user_id, new_role, deactivate``.

    Judged against the accounts before the batch: nobody demotes or deactivates themselves, and
    another active administrator must remain. ``together_unsafe`` marks changes that are each
    allowed but that together would leave no active administrator.
    """
    admin = F.col("role") == ADMIN
    active_admin = admin & F.col("active")
    admins = users.agg(F.count_if(active_admin)).scalar()
    accounts = users.select("user_id", "email", "role", "active")
    joined = changes.join(accounts, "user_id", "left")
    demotes = admin & F.col("new_role").isNotNull() & (F.col("new_role") != ADMIN)
    turns_off = F.coalesce("deactivate", F.lit(False)) & F.col("active")
    is_self = F.lower(trim(F.col("actor_email"))) == F.lower("email")
    removes = active_admin & (demotes | turns_off)
    outcome = (
        F.when(F.col("role").isNull(), "NOT_FOUND")
        .when((demotes | turns_off) & is_self, "SELF_CHANGE")
        .when(removes & (F.lit(admins) - 1 < 1), "LAST_ADMIN")
        .otherwise("ALLOWED")
    )
    judged = joined.withColumn("outcome", outcome).withColumn(
        "_removes", removes & (F.col("outcome") == "ALLOWED")
    )
    removed = judged.agg(F.count_distinct(F.when(F.col("_removes"), F.col("user_id")))).scalar()
    return judged.select(
        "change_id", "user_id", "outcome",
        F.coalesce(F.col("_removes") & (removed >= admins), F.lit(False)).alias("together_unsafe"),
    )


def refresh_roles(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """What happens to each login session ``session_id, user_id, granted_role`` now."""
    current = users.select("user_id", "role", "active")
    joined = sessions.join(current, "user_id", "left")
    action = (
        F.when(F.col("role").isNull() | ~F.col("active"), "REJECT")
        .when(F.col("granted_role") != F.col("role"), "REPLACE")
        .otherwise("KEEP")
    )
    return joined.select(
        "session_id", "user_id", action.alias("action"),
        F.when(action != "REJECT", F.col("role")).alias("role"),
    )


def url_allowlist_audit(
    urls: DataFrame, allowed: Mapping[str, Sequence[str]] = lex.PROVIDER_HOSTS,
    http_providers: Sequence[str] = ("OLLAMA_LOCAL",), max_length: int = 255,
) -> DataFrame:
    """Base URLs ``id, provider, url`` with the first reason to refuse them, or ``ALLOWED``."""
    url = trim(F.col("url"))
    malformed = (
        url.rlike(r'[\s<>"{}|\\^`]') | url.rlike(r"%(?![0-9A-Fa-f]{2})")
        # Two slashes must be followed by an authority or a path.
        | url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://($|[?#])")
    )

    def part(pattern: str) -> Column:
        return F.regexp_extract(url, pattern, 1)

    scheme = F.lower(part(r"^([A-Za-z][A-Za-z0-9+.-]*):"))
    authority = part(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)")
    server = F.regexp_replace(authority, r"^.*@", "")
    host = F.regexp_replace(F.regexp_replace(server, r":\d*$", ""), r"^\[(.*)\]$", "$1")
    host = F.regexp_replace(F.lower(host), r"\.+$", "")
    # Only an authority of host name or address and a numeric port has a host.
    label = "[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
    served = server.rlike(
        rf"^(?:(?:{label}\.)*[A-Za-z](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.?|\d+(?:\.\d+){{3}}|\[[0-9A-Fa-f:.%]+\])(?::\d*)?$")
    host = F.when(served, host).otherwise("")
    plain_http = (scheme == "http") & F.col("provider").isin(*http_providers)
    listed = F.array(*[
        F.struct(F.lit(p).alias("provider"), F.lit(h).alias("host")) for p, hosts in allowed.items() for h in hosts
    ])
    verdict = (
        F.when(is_blank(F.col("url")), "DEFAULT")
        .when(F.length(url) > max_length, "TOO_LONG")
        .when(malformed, "MALFORMED")
        .when(~((scheme == "https") | plain_http), "SCHEME")
        .when(F.contains(authority, F.lit("@")), "USER_INFO")
        .when(url.rlike(r"[?#]"), "QUERY_OR_FRAGMENT")
        .when(host == "", "MISSING_HOST")
    )
    known = F.array_contains(listed, F.struct(F.col("provider").alias("provider"), host.alias("host")))
    return urls.select(
        "id", "provider", host.alias("host"),
        verdict.when(~known, "HOST_NOT_ALLOWED").otherwise("ALLOWED").alias("verdict"),
    )
