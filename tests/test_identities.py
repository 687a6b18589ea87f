"""Logins judged in order, the cached status, and passages, against plain loops."""

from __future__ import annotations

import random

import pytest

from groundwork.operators import evaluation, identities, limits


def judge_by_hand(users, logins):
    emails = {email: n for n, (_, email, _) in enumerate(users)}
    subjects = {s: n for n, (_, _, s) in enumerate(users) if s is not None}
    accounts = [[email, s] for _, email, s in users]
    out = []
    for login, subject, email, _ in sorted(logins, key=lambda r: (r[3], r[0])):
        if not (subject or "").strip() or not (email or "").strip():
            continue
        mine, theirs, reason = subjects.get(subject), emails.get(email), None
        if mine is not None:
            if accounts[mine][0] == email:
                action = "KEEP"
            elif theirs is not None:
                action, reason = "REJECT", "EMAIL_OF_OTHER_ACCOUNT"
            else:
                action = "CHANGE_EMAIL"
                del emails[accounts[mine][0]]
                accounts[mine][0] = email
                emails[email] = mine
        elif theirs is not None:
            if accounts[theirs][1] is not None:
                action, reason = "REJECT", "BOUND_TO_OTHER_SUBJECT"
            else:
                action = "BIND"
                accounts[theirs][1] = subject
                subjects[subject] = theirs
        else:
            action = "INSERT"
            accounts.append([email, subject])
            emails[email] = subjects[subject] = len(accounts) - 1
        out.append((login, action, reason))
    return sorted(out), sorted(map(tuple, accounts), key=str)


def frames(spark, users, logins):
    return (spark.createDataFrame(users, "user_id long, email string, ext_subject string"),
            spark.createDataFrame(logins, "login_id long, ext_subject string, email string, ts long"))


@pytest.mark.parametrize("logins, expected", [
    # A new subject's first login binds an account, its second one moves the account's e-mail.
    ([(1, "new", "b@x", 10), (2, "new", "c@x", 20)], ["BIND", "CHANGE_EMAIL"]),
    # The e-mail that a change has freed may be taken by the next subject, not by an earlier one.
    ([(1, "late", "a@x", 5), (2, "s1", "z@x", 10), (3, "late", "a@x", 20)], ["REJECT", "CHANGE_EMAIL", "INSERT"]),
    # A refused claim holds nothing.
    ([(1, "n1", "a@x", 1), (2, "n2", "n@x", 2), (3, "n1", "n@x", 3), (4, "n1", "o@x", 3)], ["REJECT", "INSERT", "REJECT", "INSERT"]),
])
def test_logins_are_judged_in_order(spark, logins, expected):
    users = [(1, "a@x", "s1"), (2, "b@x", None)]
    judged = identities.replay_logins(*frames(spark, users, logins)).collect()
    assert [r.action for r in sorted(judged, key=lambda r: (r.ts, r.login_id))] == expected


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_equals_judging_one_by_one(spark, seed):
    rng = random.Random(seed)
    users = [(n, f"e{n}", f"s{n}" if n % 3 else None) for n in range(8)]
    logins = [(n, rng.choice([None, " ", *[f"s{k}" for k in range(12)]]), rng.choice([None, *[f"e{k}" for k in range(12)]]), rng.randrange(60))
              for n in range(120)]
    frame, log = frames(spark, users, logins)
    judged = identities.replay_logins(frame, log, bucket_width=7)
    expected, accounts = judge_by_hand(users, logins)
    assert sorted((r.login_id, r.action, r.reason) for r in judged.collect()) == expected
    after = identities.accounts_after(frame, judged).collect()
    assert sorted(((r.email, r.ext_subject) for r in after), key=str) == accounts


@pytest.mark.parametrize("largest_group", [10_000, 5])
def test_replay_writes_the_log_once_however_long_its_chains(spark, largest_group, monkeypatch):
    # Each login waits for the one before it to free its e-mail: a chain of 40 links, and a group of its own.
    users = [(n, f"e{n}", f"s{n}") for n in range(40)] + [(100, "f0", "t0"), (101, "f1", None)]
    logins = [(n, f"s{39 - n}", f"e{40 - n}", n) for n in range(40)] + [(100, "t0", "f2", 1), (101, "new", "f0", 2), (102, "t1", "f1", 3)]
    written, settle = [], identities.settle
    monkeypatch.setattr(identities, "settle", lambda table, purpose: written.append(purpose) or settle(table, purpose))
    frame, log = frames(spark, users, logins)
    judged = identities.replay_logins(frame, log, largest_group=largest_group)
    expected, accounts = judge_by_hand(users, logins)
    assert sorted((r.login_id, r.action, r.reason) for r in judged.collect()) == expected
    assert sorted(((r.email, r.ext_subject) for r in identities.accounts_after(frame, judged).collect()), key=str) == accounts
    if largest_group > len(logins):
        assert "login-round" not in written


def test_of_accounts_with_one_email_the_first_counts(spark):
    users = [(1, "a@x", "s1"), (2, "a@x", None), (3, "b@x", "s3")]
    # The e-mail stays taken when its first account leaves it, and the account without a subject is bound.
    logins = [(1, "n", "a@x", 1), (2, "s1", "c@x", 2), (3, "s3", "a@x", 3), (4, "n", "a@x", 4)]
    frame, log = frames(spark, users, logins)
    judged = identities.replay_logins(frame, log)
    assert [r.action for r in judged.orderBy("login_id").collect()] == ["REJECT", "CHANGE_EMAIL", "REJECT", "BIND"]
    after = identities.accounts_after(frame, judged).orderBy("user_id").collect()
    assert [tuple(r) for r in after] == [(1, "c@x", "s1"), (2, "a@x", "n"), (3, "b@x", "s3")]


def cached_by_hand(requests, changes, ttl):
    events = sorted([(ts, 0, n, c, s, e) for n, c, ts, s, e in changes] + [(ts, 1, n, c, None, None) for n, c, ts in requests])
    stored, entries, out = {}, {}, []
    for ts, kind, n, client, status, evicts in events:
        if kind == 0:
            stored[client] = status
            if evicts:
                entries.pop(client, None)
        else:
            if client not in entries or ts - entries[client][0] >= ttl:
                entries[client] = (ts, stored.get(client))
            out.append((n, entries[client][1]))
    return sorted(out)


@pytest.mark.parametrize("ttl", [3, 10, 1000])
def test_cached_status_equals_a_cache(spark, ttl):
    rng = random.Random(ttl)
    requests = [(n, f"c{n % 3}", rng.randrange(300)) for n in range(400)]
    changes = [(1000 + n, f"c{n % 4}", rng.randrange(300), f"v{n}", rng.random() < 0.4) for n in range(40)]
    asked = spark.createDataFrame(requests, "event_id long, client string, ts long")
    told = spark.createDataFrame(changes, "event_id long, client string, ts long, status string, evicts boolean")
    found = limits.status_cached(asked, told, ttl, bucket_width=17).collect()
    assert sorted((r.event_id, r.status) for r in found) == cached_by_hand(requests, changes, ttl)
    plain = limits.status_cached(asked, told.drop("evicts"), ttl, bucket_width=17).collect()
    # Where every change evicts, the cache shows what is stored.
    asof = limits.status_asof(asked, told, bucket_width=17).collect()
    assert sorted((r.event_id, str(r.status)) for r in plain) == sorted((r.event_id, str(r.status)) for r in asof)


def test_passages_meet_few_documents_whatever_they_share(spark):
    docs = [(n, f"the of and a {'rare' + str(n)} the of and word{n % 5}") for n in range(200)]
    passages = [(n, f"and a rare{n} the of") for n in range(0, 200, 7)] + [(1000, "the of"), (1001, "nowhere at all"), (1002, ""), (1003, "ord3")]
    frame = spark.createDataFrame(docs, "doc_id int, text string")
    asked = spark.createDataFrame(passages, "item_id int, text string")
    found = sorted((r.query_id, r.chunk_id) for r in evaluation.passages_in(asked, frame).collect())
    assert found == sorted((q, n) for q, p in passages for n, t in docs if p in t)
