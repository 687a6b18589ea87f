"""The operators for training text against brute force, and their defined results for odd input."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from groundwork.llm import (
    bloom, common, components, decontaminate, licenses, lines, near, neighbours, packing, pii, queries, simhash, substring,
    toxicity, urls)

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, component_id string, doc string, __print int"


def frame(spark, rows):
    """Documents with extra columns, some with names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", "x", "y", 1) for i, t in rows], SCHEMA)


def odd(spark):
    """Null ids and texts, empty and blank texts, repeated rows, one long text."""
    run = " ".join(f"w{k}" for k in range(80))
    return frame(spark, [(3, None), (4, ""), (5, " \t\n "), (None, run), (6, run), (6, run), (7, "pre " + run + " post"),
                         (8, "a b c " * 20_000), (9, "short text")])


def rows(table, *columns):
    return sorted((tuple(r) for r in table.select(*columns).collect()), key=str)


def load(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def texts(spark):
    return [(r.doc_id, r.text or "") for r in load(spark).select("doc_id", "text").collect()]


class Sets:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


# -- op1 ------------------------------------------------------------------------------------------


def cut_by_hand(docs, window):
    first = {}
    for i, text in docs:
        words = WORD.findall(text or "")
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            first[key] = min(first.get(key, 2**63), 2**63 - 1 if i is None else i)
    out = []
    for i, text in docs:
        words, gone = WORD.findall(text or ""), set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < (2**63 - 1 if i is None else i):
                gone |= set(range(k, k + window))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


def test_substring_dedup_of_odd_rows(spark):
    docs = odd(spark)
    found = substring.dedup_substrings(docs, window=50)
    assert rows(found, "doc_id", "n_words", "n_removed", "kept") == cut_by_hand(
        [(r.doc_id, r.text) for r in docs.collect()], 50)
    assert substring.dedup_substrings(docs.limit(0)).count() == 0


def test_substring_dedup_of_shared_passages_in_other_surroundings(spark):
    passage = [f"p{k}" for k in range(70)]
    made = [(k, " ".join([f"a{k}x{j}" for j in range(k % 7 * 9)] + passage[k % 11 : 70 - k % 5] + [f"b{k}"] * 30))
            for k in range(60)]
    found = substring.dedup_substrings(frame(spark, made), window=20, mer=4)
    assert rows(found, "doc_id", "n_words", "n_removed", "kept") == cut_by_hand(made, 20)


# -- op2 ------------------------------------------------------------------------------------------


def mark_by_hand(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text))
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + n]), 42) for k in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_fingerprints(spark):
    docs = texts(spark) + [(10**6, None), (10**6 + 1, "One"), (10**6 + 2, "one TWO")]
    found = simhash.near_duplicates(frame(spark, docs))
    assert rows(found, "doc_id", "fingerprint") == sorted(
        ((i, f"{mark_by_hand(t or ''):016x}") for i, t in docs), key=str)


@pytest.mark.parametrize("bucket", [256, 4])
def test_simhash_links_lose_nothing(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(7)
    marks = [int(x) for x in rng.integers(0, 2**63, 150)]
    for _ in range(350):
        base = marks[int(rng.integers(0, len(marks)))] if rng.random() < 0.6 else marks[0]
        for bit in rng.integers(0, 64, int(rng.integers(1, 4))):
            base ^= 1 << int(bit)
        marks.append(base)
    marks = sorted({m - 2**64 if m >= 2**63 else m for m in (x % 2**64 for x in marks)})
    sets = Sets(len(marks))
    for a in range(len(marks)):
        for b in range(a):
            if ((marks[a] ^ marks[b]) & (2**64 - 1)).bit_count() <= 2:
                sets.join(a, b)
    lowest = {}
    for k, m in enumerate(marks):
        lowest[sets.find(k)] = min(m, lowest.get(sets.find(k), m))
    want = {m: lowest[sets.find(k)] for k, m in enumerate(marks)}
    roots = components.components(simhash.links(spark.createDataFrame([(m,) for m in marks], "fp bigint"))).collect()
    got = {m: m for m in marks} | {r.node: r.root for r in roots}
    assert got == want


def test_simhash_keeps_one_row_of_each_component(spark):
    docs = odd(spark)
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert rows(kept, "doc_id") == [(3,), (6,), (7,), (8,), (9,)]
    named = simhash.near_duplicates(docs)
    assert [r.component_id for r in named.where("doc_id IN (4, 5)").collect()] == [3, 3]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def unlinked(spark):
    """Different texts without an id and under one id, and a copy of one of them."""
    made = [" ".join(f"{w}{k}" for k in range(60)) for w in "abcde"]
    return frame(spark, [(None, made[0]), (None, made[1]), (None, made[1]), (7, made[2]), (7, made[3]), (8, made[3]), (9, made[4])])


def test_simhash_keeps_unlinked_texts_without_id_or_of_one_id(spark):
    kept = simhash.without_near_duplicates(unlinked(spark))
    assert sorted((str(r.doc_id), r.text[0]) for r in kept.collect()) == [
        ("7", "c"), ("7", "d"), ("9", "e"), ("None", "a"), ("None", "b")]


# -- near copies ----------------------------------------------------------------------------------


def five_words(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    n = min(5, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def test_near_copies_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near, "TILE", 4)
    rng = np.random.default_rng(11)
    made = [None, "", " \n", "One two", "one  TWO", "two one"]
    for n, changes in [(100, 1), (300, 3), (1000, 10), (1000, 3), (200, 12)] * 12:
        base = [f"w{x}" for x in rng.integers(0, 10**6, n)]
        made.append(" ".join(base))
        for _ in range(2):
            copy = list(base)
            for at in rng.integers(0, n, changes):
                copy[at] = f"v{rng.integers(0, 10**6)}"
            made.append(" ".join(copy))
    chain = [f"c{k}" for k in range(60)]
    for k in range(40):
        made.append(" ".join(chain[k:]+ [f"d{j}" for j in range(k)]))
    sets, up = [five_words(t) for t in made], Sets(len(made))
    for a in range(len(made)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                up.join(a, b)
    lowest = {}
    for k in range(len(made)):
        lowest.setdefault(up.find(k), k)
    docs = frame(spark, list(enumerate(made)))
    kept = near.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(lowest.values())
    assert near.without_near_copies(docs.limit(0)).count() == 0


def test_near_copies_are_not_made_by_ids(spark):
    kept = near.without_near_copies(unlinked(spark))
    assert sorted((str(r.doc_id), r.text[0]) for r in kept.collect()) == [
        ("7", "c"), ("7", "d"), ("9", "e"), ("None", "a"), ("None", "b")]


def test_near_dedup_stage_drops_near_copies(spark):
    import corpus_pipeline

    words = [f"w{k}" for k in range(300)]
    made = [(k, " ".join(words[: 50 * k] + [f"x{k}"] + words[50 * k + 1 :])) for k in range(6)]
    docs = frame(spark, [*made, (9, "other words")])
    assert rows(corpus_pipeline.near_dedup_stage(spark, docs, SF), "doc_id") == [(0,), (9,)]


def test_near_dedup_stage_drops_what_line_dedup_left_of_near_copies(spark, tmp_path):
    """Near copies go whole, with and without an id; what two rows have left does not link what they were cut from."""
    import corpus_pipeline

    def lined(word, changed="", last=""):
        made = [" ".join(f"{word}{n}x{k}" for k in range(12)) for n in range(20)] + ([last] if last else [])
        if changed:
            made[3] = " ".join(f"{changed}{k}" for k in range(12))
        return "\n".join(made)

    made = [(1, lined("a")), (2, lined("a", "b")), (3, lined("c")), (4, lined("c", "d") + "\n" + lined("e")),
            (5, lined("f")), (6, lined("f", last="Same rest here")), (7, lined("g")), (8, lined("g", last="same REST here")),
            (9, lined("h")), (9, lined("h", "i")), (None, lined("j")), (None, lined("j", "k")), (None, lined("l"))]
    frame(spark, made).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    corpus_pipeline.line_dedup_stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/cut.parquet")
    cut = spark.read.parquet(f"{tmp_path}/cut.parquet")
    assert cut.count() == len(made)
    kept = corpus_pipeline.near_dedup_stage(spark, cut, str(tmp_path))
    assert kept.columns == cut.columns
    left = sorted((str(r.doc_id), sorted({w[0] for w in r.text.split()})) for r in kept.collect())
    named = [(i, w) for i, w in left if i not in ("9", "None")]
    # Half of document 4 is new.
    assert named == [("1", ["a"]), ("3", ["c"]), ("4", ["d", "e"]), ("5", ["f"]), ("7", ["g"])]
    assert len([i for i, _ in left if i == "9"]) == 1 and len([i for i, _ in left if i == "None"]) == 2


def test_near_copies_of_documents_with_common_boilerplate(spark, monkeypatch):
    """Dissimilar texts that share most of their words meet in bands, but few of their pairs move any set."""
    compared = []
    links = near._links
    monkeypatch.setattr(near, "_links", lambda pairs, *more: compared.append(pairs.count()) or links(pairs, *more))
    shared = [f"w{k}" for k in range(200)]
    made = [" ".join(shared + [f"x{n}y{k}" for k in range(120)]) for n in range(400)]
    made += [made[0].replace("x0y7 ", "z ")]
    kept = near.without_near_copies(frame(spark, list(enumerate(made))))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(400))
    assert sum(compared) < 4 * len(made)


def test_sketches_refuse_no_similar_pair(spark):
    """Pairs at the least similarity, whatever their size, pass the test by sketches."""
    rng = np.random.default_rng(3)
    made, pairs = [], []
    for n in [1, 4, 8, 40, 400] * 40:
        both = rng.integers(0, 2**63, n).astype(np.uint64)
        extra = rng.integers(0, 2**63, n // 4).astype(np.uint64)
        pairs.append((len(made), len(made) + 1))
        made += [np.unique(both), np.unique(np.concatenate([both, extra]))]
    lowest = np.array([(s[:, None] * near._BY[None, :]).min(axis=0) for s in made])
    sketch = np.ascontiguousarray(lowest.astype(np.uint8)).view(np.int64)
    data = [(len(made[x]), len(made[y]), *map(int, sketch[x]), *map(int, sketch[y])) for x, y in pairs]
    names = [f"{c}_{side}" for side in "xy" for c in near.SKETCH]
    table = spark.createDataFrame(data, ["size_x", "size_y", *names])
    assert table.where(near._likely(0.8)).count() == len(pairs)
    assert table.where(near._likely(0.99)).count() < len(pairs)


def test_components_of_hubs(spark):
    """Two stars, one around the largest and one around the smallest node, tied by one edge."""
    edges = [(10_000, k) for k in range(1, 400)] + [(0, 20_000 + k) for k in range(400)] + [(20_000, 399)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0} and len(got) == 400 + 401


def test_spread_join_repeats_and_loses_nothing(spark):
    left = spark.createDataFrame([(1 if k < 500 else k, k) for k in range(700)] + [(None, 5)], "key int, n int")
    right = spark.createDataFrame([(k, str(k)) for k in range(650)] + [(None, "none")], "key int, name string")
    got = common.spread_join(left, right, "key", "n", left.count())
    assert got.columns == ["key", "n", "name"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "key").collect()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 500), (None, 3), (700, 600)], "a int, b int")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {k: 0 for k in range(201)} | {700: 600, 600: 600}


# -- op3 ------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    values = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(number))]
    return sum(v - 9 * (v > 9) for v in values) % 10 == 0


def good(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind != "ip" or all(int(p) < 256 for p in match.split(".")),
            "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def spans_by_hand(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "")
                    if good(k, m[0]))


def test_pii_base_spans(spark):
    made = ["", None, "a@b.c_x@d.e, q@w a.b+c@x-y.z.de.", "1.2.3.4.5.6.7.8 999.1.1.1 000255.01.2.3 1.2.3",
            "4111 1111 1111 1111 and 4111-1111-1111-1112, 378282246310005", "é\U0001f600 +49 (30) 1234-5678. +1 2 +123456789",
            "x@y.z " * 900, "7" * 30_000, "a" * 30_000 + "@b.c", "\n\x00 +1 234 567 890@q.w 4111111111111111"]
    rng = np.random.default_rng(3)
    made += ["".join(rng.choice(list("01 -.+@aZ()_%é45"), 200)) for _ in range(150)]
    docs = frame(spark, list(enumerate(made)))
    found = pii.find_personal_data(docs)
    assert rows(found, "doc_id", "base") == sorted(((i, spans_by_hand(t)) for i, t in enumerate(made)), key=str)


def test_pii_added_spans_need_checksum_or_context(spark):
    made = [(1, "Konto DE89 3704 0044 0532 0130 00."), (2, "DE88370400440532013000"), (3, "ssn 123-45-6789"),
            (4, "part 123-45-6789"), (5, "ssn 000-45-6789")]
    found = {r.doc_id: r.spans for r in pii.find_personal_data(frame(spark, made)).collect()}
    assert "iban:6:33" in found[1] and "iban" not in found[2]
    assert found[3] == "national:4:15" and found[4] == found[5] == ""


def added(spark, made):
    """For each text the added spans as (kind, what it covers)."""
    found = {r.doc_id: r.spans for r in pii.find_personal_data(frame(spark, list(enumerate(made)))).collect()}
    kinds = {k.name for k in pii.ADDED}
    return [[(kind, text[int(a) : int(b)]) for kind, a, b in (s.split(":") for s in found[k].split(",") if s)
             if kind in kinds] for k, text in enumerate(made)]


def test_pii_secrets_behind_names(spark):
    long_hex = hashlib.sha1(b"x").hexdigest()
    made = [f'token = "{long_hex}" and more', "password=b7db7aa4a5fcc78305 next", "API_KEY: 'aB3-x9Q7.zz01'", "password=hunter",
            "password: correcthorsebattery", "the token ring has 12345678abc", "pwd=aaaaaaaa1", f"digest {long_hex}", "password=" + "1a" * 20,
            f"my_secret={long_hex}tail", "an example: password=b7db7aa4a5fcc78305", "token=" + "k3J9x0Qz" * 20_000]
    got = added(spark, made)
    assert got[:3] == [[("secret", long_hex)], [("secret", "b7db7aa4a5fcc78305")], [("secret", "aB3-x9Q7.zz01")]]
    assert got[3:9] == [[]] * 6
    assert got[9] == [("secret", long_hex + "tail")] and got[11] == [("secret", made[11][6:])]
    # A word that says so lowers the score; one that speaks of logins raises it again, and the name itself is one.
    assert got[10] == [("secret", "b7db7aa4a5fcc78305")]
    assert added(spark, ["dummy token=b7db7aa4a5fcc78305", "dummy login token=b7db7aa4a5fcc78305"]) == [
        [], [("secret", "b7db7aa4a5fcc78305")]]


def test_pii_keys_by_form(spark):
    key, hub = "AKIA" + "Q3EGRX7T2PLM9KZA", "ghp_" + "a1B2c3D4e5F6" * 3
    assert added(spark, [f"id {key},", f"x{key}", key[:-1], f"use {hub} now", f"fake key {key}"]) == [
        [("key", key)], [], [], [("key", hub)], []]


def test_pii_context_raises_and_lowers(spark):
    iban, routing, dni = "DE89370400440532013000", "021000021", "12345678Z"
    assert added(spark, [f"sample {iban}", f"sample account {iban}", iban, f"routing {routing}", routing, "routing 021000022",
                         f"dni {dni}", dni, "dni 12345678A", "nie X1234567L", f"example dni {dni}"]) == [
        [], [("iban", iban)], [("iban", iban)], [("routing", routing)], [], [], [("dni", dni)], [], [],
        [("dni", "X1234567L")], []]


def test_pii_odd_rows_and_no_rows(spark):
    docs = odd(spark)
    found = pii.find_personal_data(docs)
    assert found.count() == docs.count() and {r.spans for r in found.collect()} == {""}
    assert pii.find_personal_data(docs.limit(0)).count() == 0
    assert [r.spans for r in pii.find_personal_data(frame(spark, [(1, "a@b.c")] * 2)).collect()] == ["email:0:5"] * 2


def test_ibans_end_where_their_country_says(spark):
    compact, spaced = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    made = [f"IBAN {compact} BIC COBADEFFXXX", f"{spaced} A note", f"{spaced} 12 May", f"{compact} 250 EUR", f"pay {spaced} EUR 5",
            f"{compact} {spaced}", "GB29 NWBK 6016 1331 9268 19 AND MORE", "FR14 2004 1010 0505 0001 3M02 606 LE 3", "NO93 8601 1117 947 2026",
            "MT84 MALT 0110 0001 2345 MTLC AST0 01S BANK", "BE12 3456 7890 1234 " + spaced, f"{compact}1", "ZZ89 3704 0044 0532 0130 00"]
    found = {r.doc_id: r.spans for r in pii.find_personal_data(frame(spark, list(enumerate(made)))).collect()}
    got = [[made[k][int(a) : int(b)] for a, b in re.findall("iban:([0-9]+):([0-9]+)", found[k])] for k in range(len(made))]
    assert got == [[compact], [spaced], [spaced], [compact], [spaced], [compact, spaced], ["GB29 NWBK 6016 1331 9268 19"],
                   ["FR14 2004 1010 0505 0001 3M02 606"], ["NO93 8601 1117 947"], ["MT84 MALT 0110 0001 2345 MTLC AST0 01S"],
                   [spaced], [], []]


# -- op4 ------------------------------------------------------------------------------------------


def test_url_rules_and_list(spark):
    made = [(1, "https://a.example.net/en/x"), (2, "http://NET/de"), (3, "https://x.org/fr/1"), (4, "ftp://example.com/de/?q"),
            (5, "https://shop.test/a/?utm_source=x#y"), (6, "http://www.shop.test:80/a.html"), (7, "http://shop.test/b"),
            (8, None), (9, "no scheme"), (10, "http://xexample.net/en/"), (10, "http://net?x"), (None, "http://shop.test/a")]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in made], "page_id bigint, url string, host string, bloom_block int")
    got = {(r.page_id, r.host): (r.path, r.rule, r.verdict) for r in urls.judge_urls(
        pages, queries.campaign_urls(pages), queries.RULES).collect()}
    assert got == {
        (1, "a.example.net"): ("/en/x", "example.net/en/", "allow"), (2, "net"): ("/de", "net/", "block"),
        (3, "x.org"): ("/fr/1", "org/fr/", "allow"), (4, "example.com"): ("/de/", "example.com/de/", "block"),
        (5, "shop.test"): ("/a/", None, "block"), (6, "www.shop.test:80"): ("/a.html", None, "block"),
        (7, "shop.test"): ("/b", None, "allow"), (8, ""): ("", None, "allow"), (9, ""): ("", None, "allow"),
        (10, "xexample.net"): ("/en/", "net/", "block"), (10, "net"): ("", None, "allow"),
        (None, "shop.test"): ("/a", None, "block")}
    assert urls.judge_urls(pages.limit(0), pages.limit(0).select("url"), []).count() == 0


def test_bloom_filter_never_misses(spark):
    keys = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"))
    filled = bloom.bloom_filter(keys, "key", blocks=64)
    assert filled.count() <= 64
    assert bloom.may_hold(keys, filled, "key", blocks=64).where("NOT bloom_hit").count() == 0
    others = spark.range(500, 1500).select(F.concat(F.lit("k"), "id").alias("key"))
    assert bloom.may_hold(others, bloom.bloom_filter(keys, "key"), "key").where("bloom_hit").count() < 50


# -- op5 ------------------------------------------------------------------------------------------


def lines_by_hand(docs, least=0.8):
    places = {}
    for i, text in docs:
        for at, line in enumerate((text or "").split("\n")):
            if line := line.strip(" \t\r"):
                places.setdefault(line, []).append((2**63 - 1 if i is None else i, at))
    names = list(places)
    grams = [{x[k : k + lines.SHINGLE] for k in range(max(1, len(x) - lines.SHINGLE + 1))} for x in names]
    sets = Sets(len(names))
    for a in range(len(names)):
        for b in range(a):
            both = len(grams[a] & grams[b])
            if both and both >= least * (len(grams[a]) + len(grams[b]) - both):
                sets.join(a, b)
    groups = {}
    for k, name in enumerate(names):
        groups.setdefault(sets.find(k), []).extend(places[name])
    return {p for g in groups.values() for p in set(g) - {min(g)}}


def removed(found):
    return {(2**63 - 1 if r.doc_id is None else r.doc_id, int(k))
            for r in found.collect() for k in r.removed.split(",") if k}


def test_line_dedup_against_all_pairs(spark):
    docs = texts(spark)
    got, want = removed(lines.judge_lines(frame(spark, docs))), lines_by_hand(docs)
    # Only MinHash banding may miss a pair, and rarely.
    assert got <= want and len(want - got) <= 0.01 * len(want)


def test_line_tiles_link_all_that_is_similar(spark, monkeypatch):
    # Lines of one bucket in two families and a bridge: more lines than a tile holds, one component that fills tiles.
    monkeypatch.setattr(lines, "TILE", 4)
    rng = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyz ")

    def altered(text, n):
        chars = list(text)
        for at in rng.integers(0, len(chars), n):
            chars[at] = letters[rng.integers(27)]
        return "".join(chars)

    base = "".join(rng.choice(letters, 400))
    far = altered(base, 14)
    texts = list(dict.fromkeys([altered(base, 2) for _ in range(30)] + [altered(far, 3) for _ in range(20)]))
    made = spark.createDataFrame([(k, -k, t) for k, t in enumerate(texts)], "k1 long, k2 long, line string")
    rows = lines.with_bitmaps(made)
    # Ten lines are one component already, the others are apart.
    apart = made.select(F.lit(7).cast("long").alias("band"), "k1",
                        F.when(F.col("k1") < 10, 0).otherwise(F.col("k1")).cast("long").alias("label"))
    found = [(r.a.k1, r.b.k1) for r in lines.links_apart(apart, rows, 0.8).collect()]
    sets, want = Sets(len(texts)), Sets(len(texts))
    grams = [lines.shingle_set(t) for t in texts]

    def alike(a, b):
        return len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])

    for k in range(10):
        sets.join(0, k)
        want.join(0, k)
    for a, b in found:
        assert alike(a, b)
        sets.join(a, b)
    for a in range(len(texts)):
        for b in range(a):
            if alike(a, b):
                want.join(a, b)
    assert all((sets.find(a) == sets.find(b)) == (want.find(a) == want.find(b))
               for a in range(len(texts)) for b in range(a))


def test_long_lines_are_hashed_in_parts(monkeypatch):
    made = ["ab", "", "the quick brown fox jumps over the lazy dog " * 9, "é" * 300, "0123456789"]
    keys, bits = lines.band_keys(made), lines.bitmap_words(made)
    monkeypatch.setattr(lines, "PART", 37)
    assert (lines.band_keys(made) == keys).all() and (lines.bitmap_words(made) == bits).all()
    assert [len(lines.shingle_set(t)) for t in made] == [1, 1, 44, 1, 1]


def test_line_dedup_of_odd_rows(spark):
    long_line = "the quick brown fox jumps over the lazy dog and runs through the forest until night falls again "
    made = [(1, f"{long_line}one\nshort\n\nshort"), (2, f"  {long_line}one\r\nother"), (3, f"{long_line}two\n\nshort"),
            (None, "short"), (4, None), (5, ""), (6, "\n \n"), (7, "ab"), (8, "ab"), (9, "é" * 50_000)]
    docs = frame(spark, made)
    assert removed(lines.judge_lines(docs)) == lines_by_hand(made)
    kept = lines.without_repeated_lines(docs)
    assert kept.columns == docs.columns
    left = {r.doc_id: r.text for r in kept.collect()}
    assert left[1] == f"{long_line}one\nshort\n" and left[2] == "other" and left[7] == "ab"
    assert left[4] is None and left[5] == "" and left[6] == "\n \n" and not {3, 8, None} & set(left)
    assert lines.judge_lines(docs.limit(0)).count() == 0


def test_line_dedup_tells_rows_without_id_or_of_one_id_apart(spark):
    made = [(1, "shared line"), (None, "one\ntwo\nshared line\nfour"), (None, "five\nsix\nseven\neight"),
            (4, "head\nsame"), (4, "cape\nsame"), (4, "tail\nnine")]
    kept = [(r.doc_id, r.text) for r in lines.without_repeated_lines(frame(spark, made)).collect()]
    texts = {t for _, t in kept}
    assert len(kept) == 6 and {"shared line", "one\ntwo\nfour", "five\nsix\nseven\neight", "tail\nnine"} <= texts
    # One of the two rows of id 4 keeps the line that both have.
    assert texts & {"head\nsame", "cape\nsame"} and len(texts & {"head", "cape"}) == 1
    found = lines.judge_lines(frame(spark, made)).collect()
    assert sorted((r.doc_id or 0, r.removed) for r in found) == [
        (0, ""), (0, "2"), (1, ""), (4, ""), (4, ""), (4, "1")]


@pytest.mark.parametrize("length, changes", [(19, 1), (20, 1), (22, 1), (27, 2), (29, 2), (40, 2), (58, 5), (75, 6), (200, 10)])
def test_bands_meet_similar_lines_of_all_lengths(length, changes):
    rng = np.random.default_rng(length)
    pairs = []
    while len(pairs) < 2000:
        one = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), length))
        two = one[: length - changes] + "".join(rng.choice(list("0123456789"), changes))
        if lines._alike(lines.shingle_set(one), lines.shingle_set(two), 0.8):
            pairs.append((one, two))
        else:
            pytest.fail("not similar")
    a, b = (lines.band_keys([p[k] for p in pairs]) for k in (0, 1))
    met = ((a == b) & (a != 0)).any(axis=1).mean()
    assert met >= 0.985


# -- op6 ------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_text(spark):
    rng = np.random.default_rng(5)
    plain, bad = [f"word{k}" for k in range(300)], ["vileness", "vilely", "scummy", "scumlike"]
    made, marks = [], []
    for i in range(600):
        toxic = i % 8 == 0
        words = list(rng.choice(plain, 40)) + (list(rng.choice(bad, 2)) if toxic else [])
        made.append((i, " ".join(words)))
        if i // 8 % 2 == 0:
            marks.append((i, int(toxic)))
    docs = frame(spark, [*made, (1000, None), (1001, ""), (None, "vilely")])
    labels = spark.createDataFrame([*marks, (None, 1), (2000, None)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels, held_out=queries.is_held_out)
    found = toxicity.score_texts(docs, model).collect()
    assert len(found) == 603 and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    right = sum((r.score >= 0.3) == (r.doc_id % 8 == 0) for r in held)
    assert right >= 0.95 * len(held)
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and {1000, 1001} <= {r.doc_id for r in kept.collect()}


def test_toxicity_without_positives(spark):
    docs = frame(spark, [(1, "a"), (2, None)])
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert len(rows(toxicity.score_texts(docs, model), "doc_id", "score")) == 2


# -- op7 ------------------------------------------------------------------------------------------


def test_best_fit_is_that_of_piece_by_piece():
    rng = np.random.default_rng(1)
    for capacity in (5, 16, 100):
        sizes = sorted(rng.integers(1, capacity + 1, 300).tolist(), reverse=True)
        left = []
        for size in sizes:
            fits = [r for r in left if r >= size]
            if fits:
                left[left.index(min(fits))] -= size
            else:
                left.append(capacity - size)
        lengths = {s: sizes.count(s) for s in set(sizes)}
        plan = packing.best_fit(lengths, capacity)
        used = {first + (k - a) // each for size, a, b, first, each, base in plan for k in range(a, b)}
        assert len(used) == len(left)
        assert sum(b - a for _, a, b, *_ in plan) == len(sizes)
    assert packing.best_fit({}, 8) == []


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_path())
    odd_texts = ["<|endoftext|> a", " lead", "a  b\n\n\nc \n d\t\te ", "it's 12 x's　é\U0001f600", "z" * 9000, "", None]
    docs = texts(spark)[:80] + [(10**6 + k, t) for k, t in enumerate(odd_texts)] + [(None, "x"), (None, "x")]
    for capacity in (2048, 64):
        pieces = packing.pack(frame(spark, docs), queries.tokenizer_path(), capacity=capacity).collect()
        by_doc, by_sequence = {}, {}
        for r in pieces:
            by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
            by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for i, text in docs:
            if i is None:
                continue
            ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
            first = len(ids) % capacity or capacity
            edges = [0, len(ids)] if len(ids) <= capacity else [0, *range(first, len(ids) + 1, capacity)]
            assert sorted(by_doc[i]) == [(k, a, b - a, zlib.crc32(ids[a:b].tobytes()))
                                         for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
        assert len(by_doc[None]) == 2
        for places in by_sequence.values():
            places.sort()
            assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
            assert sum(n for _, n in places) <= capacity
    assert packing.pack(frame(spark, docs).limit(0), queries.tokenizer_path()).count() == 0


# -- op8 ------------------------------------------------------------------------------------------


def hits_by_hand(docs, items, length):
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(
        c.lower() if c.isascii() else c for c in t or ""))
    out = []
    for i, text in docs:
        words, hit, names = words_of(text), set(), set()
        for name, item in items:
            item = words_of(item)
            n = min(length, len(item))
            for k in range(len(item) - n + 1 if n else 0):
                for at in range(len(words) - n + 1):
                    if words[at : at + n] == item[k : k + n]:
                        hit |= set(range(at, at + n))
                        names.add(str(name))
        out.append((i, len(words), len(hit), sorted(names), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("pass_bytes", [1 << 20, 40])
def test_decontamination_against_plain_search(spark, pass_bytes):
    rng = np.random.default_rng(9)
    vocabulary = ["a", "be", "Ça", "dé", "x1"]
    items = [(k, " ".join(rng.choice(vocabulary, n))) for k, n in enumerate([1, 2, 4, 5, 6, 9, 12])][2:]
    docs = [(k, " ".join(rng.choice(vocabulary, int(n)))) for k, n in enumerate(rng.integers(0, 700, 12))]
    docs += [(90, None), (91, ""), (92, "x, " + items[-1][1].replace(" ", "--") + "!"), (93, items[3][1]), (93, items[3][1])]
    table = spark.createDataFrame([*items, (50, None), (51, " - "), (2, items[0][1])], "item_id bigint, text string")
    found = decontaminate.scan(frame(spark, docs), table, length=5, pass_bytes=pass_bytes)
    assert rows(found, "doc_id", "n_words", "n_hit", "items", "contaminated") == sorted(
        ((a, b, c, list(d), e) for a, b, c, d, e in hits_by_hand(docs, items, 5)), key=str)
    kept = decontaminate.without_contaminated(frame(spark, docs), table, length=5, pass_bytes=pass_bytes)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in hits_by_hand(docs, items, 5) if not r[4])


def test_decontamination_without_items(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert {r.contaminated for r in decontaminate.scan(odd(spark), none).collect()} == {False}
    assert decontaminate.without_contaminated(odd(spark), none).count() == 9


# -- op9 ------------------------------------------------------------------------------------------


def test_licenses_found_wherever_they_stand(spark):
    filler = " ".join(f"f{k}" for k in range(150))
    made = [(k, f"{filler[: 37 * k]} {t.text.upper()} {filler}") for k, t in enumerate(licenses.TEMPLATES)]
    grant = licenses.plain_words(licenses.TEMPLATES[4].text)
    made += [(20, " ".join(grant[:-6])), (21, " ".join(grant[: len(grant) // 2])), (22, None), (23, ""), (24, "licensed")]
    found = {r.doc_id: r.licenses.split(",") for r in licenses.find_licenses(frame(spark, made)).collect()}
    for k, t in enumerate(licenses.TEMPLATES):
        assert t.name in found[k]
    assert found[20] == ["MIT-grant"] and found[21] == found[22] == found[23] == found[24] == [""]
    assert licenses.find_licenses(frame(spark, made), templates=()).count() == len(made)


def test_markers_are_in_every_text_that_can_match():
    for t in licenses.TEMPLATES:
        marks, shingles = licenses.marker_words(t), licenses.plain_shingles(t.text)
        without = [s for s in shingles if not marks & set(s.split())]
        assert len(without) < licenses.LEAST * len(shingles)


# -- op10 -----------------------------------------------------------------------------------------


def test_neighbours_are_exact(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 37)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(2)
    vectors = [(k, rng.normal(size=12).astype(np.float32).tolist()) for k in range(200)]
    vectors += [(200 + k, vectors[5][1]) for k in range(40)] + [(300, vectors[5][1]), (301, [2.0**66] * 12), (302, [2.0**-66] * 12)]
    bad = [(400, None), (420, [0.0] * 12), (440, [float("nan")] * 12), (460, [None] * 12), (480, [float("inf")] * 12),
           (500, []), (520, [1.0, 2.0]), (None, vectors[0][1]), (20, vectors[20][1])]
    table = spark.createDataFrame([(i, v, "x") for i, v in vectors + bad], "vec_id bigint, embedding array<float>, rank string")
    found = neighbours.nearest(table, lambda i: i % 20 == 0, k=20)
    want = []
    for q, u in vectors:
        if q % 20 == 0:
            scored = []
            for c, v in vectors:
                if c != q:
                    total = 0.0
                    for a, b in zip(u, v, strict=True):
                        total += a * b
                    scored.append((-total, c))
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(sorted(scored)[:20])]
    assert rows(found, "query_id", "rank", "vec_id", "score") == sorted(want, key=str)
    assert neighbours.nearest(table.limit(0), lambda i: i % 20 == 0).count() == 0


# -- pipeline -------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = load(spark)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == names, name
        before, left = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in after.collect()}
        assert set(left) <= set(before)
        if name == "line dedup":
            assert not lines_by_hand(list(left.items())) - {p for p in lines_by_hand(list(before.items()))}
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in load(spark, "benchmark").collect()]
            assert {i for i, _, n, _, _ in hits_by_hand(list(before.items()), items, 10) if n} == set(before) - set(left)
        if name == "near dedup":
            marks = {}
            for i, t in sorted(before.items()):
                marks.setdefault(mark_by_hand(t), []).append(i)
            assert set(before) - set(left) >= {i for same in marks.values() for i in same[1:]}
        docs = spark.createDataFrame(after.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def test_digest_columns(spark):
    found = queries.op8_decontamination(spark, SF).where("n_items = 0").first()
    assert found.items_sha256 == hashlib.sha256(b"").hexdigest()
