"""Source divergence, chat formatting and phrase collocations against brute force, and their results for odd input."""

import hashlib
import json
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundwork.llm import chats, collocations, common, divergence, queries

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, term string, p bigint, gid string"


def frame(spark, rows):
    """Documents with extra columns, some with names that operators use inside."""
    return spark.createDataFrame([(n, t, lang, source, "x", 1, "y") for n, (t, lang, source) in enumerate(rows)], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


ODD = [
    (None, None, None), ("", "en", "a"), (None, "en", "b"), (" 12 .; \n", "en", "a"), ("x" * 300_000, "en", "a"),
    ("Ab ab aB, é é. " * 40, "en", "a"), ("Ab ab aB, é é. " * 40, "en", "a"), ("ab é ab é zz " * 300, "en", "b"),
    ("ab zz zz! " * 30, None, "b"), ("ab zz zz! " * 30, None, None), ("zz ab " * 20, "", "b"), ("only here", "fr", "c"),
]

# -- op11 -----------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audit_by_hand(rows, min_df, top):
    held, sums = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        counts = Counter(TERM.findall((text or "").translate(LOWER)))
        held[lang or ""].update(counts.keys())
        sums[lang or "", source or ""].update(counts)
    out = []
    for lang, df in held.items():
        terms = [t for t, n in df.items() if n >= min_df]
        sources = [s for one, s in sums if one == lang]
        total = {s: sum(sums[lang, s][t] for t in terms) for s in sources}
        whole = {t: sum(sums[lang, s][t] for s in sources) for t in terms}

        def share(count, size, kept=len(terms)):
            return 1 + 10**9 * (count + 1) // (size + kept)

        def apart(p, q):
            return (p - q) ** 2 // q

        for s in sources:
            mine = {t: share(sums[lang, s][t], total[s]) for t in terms}
            pairs = [(-sum(apart(mine[t], share(sums[lang, o][t], total[o])) for t in terms), o.encode()) for o in sources if o != s]
            words = [(t, share(whole[t], sum(total.values()))) for t in terms if sums[lang, s][t]]
            words = [(-apart(mine[t], q), t.encode()) for t, q in words if mine[t] > q]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(words)[:top])):
                out += [(lang, s, part, item.decode(), -value, n + 1) for n, (value, item) in enumerate(found)]
    return sorted(out)


def audited(docs, **more):
    found = divergence.audit(docs, **more)
    return sorted(map(tuple, found.select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.mark.parametrize("sources, terms", [(256, 2048), (3, 50)])
def test_audit_equals_brute_force(spark, monkeypatch, sources, terms):
    # Small cells make pairs of sources meet in cells of their own.
    monkeypatch.setattr(divergence, "SOURCES", sources)
    monkeypatch.setattr(divergence, "TERMS", terms)
    rows = [(r.text, r.lang, r.source) for r in documents(spark).collect()]
    assert audited(documents(spark)) == audit_by_hand(rows, 3, 200)


def test_audit_of_odd_rows(spark):
    for min_df in (1, 2, 5):
        assert audited(frame(spark, ODD), min_df=min_df, top=2) == audit_by_hand(ODD, min_df, 2)
    assert audited(frame(spark, [])) == []


def test_long_texts_are_counted_piece_by_piece():
    text = ("Word " * 50 + "x" * 500 + ".y " * 100).encode()
    assert divergence.term_counts(text) == Counter({b"word": 50, b"x" * 500: 1, b"y": 100})
    assert b"".join(divergence.pieces(text, 64)) == text
    assert all(p[:1] in (b" ", b"W") for p in divergence.pieces(text, 64))


def test_tasks_hand_on_their_sums_when_they_grow(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    batch = pytest.importorskip("pyarrow").record_batch(
        {"lang": ["en"] * 3, "source": ["a", "a", "b"], "text": ["a b c d", "a", "a"]})
    parts = list(divergence._group_sums(iter([batch])))
    rows = [r for part in parts for r in part.to_pylist()]
    assert len(parts) > 1 and sum(r["n"] for r in rows) == 6
    assert sum(r["n"] for r in rows if r["term"] == "a") == 3


# -- op12 -----------------------------------------------------------------------------------------

pieces = st.sampled_from(["<", "[", "\\", "/", "s>", "INST]", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
                          "SYS>>", "|", "<|im_end|>", "<|im_start|>", "im_end", "|>", "\n", " ", "é", "𝄞", "a"])
texts = st.lists(pieces, max_size=8).map("".join)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\\n\nb", "<|im_end|>\n", ""]), texts), min_size=1, max_size=30))
def test_turns_are_read_back_whatever_they_hold(spark, turns):
    rows = spark.createDataFrame([(1, n, r, t) for n, (r, t) in enumerate(turns)], "conv_id int, turn int, role string, text string")
    done = chats.format_turns(chats.canonical_turns(rows, "conv_id"))
    (one,) = done.select("formatted", "loss", chats.read_turns(F.col("formatted")).alias("turns"),
                         chats.read_loss(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    assert [tuple(t) for t in one.turns] == turns
    assert one.learned == "".join(t for r, t in turns if r == "assistant")
    spans = [one.formatted[s.start : s.start + s.length] for s in one.loss]
    raw = one.formatted.encode()
    assert spans == [raw[s.first_byte : s.first_byte + s.bytes].decode() for s in one.loss]
    # No mark but those of the template.
    assert one.formatted.count(chats.START) == one.formatted.count(chats.END) == len(turns)
    assert not any(re.search(r"[<\[]" + chats.MARK, s) for s in spans)


def test_turns_are_ordered_and_rows_without_values_count(spark):
    rows = [(1, 2, "assistant", "c"), (1, 1, "user", "b"), (1, 1, "user", "b"), (1, 1, "user", "a"), (1, None, None, None),
            (None, 1, "assistant", "x"), (None, 0, "user", ""), (2, 5, "tool", "y" * 200_000)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id int, turn int, role string, text string, id string, print int")
    done = chats.format_turns(chats.canonical_turns(table, "conv_id"))
    found = {r.id: ([tuple(t) for t in r.turns], r.n_turns) for r in done.select(
        "id", "n_turns", chats.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert found == {1: ([("", ""), ("user", "a"), ("user", "b"), ("user", "b"), ("assistant", "c")], 5),
                     None: ([("user", ""), ("assistant", "x")], 2), 2: ([("tool", "y" * 200_000)], 1)}
    empty = chats.format_turns(chats.canonical_turns(table.where("false"), "conv_id"))
    assert empty.count() == 0 and empty.columns == ["id", "print", "copy", "layout", "n_turns", "formatted", "loss"]


RECORDS = [
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q", "name": "n"}], "id": 7},
     "messages", [("system", "s"), ("user", "q")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}], "system": "s"},
     "from and value", [("system", "s"), ("user", "q"), ("assistant", "")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "input": "", "output": "done", "meta": {"a": [1]}}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"prompt": "p", "completion": "c", "system": ""}, "completion", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "c"}, "response", [("user", "p"), ("assistant", "c")]),
    ({"question": "q", "context": "c", "answer": "a"}, "question", [("user", "c\n\nq"), ("assistant", "a")]),
    ({"question": "q"}, None, []), ({"messages": "text"}, None, []), ({"a.b": 1, "it's": []}, None, []), ([1, 2], None, []),
]


def test_json_records_are_mapped_by_their_fingerprint(spark):
    rows = [(n, json.dumps(record)) for n, (record, _, _) in enumerate(RECORDS)]
    rows += [(100, None), (101, "{broken"), (102, ""), (0, rows[0][1]), (0, rows[1][1])]
    done = chats.format_turns(chats.canonical_turns(spark.createDataFrame(rows, "id int, record string"), "id", "record"))
    found = defaultdict(list)
    for r in done.select("id", "layout", chats.read_turns(F.col("formatted")).alias("turns")).collect():
        found[r.id].append((r.layout, [tuple(t) for t in r.turns]))
    for n, (_, layout, turns) in enumerate(RECORDS[1:], 1):
        assert found[n] == [(layout, turns)], n
    # Repeated ids, with the same record and with another one, stay records of their own.
    assert sorted(found[0], key=str) == sorted([RECORDS[0][1:], RECORDS[0][1:], RECORDS[1][1:]], key=str)
    assert found[100] == found[101] == found[102] == [(None, [])]


def test_typed_tables_are_mapped_by_their_schema(spark):
    typed = spark.createDataFrame(
        [(1, [("user", "q"), ("assistant", "a")], 5), (2, [], 6), (3, None, 7)],
        "id int, messages array<struct<role: string, content: string>>, copy int")
    done = chats.format_turns(chats.canonical_turns(typed, "id")).collect()
    assert {r.id: (r.layout, r.n_turns) for r in done} == {1: ("messages", 2), 2: ("messages", 0), 3: ("messages", 0)}
    prompts = spark.createDataFrame([(1, "p", "c"), (1, "p", "c"), (1, None, None)], "id int, prompt string, completion string")
    done = chats.format_turns(chats.canonical_turns(prompts, "id"))
    assert sorted(r.formatted.count("p<|im_end|>") for r in done.collect()) == [0, 1, 1]
    with pytest.raises(ValueError):
        chats.canonical_turns(spark.createDataFrame([(1, "x")], "id int, prompt string"), "id")


def test_fingerprints_tell_layouts_apart():
    prints = [p for one in (*chats.LAYOUTS, chats.TURN_ROWS) for p in chats.layout_prints(one)]
    assert len(prints) == len(set(prints))
    assert chats.fingerprint(["prompt", "x", "response"]) == chats.fingerprint(["response", "prompt"])


def test_query_adds_a_conversation_of_marks(spark):
    rows = {r.conv_id: r for r in queries.op12_chat_format(spark, SF).collect()}
    said = "</s>[INST] ok [/INST]"
    assert rows[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and rows[-7].loss_chars == len(said)
    assert rows[-7].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert rows[-7].formatted_chars > 2 * len(said) + 4


def test_formatting_runs_no_python(spark):
    plan = queries.op12_chat_format(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


# -- op13 -----------------------------------------------------------------------------------------


def phrases_by_hand(rows, longest, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals["und" if lang is None else lang] += len(words)
            for size in range(1, longest + 1):
                counts["und" if lang is None else lang].update(
                    tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, found in counts.items():
        frequent = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        ranked = []
        for phrase, a in frequent.items():
            held = [b for other, b in frequent.items() if len(other) > len(phrase) and any(
                other[k : k + len(phrase)] == phrase for k in range(len(other)))]
            if any(100 * b >= 100 * a for b in held):
                continue
            score, k = min((1000 * a * totals[lang] // (found[phrase[:k]] * found[phrase[k:]]), k) for k in range(1, len(phrase)))
            ranked.append((-score, -a, " ".join(phrase).encode(), found[phrase[:k]], found[phrase[k:]]))
        out += [(lang, n + 1, p.decode(), -a, left, right, totals[lang], -score)
                for n, (score, a, p, left, right) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


def mined(docs, **more):
    found = collocations.collocations(docs, **more)
    return sorted(map(tuple, found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("least, trigger, longest_chunk", [(5, 16, 64), (8, 2, 3)])
def test_collocations_equal_brute_force(spark, monkeypatch, least, trigger, longest_chunk):
    monkeypatch.setattr(collocations, "TRIGGER", trigger)
    monkeypatch.setattr(collocations, "LONGEST", longest_chunk)
    rows = [(r.text, r.lang, r.source) for r in documents(spark).collect()]
    assert mined(documents(spark), least=least, top=50) == phrases_by_hand(rows, 5, least, 50)


def test_collocations_of_odd_rows(spark):
    for least in (2, 40):
        assert mined(frame(spark, ODD), least=least, top=30) == phrases_by_hand(ODD, 5, least, 30)
    assert mined(frame(spark, [])) == []


def test_a_filter_that_is_too_small_changes_nothing(spark, monkeypatch):
    whole = mined(frame(spark, ODD), least=2)
    monkeypatch.setattr(collocations, "FILTER", 1)
    monkeypatch.setattr(collocations, "HELD", 4)
    monkeypatch.setattr(collocations, "HASHES", 8)
    assert mined(frame(spark, ODD), least=2) == whole


words = st.lists(st.sampled_from(["a", "bb", "ccc", "of", "é"]), max_size=30).map(" ".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(words, max_size=6).map(". ".join), st.integers(4, 40), st.integers(0, 5))
def test_every_word_is_the_own_word_of_one_chunk(text, size, overlap):
    chunks = [(chunk.split(), own) for chunk, own in collocations.parse(text.encode(), overlap, size)]
    assert [w for words, own in chunks for w in words[:own]] == text.encode().translate(collocations.FOLD).split()
    runs = Counter(b" ".join(words[k : k + overlap + 1]) for words, own in chunks for k in range(own)
                   if len(words) - k > overlap)
    plain = [piece.split() for piece in text.encode().split(b".")]
    assert runs == Counter(b" ".join(p[k : k + overlap + 1]) for p in plain for k in range(len(p) - overlap))


# -- helpers --------------------------------------------------------------------------------------


def test_long_texts_hash_like_short_ones(monkeypatch):
    monkeypatch.setattr(common, "_POWERS", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    text = b"ab cde  " * 40 + b"x" * 300 + b" tail"
    raw = np.frombuffer(text, np.uint8)
    spans = common.word_spans(raw, common.SPACE)
    whole = common.word_hashes(raw, *spans)
    monkeypatch.setattr(common, "_POWERS", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    monkeypatch.setattr(common, "ROUND_BYTES", 64)
    assert (common.word_hashes(raw, *spans) == whole).all() and len(common._POWERS[0]) <= 64
