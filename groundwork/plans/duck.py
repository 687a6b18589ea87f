"""DuckDB spellings of the text and vector expressions, for the oracles."""

from __future__ import annotations

from groundwork.plans.views import STOP_WORDS, UBIQUITOUS

DIMENSIONS = 64


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def blank(x: str) -> str:
    return rf"({x} IS NULL OR NOT regexp_matches({x}, '[^\s]'))"


def fold(x: str) -> str:
    return rf"regexp_replace(strip_accents(lower({x})), '\p{{M}}+', '', 'g')"


def normalize(x: str) -> str:
    return rf"regexp_replace({fold(x)}, '[^a-z0-9\s]', ' ', 'g')"


def words(x: str) -> str:
    return f"regexp_split_to_array({normalize(x)}, '[^a-z0-9]+')"


def stem(w: str) -> str:
    return f"CASE WHEN length({w}) >= 7 THEN left({w}, 6) WHEN length({w}) >= 5 THEN left({w}, length({w}) - 1) ELSE {w} END"


def searchable(w: str) -> str:
    return f"({w} <> '' AND {w} NOT IN ({quoted(STOP_WORDS)}))"


def analyze(x: str) -> str:
    return (
        f"list_transform(list_filter({words(x)}, lambda w: {searchable('w')}), "
        f"lambda w: {stem('w')})"
    )


def first_distinct(array: str) -> str:
    """Distinct items in first-seen order."""
    return f"list_filter({array}, lambda w, i: list_position({array}, w) = i)"


def query_terms(x: str, limit: int = 16) -> str:
    raw = rf"regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+')"
    kept = (
        f"list_filter({raw}, lambda w: length(w) >= 2 AND "
        f"{trim(normalize('w'))} NOT IN ({quoted(STOP_WORDS)}))"
    )
    return f"({first_distinct(kept)})[1:{limit}]"


def usable(v: str, dimensions: int = DIMENSIONS) -> str:
    return (
        f"({v} IS NOT NULL AND len({v}) = {dimensions} "
        f"AND len(list_filter({v}, lambda x: isnan(x) OR isinf(x))) = 0 "
        f"AND len(list_filter({v}, lambda x: x <> 0)) > 0)"
    )


def missing(v: str) -> str:
    return f"({v} IS NULL OR len(list_filter({v}, lambda x: x <> 0)) = 0)"


def cosine(a: str, b: str) -> str:
    """Without the last digits, in which equal vectors may differ."""
    return f"round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 12)"


def hashed_words(x: str, dimensions: int = DIMENSIONS) -> str:
    """Counts per hashed slot, scaled to length one."""
    counted = f"list_filter(regexp_split_to_array({fold(x)}, '[^a-z0-9]+'), lambda w: length(w) >= 3)"
    slots = f"list_transform({counted}, lambda w: ('0x' || left(md5(w), 8))::BIGINT % {dimensions})"
    return slots


def unit_vectors(table: str, key: str = "chunk_id", dimensions: int = DIMENSIONS) -> str:
    """``key, embedding`` of a table ``key, slots``."""
    counts = f"list_transform(range({dimensions}), lambda d: len(list_filter(slots, lambda s: s = d))::DOUBLE)"
    first = f"list_transform(range({dimensions}), lambda d: (d = 0)::INT::FLOAT)"
    return f"""
    SELECT {key}, CASE WHEN norm = 0 THEN {first} ELSE list_transform(counts, lambda c: (c / norm)::FLOAT) END AS embedding
    FROM (SELECT {key}, counts, sqrt(list_dot_product(counts, counts)) AS norm
          FROM (SELECT {key}, {counts} AS counts FROM {table}) c) n"""


UBIQUITOUS_LIST = quoted(UBIQUITOUS)
