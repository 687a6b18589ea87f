"""Text expressions. All of them are built-in Spark functions, so they stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundwork.functions import lexicon as lex


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def once(**columns: Column) -> Column:
    """Columns computed exactly once per row, to be selected before rows multiply.

    Generated code puts off a projected expression until it is used, which after an exploding
    join or generator means once per output row. A generator of one row settles it.
    """
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def trim(text: Column) -> Column:
    """Cut everything up to U+0020 from both ends; Spark's own trim only knows the space."""
    return F.btrim(text, F.lit(lex.TRIMMED))


def is_blank(text: Column) -> Column:
    """Null, empty, or only white space (no-break spaces count as text)."""
    visible = r"[^\s\x1C-\x1F\u1680\u2000-\u2006\u2008-\u200A\u2028\u2029\u205F\u3000]"
    return text.isNull() | ~text.rlike(visible)


def clean_page(text: Column) -> Column:
    return F.coalesce(trim(F.regexp_replace(text, r"\r\n?", "\n")), F.lit(""))


def _display_text(text: Column) -> Column:
    shown = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\p{Cc}\p{Cf}]", " ")
    return trim(F.regexp_replace(shown, r"\s+", " "))


def _shorten(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, trim(F.substring(text, 1, limit))).otherwise(text)


def file_name(raw: Column, limit: int = 200) -> Column:
    """Last path segment, made safe to show."""
    name = _display_text(F.regexp_replace(raw, r"(?s)^.*[/\\]", ""))
    return F.when(name.isin("", ".", ".."), lex.DEFAULT_FILE_NAME).otherwise(_shorten(name, limit))


def document_title(title: Column, fallback: Column, limit: int = 255) -> Column:
    first, second = _display_text(title), _display_text(fallback)
    return (
        F.when(first != "", _shorten(first, limit))
        .when(second != "", _shorten(second, limit))
        .otherwise(lex.DEFAULT_FILE_NAME)
    )


def truncate_title(title: Column, limit: int = 500) -> Column:
    kept = F.regexp_replace(F.substring(title, 1, limit - 1), r"\s+$", "")
    return F.when(F.length(title) > limit, F.concat(kept, F.lit("…"))).otherwise(title)


def chunk_hash(content: Column) -> Column:
    return F.coalesce(F.sha2(content, 256), F.lit(""))


def fold_accents(text: Column) -> Column:
    return F.translate(F.lower(text), lex.ACCENTED + lex.MARKS, lex.UNACCENTED)


def normalize(text: Column) -> Column:
    """Lower case without accents, every other character a space. Neither trimmed nor collapsed."""
    return F.regexp_replace(fold_accents(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]", " ")


def words(text: Column) -> Column:
    """The normalized words in order. May hold empty strings at the ends."""
    return F.split(fold_accents(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+")


def quoted(words: Sequence[str]) -> str:
    return ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)


def word_list(words: Sequence[str]) -> Column:
    return F.expr(f"cast(array({quoted(words)}) as array<string>)")


def query_terms(query: Column, stop_words: Sequence[str], limit: int = 16) -> Column:
    """The words worth searching for, accents kept, in first-seen order."""
    stop = word_list(stop_words)
    raw = F.split(F.lower(query), r"[^\p{L}\p{N}]+")
    kept = F.filter(
        raw,
        lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, trim(normalize(w))),
    )
    return F.slice(F.array_distinct(kept), 1, limit)


def stem(word: Column) -> Column:
    """Light stem: six letters of a long word, one letter less of a middle one."""
    size = F.length(word)
    shorter = F.least(size - 1, F.lit(6))
    return F.when(size >= 5, F.substring(word, F.lit(1), shorter)).otherwise(word)


def analyze(text: Column, stop_words: Sequence[str]) -> Column:
    """Stemmed search tokens of a text: what a stored full-text column holds."""
    stop = word_list(stop_words)
    kept = F.filter(words(text), lambda w: (w != "") & ~F.array_contains(stop, w))
    return F.transform(kept, stem)


def embedding_text(title: Column, content: Column) -> Column:
    body = trim(F.coalesce(content, F.lit("")))
    return F.when(is_blank(title), body).otherwise(F.concat(trim(title), F.lit("\n"), body))


def estimate_tokens(text: Column) -> Column:
    length = F.coalesce(F.length(text), F.lit(0)).cast("long")
    return F.greatest(F.lit(1).cast("long"), F.ceil(length / 4))


def retry_delay_ms(message: Column) -> Column:
    seconds = F.regexp_extract(message, lex.RETRY_DELAY, 1)
    millis = F.ceil(seconds.cast("double") * 1000)
    return F.when(seconds != "", F.least(millis, F.lit(3_600_000)).cast("long"))


def escape_prompt_tags(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), lex.PROMPT_TAG, "&lt;$1")


def split_words(text: Column) -> Column:
    """Pieces that end after each white-space character; joined they give the text back."""
    pieces = F.split(text, r"(?<=\s)")
    return F.filter(pieces, lambda p: p != "")
