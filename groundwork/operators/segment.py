"""Segmenters: one document row in, many chunk rows out, in one narrow pass.

A document row is ``document_id, text[, pages array<struct<page_no int, text string>>]``.
A segmenter is a function ``(text, pages) -> array of pieces``; a table of documents is cut by one
``posexplode`` over it, so that nothing is shuffled and a stream can be segmented as well.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions import lexicon as lex
from groundwork.functions.text import bind, chunk_hash, is_blank, trim

STRUCTURED_QA = "STRUCTURED_QA"
LEGAL_SECTION = "LEGAL_SECTION"
RECURSIVE = "RECURSIVE"

Segmenter = Callable[[Column, Column | None], Column]

# A Unicode noncharacter: cannot occur in a text, so it can mark where to cut.
_CUT = "\uFDD0"


def first_page_with(content: Column, pages: Column, sample: int = 50) -> Column:
    """First page that contains the start of a chunk, 1 when there is none."""
    probe = F.substring(content, 1, sample)
    hits = F.filter(pages, lambda p: F.contains(p["text"], probe))
    return F.coalesce(F.try_element_at(hits, F.lit(1))["page_no"].cast("int"), F.lit(1))


def _piece(content: Column, pages: Column | None, strategy: str, title: Column | None = None,
           question: Column | None = None, article: Column | None = None,
           start: Column | None = None, end: Column | None = None) -> Column:
    def or_null(value: Column | None, kind: str) -> Column:
        return (F.lit(None) if value is None else value).cast(kind)

    page = F.lit(1) if pages is None else first_page_with(content, pages)
    return F.struct(
        or_null(title, "string").alias("title"),
        content.alias("content"),
        page.cast("int").alias("page"),
        F.lit(strategy).alias("strategy"),
        or_null(question, "int").alias("question_number"),
        or_null(article, "string").alias("article_number"),
        or_null(start, "int").alias("char_start"),
        or_null(end, "int").alias("char_end"),
    )


def _window_bounds(text: Column, size: int, overlap: int) -> Column:
    """Start and end of each window over a trimmed text."""
    half = size // 2
    length = F.length(text)
    # Each step moves on by at least this much, which bounds the number of steps.
    steps = F.sequence(F.lit(0), F.ceil(length / (half + 1 - overlap)).cast("int"))
    none = F.array().cast("array<struct<s:int,e:int>>")

    def end_of(at: Column) -> Column:
        back_half = F.substring(text, at + (half + 1), F.lit(size - half))
        from_end = F.regexp_instr(F.reverse(back_half), F.lit(r"[\n.;!]"))
        shift = F.when(from_end > 0, from_end - 1).otherwise(0)
        return F.when(at + size >= length, length).otherwise(at + size - shift)

    def state(at: Column, done: Column, cuts: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), done.alias("done"), cuts.alias("cuts"))

    def advance(acc: Column, _: Column) -> Column:
        moved = bind(
            end_of(acc["at"]),
            lambda e: state(
                F.when(e - overlap <= acc["at"], e).otherwise(e - overlap),
                e >= length,
                F.concat(
                    acc["cuts"],
                    F.array(F.struct(acc["at"].alias("s"), e.cast("int").alias("e"))),
                ),
            ),
        )
        return F.when(acc["done"], acc).otherwise(moved)

    return F.aggregate(steps, state(F.lit(0), length == 0, none), advance, lambda acc: acc["cuts"])


def recursive(text: Column, pages: Column | None, size: int = 1000, overlap: int = 150) -> Column:
    """Overlapping windows that end at the last line or sentence end in their second half."""

    def cut(t: Column) -> Column:
        windows = F.transform(
            _window_bounds(t, size, overlap),
            lambda b: F.struct(
                b["s"].alias("s"),
                b["e"].alias("e"),
                trim(F.substring(t, b["s"] + 1, b["e"] - b["s"])).alias("content"),
            ),
        )
        return F.transform(
            F.filter(windows, lambda w: w["content"] != ""),
            lambda w, i: _piece(
                w["content"], pages, RECURSIVE,
                title=F.concat(F.lit("Seção "), (i + 1).cast("string")),
                start=w["s"], end=w["e"],
            ),
        )

    return bind(trim(text), cut)


def _at_headings(text: Column, heading: str, piece: Callable[[Column], Column]) -> Column:
    """Pieces from heading to heading; what stands before the first heading is dropped."""
    cut = F.split(F.regexp_replace(text, heading, _CUT + "$0"), _CUT)
    return bind(cut, lambda parts: F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), piece))


def structured_qa(text: Column, pages: Column | None) -> Column:
    """One piece per numbered question; a text without any is cut into windows."""

    def piece(raw: Column) -> Column:
        number = F.regexp_extract(raw, lex.QUESTION_HEADING, 1)
        topic = trim(F.regexp_extract(raw, lex.QUESTION_HEADING, 2))
        return _piece(
            trim(raw), pages, STRUCTURED_QA,
            title=F.concat(F.lit("Pergunta "), number, F.lit(" — "), topic),
            question=number,
        )

    return F.when(
        text.rlike(lex.QUESTION_HEADING), _at_headings(text, lex.QUESTION_HEADING, piece)
    ).otherwise(recursive(text, pages))


def legal_sections(text: Column, pages: Column | None) -> Column:
    """One piece per article; a text without any is cut into windows."""

    def piece(raw: Column) -> Column:
        article = F.regexp_extract(raw, lex.ARTICLE_HEADING, 1)
        title = F.concat(F.lit("Artigo "), article)
        return _piece(trim(raw), pages, LEGAL_SECTION, title=title, article=article)

    return F.when(
        text.rlike(lex.ARTICLE_HEADING), _at_headings(text, lex.ARTICLE_HEADING, piece)
    ).otherwise(recursive(text, pages))


SEGMENTERS: dict[str, Segmenter] = {
    STRUCTURED_QA: structured_qa,
    LEGAL_SECTION: legal_sections,
    RECURSIVE: recursive,
}


def segment(docs: DataFrame, segmenter: Segmenter | Column) -> DataFrame:
    """Chunk rows of a table of documents."""
    pages = F.col("pages") if "pages" in docs.columns else None
    pieces = segmenter if isinstance(segmenter, Column) else segmenter(F.col("text"), pages)
    cut = docs.where(~is_blank(F.col("text"))).select(
        "document_id", F.posexplode(pieces).alias("_pos", "_p")
    )
    return cut.select(
        "document_id",
        (F.col("_pos") + 1).alias("sequence_number"),
        "_p.*",
        chunk_hash(F.col("_p.content")).alias("chunk_hash"),
    )


def segment_by_strategy(
    docs: DataFrame, segmenters: Mapping[str, Segmenter] = SEGMENTERS, default: str = RECURSIVE
) -> DataFrame:
    """Each document by the segmenter its ``strategy`` names; unknown or none means the default.

    One pass: a row evaluates only the branch it needs.
    """
    pages = F.col("pages") if "pages" in docs.columns else None
    chosen = None
    for name, segmenter in segmenters.items():
        if name != default:
            pieces = segmenter(F.col("text"), pages)
            is_it = F.col("strategy") == name
            chosen = F.when(is_it, pieces) if chosen is None else chosen.when(is_it, pieces)
    fallback = segmenters[default](F.col("text"), pages)
    return segment(docs, fallback if chosen is None else chosen.otherwise(fallback))


def registered_strategy(strategy: Column) -> Column:
    """What a document registered without a strategy is stored with."""
    return F.coalesce(strategy, F.lit(STRUCTURED_QA))


def chunk_metadata() -> Column:
    """Metadata JSON of a chunk row; fields it does not have are left out."""
    return F.to_json(
        F.struct(
            F.col("question_number").alias("questionNumber"),
            F.col("article_number").alias("articleNumber"),
            "page",
            "strategy",
            F.col("char_start").alias("charStart"),
            F.col("char_end").alias("charEnd"),
        )
    )
