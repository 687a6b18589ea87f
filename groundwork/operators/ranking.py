"""Many questions against rows that stream through a task: who may see a row, and the best rows so far."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Values of (row, question) pairs that a task holds at a time.
PAIRS = 4_000_000


def visibility_class() -> Column:
    """What decides who sees a row, as one text: few rows differ in it, so tasks look at each text once."""
    return F.to_json(F.struct(
        F.col("default_visible").alias("d"), F.col("subjects").cast("array<string>").alias("s")))


class Askers:
    """Questions and their scopes: a list of subjects, or None for what is visible by default."""

    def __init__(self, ids: np.ndarray, scopes: Sequence[Sequence | None]):
        self.ids = ids
        self.default = np.array([s is None for s in scopes], bool)
        self.subjects = {s: n for n, s in enumerate(sorted({str(s) for one in scopes for s in one or []}))}
        self.allowed = np.zeros((len(self.subjects), len(scopes)), bool)
        for n, scope in enumerate(scopes):
            self.allowed[[self.subjects[str(s)] for s in scope or []], n] = True

    def __len__(self) -> int:
        return len(self.ids)

    def sees(self, one: str) -> np.ndarray:
        """Which questions see rows of a visibility class."""
        held = json.loads(one)
        known = [self.subjects[s] for s in held.get("s", []) if s in self.subjects]
        in_scope = self.allowed[known].any(axis=0) if known else np.zeros(len(self), bool)
        return np.where(self.default, bool(held.get("d")), in_scope)

    def masks(self, classes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(code of each row, a row of truth values per code)."""
        coded = classes.dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        seen = [self.sees(one) for one in coded.dictionary.to_pylist()]
        return coded.indices.to_numpy(zero_copy_only=False), np.array(seen, bool).reshape(len(seen), len(self))


class Best:
    """The best ``k`` rows of each question so far; ties go to the smaller id."""

    def __init__(self, questions: int, k: int):
        self.k = k
        self.ids: np.ndarray | None = None
        self.scores = np.zeros((questions, 0))

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` has a row per question and a column per id; minus infinity is no candidate."""
        by_id = np.argsort(ids, kind="stable")
        ids, scores = ids[by_id], scores[:, by_id]
        columns = np.broadcast_to(ids, scores.shape)
        if scores.shape[1] > self.k:
            keep = self._first_k(scores)
            columns = np.take_along_axis(columns, keep, axis=1)
            scores = np.take_along_axis(scores, keep, axis=1)
        if self.ids is not None:
            columns = np.concatenate([self.ids, columns], axis=1)
            scores = np.concatenate([self.scores, scores], axis=1)
            codes = np.unique(columns, return_inverse=True)[1].reshape(columns.shape)
            order = np.lexsort((codes, -scores), axis=1)[:, : self.k]
            columns = np.take_along_axis(columns, order, axis=1)
            scores = np.take_along_axis(scores, order, axis=1)
        self.ids, self.scores = columns, scores

    def _first_k(self, scores: np.ndarray) -> np.ndarray:
        """Columns of the ``k`` best; among equals the first ones."""
        edge = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1 : self.k]
        above, level = scores > edge, scores == edge
        room = self.k - above.sum(axis=1, keepdims=True)
        chosen = above | (level & (np.cumsum(level, axis=1) <= room))
        return np.nonzero(chosen)[1].reshape(len(scores), self.k)

    def edge(self) -> np.ndarray:
        """The ``k`` th best score of each question; minus infinity while there are fewer."""
        if self.scores.shape[1] < self.k:
            return np.full(len(self.scores), -np.inf)
        return self.scores.min(axis=1)

    def rows(self, question_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, id, score) of what is held."""
        if self.ids is None:
            return question_ids[:0], np.zeros(0), np.zeros(0)
        question = np.broadcast_to(question_ids[:, None], self.ids.shape)
        kept = np.isfinite(self.scores)
        return question[kept], self.ids[kept], self.scores[kept]


class Top:
    """The best ``k`` rows of each question so far, from pairs that are already few; ties go to the smaller id."""

    def __init__(self, questions: int, k: int):
        self.k = k
        self.scores = np.full((questions, k), -np.inf)
        self.ids: np.ndarray | None = None

    def edge(self) -> np.ndarray:
        """The ``k`` th best score of each question; minus infinity while there are fewer."""
        return self.scores[:, -1]

    def add(self, asked: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """A score per pair of a question's number and an id."""
        if not len(asked):
            return
        if self.ids is None:
            self.ids = np.full(self.scores.shape, ids[0], ids.dtype)
        touched = np.unique(asked)
        row, column = np.nonzero(np.isfinite(self.scores[touched]))
        held = touched[row]
        asked = np.concatenate([held, asked])
        ids = np.concatenate([self.ids[held, column], ids])
        scores = np.concatenate([self.scores[held, column], scores])
        by_id = np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids
        order = np.lexsort((by_id, -scores, asked))
        asked, ids, scores = asked[order], ids[order], scores[order]
        starts = np.flatnonzero(np.concatenate([[True], asked[1:] != asked[:-1]]))
        place = np.arange(len(asked)) - np.repeat(starts, np.diff(np.append(starts, len(asked))))
        first = place < self.k
        self.scores[touched] = -np.inf
        self.scores[asked[first], place[first]] = scores[first]
        self.ids[asked[first], place[first]] = ids[first]

    def rows(self, question_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, id, score) of what is held."""
        if self.ids is None:
            return question_ids[:0], np.zeros(0), np.zeros(0)
        asked, column = np.nonzero(np.isfinite(self.scores))
        return question_ids[asked], self.ids[asked, column], self.scores[asked, column]


class Edges:
    """The ``k`` best scores of each question so far, without whose they are."""

    def __init__(self, questions: int, k: int):
        self.k, self.scores = k, np.full((questions, k), -np.inf)

    def edge(self) -> np.ndarray:
        """The ``k`` th best score of each question; minus infinity while there are fewer."""
        return self.scores[:, 0]

    def add(self, asked: np.ndarray, scores: np.ndarray) -> None:
        """A score per pair; the numbers of the questions ascend."""
        if not len(asked):
            return
        starts = np.flatnonzero(np.concatenate([[True], asked[1:] != asked[:-1]]))
        counts = np.diff(np.append(starts, len(asked)))
        if counts.max() > 4 * self.k:
            # A long row would make all rows long.
            scores = scores[np.lexsort((-scores, asked))]
            first = np.arange(len(asked)) - np.repeat(starts, counts) < self.k
            asked, scores, counts = asked[first], scores[first], np.minimum(counts, self.k)
            starts = np.cumsum(counts) - counts
        touched, most = asked[starts], int(counts.max())
        row = np.repeat(np.arange(len(touched)), counts)
        held = np.full((len(touched), self.k + most), -np.inf)
        held[:, : self.k] = self.scores[touched]
        held[row, self.k + np.arange(len(asked)) - starts[row]] = scores
        # The smallest of the k largest comes first of them.
        self.scores[touched] = np.partition(held, most, axis=1)[:, most:]


def hopeful(scores: np.ndarray, allowed: np.ndarray | None, edge: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(question, column) of allowed scores that may be among the best ``k``: not more than ``slack`` under the edge of
    what is held, or, where that rules out little, under the ``k`` th best of ``scores`` themselves.

    No pair among the best is left out if no score is off by more than half of ``slack``.
    """
    may = scores >= (edge - slack).astype(scores.dtype)[:, None]
    if allowed is not None:
        may &= allowed
    if scores.shape[1] > k and np.count_nonzero(may) > 4 * k * len(scores):
        low = np.where(may, scores, np.float32(-np.inf))
        may &= scores >= (np.partition(low, -k, axis=1)[:, -k] - np.float32(slack))[:, None]
    return np.nonzero(may)


class Wanted:
    """What questions look for, by pattern: rows of (pattern, question, values) with the patterns numbered."""

    def __init__(self, patterns: Sequence[str], questions: np.ndarray, **values: np.ndarray):
        names, code = np.unique(np.asarray(patterns, dtype=object), return_inverse=True)
        order = np.argsort(code, kind="stable")
        self.names = names.tolist()
        self.starts = np.searchsorted(code[order], np.arange(len(names) + 1))
        self.questions = questions[order]
        self.values = {name: value[order] for name, value in values.items()}

    def rows_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all of ``codes``, and for each row the place of its code in ``codes``."""
        counts = self.starts[codes + 1] - self.starts[codes]
        place = np.repeat(np.arange(len(codes)), counts)
        first = np.cumsum(counts) - counts
        return np.arange(len(place)) - first[place] + self.starts[codes][place], place
