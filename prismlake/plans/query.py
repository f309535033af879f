"""What a search asks for, parsed and checked before any plan is built."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.functions import text as texts
from prismlake.functions import vectors
from prismlake.schemas import FACE_MODEL

SORTS = ("MOST_RELEVANT", "NEWEST_FIRST", "OLDEST_FIRST")
MODES = ("NORMAL", "OCR")


class QueryError(ValueError):
    """A query that can't be answered; the message is for the user."""


@dataclass(frozen=True)
class Filters:
    start_millis: int | None = None
    end_millis: int | None = None
    media_type: str | None = None
    sort: str = "MOST_RELEVANT"
    mode: str = "NORMAL"

    def __post_init__(self):
        if self.sort not in SORTS or self.mode not in MODES:
            raise QueryError(f"unknown sort or mode: {self.sort}, {self.mode}")


@dataclass(frozen=True)
class Query:
    """A checked query: at most a vector, vectors of persons, words."""

    filters: Filters = field(default_factory=Filters)
    vector: tuple[float, ...] | None = None
    people: tuple[tuple[float, ...], ...] = ()
    words: tuple[str, ...] = ()
    limit: int = 100
    face_threshold: float = 0.45

    def __post_init__(self):
        if self.filters.mode == "OCR":
            if self.vector is not None:
                raise QueryError("text search takes no image or description")
        elif not self.vector and not self.people:
            raise QueryError("enter a prompt, a person or a reference photo")


def canonical_handle(name: str) -> str:
    """X7; fails where the name can't be a handle."""
    clean = re.sub(r"\s+", "_", unicodedata.normalize("NFC", name.strip().removeprefix("@")).lower())
    if not 1 <= len(clean) <= 40 or not all(c == "_" or unicodedata.category(c)[0] in "LN" for c in clean):
        raise QueryError("use 1 to 40 letters, numbers or underscores for a name")
    return clean


def wordy(c: str, marks: bool) -> bool:
    """A letter, digit or underscore, or perhaps a combining mark."""
    return c == "_" or unicodedata.category(c)[0] in ("LNM" if marks else "LN")


def parse(query: str) -> tuple[str, list[str]]:
    """The text without mentions, and the mentioned handles in order."""
    out, handles, i = [], [], 0
    while i < len(query):
        if query[i] == "@" and (not i or not (query[i - 1] == "@" or wordy(query[i - 1], False))):
            end = i + 1
            while end < len(query) and wordy(query[end], True):
                end += 1
            if end > i + 1:
                handles.append(canonical_handle(query[i + 1 : end]))
                out.append(" ")
                i = end
                continue
        out.append(query[i])
        i += 1
    text = " ".join("".join(out).split()).strip(",.!?;:").strip()
    if re.search(r"(?<!\S)@", text):
        raise QueryError("enter a saved name after @")
    return text, list(dict.fromkeys(handles))


def open_mention(draft: str) -> str | None:
    """The handle being typed at the end of a draft (maybe empty), or None; for ``store.suggestions``."""
    m = re.search(r"(?:^|\s)@([^\s@]*)$", unicodedata.normalize("NFC", draft))
    return m[1].lower() if m and all(wordy(c, True) for c in m[1]) else None


def people_vectors(people: DataFrame, handles: Sequence[str], model: str = FACE_MODEL) -> list[list[float]]:
    """The mentioned persons' vectors; unknown ones and ones of another model fail, before anything is encoded."""
    if not handles:
        return []
    found = {r["handle"]: r for r in people.where(F.col("handle").isin(list(handles))).select("handle", "embedding", "embeddingModel").collect()}  # a row for each mention
    unknown = [h for h in handles if h not in found]
    if unknown:
        raise QueryError("unknown " + ", ".join(f"@{h}" for h in unknown))
    old = [h for h in handles if found[h]["embeddingModel"] != model]
    if old:
        raise QueryError("update the face photo of " + ", ".join(f"@{h}" for h in old))
    return [list(found[h]["embedding"]) for h in handles]


def build(
    query: str, filters: Filters | None = None, people: DataFrame | None = None, *, limit: int = 100, encode_text: Callable[[str], Sequence[float]] | None = None,
    references: Sequence[Sequence[float]] = (), face_threshold: float = 0.45,
) -> Query:
    """A ``Query`` from what a user typed; ``encode_text`` is called last and only if the text counts."""
    filters = filters or Filters()
    text, handles = parse(unicodedata.normalize("NFC", query.strip()))
    if filters.mode == "OCR":
        if len(references):
            raise QueryError("text search takes no reference photo")
        words = texts.query_words(text)
        if not words:
            raise QueryError("enter the words to look for")
    else:
        words = []
    if handles and people is None:
        raise QueryError("face search is unavailable")
    persons = people_vectors(people, handles) if handles else []
    vector = None
    if filters.mode == "NORMAL":
        encoded = None
        if text:
            if encode_text is None:
                raise QueryError("no text encoder")
            encoded = encode_text(text)
        if encoded is not None or len(references):
            vector = tuple(vectors.compose(encoded, references))
    return Query(filters, vector, tuple(map(tuple, persons)), tuple(words), limit, face_threshold)


def with_mode(query: Query, mode: str) -> Query:
    return replace(query, filters=replace(query.filters, mode=mode))
