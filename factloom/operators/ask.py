"""Questions in words to registered templates: keyword intent, typed slots, status; and fact patterns in documents."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .patterns import TEMPLATES, run, template

MAX_ROWS = 100
# What an IRI begins with, and characters that never belong to one.
IRI_STARTS, IRI_STOPS = ("http://", "https://", "urn:"), "<>\"'"


def iris(question: str) -> list[str]:
    """IRIs in order: from one of the beginnings up to white space or a stop."""
    out = []
    for word in re.split(rf"[\s{IRI_STOPS}]+", question):
        at = min((word.find(x) for x in IRI_STARTS if 0 <= word.find(x) < len(word) - len(x)), default=-1)
        if at >= 0:
            out.append(word[at:])
    return out


def instants(question: str) -> list[str]:
    """Days, or days with a time of day and an offset, in order: as much of a day's word, and of the one after it, as reads as an ISO instant."""
    out = []
    for day in re.finditer(r"\d{4}-\d\d-\d\d", question):
        if question[day.start() - 1 : day.start()].isdigit():
            continue
        rest = question[day.end() : day.end() + 30]
        clock = re.match(r"[T ][\d:.]*\d", rest)
        found = day[0]
        if clock and re.fullmatch(r"[T ]\d\d:\d\d(:\d\d(\.\d+)?)?", clock[0]):
            zone = re.match(r"Z|[+-]\d\d:\d\d", rest[clock.end() :])
            found += clock[0] + (zone[0] if zone else "")
        if not question[day.start() + len(found) : day.start() + len(found) + 1].isdigit():
            out.append(found)
    return out


def plain(text: str) -> str:
    """Case-folded words without accents."""
    letters = "".join(c for c in unicodedata.normalize("NFD", text.casefold()) if unicodedata.category(c) != "Mn")
    return " ".join(re.sub(r"[^\w:/.-]+", " ", letters).split())


@dataclass(frozen=True)
class Intent:
    """A registered template: the words that call for it, and which variables a question must supply (iri or instant)."""

    template: str
    triggers: Sequence[str]
    slots: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Answer:
    status: str  # matched, ambiguous, needs_input, unsupported
    templates: tuple[str, ...] = ()
    missing: tuple[str, ...] = ()
    rows: tuple = ()
    has_more: bool = False


def choose(question: str, intents: Sequence[Intent]) -> tuple[str, ...]:
    """The templates whose longest matching trigger has most words, then most letters; ties stay."""
    asked = plain(question)
    ranked: dict[tuple[int, int], list[str]] = {}
    for i in intents:
        hits = [(len(plain(t).split()), len(t)) for t in i.triggers if plain(t) in asked]
        if hits:
            ranked.setdefault(max(hits), []).append(i.template)
    return tuple(sorted(ranked[max(ranked)])) if ranked else ()


def ask(triples: DataFrame, question: str, intents: Sequence[Intent], limit: int = MAX_ROWS, select: Callable[[str, Sequence[Intent]], str | None] | None = None) -> Answer:
    """Runs the one template that fits. `select` may be any injected chooser; only registered templates are accepted from it."""
    known = {i.template: i for i in intents if i.template in TEMPLATES}
    named = select(question, intents) if select else None
    found = (named,) if named in known else choose(question, list(known.values()))
    if not found:
        return Answer("unsupported")
    if len(found) > 1:
        return Answer("ambiguous", found)
    values = {"iri": iris(question), "instant": instants(question)}
    given: dict[str, str] = {}
    missing = []
    for slot, kind in known[found[0]].slots.items():
        if values[kind]:
            given[slot] = values[kind].pop(0).rstrip(".,;?!)") if kind == "iri" else values[kind].pop(0)
        else:
            missing.append(slot)
    if missing:
        return Answer("needs_input", found, tuple(missing))
    times = {k: v for k, v in given.items() if known[found[0]].slots[k] == "instant"}
    for t in times.values():
        datetime.fromisoformat(t)
    rows = run(triples, template(found[0], **times), **{k: v for k, v in given.items() if k not in times}).limit(limit + 1).collect()
    return Answer("matched", found, (), tuple(rows[:limit]), len(rows) > limit)


# How reports word a place or a membership, in two languages; the English ones in any case.
PHRASES = (
    ("đặt tại", "place"),
    ("có trụ sở tại", "place"),
    ("hiện đóng tại", "place"),
    ("hiện nằm tại", "place"),
    ("thuộc", "member"),
    ("is based at", "place"),
    ("is stationed at", "place"),
    ("is located at", "place"),
    ("is part of", "member"),
    ("part of", "member"),
)
RELATIONS = {"place": ("urn:kg:core#locatedAt", "location"), "member": ("urn:kg:core#memberOf", "entity")}
STOPS, SUBJECT_SIZE, OBJECT_SIZE = ".,;\n", (3, 80), (2, 80)
SINCE_WORDS = ("từ", "since")
SCORE_CAP = 0.7
FACT = "doc_id long, subject_name string, predicate_iri string, object_kind string, object_value string, valid_from string, model_score double, span_start int, span_end int, exact_text string"

#: Phrases of the same relation and language that a reader takes for one: their hits do not overlap.
_FAMILIES = (("đặt tại",), ("có trụ sở tại",), ("hiện đóng tại", "hiện nằm tại"), ("is based at", "is stationed at", "is located at"), ("thuộc",), ("is part of", "part of"))
_DATE = re.compile(rf"(?:{'|'.join(SINCE_WORDS)})\s+(\d{{4}}-\d\d-\d\d)(T\d\d:\d\d:\d\dZ)?", re.I)


def _finder(family: Sequence[str]) -> re.Pattern:
    """The family's phrases between white space; inside an English phrase any white space, inside a Vietnamese one a single space."""
    english = family[0].isascii()
    words = "|".join((r"\s+" if english else " ").join(map(re.escape, p.split())) for p in family)
    return re.compile(rf"(?<=\s)(?:{words})(?=\s)", re.I if english else 0)


_FINDERS = [(_finder(f), RELATIONS[dict(PHRASES)[f[0]]]) for f in _FAMILIES]


def _subject_start(text: str, gap: int, phrase: int, floor: int) -> int | None:
    """Where the clause before a phrase begins: after the last stop, at most 80 characters before the white space at `gap`; None if it is too short."""
    start = max([floor, gap - SUBJECT_SIZE[1], *(text.rfind(c, floor, gap) + 1 for c in STOPS)])
    end = max(gap, start + SUBJECT_SIZE[0])  # white space may fill up a short subject
    return start if end < phrase and "\n" not in text[gap:end] else None


def _object_span(text: str, after: int) -> tuple[int, int] | None:
    """The clause after a phrase: up to the next stop, at most 80 characters; None if it is too short."""
    first = after
    while first < len(text) and text[first].isspace():
        first += 1
    for start in range(first, after, -1):
        end = min([start + OBJECT_SIZE[1], len(text), *(at for at in (text.find(c, start, start + OBJECT_SIZE[1]) for c in STOPS) if at >= 0)])
        if end - start >= OBJECT_SIZE[0]:
            return start, end
    return None


def facts_of(text: str) -> Iterator[tuple]:
    """Candidates with code-point spans. A date clause anywhere in the span is the start of validity; at the end of the object it leaves the object."""
    for finder, (predicate, kind) in _FINDERS:
        floor = 0
        for hit in finder.finditer(text):
            if hit.start() <= floor:
                continue
            gap = hit.start()
            while gap > floor and text[gap - 1].isspace():
                gap -= 1
            start, span = _subject_start(text, gap, hit.start(), floor), _object_span(text, hit.end())
            if start is None or span is None:
                continue
            floor = span[1]
            subject, value = text[start : hit.start()].strip(), text[span[0] : span[1]].strip()
            if not subject or not value:
                continue
            when = _DATE.search(text, start, span[1])
            for last in _DATE.finditer(value):
                if last.start() and value[last.start() - 1].isspace() and not value[last.end() :].strip().strip("。"):
                    when = when or last
                    value = value[: last.start()].rstrip()
                    break
            yield subject, predicate, kind, value, when and when[1] + (when[2] or "T00:00:00Z"), SCORE_CAP, start, span[1], text[start : span[1]]


def extract_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a candidate fact: whole texts, null as none. Texts without any of the phrases are dropped in the JVM before Python sees them."""
    cheap = "(?iu)" + "|".join(r"\s+".join(p.split()) for p, _ in PHRASES)

    def run_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in FACT.split(",")]
        for b in batches:
            yield pd.DataFrame([(i, *f) for i, t in zip(b["doc_id"], b["text"], strict=True) for f in facts_of(t)], columns=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").rlike(cheap)).mapInPandas(run_, FACT)
