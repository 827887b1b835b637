"""Scalar functions as Column expressions; all run inside the JVM, but for the three that need Unicode tables or edit distances."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

IRI_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


# -- text


def squeeze(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def casefold(s: Column) -> Column:
    """Full case folding in the JVM: upper case joins what lower case keeps apart (sharp s, ligatures, long s). The dotless i
    stays, and the final sigma becomes a plain one."""
    # the optimizer takes lower(upper(x)) for lower(x), so that a step of its own must stand between
    upper = F.upper(F.translate(F.lower(s), "ıς", "\ue000σ"))
    return F.translate(F.lower(F.translate(upper, "ς", "Σ")), "\ue000ς", "ıσ")


def normalize_surface(s: Column) -> Column:
    """Case-folded, with single spaces; punctuation stays."""
    return squeeze(casefold(s))


def normalize_name(s: Column) -> Column:
    """As normalize_surface, with everything that is no word character or space replaced by a space."""
    return squeeze(F.regexp_replace(casefold(s), r"[^\p{L}\p{N}_\s]", " "))


@pandas_udf(T.StringType())
def fold_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Case-folded, decomposed, without combining marks; word characters and :/.- stay, runs of others become one space."""
    for s in batches:
        plain = s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x.casefold()) if unicodedata.category(c) != "Mn"))
        yield plain.str.replace(r"[^\w:/.-]+", " ", regex=True).str.strip()


def tokens(s: Column) -> Column:
    """Words of a normalised name; the empty name has none."""
    return F.filter(F.split(s, " "), lambda x: x != "")


def overlap_coefficient(query: Column, alias: Column) -> Column:
    """Shared distinct tokens over the smaller side: distinct tokens of the query, all tokens (repeats count) of the alias."""
    shared = F.size(F.array_intersect(query, alias))
    return F.try_divide(shared.cast("double"), F.least(F.size(F.array_distinct(query)), F.size(alias)))


def source_urn(s: Column) -> Column:
    """An IRI stays; anything else becomes urn:source: and its percent-encoding, spaces as %20."""
    return F.when(s.rlike(IRI_SCHEME), s).otherwise(F.concat(F.lit("urn:source:"), F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))))


def iri_tail(s: Column) -> Column:
    return F.regexp_extract(s, r"([^/#:]*)$", 1)


def is_iri(s: Column) -> Column:
    return F.coalesce(s.rlike(IRI_SCHEME), F.lit(False))


def first_filled(*candidates: Column) -> Column:
    """The first candidate that is not blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in candidates))


def redact_secrets(s: Column) -> Column:
    """Values of keys that name a secret are replaced."""
    return F.regexp_replace(s, r"(?i)\b(api[_-]?key|token|password|secret|authorization)(\s*[=:]\s*)(\"[^\"]*\"|\S+)", "$1$2[redacted]")


def span_matches(text: Column, start: Column, end: Column, exact: Column) -> Column:
    """Whether text[start:end], in code points from 0, is the exact text."""
    return F.coalesce((start >= 0) & (end > start) & (F.substring(text, start + 1, end - start) == exact), F.lit(False))


# -- hashes and identifiers


def content_sha256(s: Column) -> Column:
    return F.sha2(s, 256)


def pending_iri(name: Column) -> Column:
    return F.concat(F.lit("urn:world:pending:"), F.md5(normalize_surface(name).cast("binary")))


def source_record_key(source: Column, record: Column) -> Column:
    """urn:source-record: and the digest of the compact JSON array of both."""
    return F.concat(F.lit("urn:source-record:"), F.sha2(F.to_json(F.array(source, record)), 256))


def fingerprint(**fields: Column) -> Column:
    """The digest of a JSON object with sorted keys; nulls are written out, so absent and null fields are alike."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}), 256)


# -- time


def instant_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def lag_seconds(now: Column, then: Column) -> Column:
    return F.timestamp_diff("SECOND", then, now)


def valid_at(start: Column, end: Column, at: Column) -> Column:
    """Half-open: start <= at < end, an absent end never comes."""
    return (start <= at) & (end.isNull() | (at < end))


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return (other_end.isNull() | (start < other_end)) & (end.isNull() | (other_start < end))


# -- numbers


def finite(s: Column) -> Column:
    """A finite double, or null for anything else."""
    d = s.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def bounded_ratio(part: Column, whole: Column) -> Column:
    """0 if there is nothing to divide by, never outside [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))))


def point_iri(lat: Column, lon: Column) -> Column:
    """Six decimals; minus zero is zero."""
    flat = lambda c: F.when(c == 0, F.lit(0.0)).otherwise(c)
    return F.format_string("urn:geo:crs84:%.6f:%.6f", flat(lat), flat(lon))


def canonical_decimal(s: Column, limit: int) -> Column:
    """A decimal within +-limit without exponent and trailing zeros; null otherwise."""
    d = s.try_cast("decimal(38,18)")
    plain = F.regexp_replace(F.regexp_replace(d.cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    plain = F.when(d == 0, F.lit("0")).otherwise(F.when(d.cast("string").contains("E"), F.format_string("%s", d)).otherwise(plain))
    return F.when(F.abs(d) <= limit, plain)


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Closed box, finite coordinates only."""
    good = ~(F.isnan(lat) | F.isnan(lon))
    return F.coalesce(good & lat.between(south, north) & lon.between(west, east), F.lit(False))


def valid_lei(s: Column) -> Column:
    """18 letters or digits and two digits; letters read as 10..35, the number is 1 modulo 97. The remainder is carried digit by digit."""
    value = lambda ch: F.when(ch.between("0", "9"), ch.cast("int")).otherwise(F.ascii(ch) - 55)
    step = lambda acc, ch: F.when(value(ch) < 10, (acc * 10 + value(ch)) % 97).otherwise((acc * 100 + value(ch)) % 97)
    rest = F.aggregate(F.split(s, ""), F.lit(0), lambda acc, ch: F.when(ch == "", acc).otherwise(step(acc, ch)).cast("int"))
    return F.coalesce(s.rlike(r"^[A-Z0-9]{18}[0-9]{2}$"), F.lit(False)) & F.coalesce(rest == 1, F.lit(False))


def nearest_rank(n: Column, q: float) -> Column:
    """The rank of a percentile, half to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(n * F.lit(q), 0).cast("int"))


# -- collections


def visible(sources: Column, scope: Sequence[str]) -> Column:
    """Sources in scope, in order; "*" stands for all."""
    if "*" in scope:
        return sources
    return F.filter(sources, lambda x: x.isin(list(scope)))


def ordered_union(*lists: Column) -> Column:
    """All items once, in order of their first place."""
    return F.array_distinct(F.concat(*lists))


def datatype_iri(value: Column) -> Column:
    """The XML Schema type of a measurement as written: boolean, integer, decimal, else string."""
    return F.concat(F.lit("xsd:"), F.when(value.rlike("^(true|false)$"), "boolean").when(value.rlike(r"^[+-]?\d+$"), "integer").when(value.rlike(r"^[+-]?(\d+\.\d*|\.\d+)$"), "decimal").otherwise("string"))


def first_mapped(classes: Column, mapping: dict[str, str]) -> Column:
    """The type of the first class that the mapping knows."""
    table = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return F.element_at(table, F.get(F.filter(classes, lambda c: c.isin(list(mapping))), F.lit(0)))


def _transposed_distance(a: str, b: str) -> int:
    """Edits, a swap of neighbours counting as one (restricted form)."""
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


@pandas_udf(T.IntegerType())
def damerau_levenshtein(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _transposed_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")
