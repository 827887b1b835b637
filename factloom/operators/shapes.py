"""Shape constraints as DataFrames of violations: focus, constraint, detail."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _report(df: DataFrame, focus: str, constraint: str, detail: Column | None = None) -> DataFrame:
    return df.select(F.col(focus).cast("string").alias("focus"), F.lit(constraint).alias("constraint"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def cardinality(nodes: DataFrame, values: DataFrame, focus: str, low: int = 0, high: int | None = None, name: str = "count") -> DataFrame:
    """Nodes with fewer than low or more than high values."""
    n = nodes.select(focus).join(values.groupBy(focus).agg(F.count("*").alias("n")), focus, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bad = (F.col("n") < low) if high is None else (F.col("n") < low) | (F.col("n") > high)
    return _report(n.where(bad), focus, name, F.col("n"))


def class_of(values: DataFrame, focus: str, target: str, types: DataFrame, closure: DataFrame, wanted: str) -> DataFrame:
    """Values whose target has no type that is the wanted class or below it. types: node, type; closure: child, parent, reflexive."""
    fit = types.join(closure.where(F.col("parent") == wanted), F.col("type") == F.col("child")).select(F.col("node").alias(target)).distinct()
    return _report(values.join(fit, target, "left_anti"), focus, "class", F.col(target))


def column_check(df: DataFrame, focus: str, name: str, ok: Column, detail: Column | None = None) -> DataFrame:
    """Datatype, pattern, in, range and or constraints: rows where the condition is false or unknown."""
    return _report(df.where(~F.coalesce(ok, F.lit(False))), focus, name, detail)


def exactly_one(df: DataFrame, focus: str, branches: Sequence[Column]) -> DataFrame:
    """xone: exactly one branch holds."""
    n = sum((F.coalesce(b, F.lit(False)).cast("int") for b in branches), F.lit(0))
    return _report(df.withColumn("_n", n).where("_n <> 1"), focus, "xone", F.col("_n"))


def interval_order(df: DataFrame, focus: str) -> DataFrame:
    return _report(df.where("valid_until <= valid_from"), focus, "interval", F.col("valid_until"))


def unknown_predicates(assertions: DataFrame, declared: DataFrame) -> DataFrame:
    """Assertions whose predicate is not declared, not assertable, or whose types do not fit its domain and range.

    declared: predicate_iri, domain, range, assertable; assertions with subject_type and object_type.
    """
    j = assertions.join(declared, "predicate_iri", "left")
    ok = F.col("domain").isNotNull() & F.col("range").isNotNull() & F.coalesce("assertable", F.lit(True)) & (F.col("subject_type") == F.col("domain")) & (F.col("object_type") == F.col("range"))
    return column_check(j, "assertion_id", "predicate", ok, F.col("predicate_iri"))


def diff_terms(old: DataFrame, new: DataFrame) -> DataFrame:
    """iri, change (added, removed, changed), level (minor, major, patch): terms compared by iri. Both: iri, kind, label, parent."""
    a, b = (df.select("iri", *(F.col(c).alias(f"{p}_{c}") for c in ("kind", "label", "parent")), F.lit(True).alias(f"in_{p}")) for df, p in ((old, "old"), (new, "new")))
    j = a.join(b, "iri", "full_outer")
    hard = ~F.col("old_kind").eqNullSafe(F.col("new_kind")) | ~F.col("old_parent").eqNullSafe(F.col("new_parent"))
    soft = ~F.col("old_label").eqNullSafe(F.col("new_label"))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(hard | soft, "changed")
    level = F.when(F.col("in_old").isNull(), "minor").when(F.col("in_new").isNull() | hard, "major").otherwise("patch")
    return j.select("iri", change.alias("change"), level.alias("level")).where("change is not null")


#: Kinds of things that need a name.
NAMED = ("Agent", "Artifact", "Location", "Source")


def named_things(types: DataFrame, names: DataFrame, closure: DataFrame) -> DataFrame:
    """Agents, artifacts, locations and sources, or of a class below, without a name that is text. types: node, type; names: node, name; closure: child, parent, reflexive."""
    things = types.join(closure.where(F.col("parent").isin(*NAMED)), F.col("type") == F.col("child")).select("node").distinct()
    return cardinality(things, names.where("name is not null"), "node", low=1, name="name")


def identifiers(nodes: DataFrame, values: DataFrame, entities: DataFrame) -> DataFrame:
    """Identifiers without exactly one entity, scheme and value, or whose entity is none. nodes: node; values: node, property (identifies, scheme, value), value; entities: entity_id."""
    parts = [cardinality(nodes, values.where(F.col("property") == p), "node", 1, 1, p) for p in ("identifies", "scheme", "value")]
    targets = values.where("property = 'identifies'").join(entities.select(F.col("entity_id").alias("value")).distinct(), "value", "left_anti")
    return reduce(DataFrame.union, [*parts, _report(targets, "node", "class", F.col("value"))])


def unresolved_references(references: DataFrame, texts: DataFrame) -> DataFrame:
    """References that carry no source text, or several. references: reference_id; texts: reference_id, text."""
    return cardinality(references, texts.where("text is not null"), "reference_id", 1, 1, "reference_text")


def value_type(values: DataFrame, focus: str, column: str, datatype: str) -> DataFrame:
    """Values, as text, that are not of the datatype: string, decimal, integer, boolean, dateTime or anyURI."""
    return column_check(values, focus, "datatype", _LEXICAL[datatype](F.col(column)), F.col(column))


_LEXICAL = {
    "string": lambda c: c.isNotNull(),
    "decimal": lambda c: c.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"),
    "integer": lambda c: c.rlike(r"^[+-]?\d+$"),
    "boolean": lambda c: c.isin("true", "false", "1", "0"),
    "dateTime": lambda c: c.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$") & F.try_to_timestamp(c).isNotNull(),
    "anyURI": lambda c: ~c.rlike(r"[\s<>]"),
}


def node_kind(values: DataFrame, focus: str, column: str, kind: str) -> DataFrame:
    """Terms, as N-Triples writes them, that are not of the kind: IRI, BlankNode or Literal."""
    begins = {"IRI": "<", "BlankNode": "_:", "Literal": '"'}[kind]
    return column_check(values, focus, "nodeKind", F.col(column).startswith(begins), F.col(column))


def any_of(df: DataFrame, focus: str, branches: Sequence[Column]) -> DataFrame:
    """or: at least one branch holds."""
    holds = reduce(lambda a, b: a | b, (F.coalesce(b, F.lit(False)) for b in branches))
    return _report(df.where(~holds), focus, "or")
