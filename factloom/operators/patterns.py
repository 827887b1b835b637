"""Graph patterns over triples (s, p, o): joins, optional parts, absent parts and paths, declared once and run as one DataFrame plan.

A triples table partitioned by p turns every pattern with a constant predicate into a pruned scan; bound variables are filters on
those scans and starting points of paths. Patterns are joined in the order given, so write the selective ones first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .closure import closure


@dataclass(frozen=True)
class Query:
    """where: patterns "subject predicate object", terms that start with ? are variables, a predicate with * or + is a path;
    optional: groups that may be missing; absent: (group, condition) that must not exist; filters: SQL conditions over variables;
    select: column -> SQL expression; group: columns to group by if select has aggregates."""

    where: Sequence[str]
    select: Mapping[str, str]
    optional: Sequence[Sequence[str]] = ()
    absent: Sequence[tuple[Sequence[str], str]] = ()
    filters: Sequence[str] = ()
    group: Sequence[str] = ()
    distinct: bool = False
    union: Sequence[str] = field(default=())


def _terms(pattern: str) -> tuple[str, str, str]:
    s, p, o = pattern.split(" ", 2)
    return s, p, o


def predicates(q: Query) -> set[str]:
    """The predicates that a query names: what it needs of the triples."""
    groups = [q.where, q.union, *q.optional, *(g for g, _ in q.absent)]
    return {_terms(x)[1].rstrip("*+") for g in groups for x in g}


def one_pattern(triples: DataFrame, pattern: str, bind: Mapping[str, str] | None = None) -> DataFrame:
    """The variables of one pattern. Constants and bound variables are filters on the scan; of a path of one step or more they are where it starts."""
    s, p, o = _terms(pattern)
    value = lambda term: (bind or {}).get(term[1:]) if term.startswith("?") else term
    own = triples.where(F.col("p") == p.rstrip("*+"))
    if p[-1] in "*+":
        start = next(((side, value(term)) for side, term in (("parent", o), ("child", s)) if value(term) is not None), None)
        step = own.select(F.col("s").alias("child"), F.col("o").alias("parent"))
        own = closure(step, start=start).select(F.col("child").alias("s"), F.col("parent").alias("o"))
    for column, term in (("s", s), ("o", o)):
        if value(term) is not None:
            own = own.where(F.col(column) == value(term))
    return own.select(*(F.col(column).alias(term[1:]) for column, term in (("s", s), ("o", o)) if term.startswith("?")))


def _with_path(triples: DataFrame, out: DataFrame | None, pattern: str, bind: Mapping[str, str]) -> DataFrame:
    """out joined with a path of any length, none included: a node reaches itself, whether it has such an edge or not."""
    s, _, o = _terms(pattern)
    longer = one_pattern(triples, pattern, bind)
    ends = [t[1:] for t in (s, o) if t.startswith("?")]
    if len(ends) == 2:
        longer = longer.where(F.col(ends[0]) != F.col(ends[1]))
    value = lambda term: bind.get(term[1:]) if term.startswith("?") else term
    if out is None:  # no other pattern says which nodes there are: all terms of the graph
        node = triples.select(F.col("s").alias("n")).union(triples.select("o")).distinct()
        none = node.select(*(F.col("n").alias(e) for e in ends))
    else:
        known = [e for e in ends if e in out.columns]
        if not known:
            raise ValueError(f"{pattern!r} shares no variable with the patterns before it")
        none = out
        for e in ends:
            none = none.where(F.col(e) == F.col(known[0])) if e in out.columns else none.withColumn(e, F.col(known[0]))
        longer = out.join(longer, known)
    for term in (s, o):
        if value(term) is not None:
            none = none.where(F.col(ends[0]) == value(term))
    if len(ends) < 2:  # the other end is a constant, which reaches itself in no step
        constant = next(t for t in (s, o) if not t.startswith("?"))
        longer = longer.where(F.col(ends[0]) != constant)
    return longer.unionByName(none)


def match(triples: DataFrame, patterns: Sequence[str], bind: Mapping[str, str] | None = None) -> DataFrame:
    """Patterns joined in the order given; paths of any length, none included, come last, as they need the nodes that the others name."""
    bind = bind or {}
    star = lambda x: _terms(x)[1].endswith("*")
    waiting = sorted(patterns, key=star)
    out = None
    while waiting:
        # the next pattern that shares a variable with those before it
        fits = [x for x in waiting if out is None or {t[1:] for t in _terms(x)[::2]} & set(out.columns)]
        if not fits:
            raise ValueError(f"{waiting[0]!r} shares no variable with the patterns before it")
        pattern = fits[0]
        waiting.remove(pattern)
        if star(pattern):
            out = _with_path(triples, out, pattern, bind)
            continue
        df = one_pattern(triples, pattern, bind)
        out = df if out is None else out.join(df, [c for c in out.columns if c in df.columns])
    return out


def run(triples: DataFrame, q: Query, **bind: str) -> DataFrame:
    """bind: values of variables, compared as text, which reach every scan that names them."""
    parts = [q.where, q.union] if q.union else [q.where]
    out = None
    for patterns in parts:
        df = match(triples, patterns, bind)
        keep = df.columns if out is None else [c for c in out.columns if c in df.columns]
        out = df if out is None else out.select(keep).union(df.select(keep))
    for group in q.optional:
        df = match(triples, group, bind)
        out = out.join(df, [c for c in out.columns if c in df.columns], "left")
    for group, condition in q.absent:
        df = match(triples, group, bind)
        shared = [c for c in out.columns if c in df.columns]
        out = out.join(df.where(condition or "true").select(shared).distinct(), shared, "left_anti")
    for condition in q.filters:
        out = out.where(condition)
    columns = [F.expr(e).alias(c) for c, e in q.select.items()]
    if q.group:
        keys = [F.expr(q.select[c]).alias(c) for c in q.group]
        out = out.groupBy(*keys).agg(*(F.expr(e).alias(c) for c, e in q.select.items() if c not in q.group)).select(*q.select)
    elif any(e.lower().startswith(("count(", "min(", "max(")) for e in q.select.values()):
        out = out.agg(*columns)
    else:
        out = out.select(*columns)
    return out.distinct() if q.distinct else out


def to_sql(q: Query, **bind: str) -> tuple[str, list[str]]:
    """The same query as SQL text over a relation triples(s, p, o), and the common table expressions that its paths need."""
    paths: dict[str, str] = {}

    def sub(pattern: str) -> tuple[str, list[str]]:
        s, p, o = _terms(pattern)
        source, where = "triples", [f"p = '{p}'"]
        if p[-1] in "*+":
            name = "path_" + "".join(c for c in p[:-1] if c.isalnum()) + ("_r" if p[-1] == "*" else "")
            loops = " UNION SELECT s, s FROM triples UNION SELECT o, o FROM triples" if p[-1] == "*" else ""  # every term reaches itself
            paths[name] = f"{name}(s, o) AS (SELECT s, o FROM (SELECT s, o FROM triples WHERE p = '{p[:-1]}'{loops}) UNION SELECT r.s, t.o FROM {name} r JOIN triples t ON t.p = '{p[:-1]}' AND t.s = r.o)"
            source, where = name, []
        keep = []
        for column, term in (("s", s), ("o", o)):
            if term.startswith("?"):
                keep.append((column, term[1:]))
            else:
                where.append(f"{column} = '{term}'")
        text = f"(SELECT {', '.join(f'{c} AS {v}' for c, v in keep)} FROM {source}" + (f" WHERE {' AND '.join(where)}" if where else "") + ")"
        return text, [v for _, v in keep]

    counter = iter(range(1000))

    def joined(patterns: Sequence[str]) -> tuple[str, list[str]]:
        text, seen = "", []
        for pattern in patterns:
            one, cols = sub(pattern)
            one += f" t{next(counter)}"
            shared = [c for c in cols if c in seen]
            text = one if not text else f"{text} JOIN {one} USING ({', '.join(shared)})"
            seen += [c for c in cols if c not in seen]
        return text, seen

    bodies, cols = [], None
    for patterns in [q.where, q.union] if q.union else [q.where]:
        text, seen = joined(patterns)
        conditions = [f"{k} = '{v}'" for k, v in bind.items() if k in seen]
        bodies.append((text, seen, conditions))
        cols = seen if cols is None else [c for c in cols if c in seen]
    core = " UNION ALL ".join(f"SELECT {', '.join(cols)} FROM {t}" + (f" WHERE {' AND '.join(c)}" if c else "") for t, _, c in bodies)
    text = f"(SELECT * FROM ({core}) u) base"
    for group in q.optional:
        t, seen = joined(group)
        text += f" LEFT JOIN (SELECT {', '.join(seen)} FROM {t}) t{next(counter)} USING ({', '.join(c for c in seen if c in cols)})"
        cols = cols + [c for c in seen if c not in cols]
    for group, condition in q.absent:
        t, seen = joined(group)
        shared = [c for c in seen if c in cols]
        text += f" ANTI JOIN (SELECT {', '.join(shared)} FROM {t} WHERE {condition or 'true'}) t{next(counter)} USING ({', '.join(shared)})"
    where = f" WHERE {' AND '.join(q.filters)}" if q.filters else ""
    group_by = f" GROUP BY {', '.join(q.select[c] for c in q.group)}" if q.group else ""
    sql = f"SELECT {'DISTINCT ' if q.distinct else ''}{', '.join(f'{e} AS {c}' for c, e in q.select.items())} FROM {text}{where}{group_by}"
    return sql, list(paths.values())


_CURRENT = ((("?x assertion:supersedes ?a",), ""), (("?x assertion:retracts ?a",), ""))

#: The competency templates. Instants are compared as ISO text.
TEMPLATES: dict[str, Query] = {
    "q01_entity_lookup": Query(["?e core:alias ?alias", "?e core:name ?name"], {"name": "name"}, distinct=True),
    "q02_one_hop": Query(["?person core:memberOf ?org", "?org core:name ?org_name"], {"org_name": "org_name"}),
    "q03_region_platforms": Query(["?loc core:partOf* ?region", "?org core:locatedAt ?loc", "?org core:operates ?platform", "?platform core:name ?name"], {"platform": "platform", "name": "name"}, distinct=True),
    "q04_temporal_asof": Query(["?a core:describes ?entity", "?a core:hasObject ?place", "?a core:validFrom ?since"], {"place": "place", "since": "since"}, absent=[(("?a core:validUntil ?until_t",), "until_t <= '{at}'")], filters=["since <= '{at}'"]),
    "q05_provenance": Query(["?obs core:observes ?entity", "?obs core:hasSource ?source", "?source core:name ?label"], {"label": "label"}, distinct=True),
    "q06_analytical_count": Query(["?x rdf:type ?t", "?t rdfs:label ?type_label"], {"type_label": "type_label", "n": "count(*)"}, group=["type_label"]),
    "q07_org_subordinates": Query(["?sub org:subordinateTo+ ?top", "?sub core:name ?name"], {"sub": "sub", "name": "name"}),
    "q08_track_resolution": Query(["?track track:hasTrackId ?track_id", "?track track:trackOf ?e", "?e core:name ?name"], {"track_id": "track_id", "name": "name"}),
    "q09_tracks_in_region": Query(["?loc core:partOf* ?region", "?org core:locatedAt ?loc", "?org core:operates ?platform", "?track track:trackOf ?platform", "?track track:hasTrackId ?track_id", "?platform core:name ?platform_name", "?org core:name ?org_name"], {"track_id": "track_id", "platform_name": "platform_name", "org_name": "org_name"}, distinct=True),
    "q10_track_sensor_provenance": Query(["?track track:hasTrackId ?track_id", "?track track:derivedFrom ?obs", "?obs sensor:detectedBy ?sensor", "?sensor core:name ?sensor_name"], {"track_id": "track_id", "sensor_name": "sensor_name"}, distinct=True),
    "q17_temporal_history": Query(["?a core:describes ?entity", "?a core:hasObject ?place", "?a core:validFrom ?since"], {"place": "place", "since": "since", "until_t": "until_t"}, optional=[["?a core:validUntil ?until_t"]], absent=_CURRENT),
    "q18_temporal_asof": Query(["?a core:describes ?entity", "?a core:hasObject ?place", "?a core:validFrom ?since"], {"entity": "entity", "place": "place"}, optional=[["?a core:validUntil ?until_t"]], absent=_CURRENT, filters=["since <= '{at}'", "(until_t IS NULL OR until_t > '{at}')"]),
    "q19_conflict_count": Query(["?a core:describes ?entity", "?a core:hasObject ?place", "?a core:validFrom ?since"], {"entity": "entity", "n": "count(DISTINCT place)"}, optional=[["?a core:validUntil ?until_t"]], absent=_CURRENT, filters=["since <= '{at}'", "(until_t IS NULL OR until_t > '{at}')"], group=["entity"]),
    "q20_conflict_locations": Query(["?a core:describes ?entity", "?a core:hasObject ?place", "?a core:validFrom ?since"], {"entity": "entity", "place": "place"}, optional=[["?a core:validUntil ?until_t"]], absent=_CURRENT, filters=["since <= '{at}'", "(until_t IS NULL OR until_t > '{at}')"], distinct=True),
    "q21_assertion_status": Query(["?a core:describes ?entity"], {"a": "a", "state": "CASE WHEN x IS NOT NULL THEN 'corrected' WHEN y IS NOT NULL THEN 'retracted' ELSE 'active' END", "replacement": "x"}, optional=[["?x assertion:supersedes ?a"], ["?y assertion:retracts ?a"]]),
    "q22_provenance_sources": Query(["?a core:hasSource ?source", "?a core:hasObject ?place", "?source core:name ?label"], {"a": "a", "label": "label"}),
    "q23_inline_evidence": Query(["?a assertion:evidence ?ev", "?ev assertion:evidenceSource ?source", "?source core:name ?label", "?ev assertion:locator ?locator", "?ev assertion:spanStart ?first", "?ev assertion:spanEnd ?last"], {"a": "a", "label": "label", "locator": "locator", "span_start": "first", "span_end": "last"}),
    "q24_source_fact_interval": Query(["?a core:hasSource ?source", "?a core:hasObject ?place", "?a core:validFrom ?since"], {"a": "a", "since": "since"}, absent=_CURRENT, filters=["since >= '{start}'", "since < '{end}'"]),
    "q25_pending_identity": Query(["?a assertion:subjectReference ?ref", "?ref rdf:type identity:UnresolvedReference", "?ref identity:referenceText ?reference_text"], {"a": "a", "reference_text": "reference_text"}, absent=[(("?ref rdf:type core:Entity",), "")]),
    "q26_identifier_lookup": Query(["?id identity:identifierScheme ?scheme", "?id identity:identifierValue ?value", "?id identity:identifies ?e", "?e core:name ?name"], {"name": "name"}),
    "q27_identifier_collisions": Query(["?a identity:identifierValue ?value", "?b identity:identifierValue ?value", "?a identity:identifierScheme ?scheme_a", "?b identity:identifierScheme ?scheme_b"], {"value": "value", "scheme_a": "scheme_a", "scheme_b": "scheme_b"}, filters=["scheme_a < scheme_b", "a <> b"], distinct=True),
    "q28_observation_result_position": Query(["?res track:resultOf ?obs", "?obs core:atTime ?at_time", "?res track:position ?pos", "?pos core:name ?position_name"], {"obs": "obs", "at_time": "at_time", "position_name": "position_name"}),
    "q29_measurement_value": Query(["?res track:resultOf ?obs", "?res track:measurement ?m", "?m track:measurementName ?measure", "?m track:measurementValue ?value"], {"obs": "obs", "value": "value", "unit": "unit"}, optional=[["?m track:measurementUnit ?unit"]]),
    "q30_track_path": Query(["?track track:hasTrackId ?track_id", "?track track:derivedFrom ?obs", "?obs core:atTime ?at_time", "?res track:resultOf ?obs", "?res track:position ?pos", "?pos core:name ?position_name"], {"track_id": "track_id", "at_time": "at_time", "position_name": "position_name"}),
    "q31_sensor_provenance": Query(["?obs sensor:detectedBy ?sensor", "?sensor core:name ?sensor_name"], {"sensor_name": "sensor_name"}, union=["?track track:hasTrackId ?track_id", "?track track:derivedFrom ?seen", "?seen sensor:detectedBy ?sensor", "?sensor core:name ?sensor_name"], distinct=True),
    "q32_observation_provenance": Query(["?obs core:hasSource ?source", "?obs core:atTime ?at_time", "?source core:name ?label"], {"obs": "obs", "label": "label"}),
    "q33_observation_assertion_separation": Query(["?obs core:observes ?entity", "?obs core:atTime ?at_time", "?res track:resultOf ?obs", "?res track:position ?pos", "?pos core:name ?position_name"], {"at_time": "at_time", "position_name": "position_name"}, absent=[(("?entity core:locatedAt ?pos",), "")]),
    "q34_observation_event_result_types": Query(["?obs rdf:type ?ot", "?ot rdfs:subClassOf* core:Event", "?res track:resultOf ?obs", "?res rdf:type ?rt", "?rt rdfs:subClassOf* track:Result"], {"ot": "ot", "rt": "rt", "n": "count(*)"}, group=["ot", "rt"]),
    "q35_measurement_counts": Query(["?obs core:observes ?entity", "?res track:resultOf ?obs", "?res track:measurement ?m", "?m track:measurementName ?measure"], {"entity": "entity", "measure": "measure", "n": "count(*)"}, group=["entity", "measure"]),
    "q36_track_provenance": Query(["?track track:hasTrackId ?track_id", "?track core:hasSource ?source", "?source core:name ?label"], {"track_id": "track_id", "label": "label"}),
    "q37_temporal_relationship": Query(["?a core:describes ?entity", "?a core:hasObject ?target", "?a core:validFrom ?since"], {"target": "target", "since": "since", "until_t": "until_t"}, optional=[["?a core:validUntil ?until_t"]]),
}


def template(name: str, **values: str) -> Query:
    """A template with its instants filled in."""
    q = TEMPLATES[name]
    fill = lambda s: s.format(**values)
    return Query(q.where, q.select, q.optional, [(g, fill(c)) for g, c in q.absent], [fill(f) for f in q.filters], q.group, q.distinct, q.union)
