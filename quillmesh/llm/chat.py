"""Tool calls and their results, linked, ordered, validated and serialised.

Calls and results meet in a join on their identifiers. A call's level is the length of the
longest chain of calls it depends on, so ordering by level is a topological order. Arguments are
checked against the schema of the tool, and each linked call becomes one canonical JSON text:
keys sorted, no white space, no escapes beyond those JSON needs.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}
_LONE = re.compile(r"[\ud800-\udfff]")
#: Dependencies of a conversation up to this many are levelled in one task; those of longer ones round by round.
_FEW_EDGES = 50_000


def canonical(value) -> str:
    """Canonical JSON text of a value; half characters, which no text can hold, stay escaped."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _number(text: str) -> float:
    """A float of JSON text; one beyond the range of floats is no JSON value here."""
    if abs(value := float(text)) == float("inf"):
        raise ValueError(text)
    return value


def _refused(text: str):
    raise ValueError(text)


def read_arguments(text: str | None):
    """(value, problems) of a call's arguments. NaN and infinities are not JSON; nesting beyond the reader's depth is a problem."""
    try:
        value = json.loads(text or "", parse_float=_number, parse_constant=_refused)
        canonical(value)  # as deep as it can be read, it must be written
        return value, []
    except RecursionError:
        return None, ["arguments are nested too deeply"]
    except ValueError:
        return None, ["arguments are not JSON"]


def _fits(value, kind) -> bool:
    """Whether a value is of a JSON type; whole floats are integers, booleans are no numbers, unknown types fit nothing."""
    if isinstance(value, bool):
        return kind == "boolean"
    return isinstance(value, _TYPES.get(kind, ())) or kind == "integer" and isinstance(value, float) and value.is_integer()


def _check(value, rule, name: str, found: list[str]) -> None:
    if not isinstance(rule, dict):
        return  # no rule: anything goes
    kinds = rule.get("type")
    if kinds is not None and not any(_fits(value, k) for k in (kinds if isinstance(kinds, list) else [kinds])):
        found.append(f"type of {name}")
        return
    if isinstance(rule.get("enum"), list) and canonical(value) not in map(canonical, rule["enum"]):
        found.append(f"value of {name}")
    if isinstance(value, dict):
        _check_members(value, rule, f"{name}.", found)
    elif isinstance(value, list) and "items" in rule:
        for i, x in enumerate(value):
            _check(x, rule["items"], f"{name}[{i}]", found)


def _check_members(value: dict, rule: dict, prefix: str, found: list[str]) -> None:
    found += [f"missing {prefix}{name}" for name in rule.get("required") or [] if name not in value]
    members = rule.get("properties")
    for name, x in value.items():
        if isinstance(members, dict) and name in members:
            _check(x, members[name], prefix + name, found)
        elif isinstance(members, dict) and rule.get("additionalProperties", False) is False:
            found.append(f"unexpected {prefix}{name}")


def problems(arguments, schema: dict | None) -> list[str]:
    """What a tool's schema has against some arguments, in sorted order.

    ``schema``: JSON schema with type (one or a list), enum, properties, required, items and
    additionalProperties, at any depth; names not in ``properties`` are unexpected unless it says
    otherwise; without ``properties`` any are allowed. None: an unknown tool.
    """
    if schema is None:
        return ["unknown tool"]
    if not isinstance(arguments, dict):
        return ["arguments are not an object"]
    found: list[str] = []
    _check_members(arguments, schema, "", found)
    return sorted(_LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", x) for x in found)


def _serialising(schemas: dict[str, dict]):
    def serialise(batches):
        for batch in batches:
            out: dict[str, list] = {"valid": [], "errors": [], "canonical": [], "canonical_sha256": []}
            for row in batch.to_pylist():
                arguments, errors = read_arguments(row["arguments"])
                errors = errors or problems(arguments, schemas.get(row["name"]))
                text = canonical({"arguments": arguments, "depends_on": sorted(row["depends_on"] or []), "id": row["call_id"], "name": row["name"], "result": row["result"]})
                for key, value in zip(out, (not errors, errors, text, hashlib.sha256(text.encode()).hexdigest())):
                    out[key].append(value)
            names = ["conv_id", "call_id", "turn", "status", "level"]
            kinds = {"valid": pa.bool_(), "errors": pa.list_(pa.string()), "canonical": pa.string(), "canonical_sha256": pa.string()}
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(v, kinds[k]) for k, v in out.items())], names=[*names, *out])

    return serialise


def _levelled(batches):
    """Levels of the calls of whole conversations, which come one after another: conv_id, call_id, dep (null: none)."""
    schema = {"conv_id": pa.int64(), "call_id": pa.string(), "level": pa.int32()}

    def settle(conv, edges):
        waits, users, level = {}, {}, {}
        for call, dep in edges:
            waits.setdefault(call, 0)
            if dep is not None:
                waits[call] += 1
                users.setdefault(dep, []).append(call)
        ready = [c for c, n in waits.items() if not n]
        level.update(dict.fromkeys(ready, 0))
        for call in ready:  # grows while it is read
            for user in users.get(call, ()):
                waits[user] -= 1
                level[user] = max(level.get(user, 0), level[call] + 1)
                if not waits[user]:
                    ready.append(user)
        return [(conv, c, level[c]) for c in ready]

    def batch_of(rows):
        columns = list(zip(*rows)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.values())], names=list(schema))

    conv, edges, out = None, [], []
    for batch in batches:
        for this, call, dep in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "call_id", "dep"))):
            if this != conv:
                out += settle(conv, edges)
                conv, edges = this, []
                if len(out) >= 10_000:
                    yield batch_of(out)
                    out = []
            edges.append((call, dep))
    yield batch_of(out + settle(conv, edges))


def levels(calls: DataFrame, scratch: Scratch, few: int = _FEW_EDGES) -> DataFrame:
    """conv_id, call_id, level: 0 without dependencies, else one more than the highest of them.

    Dependencies on calls that do not exist don't count. Calls in or behind a cycle get no row. A
    conversation with up to ``few`` dependencies is ordered at once, next to others in its task. Of longer
    ones, however long, a round settles one level and only unsettled calls go into the next, dealt
    by call and not by conversation; the number of rounds is that of their longest chain.
    """
    ids = calls.select("conv_id", "call_id").distinct()
    edges = calls.select("conv_id", "call_id", F.explode(F.array_distinct("depends_on")).alias("dep")).distinct()
    known = ids.select("conv_id", F.col("call_id").alias("dep"))
    edges = edges.join(known.hint("shuffle_hash"), ["conv_id", "dep"], "left_semi")
    rows = scratch.cut(ids.withColumn("dep", F.lit(None).cast("string")).unionByName(edges), "edges")
    large = rows.groupBy("conv_id").agg(F.count("*").alias("n")).filter(F.col("n") > few).select("conv_id")
    large = scratch.cut(large, "large")
    small = rows.join(large.hint("merge"), "conv_id", "left_anti").repartition("conv_id").sortWithinPartitions("conv_id")
    out = small.mapInArrow(_levelled, "conv_id long, call_id string, level int")
    if large.isEmpty():
        return out
    rows = rows.join(large.hint("merge"), "conv_id", "left_semi")
    return out.unionByName(_levels_by_round(rows.select("conv_id", "call_id").distinct(), scratch.cut(rows.filter("dep is not null"), "open"), scratch))


def _levels_by_round(ids: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    settled = scratch.cut(ids.join(edges.select("conv_id", "call_id").distinct().hint("merge"), ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)), "level")
    out, open_edges, level = settled, edges, 0
    while True:
        # of the edges whose dependency is not settled yet
        rest = open_edges.join(settled.select("conv_id", F.col("call_id").alias("dep")).hint("merge"), ["conv_id", "dep"], "left_anti")
        rest = scratch.cut(rest, "open")
        waiting = rest.select("conv_id", "call_id").distinct()
        level += 1
        ready = open_edges.select("conv_id", "call_id").distinct().join(waiting.hint("merge"), ["conv_id", "call_id"], "left_anti")
        settled = scratch.cut(ready.withColumn("level", F.lit(level)), "level")
        if settled.isEmpty():
            return out
        out, open_edges = out.unionByName(settled), rest


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """A row for each call: conv_id, call_id, turn, status, level, valid, errors, canonical, canonical_sha256.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), depends_on (array of call ids).
    ``results``: conv_id, call_id, content. Status: linked, unanswered (no result, ``result`` null in the
    JSON) or cycle (no topological level: null). A result without a call is left out; of several
    results the first text counts, of repeated call ids the earliest turn. Null ids take no part.
    A null conv_id is a conversation of its own kind: its calls take no part either.
    Order by level within a conversation for a topological order. Empty tables give no rows. Columns
    other than those named are ignored, whatever their names.
    """
    scratch = Scratch(calls.sparkSession, "calls")
    known = calls.filter("call_id is not null and conv_id is not null")
    known = known.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "name", "arguments", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))).alias("x")).select("conv_id", "call_id", "x.*")
    known = scratch.cut(known, "calls")
    answers = results.filter("call_id is not null").groupBy("conv_id", "call_id").agg(F.min("content").alias("result"), F.count("*").alias("results"))
    linked = known.join(answers.hint("shuffle_hash"), ["conv_id", "call_id"], "left").join(levels(known, scratch).hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    status = F.when(F.col("level").isNull(), "cycle").when(F.col("results").isNull(), "unanswered").otherwise("linked")
    rows = linked.withColumn("status", status).select("conv_id", "call_id", "turn", "status", "level", "name", "arguments", "depends_on", "result")
    return rows.mapInArrow(_serialising(schemas), "conv_id long, call_id string, turn long, status string, level int, valid boolean, errors array<string>, canonical string, canonical_sha256 string")
