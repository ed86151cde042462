"""Tool-call linking for chat formatting, by DataFrame functions only.

Calls and results are joined by call identifier, calls are put in topological order of their dependencies, arguments are
validated against the tool's schema, and each message is serialised as canonical JSON (keys sorted at every depth, no
spaces, text as ``to_json`` escapes it; arguments that are not JSON become a string).  Each message stays a row of its own, so a conversation of any length is never gathered.

Linking: of calls that share an identifier within a conversation the first (by turn, then JSON) is the one that results
link to; the others are ``repeated``.  A result without a call is an ``orphan``; a call without a result ``unanswered``.

Order: a message's place is (due, level, turn).  A call is due at its turn, or later where a call that it depends on is
due later; among calls due at one turn the level counts how many such dependencies stand before it.  Calls that only
depend on earlier ones keep (turn, 0), so chains of any length cost nothing.  Others get their place in rounds; each round
also replaces an edge to a call with a single dependency by one past it, so a chain of n calls takes about log2(n) rounds, and
the rounds end as soon as only cycles, and what waits for them, are left: those calls get level -1.  A result has its
call's place; plain messages, of whatever role, keep (turn, 0).

Validation: arguments are parsed as JSON values with their types.  ``string``, ``integer`` (a number without fraction and exponent),
``number`` and ``boolean`` must be just that; JSON null is missing; an object with a repeated name does not parse.

Defined results: a null identifier links to nothing, nor does one in a conversation whose id is null; null arguments count as ``{}``; JSON that does not parse, or is no
object, fails with ``not an object``; unknown tools fail with ``unknown tool``; rows that repeat are each a message; an empty table gives no message; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, look_up

#: A tool's arguments: name -> (type, required, least, most); sizes bound numbers, and the lengths of strings.
Schema = dict[str, tuple[str, bool, float | None, float | None]]
MOST_TOOLS = 1000
#: The kinds of arguments, and the names of their JSON values' types.
SHAPES = {"string": "^STRING$", "integer": r"^(BIGINT|DECIMAL\([0-9]+,0\))$", "number": r"^(BIGINT|DECIMAL\([0-9,]+\)|DOUBLE)$", "boolean": "^BOOLEAN$"}


def canonical_json(**parts: Column) -> Column:
    """A JSON object with the given members in sorted order; None values are written as null, not left out."""
    members = [F.concat(F.lit(("," if i else "") + f'"{k}":'), F.coalesce(v, F.lit("null"))) for i, (k, v) in enumerate(sorted(parts.items()))]
    return F.concat(F.lit("{"), *members, F.lit("}"))


def json_text(value: Column) -> Column:
    """A string as JSON text."""
    whole = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNotNull(), F.substr(whole, F.lit(6), F.char_length(whole) - 6))


def argument_errors(name: Column, arguments: Column, tools: dict[str, Schema]) -> Column:
    """Array of what is wrong with a call's arguments (a JSON object as text), in the order of the schema's names."""
    if len(tools) > MOST_TOOLS:
        raise ValueError(f"more than {MOST_TOOLS} tools")
    text = F.coalesce(arguments, F.lit("{}"))
    parsed = F.try_parse_json(text)
    whole = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT<"), F.lit(False))
    members = F.json_object_keys(text)
    out = F.array(F.lit("unknown tool"))
    for tool, schema in tools.items():
        found = []
        for key, (kind, required, least, most) in sorted(schema.items()):
            path = f"$['{key}']"
            shape = F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
            missing = shape.isNull() | (shape == "VOID")
            size = F.char_length(F.try_variant_get(parsed, path, "string")) if kind == "string" else F.try_variant_get(parsed, path, "double")
            wrong = ~shape.rlike(SHAPES[kind])
            low = size < least if least is not None else F.lit(False)
            high = size > most if most is not None else F.lit(False)
            found.append(F.when(missing, F.lit(f"{key}: missing") if required else F.lit(None)).when(wrong, f"{key}: not {kind}").when(low, f"{key}: too small").when(high, f"{key}: too large"))
        extra = F.transform(F.array_except(F.array_sort(members), F.array(*map(F.lit, schema))), lambda m: F.concat(m, F.lit(": not in schema")))
        out = F.when(name == tool, F.when(~whole, F.array(F.lit("not an object"))).otherwise(F.concat(F.array_compact(F.array(*found)), extra))).otherwise(out)
    return out


def jumped(edges: DataFrame) -> DataFrame:
    """Edges (conv_id, call_id, need, steps): those to a call with a single need lead past it, to that need."""
    single = edges.groupBy("conv_id", "call_id").agg(F.max("need").alias("past"), F.max("steps").alias("more"), F.count(F.lit(1)).alias("n")).where("n = 1")
    past = single.select("conv_id", F.col("call_id").alias("need"), "past", "more")
    led = edges.join(past, ["conv_id", "need"], "left").select("conv_id", "call_id", F.coalesce("past", "need").alias("need"), (F.col("steps") + F.coalesce("more", F.lit(0).cast("long"))).alias("steps"))
    return led.groupBy("conv_id", "call_id", "need").agg(F.max("steps").alias("steps"))


def dues(edges: DataFrame, turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, call_id, due): the latest turn among each call and all that it needs, directly or not."""
    keys, now, k = ["conv_id", "call_id"], scratch.table(turns.select("conv_id", "call_id", F.col("turn").alias("due")), "due0"), 0
    edges = scratch.table(edges, "due_edges0")
    while True:
        needs = now.select("conv_id", F.col("call_id").alias("need"), F.col("due").alias("below"))
        raised = edges.join(needs, ["conv_id", "need"]).groupBy(*keys).agg(F.max("below").alias("below"))
        new = now.join(raised, keys, "left").select(*keys, F.greatest("due", "below").alias("due"), F.coalesce(F.col("below") > F.col("due"), F.lit(False)).alias("moved"))
        new = scratch.table(new, f"due{k + 1}")
        if new.where("moved").isEmpty():
            return new.drop("moved")
        edges, now, k = scratch.table(jumped(edges), f"due_edges{k + 1}"), new.drop("moved"), k + 1


def levels(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, call_id, level) of all calls in ``edges``: the longest chain of needs, or -1 on and behind a cycle."""
    keys, k = ["conv_id", "call_id"], 0
    edges = scratch.table(edges, "level_edges0")
    ends = edges.select("conv_id", F.col("need").alias("call_id")).distinct().join(edges.select(*keys).distinct(), keys, "left_anti")
    done = scratch.table(ends.withColumn("level", F.lit(0).cast("long")), "done0")
    new, settled = done, []
    while not new.isEmpty():
        settled.append(new)
        known = settled[0]
        for more in settled[1:]:
            known = known.union(more)
        below = known.select("conv_id", F.col("call_id").alias("need"), "level")
        ready = edges.join(below, ["conv_id", "need"], "left").groupBy(*keys).agg(F.max(F.col("level") + F.col("steps")).alias("level"), F.count_if(F.col("level").isNull()).alias("open"))
        new = scratch.table(ready.where("open = 0").drop("open"), f"done{k + 1}")
        waiting = edges.join(new, keys, "left_anti")
        # An edge to a call that just settled stays: its level is known.
        edges, k = scratch.table(jumped(waiting), f"level_edges{k + 1}"), k + 1
    stuck = edges.select(*keys).distinct().withColumn("level", F.lit(-1).cast("long"))
    for more in settled:
        stuck = stuck.union(more)
    return stuck


def places(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, call_id, due, level) of the calls (conv_id, call_id, turn, after; unique by id) in conversations with late needs.

    A need is late if its call's turn is not before that of the call that needs it.
    """
    edges = calls.select("conv_id", "call_id", "turn", F.explode(F.array_distinct("after")).alias("need"))
    edges = edges.join(calls.select("conv_id", F.col("call_id").alias("need"), F.col("turn").alias("need_turn")), ["conv_id", "need"])
    edges = scratch.table(edges, "edges")
    late = scratch.table(edges.where("need_turn >= turn").select("conv_id").distinct(), "late")
    if late.isEmpty():
        return calls.limit(0).select("conv_id", "call_id", F.col("turn").cast("long").alias("due"), F.lit(0).cast("long").alias("level"))
    edges = scratch.table(edges.join(late, "conv_id", "left_semi").select("conv_id", "call_id", "need", F.lit(1).cast("long").alias("steps")), "late_edges")
    ends = edges.select("conv_id", "call_id").union(edges.select("conv_id", "need")).distinct()
    due = dues(edges, calls.join(ends, ["conv_id", "call_id"], "left_semi"), scratch)
    same = edges.join(due, ["conv_id", "call_id"]).join(due.select("conv_id", F.col("call_id").alias("need"), F.col("due").alias("need_due")), ["conv_id", "need"]).where("need_due = due")
    level = levels(same.select("conv_id", "call_id", "need", "steps"), scratch)
    return due.join(level, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "due", F.coalesce("level", F.lit(0).cast("long")).alias("level"))


def link(calls: DataFrame, results: DataFrame, tools: dict[str, Schema], scratch: Scratch, messages: DataFrame | None = None) -> DataFrame:
    """Linked messages: (conv_id, turn, kind, call_id, status, errors, due, level, json).

    ``calls`` has conv_id, turn, call_id, name, arguments (JSON text) and after (array of call ids); ``results`` has
    conv_id, turn, call_id and content; ``messages``, which are neither, have conv_id, turn, role and content.
    """
    # A parsed variant keeps an object's members in the order of their names, at every depth.
    sorted_arguments = F.coalesce(F.to_json(F.try_parse_json(F.coalesce("arguments", F.lit("{}")))), json_text(F.col("arguments")))
    body = canonical_json(arguments=sorted_arguments, id=json_text(F.col("call_id")), name=json_text(F.col("name")))
    made = calls.select("conv_id", "turn", "call_id", "name", "arguments", "after", body.alias("json"))
    made = made.withColumn("errors", argument_errors(F.col("name"), F.col("arguments"), tools))
    made = scratch.table(made, "calls")
    answers = results.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("answers"))
    first = made.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "json", "after")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = scratch.table(first.select("conv_id", "call_id", F.col("first.turn").alias("first_turn"), F.col("first.json").alias("first_json"), F.col("first.after").alias("after"), "n"), "first")
    place = places(first.select("conv_id", "call_id", F.col("first_turn").alias("turn"), "after"), scratch)
    keys = ["conv_id", "call_id"]
    known = first.drop("after").join(place, keys, "left").join(answers, keys, "left").withColumn("weight", F.greatest(F.col("n"), F.coalesce("answers", F.lit(0))))
    known = known.select(F.struct("conv_id", "call_id").alias("key"), "first_turn", "first_json", "due", "level", F.coalesce("answers", F.lit(0)).alias("answers"), "weight")
    known = scratch.table(known, "known")
    key = F.when(F.col("call_id").isNotNull() & F.col("conv_id").isNotNull(), F.struct("conv_id", "call_id"))
    place_of = [F.coalesce("due", "first_turn", "turn").alias("due"), F.coalesce("level", F.lit(0)).cast("long").alias("level")]
    asked = look_up(made.withColumn("key", key), known, "key", "weight", made.count())
    own = F.coalesce((F.col("turn") == F.col("first_turn")) & (F.col("json") == F.col("first_json")), F.lit(False))
    status = F.when(F.col("call_id").isNull() | F.col("conv_id").isNull(), "unanswered").when(~own, "repeated").when(F.col("answers") > 0, "linked").otherwise("unanswered")
    asked = asked.select("conv_id", "turn", F.lit("call").alias("kind"), "call_id", status.alias("status"), "errors", *place_of, "json")
    reply = canonical_json(content=json_text(F.col("content")), id=json_text(F.col("call_id")))
    told = look_up(results.select("conv_id", "turn", "call_id", "content").withColumn("key", key), known, "key", "weight", results.count())
    told = told.select(
        "conv_id", "turn", F.lit("result").alias("kind"), "call_id", F.when(F.col("first_turn").isNull(), "orphan").otherwise("linked").alias("status"),
        F.array().cast("array<string>").alias("errors"), *place_of, reply.alias("json"),
    )
    if messages is None:
        return asked.unionByName(told)
    plain = canonical_json(content=json_text(F.col("content")), role=json_text(F.col("role")))
    said = messages.select(
        "conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit("plain").alias("status"),
        F.array().cast("array<string>").alias("errors"), F.col("turn").alias("due"), F.lit(0).cast("long").alias("level"), plain.alias("json"),
    )
    return asked.unionByName(told).unionByName(said)
