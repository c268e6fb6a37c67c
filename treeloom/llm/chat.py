"""Chat formatting: linking tool calls with their results (operator 10, DataFrame functions only).

Calls and results meet in a hash join on (conversation, call identifier). Calls
that name earlier calls in their arguments' ``after`` list are put in topological
order by levels: a call's level is one more than the greatest level of the calls
it follows; each round settles the calls whose predecessors are settled, and what
no round can settle is in or behind a cycle. Arguments are parsed once as VARIANT
and validated against the tool's schema, one row per declared parameter.
Messages are serialised as canonical JSON: keys sorted, no blanks.

No conversation is collected: the output has one row per message, ordered by
(conv_id, turn, part, level, call_id). A conversation with a third of all rows
is spread by its call identifiers.

Defined cases: arguments that are null, not JSON or not an object are invalid;
so are missing required, undeclared and wrongly typed parameters and values
outside an enumeration (``errors`` names each, sorted). Of several results of a
call the first turn counts, of several calls of one identifier the first turn,
the others get the status 'repeated'; results without a call have the status
'orphan'. A null identifier links with nothing; rows with a null conv_id are one
more conversation. A predecessor that does not exist
is an error and does not hold a call back. Null texts are JSON null. Extra columns
are ignored, empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, written

# JSON type of a schema -> beginnings of VARIANT type names that satisfy it.
TYPES = {
    "string": ("STRING",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"),
    "boolean": ("BOOLEAN",),
    "array": ("ARRAY",),
    "object": ("OBJECT",),
}


def quoted(text: Column) -> Column:
    """A JSON string (or null) of a text column."""
    body = F.to_json(F.array(text))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substr(body, F.lit(2), F.length(body) - 2))


def canonical(json: Column) -> Column:
    """Canonical text of a JSON text: objects' keys sorted, no blanks; null if it is not JSON."""
    return F.to_json(F.try_parse_json(json))


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """``(conv_id, call_id, level)`` of calls given ``needs(conv_id, call_id, before)``; level -1 in or behind a cycle."""
    edges = written(
        needs.join(calls.select("conv_id", F.col("call_id").alias("before")), ["conv_id", "before"], "left_semi").distinct(),
        "needs",
    )
    waiting = edges.select("conv_id", "call_id").distinct()
    settled = written(
        calls.join(waiting, ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.lit(0).alias("level")), "level"
    )
    parts = [settled]
    while not edges.isEmpty():
        done = settled.select("conv_id", F.col("call_id").alias("before"), F.lit(True).alias("done"))
        # an edge whose predecessor was settled this round goes; a call without edges left is settled next
        rest = written(edges.join(done, ["conv_id", "before"], "left_anti"), "needs")
        freed = edges.select("conv_id", "call_id").distinct().join(
            rest.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti"
        )
        settled = written(freed.select("conv_id", "call_id", F.lit(len(parts)).alias("level")), "level")
        if settled.isEmpty():
            break
        parts.append(settled)
        edges = rest
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return calls.select("conv_id", "call_id").join(out, ["conv_id", "call_id"], "left").withColumn(
        "level", F.coalesce("level", F.lit(-1))
    )


def validate(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``(conv_id, call_id, arguments, errors)``: canonical arguments and the sorted errors of each call.

    ``schemas(name, param, type, required, allowed)`` lists declared parameters
    (``allowed``: array of JSON texts or null). There is one row per call and declared
    or given parameter, joined on the tool's name; schemas are few and broadcast
    when their rows are at most ``MAX_SCHEMA_ROWS``.
    """
    parsed = calls.withColumn("v", F.try_parse_json("arguments"))
    kind = F.schema_of_variant("v")
    parsed = parsed.withColumn("is_object", F.coalesce(kind.startswith("OBJECT"), F.lit(False)))
    given = parsed.withColumn(
        "given", F.when(F.col("is_object"), F.coalesce(F.json_object_keys("arguments"), F.array())).otherwise(F.array())
    )
    declared = schemas.groupBy("name").agg(
        F.array_sort(F.collect_list(F.struct("param", "type", "required", "allowed"))).alias("declared")
    )
    declared = F.broadcast(declared) if schemas.limit(MAX_SCHEMA_ROWS + 1).count() <= MAX_SCHEMA_ROWS else declared
    both = given.join(declared, "name", "left")
    values = F.from_json(F.col("canonical"), "map<string,variant>")
    both = both.withColumn("canonical", F.to_json("v")).withColumn("values", F.when(F.col("is_object"), values))

    def check(d: Column) -> Column:
        present = F.array_contains("given", d["param"])
        found = F.schema_of_variant(F.element_at(F.col("values"), d["param"]))
        fits = F.lit(False)
        for name, starts in TYPES.items():
            good = F.lit(False)
            for s in starts:
                good = good | found.startswith(s)
            fits = fits | ((d["type"] == name) & good)
        listed = d["allowed"].isNull() | F.array_contains(d["allowed"], F.to_json(F.element_at(F.col("values"), d["param"])))
        return (
            F.when(~present & d["required"], F.concat(F.lit("missing:"), d["param"]))
            .when(present & ~F.coalesce(fits, F.lit(False)), F.concat(F.lit("type:"), d["param"]))
            .when(present & ~F.coalesce(listed, F.lit(False)), F.concat(F.lit("value:"), d["param"]))
        )

    names = F.transform(F.col("declared"), lambda d: d["param"])
    errors = F.concat(
        F.when(~F.col("is_object"), F.array(F.lit("arguments"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("declared").isNull(), F.array(F.lit("tool"))).otherwise(
            F.when(
                F.col("is_object"),
                F.concat(
                    F.filter(F.transform("declared", check), lambda e: e.isNotNull()),
                    F.transform(F.array_except("given", names), lambda p: F.concat(F.lit("undeclared:"), p)),
                ),
            ).otherwise(F.array().cast("array<string>"))
        ),
    )
    return both.select("conv_id", "call_id", F.col("canonical").alias("arguments"), F.array_sort(errors).alias("errors"))


MAX_SCHEMA_ROWS = 10_000
NO_CONVERSATION = "0"


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with conv_id as a text that is never null, so that rows without one meet in joins too."""
    return rows.withColumn("conv_id", F.coalesce(F.concat(F.lit("1"), F.col("conv_id").cast("string")), F.lit(NO_CONVERSATION)))


def _first(rows: DataFrame, values: list[str]) -> DataFrame:
    """The first turn's row of each (conv_id, call_id)."""
    best = F.min(F.struct("turn", *[F.col(v) for v in values])).alias("b")
    return rows.where(F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(best).select(
        "conv_id", "call_id", "b.*"
    )


def format_chats(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """``(conv_id, turn, part, level, call_id, status, json)``, one row per message, call and result.

    ``messages(conv_id, turn, role, text)``, ``calls(conv_id, turn, call_id, name,
    arguments)``, ``results(conv_id, turn, call_id, content)``. Within a turn the
    message comes first (part 0), then calls (1) and results (2). A call's status
    is ok, invalid, unanswered, cycle or repeated; a result's ok, orphan or
    repeated. ``json`` is the canonical JSON of the row.
    """
    prepare(messages.sparkSession)
    kind = messages.schema["conv_id"].dataType
    messages, calls, results = (_keyed(rows) for rows in (messages, calls, results))
    calls = written(calls.select("conv_id", "turn", "call_id", "name", "arguments"), "calls")
    results = written(results.select("conv_id", "turn", "call_id", "content"), "results")
    first = written(_first(calls, ["name", "arguments"]), "first_calls")
    answers = _first(results, ["content"]).select("conv_id", "call_id", F.col("turn").alias("answer_turn"))
    after = F.from_json("arguments", "struct<after:array<string>>")["after"]
    needs = first.select("conv_id", "call_id", F.explode(F.array_distinct(after)).alias("before")).where("before is not null")
    known = first.select("conv_id", F.col("call_id").alias("before"), F.lit(True).alias("known"))
    unknown = (
        needs.join(known, ["conv_id", "before"], "left_anti")
        .groupBy("conv_id", "call_id")
        .agg(F.array_sort(F.collect_set(F.concat(F.lit("after:"), "before"))).alias("unknown"))
    )
    facts = (
        validate(first, schemas)
        .join(levels(first, needs), ["conv_id", "call_id"])
        .join(unknown, ["conv_id", "call_id"], "left")
        .join(answers, ["conv_id", "call_id"], "left")
        .join(first.select("conv_id", "call_id", F.col("turn").alias("call_turn")), ["conv_id", "call_id"])
        .withColumn("errors", F.array_sort(F.concat("errors", F.coalesce("unknown", F.array()))))
    )
    facts = written(facts.drop("unknown"), "facts")

    call_rows = calls.select("conv_id", "turn", "call_id", "name").join(
        facts.select("conv_id", "call_id", "arguments", "errors", "level", "answer_turn", "call_turn"),
        ["conv_id", "call_id"],
        "left",
    )
    status = (
        F.when(F.col("call_id").isNull(), "invalid")
        .when(F.col("turn") != F.col("call_turn"), "repeated")
        .when(F.col("level") < 0, "cycle")
        .when(F.size("errors") > 0, "invalid")
        .when(F.col("answer_turn").isNull(), "unanswered")
        .otherwise("ok")
    )
    call_json = F.concat(
        F.lit('{"arguments":'), F.coalesce("arguments", F.lit("null")),
        F.lit(',"errors":'), F.coalesce(F.to_json("errors"), F.lit("[]")),
        F.lit(',"id":'), quoted(F.col("call_id")),
        F.lit(',"level":'), F.coalesce(F.col("level").cast("string"), F.lit("null")),
        F.lit(',"name":'), quoted(F.col("name")),
        F.lit(',"type":"call"}'),
    )
    shaped = call_rows.select(
        "conv_id", "turn", F.lit(1).alias("part"), F.coalesce("level", F.lit(-1)).alias("level"), "call_id",
        status.alias("status"), call_json.alias("json"),
    )

    result_rows = results.join(
        facts.select("conv_id", "call_id", "level", "answer_turn", F.lit(True).alias("has_call")),
        ["conv_id", "call_id"],
        "left",
    )
    result_status = (
        F.when(F.col("has_call").isNull(), "orphan").when(F.col("turn") != F.col("answer_turn"), "repeated").otherwise("ok")
    )
    result_json = F.concat(
        F.lit('{"content":'), quoted(F.col("content")), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"type":"result"}')
    )
    answered = result_rows.select(
        "conv_id", "turn", F.lit(2).alias("part"), F.coalesce("level", F.lit(-1)).alias("level"), "call_id",
        result_status.alias("status"), result_json.alias("json"),
    )

    message_json = F.concat(
        F.lit('{"content":'), quoted(F.col("text")), F.lit(',"role":'), quoted(F.col("role")), F.lit(',"type":"message"}')
    )
    said = messages.select(
        "conv_id", "turn", F.lit(0).alias("part"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("call_id"),
        F.lit("ok").alias("status"), message_json.alias("json"),
    )
    own = F.when(F.col("conv_id") != NO_CONVERSATION, F.expr("substring(conv_id, 2)")).cast(kind)
    return said.unionByName(shaped).unionByName(answered).withColumn("conv_id", own)
