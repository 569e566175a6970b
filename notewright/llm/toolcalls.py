"""Tool-call linking: calls and results joined by identifier, ordered by dependence, validated, as canonical JSON.

All of it is DataFrame functions. Calls: conv_id, call_id, name, arguments (JSON), depends_on (array of call_ids
of the same conversation). Results: conv_id, call_id, output. Schemas: name, field, type, required.

* Link: a full outer join on (conv_id, call_id); the status is linked, pending (no result) or orphan (no call).
* Order: the level of a call is the longest chain of calls that it depends on; ascending levels are a topological
  order. Where no call has more than one dependence, pointers are doubled: the rounds grow with the logarithm of the
  longest chain. Otherwise calls are released level by level. A call on or behind a cycle has no level.
* Validate: missing and unknown fields and wrong types, from the parsed arguments.
* Canonical: keys sorted on every level, no white space, by way of the variant type.

Repeated calls or results of one identifier count once: the smallest name and arguments, the smallest output. Rows
without conv_id or call_id are left out. Dependences on calls that are not there are ignored and counted. Null or
malformed arguments are invalid ("not an object"). An unknown tool is invalid. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.shared import cut

ID = ["conv_id", "call_id"]


def _doubled(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) where each call has one dependence at most: up is `level` steps above."""
    state = cut(edges.select(*ID, F.col("needs").alias("up"), F.when(F.col("needs").isNull(), 0).otherwise(1).cast("long").alias("level")), "levels")
    calls, done, going = state.count(), state.where("up is null"), state.where("up is not null")
    for _ in range(max(1, calls).bit_length() + 1):
        if going.isEmpty():
            break
        # Finished calls are only looked up, by their unique identifier: their empty pointers are not joined.
        above = done.unionByName(going).select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("level").alias("more"))
        state = cut(going.join(above.hint("merge"), ["conv_id", "up"]).select(*ID, F.col("up2").alias("up"), (F.col("level") + F.col("more")).alias("level")), "levels")
        done, going = done.unionByName(state.where("up is null")), state.where("up is not null")
    state = done.unionByName(going)
    return state.select(*ID, F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def _released(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) level by level: a call is released when all it depends on is."""
    waiting = cut(edges.where("needs is not null"), "waiting")
    free = cut(calls.join(waiting.select(*ID).distinct(), ID, "left_anti").withColumn("level", F.lit(0).cast("long")), "released")
    out, level = free, 0
    while not waiting.isEmpty() and not free.isEmpty():
        level += 1
        last = free.select("conv_id", F.col("call_id").alias("needs"))
        left = cut(waiting.join(last, ["conv_id", "needs"], "left_anti").select(*ID, "needs"), "waiting")
        done = waiting.select(*ID).distinct().join(left.select(*ID).distinct(), ID, "left_anti")
        free = cut(done.withColumn("level", F.lit(level).cast("long")), "released")
        out, waiting = out.unionByName(free), left
    return out.unionByName(waiting.select(*ID).distinct().withColumn("level", F.lit(None).cast("long")))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, n_missing) of calls with unique (conv_id, call_id) and depends_on."""
    asked = calls.select(*ID, F.explode(F.array_distinct("depends_on")).alias("needs")).where("needs is not null")
    there = calls.select("conv_id", F.col("call_id").alias("needs"), F.lit(True).alias("there"))
    asked = cut(asked.join(there, ["conv_id", "needs"], "left"), "dependences")
    missing = asked.where("there is null").groupBy(*ID).agg(F.count("*").alias("n_missing"))
    edges = asked.where("there").select(*ID, "needs")
    if edges.groupBy(*ID).count().where("count > 1").isEmpty():
        found = _doubled(calls.select(*ID).join(edges, ID, "left"))
    else:
        found = _released(calls.select(*ID), edges)
    return found.join(missing, ID, "left").select(*ID, "level", F.coalesce("n_missing", F.lit(0)).cast("long").alias("n_missing"))


def _problems() -> F.Column:
    """Problems of `parsed` under `fields` (name to (type, required)), sorted and joined by commas."""
    kind = "case when value is null then 'absent' when value like 'DECIMAL%' then 'DOUBLE' when value like 'ARRAY%' then 'ARRAY' when value like 'OBJECT%' then 'OBJECT' else value end"
    return F.expr(f"""
        case when fields is null then 'unknown tool'
        when parsed is null or given is null then 'not an object'
        else array_join(array_sort(concat(
            transform(filter(map_entries(fields), f -> f.value.required and given[f.key] is null), f -> concat('missing ', f.key)),
            transform(filter(map_keys(given), k -> fields[k] is null), k -> concat('unknown ', k)),
            transform(filter(map_entries(fields), f -> given[f.key] is not null and transform(array(given[f.key]), value -> {kind})[0] <> f.value.type), f -> concat('type ', f.key)))), ',')
        end""")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each identifier: conv_id, call_id, status, name, level, n_missing, valid, problems, output, canonical. An orphan is not valid."""
    calls = calls.where("conv_id is not null and call_id is not null").groupBy(*ID).agg(F.min(F.struct("name", "arguments", "depends_on")).alias("c")).select(*ID, "c.*")
    calls = cut(calls, "calls")
    results = results.where("conv_id is not null and call_id is not null").groupBy(*ID).agg(F.min("output").alias("output"), F.lit(True).alias("answered"))
    tools = schemas.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("type", "required")))).alias("fields"))  # a row for each tool
    checked = calls.join(tools, "name", "left").withColumn("parsed", F.expr("try_parse_json(arguments)"))
    checked = checked.withColumn("given", F.expr("transform_values(try_variant_get(parsed, '$', 'map<string, variant>'), (k, v) -> schema_of_variant(v))"))
    checked = checked.select(*ID, "name", _problems().alias("problems"), F.to_json("parsed").alias("arguments"))
    joined = checked.join(levels(calls), ID).join(results, ID, "full_outer")
    status = F.when(F.col("problems").isNull(), "orphan").when(F.col("answered").isNull(), "pending").otherwise("linked")
    canonical = F.expr("concat('{\"arguments\":', coalesce(arguments, 'null'), ',\"name\":', coalesce(to_json(to_variant_object(array(name))), '[null]'), ',\"output\":', to_json(to_variant_object(array(output))), '}')")
    return joined.select(*ID, status.alias("status"), "name", "level", "n_missing", F.coalesce(F.col("problems") == "", F.lit(False)).alias("valid"), "problems", "output", canonical.alias("canonical"))


#: The tools that the roles of a plain conversation stand for.
CHAT_TOOLS = [("chat.reply", "text", "STRING", True), ("chat.reply", "turn", "BIGINT", True), ("chat.configure", "text", "STRING", True), ("chat.configure", "turn", "BIGINT", True)]


def calls_of_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas of plain conversations (conv_id, turn, role, text).

    A user turn calls chat.reply and a system turn chat.configure, with its text and number as arguments, under the
    turn's number as identifier; it depends on the call two turns before. An assistant turn is the result of the call
    one turn before. Turns of other roles, or without a role, conversation or number, are neither."""
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    name = F.when(F.col("role") == "user", "chat.reply").when(F.col("role") == "system", "chat.configure")
    calls = turns.select("conv_id", F.col("turn").alias("call_id"), name.alias("name"), F.to_json(F.struct("turn", "text")).alias("arguments"), F.array(F.col("turn") - 2).alias("depends_on")).where("name is not null")
    results = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("call_id"), F.col("text").alias("output"))
    return calls, results, turns.sparkSession.createDataFrame(CHAT_TOOLS, "name string, field string, type string, required boolean")
