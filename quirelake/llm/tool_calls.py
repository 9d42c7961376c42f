"""Chat formatting: tool calls linked to their results, with DataFrame operations only.

Calls and results meet in a hash join by (conversation, identifier). Calls are ordered so that
each follows those it depends on; arguments are validated against the tool's schema; every linked
call becomes one canonical JSON line (keys sorted at every level, no blanks). A conversation is
never gathered in one task: the order is given by columns (conv_id, level, turn, pos).

Defined cases, by ``status``: ``unanswered`` (no result), ``orphan`` (a result without call),
``unknown_tool``, ``bad_json`` (arguments null or no JSON object), ``bad_arguments`` (a required
argument absent or null, one of another type, or one the schema doesn't name), ``bad_dependency``
(a dependency that no call of the conversation has), ``cycle``, else ``ok``; the first that holds
in the order orphan, bad_json, unknown_tool, bad_arguments, bad_dependency, cycle, unanswered.
Where an identifier repeats within a conversation the first call by (turn, pos) and the first
result by turn count and the others are dropped as repeats. A call or a result with a null
identifier is a row of its own and links with nothing. Null conversation ids are one conversation.
``level`` is the longest path of dependencies that ends at the call, 0 without any; null in or
behind a cycle and for orphans. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.common import materialize, release, table

CALLS = "conv_id bigint, turn bigint, pos int, call_id string, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id bigint, turn bigint, call_id string, content string"
#: How a JSON value's type is named by schema_of_variant.
TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "number": "BIGINT|DOUBLE|DECIMAL.*|FLOAT", "array": "ARRAY<.*", "object": "OBJECT<.*"}


def parse_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of (conv_id, turn, role, text) whose texts hold JSON.

    Assistant texts ``{"tool_calls": [{"id", "name", "arguments", "depends_on"}]}``; tool texts
    ``{"tool_call_id", "content"}``. Other messages give nothing.
    """
    body = "tool_calls array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>"
    calls = (
        messages.where(F.col("role") == "assistant").withColumn("_j", F.from_json("text", body))
        .select("conv_id", "turn", F.posexplode("_j.tool_calls").alias("pos", "c"))
        .select("conv_id", "turn", "pos", F.col("c.id").alias("call_id"), "c.name", "c.arguments", "c.depends_on")
    )
    results = (
        messages.where(F.col("role") == "tool").withColumn("_j", F.from_json("text", "tool_call_id string, content string"))
        .where("_j.tool_call_id is not null").select("conv_id", "turn", F.col("_j.tool_call_id").alias("call_id"), "_j.content")
    )
    return calls, results


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain chats as calls: a user's turn calls ``reply``, the next turn, if the assistant's, is its result, and it depends on the call two turns before, if there is one. Turns of other roles give nothing."""
    user = messages.where(F.col("role") == "user")
    ident = lambda turn: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")), turn)
    calls = user.select(
        "conv_id", "turn", F.lit(0).alias("pos"), ident(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"),
        F.to_json(F.struct("turn", "text")).alias("arguments"), F.array(ident(F.col("turn") - 2)).alias("_before"),
    )
    earlier = user.select(F.col("conv_id").alias("_conv"), (F.col("turn") + 2).alias("_turn")).distinct()
    calls = calls.join(earlier, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("turn") == F.col("_turn")), "left").select(
        "conv_id", "turn", "pos", "call_id", "name", "arguments", F.when(F.col("_turn").isNull(), F.array().cast("array<string>")).otherwise(F.col("_before")).alias("depends_on")
    )
    results = messages.where(F.col("role") == "assistant").select("conv_id", "turn", ident(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def _argument_errors(schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Whether the variant ``_v`` breaks the schema of ``name``."""
    broken = F.lit(False)
    for tool, fields in schemas.items():
        bad = F.size(F.array_except(F.json_object_keys(F.to_json("_v")), F.array(*[F.lit(f) for f in fields]))) > 0
        for field, (kind, required) in fields.items():
            found = F.schema_of_variant(F.variant_get("_v", f"$['{field}']", "variant"))
            absent = found.isNull() | (found == "VOID")
            bad = bad | (absent if required else F.lit(False)) | (~absent & ~F.coalesce(found, F.lit("VOID")).rlike(f"^({TYPES[kind]})$"))
        broken = F.when(F.col("name") == tool, bad).otherwise(broken)
    return broken


def call_levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(call, level): the longest path of ``edges`` (call, needs) from each call; null in or behind a cycle.

    Walks are doubled: from the pairs that 2**k steps join, and each call's longest walk of fewer
    steps, follow both for k + 1. So rounds grow with the logarithm of the longest path. A walk of as
    many steps as there are calls with dependencies runs in a cycle.
    """
    walks = materialize(edges.distinct(), "walks")
    levels = calls.select("call", F.lit(0).alias("level"))
    longest, steps = walks.select("call").distinct().count(), 1
    held: list[DataFrame] = []
    while steps <= longest and not walks.isEmpty():
        onward = walks.join(levels.withColumnsRenamed({"call": "needs", "level": "_on"}), "needs").groupBy("call").agg((F.max("_on") + steps).alias("_on"))
        levels = materialize(levels.join(onward, "call", "left").select("call", F.greatest("level", "_on").alias("level")), "levels")
        twice = materialize(walks.join(walks.select(F.col("call").alias("needs"), F.col("needs").alias("_far")), "needs").select("call", F.col("_far").alias("needs")).distinct(), "walks")
        release(*held, walks)
        held, walks, steps = [levels], twice, 2 * steps
    endless = walks.select("call").distinct().withColumn("_endless", F.lit(True))
    return levels.join(endless, "call", "left").select("call", F.when(F.col("_endless").isNull(), F.col("level")).alias("level"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """(conv_id, level, turn, pos, call_id, name, status, json), one row for each call and each orphan result."""
    order = F.struct("turn", "pos")
    apart = F.when(F.col("call_id").isNull(), F.monotonically_increasing_id())  # no identifier, no repeat
    calls = calls.withColumn("_apart", apart).groupBy("conv_id", "call_id", "_apart")
    calls = calls.agg(F.min_by(F.struct("turn", "pos", "name", "arguments", "depends_on"), order).alias("c")).select("conv_id", "call_id", "c.*")
    calls = materialize(calls.withColumn("call", F.monotonically_increasing_id()), "calls")
    results = results.withColumn("_apart", apart).groupBy("conv_id", "call_id", "_apart").agg(F.min_by(F.struct("content", "turn"), F.col("turn")).alias("r")).select(
        F.col("conv_id").alias("_rc"), F.col("call_id").alias("_ri"), "r.content", F.col("r.turn").alias("_rt"), F.lit(True).alias("_answer")
    )
    needs = calls.select("conv_id", "call", F.explode("depends_on").alias("dep"))
    found = calls.select(F.col("conv_id").alias("_nc"), F.col("call_id").alias("dep_id"), F.col("call").alias("needs"))
    met = needs.join(found, F.col("conv_id").eqNullSafe(F.col("_nc")) & (F.col("dep") == F.col("dep_id")), "left").select("call", "needs")
    met = materialize(met, "dependencies")
    levels = call_levels(calls, met.where("needs is not null"))
    lacking = met.where("needs is null").select("call").distinct().withColumn("_bad", F.lit(True))
    linked = calls.join(levels, "call", "left").join(lacking, "call", "left")
    same = F.col("conv_id").eqNullSafe(F.col("_rc")) & (F.col("call_id") == F.col("_ri"))
    linked = linked.join(results.hint("shuffle_hash"), same, "full")
    is_call = F.col("call").isNotNull()
    parsed = linked.withColumn("_v", F.try_parse_json("arguments"))
    shape = F.schema_of_variant("_v")
    status = (
        F.when(~is_call, "orphan")
        .when(F.col("_v").isNull() | ~F.coalesce(shape, F.lit("")).startswith("OBJECT"), "bad_json")
        .when(F.col("name").isNull() | ~F.col("name").isin(*schemas), "unknown_tool")
        .when(_argument_errors(schemas), "bad_arguments")
        .when(F.col("_bad"), "bad_dependency")
        .when(F.col("level").isNull(), "cycle")
        .when(F.col("_answer").isNull(), "unanswered")
        .otherwise("ok")
    )
    text = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2))
    line = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json("_v"), text("arguments")), F.lit(',"id":'), text("_id"),
        F.lit(',"name":'), text("name"), F.lit(',"result":'), text("content"), F.lit("}"),
    )
    return parsed.withColumn("_id", F.coalesce("call_id", "_ri")).select(
        F.coalesce("conv_id", "_rc").alias("conv_id"), "level", F.when(is_call, F.col("turn")).otherwise(F.col("_rt")).alias("turn"), F.coalesce("pos", F.lit(0)).alias("pos"),
        F.col("_id").alias("call_id"), "name", status.alias("status"), line.alias("json"),
    )


SCHEMAS = {"reply": {"text": ("string", True), "turn": ("integer", True)}}


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(*turns_as_calls(table(spark, sf_dir, "conversations")), SCHEMAS)


OP2_SQL = """
WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT * FROM conversations WHERE role = 'assistant'),
chains AS (SELECT conv_id, turn, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS chain FROM (SELECT DISTINCT conv_id, turn FROM u)),
levels AS (SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn % 2, chain ORDER BY turn) - 1)::INTEGER AS level FROM chains)
SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, levels.level, coalesce(u.turn, a.turn) AS turn, 0::INTEGER AS pos,
  coalesce(u.conv_id || ':' || u.turn, a.conv_id || ':' || (a.turn - 1)) AS call_id, CASE WHEN u.turn IS NOT NULL THEN 'reply' END AS name,
  CASE WHEN u.turn IS NULL THEN 'orphan' WHEN u.text IS NULL THEN 'bad_arguments' WHEN a.turn IS NULL THEN 'unanswered' ELSE 'ok' END AS status,
  '{"arguments":' || CASE WHEN u.turn IS NULL THEN 'null' ELSE '{' || CASE WHEN u.text IS NULL THEN '' ELSE '"text":' || to_json(u.text)::VARCHAR || ',' END || '"turn":' || u.turn || '}' END
  || ',"id":' || to_json(coalesce(u.conv_id || ':' || u.turn, a.conv_id || ':' || (a.turn - 1)))::VARCHAR
  || ',"name":' || CASE WHEN u.turn IS NULL THEN 'null' ELSE '"reply"' END || ',"result":' || coalesce(to_json(a.text)::VARCHAR, 'null') || '}' AS json
FROM u FULL JOIN a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 LEFT JOIN levels ON levels.conv_id = u.conv_id AND levels.turn = u.turn
"""

QUERIES = {"op2_tool_calls": op2_tool_calls}
SQL = {"op2_tool_calls": OP2_SQL}
