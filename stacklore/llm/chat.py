"""Tool calls and their results in conversations, in DataFrame functions only.

Calls and results are hash-joined by (conversation, call id). A call may name an
earlier one that it waits for; its level is the number of calls before it in that
chain, found by doubling the distance that each call looks back, so a chain of n
calls takes about log n joins. Arguments are checked against a table of parameters
(name, type, required), and each linked call is written as canonical JSON: no
blanks, keys in order at every depth.

Output is one row for each call id, never a whole conversation in one row, so a
conversation of any length is spread over tasks. (conv_id, level, turn, call_id)
is a topological order.

A call id that stands several times in a conversation counts once, with the least
turn (ties: least arguments), and n_copies tells how many there were. A call
without result and a result without call keep their rows with status ``no_result``
and ``no_call``; a call that waits for an unknown one starts a chain; calls in a
circle have a null level and status ``cycle``. Arguments that are no JSON object
have the error ``not_an_object``. Rows without conversation or call id are left out.
Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacklore.llm.base import forget, keep

KEYS = ["conv_id", "call_id"]


def _once(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """One row for each call id, with n_copies."""
    rest = [c for c in rows.columns if c not in KEYS]
    first = F.min(F.struct(*order, *(c for c in rest if c not in order)))
    known = rows.where("conv_id IS NOT NULL AND call_id IS NOT NULL")
    return known.groupBy(*KEYS).agg(first.alias("r"), F.count(F.lit(1)).alias("n_copies")).select(*KEYS, *(F.col(f"r.{c}").alias(c) for c in rest), "n_copies")


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level of each call (conv_id, call_id, after)."""
    there = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("there"))
    look = calls.select(*KEYS, "after").join(there, ["conv_id", "after"], "left").select(
        *KEYS, F.when(F.col("there"), F.col("after")).alias("back"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("level")
    )
    look = keep(look, "levels")
    rounds = max(look.count(), 1).bit_length() + 1
    for _ in range(rounds):
        if not look.where("back IS NOT NULL").limit(1).count():
            break
        ahead = look.select("conv_id", F.col("call_id").alias("back"), F.col("back").alias("further"), F.col("level").alias("more"))
        was = look
        look = keep(
            look.join(ahead, ["conv_id", "back"], "left").select(*KEYS, F.col("further").alias("back"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")),
            "levels",
        )
        forget(was)
    return look.select(*KEYS, F.when(F.col("back").isNull(), F.col("level")).alias("level"))


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, call_id, errors (sorted array) of the calls (name, arguments) that break
    the schema (name, param, type, required); ``type`` is string, number, boolean, array or object."""
    parsed = calls.select(*KEYS, "name", F.expr("try_parse_json(arguments)").alias("v"))
    parsed = parsed.withColumn("kind", F.schema_of_variant("v"))
    whole = parsed.where("kind IS NULL OR kind NOT LIKE 'OBJECT%'").select(*KEYS, F.lit("not_an_object").alias("error"))
    objects = parsed.where("kind LIKE 'OBJECT%'")
    given = objects.select(*KEYS, "name", F.explode(F.expr("variant_get(v, '$', 'map<string,variant>')")).alias("param", "value")).select(
        *KEYS, "name", "param", _json_type(F.schema_of_variant("value")).alias("is_a")
    )
    rules = schemas.select("name", "param", "type", "required").dropDuplicates(["name", "param"])
    checked = given.join(rules, ["name", "param"], "left")
    bad = checked.where("type IS NULL OR (is_a <> type)").select(
        *KEYS, F.concat(F.when(F.col("type").isNull(), "unknown:").otherwise("type:"), "param").alias("error")
    )
    wanted = objects.select(*KEYS, "name").join(rules.where("required").select("name", "param"), "name")
    missing = wanted.join(given.where("is_a <> 'null'").select(*KEYS, "param"), [*KEYS, "param"], "left_anti").select(*KEYS, F.concat(F.lit("missing:"), "param").alias("error"))
    return whole.unionByName(bad).unionByName(missing).groupBy(*KEYS).agg(F.array_sort(F.collect_set("error")).alias("errors"))


def _json_type(kind: Column) -> Column:
    return (
        F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), "number")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .otherwise("null")
    )


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, call_id, level, turn, name, status, valid, errors, n_copies, json.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON), after (a call id or
    null). ``results``: conv_id, call_id, turn, content. Other columns are ignored.
    """
    calls = keep(_once(calls.select(*KEYS, "turn", "name", "arguments", "after"), ("turn", "arguments")), "calls")
    results = _once(results.select(*KEYS, F.col("turn").alias("result_turn"), "content"), ("result_turn", "content")).drop("n_copies")
    linked = calls.hint("shuffle_hash").join(results.withColumn("answered", F.lit(True)), KEYS, "full")
    linked = linked.join(levels(calls), KEYS, "left").join(argument_errors(calls, schemas), KEYS, "left")
    errors = F.coalesce("errors", F.array().cast("array<string>"))
    status = (
        F.when(F.col("n_copies").isNull(), "no_call").when(F.col("level").isNull(), "cycle").when(F.col("answered").isNull(), "no_result").otherwise("ok")
    )
    text = lambda c: F.coalesce(F.to_json(F.col(c)), F.lit("null")) if c == "v" else F.coalesce(_quoted(c), F.lit("null"))
    body = linked.withColumn("v", F.expr("try_parse_json(arguments)"))
    json = F.concat(
        F.lit('{"arguments":'), text("v"), F.lit(',"call_id":'), text("call_id"), F.lit(',"content":'), text("content"), F.lit(',"name":'), text("name"), F.lit("}")
    )
    return body.select(
        *KEYS, "level", F.coalesce("turn", "result_turn").alias("turn"), "name", status.alias("status"),
        (F.col("n_copies").isNotNull() & (F.size(errors) == 0)).alias("valid"), F.array_join(errors, ",").alias("errors"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"), json.alias("json"),
    )


def _quoted(column: str) -> Column:
    """A string as JSON, null where it is null."""
    whole = F.to_json(F.array(F.col(column)))
    return F.when(F.col(column).isNotNull(), F.substring(whole, F.lit(2), F.length(whole) - 2))


def calls_of_turns(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversation turns (conv_id, turn, role, text) as calls, results and a schema.

    A user's turn calls a tool with its text; the assistant's next turn is the result
    by the identifier of the turn before it; a call waits for the user's last one.
    Turns of other roles are neither.
    """
    name = F.element_at(F.array(*map(F.lit, ("search", "summarise", "translate"))), (F.pmod(F.length("text"), F.lit(3)) + 1).cast("int"))
    ident = lambda turn: F.concat(F.lit("call_"), F.substring(F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))), 1, 12))
    words = F.size(F.split("text", " "))
    asked = F.when(words > 60, F.concat(F.lit('"'), words.cast("string"), F.lit('"'))).otherwise(words.cast("string"))
    extra = F.when(words % 5 == 0, F.lit(',"verbose":true')).otherwise("")
    arguments = F.concat(F.lit('{"text": '), _quoted("text"), F.lit(', "limit": '), asked, extra, F.lit("}"))
    calls = messages.where("role = 'user' AND text IS NOT NULL").select(
        "conv_id", ident(F.col("turn")).alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"), F.when(F.col("turn") >= 2, ident(F.col("turn") - 2)).alias("after")
    )
    results = messages.where("role = 'assistant'").select("conv_id", ident(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    rows = [(n, p, t, r) for n in ("search", "summarise", "translate") for p, t, r in (("text", "string", True), ("limit", "number", True))]
    rows += [("search", "verbose", "boolean", False), ("translate", "target", "string", True)]
    return calls, results, messages.sparkSession.createDataFrame(rows, "name string, param string, type string, required boolean")


#: The query's rows as DuckDB SQL.
ORACLE_SQL = """
WITH RECURSIVE turns AS (SELECT *, CASE WHEN text IS NOT NULL THEN len(string_split(text, ' ')) END AS w FROM conversations),
raw_calls AS (
  SELECT conv_id, 'call_' || substr(md5(conv_id::VARCHAR || ':' || turn::VARCHAR), 1, 12) AS call_id, turn,
         ['search', 'summarise', 'translate'][length(text) % 3 + 1] AS name, text, w,
         CASE WHEN turn >= 2 THEN 'call_' || substr(md5(conv_id::VARCHAR || ':' || (turn - 2)::VARCHAR), 1, 12) END AS after
  FROM turns WHERE role = 'user' AND text IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL),
calls AS (SELECT * EXCLUDE (k) FROM (SELECT *, count(*) OVER (PARTITION BY conv_id, call_id) AS n_copies,
                 row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, to_json(text)::VARCHAR) AS k FROM raw_calls) WHERE k = 1),
results AS (
  SELECT * EXCLUDE (k) FROM (
    SELECT conv_id, 'call_' || substr(md5(conv_id::VARCHAR || ':' || (turn - 1)::VARCHAR), 1, 12) AS call_id, turn AS result_turn, text AS content,
           row_number() OVER (PARTITION BY conv_id, turn ORDER BY text NULLS FIRST) AS k
    FROM turns WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL) WHERE k = 1),
lv AS (
  SELECT conv_id, call_id, 0 AS level FROM calls c WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.call_id = c.after)
  UNION ALL
  SELECT c.conv_id, c.call_id, lv.level + 1 FROM lv JOIN calls c ON c.conv_id = lv.conv_id AND c.after = lv.call_id),
errs AS (
  SELECT conv_id, call_id, array_to_string(list_sort(list_filter([
           CASE WHEN name = 'translate' THEN 'missing:target' END, CASE WHEN w > 60 THEN 'type:limit' END,
           CASE WHEN w % 5 = 0 AND name <> 'search' THEN 'unknown:verbose' END], lambda x: x IS NOT NULL)), ',') AS errors FROM calls)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, lv.level AS level,
       coalesce(c.turn, r.result_turn) AS turn, c.name AS name,
       CASE WHEN c.call_id IS NULL THEN 'no_call' WHEN r.call_id IS NULL THEN 'no_result' ELSE 'ok' END AS status,
       c.call_id IS NOT NULL AND e.errors = '' AS valid, coalesce(e.errors, '') AS errors, coalesce(c.n_copies, 0) AS n_copies,
       '{"arguments":' || CASE WHEN c.call_id IS NULL THEN 'null' ELSE '{"limit":' || CASE WHEN w > 60 THEN '"' || w || '"' ELSE w::VARCHAR END
         || ',"text":' || to_json(c.text)::VARCHAR || CASE WHEN w % 5 = 0 THEN ',"verbose":true' ELSE '' END || '}' END
         || ',"call_id":"' || coalesce(c.call_id, r.call_id) || '","content":' || coalesce(to_json(r.content)::VARCHAR, 'null')
         || ',"name":' || coalesce('"' || c.name || '"', 'null') || '}' AS json
FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
LEFT JOIN lv ON lv.conv_id = c.conv_id AND lv.call_id = c.call_id
LEFT JOIN errs e ON e.conv_id = c.conv_id AND e.call_id = c.call_id
"""
