"""Chat formatting: tool calls linked to their results, ordered, validated, serialised.

Native: SQL expressions, joins and aggregates only. Calls and results meet in a hash join by
identifier, never by conversation, so a conversation of any length is no single task. The
order inside a conversation is a key (level, turn, id), computed from the call graph, not a
collected list; a reader sorts by it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.runtime import settle

# Turns of one number range of a conversation that are ordered in one window.
TURN_BLOCK = 1024

# Argument name -> (type, required), by tool. Types: string, integer, number, boolean.
SCHEMAS = {
    "reply": {"language": ("string", False), "prompt": ("string", True), "words": ("integer", True)},
    "brief": {"prompt": ("string", True), "words": ("integer", True)},
}
SHORT = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
ESCAPES = [("\\", "\\\\"), ('"', '\\"'), *((chr(c), e) for c, e in SHORT.items()),
           *((chr(c), f"\\u{c:04x}") for c in range(32) if c not in SHORT)]


def canonical(text) -> Column:
    """A JSON string literal of a text, with the fewest escapes; null gives ``null``.

    Backslash, quote and control characters are escaped; everything else stays as it is.
    """
    out = F.col(text) if isinstance(text, str) else text
    for plain, short in ESCAPES[:7]:
        out = F.replace(out, F.lit(plain), F.lit(short))
    rare = out
    for plain, short in ESCAPES[7:]:
        rare = F.replace(rare, F.lit(plain), F.lit(short))
    out = F.when(out.rlike(r"[\x00-\x1f]"), rare).otherwise(out)
    return F.coalesce(F.concat(F.lit('"'), out, F.lit('"')), F.lit("null"))


def canonical_map(arguments) -> Column:
    """A JSON object of a MAP<STRING, STRING> of JSON literals, keys in code point order."""
    pairs = F.array_sort(F.map_entries(arguments))
    body = F.array_join(F.transform(pairs, lambda e: F.concat(canonical(e["key"]), F.lit(":"), e["value"])), ",")
    return F.coalesce(F.concat(F.lit("{"), body, F.lit("}")), F.lit("null"))


def _fits(literal: Column, kind: str) -> Column:
    return {
        "string": literal.startswith('"'), "boolean": literal.isin("true", "false"),
        "integer": literal.rlike(r"^-?(0|[1-9][0-9]*)$"),
        "number": literal.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"),
    }[kind]


def schema_problem(name, arguments, schemas=SCHEMAS) -> Column:
    """Null for arguments that fit their tool's schema, else the first problem by name."""
    problem = F.lit("unknown tool")
    args = F.col(arguments)
    for tool, fields in schemas.items():
        found = [F.when(F.lit(required) & ~F.coalesce(F.map_contains_key(args, field), F.lit(False)),
                        F.lit(f"missing {field}"))
                 .when(~F.coalesce(_fits(args[field], kind), F.lit(True)), F.lit(f"type of {field}"))
                 for field, (kind, required) in sorted(fields.items())]
        extra = F.size(F.array_except(F.map_keys(args), F.array(*[F.lit(f) for f in fields]))) > 0
        found.append(F.when(F.coalesce(extra, F.lit(False)), F.lit("unknown field")))
        problem = F.when(F.col(name) == tool, F.coalesce(*found)).otherwise(problem)
    return problem


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level): 0 for calls that need no other, else one more than the deepest needed.

    ``calls`` has (call_id, needs), one row per dependency (null: none). Calls that need just one
    other form chains, which pointer doubling shortens to (head, distance) in logarithmically many
    rounds. What is left are calls that need several: each round tells those behind the calls
    settled last how many of their heads are done, so these rounds are as many as such calls
    follow each other, and a round writes only the calls still open. A call that needs an absent
    call or sits on a cycle, or behind one, gets level null.
    """
    ids = settle(calls.where(F.col("call_id").isNotNull()).select("call_id", "needs").distinct())
    # A null dependency beside others says nothing.
    needs = ids.where(F.col("needs").isNotNull())
    total = settle(ids.groupBy("call_id").agg(F.count("needs").alias("wanted")))
    done = total.where("wanted = 0").select("call_id", F.lit(0).cast("long").alias("level"))
    hops = settle(needs.join(total.where("wanted = 1"), "call_id", "left_semi").select(
        "call_id", F.col("needs").alias("head"), F.lit(1).cast("long").alias("d")))
    chain, span = hops.count(), 1
    while span <= chain:
        ahead = hops.select(F.col("call_id").alias("_at"), F.col("head").alias("_head"), F.col("d").alias("_d"))
        jumped = settle(hops.join(ahead, F.col("head") == F.col("_at"), "left").select(
            "call_id", F.coalesce("_head", "head").alias("head"), (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d"),
            F.col("_at").isNotNull().alias("moved")))
        hops, span = jumped.drop("moved"), 2 * span
        if jumped.where("moved").isEmpty():
            break
    # On a cycle the head stays a call of the chain, which is never settled.
    via = hops.select(F.col("call_id").alias("needs"), "head", "d")
    edges = settle(needs.join(total.where("wanted > 1"), "call_id").join(via, "needs", "left").select(
        "call_id", "wanted", F.coalesce("head", "needs").alias("head"), (F.coalesce("d", F.lit(0)) + 1).alias("d")))
    # Calls still open: heads they wait for, and the highest level a settled one gives them.
    waiting = edges.groupBy("call_id").agg(F.first("wanted").alias("left"), F.lit(-1).cast("long").alias("level"))
    parts, latest = [done], done
    while True:
        met = edges.join(latest.select(F.col("call_id").alias("head"), F.col("level").alias("_base")), "head").groupBy(
            "call_id").agg(F.count("*").alias("_met"), F.max(F.col("_base") + F.col("d")).alias("_level"))
        waiting = settle(waiting.join(met, "call_id", "left").select(
            "call_id", (F.col("left") - F.coalesce("_met", F.lit(0))).alias("left"),
            F.greatest("level", "_level").alias("level")))
        latest, waiting = waiting.where("left = 0").select("call_id", "level"), waiting.where("left > 0")
        if latest.isEmpty():
            break
        parts.append(latest)
    done = reduce(DataFrame.unionByName, parts)
    chained = hops.join(done.select(F.col("call_id").alias("head"), "level"), "head").select(
        "call_id", (F.col("level") + F.col("d")).alias("level"))
    return total.select("call_id").join(done.unionByName(chained), "call_id", "left")


def link_calls(messages: DataFrame, schemas=SCHEMAS) -> DataFrame:
    """One row per message, linked and serialised.

    ``messages`` has conv_id, turn, role, text, and for tools: call_id and name and arguments
    (MAP<STRING, STRING> of JSON literals) of a call, result_of (the call it answers), needs
    (ARRAY<STRING> of calls it builds on). Added: level, problem (of a call), status, json.

    A call is ``answered`` or ``open``; a result is ``linked``, or ``orphan`` when no call has
    its identifier; other messages are ``plain``. Where several results name one call, each is
    linked and the call counts once; a call identifier used twice links its results to both
    uses' shared identifier. Level: 2 * that of the call, and one more for its result, so a
    result sorts after its call; plain messages take the turn alone (level 0). Every input row
    gives one row; nulls in any column are allowed and written as null.
    """
    messages = messages.select("conv_id", "turn", "role", "text", "call_id", "name", "arguments", "result_of", "needs")
    calls = messages.where(F.col("call_id").isNotNull())
    edges = calls.select("call_id", F.explode_outer("needs").alias("needs"))
    depth = levels(edges).select(F.col("call_id").alias("_call"), "level")
    answered = messages.where(F.col("result_of").isNotNull()).select(
        F.col("result_of").alias("_answer")).distinct()
    known = depth.join(answered, F.col("_call") == F.col("_answer"), "left")
    # Messages without an identifier meet nothing, and stay out of the join: their null key is one hash.
    own = F.coalesce("call_id", "result_of")
    linked = messages.where(own.isNotNull()).join(known, own == F.col("_call"), "left").unionByName(
        messages.where(own.isNull()), allowMissingColumns=True)
    is_call, is_result = F.col("call_id").isNotNull(), F.col("result_of").isNotNull() & F.col("call_id").isNull()
    status = F.when(is_call, F.when(F.col("_answer").isNotNull(), "answered").otherwise("open")) \
        .when(is_result, F.when(F.col("_call").isNotNull(), "linked").otherwise("orphan")).otherwise("plain")
    level = F.when(is_call, 2 * F.col("level")).when(is_result, 2 * F.col("level") + 1).otherwise(0)
    problem = F.when(is_call, schema_problem("name", "arguments", schemas))
    fields = [("call_id", canonical("call_id")), ("content", canonical("text")),
              ("result_of", canonical("result_of")), ("role", canonical("role")),
              ("tool", F.concat(F.lit('{"arguments":'), canonical_map("arguments"),
                                F.lit(',"name":'), canonical("name"), F.lit("}")))]
    present = {"call_id": is_call, "result_of": is_result, "tool": is_call}
    parts = F.filter(F.array(*[F.when(present.get(k, F.lit(True)), F.concat(F.lit(f'"{k}":'), v))
                               for k, v in fields]), lambda p: p.isNotNull())
    json = F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))
    return linked.select("conv_id", "turn", F.col("role"), level.cast("int").alias("level"),
                         status.alias("status"), problem.alias("problem"), json.alias("json"))


def earlier_asked(conversations: DataFrame) -> DataFrame:
    """(_c, _t, _before): every turn number a user has in a conversation, and the one before it.

    Turn numbers are ordered in blocks of ``TURN_BLOCK``, and each block is told the last number
    of those before it, so that a conversation of any length is no single sort. Repeated turns
    count once.
    """
    asked = conversations.where((F.col("role") == "user") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select(
        F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.floor(F.col("turn") / TURN_BLOCK).alias("_b")).distinct()
    blocks = asked.groupBy("_c", "_b").agg(F.max("_t").alias("_last"))
    carried = blocks.select("_c", "_b", F.lag("_last").over(Window.partitionBy("_c").orderBy("_b")).alias("_carry"))
    inside = F.lag("_t").over(Window.partitionBy("_c", "_b").orderBy("_t"))
    return asked.withColumn("_inside", inside).join(carried, ["_c", "_b"]).select(
        "_c", "_t", F.coalesce("_inside", "_carry").alias("_before"))


def turns_as_calls(conversations: DataFrame) -> DataFrame:
    """Plain conversations as tool traffic: a user turn calls, an assistant turn answers it.

    A call is identified by conversation and turn, an answer names the turn before it, and
    every call builds on the user turn before it, so calls of a conversation form one chain. Prompts
    under eight words call ``brief``, others ``reply``. System turns stay plain, as do turns without
    a number or a conversation.
    """
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    ident = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    asks = F.col("role") == "user"
    brief = words < 8
    arguments = F.create_map(F.lit("prompt"), canonical("text"), F.lit("words"), words.cast("string"))
    earlier = earlier_asked(conversations).where(F.col("_before").isNotNull())
    known = conversations.where(asks).join(
        earlier, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left").unionByName(
        conversations.where(~F.coalesce(asks, F.lit(False))), allowMissingColumns=True)
    return known.select(
        "conv_id", "turn", "role", "text",
        F.when(asks, ident(F.col("turn"))).alias("call_id"),
        F.when(asks, F.when(brief, "brief").otherwise("reply")).alias("name"),
        F.when(asks, arguments).alias("arguments"),
        F.when(F.col("role") == "assistant", ident(F.col("turn") - 1)).alias("result_of"),
        F.when(F.col("_before").isNotNull(), F.array(ident(F.col("_before")))).alias("needs"))


def op6_chat_formatting(spark, folder):
    return link_calls(turns_as_calls(spark.read.parquet(f"{folder}/conversations.parquet")))


def _sql() -> str:
    def literal(c):
        out = c
        for plain, short in ESCAPES[:7]:
            code = f"chr({ord(plain)})"
            out = f"replace({out}, {code}, '{short}')"
        return f"coalesce('\"' || {out} || '\"', 'null')"

    return rf"""
WITH m AS (
  SELECT conv_id, turn, role, text, conv_id || ':' || turn AS ident, conv_id || ':' || (turn - 1) AS prior,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    role = 'user' AS asks, role = 'assistant' AS answers
  FROM conversations),
calls AS (
  SELECT ident, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS depth
  FROM (SELECT DISTINCT ident, conv_id, turn FROM m WHERE asks AND ident IS NOT NULL)),
answered AS (SELECT DISTINCT prior FROM m WHERE answers)
SELECT conv_id, turn, role,
  CAST(CASE WHEN asks THEN 2 * c.depth WHEN answers THEN 2 * c.depth + 1 ELSE 0 END AS INT) AS level,
  CASE WHEN asks AND m.ident IS NOT NULL THEN CASE WHEN a.prior IS NULL THEN 'open' ELSE 'answered' END
       WHEN answers AND m.prior IS NOT NULL THEN CASE WHEN c.ident IS NULL THEN 'orphan' ELSE 'linked' END ELSE 'plain' END AS status,
  CASE WHEN asks AND text IS NULL THEN 'type of prompt' END AS problem,
  '{{' || CASE WHEN asks THEN '"call_id":' || {literal("m.ident")} || ',' ELSE '' END
    || '"content":' || {literal("text")}
    || CASE WHEN answers THEN ',"result_of":' || {literal("m.prior")} ELSE '' END
    || ',"role":' || {literal("role")}
    || CASE WHEN asks THEN ',"tool":{{"arguments":{{"prompt":' || {literal("text")} || ',"words":' || words
         || '}},"name":"' || CASE WHEN words < 8 THEN 'brief' ELSE 'reply' END || '"}}' ELSE '' END || '}}' AS json
FROM m LEFT JOIN calls c ON c.ident = CASE WHEN asks THEN m.ident WHEN answers THEN m.prior END
  LEFT JOIN answered a ON asks AND a.prior = m.ident
"""


SQL = _sql()
