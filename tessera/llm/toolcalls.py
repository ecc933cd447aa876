"""Tool-call linking for chat data, in DataFrame functions alone.

Calls and results meet by a shuffled hash join on their identifiers, are put in a topological order, have their arguments validated against
schemas, and are serialised as canonical JSON: keys sorted, no white space.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import files_of, fresh_dir, note, store, tidy

#: A schema: for each argument its type and whether it must be there; other arguments are errors.
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]
# Types of JSON by the names that schema_of_variant has for them.
KINDS = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY"}


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _errors(args: Column, name: Column, schemas: Schemas) -> Column:
    """What is wrong with the arguments (a variant, null if they are no JSON object), as an array of strings."""
    found: list[Column] = [F.when(args.isNull(), F.lit("not_an_object")), F.when(~F.coalesce(name.isin(list(schemas)), F.lit(False)), F.lit("unknown_tool"))]
    for tool, fields in schemas.items():
        mine = (name == tool) & args.isNotNull()
        for field, (kind, required) in fields.items():
            has = F.try_variant_get(args, f"$['{field}']", "variant")
            there = has.isNotNull() & (_kind(has) != "VOID")
            if required:
                found.append(F.when(mine & ~there, F.lit(f"missing:{field}")))
            ok = _kind(has).isin("BIGINT", "DECIMAL", "DOUBLE") if kind == "number" else _kind(has) == KINDS[kind]
            found.append(F.when(mine & there & ~ok, F.lit(f"type:{field}")))
        more = F.array_except(F.json_object_keys(F.to_json(args)), F.array(*(F.lit(f) for f in fields)).cast("array<string>"))
        found.append(F.when(mine & (F.size(more) > 0), F.concat(F.lit("unknown:"), F.array_join(F.array_sort(more), "+"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


FAR = 1 << 40  # longer than any path; steps around a cycle stay there


def waves(links: DataFrame) -> DataFrame:
    """Topological order: links (conv_id, call_id, turn, needs: an array of call_ids or null), one row for each call, to (conv_id, call_id, turn,
    wave): 0 for calls that need nothing that is there, else one more than the greatest of those they need. What stands on a cycle or
    behind one has none.

    An unsettled call has edges to unsettled ones, with steps, and the least wave that its settled ones leave it (base). A round takes each
    edge to a settled call into the base, and leads each edge to a call with one edge on to that edge's end; edges that meet become one. So a
    chain takes the logarithm of its length in rounds, and other graphs as many as calls with several unsettled ones follow each other.
    Without cycles every round settles calls; one that settles none leaves only cycles and what is behind them."""
    spark, folder, rounds = links.sparkSession, note(fresh_dir(links.sparkSession, "waves")), 0
    by, zero = ["conv_id", "call_id"], F.lit(0).cast("long")
    known = links.select("conv_id", F.col("call_id").alias("to"))
    edges = links.select(*by, "turn", F.explode("needs").alias("to")).distinct().join(known, ["conv_id", "to"])
    edges = store(edges.select(*by, "turn", zero.alias("base"), "to", (zero + 1).alias("steps"), F.count("*").over(Window.partitionBy(*by)).alias("open")), "edges")
    done = links.join(edges.select(*by), by, "left_anti").select(*by, "turn", zero.alias("wave"))

    def settle(df: DataFrame) -> DataFrame:
        """A round's calls in a folder of its own below that of all, so the result is one scan however many there are."""
        df.write.parquet(f"{folder}/round={rounds}")
        return spark.read.schema(df.schema).parquet(f"{folder}/round={rounds}")

    def settled() -> DataFrame:
        return spark.read.schema(done.schema).parquet(folder).select(*done.columns)

    new = settle(done)
    while not edges.isEmpty() and not new.isEmpty():
        rounds += 1
        none = F.lit(None)
        ends = settled().select("conv_id", F.col("call_id").alias("to"), F.col("wave").alias("least"), none.cast(edges.schema["to"].dataType).alias("on"), none.cast("long").alias("more"))
        ends = ends.union(edges.where("open = 1").select("conv_id", F.col("call_id").alias("to"), F.col("base").alias("least"), F.col("to").alias("on"), F.col("steps").alias("more")))
        met = edges.join(ends, ["conv_id", "to"], "left")
        stay = F.col("least").isNull()
        met = met.select(
            *by, "turn", F.when(stay, F.col("to")).otherwise(F.col("on")).alias("to"),
            F.least(F.col("steps") + F.coalesce("more", zero), F.lit(FAR)).alias("steps"),
            F.greatest("base", F.least(F.coalesce(F.col("least") + F.col("steps"), zero), F.lit(FAR))).alias("base"),
        )
        one = met.repartition(*by).groupBy(*by, "turn", "to").agg(F.max("steps").alias("steps"), F.max("base").alias("base"))
        own = Window.partitionBy(*by)
        moved = store(one.select(*by, "turn", F.max("base").over(own).alias("base"), "to", "steps", F.count("to").over(own).alias("open")), "edges")
        new = settle(moved.where("open = 0").select(*by, "turn", F.col("base").alias("wave")))
        edges = moved.where("to IS NOT NULL")
    return settled()


def positions(order: DataFrame) -> DataFrame:
    """order (conv_id, call_id, turn, wave) to (conv_id, call_id, wave, position): 1 for the first call of its conversation by wave, turn and
    call_id. Calls are dealt by ranges of all four and ranked within these; what a conversation has in earlier ranges is added,
    so a conversation of any length is spread over many tasks."""
    by = ["conv_id", "wave", "turn", "call_id"]
    dealt = store(order.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*by[1:]))
    return dealt.withColumn("within", within).join(sizes, ["conv_id", "part"]).select("conv_id", "call_id", "wave", (F.col("before") + F.col("within")).alias("position"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """calls (conv_id, call_id, turn, name, arguments: JSON text, needs: a call_id, an array of them, or null) and results (conv_id, call_id,
    content) to a row for each call, and one for each identifier that has results alone.

    conv_id, call_id, turn, wave, position (1 for the first call of its conversation by wave, turn and call_id; null on a cycle), n_calls
    and n_results (rows that repeat the identifier; the least by turn and text stands for them), status (linked, no_result, no_call), errors
    (joined by commas, empty if the arguments are valid) and message (canonical JSON). Null identifiers link with nothing and give rows of
    their own; null contents and arguments are null in the message. Other columns are not read, texts of any length are kept whole, and
    empty tables give none."""
    if calls.schema["needs"].dataType.typeName() != "array":
        calls = calls.withColumn("needs", F.when(F.col("needs").isNotNull(), F.array("needs")))
    c = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "name", "arguments", "needs")).alias("c"), F.count("*").alias("n_calls"))
    r = results.groupBy("conv_id", "call_id").agg(F.min("content").alias("content"), F.count("*").alias("n_results"))
    # A null never equals a null here: each unknown identifier stays by itself.
    both = c.join(r.hint("shuffle_hash"), ["conv_id", "call_id"], "full_outer")
    # The order needs the identifiers alone, so only they go through its rounds.
    order = waves(store(c.where("call_id IS NOT NULL AND conv_id IS NOT NULL").select("conv_id", "call_id", "c.turn", "c.needs"), "needs"))
    both = both.join(positions(order), ["conv_id", "call_id"], "left")
    args = F.try_parse_json("c.arguments")
    object_ = F.when(_kind(args) == "OBJECT", args)
    there = F.col("n_calls").isNotNull()
    field = lambda key, v: F.concat(F.lit(f'"{key}":'), F.coalesce(F.regexp_extract(F.to_json(F.struct(v.alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1), F.lit("null")))
    json = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            F.concat(F.lit('"arguments":'), F.coalesce(F.to_json(object_), F.lit("null"))),
            field("content", F.col("content")),
            field("id", F.col("call_id")),
            field("name", F.col("c.name")),
        ),
        F.lit("}"),
    )
    status = F.when(there & F.col("n_results").isNotNull(), "linked").when(there, "no_result").otherwise("no_call")
    errors = F.when(there, F.array_join(_errors(object_, F.col("c.name"), schemas), ",")).otherwise(F.lit(""))
    return both.select(
        "conv_id", "call_id", F.col("c.turn").alias("turn"), "wave", "position", F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"), status.alias("status"), errors.alias("errors"), json.alias("message"),
    )


#: A user's turn, as the call of a tool that has it answered.
ANSWER: Schemas = {"answer": {"prompt": ("string", True), "turn": ("integer", True)}}


def from_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations as calls and results: each user turn asks the tool "answer" and needs the call two turns before it, and
    the assistant's next turn is the result. other_turns() tells of the rest."""
    t = conversations.where(LINKABLE)
    id_ = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    calls = t.where("role = 'user'").select(
        "conv_id", id_(F.col("turn")).alias("call_id"), "turn", F.lit("answer").alias("name"),
        F.to_json(F.struct(F.col("turn"), F.col("text").alias("prompt"))).alias("arguments"), F.when(F.col("turn") >= 2, id_(F.col("turn") - 2)).alias("needs"),
    )
    results = t.where("role = 'assistant'").select("conv_id", id_(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


LINKABLE = "conv_id IS NOT NULL AND turn IS NOT NULL AND role IN ('user', 'assistant')"


def other_turns(conversations: DataFrame) -> DataFrame:
    """Turns that are neither calls nor results, as rows like those of link_calls: of other roles or none, without a conversation or a turn.
    Each keeps its conv_id and turn, has status other, and its message holds content and role."""
    none = lambda kind: F.lit(None).cast(kind)
    json = F.to_json(F.struct(F.col("text").alias("content"), "role"), {"ignoreNullFields": "false"})
    zero = F.lit(0).cast("long")
    rest = conversations.where(f"NOT coalesce({LINKABLE}, false)")
    return rest.select(
        "conv_id", none("string").alias("call_id"), "turn", none("long").alias("wave"), none("long").alias("position"), zero.alias("n_calls"), zero.alias("n_results"),
        F.lit("other").alias("status"), F.lit("").alias("errors"), json.alias("message"),
    )


@tidy
def op8_tool_calls(conversations: DataFrame) -> DataFrame:
    """link_calls of from_turns, and other_turns: every turn has its place in some row, in the cases that those state. Repeated turns of
    users and assistants are counted in one row; others have a row each."""
    calls, results = from_turns(conversations)
    return files_of(link_calls(calls, results, ANSWER).unionByName(other_turns(conversations)), conversations.count(), 5000)


OP8_SQL = """
WITH RECURSIVE t AS (SELECT * FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IN ('user', 'assistant')),
c AS (SELECT conv_id, turn, count(*) n_calls, arg_min(text, '{"turn":' || turn || coalesce(',"prompt":' || to_json(text)::varchar, '') || '}') AS prompt FROM t WHERE role = 'user' GROUP BY 1, 2),
r AS (SELECT conv_id, turn - 1 AS turn, count(*) n_results, min(text) AS answer FROM t WHERE role = 'assistant' GROUP BY 1, 2),
w(conv_id, turn, wave) AS (
  SELECT conv_id, turn, 0 FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.conv_id = c.conv_id AND d.turn = c.turn - 2)
  UNION ALL SELECT c.conv_id, c.turn, w.wave + 1 FROM w JOIN c ON c.conv_id = w.conv_id AND c.turn = w.turn + 2),
b AS (SELECT coalesce(c.conv_id, r.conv_id) conv_id, coalesce(c.turn, r.turn) k, c.turn, n_calls, n_results, prompt, answer FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn)
SELECT b.conv_id, b.conv_id || ':' || k AS call_id, b.turn, wave, coalesce(n_calls, 0) n_calls, coalesce(n_results, 0) n_results,
  CASE WHEN n_calls IS NULL THEN 'no_call' WHEN n_results IS NULL THEN 'no_result' ELSE 'linked' END status,
  CASE WHEN n_calls IS NOT NULL AND prompt IS NULL THEN 'missing:prompt' ELSE '' END errors,
  '{"arguments":' || CASE WHEN n_calls IS NULL THEN 'null' ELSE '{' || coalesce('"prompt":' || to_json(prompt)::varchar || ',', '') || '"turn":' || b.turn || '}' END
  || ',"content":' || coalesce(to_json(answer)::varchar, 'null') || ',"id":"' || b.conv_id || ':' || k || '","name":' || CASE WHEN n_calls IS NULL THEN 'null' ELSE '"answer"' END || '}' AS message,
  CASE WHEN wave IS NOT NULL THEN row_number() OVER (PARTITION BY b.conv_id, wave IS NULL ORDER BY wave, b.turn, b.conv_id || ':' || k) END AS "position"
FROM b LEFT JOIN w ON b.conv_id = w.conv_id AND b.turn = w.turn
UNION ALL BY NAME SELECT conv_id, NULL::varchar AS call_id, turn, NULL::bigint AS wave, 0 AS n_calls, 0 AS n_results, 'other' AS status, '' AS errors,
  '{"content":' || coalesce(to_json(text)::varchar, 'null') || ',"role":' || coalesce(to_json(role)::varchar, 'null') || '}' AS message, NULL::bigint AS "position"
FROM conversations WHERE NOT coalesce(conv_id IS NOT NULL AND turn IS NOT NULL AND role IN ('user', 'assistant'), false)"""
