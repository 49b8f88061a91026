"""Chat formatting: tool calls linked to their results, ordered, validated and serialised as canonical JSON."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.shared import bind, cut, fresh_path

#: JSON types that a schema may name, and how Spark names the variant's type.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "DOUBLE|DECIMAL.*|BIGINT", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*"}
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]


#: Tokens of JSON text: strings (possessive, so that long ones need no stack), numbers, punctuation, names.
TOKEN = r'"(?:[^"\\]++|\\.)*+"|-?[0-9][-+.0-9eE]*|[\[\]{}:,]|true|false|null'
#: Digits up to which a number is written out.
PLAIN_DIGITS = 21


def plain_number(token: str) -> str:
    """SQL: a JSON number by its value alone, exactly: written out where PLAIN_DIGITS digits (or, for whole numbers, all that it has) do,
    else as d.ddde+n; no zeros that say nothing. An exponent of more than 18 characters leaves a number as it stands."""
    part = lambda k: f"regexp_extract({token}, '^(-?)([0-9]+)(?:[.]([0-9]+))?(?:[eE]([-+]?[0-9]+))?$', {k})"
    # d: the digits without zeros at the ends; the value is 0.d times ten to the p.
    exponent = f"case when {part(4)} = '' then 0L when length({part(4)}) <= 18 then try_cast({part(4)} as bigint) end"
    point = f"{exponent} + length({part(2)}) - (length({part(2)}) + length({part(3)}) - length(x.lead))"
    whole, fraction = "rpad(n.d, int(n.p), '0')", "concat(substring(n.d, 1, int(n.p)), '.', substring(n.d, int(n.p) + 1))"
    small = "concat('0.', repeat('0', int(-n.p)), n.d)"
    science = "concat(substring(n.d, 1, 1), if(length(n.d) > 1, concat('.', substring(n.d, 2)), ''), 'e', if(n.p > 0, '+', ''), string(n.p - 1))"
    shape = f"case when n.p >= length(n.d) and n.p <= greatest({PLAIN_DIGITS}, length(n.d)) then {whole} when n.p > 0 and n.p < length(n.d) then {fraction} when n.p > -6 and n.p <= 0 then {small} else {science} end"
    text = f"case when n.d = '' then '0' when n.p is null then {token} else concat({part(1)}, {shape}) end"
    lead = f"named_struct('lead', regexp_replace(concat({part(2)}, {part(3)}), '^0+', ''))"
    return bind("x", lead, bind("n", f"named_struct('d', regexp_replace(x.lead, '0+$', ''), 'p', {point})", text))


def canonical(json: str) -> Column:
    """JSON (SQL of it) by its value: the keys of each object in code-point order, no white space, numbers by plain_number(), strings with
    the fewest escapes; null where it doesn't parse (repeated keys and numbers of over 1000 digits among that).

    The parser sorts keys by UTF-16 and holds 38 digits. So its input is rewritten token by token: a key gets its bytes in hex in front,
    which sort as code points do, and a number that is no short whole one becomes a string; a hash of the whole marks both, and both go
    at the end.
    """
    key = """concat('"', mark, hex(encode(try_variant_get(try_parse_json(t), '$', 'string'), 'UTF-8')), '!', substring(t, 2))"""
    number = bind("v", plain_number("t"), """if(v rlike '^-?[0-9]{1,18}$', v, concat('"', mark, '#', v, '"'))""")
    token = f"""case when startswith(t, '"') then if(get(ts, i + 1) = ':', {key}, t) when t rlike '^[-0-9]' then {number} else t end"""
    marked = f"to_json(try_parse_json(array_join(transform(ts, (t, i) -> {token}), '')))"
    plain = f"""regexp_replace(regexp_replace({marked}, concat('"', mark, '[0-9A-F]*!'), '"'), concat('"', mark, '#([^"]*)"'), '$1')"""
    body = bind("j", json, bind("mark", "md5(j)", bind("ts", f"regexp_extract_all(j, r'{TOKEN}', 0)", plain)))
    return F.expr(f"if(try_parse_json({json}) is null, null, {body})")


def violations(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a call's arguments, in a fixed order: unparsable, unknown_tool, then by field missing: and type:,
    then extra: for fields that the tool's schema (field -> (type, required)) doesn't name."""
    value = F.try_parse_json(arguments)
    keys = F.coalesce(F.json_object_keys(F.when(value.isNotNull(), arguments)), F.array().cast("array<string>"))
    keys = F.array_sort(keys)
    found = F.when(value.isNull(), F.array(F.lit("unparsable")))
    for tool, fields in sorted(schemas.items()):
        checks = []
        for field, (kind, required) in sorted(fields.items()):
            typed = F.schema_of_variant(F.try_variant_get(value, f"$['{field}']", "variant"))
            if required:
                checks.append(F.when(~F.array_contains(keys, field), F.lit(f"missing:{field}")))
            checks.append(F.when(F.array_contains(keys, field) & ~F.coalesce(typed, F.lit("VOID")).rlike(f"^({TYPES[kind]})$"), F.lit(f"type:{field}")))
        extra = F.transform(F.filter(keys, lambda k: ~k.isin(*fields) if fields else F.lit(True)), lambda k: F.concat(F.lit("extra:"), k))
        found = found.when(name == tool, F.concat(F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"), extra))
    return found.otherwise(F.array(F.lit("unknown_tool")))


def chain_ends(waits: DataFrame) -> DataFrame:
    """(conv_id, call_id, end, steps) for each call of waits (conv_id, call_id, on) that waits for one other alone: the first call along
    the chain that waits for none or for several, and how far it is; end is null where a chain leads into a circle.

    Pointers are doubled: as many rounds as the logarithm of the longest chain.
    """
    counts = cut(waits.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n"), F.min("on").alias("end")), "counts")
    single = counts.where("n = 1").select("conv_id", "call_id", "end", F.lit(1).cast("long").alias("steps"))
    inner = single.select("conv_id", F.col("call_id").alias("end"), F.lit(True).alias("more"))
    at = cut(single.join(inner, ["conv_id", "end"], "left").select("conv_id", "call_id", "end", "steps", F.coalesce("more", F.lit(False)).alias("more")), "chains")
    n = at.count()
    for _ in range(n.bit_length() + 1):
        if at.where("more").isEmpty():
            break
        to = at.select("conv_id", F.col("call_id").alias("end"), F.col("end").alias("far"), F.col("steps").alias("on_steps"), F.col("more").alias("on_more"))
        moved = at.where("more").join(to, ["conv_id", "end"]).select("conv_id", "call_id", F.col("far").alias("end"), (F.col("steps") + F.col("on_steps")).alias("steps"), F.col("on_more").alias("more"))
        at = cut(at.where("not more").unionByName(moved), "chains")
    return at.select("conv_id", "call_id", F.when(~F.col("more"), F.col("end")).alias("end"), "steps")


def topological_levels(calls: DataFrame) -> DataFrame:
    """calls (conv_id, call_id, turn, depends_on) with level, long: 0 where nothing stands in the way.

    Turns of a conversation grow, so an order by turn is topological wherever each dependency is on a call of an earlier
    turn: those have level 0. In a conversation with a call that depends on one of the same or a later turn, a call's level is 1 + the
    greatest of those that it waits for, 0 if it waits for none; null on a circle, and behind one. Dependencies on unknown calls are
    ignored. Order by (level, turn) within a conversation.

    Calls that wait for one other alone are jumped over by chain_ends(); the rest takes a round for each call that waits for several on
    the longest way. A round appends the levels that it finds to one table.
    """
    plain = calls.select("conv_id", "call_id", "turn")
    edges = calls.select("conv_id", "call_id", "turn", F.explode("depends_on").alias("on"))
    to = plain.select("conv_id", F.col("call_id").alias("on"), F.col("turn").alias("on_turn"))
    edges = edges.join(to, ["conv_id", "on"])
    # Only conversations in which a dependency points forward need more than their turns.
    crossed = cut(edges.where("on_turn >= turn").select("conv_id").distinct(), "crossed")
    if crossed.isEmpty():
        return calls.withColumn("level", F.lit(0).cast("long"))
    waits = cut(edges.join(crossed, "conv_id", "left_semi").select("conv_id", "call_id", "on").distinct(), "waits")
    ends = cut(chain_ends(waits).select("conv_id", F.col("call_id").alias("waiting"), F.col("end").alias("call_id"), "steps"), "ends")
    several = waits.join(ends.select("conv_id", F.col("waiting").alias("call_id")), ["conv_id", "call_id"], "left_anti")
    spark, known = calls.sparkSession, fresh_path(calls.sparkSession, "levels")
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema}
    schema = f"conv_id {kinds['conv_id']}, call_id {kinds['call_id']}, level long"

    def settle(found: DataFrame) -> None:
        """Append levels of calls, and those of the chains that end in them."""
        found = cut(found, "settled")
        behind = ends.join(found, ["conv_id", "call_id"]).select("conv_id", F.col("waiting").alias("call_id"), (F.col("level") + F.col("steps")).alias("level"))
        found.unionByName(behind).write.mode("append").parquet(known)

    free = plain.join(crossed, "conv_id", "left_semi").join(waits.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")
    settle(free.select("conv_id", "call_id", F.lit(0).cast("long").alias("level")))
    several = cut(several, "several")
    while not several.isEmpty():
        levels = spark.read.schema(schema).parquet(known)
        met = several.join(levels.withColumnRenamed("call_id", "on"), ["conv_id", "on"], "left").groupBy("conv_id", "call_id")
        ready = met.agg(F.max("level").alias("most"), F.count(F.when(F.col("level").isNull(), 1)).alias("open")).where("open = 0")
        ready = cut(ready.select("conv_id", "call_id", (F.col("most") + 1).alias("level")), "ready")
        if ready.isEmpty():
            break
        settle(ready)
        several = cut(several.join(ready, ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", "on"), "several")
    levels = spark.read.schema(schema).parquet(known).withColumnRenamed("level", "found")
    out = calls.join(crossed.withColumn("crossed", F.lit(True)), "conv_id", "left").join(levels, ["conv_id", "call_id"], "left")
    return out.withColumn("level", F.when(F.col("crossed"), F.col("found")).otherwise(F.lit(0).cast("long"))).drop("crossed", "found")


def linked_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for each call of calls (conv_id, call_id, turn, name, arguments, depends_on), with level, status, problems, n_results and json,
    and one for each conv_id and call_id that only results have.

    Calls and results (conv_id, call_id, turn, content) meet by a hash join on conv_id and call_id. A call that repeats
    conv_id and call_id counts once, as its least row; of several results to a call the first by turn and content counts, and
    n_results tells how many there were. status: orphan (there is no call), invalid (problems is not empty), cyclic, unanswered or
    linked. json is canonical(): the call's arguments canonical within it (as text where they don't parse), and its result or null.
    An orphan has the turn of its result, level 0, no problems and a null call in json. Rows with a null
    conv_id, call_id or turn are ignored. Empty tables give no rows.
    """
    known = "conv_id is not null and call_id is not null and turn is not null"
    one = calls.where(known).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("c"))
    one = cut(one.select("conv_id", "call_id", "c.*"), "calls")
    answers = results.where(known).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    out = topological_levels(one).withColumn("_called", F.lit(True)).join(cut(answers, "results"), ["conv_id", "call_id"], "full")
    orphan = F.col("_called").isNull()
    out = out.withColumn("turn", F.coalesce("turn", "r.turn")).withColumn("level", F.when(orphan, F.lit(0).cast("long")).otherwise(F.col("level")))
    out = out.withColumn("problems", F.when(orphan, F.array().cast("array<string>")).otherwise(violations(F.col("name"), F.col("arguments"), schemas))).withColumn("n_results", F.coalesce("n_results", F.lit(0)).cast("long"))
    status = F.when(orphan, "orphan").when(F.size("problems") > 0, "invalid").when(F.col("level").isNull(), "cyclic").when(F.col("n_results") == 0, "unanswered").otherwise("linked")
    out = out.withColumn("status", status)
    quoted = lambda c: F.coalesce(F.to_json(F.to_variant_object(F.array(c))), F.lit("[null]"))
    text = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(F.regexp_replace(quoted(c), r"^\[|\]$", ""))
    arguments = F.coalesce(canonical("arguments"), text(F.col("arguments")))
    content = F.col("r.content")
    call = F.concat(F.lit('{"arguments":'), arguments, F.lit(',"id":'), text(F.col("call_id")), F.lit(',"name":'), text(F.col("name")), F.lit("}"))
    json = F.concat(F.lit('{"call":'), F.when(orphan, F.lit("null")).otherwise(call), F.lit(',"result":'), text(content), F.lit(',"status":"'), F.col("status"), F.lit('"}'))
    return out.select("conv_id", "call_id", "turn", "name", "level", "status", "problems", "n_results", json.alias("json"))


def as_calls(turns: DataFrame, tool: str = "reply") -> tuple[DataFrame, DataFrame]:
    """Calls and results that plain conversations (conv_id, turn, role, text) stand for.

    Each user turn calls `tool` with its text and turn, under the id t<turn>, and depends on the user's turn two before;
    an assistant turn is the result of the call of the turn before it. Other roles are neither.
    """
    ident = lambda back: F.concat(F.lit("t"), (F.col("turn") - back).cast("string"))
    arguments = F.to_json(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))
    base = turns.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    calls = base.where("role = 'user'").select("conv_id", ident(0).alias("call_id"), "turn", F.lit(tool).alias("name"), arguments.alias("arguments"), F.array(ident(2)).alias("depends_on"))
    results = base.where("role = 'assistant'").select("conv_id", ident(1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def faulty_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """as_calls(), with what goes wrong in practice, by the conversation's number: of every 8, the calls of one (3) depend on the call
    two turns later instead, another (5) tells turns as text, and of the next (6) every second lacks the text, the others
    add a field, in another order and with a number that is not plain. Numbers are those of conv_id where it is a whole number."""
    calls, results = as_calls(turns)
    number = F.col("conv_id").cast("long")
    later = F.array(F.concat(F.lit("t"), (F.col("turn") + 2).cast("string")))
    text = F.get_json_object("arguments", "$.text")
    told = F.to_json(F.struct(F.col("turn").cast("string").alias("turn"), text.alias("text")))
    more = F.concat(F.lit('{ "turn" : '), F.col("turn"), F.lit(', "more" : 1.50E+1, "text" : '), F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", ""), F.lit(" }"))
    arguments = F.when(number % 8 == 5, told).when(number % 16 == 6, F.to_json(F.struct("turn"))).when(number % 16 == 14, more).otherwise(F.col("arguments"))
    calls = calls.withColumn("depends_on", F.when(number % 8 == 3, later).otherwise(F.col("depends_on"))).withColumn("arguments", arguments)
    return calls, results


#: The schema of the tool that as_calls() names.
REPLY: Schemas = {"reply": {"text": ("string", True), "turn": ("integer", True)}}
