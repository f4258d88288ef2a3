"""Agent transcripts of four formats, as events, and the latest turn of each file.

Files are read as bounded tails: the last bytes up to an end that may be frozen beforehand, without the first line if it
is cut. A format turns its lines into one relation of events; turns are built from events alike for all.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.parsers import scripted_command
from ..functions.tables import EXIT_CODE, OBJECTIVE_COMMAND, OBJECTIVE_TOOLS
from ..functions.text import redact

MAX_BYTES, MAX_CODEX_BYTES = 2_000_000, 16_000_000
#: Events: kind is user, assistant, call, result or other; the rest is null where it does not apply.
EVENT = """path string, n long, kind string, key string, text string, call_id string, name string, input string, output string,
 failed boolean, passed boolean, running boolean, exit_code string"""


def tails(spark: SparkSession, paths: str | list[str], max_bytes: int = MAX_BYTES, frozen: DataFrame | None = None) -> DataFrame:
    """(path, n, line): lines of each file's tail. ``frozen`` (path, end_offset) ends a file where it ended when it was queued."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content", "length")
    if frozen is not None:
        files = files.join(frozen, "path").where("end_offset between 0 and length")
        files = files.withColumn("content", F.substring(F.col("content"), F.lit(1), F.col("end_offset").cast("int"))).withColumn("length", F.col("end_offset"))
    start = F.greatest(F.lit(0).cast("long"), F.col("length") - max_bytes).cast("int")
    tail = F.decode(F.substring(F.col("content"), start + 1, F.lit(max_bytes)), "UTF-8")
    whole = F.when(start > 0, F.regexp_replace(tail, r"^[^\n]*\n", "")).otherwise(tail)
    return files.select("path", F.posexplode(F.split(whole, r"\r?\n")).alias("n", "line")).where("trim(line) <> ''").withColumn("n", F.col("n").cast("long"))


def _get(path: str, line: str = "line") -> Column:
    return F.get_json_object(line, path)


_BLOCKS = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"


def _blocks(content: Column) -> Column:
    """Message content as blocks: a string is one block of text."""
    text = F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("id", "name", "input", "tool_use_id", "content")], F.lit(None).cast("boolean").alias("is_error")))
    return F.when(content.startswith("["), F.from_json(content, _BLOCKS)).when(content.isNotNull(), text).otherwise(F.array().cast(_BLOCKS))


def _event(kind: Column | str, **values: Column) -> Column:
    names = [("kind", "string"), ("key", "string"), ("text", "string"), ("call_id", "string"), ("name", "string"), ("input", "string"), ("output", "string")]
    names += [("failed", "boolean"), ("passed", "boolean"), ("running", "boolean"), ("exit_code", "string")]
    values["kind"] = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in names])


def _joined(blocks: Column) -> Column:
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"].isin("text", "input_text", "output_text") & b["text"].isNotNull()), lambda b: b["text"]), "\n")


def claude(lines: DataFrame) -> DataFrame:
    rows = lines.select("path", "n", _get("$.type").alias("type"), _get("$.uuid").alias("uuid"), _get("$.message.role").alias("role"), _blocks(_get("$.message.content")).alias("b"), "line")
    uses = F.transform(F.filter("b", lambda b: (b["type"] == "tool_use") & b["id"].isNotNull()), lambda b: _event("call", call_id=b["id"], name=b["name"], input=b["input"]))
    flags = dict(
        failed=F.when((_get("$.toolUseResult.interrupted") == "true") | _get("$.toolUseResult.status").isin("failed", "error"), True),
        running=_get("$.toolUseResult.backgroundTaskId").isNotNull() | _get("$.toolUseResult.status").isin("running", "pending"),
    )
    code = F.coalesce(_get("$.toolUseResult.exit_code"), _get("$.toolUseResult.exitCode"))

    def result(b: Column) -> Column:
        return _event(
            "result", call_id=b["tool_use_id"], output=F.coalesce(b["content"], F.lit("")), failed=F.coalesce(flags["failed"], b["is_error"], F.lit(False)),
            passed=F.coalesce(~b["is_error"], F.lit(False)), running=F.coalesce(flags["running"], F.lit(False)), exit_code=code,
        )

    results = F.transform(F.filter("b", lambda b: (b["type"] == "tool_result") & b["tool_use_id"].isNotNull()), result)
    said = F.array(_event(F.when(F.col("type") == "user", "user").when(F.col("role") == "assistant", "assistant").otherwise("other"), key=F.col("uuid"), text=_joined(F.col("b"))))
    return _flat(rows, F.concat(said, F.when(F.col("role") == "assistant", uses).otherwise(F.array().cast(_event_array())), F.when(F.col("role") == "user", results).otherwise(F.array().cast(_event_array()))))


def _event_array() -> str:
    return "array<struct<kind:string,key:string,text:string,call_id:string,name:string,input:string,output:string,failed:boolean,passed:boolean,running:boolean,exit_code:string>>"


def _flat(rows: DataFrame, events: Column) -> DataFrame:
    """One row for each event; n counts lines, and events of a line stay in order."""
    return rows.select("path", (F.col("n") * 1000).alias("n"), F.posexplode(events).alias("i", "e")).select("path", (F.col("n") + F.col("i")).alias("n"), "e.*")


def codex(lines: DataFrame) -> DataFrame:
    p = lambda name: _get(f"$.payload.{name}")
    kind = p("type")
    text = F.when(kind.isin("user_message", "agent_message"), p("message")).otherwise(_joined(_blocks(p("content"))))
    call, result = kind.isin("function_call", "custom_tool_call"), kind.isin("function_call_output", "custom_tool_call_output")
    output = F.when(p("output").startswith("["), _joined(_blocks(p("output")))).otherwise(p("output"))
    what = (
        F.when((kind == "user_message") | ((kind == "message") & (p("role") == "user")), "user")
        .when((kind == "agent_message") | ((kind == "message") & (p("role") == "assistant")), "assistant")
        .when(call, "call").when(result, "result").otherwise("other")
    )
    # a call of the scripting tool whose script is one literal command counts as that command; its output wraps the result
    name, given = F.coalesce(p("name"), p("tool_name")), F.coalesce(p("arguments"), p("input"))
    script = F.coalesce(F.get_json_object(given, "$.input"), given)
    lines = lines.withColumn("__command", scripted_command(F.when(call & name.isin("exec", "functions.exec"), script)))
    known = F.col("__command").isNotNull()
    name, given = F.when(known, "exec_command").otherwise(name), F.when(known, F.to_json(F.struct(F.col("__command").alias("cmd")))).otherwise(given)
    wrapped = F.regexp_extract(output, r"(?s)^Script completed\n.*?\nOutput:\n(\{.*\})\s*$", 1)
    event = _event(
        what, text=text, call_id=F.coalesce(p("call_id"), p("id")), name=name, input=given,
        output=output, failed=p("status").isin("failed", "error"), running=p("status").isin("running", "pending") | output.contains("Script running with cell ID"),
        exit_code=F.coalesce(p("exit_code"), F.get_json_object(output, "$.exit_code"), F.get_json_object(output, "$.metadata.exit_code"), F.get_json_object(wrapped, "$.exit_code")),
    )
    return _flat(lines, F.array(event))


_MESSAGES = "array<struct<id:string,line:string>>"


def _gemini_steps(lines: DataFrame) -> DataFrame:
    """(path, n, i, kind, id, line): what a log's lines do to the list of messages: reset it, rewind it to an id, or put a message."""
    keys = F.coalesce(F.json_object_keys("line"), F.array().cast("array<string>"))
    set_ = F.get_json_object("line", "$['$set'].messages")
    batch = F.from_json(F.coalesce(set_, _get("$.messages")), "array<string>")
    put = lambda text: F.struct(F.lit("put").alias("kind"), F.get_json_object(text, "$.id").alias("id"), text.alias("line"))
    mark = lambda kind, id_: F.struct(F.lit(kind).alias("kind"), id_.cast("string").alias("id"), F.lit(None).cast("string").alias("line"))
    puts = F.transform(batch, put)
    steps = (
        F.when(F.array_contains(keys, "$rewindTo"), F.array(mark("rewind", F.get_json_object("line", "$['$rewindTo']"))))
        .when(set_.isNotNull() & batch.isNotNull(), F.concat(F.array(mark("reset", F.lit(None))), puts))
        .when(batch.isNotNull(), puts)
        .otherwise(F.array(put(F.col("line"))))
    )
    found = lines.where(F.size(keys) > 0).select("path", "n", F.posexplode(steps).alias("i", "s")).select("path", "n", "i", "s.*")
    return found.where("kind <> 'put' or coalesce(id, '') <> ''")


def _after(live: Column, step: Column) -> Column:
    """A list of messages after one step: a rewind cuts from its message on, or everything where it names none; a put replaces in place."""
    ids = F.transform(live, lambda m: m["id"])
    at = F.array_position(ids, F.coalesce(step["id"], F.lit(""))).cast("int")
    empty, own = F.array().cast(_MESSAGES), F.struct(step["id"].alias("id"), step["line"].alias("line"))
    replaced = F.transform(live, lambda m: F.when(m["id"] == step["id"], own).otherwise(m))
    return (
        F.when((step["kind"] == "reset") | ((step["kind"] == "rewind") & (at == 0)), empty)
        .when(step["kind"] == "rewind", F.slice(live, F.lit(1), F.greatest(at - 1, F.lit(0))))
        .when(at == 0, F.array_append(live, own))
        .otherwise(replaced)
    )


def gemini(lines: DataFrame) -> DataFrame:
    """A log is a list of steps, which are folded in order, for each file within the tail's bound; the messages left are events like any others."""
    steps = _gemini_steps(lines).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("n", "i", "kind", "id", "line"))).alias("steps"))
    live = F.aggregate("steps", F.array().cast(_MESSAGES), _after)
    rows = steps.select("path", F.posexplode(live).alias("n", "m")).select("path", F.col("n").cast("long").alias("n"), "m.line")
    said = _event(F.when(_get("$.type") == "user", "user").otherwise("assistant"), key=_get("$.id"), text=F.when(_get("$.content").startswith("["), _joined_plain(_get("$.content"))).otherwise(_get("$.content")))
    calls = F.coalesce(F.from_json(_get("$.toolCalls"), "array<struct<id:string,name:string,args:string,status:string,result:string>>"), F.array().cast("array<struct<id:string,name:string,args:string,status:string,result:string>>"))
    asked = F.transform(calls, lambda c: _event("call", call_id=c["id"], name=c["name"], input=c["args"]))
    told = F.transform(calls, lambda c: _event("result", call_id=c["id"], output=c["result"], failed=c["status"].isin("failed", "error"), running=c["status"].isin("running", "pending")))
    return _flat(rows, F.concat(F.array(said), asked, told))


def _joined_plain(content: Column) -> Column:
    return F.array_join(F.transform(F.from_json(content, "array<struct<text:string,thought:boolean>>"), lambda b: F.when(~F.coalesce(b["thought"], F.lit(False)), b["text"])), "\n")


#: Kinds of entries that may end a branch.
TURN_TYPES = ("message", "function_call", "function_call_output", "function_call_result")


def branches(lines: DataFrame) -> DataFrame:
    """(path, nodes, cycle): the numbers of the lines of each file's newest branch, from its newest turn up to the root.

    A file without any parent is one branch. An edge to an id that is not there ends the branch; one that comes back to it is a cycle.
    The edges of one file, which the tail bounds, are a map that a fold looks the next parent up in.
    """
    flag = lambda name: F.coalesce(_get(f"$.providerData.{name}") == "true", F.lit(False))
    keys = F.json_object_keys("line")
    parent = F.coalesce(F.nullif(_get("$.parentId"), F.lit("")), _get("$.logicalParentId"))
    nodes = lines.where(keys.isNotNull()).select(
        "path", "n", _get("$.id").alias("id"), parent.alias("parent"), (_get("$.type").isin(*TURN_TYPES) & ~flag("isCompactInternal")).alias("turn"),
        (F.array_contains(keys, "parentId") | F.array_contains(keys, "logicalParentId")).alias("edge"),
    )
    node = F.struct("n", "parent", "id")
    by_id = nodes.where("id is not null").groupBy("path", "id").agg(F.max_by(node, "n").alias("node"))
    known = by_id.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("id", "node"))).alias("known"))
    files = nodes.groupBy("path").agg(
        F.max_by(node, F.when(F.coalesce("turn", F.lit(False)), F.col("n"))).alias("leaf"), F.bool_or("edge").alias("edges"), F.array_sort(F.collect_list("n")).alias("all"), F.count("*").alias("size"),
    )
    met = files.join(known, "path", "left")
    start = F.struct(F.col("leaf").alias("at"), F.array().cast("array<long>").alias("kept"), F.lit(False).alias("cycle"))

    def up(s: Column, _: Column) -> Column:
        again = F.array_contains(s["kept"], s["at"]["n"])
        nxt = F.try_element_at(F.col("known"), s["at"]["parent"])
        moved = F.struct(nxt.alias("at"), F.array_append(s["kept"], s["at"]["n"]).alias("kept"), s["cycle"].alias("cycle"))
        stopped = F.struct(F.when(F.lit(False), s["at"]).alias("at"), s["kept"].alias("kept"), F.lit(True).alias("cycle"))
        return F.when(s["at"].isNull(), s).when(again, stopped).otherwise(moved)

    walked = F.aggregate(F.sequence(F.lit(0), F.col("size")), start, up)
    branched = F.col("edges") & F.col("leaf").isNotNull()
    return met.withColumn("w", walked).select("path", F.when(branched, F.reverse("w.kept")).otherwise(F.col("all")).alias("nodes"), (branched & F.col("w.cycle")).alias("cycle"))


def dead_letters(lines: DataFrame) -> DataFrame:
    """(path, reason): files of this format that have no turn to read, because their branch is a cycle."""
    return branches(lines).where("cycle").select("path", F.lit("branch_contains_a_cycle").alias("reason"))


def codebuddy(lines: DataFrame) -> DataFrame:
    """Entries that are internal to a compaction hold a branch together and say nothing; files with a cycle are dead letters."""
    own = branches(lines).where("not cycle").select("path", F.posexplode("nodes").alias("place", "n"))
    rows = lines.join(own, ["path", "n"]).select("path", F.col("place").cast("long").alias("n"), "line")
    rows = rows.where(~F.coalesce(_get("$.providerData.isCompactInternal") == "true", F.lit(False)))
    rows = rows.where(~F.coalesce(_get("$.providerData.isMeta") == "true", F.lit(False)))
    kind, call_id = _get("$.type"), F.coalesce(_get("$.callId"), _get("$.call_id"))
    what = (
        F.when((kind == "message") & (_get("$.role") == "user"), "user").when((kind == "message") & (_get("$.role") == "assistant"), "assistant")
        .when(kind == "function_call", "call").when(kind.isin("function_call_output", "function_call_result"), "result").otherwise("other")
    )
    out = _get("$.output")
    event = _event(
        what, key=_get("$.id"), text=_joined(_blocks(_get("$.content"))), call_id=call_id, name=_get("$.name"), input=F.coalesce(_get("$.arguments"), _get("$.input")),
        output=F.when(out.startswith("["), _joined(_blocks(out))).when(out.startswith("{"), F.get_json_object(out, "$.text")).otherwise(out),
        failed=_get("$.providerData.toolResult.isError") == "true", exit_code=_get("$.providerData.toolResult.rawResponse.exitCode"),
    )
    return _flat(rows, F.array(event))


FORMATS: dict[str, Callable[[DataFrame], DataFrame]] = {"claude": claude, "codex": codex, "gemini": gemini, "codebuddy": codebuddy}


def tool_success() -> Column:
    """true, false or unknown: failure wins, running is unknown, exit codes decide, and a flag comes last."""
    told = F.regexp_extract_all(F.coalesce("output", F.lit("")), F.lit(EXIT_CODE), F.lit(1))
    codes = F.filter(F.concat(F.array("exit_code"), told), lambda c: c.rlike(r"^-?\d+$"))
    return (
        F.when(F.coalesce("failed", F.lit(False)), False)
        .when(F.coalesce("running", F.lit(False)), F.lit(None))
        .when(F.size(codes) > 0, F.forall(codes, lambda c: c.cast("int") == 0))
        .when(F.coalesce("passed", F.lit(False)), True)
    )


def objective_kind() -> Column:
    command = F.coalesce(F.get_json_object("input", "$.command"), F.get_json_object("input", "$.cmd"), F.col("input"), F.lit(""))
    return F.when(F.col("name").isin(*OBJECTIVE_TOOLS) & command.rlike(OBJECTIVE_COMMAND), "test")


def latest_turns(events: DataFrame) -> DataFrame:
    """(path, user_text, assistant_text, tools, source_turn_key, previous_turn_key): all after each file's last user prompt."""
    asked = events.where("kind = 'user' and trim(text) <> ''")
    by = Window.partitionBy("path").orderBy(F.desc("n"))
    ranked = asked.withColumn("__r", F.row_number().over(by)).where("__r <= 2")
    name = F.when(F.col("key").isNotNull(), F.concat(F.lit("transcript:"), F.sha2(F.concat_ws("\x1f", "path", "key"), 256)))
    at = lambda r, c: F.max(F.when(F.col("__r") == r, c))
    last = ranked.groupBy("path").agg(at(1, F.col("n")).alias("from_n"), at(1, F.col("text")).alias("user_text"), at(1, name).alias("source_turn_key"), at(2, name).alias("previous_turn_key"))
    after = events.join(last.select("path", "from_n"), "path").where("n > from_n")
    said = after.where("kind = 'assistant' and text <> ''").groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n").alias("assistant_text"))
    results = after.where("kind = 'result'").groupBy("path", "call_id").agg(F.max_by(F.struct("output", tool_success().alias("success")), "n").alias("r"))
    tool = F.struct(
        "n", F.col("call_id").alias("id"), F.coalesce("name", F.lit("unknown")).alias("name"), F.substring(redact(F.coalesce("input", F.lit(""))), 1, 2000).alias("input_summary"),
        F.substring(redact(F.coalesce("r.output", F.lit(""))), 1, 2000).alias("output_summary"), F.col("r.success").alias("success"), objective_kind().alias("objective_kind"),
    )
    calls = after.where("kind = 'call'").join(results, ["path", "call_id"], "left").groupBy("path").agg(F.transform(F.sort_array(F.collect_list(tool)), lambda t: t.dropFields("n")).alias("tools"))
    clean = lambda c: F.substring(redact(F.coalesce(c, F.lit(""))), 1, 5000)
    out = last.join(said, "path", "left").join(calls, "path", "left")
    return out.select("path", clean("user_text").alias("user_text"), clean("assistant_text").alias("assistant_text"), "tools", "source_turn_key", "previous_turn_key")


def read_turns(spark: SparkSession, paths: str | list[str], kind: str, frozen: DataFrame | None = None) -> DataFrame:
    return latest_turns(FORMATS[kind](tails(spark, paths, MAX_CODEX_BYTES if kind == "codex" else MAX_BYTES, frozen)))


def compilation_identity(turns: DataFrame) -> DataFrame:
    """Turns with source_hash and manifest_hash; a turn is learnt from once for each manifest."""
    source = F.sha2(F.concat_ws("\x1f", "user_text", "assistant_text", F.coalesce(F.to_json("tools"), F.lit("[]"))), 256)
    return turns.withColumn("source_hash", source).withColumn("manifest_hash", F.sha2(F.concat_ws("\x1f", "source_turn_key", "source_hash"), 256))
