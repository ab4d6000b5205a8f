"""Execution traces: the stack of agents over ordered events, session logs, search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The tools that are agents of their own, and the agent outside all of them.
AGENTS = ("architect", "auditor", "engineer", "msbuild", "scout", "supervisor", "codebase_investigator")
OUTSIDE = "CLI"


def stack_depth(events: DataFrame, session: str, order: list[str], push: Column, pop: Column) -> DataFrame:
    """events with ``depth``, the height of a session's stack after each event.

    A pop of an empty stack does nothing, so the running sum is raised by its least value so far.
    """
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    move = F.when(push, 1).when(pop, -1).otherwise(0)
    summed = events.withColumn("__sum", F.sum(move).over(w))
    return summed.withColumn("depth", (F.col("__sum") - F.least(F.lit(0), F.min("__sum").over(w))).cast("long")).drop("__sum")


def agent_at(events: DataFrame, session: str, order: list[str], hook: str, tool: str, agents: tuple[str, ...] = AGENTS, outside: str = OUTSIDE) -> DataFrame:
    """events with ``agent`` and ``depth`` as seen while each event runs.

    A BeforeTool of an agent's tool puts it on the session's stack before the event counts,
    an AfterTool takes the top off after it.  So an event belongs to the top of the stack as
    high as it then is: the latest push that reached that height, found by a window over
    (session, height) rather than by a loop.  An agent's own events stand one level up, with
    what called it.
    """
    own = F.coalesce(F.col(tool).isin(*agents), F.lit(False))
    push, pop = own & (F.col(hook) == "BeforeTool"), own & (F.col(hook) == "AfterTool")
    deep = stack_depth(events.withColumn("__push", F.coalesce(push, F.lit(False))).withColumn("__pop", F.coalesce(pop, F.lit(False))), session, order, F.col("__push"), F.col("__pop"))
    before = F.coalesce(F.lag("depth").over(Window.partitionBy(session).orderBy(*order)), F.lit(0))
    high = deep.withColumn("__high", F.when(F.col("__pop"), before).otherwise(F.col("depth")))
    w = Window.partitionBy(session, "__high").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = F.last(F.when(F.col("__push"), F.col(tool)), ignorenulls=True).over(w)
    inside = F.col("__high") - F.when(own & F.col(hook).isNotNull(), 1).otherwise(0)
    return high.withColumn("agent", F.when(F.col("__high") == 0, F.lit(outside)).otherwise(top)).withColumn("depth", F.greatest(inside, F.lit(0)).cast("long")).drop("__push", "__pop", "__high")


def search(events: DataFrame, text: str, *columns: str) -> DataFrame:
    """Events whose named columns, joined and in lower case, contain the text."""
    return events.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower())))


def found(events: DataFrame, text: str, *columns: str) -> DataFrame:
    """shown and total: how many events ``search`` gives, of how many."""
    hit = F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower()))
    return events.agg(F.count_if(hit).alias("shown"), F.count("*").alias("total"))


def _there(value: Column) -> Column:
    """Whether JSON text is a value that counts as given: not missing, null, false, 0 or empty."""
    return F.coalesce(~value.isin("", "null", "false", "0"), F.lit(False))


def kind_of(content: Column | str) -> Column:
    """``trace`` for JSON lines whose first is a hook event, ``session`` for an object with a list of messages, else null."""
    c = F.col(content) if isinstance(content, str) else content
    first = F.trim(F.split(F.trim(F.btrim(c, F.lit(" \t\r\n"))), "\n")[0])
    hook = F.lit(False)
    for k in ("hook_event_name", "tool_name", "timestamp", "event"):
        hook = hook | _there(F.get_json_object(first, f"$.{k}"))
    listed = F.get_json_object(c, "$.messages").startswith("[")
    return F.when(F.try_parse_json(first).isNotNull() & hook, "trace").when(F.try_parse_json(c).isNotNull() & F.coalesce(listed, F.lit(False)), "session")


def summary(tool_input: Column | str, data: Column | None = None) -> Column:
    """One line for an event: its command, its instruction, or the head of the JSON of its input or data; else empty."""
    d = F.col(tool_input) if isinstance(tool_input, str) else tool_input
    command, instruction = F.get_json_object(d, "$.command"), F.get_json_object(d, "$.instruction")
    said = F.when(_there(command), F.concat(F.lit("$ "), command)).when(_there(instruction), F.concat(F.lit("Replace: "), instruction))
    return F.coalesce(said, F.substring(d, 1, 100), F.lit("") if data is None else F.substring(data, 1, 100), F.lit(""))


EVENT = "session, seq long, ts timestamp, type string, category string, summary string, agent string, depth long, is_error boolean, details string"


_FIELDS = ("timestamp", "hook_event_name", "tool_name", "tool_input", "tool_response", "data", "error", "event")


def read_trace(lines: DataFrame, agents: tuple[str, ...] = AGENTS) -> DataFrame:
    """EVENT rows of JSON lines (session, seq, value): malformed and blank lines are skipped.

    The fields of an object under ``data`` stand beside the line's own and win.  All fields of
    a line are taken in one parse, and those of its data in another.
    """
    sound = lines.where(F.json_object_keys("value").isNotNull() & F.try_parse_json("value").isNotNull())
    raw = sound.select("session", "seq", F.json_tuple("value", *_FIELDS).alias(*[f"__raw_{k}" for k in _FIELDS]))
    inner = F.when(F.col("__raw_data").startswith("{"), F.col("__raw_data"))
    both = raw.select("*", F.json_tuple(inner, *_FIELDS).alias(*[f"__in_{k}" for k in _FIELDS]))
    rows = both.select("session", "seq", *[F.coalesce(f"__in_{k}", f"__raw_{k}").alias(f"__{k}") for k in _FIELDS])
    seen = agent_at(rows, "session", ["seq"], "__hook_event_name", "__tool_name", agents)
    parts = [F.coalesce(F.from_json(x, "map<string,string>"), F.create_map().cast("map<string,string>")) for x in ("__tool_input", "__data")]
    answer = F.map_filter(F.create_map(F.lit("response"), F.col("__tool_response")), lambda _, v: v.isNotNull())
    details = F.to_json(F.map_from_entries(F.concat(*[F.map_entries(x) for x in _last_wins(*parts, answer)])))
    category = F.coalesce(*[F.when(_there(F.col(c)), F.col(c)) for c in ("__tool_name", "__hook_event_name")], F.lit("unknown"))
    error = _there(F.col("__error")) | F.coalesce(F.col("__event") == "ERROR", F.lit(False))
    return seen.select("session", "seq", F.try_to_timestamp("__timestamp").alias("ts"), F.lit("tool").alias("type"), category.alias("category"), summary("__tool_input", F.col("__data")).alias("summary"), "agent", "depth", error.alias("is_error"), details.alias("details"))


def _last_wins(*maps: Column) -> list[Column]:
    """The maps without the keys that a later one has."""

    def without(m: Column, later: Column) -> Column:
        return F.map_filter(m, lambda k, _: ~F.map_contains_key(later, k))

    return [reduce(without, maps[i + 1 :], m) for i, m in enumerate(maps)]


_THOUGHT = "struct<subject:string,description:string,timestamp:string>"
_CALL = "struct<name:string,args:string,timestamp:string,result:array<string>>"
MESSAGE = f"struct<type:string,timestamp:string,lastUpdated:string,content:string,thoughts:array<{_THOUGHT}>,toolCalls:array<{_CALL}>>"
_PART = "part:int,pos:int,ts:timestamp,type:string,category:string,summary:string,agent:string,depth:bigint,is_error:boolean"
#: What a summary of a tool's arguments begins with, by tool and argument.
_TOOL_HEADS = (("run_shell_command", "command", "$ "), ("replace", "instruction", "Replace: "), ("read_file", "file_path", "Read: "), ("write_file", "file_path", "Write: "))


def _tool_summary(name: Column, args: Column) -> Column:
    heads = [F.when((name == tool) & _there(F.get_json_object(args, f"$.{k}")), F.concat(F.lit(head), F.get_json_object(args, f"$.{k}"))) for tool, k, head in _TOOL_HEADS]
    return F.coalesce(*heads, F.substring(args, 1, 100))


def read_session(documents: DataFrame, model: str = "model") -> DataFrame:
    """Events of chat sessions, one JSON document (session, value) each, in the order session, msg, part, pos.

    A message of type user gives one event; one of type ``model`` gives its thoughts
    (depth 1), its tool calls (depth 1) each followed by their results (depth 2), and its
    content, if not empty.  Other messages give none.  A message's events are made together, so
    that the documents are read and parsed once.
    """
    parsed = documents.select("session", F.from_json("value", f"struct<messages:array<{MESSAGE}>>").alias("doc"))
    m = parsed.select("session", F.posexplode("doc.messages").alias("msg", "m"))
    at, none = F.col("m.timestamp"), F.array().cast(f"array<struct<{_PART}>>")

    def event(part: int, pos, ts: Column, kind: str, category, text: Column, agent: str, depth: int, error=False) -> Column:
        of = {"part": part, "pos": pos, "ts": F.try_to_timestamp(ts), "type": kind, "category": category, "summary": text, "agent": agent, "depth": depth, "is_error": error}
        return F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(n) for n, x in of.items()]).cast(f"struct<{_PART}>")

    def call(x: Column, i: Column) -> Column:
        ts = F.coalesce(x["timestamp"], at)

        def result(r: Column, k: Column) -> Column:
            answer = F.coalesce(F.get_json_object(r, "$.functionResponse.response"), r)
            failed = F.coalesce(F.get_json_object(r, "$.status") == "error", F.lit(False)) | _there(F.get_json_object(answer, "$.error"))
            return event(2, i * 1000 + 1 + k, ts, "tool_result", F.when(failed, "ERROR").otherwise("RESULT"), F.when(failed, "Tool Failed").otherwise("Tool Finished"), "System", 2, failed)

        tool = event(2, i * 1000, ts, "tool", x["name"], _tool_summary(x["name"], x["args"]), model, 1)
        return F.concat(F.array(tool), F.coalesce(F.transform(x["result"], result), none))

    thought = lambda x, i: event(1, i, F.coalesce(x["timestamp"], at), "thought", "THOUGHT", F.coalesce(F.nullif(x["subject"], F.lit("")), F.lit("Reasoning")), model, 1)
    user = F.array(event(0, 0, at, "user", "USER", F.col("m.content"), "User", 0))
    content = F.when(F.col("m.content") != "", F.array(event(3, 0, F.coalesce("m.lastUpdated", at), "assistant", "RESPONSE", F.col("m.content"), model, 0)))
    said = [F.transform("m.thoughts", thought), F.flatten(F.transform("m.toolCalls", call)), content]
    parts = [F.when(F.col("m.type") == "user", user), *[F.when(F.col("m.type") == model, x) for x in said]]
    return m.select("session", "msg", F.inline(F.concat(*[F.coalesce(x, none) for x in parts])))
