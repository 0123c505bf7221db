"""Session transcripts, ledgers, knowledge files and usage streams as DataFrames. A line that is no JSON is skipped, never fatal.

Files are read as text with their path, time and size, so a reader of any host is one scan, and the same select works on a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a turn is, whatever host it comes from.
TURN = "path string, session string, ts string, kind string, message_id string, text string, tool string, model string, tokens_in long, tokens_out long, cache_read long, cache_write long"
KINDS = ("user", "agent", "thinking", "tool_call", "shell_command", "file_edit", "todo")
_SHELL, _EDIT, _TODO = ("bash", "shell", "exec"), ("edit", "write", "multiedit", "apply_patch"), ("todowrite", "todo", "update_plan")


def json_lines(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    """path, mtime, size, j (the parsed line) of the lines that are JSON objects of the schema."""
    reader = spark.readStream if stream else spark.read
    lines = reader.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(path)
    rows = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("size"), F.trim("value").alias("value"))
    parsed = rows.filter(F.col("value").startswith("{")).withColumn("j", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.filter("j IS NOT NULL AND j._bad IS NULL").drop("value")


def _session(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.jsonl$", 1)


def tool_kind(tool: Column) -> Column:
    t = F.lower(tool)
    return F.when(t.isin(*_SHELL), "shell_command").when(t.isin(*_EDIT), "file_edit").when(t.isin(*_TODO), "todo").otherwise("tool_call")


def _turn(rows: DataFrame, **columns: Column) -> DataFrame:
    kinds = dict(x.strip().split(" ") for x in TURN.split(","))
    return rows.select(*[columns.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


_USAGE = "usage struct<input_tokens:long,output_tokens:long,cache_read_input_tokens:long,cache_creation_input_tokens:long>"
_BLOCK = "struct<type:string,text:string,thinking:string,name:string,id:string>"


def messages(spark: SparkSession, path: str) -> DataFrame:
    """Turns of logs whose lines hold a message with content blocks; parts of one message share its id and are told apart by their kind."""
    schema = f"type string, sessionId string, timestamp string, message struct<id:string,role:string,model:string,content:string,{_USAGE.replace('usage ', 'usage:', 1)}>"
    r = json_lines(spark, path, schema)
    m = F.col("j.message")
    # Content is a text or a list of blocks.
    listed = F.when(m["content"].startswith("["), F.from_json(m["content"], f"array<{_BLOCK}>"))
    blocks = F.coalesce(listed, F.array(F.struct(F.lit("text").alias("type"), m["content"].alias("text"), F.lit(None).cast("string").alias("thinking"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("id"))))
    b = r.select("path", "j", F.explode(blocks).alias("b"))
    m, b_ = F.col("j.message"), F.col("b")
    kind = F.when(b_["type"] == "thinking", "thinking").when(b_["type"] == "tool_use", tool_kind(b_["name"])).when(m["role"] == "user", "user").otherwise("agent")
    u = m["usage"]
    return _turn(
        b.filter(F.coalesce(F.col("b.type"), F.lit("")) != "tool_result"), path=F.col("path"), session=F.coalesce("j.sessionId", _session(F.col("path"))), ts=F.col("j.timestamp"), kind=kind, message_id=m["id"], text=F.coalesce(b_["text"], b_["thinking"]),
        tool=b_["name"], model=m["model"], tokens_in=u["input_tokens"], tokens_out=u["output_tokens"], cache_read=u["cache_read_input_tokens"], cache_write=u["cache_creation_input_tokens"],
    )


def rollout(spark: SparkSession, path: str) -> DataFrame:
    """Turns of logs of wrapped items ({type, payload}) and of bare ones ({type, role, content}); one read serves both wire formats."""
    item = "type string, role string, name string, text string, arguments string, model string"
    r = json_lines(spark, path, f"timestamp string, {item}, payload struct<{item.replace(' string', ':string')}>")
    p = {n: F.coalesce(F.col(f"j.payload.{n}"), F.col(f"j.{n}")) for n in ("type", "role", "name", "text", "arguments", "model")}
    call = p["type"].isin("function_call", "local_shell_call", "custom_tool_call")
    kind = F.when(p["type"] == "reasoning", "thinking").when(p["type"] == "local_shell_call", "shell_command").when(call, tool_kind(p["name"])).when(p["role"] == "user", "user").when(p["type"] == "message", "agent")
    out = _turn(r, path=F.col("path"), session=_session(F.col("path")), ts=F.col("j.timestamp"), kind=kind, text=F.coalesce(p["text"], p["arguments"]), tool=F.when(call, p["name"]), model=p["model"])
    return out.filter("kind IS NOT NULL")


def events(spark: SparkSession, path: str) -> DataFrame:
    """Turns of event logs ({type: "user.message", data: {...}})."""
    r = json_lines(spark, path, "type string, timestamp string, data struct<content:string,toolName:string,model:string>")
    t = F.col("j.type")
    kind = F.when(t == "user.message", "user").when(t == "assistant.message", "agent").when(t == "assistant.reasoning", "thinking").when(t == "tool.execution_start", tool_kind(F.col("j.data.toolName")))
    return _turn(r, path=F.col("path"), session=_session(F.col("path")), ts=F.col("j.timestamp"), kind=kind, text=F.col("j.data.content"), tool=F.col("j.data.toolName"), model=F.col("j.data.model")).filter("kind IS NOT NULL")


def parts(message: DataFrame, part: DataFrame) -> DataFrame:
    """Turns of a store of messages (id, session, role, model, ts) and parts (message_id, type, text, tool): parts and the messages without any."""
    j = message.join(part, message["id"] == part["message_id"])
    kind = F.when(F.col("type") == "reasoning", "thinking").when(F.col("type") == "tool", tool_kind(F.col("tool"))).when(F.col("role") == "user", "user").otherwise("agent")
    none = F.lit("")
    full = _turn(j, path=none, session=F.col("session"), ts=F.col("ts"), kind=kind, message_id=F.col("id"), text=F.col("text"), tool=F.col("tool"), model=F.col("model"))
    bare = message.join(part, message["id"] == part["message_id"], "left_anti")
    return full.unionAll(_turn(bare, path=none, session=F.col("session"), ts=F.col("ts"), kind=F.when(F.col("role") == "user", "user").otherwise("agent"), message_id=F.col("id"), model=F.col("model")))


def normalized(spark: SparkSession, path: str) -> DataFrame:
    """Turns of logs that are in this module's own form already."""
    r = json_lines(spark, path, TURN.removeprefix("path string, "))
    return r.select("path", "j.*").select(*[x.strip().split(" ")[0] for x in TURN.split(",")]).withColumn("session", F.coalesce("session", _session(F.col("path"))))


#: Host -> reader; hosts that write one form share its reader.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"messages": messages, "rollout": rollout, "events": events, "normalized": normalized}


def turns(spark: SparkSession, path: str, host: str) -> DataFrame:
    if host not in READERS:
        raise ValueError(f"unknown host {host!r}; have {sorted(READERS)}")
    return READERS[host](spark, path)


def detect(spark: SparkSession, path: str) -> DataFrame:
    """path, host of each file by the keys of its lines: the form that most of them have."""
    lines = spark.read.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(path).select(F.col("_metadata.file_path").alias("path"), "value")
    keys = F.json_object_keys("value")
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    host = F.when(has("message"), "messages").when(has("data"), "events").when(has("payload") | (has("type") & (has("role") | has("name"))), "rollout").when(has("kind"), "normalized")
    n = lines.groupBy("path", host.alias("host")).agg(F.count("*").alias("n")).filter("host IS NOT NULL")
    return n.groupBy("path").agg(F.max_by("host", F.struct("n", "host")).alias("host"))


def changed(spark: SparkSession, path: str, seen: DataFrame) -> DataFrame:
    """path, mtime, size of the files that are new or other than when they were seen (path, mtime, size)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(path)
    now = files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    return now.join(seen.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")


def usage(turned: DataFrame) -> DataFrame:
    """session, model, calls, tokens by class: repeated rows of one message retract earlier ones (the last by time counts)."""
    t = turned.filter("message_id IS NOT NULL AND coalesce(tokens_in, tokens_out, cache_read, cache_write) IS NOT NULL")
    names = ("tokens_in", "tokens_out", "cache_read", "cache_write")
    last = t.groupBy("session", "message_id").agg(F.max_by(F.struct("model", *names), F.struct("ts", *names)).alias("u"))
    return last.groupBy("session", F.col("u.model").alias("model")).agg(F.count("*").alias("calls"), *[F.sum(F.coalesce(f"u.{n}", F.lit(0))).alias(n) for n in names])


def ledger(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Rows of savings ledgers with path, mtime and size of their file; the session is the folder that holds it. Rows without a time are left out."""
    schema = "ts string, kind string, tool string, model string, tokens long, calls long, calls_usd double, cost_saved_usd double, est_cost_usd double, carry_usd double, carry_tokens long"
    r = json_lines(spark, path, schema, stream).select("path", "mtime", "size", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("session"), "j.*").drop("_bad")
    us = F.unix_micros(F.try_to_timestamp(F.regexp_replace("ts", r"(Z|[+-]00:00)$", "")))
    return r.withColumn("us", us).filter("us IS NOT NULL")


def live_events(spark: SparkSession, path: str) -> DataFrame:
    """session, events, tokens, calls, cost: one parse of the log serves every session."""
    r = json_lines(spark, path, "session_id string, tokens_saved long, calls_saved long, cost_saved_usd double").select("j.*")
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return r.filter("session_id IS NOT NULL").groupBy(F.col("session_id").alias("session")).agg(F.count("*").alias("events"), zero("tokens_saved").alias("tokens"), zero("calls_saved").alias("calls"), zero("cost_saved_usd").alias("cost"))


def prices(spark: SparkSession, catalog: str, overrides: DataFrame | None = None) -> DataFrame:
    """model, rates of a JSON price map ({model: {input, output, cache_read, cache_write}}); overrides (same columns) win."""
    text = spark.read.text(catalog, wholetext=True)
    cards = text.select(F.explode(F.from_json("value", "map<string,struct<input:double,output:double,cache_read:double,cache_write:double>>")).alias("model", "c")).select("model", "c.*")
    return cards if overrides is None else cards.join(overrides.select("model"), "model", "left_anti").unionByName(overrides)


def knowledge(spark: SparkSession, path: str) -> DataFrame:
    """path, id, title, domain, body of markdown files with a head of "key: value" lines between dashes; files without one have nulls."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n", "\n").alias("t"))
    head = F.regexp_extract("t", r"(?s)\A---\n(.*?)\n---\n", 1)
    key = lambda k: F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{k}:[ \t]*[\"']?(.*?)[\"']?[ \t]*$", 1)), F.lit(""))
    return files.select("path", key("id").alias("id"), key("title").alias("title"), key("domain").alias("domain"), F.regexp_replace("t", r"(?s)\A---\n.*?\n---\n", "").alias("body"))


def stream_usage(bodies: DataFrame) -> DataFrame:
    """request_id, model, tokens_in, tokens_out of response bodies (request_id, body): plain JSON or server-sent events, whose counters only grow."""
    lines = bodies.select("request_id", F.posexplode(F.split("body", "\n")).alias("i", "l"))
    data = F.when(F.col("l").startswith("data:"), F.trim(F.substring("l", 6, 1 << 30))).when(F.trim("l").startswith("{"), F.trim("l"))
    inner = "model string, usage struct<input_tokens:long,output_tokens:long,prompt_tokens:long,completion_tokens:long>"
    j = F.from_json(data, f"{inner}, message struct<{inner.replace('model string', 'model:string').replace('usage struct', 'usage:struct')}>")
    r = lines.select("request_id", "i", j.alias("j")).filter("j IS NOT NULL")
    u = lambda *names: F.max(F.coalesce(*[F.col(f"j.{at}usage.{n}") for n in names for at in ("", "message.")]))
    return r.groupBy("request_id").agg(F.max(F.coalesce("j.model", "j.message.model")).alias("model"), u("input_tokens", "prompt_tokens").alias("tokens_in"), u("output_tokens", "completion_tokens").alias("tokens_out"))


def tracked_lines(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """file, line_no, line of the files that a list (file) names, for text search; other files under the path are not read past their name."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    named = found.join(F.broadcast(files.select("file")), F.col("path").endswith(F.concat(F.lit("/"), F.col("file"))))
    return named.select("file", F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("n", "line")).select("file", (F.col("n") + 1).alias("line_no"), "line")
