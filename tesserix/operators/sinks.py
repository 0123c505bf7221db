"""Write semantics over versioned Parquet tables: upserts, tombstones, unique inserts, counters, retention, markers, audit bundles.

A table is a folder of snapshots, each one Spark write; the latest complete one is the table. A write makes the next snapshot out of
the last one and the change, so readers see all of a change or none, and a task that runs twice leaves no trace.
"""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class ConcurrencyError(RuntimeError):
    """A row was written on another version than the stored one."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def snapshots(self) -> list[int]:
        """Numbers of the complete snapshots, in order."""
        fs, top = self._fs(self.path)
        if not fs.exists(top):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        done = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]
        return sorted(n for n in done if fs.exists(self._fs(f"{self.path}/v{n}/_SUCCESS")[1]))

    def read(self, snapshot: int | None = None) -> DataFrame:
        have = self.snapshots()
        if not have:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{have[-1] if snapshot is None else snapshot}")

    def replace(self, rows: DataFrame) -> None:
        """The rows as the next snapshot. A writer that was overtaken fails, as the folder of the number exists by then."""
        have = self.snapshots()
        names = self.read().columns
        rows.select(*names).write.mode("errorifexists").parquet(f"{self.path}/v{have[-1] + 1 if have else 0}")

    def vacuum(self, keep: int = 2) -> None:
        """Removes all snapshots but the latest few."""
        for n in self.snapshots()[:-keep]:
            fs, where = self._fs(f"{self.path}/v{n}")
            fs.delete(where, True)

    def upsert(self, rows: DataFrame, key: list[str], order: str) -> None:
        """Rows replace those of their key; of several of one key the last by order counts."""
        new = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")
        self.replace(self.read().join(new.select(*key), key, "left_anti").select(*self.read().columns).unionByName(new.select(*self.read().columns)))

    def upsert_checked(self, rows: DataFrame, key: list[str], history: VersionedTable, actor: str) -> None:
        """Rows (with version) replace those of their key if they know its stored version; then it is one more. Each change goes into the history.

        history: the key, prev_value, new_value, actor. One stale row stops the whole write.
        """
        old = self.read().select(*key, F.col("version").alias("_v"), F.col("value").alias("_was"))
        j = rows.join(old, key, "left")
        stale = j.filter("_v IS NOT NULL AND _v <> version").select(*key, "_v", "version").first()
        if stale:
            raise ConcurrencyError(f"stale version for {[stale[k] for k in key]}: expected {stale['_v']} got {stale['version']}")
        new = j.withColumn("version", F.when(F.col("_v").isNotNull(), F.col("_v") + 1).otherwise(F.col("version")))
        names = self.read().columns
        change = j.select(*key, F.coalesce("_was", F.lit("")).alias("prev_value"), F.col("value").alias("new_value"), F.lit(actor).alias("actor"))
        history.replace(history.read().unionByName(change))
        self.replace(self.read().join(rows.select(*key), key, "left_anti").select(*names).unionByName(new.select(*names)))

    def tombstone(self, keys: DataFrame, key: list[str], column: str, reason: str) -> None:
        """Marks rows as gone, with the reason; none is deleted, and one that is marked already keeps its first reason."""
        t = self.read()
        hit = keys.select(*key).distinct().withColumn("_hit", F.lit(True))
        self.replace(t.join(hit, key, "left").withColumn(column, F.when(F.col("_hit") & F.col(column).isNull(), F.lit(reason)).otherwise(F.col(column))))

    def insert_unique(self, rows: DataFrame, owner: str, text: str) -> DataFrame:
        """Rows whose (owner, digest of the text) is new go in. Returns every row with the id that holds it now and dedup_hit.

        Columns of the table: id, owner, text, digest; of several new rows of one digest the least id goes in.
        """
        digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
        new = rows.withColumn("digest", digest)
        old = self.read().select(owner, "digest", F.col("id").alias("_old"))
        first = Window.partitionBy(owner, "digest")
        j = new.join(old, [owner, "digest"], "left").withColumn("_held", F.coalesce("_old", F.min("id").over(first)))
        answer = j.select("id", F.col("_held").alias("held_by"), (F.col("_held") != F.col("id")).alias("dedup_hit"))
        fresh = j.filter("_old IS NULL AND _held = id").select(*self.read().columns)
        self.replace(self.read().unionByName(fresh))
        return answer

    def prune(self, keep) -> int:
        """Keeps the rows for which the expression holds or is null; returns how many went."""
        t = self.read()
        before = t.count()
        self.replace(t.filter(F.coalesce(keep, F.lit(True))))
        return before - self.read().count()


def counters(log: DataFrame, key: str) -> DataFrame:
    """key, usage, success, failure from an append-only log of outcomes: increments are rows, so two writers never lose one."""
    return log.groupBy(key).agg(F.count("*").alias("usage"), F.count_if(F.col("ok")).alias("success"), F.count_if(~F.col("ok")).alias("failure"))


def artifacts(rows: DataFrame, redact) -> DataFrame:
    """id, digests and byte counts of a text and of its redacted form."""
    t = F.coalesce("text", F.lit(""))
    clean = redact(t)
    return rows.select("id", F.sha2(t.cast("binary"), 256).alias("digest"), F.octet_length(t).alias("bytes"), F.sha2(clean.cast("binary"), 256).alias("redacted_digest"), F.octet_length(clean).alias("redacted_bytes"))


def search_document(traces: DataFrame, fields: list[str]) -> DataFrame:
    """id, document: the searchable fields of a trace, arrays and all, as one text."""
    parts = [F.array_join(F.col(f).cast("array<string>"), " ") if dict(traces.dtypes)[f].startswith("array") else F.col(f).cast("string") for f in fields]
    return traces.select("id", F.trim(F.regexp_replace(F.concat_ws(" ", *parts), r"\s+", " ")).alias("document"))


def inverted_index(documents: DataFrame) -> DataFrame:
    """term, id, n: postings of the documents; rebuilding those of an id is a write of its rows."""
    return documents.select("id", F.explode(F.regexp_extract_all(F.lower("document"), F.lit("[a-z0-9_]+"), 0)).alias("term")).groupBy("term", "id").agg(F.count("*").alias("n"))


def unsynced(rows: DataFrame, markers: DataFrame, key: str, payload: str) -> DataFrame:
    """Rows without a marker of their present payload."""
    digest = F.sha2(F.col(payload).cast("binary"), 256)
    return rows.withColumn("digest", digest).join(markers.select(key, "digest"), [key, "digest"], "left_anti")


def token_ledger(calls: DataFrame) -> str:
    """Calls and tokens of each tool as JSON, keys in order."""
    g = calls.groupBy("tool").agg(F.sum("tokens_in").alias("in"), F.sum("tokens_out").alias("out"), F.count("*").alias("calls"))
    return json.dumps({r["tool"]: {"in": r["in"], "out": r["out"], "calls": r["calls"]} for r in g.collect()}, sort_keys=True)


# Audit bundles and portable exports: a folder of JSON lines, and a manifest.


def _digests(spark: SparkSession, path: str) -> dict[str, str]:
    """SHA-256 of each data file, taken by the tasks that read them."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sums = [hashlib.sha256(c or b"").hexdigest() for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums)], names=["name", "digest"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return {r["name"]: r["digest"] for r in files.mapInArrow(run, "name string, digest string").collect()}


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def audit_export(rows: DataFrame, path: str, key: bytes) -> dict:
    """JSON lines, the SHA-256 of each file, and an HMAC over the manifest."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").json(f"{path}/data")
    body = {"files": _digests(spark, f"{path}/data"), "rows": rows.count()}
    text = json.dumps(body, sort_keys=True)
    manifest = {"manifest": body, "signature": hmac.new(key, text.encode(), hashlib.sha256).hexdigest()}
    _write_text(spark, f"{path}/manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest


def audit_verify(spark: SparkSession, path: str, key: bytes) -> list[str]:
    """What is wrong with a bundle: its signature, files that differ, are gone or came in. Empty if it is whole."""
    held = json.loads(_read_text(spark, f"{path}/manifest.json"))
    text = json.dumps(held["manifest"], sort_keys=True)
    bad = [] if hmac.compare_digest(held["signature"], hmac.new(key, text.encode(), hashlib.sha256).hexdigest()) else ["signature"]
    want, have = held["manifest"]["files"], _digests(spark, f"{path}/data")
    return bad + sorted(n for n in want.keys() | have.keys() if want.get(n) != have.get(n))


FORMAT = 1


def export_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Tables as Parquet with a manifest of format, rows and schema."""
    spark = next(iter(tables.values())).sparkSession
    about = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        about[name] = {"rows": df.count(), "schema": df.schema.simpleString()}
    _write_text(spark, f"{path}/manifest.json", json.dumps({"format": FORMAT, "tables": about}, sort_keys=True))


def import_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an export of this format, if all of its rows and columns are there."""
    held = json.loads(_read_text(spark, f"{path}/manifest.json"))
    if held.get("format") != FORMAT:
        raise ValueError(f"format {held.get('format')} is not {FORMAT}")
    out = {n: spark.read.parquet(f"{path}/{n}") for n in held["tables"]}
    for n, df in out.items():
        want = held["tables"][n]
        if df.schema.simpleString() != want["schema"] or df.count() != want["rows"]:
            raise ValueError(f"{n} is not what was exported")
    return out
