"""Secret scans through a ledger of blobs.

Every historical version of a file is addressed by the SHA-256 of its content.
The ledger is a Parquet table of (blob, rule_version, spans); a scan reads only
the (blob, rule version) pairs it lacks, appends what it found and joins the
findings back to all paths.  A blob that lies under many paths is scanned once,
and a second call over the same history scans nothing.

Text NULL counts as the empty text.  Positions are code points, ends exclusive.
Rows of any table stay as they are: repeated rows, NULL ids and extra columns
pass through, columns with the names of the result are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.text import in_small_batches
from nearfield.session import broadcast_limit, scratch_path


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int  # the group whose length counts
    least: int


# The base rules, in the order in which their kinds are listed.
RULES = (
    Rule(
        "assign",
        r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|"""
        r"""[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    Rule("access", r"(AKIA[A-Z0-9]+)", 1, 16),
    Rule("hex", r"([0-9a-f]{32,})", 1, 32),  # a shorter run fails anyway
)
KINDS = tuple(rule.kind for rule in RULES)
FOUND = "array<struct<kind:string,start:bigint,end:bigint>>"
BLOB_BYTES = 160
SPAN_BYTES = 64
LEDGER = f"blob string, rule_version string, spans {FOUND}"


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    """Changes with any rule, so a changed rule scans everything again."""
    return hashlib.sha256(repr([tuple(r) for r in rules]).encode()).hexdigest()[:16]


def find(text: bytes, compiled) -> list[tuple[str, int, int]]:
    """Spans of one text in code points, by start, then kind as listed."""
    found = []
    for order, (rule, pattern) in enumerate(compiled):
        for match in pattern.finditer(text):
            if match.end(rule.group) - match.start(rule.group) >= rule.least:
                found.append((match.start(), order, match.end(), rule.kind))
    if not found:
        return []
    found.sort()
    if not text.isascii():
        # Byte positions become code points in one sweep over the text.
        marks = sorted({p for start, _, end, _ in found for p in (start, end)})
        points, last, seen = {}, 0, 0
        for mark in marks:
            seen += len(text[last:mark].decode("utf-8"))
            points[mark], last = seen, mark
        found = [(points[start], order, points[end], kind) for start, order, end, kind in found]
    return [(kind, start, end) for start, _, end, kind in found]


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of (blob, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(rule, re.compile(rule.pattern.encode())) for rule in rules]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = [
                [{"kind": k, "start": a, "end": b} for k, a, b in find(value.as_py(), compiled)]
                for value in batch.column(1).cast(pa.binary())
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["blob", "spans"])

    return in_small_batches(blobs).select("blob", "text").mapInArrow(run, f"blob string, spans {FOUND}")


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(ledger)


def open_ledger(spark: SparkSession, ledger: str | None = None) -> str:
    """The ledger's path; it is made, empty, where there is none."""
    ledger = ledger or scratch_path(spark, "ledger")
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)
    return ledger


def update_ledger(
    docs: DataFrame, ledger: str, text: str = "text", rules: tuple[Rule, ...] = RULES
) -> None:
    """Scan the blobs of ``docs`` that the ledger lacks under these rules, and append them.

    One row of each blob is scanned.  Tasks keep one row per blob before anything is
    shuffled, so copies never gather; known blobs go first where the ledger is small
    enough to be shipped, else afterwards.
    """
    version = rule_version(rules)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(F.sha2(body.cast("binary"), 256).alias("blob"), body.alias("text"))
    known = read_ledger(docs.sparkSession, ledger).filter(F.col("rule_version") == version).select("blob")
    if known.count() * BLOB_BYTES <= broadcast_limit(docs.sparkSession):
        todo = texts.join(F.broadcast(known), "blob", "left_anti").dropDuplicates(["blob"])
    else:
        todo = texts.dropDuplicates(["blob"]).join(known, "blob", "left_anti")
    fresh = scan(todo, rules)
    fresh = fresh.withColumn("rule_version", F.lit(version)).select("blob", "rule_version", "spans")
    fresh.write.mode("append").parquet(ledger)


def _hits(spark: SparkSession, ledger: str, rules: tuple[Rule, ...]) -> DataFrame:
    """Blobs with findings, shipped to all tasks where they are few."""
    done = read_ledger(spark, ledger).filter(F.col("rule_version") == rule_version(rules))
    hits = done.filter(F.size("spans") > 0).select(F.col("blob").alias("_blob"), "spans").dropDuplicates(["_blob"])
    size = hits.agg(F.count("*") * BLOB_BYTES + F.sum(F.size("spans")) * SPAN_BYTES).first()[0] or 0
    return F.broadcast(hits) if size <= broadcast_limit(spark) else hits


def scan_paths(
    docs: DataFrame,
    ledger: str,
    text: str = "text",
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """``docs`` without ``text`` plus ``blob`` and ``spans``, one row per row of ``docs``."""
    update_ledger(docs, ledger, text, rules)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    paths = docs.withColumn("blob", F.sha2(body.cast("binary"), 256)).drop(text, "spans")
    out = paths.join(_hits(docs.sparkSession, ledger, rules), F.col("blob") == F.col("_blob"), "left").drop("_blob")
    return out.withColumn("spans", F.coalesce("spans", F.array().cast(FOUND)))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts by kind, and the spans as text: (key, n_assign, n_access, n_hex, base_sha256, spans)."""
    one = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    base = F.concat_ws(",", one)
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        key,
        *(number(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        base.alias("spans"),
    )


def redact(docs: DataFrame, ledger: str, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mask``; ``n_chars`` follows the text.

    Only rows with findings change; overlapping spans are masked as one.
    """
    hits = _hits(docs.sparkSession, ledger, RULES)
    blob = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    joined = docs.drop("spans").join(hits, blob == F.col("_blob"), "left")
    # The text is cut behind the last masked position, span by span.
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    piece = lambda acc, s: F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
    step = lambda acc, s: (
        F.when(s["start"] >= acc["at"], F.struct(F.concat(acc["out"], piece(acc, s), F.lit(mask)).alias("out"), s["end"].alias("at")))
        .otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))
    )
    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text")))
    clean = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.aggregate("spans", start, step, rest))
    out = joined.withColumn("text", clean)
    columns = [
        (F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("bigint").alias("n_chars"))
        if c == "n_chars"
        else F.col(c)
        for c in docs.columns
    ]
    return out.select(*columns)
