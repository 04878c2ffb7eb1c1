"""Secret scans with an incremental ledger of blobs.

Every version of a text is addressed by its SHA-256. The ledger holds a row for each (blob, rule version) that was ever
scanned, with its findings. A run scans only the pairs that the ledger lacks, appends them, and joins findings back to
every path (document row) that holds the blob. Copies are scanned once however many paths hold them, and a second run
over the same texts scans nothing. Copies collapse by a partial aggregation before the shuffle, so a blob that fills a
third of all rows is one row for each task.

The ledger is a folder of Parquet files in storage that all executors share, partitioned by rule version; a run writes a
new sub-folder, so a failed run leaves no half-written state that a later run would read.

A null text counts as empty. Repeated rows give a row each. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from moteflow.llm.common import shards, utf8
from moteflow.session import checkpoint_dir

RULES_VERSION = "3"
FINDING = "array<struct<kind:string,start:long,end:long>>"
#: Kinds in the order in which findings of one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "key-block", "host-token", "web-token")
BASE = KINDS[:3]
ASSIGN = re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
#: Fixed formats: armoured private keys, tokens of code hosts and chat services, signed web tokens.
MORE = (
    ("key-block", b"-----BEGIN ", re.compile(rb"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----)?")),
    ("host-token", b"_", re.compile(rb"gh[pousr]_[A-Za-z0-9]{36,}")),
    ("host-token", b"xox", re.compile(rb"xox[abpr]-[A-Za-z0-9-]{10,}")),
    ("web-token", b"eyJ", re.compile(rb"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
)
HINTS = (b"passw", b"secret", b"token", b"key")
_HEX_CLASS = bytes(49 if 48 <= c <= 57 or 97 <= c <= 102 else 48 for c in range(256))


def scan_text(text: bytes) -> list[tuple[str, int, int]]:
    """All findings in one text as (kind, start, end) in bytes. The quick tests before the patterns only skip
    patterns that cannot match."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if b"AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"1" * 16 in text.translate(_HEX_CLASS):
        out += [("hex", *m.span()) for m in HEX.finditer(text)]
    for kind, hint, pattern in MORE:
        if hint in text:
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return out


_TAIL_BYTES = bytes(range(128, 192))


def code_points(text: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans with byte offsets turned into code points; every byte is looked at once."""
    at, last, count = {}, 0, 0
    for p in sorted({p for _, *ends in spans for p in ends}):
        count += len(text[last:p].translate(None, _TAIL_BYTES))
        at[p], last = count, p
    return [(k, at[a], at[b]) for k, a, b in spans]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for shard in shards(batches, "text"):
        found = []
        for text in utf8(shard["text"]):
            spans = sorted(code_points(text, scan_text(text)), key=lambda x: (x[1], KINDS.index(x[0])))
            found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
        yield pa.RecordBatch.from_arrays([shard["blob"], pa.array(found, kind)], ["blob", "findings"])


def read_ledger(spark, ledger: str, rules: str = RULES_VERSION) -> DataFrame:
    """(blob, findings, run) of the rule version; empty where the ledger does not exist yet."""
    schema = f"blob binary, findings {FINDING}, rules string, run string"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(ledger) if there else spark.createDataFrame([], schema)
    return df.where(F.col("rules") == rules).select("blob", "findings", "run")


def scan_secrets(docs: DataFrame, ledger: str | None = None, rules: str = RULES_VERSION, key: str = "doc_id") -> DataFrame:
    """(``key``, blob, findings, scanned) for every row of ``docs``, after bringing the ledger up to date; ``scanned`` tells blobs that this run had to scan from those the ledger had."""
    spark, run = docs.sparkSession, uuid.uuid4().hex
    ledger = ledger or f"{checkpoint_dir(spark).rstrip('/')}/secret_ledger/{run}"
    text = F.coalesce("text", F.lit(""))
    paths = docs.select(F.col(key), F.unhex(F.sha2(text, 256)).alias("blob"))
    blobs = docs.select(F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    unseen = blobs.join(read_ledger(spark, ledger, rules).select("blob"), "blob", "left_anti")
    unseen.mapInArrow(_scan, f"blob binary, findings {FINDING}").withColumns({"rules": F.lit(rules), "run": F.lit(run)}).write.parquet(f"{ledger.rstrip('/')}/{run}")
    return paths.join(read_ledger(spark, ledger, rules), "blob").select(key, "blob", "findings", (F.col("run") == run).alias("scanned"))
