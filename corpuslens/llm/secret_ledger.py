"""Secret scans with an incremental blob ledger.

Every version of every path is content-addressed: its blob is the SHA-256 of its whole text.  The
ledger is a Parquet table of (blob, rule version) pairs with their findings; a scan reads it,
scans only pairs it lacks, appends these, and joins the findings of all blobs back to all paths.
A blob that occurs many times is scanned once: copies are dropped inside each task before the
texts are dealt out by blob, so that a hot blob sends one row from each task.

Rules: the base kinds (assignments of secrets, access keys, long hexadecimal runs) and, added by
this operator, private key blocks and signed web tokens.  A new rule version makes all its pairs
unseen and leaves those of earlier versions in the ledger.

Edge cases: a null text is an empty blob without findings; repeated rows each get the findings of
their blob; null ids stay null; an empty table gives an empty result and ledger entry; other
columns stay (``blob`` and ``findings`` are replaced).  Spans are half-open, in code points, of the whole match.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.llm import common

#: Names the rules below in the ledger; a change of the rules takes a new name.
RULE_VERSION = "base+pem+jwt/1"
#: Fixed patterns of the base kinds, in the order that settles equal starts.
ASSIGN = r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]*PRIVATE KEY-----"
JWT = r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "jwt")

LEDGER_SCHEMA = ("blob string, rule_version string, "
                 "findings array<struct<kind: string, start: int, end: int>>")


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all findings, by start and then by kind as listed.

    Runs of a class of characters are maximal, so the least length stands in the pattern; an
    assignment that is too short still uses up its characters.
    """
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= LEAST_ASSIGN]
    for kind, pattern in _OTHERS:
        found += [(kind, *m.span()) for m in pattern.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


_ASSIGN = re.compile(ASSIGN)
_OTHERS = [("access", re.compile(f"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}")), ("hex", re.compile(f"[0-9a-f]{{{LEAST_HEX},}}")),
           ("pem", re.compile(PEM)), ("jwt", re.compile(JWT))]


def _blobs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each blob once a task, as far as the task's memory of digests goes."""
    seen: set[bytes] = set()
    for batch in batches:
        out = []
        for text in batch["__cl_text"]:
            digest = hashlib.sha256(text.encode("utf-8", "surrogatepass"))
            if digest.digest() not in seen:
                seen.add(digest.digest())
                out.append((digest.hexdigest(), text))
        yield pd.DataFrame(out, columns=["blob", "content"])


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: set[str] = set()
    for batch in batches:
        out = []
        for blob, text in zip(batch["blob"], batch["content"], strict=True):
            if blob not in seen:
                seen.add(blob)
                out.append((blob, RULE_VERSION, [{"kind": k, "start": s, "end": e} for k, s, e in find(text)]))
        yield pd.DataFrame(out, columns=["blob", "rule_version", "findings"])


def scan(versions: DataFrame, text: str = "text", ledger: str | None = None) -> DataFrame:
    """All columns of ``versions`` with their blob and its findings.

    ``ledger`` is the ledger's folder, kept from scan to scan; without one a new ledger is begun in
    the shared folder.  The texts are read once for the blobs to scan and once for the addresses.
    """
    spark = versions.sparkSession
    ledger = ledger or common.scratch_path(spark, "ledger")
    spark.createDataFrame([], LEDGER_SCHEMA).write.mode("append").parquet(ledger)
    known = spark.read.schema(LEDGER_SCHEMA).parquet(ledger).where(F.col("rule_version") == RULE_VERSION)
    contents = versions.select(common.whole_text(text).alias("__cl_text"))
    blobs = contents.mapInPandas(_blobs, "blob string, content string")
    unseen = blobs.join(known.select("blob"), "blob", "left_anti")
    unseen.repartition("blob").mapInPandas(_scan, LEDGER_SCHEMA).write.mode("append").parquet(ledger)
    spark.catalog.refreshByPath(ledger)
    known = spark.read.schema(LEDGER_SCHEMA).parquet(ledger).where(F.col("rule_version") == RULE_VERSION)
    # A scan that was cut off while it appended may have left a blob twice; findings are the same.
    findings = known.where(F.size("findings") > 0).select("blob", "findings").dropDuplicates(["blob"])
    paths = versions.drop("blob", "findings").withColumn("blob", F.sha2(common.whole_text(text).cast("binary"), 256))
    return paths.join(findings, "blob", "left").withColumn(
        "findings", F.coalesce("findings", F.array().cast("array<struct<kind:string,start:int,end:int>>")))


def joined(findings: Column) -> Column:
    """kind:start:end of each finding, comma-joined."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
