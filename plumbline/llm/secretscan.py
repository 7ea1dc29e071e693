"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by its text's SHA-256. Only pairs of blob and rule version that the ledger
lacks are scanned, one copy each; findings are joined back to all paths that hold the blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shared

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Further kinds: (kind, a literal that each match holds, pattern).
_MORE = [
    ("pem", "PRIVATE KEY-----", re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END (?:[A-Z0-9]+ ){0,4}PRIVATE KEY-----)?")),
    ("git", "gh", re.compile(r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}")),
    ("chat", "xox", re.compile(r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}")),
    ("pay", "k_live_", re.compile(r"(?<![A-Za-z0-9])[sr]k_live_[A-Za-z0-9]{16,}")),
    ("cloud", "AIza", re.compile(r"(?<![A-Za-z0-9_-])AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])")),
    ("jwt", "eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
]
KINDS = ["assign", "access", "hex", *[kind for kind, _, _ in _MORE]]
BASE = KINDS[:3]
#: Counts changes of the scan that the patterns don't show: flags, least lengths, which texts are looked at.
SCAN = "2"
#: Changes with any rule, so that blobs are scanned anew.
RULE_VERSION = hashlib.sha256("\n".join([SCAN, _ASSIGN.pattern, _ACCESS.pattern, _HEX.pattern, *[p.pattern for _, _, p in _MORE]]).encode()).hexdigest()[:16]

_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
_LITERALS = tuple(literal.encode() for _, literal, _ in _MORE if literal != "gh") + (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_", b"AKIA")
_HEX_BYTES = np.zeros(256, bool)
_HEX_BYTES[list(b"0123456789abcdef")] = True


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then by kind as listed in KINDS."""
    spans = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    for kind, literal, pattern in _MORE:
        if literal in text:
            spans += [(kind, *m.span()) for m in pattern.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _suspects(docs: list[bytes]) -> list[bool]:
    """Whether a text may hold a secret: literals by substring search, long hex runs by every fourth byte."""
    sizes = np.array([len(d) for d in docs], np.int64)
    starts = np.cumsum(sizes) - sizes
    fourth = _HEX_BYTES[np.frombuffer(b"".join(docs), np.uint8)[::4]]
    run = np.flatnonzero(fourth[:-3] & fourth[1:-2] & fourth[2:-1] & fourth[3:]) * 4 if len(fourth) > 3 else np.zeros(0, np.int64)
    hexed = np.zeros(len(docs), bool)
    if len(run):
        hexed[np.searchsorted(starts, run, "right") - 1] = True
        hexed[np.searchsorted(starts, run + 12, "right") - 1] = True
    out = []
    for doc, suspect in zip(docs, hexed):
        suspect = bool(suspect) or any(x in doc for x in _LITERALS)
        if not suspect:
            low = doc.lower()
            suspect = any(x in low for x in _WORDS)
        out.append(suspect)
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs = shared.as_bytes(batch["text"])
        found = [find_secrets(d.decode()) if suspect else [] for d, suspect in zip(docs, _suspects(docs))]
        spans = pa.array([[f"{k}:{a}:{b}" for k, a, b in x] for x in found], pa.list_(pa.string()))
        yield pa.record_batch({"blob": batch["blob"], "found": spans})
    shared.release()


def addressed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and its blob address."""
    return shared.texts(docs).withColumn("blob", F.unhex(F.sha2("text", 256)))


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """Rows that the ledger (blob, rule_version, found) lacks: each unseen blob once, with its findings (none: [])."""
    versions = addressed(docs)
    unseen = versions.groupBy("blob").agg(F.min("doc_id").alias("rep_id"))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rule_version).select("blob")
        unseen = unseen.join(seen, "blob", "left_anti")
    # the copy to scan is found by id, not by shuffling texts to their address, where a third of all rows may meet
    same = (versions["doc_id"].eqNullSafe(unseen["rep_id"])) & (versions["blob"] == unseen["blob"])
    once = versions.join(unseen.hint("shuffle_hash"), same, "left_semi")
    scanned = once.mapInArrow(_scan, "blob binary, found array<string>")
    return scanned.groupBy("blob").agg(F.min("found").alias("found")).select("blob", F.lit(rule_version).alias("rule_version"), "found")


def findings(docs: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """(doc_id, blob, found) for every row of docs; found is null if the ledger lacks its blob."""
    known = ledger.where(F.col("rule_version") == rule_version).select("blob", "found")
    return addressed(docs).select("doc_id", "blob").join(known, "blob", "left").select("doc_id", "blob", "found")


def scan_secrets(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Findings of each row of docs, scanning only what the ledger lacks.

    A null text is empty; rows that repeat, and null ids, get rows of their own. An empty table gives none. Returns
    doc_id, counts by base kind, base_sha256 and spans as strings; other columns of docs are not read.
    """
    new = shared.written(update_ledger(docs, ledger))  # read twice, and joined where one blob may have many paths
    ledger = new if ledger is None else ledger.select("blob", "rule_version", "found").unionByName(new)
    found = findings(docs, ledger).withColumn("base", F.filter("found", lambda s: F.substring_index(s, ":", 1).isin(*BASE)))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: F.substring_index(s, ":", 1) == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(F.concat_ws(",", "base"), 256).alias("base_sha256"), F.concat_ws(",", "found").alias("spans"), F.hex("blob").alias("blob"))


def _redacted(mark: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = shared.unpacked(batch["row"], names)
            texts = row["text"].to_pylist()
            for i, found in enumerate(batch["found"].to_pylist()):
                if found and texts[i]:
                    spans = sorted(tuple(map(int, s.split(":")[1:])) for s in found)
                    parts, at = [], 0
                    for a, b in spans:
                        if a >= at:
                            parts += [texts[i][at:a], mark]
                        at = max(at, b)
                    texts[i] = "".join(parts) + texts[i][at:]
            yield pa.record_batch({n: pa.array(texts, pa.string()) if n == "text" else row[n] for n in names})
        shared.release()

    return run


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every secret in its texts replaced by mark; its columns, of any names, and texts without secrets stay as they are.

    A null text stays null; rows that repeat are redacted alike, and null ids count for nothing; an empty table stays empty.
    """
    known = shared.written(update_ledger(docs).where(F.size("found") > 0)).select("blob", "found")
    row = docs.select(shared.packed(docs).alias("row"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("blob"))
    marked = row.join(F.broadcast(known) if _small(known) else known, "blob", "left").select("row", "found")
    return marked.mapInArrow(_redacted(mark, docs.columns), docs.schema)


#: Blobs with findings up to which redact() broadcasts them (a few hundred bytes each).
MOST_BROADCAST = 20_000


def _small(known: DataFrame) -> bool:
    return known.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
