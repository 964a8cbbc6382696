"""Secret scans with multipart credential linking."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketflow.llm.text import map_batches

#: The base patterns, and how long a match must be.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20
_HINT = re.compile(r"pass|secret|token|api", re.IGNORECASE | re.ASCII)

#: Weak parts, each common in clean text: an identifier, a secret-like run, an endpoint.
WEAK_ID = re.compile(r"""\b(?:user(?:name)?|login|client_?id|access_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,64})""", re.IGNORECASE | re.ASCII)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]{0,39}[0-9])(?=[^a-z]{0,39}[a-z])(?=[^A-Z]{0,39}[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}", re.ASCII)
ENDPOINT = re.compile(r"\b[a-z][a-z0-9+]{1,9}://[^\s\"'<>]{4,}|\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?\b", re.ASCII)
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
#: Parts are linked if this many code points at most lie between them and no blank line does.
SCOPE = 200



def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping per kind."""
    found = []
    if _HINT.search(text):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def linked_spans(text: str, base: list[tuple[int, int, str]], scope: int = SCOPE) -> list[tuple[int, int, str]]:
    """Weak parts that have a complementary part in their scope.

    Each part is an interval; the parts are sorted by start and joined with those that begin
    at most `scope` after them. A weak secret needs an identifier or endpoint, a weak
    identifier a secret, an endpoint a secret together with an identifier. Base spans count as secrets
    (access keys as identifiers too), so that they lend weight but never depend on others.
    """
    weak = [(m.start(), m.end(), "weak_secret") for m in WEAK_SECRET.finditer(text)]
    if not weak and not base:
        return []
    weak += [(m.start(), m.end(), "weak_id") for m in WEAK_ID.finditer(text)]
    weak += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
    if not weak:
        return []
    parts = sorted(base + weak)
    breaks = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    sides: list[set[str]] = [set() for _ in parts]
    for i, (start, end, kind) in enumerate(parts):
        for j in range(i + 1, len(parts)):
            start_j, end_j, kind_j = parts[j]
            if start_j > end + scope:
                break
            at = bisect_left(breaks, start)
            if at < len(breaks) and breaks[at] < start_j:
                break
            if start_j >= end:
                sides[i].add(kind_j)
                sides[j].add(kind)
    secret, ident = {"assign", "hex", "weak_secret"}, {"access", "weak_id"}
    kept = []
    for (start, end, kind), near in zip(parts, sides):
        if kind == "weak_secret" and near & (ident | {"endpoint"}):
            kept.append((start, end, kind))
        elif kind == "weak_id" and near & secret:
            kept.append((start, end, kind))
        elif kind == "endpoint" and near & secret and near & ident:
            kept.append((start, end, kind))
    return [x for x in kept if not any(b[0] < x[1] and x[0] < b[1] for b in base)]


def all_spans(text: str | None, scope: int = SCOPE) -> list[tuple[int, int, str]]:
    """Base and linked spans by start, then kind as in KINDS."""
    text = text or ""
    base = base_spans(text)
    return sorted(base + linked_spans(text, base, scope), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """documents -> doc_id, n_assign, n_access, n_hex, base_sha256, spans; one row per document, over its whole text.

    Base spans always stay; the linking step adds weak parts that occur with complementary
    ones. All parts of a credential lie in one document, so the join needs no shuffle.
    Null or empty text: no spans, the digest of the empty string. Extra columns are not read.
    """

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for value in batch.column(1):  # one text at a time
            text = value.as_py()
            spans = all_spans(text, scope)
            base = [x for x in spans if x[2] in KINDS[:3]]
            for k in KINDS[:3]:
                out[f"n_{k}"].append(sum(x[2] == k for x in base))
            out["base_sha256"].append(hashlib.sha256(digest(base).encode()).hexdigest())
            out["spans"].append(digest(spans))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, k) for v, k in zip(out.values(), kinds)]], ["doc_id", *out])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, each, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, mark: str = "<secret>", scope: int = SCOPE) -> DataFrame:
    """documents with every reported span replaced by `mark`; n_chars follows the new text. Null text stays null."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = []
        for value in batch.column("text"):
            text = value.as_py()
            if text:
                out, at = [], 0
                for start, end, _ in sorted(all_spans(text, scope)):
                    if start >= at:
                        out += [text[at:start], mark]
                    at = max(at, end)
                text = "".join([*out, text[at:]])
            texts.append(text)
        i = batch.schema.get_field_index("text")
        yield batch.set_column(i, pa.field("text", pa.string()), pa.array(texts, pa.string()))

    out = map_batches(docs.withColumn("text", F.col("text").cast("string")), each, docs.withColumn("text", F.col("text").cast("string")).schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
