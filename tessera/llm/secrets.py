"""Secret scans over a ledger of content-addressed blobs.

A text is a blob, named by its SHA-256. The ledger has a row for every (blob, rule version) scanned so far, findings or not.
A run scans only blobs without such a row, each once however many documents carry it, and joins the findings of old and new
blobs back to every document. Base rules are fixed by contract; the others add spans and never take any away.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, narrow
from tessera.llm.sharing import FREQUENT, DigestFilter, digest_filter, join_by_key

#: Changes whenever a rule does, so that blobs scanned under older rules are scanned again.
RULE_VERSION = "3"
BASE = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: A byte that is a hex digit becomes 1; 32 of these in a row are worth the slower pattern.
_IS_HEX = bytes(49 if c in b"0123456789abcdef" else 48 for c in range(256))
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----")
#: What a key without its END line has after the first one: header lines, then lines of base64 alone or long runs of it between
#: blanks. Line ends may be escaped, as in JSON.
_BREAK = r"(?:[ \t]*+(?:\r?\n|\\r\\n|\\n)[ \t]*+)"
_BASE64 = re.compile(
    rf"(?:{_BREAK}[A-Za-z0-9-]++:[ ][^\n\\]*+)*+"
    rf"(?:{_BREAK}++[A-Za-z0-9+/]++={{0,2}}(?={_BREAK}|[ \t]*+$)|(?:\s|\\[rn])*+[A-Za-z0-9+/]{{24,}}+={{0,2}}(?:[ \t][A-Za-z0-9+/]++={{1,2}})?)*+",
    re.A,
)


class _Pem:
    """A private key from its BEGIN line through the matching END line, to the end of its base64 where that is missing."""

    @staticmethod
    def spans(text: str) -> list[tuple[int, int]]:
        out = []
        for m in _PEM.finditer(text):
            stop = text.find("-----BEGIN ", m.end())
            last = f"-----END {m[1]}PRIVATE KEY-----"
            at = text.find(last, m.end(), stop if stop >= 0 else len(text))
            out.append((m.start(), at + len(last) if at >= 0 else _BASE64.match(text, m.end()).end()))
        return out


#: Kind, a part that any match contains, pattern.
MORE = (
    ("pem", "PRIVATE KEY-----", _Pem),
    ("jwt", "eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", re.A)),
    ("forge", "gh", re.compile(r"\bgh[opsur]_[A-Za-z0-9]{36,}", re.A)),
    ("chat", "xox", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}", re.A)),
    ("bearer", "earer ", re.compile(r"\b[Bb]earer\x20+[A-Za-z0-9._~+/=-]{20,}", re.A)),
    ("url", "://", re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]*+:[^\s:/@]++@", re.A)),
)
KINDS = (*BASE, *(k for k, _, _ in MORE))
#: Blobs that a worker remembers to have handed on; beyond that it may hand one on again.
GIVEN = 100_000
_LEDGER = "blob binary, rule_version string, base string, spans string"


def find(text: str) -> list[tuple[int, int, str, int]]:
    """(start, place of the kind, kind, end) in code points, end exclusive, sorted."""
    out = []
    low = text.lower()
    if any(x in low for x in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, "access", m.end()) for m in _ACCESS.finditer(text)]
    if b"1" * 32 in text.encode("utf-8", "surrogatepass").translate(_IS_HEX):
        out += [(m.start(), 2, "hex", m.end()) for m in _HEX.finditer(text)]
    for k, (kind, part, pattern) in enumerate(MORE, len(BASE)):
        if part in text:
            spans = pattern.spans(text) if pattern is _Pem else (m.span() for m in pattern.finditer(text))
            out += [(s, k, kind, e) for s, e in spans]
    return sorted(out)


def _spans(text: str) -> tuple[str, str]:
    """The base spans and all spans, as kind:start:end, comma-joined."""
    found = find(text)
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in found if k in BASE), ",".join(f"{k}:{s}:{e}" for s, _, k, e in found)


def _scan(batches):
    for batch in batches:
        found = [_spans(t or "") for t in batch.column(1).to_pylist()]
        columns = [batch.column(0), pa.array([RULE_VERSION] * len(batch), pa.string()), *(pa.array([f[i] for f in found], pa.string()) for i in (0, 1))]
        yield pa.RecordBatch.from_arrays(columns, ["blob", "rule_version", "base", "spans"])


def blob_of(text: Column | str) -> Column:
    """A text's content address; a null text is an empty one."""
    return F.unhex(F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256))


class _Sorter:
    """Tells apart, by filters, blobs that no ledger has (`unseen`; None: all) and those that may be read more than once."""

    def __init__(self, unseen: DigestFilter | None, apart: DigestFilter) -> None:
        self.unseen, self.apart = unseen, apart
        self.given: set[bytes] = set()

    def sort(self, texts: list[bytes | None]) -> tuple[list[bytes], list[str]]:
        """Blobs, and what becomes of each text: scanned here (`scan`), once for all that have it (`give`), or not again (`pass`)."""
        blobs = [hashlib.sha256(t or b"").digest() for t in texts]
        new = self.unseen.contains(blobs) if self.unseen else [True] * len(blobs)
        out = []
        for blob, fresh, apart in zip(blobs, new, self.apart.contains(blobs), strict=True):
            if not fresh or blob in self.given:
                out.append("pass")
            elif apart:
                if len(self.given) >= GIVEN:
                    self.given.clear()
                self.given.add(blob)
                out.append("give")
            else:
                out.append("scan")
        return blobs, out


def _read(unseen, apart, text: int, change: bool):
    """Scans each batch's texts where it may. Adds blob, base, spans and, where another task scans it, the text; the column itself
    is redacted where it was scanned (`change`) or goes."""

    def run(batches):
        sorter = _Sorter(unseen and unseen.value, apart.value)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = part.column(text).cast(pa.binary()).to_pylist()
                blobs, way = sorter.sort(texts)
                texts = [None if t is None else t.decode("utf-8", "replace") for t in texts]
                found = [_spans(t or "") if w == "scan" else (None, None) for t, w in zip(texts, way, strict=True)]
                columns, names = part.columns, part.schema.names
                if not change:
                    del columns[text], names[text]
                else:
                    columns[text] = pa.array([_cut(t, f[1]) for t, f in zip(texts, found, strict=True)], pa.string())
                given = [t or "" if w == "give" else None for t, w in zip(texts, way, strict=True)]
                more = [pa.array(blobs, pa.binary()), *(pa.array([f[i] for f in found], pa.string()) for i in (0, 1)), pa.array(given, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *more], [*names, "blob", "base", "spans", "given"])

    return run


def _scanned(docs: DataFrame, text: str, ledger: DataFrame | None, change: bool) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Rows of docs with row, blob, base and spans, null where another row or the ledger has them; the new ledger rows; what is
    known of the blobs of those rows (blob, n, base, spans), if anything was found; the number of rows."""
    spark = docs.sparkSession
    blobs = materialize(docs.groupBy(blob_of(text).alias("blob")).agg(F.count("*").alias("n")), "blobs")
    n_rows = blobs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = spark.sparkContext.broadcast
    if ledger is None:
        unseen, fresh = None, blobs
        apart = share(digest_filter(blobs.where("n > 1").select("blob")))
    else:
        ledger = ledger.where(F.col("rule_version") == RULE_VERSION).select("blob", "rule_version", "base", "spans")
        known = ledger.select("blob")
        fresh = materialize(blobs.join(known, "blob", "left_anti"), "unseen")
        apart = share(digest_filter(blobs.join(known, "blob", "left_semi").select("blob").union(fresh.where("n > 1").select("blob"))))
        unseen = share(digest_filter(fresh.select("blob")))
    at = docs.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if change or f.name != text) + ", blob binary, base string, spans string, given string"
    rows = docs.mapInArrow(_read(unseen, apart, at, change), schema)
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "read")
    given = rows.where("given is not null").groupBy("blob").agg(F.first("given").alias("given"))
    if ledger is not None:
        given = given.join(fresh.select("blob"), "blob", "left_semi")
    once = rows.where("spans is not null").select("blob", F.lit(RULE_VERSION).alias("rule_version"), "base", "spans")
    new = materialize(once.union(given.mapInArrow(_scan, _LEDGER)), "ledger")
    known = new if ledger is None else new.union(ledger)
    found = known.select("blob", F.col("base").alias("base_"), F.col("spans").alias("spans_")).join(blobs, "blob")
    found = found.where((F.col("spans_") != "") | (F.col("n") >= n_rows * FREQUENT))  # frequent ones are not to be joined in vain
    return rows.drop("given"), new, found, n_rows


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The rows that the ledger lacks for docs(text): (blob, rule_version, base, spans), one for each unseen blob."""
    return scan(docs, ledger)[1]


def scan(docs: DataFrame, ledger: DataFrame | None = None, **ids: str) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) -> (findings of every document, new ledger rows).

    Findings: doc_id, blob, base, spans; a row for each input row, null doc_ids and repeated rows included. Spans are
    kind:start:end, by start, then kind, comma-joined, in code points of the whole text; empty where nothing was found. Null and
    empty texts are the empty blob. ids: other columns and their types to carry instead of doc_id, as the path and version of
    each blob. Extra columns are ignored; an empty table gives empty ones.

    Digests are grouped, texts are not: a blob that one row has is scanned where it is read. Only blobs that several rows may
    have are shuffled, one text of each from a task.
    """
    ids = ids or {"doc_id": "long"}
    docs = narrow(docs, text="string", **ids)
    rows, fresh, found, n_rows = _scanned(docs, "text", ledger, False)
    out = join_by_key(rows, found, "blob", n_rows)
    return out.select(*ids, "blob", *[F.coalesce(c, f"{c}_", F.lit("")).alias(c) for c in ("base", "spans")]), fresh


def scan_into(docs: DataFrame, ledger_path: str, **ids: str) -> DataFrame:
    """Findings as of scan(), against the ledger kept at a path, to which the new rows are added.

    A run that fails adds nothing. With ids path="string", version="string", docs are all versions of all files: those that an
    earlier run has seen are not scanned again, and the findings join back to every path and version.
    """
    spark = docs.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger_path)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    out, fresh = scan(docs, spark.read.schema(_LEDGER).parquet(ledger_path) if there else None, **ids)
    out = materialize(out, "findings")
    fresh.write.mode("append").parquet(ledger_path)
    return out


def report(findings: DataFrame) -> DataFrame:
    """Counts by base kind and the digest of the base spans, with all spans."""
    items = F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ","))
    count = lambda kind: F.size(F.filter(items, lambda x: x.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")
    return findings.select("doc_id", *[count(k) for k in BASE], F.sha2("base", 256).alias("base_sha256"), "spans")


def _cut(text: str | None, spans: str | None) -> str | None:
    """The text with <kind> in the place of each span; of spans that overlap, what an earlier one covers goes with that."""
    if not spans or text is None:
        return text
    out, end = [], 0
    for kind, s, e in (x.split(":") for x in spans.split(",")):
        if int(e) <= end:
            continue
        out += [text[end : max(end, int(s))], f"<{kind}>" if int(s) >= end else ""]
        end = int(e)
    return "".join([*out, text[end:]])


def _redact(at: int):
    def run(batches):
        for batch in batches:
            spans = batch.column(batch.schema.get_field_index("spans_")).to_pylist()
            columns = batch.columns[: batch.schema.get_field_index("blob")]
            columns[at] = pa.array([_cut(t, s) for t, s in zip(columns[at].to_pylist(), spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[: len(columns)])

    return run


def redact(docs: DataFrame) -> DataFrame:
    """docs(text) with every span found replaced by <kind>; other columns and documents as they are, n_chars set anew.

    Null and empty texts stay as they are, repeated rows and extra columns too, whatever their names; an empty table gives an
    empty one.
    """
    at = docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    rows, _, found, n_rows = _scanned(plain, f"c{at}", None, True)
    done = rows.where("spans is not null").select(plain.columns)
    left = join_by_key(rows.where("spans is null").select(*plain.columns, "blob", "row"), found, "blob", n_rows)
    out = done.union(left.mapInArrow(_redact(at), plain.schema))
    for i in [i for i, c in enumerate(docs.columns) if c == "n_chars"]:
        kind = docs.schema[i].dataType
        out = out.withColumn(f"c{i}", F.when(F.col(f"c{at}").isNotNull(), F.length(f"c{at}").cast(kind)).otherwise(F.col(f"c{i}")))
    return out.toDF(*docs.columns)
