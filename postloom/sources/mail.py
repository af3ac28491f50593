"""E-mail sources: single messages, folders and mbox files, parsed in Arrow batches."""

from __future__ import annotations

import email
import email.policy
import hashlib
import re
from collections.abc import Iterator
from datetime import UTC
from email.utils import getaddresses, parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OVERSIZE = 64 * 1024 * 1024
PARSED = (
    "blob_hash string, size bigint, content binary, error string, detail string, message_id string, subject string, from_name string, from_address string, sent_at string, in_reply_to string, refs array<string>, "
    "body_text string, html string, recipients array<struct<name:string,address:string,kind:string>>, attachments array<struct<att_index:int,filename:string,mime:string,content:binary>>, ord string"
)
_FIELDS = "blob_hash size content error detail message_id subject from_name from_address sent_at in_reply_to refs body_text html recipients attachments ord".split()
_POSTMARK = re.compile(rb"^From \S+ +(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) [A-Z][a-z]{2} +\d{1,2} \d{2}:\d{2}(?::\d{2})?(?: \S+)? \d{4}\s*$")


def split_mbox(data: bytes) -> list[bytes]:
    """Messages of an mbox file.

    A postmark must look like one and stand first or below a blank line; without any, the file is
    one message. The blank line before a postmark is dropped, one ``>`` of ``>From `` is taken off.
    """
    lines = data.split(b"\n")
    starts = [i for i, x in enumerate(lines) if _POSTMARK.match(x.rstrip(b"\r")) and (i == 0 or not lines[i - 1].strip(b"\r"))]
    if not starts:
        return [data] if data.strip() else []
    out = []
    for a, b in zip(starts, [*starts[1:], len(lines)]):
        part = lines[a + 1 : b]
        if part and not part[-1].strip(b"\r"):
            part = part[:-1]
        body = b"\n".join(x[1:] if x.startswith(b">From ") else x for x in part)
        if body.strip():
            out.append(body + b"\n")
    return out


def id_list(raw: str | None) -> list[str]:
    """Ids of a header: bracketed ones, else those between blanks, without brackets."""
    text = raw or ""
    found = re.findall(r"<([^<>\s]+)>", text)
    return [x for x in (found or [t.strip("<>") for t in text.split()]) if x]


def iso(raw: str | None) -> str | None:
    """RFC 822 date as ISO-8601 UTC with milliseconds; None if it is none."""
    try:
        d = parsedate_to_datetime(raw)
        d = d.replace(tzinfo=UTC) if d.tzinfo is None else d.astimezone(UTC)
        return d.strftime("%Y-%m-%dT%H:%M:%S.") + f"{d.microsecond // 1000:03d}Z"
    except Exception:  # noqa: BLE001
        return None


def _oversize(size: int) -> dict:
    return dict.fromkeys(_FIELDS) | {"size": size, "error": "oversize", "detail": f"{size} bytes", "refs": [], "body_text": "", "recipients": [], "attachments": []}


def parse(data: bytes) -> dict:
    """Fields of one message; ``error`` is oversize, parse_error or degenerate, else None."""
    row: dict = dict.fromkeys(("error", "detail", "message_id", "subject", "from_name", "from_address", "sent_at", "in_reply_to", "html"), None)
    row |= {"blob_hash": hashlib.sha256(data).hexdigest(), "size": len(data), "content": data, "refs": [], "body_text": "", "recipients": [], "attachments": []}
    if len(data) > OVERSIZE:
        return _oversize(len(data))
    try:
        m = email.message_from_bytes(data, policy=email.policy.default)
        ids = id_list(m["Message-ID"])
        sender = [(n, a) for n, a in getaddresses([str(m["From"] or "")]) if a]
        row["message_id"] = ids[0] if ids else f"synth-{row['blob_hash']}"
        row["subject"] = str(m["Subject"] or "")
        row["from_name"], row["from_address"] = sender[0] if sender else ("", "")
        row["sent_at"] = iso(str(m["Date"])) if m["Date"] else None
        row["in_reply_to"] = next(iter(id_list(str(m["In-Reply-To"] or ""))), None)
        row["refs"] = id_list(str(m["References"] or ""))
        seen = set()
        for kind in ("to", "cc", "bcc"):
            for n, a in getaddresses([str(v) for v in m.get_all(kind, [])]):
                if a and (a, kind) not in seen:
                    seen.add((a, kind))
                    row["recipients"].append({"name": n, "address": a, "kind": kind})
        plain, html = m.get_body(("plain",)), m.get_body(("html",))
        if plain is not None:
            row["body_text"] = plain.get_content().replace("\r\n", "\n")
        elif html is not None:
            row["html"] = html.get_content()
        for i, p in enumerate(m.iter_attachments()):
            payload = p.get_payload(decode=True) or b""
            row["attachments"].append({"att_index": i, "filename": p.get_filename() or "", "mime": p.get_content_type(), "content": payload})
    except Exception as x:  # noqa: BLE001
        return row | {"error": "parse_error", "detail": str(x)[:500]}
    if not ids and not sender and not row["sent_at"] and not (row["body_text"] + (row["html"] or "")).strip():
        row |= {"error": "degenerate", "detail": "no sender, date, body or id"}
    return row


def parsed(raw: DataFrame) -> DataFrame:
    """Parsed rows of (content, ord, length); files that are no mail come out with an error.

    Rows without content are files found too large before they were read, of ``length`` bytes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(parse(bytes(c)) if c is not None else _oversize(int(n))) | {"ord": o} for c, o, n in zip(b["content"], b["ord"], b["length"])]
            yield pd.DataFrame(out, columns=_FIELDS)

    return raw.select("content", "ord", "length").mapInPandas(run, PARSED)


def gated(files: DataFrame) -> DataFrame:
    """(content, ord, length) of a listing of files, ordered by path; of those above the size limit nothing is read."""
    small = files.filter(F.col("length") <= OVERSIZE).select("content", F.col("path").alias("ord"), "length")
    return small.unionByName(files.filter(F.col("length") > OVERSIZE).select(F.lit(None).cast("binary").alias("content"), F.col("path").alias("ord"), "length"))


def folder(spark: SparkSession, path: str) -> DataFrame:
    """(content, ord, length) of every .eml below a folder, ordered by path."""
    return gated(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.lower("path").endswith(".eml")))


def single(spark: SparkSession, path: str) -> DataFrame:
    """(content, ord, length) of one file."""
    return gated(spark.read.format("binaryFile").load(path))


def mbox(spark: SparkSession, path: str) -> DataFrame:
    """(content, ord, length) of every message of an mbox file or of all files of a folder, in order of path and place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(x, f"{p}#{i:012d}", len(x)) for c, p in zip(b["content"], b["path"]) for i, x in enumerate(split_mbox(bytes(c)))]
            yield pd.DataFrame(rows, columns=["content", "ord", "length"])

    return spark.read.format("binaryFile").load(path).select("content", "path").mapInPandas(run, "content binary, ord string, length bigint")


def pdf_text(data: bytes) -> tuple[str, dict]:
    """Text layer of a PDF: shown strings per page, pages parted by a blank line; "" without one."""
    import zlib

    pages = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m.group(1)
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        if b"BT" not in body:
            continue
        shown = re.findall(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|'|\")|\[((?:\\.|[^\]])*)\]\s*TJ", body)
        words = []
        for one, many in shown:
            parts = [one] if one else re.findall(rb"\(((?:\\.|[^\\()])*)\)", many)
            words.append(b"".join(re.sub(rb"\\([()\\])", rb"\1", p) for p in parts).decode("latin-1"))
        if words:
            pages.append(" ".join(w for w in words if w.strip()))
    return "\n\n".join(pages), {"pages": len(pages)}
