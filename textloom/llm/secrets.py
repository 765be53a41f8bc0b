"""Secret scan: exact base patterns plus spans tagged by a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, raw
from .crf import KEYWORDS, B, Crf, I, features, trained

#: Kinds of spans in the order in which they are listed.
KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
_HEX_MAP = bytes(1 if chr(c) in "0123456789abcdef" else 0 for c in range(256))
_HEX_RUN = b"\x01" * 24
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_VALUE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Token classes that a worker remembers, and bytes of text that are tagged together.
_MEMO, _TOGETHER = 400_000, 2 << 20


def base_spans(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, in bytes; leftmost, non-overlapping within a kind.

    The cheap tests in front only skip texts that a pattern cannot match in.
    """
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if _HEX_RUN in (mapped := text.translate(_HEX_MAP)):
        at = mapped.find(_HEX_RUN)
        while at >= 0:
            end = _HEX.match(text, at).end()
            out.append(("hex", at, end))
            at = mapped.find(_HEX_RUN, end)
    return out


class _Classes(dict):
    """Token to its row of the model's table; forgets all when it holds too many."""

    def __init__(self, model: Crf):
        super().__init__()
        self.model, self.rows, self.known = model, [], {}

    def __missing__(self, token: bytes) -> int:
        mask = features(token)
        if (row := self.known.get(mask)) is None:
            row = self.known[mask] = len(self.rows)
            self.rows.append(self.model.table(mask))
        self[token] = row
        return row


def tagged(texts: list[bytes], model: Crf, classes: _Classes) -> dict[int, list[tuple[int, int]]]:
    """Byte spans that the model tags, by position of the text."""
    words = [t.split() for t in texts]
    starts = np.cumsum([0, *map(len, words)])
    if not starts[-1]:
        return {}
    ids = np.fromiter((k for ws in words for k in map(classes.__getitem__, ws)), np.int32, starts[-1])
    if len(classes) > _MEMO:
        classes.clear()
    table = np.stack(classes.rows)
    full = [k for k, ws in enumerate(words) if ws]
    keyword = np.array([not KEYWORDS.isdisjoint(words[k]) for k in full], float)
    starts = starts[:-1][full]
    states = model.decode(model.emissions(table[ids], starts, np.stack([np.ones(len(full)), keyword, 1 - keyword], 1)), starts)
    out: dict[int, list[tuple[int, int]]] = {}
    hits = np.flatnonzero(states)
    for n in np.unique(np.searchsorted(starts, hits, side="right") - 1).tolist():
        text, mine = texts[full[n]], states[starts[n] : starts[n] + len(words[full[n]])].tolist()
        spans: list[list[int]] = []
        for k, m in enumerate(_WORD.finditer(text)):
            if mine[k] == B or mine[k] == I and (not k or not mine[k - 1]):
                spans.append([*m.span()])
            elif mine[k] == I:
                spans[-1][1] = m.end()
        for a, b in spans:
            inner = text[a:b]
            left = len(inner) - len(inner.lstrip(bytes(set(range(256)) - set(_VALUE))))
            right = len(inner.rstrip(bytes(set(range(256)) - set(_VALUE))))
            if right > left:
                out.setdefault(full[n], []).append((a + left, a + right))
    return out


def _points(text: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans in code points; byte offsets lie on character borders."""
    if text.isascii():
        return spans
    at, seen, n = {}, 0, 0
    for k in sorted({x for _, a, b in spans for x in (a, b)}):
        n += len(text[seen:k].decode("utf-8", "replace"))
        at[k], seen = n, k
    return [(kind, at[a], at[b]) for kind, a, b in spans]


def scan(texts: list[bytes], model: Crf, classes: _Classes) -> list[list[tuple[str, int, int]]]:
    """All spans of each text in code points, by start, then kind as listed.

    A span of the model that lies inside a base span says nothing new and is left out.
    """
    more = tagged(texts, model, classes)
    out = []
    for k, text in enumerate(texts):
        spans = base_spans(text)
        spans += [("crf", a, b) for a, b in more.get(k, ()) if not any(x <= a and b <= y for _, x, y in spans)]
        spans.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
        out.append(_points(text, spans) if spans else spans)
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """Return ``(id, spans)`` for every row; spans is an array of (kind, start, end) in code points, end exclusive.

    Null and empty texts have no spans. Each row is scanned alone, so repeated rows and ids give repeated
    results; null ids stay null. Other columns are not read. An empty table gives an empty result. The model
    depends on ``seed`` alone.
    """
    bound_batches(docs.sparkSession)
    model = trained(seed)
    kind = "array<struct<kind:string,start:int,end:int>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _Classes(model)
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            group = np.cumsum(sizes) // _TOGETHER
            for cut in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(group)) + 1):
                part = batch.slice(int(cut[0]), len(cut)) if len(cut) else batch
                found = scan(part.column(1).to_pylist(), model, classes)
                rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, arrow)], names=["id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("id"), raw(text_col).alias("t")).mapInArrow(mapped, f"id long, spans {kind}")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", seed: int = 7) -> DataFrame:
    """``docs`` with every found span of ``text_col`` replaced by ``mark``; all rows and columns stay.

    Spans that touch or overlap are replaced by one mark. A null text stays null.
    """
    bound_batches(docs.sparkSession)
    model = trained(seed)

    def cleaned(texts: Iterator) -> Iterator:
        import pandas as pd

        classes = _Classes(model)
        for batch in texts:
            whole = [t if isinstance(t, str) else None for t in batch.tolist()]
            found = scan([(t or "").encode() for t in whole], model, classes)
            yield pd.Series([_without(t, s, mark) for t, s in zip(whole, found, strict=True)])

    from pyspark.sql.functions import pandas_udf
    from pyspark.sql.types import StringType

    clean = pandas_udf(cleaned, StringType(), functionType=204)
    return docs.withColumn(text_col, clean(F.col(text_col)))


def _without(text: str | None, spans: list[tuple[str, int, int]], mark: str) -> str | None:
    if not spans:
        return text
    parts, at = [], 0
    for _, a, b in spans:
        if a > at or not parts:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Contract query: counts and digests of the spans in every document."""
    from .common import table

    found = find_secrets(table(spark, sf_dir, "documents"))
    joined = lambda only: F.array_join(F.transform(only, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select(F.col("id").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
