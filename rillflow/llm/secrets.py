"""Secret scans: an Aho-Corasick automaton finds keywords, anchored expressions run only at its hits, checksums confirm.

The keywords are the credential names, the access-key prefix, the prefixes of tokens that carry a checksum
and every four hexadecimal digits, so that each run of sixteen or more holds hits from its fourth digit on.
"""

from __future__ import annotations

import hashlib
import re
import string
import zlib
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import bounded_batches, hold, id_and_text

#: In the order in which spans of the same start are listed.
KINDS = ("assign", "access", "hex", "checked")
CREDENTIAL_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Prefixes of tokens whose last six base-62 digits are the CRC-32 of the thirty before them.
CHECKED_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_TO_LOWER = dict(zip(map(ord, string.ascii_uppercase), string.ascii_lowercase, strict=True))


def _automaton():
    """The keywords' automaton, one in a Python worker until another operator works there."""
    return hold("secrets", _build)


def _build():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word in CREDENTIAL_NAMES:
        a.add_word(word, ("assign", len(word)))
    a.add_word("akia", ("access", 4))
    for prefix in CHECKED_PREFIXES:
        a.add_word(prefix, ("checked", 4))
    hexadecimal = ("hex", 4)
    for digits in product("0123456789abcdef", repeat=4):
        a.add_word("".join(digits), hexadecimal)
    a.make_automaton()
    return a


def checksum62(payload: str) -> str:
    """The six base-62 digits of the CRC-32 of ``payload``, leading zeros kept."""
    n, digits = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        digits = BASE62[r] + digits
    return digits


def scan(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` in code points, by start and then in the order of ``KINDS``."""
    low = text.lower()
    if len(low) != len(text):  # a few capitals become two code points
        low = text.translate(_TO_LOWER)
    done = dict.fromkeys(KINDS, 0)
    found = []
    hits = sorted({(i - n + 1, kind) for i, (kind, n) in _automaton().iter(low)})
    for start, kind in hits:
        if start < done[kind]:
            continue
        if kind == "hex":
            if m := _HEX.match(text, start):
                found.append((start, m.end(), kind))
                done[kind] = m.end()
        elif kind == "access":
            if m := _ACCESS.match(text, start):
                done[kind] = m.end()
                if m.end() - start >= 18:
                    found.append((start, m.end(), kind))
        elif kind == "assign":
            if m := _ASSIGN.match(text, start):
                done[kind] = m.end()
                if len(m[1]) >= 12:
                    found.append((start, m.end(), kind))
        elif (m := _CHECKED.match(text, start)) and checksum62(m[1]) == m[2]:
            found.append((start, m.end(), kind))
            done[kind] = m.end()
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """``text`` with each span, or chain of overlapping spans, replaced by ``mark``."""
    out, at, last = [], 0, -1
    for start, end, _ in spans:
        if start >= last:
            out += [text[at:start], mark]
        last = at = max(last, end)
    return "".join([*out, text[at:]])


def _report(spans) -> dict:
    lines = [f"{kind}:{start}:{end}" for start, end, kind in spans]
    base = [x for x in lines if not x.startswith("checked:")]
    count = lambda k: sum(x[2] == k for x in spans)
    return {"n_assign": count("assign"), "n_access": count("access"), "n_hex": count("hex"), "n_checked": count("checked"), "base_sha256": hashlib.sha256(",".join(base).encode()).hexdigest(), "spans": ",".join(lines)}


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: counts by kind, the digest of the base spans, and all spans.

    Null and empty texts have no spans; repeated rows and null ids are reported like any others; other
    columns are not read. A map over partitions: nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_report(scan(t)) for t in b.column("text").to_pylist()]
            cols = {k: pa.array([r[k] for r in rows], pa.string() if k in ("base_sha256", "spans") else pa.int64()) for k in ("n_assign", "n_access", "n_hex", "n_checked", "base_sha256", "spans")}
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols.values()], names=["doc_id", *cols])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with its columns, every secret in ``text`` replaced by ``mark`` (null stays null).

    ``n_chars``, where there is one, is counted anew for changed texts.
    """
    names = docs.columns

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else redact(t, spans, mark) if (spans := scan(t)) else t)

    new = bounded_batches(docs).withColumn("__rf_text", clean("text"))
    changed = ~F.col("__rf_text").eqNullSafe(F.col("text"))
    cols = [F.col("__rf_text").alias("text") if c == "text" else F.when(changed, F.length("__rf_text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in names]
    return new.select(*cols)
