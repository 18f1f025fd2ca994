"""Secret scans: keyword automaton, anchored expressions near its hits, checksum validation.

One Aho-Corasick pass over the ASCII-lowered text finds keywords and token
prefixes; a regular expression is tried only at such a place. Runs of hex digits
have no keyword and are found as runs in the batch's bytes. Tokens that carry a
checksum (CRC-32 in base 62) or a self-describing header are reported only if it
holds.

Defined results: a null text is empty and yields zero counts and empty strings;
a null doc_id passes through; repeated rows give equal rows.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import buffer_of, slices

#: Kinds in their order within one start: three base kinds, then the method's own.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ANCHORED = {
    "github": re.compile(r"gh[opsur]_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "npm": re.compile(r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "jwt": re.compile(r"eyJ[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+"),
    "pem": re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[0-9A-Za-z+/=\s]+-----END [A-Z ]{0,30}PRIVATE KEY-----"),
}
#: What the automaton looks for, in lower case, and the kind tried there.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "gho_": "github", "ghp_": "github", "ghr_": "github", "ghs_": "github", "ghu_": "github",
    "npm_": "npm", "eyj": "jwt", "-----begin ": "pem",
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX = np.zeros(256, bool)
HEX[list(b"0123456789abcdef")] = True
MIN_HEX, MIN_ACCESS, MIN_VALUE = 16, 18, 12
#: Characters of a web token's parts: a token starts only behind another character, so each run is tried once.
TOKEN = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_-")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


@cache
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def checksum_holds(token: str) -> bool:
    """Whether the last six base-62 digits are the CRC-32 of what stands between prefix and them."""
    body, digits = token[4:-6], token[-6:]
    value = 0
    for c in digits:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body.encode())


def header_holds(token: str) -> bool:
    """Whether a web token's first part decodes to a JSON object that names its algorithm."""
    head = token.split(".", 1)[0]
    try:
        found = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except ValueError:
        return False
    return isinstance(found, dict) and isinstance(found.get("alg"), str)


VALID = {"github": checksum_holds, "npm": checksum_holds, "jwt": header_holds, "pem": lambda token: True}


def keyword_spans(text: str, lowered: str) -> list[tuple[int, int, str]]:
    """Spans of all kinds but hex; leftmost and non-overlapping within each kind."""
    found: list[tuple[int, int, str]] = []
    done = dict.fromkeys(KINDS, 0)
    for last, (length, kind) in sorted(automaton().iter(lowered), key=lambda hit: hit[0] - hit[1][0]):
        start = last - length + 1
        if start < done[kind] or kind == "jwt" and start and text[start - 1] in TOKEN:
            continue
        m = (ASSIGN if kind == "assign" else ACCESS if kind == "access" else ANCHORED[kind]).match(text, start)
        if not m:
            continue
        if kind == "assign":
            good = len(m[1]) >= MIN_VALUE
        elif kind == "access":
            good = len(m[0]) >= MIN_ACCESS
        else:
            good = VALID[kind](m[0])
        if good or kind in ("assign", "access"):
            done[kind] = m.end()
        if good:
            found.append((m.start(), m.end(), kind))
    return found


def hex_runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end (bytes of the buffer) of each maximal run of at least 16 hex digits."""
    inside = HEX[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    long = end - start >= MIN_HEX
    start, end = start[long], end[long]
    return np.searchsorted(off, start, "right") - 1, start, end


def scan(docs: DataFrame) -> DataFrame:
    """Per document all spans as ``array<struct<kind, start, end>>`` (code points, end exclusive), in order."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffer_of(batch.column("text"))
            for i, j in slices(off):
                part, cut = data[off[i] : off[j]], off[i : j + 1] - off[i]
                runs: dict[int, list[tuple[int, int]]] = {}
                for d, s, e in zip(*(x.tolist() for x in hex_runs(part, cut)), strict=True):
                    runs.setdefault(d, []).append((s, e))
                rows = []
                whole = part.tobytes()
                lead = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
                for d in range(j - i):
                    raw = whole[cut[d] : cut[d + 1]]
                    text = raw.decode("utf-8", "replace")
                    spans = keyword_spans(text, raw.lower().decode("utf-8", "replace")) if raw else []
                    for s, e in runs.get(d, ()):
                        at = int(lead[s] - lead[cut[d]])
                        spans.append((at, at + e - s, "hex"))
                    spans.sort(key=lambda x: (x[0], KINDS.index(x[2])))
                    rows.append([{"kind": k, "start": s, "end": e} for s, e, k in spans])
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(i, j - i), "spans": pa.array(rows, kind)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        find, "doc_id long, spans array<struct<kind string, start long, end long>>"
    )


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the spans of ``scan``."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    of = lambda *kinds: F.filter("spans", lambda x: x.kind.isin(*kinds))
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(of(*KINDS[:3])), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )

