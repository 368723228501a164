"""Secrets in whole texts: fixed patterns, and strings that a tokenizer needs too many tokens for.

Patterns (each leftmost and non-overlapping for itself): assignments to names of secrets, access key ids and long
runs of hex digits.  The *token-efficiency* test looks at every run of at least ``min_run`` characters that keys are
made of: a public byte-level vocabulary learned ordinary words, so a run with few characters a token is a random
string, with or without digits; names joined of words have many.  Known digests (hex of the length of a usual digest),
UUIDs and runs without a letter (numbers, rules) are left out.  Where a pattern has found a part of a run already, each
part beside it that is as long as a run is tested by itself.

Cases: a null text is empty and has no span; repeated rows, null ids and extra columns are carried along; offsets are
code points of the whole text, ends exclusive; a text of one long run is one candidate.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spanloom.llm.arrowmap import append_struct
from spanloom.llm.textnp import Texts, code_points_before, lut, words_of

# The patterns, and the order of kinds.
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
KINDS = ["assign", "access", "hex", "random"]
#: Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_SIZES = {32, 40, 56, 64, 96, 128}
UUID = re.compile(rb"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
RUN = lut(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
LETTER = lut(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
VOCABULARY = os.environ.get("SPANLOOM_TIKTOKEN", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How byte-level BPE cuts a text before merging: contractions, words, numbers, the rest, white space (fixed value).
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def is_known(run: bytes) -> bool:
    """A digest, a UUID or a number: not a secret by itself."""
    if UUID.fullmatch(run) or not re.search(rb"[A-Za-z]", run):
        return True
    return len(run) in DIGEST_SIZES and re.fullmatch(rb"[0-9a-f]+|[0-9A-F]+", run) is not None


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, number of kind, end) of the patterns' matches, in bytes."""
    out = []
    if b":" in raw or b"=" in raw:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(raw)]
    return sorted(out)


def outside(start: int, end: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of a run that no span covers; spans in order of their starts."""
    out = []
    for a, _, b in spans:
        if a >= end:
            break
        if a > start:
            out.append((start, a))
        start = max(start, b)
    return [*out, (start, end)] if start < end else out


def scanner(vocabulary: str, min_run: int, max_ratio: float, mask: str | None):
    """A function for append_struct; with ``mask``, also the text with all spans replaced by it."""

    def scan(texts: Texts) -> list:
        points = code_points_before(texts)
        runs = words_of(texts, RUN)
        long = runs.end - runs.start >= min_run
        letters = np.concatenate([[0], np.cumsum(LETTER[texts.data])])
        long &= letters[runs.end] > letters[runs.start]
        doc = runs.doc[long]
        by_doc: dict[int, list[tuple[int, int]]] = {}
        for d, s, e in zip(doc.tolist(), runs.start[long].tolist(), runs.end[long].tolist(), strict=True):
            by_doc.setdefault(d, []).append((s, e))
        counts = np.zeros((3, len(texts)), dtype=np.int64)
        shas, all_spans, masked = [], [], []
        for d in range(len(texts)):
            at, raw = int(texts.offsets[d]), texts.bytes_of(d)
            base = base_spans(raw)
            more = []
            for s, e in by_doc.get(d, ()):
                for a, b in outside(s - at, e - at, base):
                    run = raw[a:b]
                    if len(run) < min_run or is_known(run):
                        continue
                    if len(run) <= max_ratio * len(encoding(vocabulary).encode_ordinary(run.decode())):
                        more.append((a, 3, b))
            origin = points[at]

            def said(spans, at=at, origin=origin) -> str:
                return ",".join(f"{KINDS[k]}:{points[at + a] - origin}:{points[at + b] - origin}" for a, k, b in spans)

            for _, k, _ in base:
                counts[k, d] += 1
            spans = sorted(base + more)
            shas.append(hashlib.sha256(said(base).encode()).hexdigest())
            all_spans.append(said(spans))
            if mask is not None:
                out, done = [], 0
                for a, _, b in spans:
                    if a >= done:
                        out += [raw[done:a].decode(), mask]
                    done = max(done, b)
                masked.append("".join(out) + raw[done:].decode())
        return [*counts, shas, all_spans, *([masked] if mask is not None else [])]

    return scan


def scan_secrets(docs: DataFrame, name: str, text: str = "text", vocabulary: str = VOCABULARY, min_run: int = 20, max_ratio: float = 2.0, mask: str | None = None) -> DataFrame:
    """``docs`` and a struct column ``name``: n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, joined by
    commas) and, with ``mask``, masked.  max_ratio: characters a token up to which a run counts as random."""
    fields = [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    if mask is not None:
        fields.append(T.StructField("masked", T.StringType()))
    return append_struct(docs, text, name, scanner(vocabulary, min_run, max_ratio, mask), T.StructType(fields))
