"""Encoded spans in byte buffers: finding, decoding, and where decoded bytes come from.

Each decoder gives the decoded bytes and, for each of them, the place of its first and
behind its last encoded byte, so spans in the decoded text map back exactly.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np

URL = re.compile(rb"[A-Za-z0-9%+\-_.~:/?#\[\]@!$&'()*,;=]+")
BASE64 = re.compile(rb"[A-Za-z0-9+/\-_](?:[\n\r\t]*[A-Za-z0-9+/\-_])*(?:[\n\r\t]*=){0,2}")
BASE64_SPACED = re.compile(rb"[A-Za-z0-9+/\-_](?:[\n\r\t ]*[A-Za-z0-9+/\-_])*(?:[\n\r\t ]*=){0,2}")
#: Bytes that base64 can be written in.
LINE, SPACED = rb"A-Za-z0-9+/\-_=\n\r\t", rb"A-Za-z0-9+/\-_=\n\r\t "
#: Budgets are for stretches of as many bytes as the reference's chunks have.
STRETCH = 64 * 1024
HEX = {c: int(chr(c), 16) for c in b"0123456789abcdefABCDEF"}
SIX = {c: k for k, c in enumerate(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")} | {ord("-"): 62, ord("_"): 63}


#: The value of each byte in base64; 64 for a pad, -1 for any other.
VALUES = np.array([SIX.get(c, 64 if c == 0x3D else -1) for c in range(256)], np.int16)


@dataclass(frozen=True)
class Decoded:
    data: bytes
    first: np.ndarray
    behind: np.ndarray

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The encoded span of decoded bytes start to end."""
        if end <= start:
            at = int(self.first[start]) if start < len(self.first) else int(self.behind[-1]) if len(self.behind) else 0
            return at, at
        return int(self.first[start]), int(self.behind[end - 1])


class Spans:
    """Spans of a buffer, at most ``most`` (None: all) that begin in each stretch of ``stretch`` bytes; ``dropped`` counts the others."""

    def __init__(self, most: int | None, stretch: int):
        self.most, self.stretch, self.kept, self.held, self.dropped = most, stretch, [], Counter(), 0

    def add(self, start: int, end: int) -> None:
        if self.most is None or self.held[start // self.stretch] < self.most:
            self.held[start // self.stretch] += 1
            self.kept.append((start, end))
        else:
            self.dropped += 1

    def told(self, dropped: Counter | None, kind: str) -> list[tuple[int, int]]:
        if dropped is not None and self.dropped:
            dropped[kind] += self.dropped
        return self.kept


def url_spans(data: bytes, least: int = 16, longest: int = 65536, most: int | None = None, plus: bool = False, dropped: Counter | None = None) -> list[tuple[int, int]]:
    """Runs of URL characters with an escape, split at ``longest``; ``most`` of each ``STRETCH``."""
    out = Spans(most, STRETCH)
    if b"%" not in data and not (plus and b"+" in data):
        return []
    for m in URL.finditer(data):
        for at in range(m.start(), m.end(), longest):
            end = min(at + longest, m.end())
            piece = data[at:end]
            if end - at >= least and (b"%" in piece or (plus and b"+" in piece)):
                out.add(at, end)
    return out.told(dropped, "URL spans")


def url_decode(data: bytes, plus: bool = False) -> Decoded:
    """%HH to a byte; invalid escapes stay as they are; + to a space only if asked for."""
    out, first, behind = bytearray(), [], []
    k, n = 0, len(data)
    while k < n:
        c, size = data[k], 1
        if c == 0x25 and k + 2 < n + 0 and data[k + 1] in HEX and data[k + 2] in HEX:
            c, size = HEX[data[k + 1]] * 16 + HEX[data[k + 2]], 3
        elif plus and c == 0x2B:
            c = 0x20
        out.append(c)
        first.append(k)
        k += size
        behind.append(k)
    return Decoded(bytes(out), np.array(first, np.int64), np.array(behind, np.int64))


def base64_spans(data: bytes, least: int = 32, longest: int = 65536, most: int | None = None, spaces: bool = False, dropped: Counter | None = None) -> list[tuple[int, int]]:
    """Runs of the two base64 alphabets with white space inside and up to two pads; ``most`` of each ``STRETCH``."""
    out = Spans(most, STRETCH)
    # Most words are too short: runs of the alphabet that are long enough come first, and spans lie within them.
    letters = SPACED if spaces else LINE
    for run in re.finditer(rb"(?<![%s])[%s]{%d,}+" % (letters, letters, least), data):
        for m in (BASE64_SPACED if spaces else BASE64).finditer(data, run.start(), run.end()):
            for at in range(m.start(), m.end(), longest) if m.end() - m.start() >= least else ():
                end = min(at + longest, m.end())
                if end - at >= least and (end - at) - sum(data.count(c, at, end) for c in (b"\n", b"\r", b"\t", b" ")) >= least:
                    out.add(at, end)
    return out.told(dropped, "base64 spans")


def base64_decode(data: bytes, shift: int = 0) -> Decoded | None:
    """Decode after skipping ``shift`` characters; None for a lone last character or data after a pad."""
    codes = VALUES[np.frombuffer(data, np.uint8)]
    places = np.flatnonzero(codes >= 0)[shift:]
    body = places[codes[places] < 64]
    if len(body) % 4 == 1 or (places[: len(body)] != body).any():
        return None
    six = codes[body].astype(np.uint32)
    size = len(six) * 6 // 8
    six = np.concatenate([six, np.zeros(-len(six) % 4, np.uint32)]).reshape(-1, 4)
    whole = six[:, 0] << 18 | six[:, 1] << 12 | six[:, 2] << 6 | six[:, 3]
    out = np.stack([whole >> 16 & 255, whole >> 8 & 255, whole & 255], 1).astype(np.uint8).ravel()[:size]
    at = np.array(body, np.int64)
    k = np.arange(size)
    last = np.minimum(-(-(k + 1) * 8 // 6) - 1, len(at) - 1)
    return Decoded(out.tobytes(), at[k * 8 // 6], at[last] + 1)


def base64_shifts(data: bytes, least: int = 32) -> list[int]:
    """Alignments worth trying: a run's own, and those of a run that begins in other text."""
    n = int((np.abs(VALUES[np.frombuffer(data, np.uint8)] - 31.5) < 32).sum())
    return [s for s in range(4) if n - s >= least]


def utf16_decode(data: bytes, big: bool) -> Decoded:
    """UTF-16 as UTF-8 with U+FFFD for what isn't; an odd last byte is dropped."""
    data = data[: len(data) & ~1]
    text = data.decode("utf-16-be" if big else "utf-16-le", "replace")
    out, first, behind, at = bytearray(), [], [], 0
    for c in text:
        b, size = c.encode(), 4 if ord(c) > 0xFFFF else 2
        out += b
        first += [at] * len(b)
        at = min(at + size, len(data))
        behind += [at] * len(b)
    return Decoded(bytes(out), np.array(first, np.int64), np.array(behind, np.int64))


def utf16_decode_long(data: bytes, big: bool, size: int) -> Decoded:
    """``utf16_decode`` of successive pieces of about ``size`` bytes, joined; no pair of surrogates is cut."""
    parts, at = [], 0
    while at == 0 or at < len(data) & ~1:
        end = min(len(data), at + max(4, size & ~1))
        if end < len(data) - 1 and 0xD8 <= data[end - 2 if big else end - 1] <= 0xDB:
            end -= 2
        parts.append((at, utf16_decode(data[at:end], big)))
        at = max(end, 1)
    return Decoded(b"".join(d.data for _, d in parts), np.concatenate([d.first + k for k, d in parts]).astype(np.int64), np.concatenate([d.behind + k for k, d in parts]).astype(np.int64))
