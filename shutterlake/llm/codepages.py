"""Code-page swaps: the ways in which bytes of one encoding, read in another, turn letters into others."""

from __future__ import annotations

import codecs
import re
from functools import lru_cache

# Encodings that texts are commonly read in by mistake, and encodings that they are commonly written in.
READ_AS = "cp1252 latin_1 cp1250 cp1251 cp1253 cp1254 cp1257 iso8859_2 iso8859_5 iso8859_7 iso8859_9 iso8859_15 mac_roman mac_cyrillic cp437 cp850 cp852 cp866 koi8_r".split()
WRITTEN_IN = [*READ_AS, "cp1258", "shift_jis", "euc_jp", "gbk", "big5", "euc_kr"]
WIDE = frozenset("shift_jis euc_jp gbk big5 euc_kr".split())
NON_ASCII = re.compile(r"[^\x00-\x7f]+")


@lru_cache(None)
def byte_of(page: str) -> dict[str, int]:
    """Character -> byte of a one-byte encoding, upper half only; bytes it leaves undefined read as control characters."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(page)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    for b in range(128, 160):  # readers differ on control characters
        out.setdefault(chr(b), b)
    return out


@lru_cache(None)
def table(read: str, written: str) -> dict[int, str]:
    """For str.translate: each character seen -> the one meant, for one-byte encodings."""
    out = {}
    for ch, b in byte_of(read).items():
        try:
            out[ord(ch)] = bytes([b]).decode(written)
        except UnicodeDecodeError:
            if b < 160:
                out[ord(ch)] = chr(b)
    return out


def as_bytes(s: str, read: str) -> bytes | None:
    """The bytes that read as ``s``; None if it can't come from that encoding."""
    codes = byte_of(read)
    out = bytearray()
    for ch in s:
        o = ord(ch)
        if o < 128:
            out.append(o)
        else:
            b = codes.get(ch)
            if b is None:
                return None
            out.append(b)
    return bytes(out)


def decoded(s: str, read: str, written: str) -> str | None:
    """What ``s`` was if it was written in one encoding and read in another; None if it can't be."""
    if written in WIDE or written == "utf_8":
        raw = as_bytes(s, read)
        if raw is None:
            return None
        try:
            return codecs.decode(raw, written)
        except UnicodeDecodeError:
            return None
    t = table(read, written)
    if any(ord(c) > 127 and ord(c) not in t for c in s):
        return None
    return s.translate(t)
