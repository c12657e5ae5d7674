"""Text of simple PDF files: what the content streams show, in their order.

Covers uncompressed and Flate streams, literal and hexadecimal strings in one-byte encodings. Fonts with
encodings of their own need a parser from outside, passed to `read_files`.
"""

from __future__ import annotations

import re
import zlib

_STREAM = re.compile(rb"<<(?P<head>(?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n(?P<body>.*?)\r?\n?endstream", re.S)
# One alternation walks a content stream: strings, arrays' numbers, operators that show text or move the line.
_PART = re.compile(rb"\((?P<literal>(?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*)\)|<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<number>-?\d+(?:\.\d+)?)|(?P<op>TJ|Tj|'|\"|T\*|Td|TD|Tm|ET)(?![A-Za-z*])|[A-Za-z*]+", re.S)
_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(\r\n|[\s\S]))")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


def _literal(raw: bytes) -> bytes:
    return _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1] else _ESCAPES.get(m[2], m[2]), raw)


def _shown(stream: bytes) -> str:
    lines, held, gap = [[]], [], 0.0
    for m in _PART.finditer(stream):
        if m["literal"] is not None:
            held.append(_literal(m["literal"]))
        elif m["hex"] is not None:
            digits = re.sub(rb"\s", b"", m["hex"])
            held.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        elif m["number"] is not None:
            gap = float(m["number"])
            if held and gap < -200:  # a wide gap within an array of strings is a space
                held.append(b" ")
        else:
            op = m["op"]
            if op in (b"T*", b"Td", b"TD", b"Tm", b"ET", b"'", b'"') and lines[-1]:
                lines.append([])
            if op in (b"Tj", b"TJ", b"'", b'"'):
                lines[-1].append(b"".join(held).decode("latin-1"))
            held = []
    return "\n".join("".join(x) for x in lines if x)


def pdf_text(data: bytes) -> str:
    """Lines of all content streams, streams parted by an empty line."""
    if not data.startswith(b"%PDF"):
        raise ValueError("no PDF")
    pages = []
    for m in _STREAM.finditer(data):
        body = m["body"]
        if b"FlateDecode" in m["head"]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        if b"BT" in body and (text := _shown(body).strip()):
            pages.append(text)
    return "\n\n".join(pages)
