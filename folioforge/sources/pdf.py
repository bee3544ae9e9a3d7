"""Text of PDF files with a text layer: pages in their order, by the operators that show text.

Objects in the file and in object streams, Flate streams, literal and hexadecimal strings are read; fonts that
number their glyphs in a way of their own are not decoded. Encrypted files are unreadable.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s()<>\[\]/]+|[-+.\d]+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(token: bytes) -> str:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        one = lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1] in b"\r\n" else _ESCAPES.get(m[1], m[1])
        data = re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, token[1:-1], flags=re.S)
    return data[2:].decode("utf-16-be", "replace") if data.startswith(b"\xfe\xff") else data.decode("cp1252", "replace")


def _stream(body: bytes) -> bytes:
    found = _STREAM.search(body)
    if not found:
        return b""
    return zlib.decompressobj().decompress(found[1]) if b"/FlateDecode" in body[: found.start()] else found[1]


def _objects(data: bytes) -> dict[int, bytes]:
    out = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    for body in list(out.values()):
        if b"/ObjStm" in body:
            inner, first = _stream(body), int(re.search(rb"/First\s+(\d+)", body)[1])
            numbers = [int(x) for x in inner[:first].split()]
            starts = numbers[1::2] + [len(inner) - first]
            out |= {n: inner[first + a : first + b] for n, a, b in zip(numbers[::2], starts, starts[1:])}
    return out


def _shown(content: bytes) -> str:
    """What text operators show, a line for each that begins one."""
    out, strings = [], []
    for token in _TOKEN.findall(content):
        if token[:1] in b"(<":
            strings.append(_string(token))
        elif token in (b"Tj", b"TJ", b"'", b'"'):
            out += ["\n"] * (token in b"'\"") + strings
            strings = []
        elif token in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
            out.append("\n")
            strings = []
        elif token[:1].isalpha():
            strings = []
    return re.sub(r"\n+", "\n", "".join(out)).strip()


def pdf_text(data: bytes) -> str | None:
    """Pages that show anything, joined by blank lines; null for what is no readable PDF."""
    if not data.lstrip()[:5] == b"%PDF-" or b"/Encrypt" in data:
        return None
    try:
        objects = _objects(data)
        refs = lambda body, name: [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", (re.search(rb"/" + name + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body) or [b"", b""])[1])]
        tops = [n for n, b in objects.items() if re.search(rb"/Type\s*/Pages\b", b) and not re.search(rb"/Parent\b", b)]
        pages, left = [], tops[::-1]
        while left:  # depth first, in the order of kids
            body = objects.get(left.pop(), b"")
            if re.search(rb"/Type\s*/Pages\b", body):
                left += refs(body, b"Kids")[::-1]
            elif body:
                pages.append("\n".join(_shown(_stream(objects.get(n, b""))) for n in refs(body, b"Contents")))
        return "\n\n".join(p for p in pages if p.strip()) if tops else None
    except (ValueError, zlib.error, TypeError, IndexError):
        return None
