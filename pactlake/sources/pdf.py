"""PDF pages as rows of text fragments (L3): a Python data source split by file and range of pages.

    spark.dataSource.register(PdfFragments)
    spark.read.format("pdf_fragments").option("paths", json.dumps([...])).load()

A file of more than `range_bytes` bytes is read by several tasks, each of which takes its share of the pages, so the
driver only lists names and sizes. Files are opened by pyarrow's file systems (local, hdfs, s3, gs). Text comes from
pypdf where it is installed, else from the small reader below.

That reader knows plain and Flate-coded streams, object streams, nested page trees and the text operators; fonts
are taken as Latin-1 (or UTF-16 with its mark). Encrypted files and fonts with encodings of their own need pypdf. A
damaged stream has no fragments; a file without a page tree has no pages.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FRAGMENT = "doc_id string, source string, page int, total_pages int, plain string, x double, y double, text string"
RANGE_BYTES = 16 << 20

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_REF = rb"(\d+)\s+\d+\s+R"
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+]?\d*\.?\d+|/[^\s()<>\[\]/%]*|[A-Za-z'\"*]+[0-9]?", re.S)
_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(\r\n|\n|\r)|(.))", re.S)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A gap in a TJ array from which on it stands for a blank, in thousandths of the font size.
_BLANK_GAP = 200


class PdfFile:
    """Pages of one file: `pages` holds the contents' object numbers of each."""

    def __init__(self, data: bytes):
        self.objects: dict[int, bytes] = {int(n): body for n, body in _OBJECT.findall(data)}
        for body in [b for b in self.objects.values() if b"/ObjStm" in b]:
            self._unpack(body)
        roots = [b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)]
        tops = [m for b in roots if (m := re.search(rb"/Pages\s+" + _REF, b))]
        self.pages = list(self._leaves(int(tops[-1][1]), set())) if tops else []

    def _unpack(self, body: bytes) -> None:
        """The objects of an object stream."""
        first, packed = re.search(rb"/First\s+(\d+)", body), self.stream(body)
        if first and packed:
            start = int(first[1])
            numbers = [int(x) for x in packed[:start].split()]
            places = list(zip(numbers[::2], numbers[1::2], strict=False))
            for i, (number, at) in enumerate(places):
                end = places[i + 1][1] + start if i + 1 < len(places) else len(packed)
                self.objects.setdefault(number, packed[start + at : end])

    def _leaves(self, number: int, seen: set[int]) -> Iterator[list[int]]:
        body = self.objects.get(number, b"")
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
        if number in seen:
            return
        seen.add(number)
        if kids:
            for kid in re.findall(_REF, kids[1]):
                yield from self._leaves(int(kid), seen)
        elif re.search(rb"/Type\s*/Page\b", body):
            contents = re.search(rb"/Contents\s*(?:\[(.*?)\]|(\d+)\s+\d+\s+R)", body, re.S)
            yield [] if not contents else [int(contents[2])] if contents[2] else [int(x) for x in re.findall(_REF, contents[1])]

    @staticmethod
    def stream(body: bytes) -> bytes:
        found = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
        if not found:
            return b""
        if b"/FlateDecode" in body[: found.start()]:
            try:
                return zlib.decompressobj().decompress(found[1])
            except zlib.error:
                return b""
        return found[1]

    def fragments(self, page: int) -> list[tuple[float, float, str]]:
        """(x, y, text) of a page (from 0) in the order of its operators."""
        return fragments_of(b"\n".join(self.stream(self.objects.get(n, b"")) for n in self.pages[page]))


def literal(token: bytes) -> str:
    """A string operand as text."""
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1] else b"" if m[2] else _NAMED.get(m[3], m[3]), token[1:-1])
    return raw.decode("utf-16") if raw[:2] in (b"\xfe\xff", b"\xff\xfe") else raw.decode("latin-1")


def fragments_of(content: bytes) -> list[tuple[float, float, str]]:
    """Fragments of a content stream: texts shown one after the other without a move are one fragment."""
    out: list[tuple[float, float, str]] = []
    x = y = line_x = line_y = leading = 0.0
    shown: list[str] = []
    stack: list = []
    array: list | None = None

    def flush() -> None:
        if text := " ".join("".join(shown).split()):
            out.append((x, y, text))
        shown.clear()

    def number(i: int) -> float:
        return float(stack[i]) if len(stack) >= -i and isinstance(stack[i], float) else 0.0

    for match in _TOKEN.finditer(content):
        token = match[0]
        if token == b"[":
            array = []
        elif token == b"]":
            stack.append(array or [])
            array = None
        elif token[:1] in b"(<":
            (stack if array is None else array).append(literal(token))
        elif token[:1] in b"+-.0123456789":
            (stack if array is None else array).append(float(token))
        elif token[:1] == b"/":
            stack.append(token)
        else:
            if token in (b"Td", b"TD", b"T*", b"Tm", b"BT", b"'", b'"'):
                flush()
            if token in (b"Td", b"TD"):
                line_x, line_y = line_x + number(-2), line_y + number(-1)
                leading = -number(-1) if token == b"TD" else leading
            elif token == b"Tm":
                line_x, line_y = number(-2), number(-1)
            elif token == b"BT":
                line_x = line_y = 0.0
            elif token == b"TL":
                leading = number(-1)
            elif token in (b"T*", b"'", b'"'):
                line_y -= leading
            x, y = line_x, line_y
            if token in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], str):
                shown.append(stack[-1])
            elif token == b"TJ" and stack and isinstance(stack[-1], list):
                shown += [s if isinstance(s, str) else " " if s <= -_BLANK_GAP else "" for s in stack[-1]]
            elif token == b"ET":
                flush()
            stack.clear()
    flush()
    return out


def file_pages(data: bytes, part: int = 0, parts: int = 1) -> Iterator[tuple[int, int, str, list[tuple[float, float, str]]]]:
    """(page, total, plain text, fragments) of the pages of one of `parts` even ranges."""
    try:
        from pypdf import PdfReader
    except ImportError:
        file = PdfFile(data)
        total = len(file.pages)
        for i in range(total * part // parts, total * (part + 1) // parts):
            found = file.fragments(i)
            yield i + 1, total, "\n".join(t for _, _, t in found), found
        return
    import io

    reader = PdfReader(io.BytesIO(data))
    if reader.is_encrypted:
        reader.decrypt("")
    total = len(reader.pages)
    for i in range(total * part // parts, total * (part + 1) // parts):
        seen: list[tuple[float, float, str]] = []
        plain = reader.pages[i].extract_text(visitor_text=lambda t, _cm, tm, _f, _s, seen=seen: seen.append((float(tm[4]), float(tm[5]), " ".join(t.split()))) if t.strip() else None)
        yield i + 1, total, plain or "", seen


def fragment_tuples(path: str, data: bytes, part: int = 0, parts: int = 1) -> Iterator[tuple]:
    """Rows of FRAGMENT; a page without fragments is one row without a place."""
    name = path.rsplit("/", 1)[-1]
    for page, total, plain, found in file_pages(data, part, parts):
        for x, y, text in found or [(None, None, None)]:
            yield path, name, page, total, plain, x, y, text


@dataclass
class PageRange(InputPartition):
    path: str
    part: int
    parts: int


class PdfReaderOfRanges(DataSourceReader):
    def __init__(self, paths: list[str], range_bytes: int):
        self.paths, self.range_bytes = paths, range_bytes

    def partitions(self) -> list[PageRange]:
        from pyarrow.fs import FileSystem, FileType

        out = []
        for path in self.paths:
            system, inside = FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
            info = system.get_file_info(inside)
            if info.type != FileType.File:
                raise FileNotFoundError(path)
            parts = max(1, -(-info.size // self.range_bytes))
            out += [PageRange(path, i, parts) for i in range(parts)]
        return out

    def read(self, partition: PageRange) -> Iterator[tuple]:
        from pyarrow.fs import FileSystem

        path = partition.path
        system, inside = FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        with system.open_input_file(inside) as f:
            data = f.read()
        yield from fragment_tuples(path, data, partition.part, partition.parts)


class PdfFragments(DataSource):
    """Options: paths (a JSON list of files), range_bytes (size of the ranges that a file is read by)."""

    @classmethod
    def name(cls) -> str:
        return "pdf_fragments"

    def schema(self) -> str:
        return FRAGMENT

    def reader(self, schema) -> PdfReaderOfRanges:
        return PdfReaderOfRanges(json.loads(self.options["paths"]), int(self.options.get("range_bytes", RANGE_BYTES)))
