"""Text of PDF files by pages, without a PDF library: objects, compressed object streams, page tree, fonts' ToUnicode maps, text operators.

Objects are found by scanning the file in order, so that a damaged cross-reference table does no harm and later updates of an object win. Lines follow the text position; a gap of more than
1.8 lines is an empty line. Pages without a text layer give empty texts and are left to transcription. Encrypted files are told, not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

PAGES = "doc string, page int, text string, image_count int, encrypted boolean, error string"
_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b")
_TOKEN = re.compile(rb"\s*(?:%[^\r\n]*\s*)*(<<|>>|\[|\]|/[^\s()<>\[\]{}/%]*|\(|<[0-9A-Fa-f\s]*>|[^\s()<>\[\]{}/%]+|[{}])")
_REF = re.compile(rb"\s*(\d+)\s+(\d+)\s+R\b")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A name object."""


class Ref(int):
    """A reference to an object by number."""


class Word(bytes):
    """An operator or other bare word."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            e = data[at : at + 1]
            if octal := re.compile(rb"[0-7]{1,3}").match(data, at):
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
            else:
                out += b"" if e in b"\r\n" else _ESCAPES.get(e, e)
                at += 2 if data[at : at + 2] == b"\r\n" else 1
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def value(data: bytes, at: int) -> tuple[object, int]:
    """The object at a place and the place behind it; None as place at the end."""
    if ref := _REF.match(data, at):
        return Ref(ref[1]), ref.end()
    found = _TOKEN.match(data, at)
    if not found:
        return None, -1
    token, at = found[1], found.end()
    if token == b"(":
        return _string(data, at)
    if token == b"<<" or token == b"[":
        items = []
        while True:
            item, to = value(data, at)
            if to < 0 or isinstance(item, Word) and item in (b">>", b"]"):
                break
            items.append(item)
            at = to
        at = to if to > 0 else len(data)
        return (items if token == b"[" else {k: v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, Name)}), at
    if token[:1] == b"/":
        return Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), token[1:].decode("latin-1"))), at
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), at
    if _NUMBER.match(token):
        return float(token), at
    return {b"true": True, b"false": False, b"null": None}.get(token, Word(token)), at


class Document:
    """The objects of a file by number: dictionaries and their streams."""

    def __init__(self, raw: bytes) -> None:
        if not raw or b"%PDF-" not in raw[:1024]:
            raise ValueError("not a PDF file")
        self.objects: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        self.trailer: dict = {}
        at = 0
        while found := _OBJECT.search(raw, at):
            number = int(found[1])
            item, at = value(raw, found.end())
            at = at if at > 0 else found.end()
            self.objects[number] = item
            if isinstance(item, dict) and (opened := re.compile(rb"\s*stream\r?\n").match(raw, at)):
                length = item.get("Length")
                end = opened.end() + int(length) if isinstance(length, float) else -1
                if not re.compile(rb"\s*endstream").match(raw, max(0, end)):
                    end = raw.find(b"endstream", opened.end())
                end = end if end >= 0 else len(raw)
                self.streams[number] = raw[opened.end() : end]
                at = end
                if item.get("Type") == "XRef":
                    self.trailer |= item
        for found in re.finditer(rb"trailer", raw):
            if isinstance(item := value(raw, found.end())[0], dict):
                self.trailer |= item
        self.encrypted = "Encrypt" in self.trailer
        if not self.encrypted:
            for number in [n for n, o in self.objects.items() if isinstance(o, dict) and o.get("Type") == "ObjStm"]:
                self._unpack(number)

    def _unpack(self, number: int) -> None:
        head, body = self.objects[number], self.stream(number)
        at = 0
        pairs = []
        for _ in range(int(head.get("N", 0))):
            n, at = value(body, at)
            offset, at = value(body, at)
            pairs.append((int(n), int(offset)))
        for n, offset in pairs:
            self.objects[n] = value(body, int(head["First"]) + offset)[0]

    def get(self, item: object) -> object:
        for _ in range(20):
            if not isinstance(item, Ref):
                return item
            item = self.objects.get(int(item))
        return None

    def dict(self, item: object) -> dict:
        found = self.get(item)
        return found if isinstance(found, dict) else {}

    def stream(self, number: int) -> bytes:
        """A stream's bytes, inflated where it says so; what is left of a cut one."""
        head, raw = self.dict(Ref(number)), self.streams.get(number, b"")
        kinds = self.get(head.get("Filter"))
        for kind in kinds if isinstance(kinds, list) else [kinds] if kinds else []:
            if self.get(kind) in ("FlateDecode", "Fl"):
                raw = zlib.decompressobj().decompress(raw)
            else:
                return b""
        return raw

    def pages(self) -> Iterator[tuple[dict, dict]]:
        """Each page with its resources, in order."""
        root = self.dict(self.trailer.get("Root")) or next((o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"), {})
        todo, seen = [(root.get("Pages"), {})], set()
        while todo:
            ref, resources = todo.pop(0)
            if isinstance(ref, Ref):
                if int(ref) in seen:
                    continue
                seen.add(int(ref))
            node = self.dict(ref)
            resources = self.dict(node.get("Resources")) or resources
            if "Kids" in node:
                todo[:0] = [(kid, resources) for kid in self.get(node["Kids"]) or []]
            elif node:
                yield node, resources


class Font:
    """Bytes of a shown string to text: by the ToUnicode map, else as the common single-byte encoding; unknown two-byte codes are replacement characters."""

    def __init__(self, doc: Document, font: dict) -> None:
        self.wide, self.map = font.get("Subtype") == "Type0", {}
        ref = font.get("ToUnicode")
        if isinstance(ref, Ref):
            self._read(doc.stream(int(ref)))

    def _read(self, cmap: bytes) -> None:
        text = lambda b: b.decode("utf-16-be", "replace")
        for block in re.finditer(rb"begin(bfchar|bfrange)(.*?)end", cmap, re.S):
            items, at = [], 0
            while True:
                item, at = value(block[2], at)
                if at < 0:
                    break
                items.append(item)
            step = 2 if block[1] == b"bfchar" else 3
            for row in zip(*(items[i::step] for i in range(step)), strict=False):
                if not all(isinstance(x, bytes | list) for x in row):
                    continue
                low = int.from_bytes(row[0])
                if step == 2:
                    self.map[low] = text(row[1])
                else:
                    for i in range(min(int.from_bytes(row[1]) - low + 1, 1 << 16)):
                        self.map[low + i] = text(row[2][i]) if isinstance(row[2], list) else text(row[2][:-2] + (int.from_bytes(row[2][-2:]) + i & 0xFFFF).to_bytes(2))

    def text(self, raw: bytes) -> str:
        if self.wide:
            return "".join(self.map.get(int.from_bytes(raw[i : i + 2]), "�") for i in range(0, len(raw), 2))
        return "".join(self.map.get(b) or bytes([b]).decode("cp1252", "replace") for b in raw)


def page_text(doc: Document, page: dict, resources: dict) -> str:
    """Lines of a page as its text operators place them."""
    contents = page.get("Contents")
    held = doc.get(contents)
    refs = held if isinstance(held, list) else [contents]
    data = b"\n".join(doc.stream(int(r)) for r in refs if isinstance(r, Ref))
    fonts = {name: Font(doc, doc.dict(font)) for name, font in doc.dict(resources.get("Font")).items()}
    font, operands, at = None, [], 0
    x = y = 0.0
    scale, leading, size = 1.0, 0.0, 12.0
    lines: list[list] = []  # [y, height, text]

    def show(raw: object) -> None:
        said = font.text(raw) if font else bytes(raw).decode("cp1252", "replace")
        if lines and abs(lines[-1][0] - y) < 0.5:
            lines[-1][2] += said
        else:
            lines.append([y, max(1.0, abs(size * scale)), said])

    def move(tx: float, ty: float) -> None:
        nonlocal x, y
        x, y = x + tx * scale, y + ty * scale
        if ty == 0 and tx > 0 and lines and lines[-1][2][-1:] not in ("", " "):
            lines[-1][2] += " "

    while True:
        item, at = value(data, at)
        if at < 0:
            break
        if not isinstance(item, Word):
            operands.append(item)
            continue
        n = operands
        try:
            if item == b"Tf":
                font, size = fonts.get(n[-2]), n[-1]
            elif item == b"Td":
                move(n[-2], n[-1])
            elif item == b"TD":
                leading = -n[-1]
                move(n[-2], n[-1])
            elif item == b"TL":
                leading = n[-1]
            elif item == b"T*":
                move(0, -(leading or size))
            elif item == b"Tm":
                scale, x, y = n[-3] or 1.0, n[-2], n[-1]
            elif item == b"BT":
                x = y = 0.0
                scale = 1.0
            elif item in (b"Tj", b"'", b'"'):
                if item != b"Tj":
                    move(0, -(leading or size))
                show(n[-1])
            elif item == b"TJ":
                for part in n[-1]:
                    if isinstance(part, bytes):
                        show(part)
                    elif part < -200 and lines and lines[-1][2][-1:] != " ":
                        lines[-1][2] += " "
            elif item == b"ID":  # an inline image's bytes
                end = re.compile(rb"\sEI\b").search(data, at)
                at = end.end() if end else len(data)
        except (IndexError, TypeError):
            pass  # an operator without its operands is skipped
        operands = []
    out = []
    for before, line in zip([None, *lines], lines, strict=False):
        if before is not None and abs(before[0] - line[0]) > 1.8 * max(before[1], line[1]):
            out.append("")
        out.append(line[2].rstrip())
    return "\n".join(out)


def read_pages(raw: bytes) -> list[tuple[int, str, int]] | None:
    """(page, text, images) of a file; None if it is encrypted."""
    doc = Document(raw)
    if doc.encrypted:
        return None
    found = []
    for i, (page, resources) in enumerate(doc.pages()):
        images = sum(doc.dict(o).get("Subtype") == "Image" for o in doc.dict(resources.get("XObject")).values())
        found.append((i + 1, page_text(doc, page, resources), images))
    if not found:
        raise ValueError("no pages")
    return found


def pdf_pages(docs: DataFrame) -> DataFrame:
    """Rows of PAGES for docs (doc, content). An encrypted file is one row that says so, a broken one a row with an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, content in zip(frame["doc"], frame["content"], strict=True):
                try:
                    pages = read_pages(content)
                    rows += [(doc, n, text, images, False, None) for n, text, images in pages] if pages is not None else [(doc, 0, "", 0, True, None)]
                except Exception as e:  # one broken file is a row, not a failed job
                    rows.append((doc, 0, "", 0, False, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc", "page", "text", "image_count", "encrypted", "error"])

    return docs.select("doc", "content").mapInPandas(run, PAGES)
