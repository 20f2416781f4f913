"""Blocks to chunks of about CHUNK_TOKENS with overlap: a scan of each document's blocks, as sorted rows stream past."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK_TOKENS, OVERLAP, SLACK = 512, 80, 5
ATOMIC = {"table", "code", "image"}
CHUNKS = "doc string, chunk_index int, block_type string, page_num int, est_tokens int, content string"
# What counts as a wide character, and where a sentence ends.
_WIDE = re.compile("[\u4e00-\u9fff\u3000-\u303f\uff00-\uffef]")
_NARROW = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"
_SENTENCE = re.compile(r"[。；！？!?;]\s*|[.]\s+")
_WIDE_RANGES = ((0x3000, 0x303F), (0x4E00, 0x9FFF), (0xFF00, 0xFFEF))
#: Bytes of UTF-8 that no wide character starts with.
_BELOW_WIDE = bytes(range(0xE3))
_IS_NARROW = np.isin(np.arange(128), list(_NARROW))
NAMES = [c.split()[0] for c in CHUNKS.split(", ")]


def counts(text: str) -> tuple[int, int]:
    """Wide characters and ASCII word characters."""
    raw = text.encode("utf-8", "surrogatepass")
    return len(_WIDE.findall(text)) if raw.translate(None, _BELOW_WIDE) else 0, len(raw) - len(raw.translate(None, _NARROW))


def tokens(text: str) -> int:
    wide, narrow = counts(text)
    return wide + max(1, narrow // 3)


def _marks(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Whether each character is wide, and whether it is an ASCII word character."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.any([(code >= a) & (code <= b) for a, b in _WIDE_RANGES], axis=0), _IS_NARROW[np.minimum(code, 127)]


def tail(text: str, limit: int = OVERLAP) -> str:
    """The end of a text of about `limit` tokens, nothing if all of it fits."""
    if tokens(text) <= limit:
        return ""
    wide, narrow = (np.cumsum(x[::-1]) for x in _marks(text))
    n = int(np.searchsorted(wide + np.maximum(1, narrow // 3), limit + SLACK, "right"))  # tokens grow with the tail
    return text[-n:] if n else ""


def pack(units: list[str], glue: str, limit: int) -> list[str]:
    """Units joined while they stay within the limit; counts run, as those of glued texts add up (the ASCII third is rounded once)."""
    out: list[list[str]] = []
    wide = narrow = 0
    for unit in units:
        w, n = counts(unit)
        if out and wide + w + max(1, (narrow + n) // 3) <= limit:
            out[-1].append(unit)
            wide, narrow = wide + w, narrow + n
        else:
            out.append([unit])
            wide, narrow = w, n
    return [glue.join(x) for x in out]


def cut(text: str, limit: int = CHUNK_TOKENS) -> list[str]:
    """Pieces within the limit: by lines, long lines by sentences, long sentences by characters."""
    if tokens(text) <= limit:
        return [text]
    lines = text.split("\n")
    if len(lines) > 1:
        return pack([p for line in lines for p in cut(line, limit)], "\n", limit)
    ends = [0, *sorted({m.end() for m in _SENTENCE.finditer(text)} - {0, len(text)}), len(text)]
    if len(ends) > 2:  # each sentence keeps the white space behind it, so pieces join to the text
        return [p.strip() for p in pack([p for a, b in zip(ends, ends[1:], strict=False) for p in _hard(text[a:b], limit)], "", limit) if p.strip()]
    return _hard(text, limit)


def _hard(text: str, limit: int) -> list[str]:
    """Pieces by characters alone, from running counts."""
    if tokens(text) <= limit:
        return [text]
    wide, narrow = (np.cumsum(x) for x in _marks(text))
    out, at = [], 0
    while at < len(text):
        w, n = (int(x[at - 1]) if at else 0 for x in (wide, narrow))
        lo, hi = at + 1, min(len(text), at + 8 * limit + 64)
        while hi < len(text) and wide[hi - 1] - w + max(1, (narrow[hi - 1] - n) // 3) <= limit:
            hi = min(len(text), 2 * hi - at)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if wide[mid - 1] - w + max(1, (narrow[mid - 1] - n) // 3) <= limit else (lo, mid - 1)
        out.append(text[at:lo])
        at = lo
    return out


def slices(text: str, limit: int = CHUNK_TOKENS, overlap: int = OVERLAP) -> list[str]:
    """Pieces of a long text, each but the first led by the end of the one before."""
    parts = cut(text, limit)
    return [parts[0], *((tail(a, overlap) if overlap else "") + b for a, b in zip(parts, parts[1:], strict=False))]


def chunk_blocks(blocks: list[tuple[str, str, int | None]], limit: int = CHUNK_TOKENS, overlap: int = OVERLAP) -> list[tuple[str, str, int]]:
    """(block types, text, page) from (type, text, page): tables, code and images stay whole and alone, the rest fills chunks."""
    out: list[tuple[str, str, int]] = []
    held: list[tuple[str, str, int | None]] = []
    wide = narrow = 0  # of the held texts; what joins them counts for nothing

    def flush() -> None:
        if held:
            text = "\n\n".join(t for _, t, _ in held)
            kinds = ",".join(sorted({k for k, _, _ in held}))
            page = next((p for _, _, p in held if p), 0)
            parts = slices(text, limit, overlap)
            out.extend((kinds if len(parts) == 1 else "paragraph", p, page) for p in parts)
            held.clear()

    for kind, text, page in blocks:
        if kind in ATOMIC:
            flush()
            out.append((kind, text, page or 0))
            continue
        w, n = counts(text)
        if held and wide + w + max(1, (narrow + n) // 3) > limit:
            flush()
        wide, narrow = (wide + w, narrow + n) if held else (w, n)
        held.append((kind, text, page))
    flush()
    return out


def chunk_documents(blocks: DataFrame, limit: int = CHUNK_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of blocks (doc, seq, block_type, text, page)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc: str | None = None
        held: list[tuple[str, str, int | None]] = []
        rows: list[tuple] = []

        def flush() -> None:
            rows.extend((doc, i + 1, k, p, tokens(t), t) for i, (k, t, p) in enumerate(chunk_blocks(held, limit, overlap)))
            held.clear()

        def made() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            out = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], NAMES)
            rows.clear()
            return out

        for batch in batches:
            for d, *block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and d != doc:
                    flush()
                doc = d
                held.append(tuple(block))
            yield made()
        flush()
        yield made()

    dealt = blocks.select("doc", "block_type", "text", "page", "seq").repartition("doc").sortWithinPartitions("doc", "seq")
    return dealt.select("doc", "block_type", "text", "page").mapInArrow(run, CHUNKS)
