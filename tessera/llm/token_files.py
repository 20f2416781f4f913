"""Operator 4, token-ID output: length-delimited binary records with masked checksums and a separate offset index.

A data file is a run of records: payload length (u64), masked CRC-32 of those 8 bytes (u32), payload, masked CRC-32 of
the payload (u32), little-endian. A payload is flag (u8: 1 if the id is null), doc_id (i64) and the token ids, u16
where the vocabulary allows it, else u32 (flag bit 2). Its index file, `.idx`, is one i64 offset for each record, so a reader can take
records in any order. Documents are dealt by ranges of (doc_id, place in the scan) and sorted in each range, hence files are in order,
rows that share a doc_id or have none spread over as many files as others, and each file is written by one task as a stream. A task writes under a name of its own attempt; the manifest, a table in the
shared folder, names the files of the attempts that counted, so a lost executor leaves at most files nobody reads.

Defined cases: null or empty text is a document with the end id only; a very long text is encoded in parts cut at safe spaces and is one record; null
doc_ids come first; repeated rows and rows that share a doc_id (ties) are records of their own, next to each other, in order of text within a file; an empty
table writes no files and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.llm.common import doc_text, materialize, shared_dir, string_buffers
from tessera.llm.tokenization import encoder

VOCABULARY, SEPARATOR, END_ID = "word_bpe_49k.json", " |", 2
MANIFEST = "path string, first_id long, n_docs long, n_tokens long, n_bytes long"


def masked_crc(data: bytes) -> int:
    """CRC-32 rotated by 15 bits plus a constant, so that checksums of data that holds checksums stay apart."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """A record of ids in u16 or u32."""
    payload = bytes([(doc_id is None) + 2 * (ids.itemsize == 4)]) + (doc_id or 0).to_bytes(8, "little", signed=True) + ids.tobytes()
    head = len(payload).to_bytes(8, "little")
    return b"".join([head, masked_crc(head).to_bytes(4, "little"), payload, masked_crc(payload).to_bytes(4, "little")])


def read_record(f, offset: int) -> tuple[int | None, np.ndarray]:
    """The record at an offset of an open data file; a wrong checksum raises."""
    f.seek(offset)
    head = f.read(12)
    if masked_crc(head[:8]) != int.from_bytes(head[8:], "little"):
        raise ValueError(f"broken record length at {offset}")
    body = f.read(int.from_bytes(head[:8], "little") + 4)
    payload = body[:-4]
    if masked_crc(payload) != int.from_bytes(body[-4:], "little"):
        raise ValueError(f"broken record at {offset}")
    ids = np.frombuffer(payload, "<u4" if payload[0] & 2 else "<u2", offset=9).astype("<u4")
    return None if payload[0] & 1 else int.from_bytes(payload[1:9], "little", signed=True), ids


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, separator: str = SEPARATOR, end_id: int = END_ID) -> DataFrame:
    """Write docs (doc_id, text) to `folder`, a URI all executors share; returns the manifest, one row for each data file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, separator)
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        path = f"{root}/tokens-{uuid.uuid4().hex}.bin"
        out, offsets, first, tokens, at = None, [], None, 0, 0
        for batch in batches:
            data, off = string_buffers(batch.column(1))
            for i, j, border, ids in enc.rows_with_end(data, off, end_id):
                doc_ids = batch.column(0).slice(i, j - i).to_pylist()
                if out is None:
                    out, first = store.open_output_stream(path), doc_ids[0]
                wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
                small, cuts = ids if wide else ids.astype("<u2"), border.tolist()
                frames = [frame(doc_id, small[a:b]) for doc_id, a, b in zip(doc_ids, cuts, cuts[1:], strict=False)]
                sizes = np.fromiter(map(len, frames), np.int64, len(frames))
                offsets.append(at + np.cumsum(sizes) - sizes)
                at, tokens = at + int(sizes.sum()), tokens + len(ids)
                out.write(b"".join(frames))
        if out is not None:
            out.close()
            with store.open_output_stream(path + ".idx") as index:
                index.write(np.concatenate(offsets).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([first], pa.int64()), pa.array([sum(map(len, offsets))]), pa.array([tokens]), pa.array([at])], ["path", "first_id", "n_docs", "n_tokens", "n_bytes"])

    key = F.col("doc_id").asc_nulls_first()
    dealt = doc_text(docs).withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(key, "_place")
    return materialize(dealt.drop("_place").sortWithinPartitions(key, "text").mapInArrow(run, MANIFEST), f"{folder.rstrip('/')}/manifest")


def read_token_files(manifest: DataFrame, folder: str, batch_docs: int = 2000) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each record, from the files through their index, checksums verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(row["path"] + ".idx") as f:
                    offsets = np.frombuffer(f.read(), "<i8")
                start = row["base"]
                with store.open_input_file(row["path"]) as f:
                    for i in range(0, len(offsets), batch_docs):
                        cols = ([], [], [], [])
                        for at in offsets[i : i + batch_docs].tolist():
                            doc_id, ids = read_record(f, at)
                            for c, v in zip(cols, (doc_id, start, len(ids), zlib.crc32(ids.tobytes())), strict=True):
                                c.append(v)
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row for each file: the sums over all of them are small
    w = W.Window.orderBy(F.col("first_id").asc_nulls_first(), "n_bytes", "path")
    based = manifest.withColumn("base", F.sum("n_tokens").over(w) - F.col("n_tokens"))
    return based.repartition(max(1, manifest.count()), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    return read_token_files(write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder), folder)
