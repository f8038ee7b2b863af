"""Token ids as length-delimited binary records, with an index for shuffled reads.

A record is framed as: its length (8 bytes, little-endian), the masked CRC-32C
of these 8 bytes, the data, the masked CRC-32C of the data.  The data are the
document's id (8 bytes; the least number for null) and its token ids, 2 bytes
each (4 in vocabularies of more than 65,536).  Each task writes one file and,
beside it, an index of 8-byte offsets; both appear under their names when they
are complete.  The rows that an attempt returns name the attempt's own file, so
that lost, repeated and speculative attempts do no harm: their files are simply
not in the index.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.bpe import VOCABULARY, encoder
from pressmill.llm.storage import file_system, shared_dir
from pressmill.llm.text import slices, small_batches

_BLOCK = 256
_POLY = 0x82F63B78


@lru_cache(1)
def _step() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & 1, np.uint32(_POLY), np.uint32(0))
    return t


@lru_cache(64)
def _skip(log: int) -> np.ndarray:
    """Four tables that advance a checksum over 2^log zero bytes."""
    byte = np.arange(256, dtype=np.uint32)
    start = np.stack([byte << np.uint32(8 * k) for k in range(4)])
    if log == 0:
        return (start >> np.uint32(8)) ^ _step()[start & np.uint32(255)]
    half = _skip(log - 1)
    return _advance(half, _advance(half, start))


def _advance(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tables[0][c & np.uint32(255)] ^ tables[1][c >> np.uint32(8) & np.uint32(255)] ^ tables[2][c >> np.uint32(16) & np.uint32(255)] ^ tables[3][c >> np.uint32(24)]


def masked_crcs(data: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Masked CRC-32C of each of several records, laid end to end in data (bytes)."""
    lens = np.asarray(lens, np.int64)
    blocks = -(-lens // _BLOCK)
    lane0 = np.cumsum(blocks) - blocks
    padded = np.zeros(int(blocks.sum()) * _BLOCK, np.uint8)
    # Zeros in front of a record don't change a checksum that starts from zero.
    shift = (lane0 + blocks) * _BLOCK - np.cumsum(lens)
    padded[np.arange(len(data)) + np.repeat(shift, lens)] = data
    step, c = _step(), np.zeros(int(blocks.sum()), np.uint32)
    columns = np.ascontiguousarray(padded.reshape(-1, _BLOCK).T)
    for column in columns:
        c = step[(c ^ column) & np.uint32(255)] ^ (c >> np.uint32(8))
    crc, over_block = np.zeros(len(lens), np.uint32), _skip(8)
    for k in range(int(blocks.max(initial=0))):
        own = np.flatnonzero(blocks > k)
        crc[own] = _advance(over_block, crc[own]) ^ c[lane0[own] + k]
    start = np.full(len(lens), 0xFFFFFFFF, np.uint32)
    for log in range(int(lens.max(initial=0)).bit_length()):
        own = np.flatnonzero(lens >> log & 1)
        start[own] = _advance(_skip(log), start[own])
    crc ^= start ^ np.uint32(0xFFFFFFFF)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def frame(data: list[bytes]) -> list[bytes]:
    """Each record framed."""
    if not data:
        return []
    lens = np.fromiter(map(len, data), np.int64, len(data))
    heads = lens.astype("<u8")
    a = masked_crcs(heads.view(np.uint8), np.full(len(data), 8))
    b = masked_crcs(np.frombuffer(b"".join(data), np.uint8), lens)
    return [struct.pack("<QI", len(d), x) + d + struct.pack("<I", y) for d, x, y in zip(data, a.tolist(), b.tolist(), strict=True)]


def write(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Writes a record for each row of docs when the result is computed: doc_id, file, record, record_offset, length (of the data, in bytes) and tokens.

    A null text is written like an empty one, as a record without tokens; equal rows give a record each; a text may be of any length; an empty
    table gives no rows; records are in the table's order, so that there are no ties.  Whoever keeps the result should write it: it is the index, and computing it again writes anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        e = encoder(vocabulary)
        kind = np.dtype("<u2" if e.size <= 1 << 16 else "<u4")
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        out, at, offsets = None, 0, []
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                for i, j in slices(texts):
                    ids, counts = e.encode(texts[i:j])
                    own = part.column("doc_id").slice(i, j - i)
                    keys = own.fill_null(-(2**63)).to_numpy(zero_copy_only=False).astype("<i8")
                    parts = np.split(ids.astype(kind), np.cumsum(counts)[:-1])
                    framed = frame([k.tobytes() + p.tobytes() for k, p in zip(keys, parts, strict=True)])
                    sizes = np.fromiter(map(len, framed), np.int64, len(framed))
                    if out is None:
                        out = system.open_output_stream(f"{root}/.{name}")
                    out.write(b"".join(framed))
                    start = at + np.cumsum(sizes) - sizes
                    yield pa.RecordBatch.from_arrays([own, pa.array([f"{name}.rec"] * len(framed)), pa.array(np.arange(len(framed), dtype=np.int64) + len(offsets)), pa.array(start), pa.array((sizes - 16).astype(np.int32)), pa.array(counts.astype(np.int32))], names=["doc_id", "file", "record", "record_offset", "length", "tokens"])
                    at += int(sizes.sum())
                    offsets += start.tolist()
        if out is not None:
            out.close()
            with system.open_output_stream(f"{root}/.{name}.idx") as index:
                index.write(np.array(offsets, "<u8").tobytes())
            system.move(f"{root}/.{name}.idx", f"{root}/{name}.idx")
            system.move(f"{root}/.{name}", f"{root}/{name}.rec")

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, file string, record bigint, record_offset bigint, length int, tokens int")


def new_folder(spark) -> str:
    """A new folder for records in the shared one."""
    return f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"


def read(index: DataFrame, folder: str, seed: int | None = None, width: int = 2) -> DataFrame:
    """doc_id and ids of each record in index, in an order shuffled by seed, or file by file.  Wrong lengths and checksums raise ValueError.  width: bytes of a token id."""
    rows = index.select("file", "record_offset", "length")
    rows = rows.repartition("file").sortWithinPartitions("file", "record_offset") if seed is None else rows.orderBy(F.rand(seed))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = file_system(folder)
        opened: dict = {}
        for part in parts:
            data = []
            for name, at, length in part.itertuples(index=False):
                if name not in opened:
                    if len(opened) > 64:
                        opened.popitem()[1].close()
                    opened[name] = system.open_input_file(f"{root}/{name}")
                data.append(opened[name].read_at(length + 16, at))
            for d, length, again in zip(data, part["length"], frame([d[12:-4] for d in data]), strict=True):
                if len(d) != length + 16 or bytes(d) != again:
                    raise ValueError("a record is damaged")
            keys = [struct.unpack("<q", d[12:20])[0] for d in data]
            yield pd.DataFrame({"doc_id": pd.Series([None if k == -(2**63) else k for k in keys], dtype="Int64"), "ids": [np.frombuffer(d[20:-4], f"<u{width}").astype(np.int32) for d in data]})

    return rows.mapInPandas(run, "doc_id bigint, ids array<int>")
