"""Packing documents into sequences of fixed length: first-fit decreasing.

Documents are dealt at random (a hash of id and text, and of equal rows' number within
a slice of the table, so that many equal rows don't end in one group) to groups of about
GROUP_DOCUMENTS, and each group is packed by itself: longest first, into the
first bin with room.  A tournament tree over the bins' free room finds that bin
in log n steps.  Only lengths travel, not texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.bpe import VOCABULARY, encoder
from pressmill.llm.text import map_texts

CAPACITY, GROUP_DOCUMENTS, SEED = 4096, 8192, 29


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (1..capacity), given in decreasing order."""
    n = len(lengths)
    size = 1 << max(0, n - 1).bit_length()
    tree = [capacity] * (2 * size)  # the winner of each match is the larger room
    bins, offsets = np.zeros(n, np.int32), np.zeros(n, np.int32)
    for i, need in enumerate(lengths.tolist()):
        k = 1
        while k < size:
            k *= 2
            if tree[k] < need:
                k += 1
        bins[i], offsets[i] = k - size, capacity - tree[k]
        tree[k] -= need
        while k > 1:
            k //= 2
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a > b else b
    return bins, offsets


def pack_group(doc_id: np.ndarray, order: np.ndarray, tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """Row, first token, tokens, bin and offset of each piece; doc_id and order break ties, so that the rows' order doesn't matter."""
    whole, rest = tokens // capacity, tokens % capacity
    by_id = np.lexsort((order, doc_id))
    each = whole[by_id]
    full_row = np.repeat(by_id, each)
    full_first = (np.arange(len(full_row)) - np.repeat(np.cumsum(each) - each, each)) * capacity
    some = np.flatnonzero(rest)
    some = some[np.lexsort((order[some], doc_id[some], -rest[some]))]
    bins, offsets = first_fit_decreasing(rest[some], capacity) if len(some) else (np.zeros(0, np.int32),) * 2
    used = int(bins.max()) + 1 if len(some) else 0
    return (np.append(some, full_row), np.append((whole * capacity)[some], full_first), np.append(rest[some], np.full(len(full_row), capacity)), np.append(bins, used + np.arange(len(full_row))), np.append(offsets, np.zeros(len(full_row), np.int64)))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text_hash and tokens of each document, and its number (same) among the equal rows of its slice of the table."""

    def run(texts, part):
        _, counts = encoder(vocabulary).encode(texts)
        seen: dict[tuple, int] = {}
        same = []
        for key in zip(part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist(), strict=True):
            same.append(seen.setdefault(key, 0))
            seen[key] += 1
        yield {"doc_id": part.column("doc_id"), "text_hash": part.column("text_hash"), "tokens": counts, "same": np.array(same, np.int32)}

    return map_texts(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"), run, "doc_id bigint, text_hash bigint, tokens bigint, same int")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, first_token and tokens of each piece, and its place: group, bin and bin_offset.

    A document of more than capacity tokens gives full pieces, each a bin of its own, and a rest that is packed
    like the others.  Documents without tokens (null and empty texts) take no room and have no row; each of
    several equal rows is packed.  A null doc_id stays null.  An empty table gives no rows.
    """
    groups = max(1, math.ceil(docs.count() / GROUP_DOCUMENTS))
    rows = token_counts(docs, vocabulary).where("tokens > 0").withColumn("group", F.pmod(F.xxhash64("doc_id", "text_hash", "same", F.lit(SEED)), F.lit(groups)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").combine_chunks()
        key = ids.fill_null(2**63 - 1).to_numpy(zero_copy_only=False)
        row, first, tokens, bins, offset = pack_group(key, table.column("text_hash").to_numpy(), table.column("tokens").to_numpy(), capacity)
        return pa.table({"doc_id": ids.take(pa.array(row)), "first_token": pa.array(first, pa.int64()), "tokens": pa.array(tokens, pa.int32()), "group": pa.array(np.full(len(row), table.column("group")[0].as_py()), pa.int32()), "bin": pa.array(bins, pa.int32()), "bin_offset": pa.array(offset, pa.int32())})

    return rows.groupBy("group").applyInArrow(run, "doc_id bigint, first_token bigint, tokens int, group int, bin int, bin_offset int")
