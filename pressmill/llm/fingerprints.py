"""Document fingerprints by content-defined chunking.

A gear hash runs over the text's UTF-8 bytes; its upper bits depend on the last
32 bytes alone.  A chunk ends where they are zero: more bits of them before
NORMAL bytes and fewer after (normalised chunking), so that sizes gather around
NORMAL, between LEAST and MOST bytes, and never within a character.  An
insertion moves the boundaries near it and no others.  A document's fingerprint
is the set of its chunks' digests, each with its length in bytes; containment is
the share of one set's bytes whose digests are in another's.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pressmill.llm.storage import keep
from pressmill.llm.text import lists, small_batches

LEAST, NORMAL, MOST = 64, 256, 1024
#: A document is linked to those that hold at least such a share of it.
LINK = 0.5
#: Chunks of more classes are compared by way of patterns (see containers) instead of class by class; the result is the same.
HOT = 64
_HARD, _EASY = 10, 6
_GEAR = np.random.default_rng(5).integers(0, 1 << 32, 256, dtype=np.uint32)
_SLICE_BYTES = 1 << 19


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash (32 bits) after each byte; the first 31 lack bytes before them."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h[k:] += h[:-k] << np.uint32(k)
    return h


def boundaries(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For each text (data from one offset to the next) where its chunks end, as offsets into data."""
    h = gear(data)
    whole = np.append((data[1:] & 0xC0) != 0x80, True)  # what follows begins a character
    easy = np.flatnonzero((h >> np.uint32(32 - _EASY) == 0) & whole) + 1
    hard = easy[h[easy - 1] >> np.uint32(32 - _HARD) == 0].tolist()
    easy = easy.tolist()
    out = []
    for p, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        cuts = []
        while end - p > LEAST:
            i = bisect_left(hard, p + LEAST)
            if i < len(hard) and hard[i] < min(p + NORMAL, end):
                p = hard[i]
            else:
                i = bisect_left(easy, p + NORMAL)
                if i < len(easy) and easy[i] < min(p + MOST, end):
                    p = easy[i]
                elif end - p <= MOST:
                    break
                else:
                    p += MOST
                    while not whole[p - 1]:
                        p -= 1
            cuts.append(p)
        if end > p:
            cuts.append(end)
        out.append(cuts)
    return out


def chunk(text: str) -> list[str]:
    """One text's chunks; joined they are the text."""
    raw = text.encode()
    cuts = boundaries(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    return [raw[a:b].decode() for a, b in zip([0, *cuts], cuts, strict=False)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, node (a hash of id and text), and the fingerprint: digests, in order, and lengths.  A null or empty text has none; equal rows have a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").cast(pa.large_string()).fill_null("")
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            i = 0
            while i < len(text):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _SLICE_BYTES, "right")) - 1)
                j = min(j, len(text))
                own = offsets[i : j + 1] - offsets[i]
                data = raw[offsets[i] : offsets[j]]
                digests, lengths, counts = [], [], []
                if len(data):
                    view = memoryview(data)
                    for p, cuts in zip(own[:-1].tolist(), boundaries(data, own), strict=True):
                        found = {}
                        for c in cuts:
                            found[xxhash.xxh3_64_intdigest(view[p:c])] = c - p
                            p = c
                        digests += found
                        lengths += found.values()
                        counts.append(len(found))
                else:
                    counts = [0] * (j - i)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), lists(np.array(digests, np.uint64).view(np.int64), np.array(counts), pa.int64()), lists(np.array(lengths, np.int32), np.array(counts), pa.int32())], names=["doc_id", "node", "digests", "lengths"])
                i = j

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("doc_id", "text").alias("node"), "text").mapInArrow(run, "doc_id bigint, node bigint, digests array<bigint>, lengths array<int>")


def _sized(digests: Column, lengths: Column) -> Column:
    """Digests with their chunk's length in the lowest 11 bits (MOST is less than 2,048), so that an intersection of sets has its weight with it."""
    return F.zip_with(digests, lengths, lambda d, n: d.bitwiseAND(F.lit(-2048)).bitwiseOR(n.cast("bigint")))


def _weight(sized: Column) -> Column:
    """The bytes of chunks as _sized gives them."""
    return F.aggregate(sized, F.lit(0).cast("bigint"), lambda s, d: s + d.bitwiseAND(F.lit(2047)))


def classes(prints: DataFrame) -> DataFrame:
    """class (a hash of a digest set), its least doc_id (null if it has no other), how many documents (distinct in id and text) have it, and its fingerprint; empty fingerprints are left out."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    each = prints.where(F.size("digests") > 0).withColumn("class", F.xxhash64(F.array_sort("digests")))
    return each.groupBy("class").agg(F.min(rank).alias("least"), F.count_distinct("node").alias("copies"), F.min(F.struct("node", "digests", "lengths")).alias("p")).select("class", "least", "copies", "p.digests", "p.lengths")


def containers(own: DataFrame) -> DataFrame:
    """class, shared_bytes (in chunks that another class has too), links (how many other classes hold at least LINK of it), and of all others the one that holds most: container_id (its least doc_id) and contained.

    own: classes.  Every pair of classes that shares a chunk counts, with the exact containment; ties go to the least doc_id.  Pairs that share a
    chunk of at most HOT classes are listed, and those chunks summed.  The other chunks are treated by patterns: the set of them that a class has.  What two classes
    share of them depends on their patterns alone, so that it is found once for two patterns that meet, and counts for as many classes as have them.
    """
    chunks = own.select("class", F.explode(_sized(F.col("digests"), F.col("lengths"))).alias("chunk"))
    each = keep(chunks.join(chunks.groupBy("chunk").agg(F.count("*").alias("n")).where("n > 1"), "chunk"))
    size = lambda c: F.col(c).bitwiseAND(F.lit(2047))
    hot = each.where(F.col("n") > HOT).groupBy("class").agg(F.sort_array(F.collect_set("chunk")).alias("hot")).withColumn("pattern", F.xxhash64("hot"))
    known = keep(own.select("class", "least", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("bytes")).join(each.groupBy("class").agg(F.sum(size("chunk")).alias("shared_bytes")), "class").join(hot, "class", "left"))
    enough = lambda c: F.col(c) / F.col("bytes") >= LINK
    best = lambda c, least: F.min(F.struct((-F.col(c)).alias("less"), F.col(least).alias("least")))
    # Chunks of the same classes go as one.
    held = each.where(F.col("n") <= HOT).groupBy("chunk").agg(F.sort_array(F.collect_list("class")).alias("classes")).groupBy("classes").agg(F.sum(size("chunk")).alias("rare"))
    pairs = held.select("rare", "classes", F.explode("classes").alias("class")).select("rare", "class", F.explode("classes").alias("other")).where("other <> class").groupBy("class", "other").agg(F.sum("rare").alias("rare"))
    both = pairs.join(known.select("class", "bytes", "hot"), "class").join(known.select(F.col("class").alias("other"), F.col("least").alias("other_least"), F.col("hot").alias("other_hot")), "other")
    both = both.withColumn("common", F.coalesce(_weight(F.array_intersect("hot", "other_hot")), F.lit(0))).withColumn("all", F.col("rare") + F.col("common"))
    # Patterns count what two classes share of the frequent chunks; here only what the others add to it.
    listed = both.groupBy("class").agg(F.count_if(enough("all") & ~enough("common")).alias("listed"), best("all", "other_least").alias("best_listed"))
    members = known.where("pattern is not null")
    first = members.select("pattern", "least", F.row_number().over(W.partitionBy("pattern").orderBy("least")).alias("i")).where("i <= 2")
    first = first.groupBy("pattern").agg(F.min(F.when(F.col("i") == 1, F.col("least"))).alias("a"), F.min(F.when(F.col("i") == 2, F.col("least"))).alias("b"))
    patterns = keep(members.groupBy("pattern").agg(F.count("*").alias("members"), F.min("hot").alias("hot")).join(first, "pattern"))
    of = patterns.select("pattern", F.explode("hot").alias("chunk"))
    meet = of.join(of.select(F.col("pattern").alias("other"), "chunk"), "chunk").where("other <> pattern").groupBy("pattern", "other").agg(F.sum(size("chunk")).alias("common"))
    level = meet.join(patterns.select(F.col("pattern").alias("other"), "members", "a"), "other").groupBy("pattern", "common").agg(F.sum("members").alias("members"), F.min("a").alias("a"))
    levels = level.groupBy("pattern").agg(F.collect_list(F.struct("common", "members")).alias("levels"), best("common", "a").alias("best_other"))
    out = known.join(listed, "class", "left").join(patterns.select("pattern", "members", "a", "b").join(levels, "pattern", "left"), "pattern", "left")
    out = out.withColumn("own", _weight(F.col("hot")))
    others = F.aggregate("levels", F.lit(0).cast("bigint"), lambda s, x: s + F.when(x.common / F.col("bytes") >= LINK, x.members).otherwise(0))
    none = F.lit(0).cast("bigint")
    links = F.coalesce("listed", none) + F.coalesce(others, none) + F.when(enough("own"), F.col("members") - 1).otherwise(none)
    alike = F.when(F.col("members") > 1, F.struct((-F.col("own")).alias("less"), F.when(F.col("a") == F.col("least"), F.col("b")).otherwise(F.col("a")).alias("least")))
    out = out.withColumn("best", F.least("best_listed", "best_other", alike))
    return out.select("class", "shared_bytes", links.alias("links"), F.col("best.least.doc_id").alias("container_id"), (-F.col("best.less") / F.col("bytes")).alias("contained"))


def corpus_containment(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, its bytes, how many of them are in chunks that any other document has too, that share (containment in the rest of the corpus), and its place among the others.

    class_id and copies: the least doc_id of the documents with the same digest set, and how many they are.  container_id and
    contained: of all other sets the one that holds most of it, and the containment in it; links: how many of them hold at least LINK
    of it (see containers).  Rows equal in doc_id and text are one document, not others of each other, and each has its row.  An empty fingerprint (of a
    null or empty text) has containment 0, no links and null for the rest.  A text may be of any length; an empty table gives no rows; a null doc_id comes back as null.
    """
    prints = keep(fingerprints(docs))
    own = keep(classes(prints))
    total = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda s, x: s + x)
    known = own.select("class", "least", "copies").join(containers(own), "class", "left")
    out = prints.withColumn("class", F.when(F.size("digests") > 0, F.xxhash64(F.array_sort("digests")))).join(known, "class", "left").withColumn("bytes", total)
    none = F.lit(0).cast("bigint")
    out = out.withColumn("shared_bytes", F.when(F.col("copies") > 1, F.col("bytes")).otherwise(F.coalesce("shared_bytes", none)))
    return out.select("doc_id", "digests", "lengths", "bytes", "shared_bytes", F.when(F.col("bytes") > 0, F.col("shared_bytes") / F.col("bytes")).otherwise(F.lit(0.0)).alias("containment"), F.col("least.doc_id").alias("class_id"), "copies", F.coalesce("links", none).alias("links"), "container_id", "contained")
