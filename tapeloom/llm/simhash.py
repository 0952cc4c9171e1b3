"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components.

Two of 64-bit fingerprints that differ in at most 4 bits agree in at least two of six blocks. Fingerprints (each once,
however many documents have it) are therefore joined on every pair of blocks. A bucket of many fingerprints is divided
again by pairs of blocks of the bits that its key leaves free, so that one key never makes one task; what is still large after the
last division is linked over values halfway between. In a bucket the distances are verified and a star for each component is
kept: connectivity is whole, but its size is linear.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_hot, map_columns, packed, stored
from .components import components

BITS = 4
SEED = 42
#: Blocks into which free bits are split: pairs within BITS share at least BLOCKS - BITS of them.
BLOCKS = BITS + 2
#: Fingerprints of a bucket beyond which it is divided again; how often at most.
LARGE, DEPTH = 2_048, 3


def fingerprint(text: str | None, words: int = 4, digest=None) -> int:
    """The fingerprint as an unsigned integer: ASCII lower case, words between ASCII white space, shingles of ``words``
    words with repeats, XXH64 with seed 42; a bit is 1 if set in over half of the hashes. No words: zero."""
    if digest is None:
        from xxhash import xxh64_intdigest as digest
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    n = len(parts) - words + 1
    if n <= 1:
        return digest(b" ".join(parts), SEED)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    hashes = np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts, ends[words - 1 :].tolist(), strict=True)), np.uint64, n)
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)
    over = 2 * bits.sum(0, dtype=np.int64) > n
    return int.from_bytes(np.packbits(over).tobytes(), "big")


def fingerprints(documents: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every whole text; a null text counts as empty."""

    def make():
        from xxhash import xxh64_intdigest as digest

        def f(ids, texts):
            made = np.array([fingerprint(t, words, digest) for t in texts], np.uint64)
            return {"doc_id": ids, "fp": made.view(np.int64).tolist()}

        return f

    return map_columns(documents, ["doc_id", "text"], [("doc_id", "long"), ("fp", "long")], make)


def masks(free: int, blocks: int = BLOCKS) -> list[int]:
    """The pairs of blocks of the bits set in ``free``, each as a mask."""
    at = [i for i in range(64) if free >> i & 1]
    size = [sum(1 << i for i in at[k * len(at) // blocks : (k + 1) * len(at) // blocks]) for k in range(blocks)]
    return [sum(x) for x in combinations(size, blocks - BITS)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bits_of(x: int) -> F.Column:
    return F.lit(signed(x)).cast("long")


def keyed(points: DataFrame, depth: int) -> DataFrame:
    """fp, mask (fixed bits), key: a row for each pair of blocks of the bits that ``mask`` leaves free."""
    if depth == 0:
        known = masks((1 << 64) - 1)
        return points.select("fp", F.explode(F.array(*map(bits_of, known))).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    level = {0: masks((1 << 64) - 1)}
    for _ in range(depth):  # masks of the level before, and those of each
        level = {f: [f | m for m in masks(((1 << 64) - 1) & ~f)] for f in sorted({f for inner in level.values() for f in inner})}
    table = F.expr("map(" + ", ".join(f"{signed(f)}L, array({', '.join(f'{signed(m)}L' for m in inner)})" for f, inner in level.items()) + ")")
    inner = F.coalesce(table[F.col("mask")], F.raise_error(F.concat(F.lit("no blocks for the mask "), F.hex("mask"))))
    rows = points.select("fp", F.explode(inner).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    return rows.distinct()  # two ways may lead to one mask


def forest(points: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """A star for each component of ``points`` (distinct unsigned integers) under links of at most ``bits`` differing bits: pairs of its
    first point and each other. Points that aren't reached yet are compared with each that is: no link is listed."""
    waiting, pairs = np.ones(len(points), bool), []
    for first in range(len(points)):
        if not waiting[first]:
            continue
        waiting[first] = False
        reached = [first]
        while reached:
            i = reached.pop()
            near = np.flatnonzero(waiting)
            near = near[np.bitwise_count(points[near] ^ points[i]) <= bits].tolist()
            waiting[near] = False
            reached += near
            pairs += [(first, j) for j in near]
    return pairs


def bucket_links(batches):
    """Links of each run of equal (mask, key) in sorted rows; a run may go over batches."""
    held: list[np.ndarray] = []
    last = None
    out_a: list[int] = []
    out_b: list[int] = []

    def close():
        points = np.unique(np.concatenate(held)).view(np.uint64) if held else np.zeros(0, np.uint64)
        if len(points) == 2:
            pairs = [(0, 1)] if int(points[0] ^ points[1]).bit_count() <= BITS else []
        else:
            pairs = forest(points) if len(points) > 2 else []
        for i, j in pairs:
            out_a.append(int(points[i].view(np.int64)))
            out_b.append(int(points[j].view(np.int64)))

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
        out_a.clear(), out_b.clear()
        return batch

    for batch in batches:
        fp, mask, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(fp):
            continue
        edge = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        for part in np.split(np.arange(len(fp)), edge):
            this = (mask[part[0]], key[part[0]])
            if this != last:
                close()
                held.clear()
                last = this
            held.append(fp[part].copy())
        if len(out_a) > 10_000:
            yield flush()
    close()
    yield flush()


def halfway(points: DataFrame) -> DataFrame:
    """a, b: links of buckets that stay large. Two fingerprints differ in at most BITS bits if and only if some value differs from each in at
    most half as many. Every fingerprint is sent to all such values (of the bits that its mask leaves free), and those that meet at one
    are linked to the least of them: linear in the bucket, whatever its size."""
    free = [((1 << 64) - 1) & ~m for m in sorted({r["mask"] & ((1 << 64) - 1) for r in points.select("mask").distinct().collect()})]  # at most the masks of the last level

    def flips(bits: int) -> list[int]:
        at = [1 << i for i in range(64) if bits >> i & 1]
        return [0, *(sum(x) for n in range(1, BITS // 2 + 1) for x in combinations(at, n))]

    table = {signed(~f & ((1 << 64) - 1)): np.array([signed(x) for x in flips(f)], np.int64) for f in free}

    def spread(batches):
        for batch in batches:
            fp, mask = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for start in range(0, len(fp), 512):
                few, which = fp[start : start + 512], mask[start : start + 512]
                met = [x ^ table[int(m)] for x, m in zip(few, which)]
                if met:
                    size = [len(x) for x in met]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(few, size)), pa.array(np.repeat(which, size)), pa.array(np.concatenate(met))], names=["fp", "mask", "value"])

    rows = points.select("fp", "mask").mapInArrow(spread, "fp long, mask long, value long")
    least = rows.groupBy("mask", "value").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = rows.join(least.hint("merge"), ["mask", "value"]).filter("fp != b")
    return met.select(F.col("fp").alias("a"), "b").distinct()


def links(points: DataFrame) -> DataFrame:
    """a, b: pairs of different fingerprints of ``points`` (column fp, each once) that connect all that differ in at most four bits,
    directly or by others, and no more."""
    whole, level = None, points
    for depth in range(DEPTH):
        rows = keyed(level, depth)
        rows = rows.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("mask", "key"))).filter("m > 1")
        rows = stored(rows)  # few: most buckets hold one fingerprint
        small = rows.filter(F.col("m") <= LARGE)
        made = small.select("fp", "mask", "key").repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(bucket_links, "a long, b long")
        whole = made if whole is None else whole.unionByName(made)
        level = stored(rows.filter(F.col("m") > LARGE).select("fp", "mask"))
        if level.isEmpty():
            return whole
    return whole.unionByName(halfway(level))


def near_duplicates(documents: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links; its own, if none; null if no
    row of the group has a doc_id). A null or empty text, or one without words, has fingerprint zero and is linked like any other; texts of
    any length are read whole. Rows that share a doc_id stay, each with its own fingerprint. An empty table gives no rows; other
    columns of ``documents`` are left aside, whatever their names."""
    marked = cut(fingerprints(documents.select("doc_id", "text"), words))
    points = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("_rows")))
    by_fp = stored(components(stored(links(points.select("fp")))).withColumnRenamed("node", "fp"))  # linked fingerprints only
    linked = stored(points.join(by_fp.hint("merge"), "fp"))
    least = stored(linked.groupBy("component").agg(F.min("first").alias("component_id")))
    named = join_hot(linked, least, "component").select("fp", "component_id")
    alone = points.join(by_fp.select("fp").hint("merge"), "fp", "left_anti").select("fp", F.col("first").alias("component_id"))
    whole = join_hot(marked, stored(named.unionByName(alone)), "fp", counts=points.select("fp", "_rows"))
    return whole.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame, words: int = 4) -> DataFrame:
    """The documents that stand for their component (the one with the smallest doc_id), each once, with all columns of ``documents``,
    whatever their names. Where one doc_id has several rows, the one with the least hash of its text stays; rows without a doc_id
    are their own only if none of their group has one, and one such row stays for each fingerprint. Null, empty and long texts and
    empty tables are as in ``near_duplicates``."""
    groups = near_duplicates(documents, words)
    chosen = stored(groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("key")).distinct())
    rows = packed(documents.filter(F.col("doc_id").isNotNull()), key=F.col("doc_id"), sign=F.xxhash64("text"))
    kept = rows.groupBy("key").agg(F.min_by("row", "sign").alias("row")).join(chosen.hint("merge"), "key", "left_semi")
    nameless = documents.filter(F.col("doc_id").isNull())
    if not groups.filter("doc_id IS NULL AND component_id IS NULL").isEmpty():
        own = groups.filter("component_id IS NULL").select("fingerprint").distinct()
        signs = fingerprints(nameless.withColumn("doc_id", F.xxhash64("text")), words).select(F.col("doc_id").alias("sign"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"))
        signs = stored(signs.distinct().join(own.hint("merge"), "fingerprint", "left_semi").groupBy("fingerprint").agg(F.min("sign").alias("sign")))
        few = packed(nameless, sign=F.xxhash64("text")).join(signs.select("sign").hint("merge"), "sign", "left_semi").groupBy("sign").agg(F.first("row").alias("row"))
        kept = kept.select("row").unionByName(few.select("row"))
    return kept.select("row.*")
