"""Operator 7, SimHash near-duplicates by bit-sliced comparison.

Fingerprints are computed per document inside tasks. Only distinct fingerprints
are compared. Two that differ in at most r of 64 bits agree on at least two of
r + 2 bands of bits, so each fingerprint is dealt to one bucket per pair of
bands; within a bucket the bit planes are stored vertically, carry-save
counters add up the differing planes of many pairs at once, and a block is
abandoned once every pair in it exceeds the radius. Buckets above
LARGE_BUCKET are dealt out anew by bands of their remaining bits, which loses no link,
for as long as that lowers the rows in such buckets; what it cannot part lies close
together, and a spanning forest reaches it in few steps. A bucket gives the links of a spanning forest of its own, never all
pairs of a group; components then grow by alternating star contractions.

Edge cases: a null or word-free text has fingerprint zero and links like any
other; repeated rows share a fingerprint; a null doc_id is ignored when the
smallest id of a component is sought, and a component of null ids alone has a
null component_id. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cavitas.llm.shared import apart, slices, stored, utf8

BITS = 64
SEED = 42
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Buckets of more fingerprints are dealt out anew by their remaining bits.
LARGE_BUCKET = 20_000
#: Buckets of up to so many fingerprints are compared by shifts, all together.
SMALL_BUCKET = 48
#: Hashes turned into bits at once.
AT_ONCE = 1 << 16


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """The SimHash of one text, as an unsigned number."""
    words = WORD.findall(text.translate(LOWER))
    if not words:
        return 0
    joined, width = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), AT_ONCE):
        bits = np.unpackbits(hashes[i : i + AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.asarray([fingerprint(t, shingle) for t in utf8(batch["text"])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """The rows of docs and their fingerprint fp as a signed long."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(_fingerprints(shingle), f"{kinds}, fp long")


def _bands(at: list[int], n: int) -> list[list[int]]:
    return [list(x) for x in np.array_split(np.asarray(at), n)]


def _mask(bits: list[int]) -> int:
    return sum(1 << int(b) for b in bits)


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> BITS - 1 else mask


def _planes(fp: np.ndarray) -> np.ndarray:
    """(64, n) bits, the highest first."""
    return np.unpackbits(fp.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).T


def within(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Whether pairs of packed columns (64, n bytes each) differ in at most `radius` planes.

    Three carry-save counters hold the differences modulo 8; `over` keeps every
    pair that has passed the radius, and the rest of the planes is left out
    once that is all of them.
    """
    n = max(left.shape[1], right.shape[1])
    one, two, four, over = (np.zeros(n, np.uint8) for _ in range(4))
    for k in range(BITS):
        differ = left[k] ^ right[k]
        carry = one & differ
        one ^= differ
        higher = two & carry
        two ^= carry
        over |= four & higher
        four ^= higher
        if k >= radius and k % 4 == 3:
            over |= _above(one, two, four, radius)
            if over.all() and (over == 255).all():
                break
    return ~(over | _above(one, two, four, radius))


def _above(one: np.ndarray, two: np.ndarray, four: np.ndarray, radius: int) -> np.ndarray:
    found = np.zeros_like(one)
    for count in range(radius + 1, 8):
        found |= (one if count & 1 else ~one) & (two if count & 2 else ~two) & (four if count & 4 else ~four)
    return found


def _small(fp: np.ndarray, bucket: np.ndarray, size: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links in small buckets: every row against the row d places on, for all buckets at once."""
    place = np.arange(len(fp)) - np.repeat(np.flatnonzero(np.diff(bucket, prepend=-1)), size[np.flatnonzero(np.diff(bucket, prepend=-1))])
    found = []
    for d in range(1, int(size.max(initial=0))):
        i = np.flatnonzero(place + d < size)
        for at in np.array_split(i, max(1, len(i) // AT_ONCE)):
            near = np.unpackbits(within(np.packbits(_planes(fp[at]), axis=1), np.packbits(_planes(fp[at + d]), axis=1), radius))[: len(at)].astype(bool)
            found.append((fp[at[near]], fp[at[near] + d]))
    return found


def _large(fp: np.ndarray, radius: int, block: int = 4096) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of one large bucket: each row reached is compared with those not reached yet."""
    left, found, queue = fp, [], []
    blocks: list[np.ndarray] = []
    alive = np.zeros(0, bool)
    while len(left) or queue:
        if alive.sum() * 2 < len(alive) or not len(alive):
            left = left[alive] if len(alive) else left
            alive = np.ones(len(left), bool)
            blocks = [np.packbits(_planes(left[i : i + block]), axis=1) for i in range(0, len(left), block)]
        if not queue:
            rest = np.flatnonzero(alive)
            if not len(rest):
                break
            queue.append(left[rest[0]])
            alive[rest[0]] = False
        x = queue.pop()
        column = np.where(_planes(np.asarray([x], np.uint64)) > 0, 255, 0).astype(np.uint8)
        near = np.concatenate([np.unpackbits(within(b, column, radius))[: min(block, len(left) - k * block)] for k, b in enumerate(blocks)]).astype(bool) & alive
        if near.any():
            alive &= ~near
            found.append((np.full(int(near.sum()), x), left[near]))
            queue.extend(left[near])
        if not alive.any():
            break
    return found


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if batches else None
        if table is None or not table.num_rows:
            return
        key, fp = (table[c].to_numpy() for c in ("bucket", "fp"))
        table = None
        band = np.concatenate([[True], key[1:] != key[:-1]])
        bucket = np.cumsum(band) - 1
        size = np.bincount(bucket)[bucket]
        fp, found = fp.view(np.uint64), []
        small = (size > 1) & (size <= SMALL_BUCKET)
        if small.any():
            found += _small(fp[small], bucket[small], size[small], radius)
        for b in np.unique(bucket[size > SMALL_BUCKET]):
            lo, hi = np.searchsorted(bucket, [b, b + 1])
            found += _large(fp[lo:hi], radius)
        if found:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _anew(radius: int):
    """Rows of large buckets, dealt by bands of the bits outside the bucket's own.

    These bits of two linked fingerprints differ in radius places at most, so one of radius + 1 bands agrees.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch["mask"].to_numpy()
            for mask in np.unique(held):
                rows = batch.filter(pa.array(held == mask))
                own = int(mask) % (1 << BITS)
                for k, band in enumerate(_bands([b for b in range(BITS) if not own >> b & 1], radius + 1)):
                    wider = pa.array(np.full(rows.num_rows, _signed(own | _mask(band)), np.int64))
                    turn = pa.array(np.full(rows.num_rows, k, np.int32))
                    yield pa.record_batch([rows["fp"], rows["bucket"], turn, wider], names=["fp", "of", "t", "mask"])

    return run


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b) links between distinct fingerprints: enough of them to connect each component.

    fps: one row per distinct fp.
    """
    groups = _bands(list(range(BITS)), radius + 2)
    masks = [_mask(x + y) for x, y in combinations(groups, 2)]

    cases = F.array(*(F.struct(F.lit(k).alias("t"), F.lit(_signed(m)).alias("mask")) for k, m in enumerate(masks)))
    dealt = fps.select("fp", F.explode(cases).alias("of")).select("fp", F.xxhash64("of.t", F.col("fp").bitwiseAND(F.col("of.mask"))).alias("bucket"), "of.mask")
    done, before = [], None
    while True:
        heavy = stored(dealt.groupBy("bucket").count().where(F.col("count") > LARGE_BUCKET), "heavy")
        now = heavy.agg(F.sum("count")).first()[0]
        if now is None or before is not None and now >= before:
            break
        done.append(dealt.join(heavy, "bucket", "left_anti"))
        again = dealt.join(heavy, "bucket", "left_semi").mapInArrow(_anew(radius), "fp long, of long, t int, mask long")
        dealt = stored(again.select("fp", F.xxhash64("of", "t", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"), "mask"), "dealt")
        before = now
    for part in done:
        dealt = dealt.unionByName(part)
    rows = dealt.select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket", "fp")
    return rows.mapInArrow(_links(radius), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of the edges (a, b) the smallest node it is connected to.

    Alternates the two star contractions until the edges no longer change, however many rounds that takes: each
    round lowers an edge's end or leaves all as they are, so it ends. Every round is written to the shared folder, so no lineage piles up.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for k in count():
        if k % 2 == 0:  # large star: a node's larger neighbours go to its smallest
            near = both(edges)
            low = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
            edges = near.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:  # small star: a node and its smaller neighbours go to the smallest of them
            low = edges.groupBy("a").agg(F.min("b").alias("low"))
            edges = edges.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
        edges = stored(edges.where("a <> b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if k % 2 and now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        if k % 2:
            state = now


def classes(rows: DataFrame, radius: int = 4) -> DataFrame:
    """fp, root and component_id for every fingerprint of rows (doc_id, fp)."""
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    root = components(links(fps.select("fp"), radius))
    found = fps.join(root, fps.fp == root.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    return found.join(found.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp (signed) and component_id for every row of docs."""
    rows = stored(fingerprints(docs.select("doc_id", "text"), shingle).select("doc_id", "fp"), "fingerprints")
    return rows.join(classes(rows, radius), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, null last."""
    own, back = apart(docs, "fp", "row", "root")
    rows = stored(fingerprints(own, shingle).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).getField("row").alias("row")
    chosen = rows.select("doc_id", "row", "fp").join(classes(rows.select("doc_id", "fp"), radius), "fp").groupBy("root").agg(first)
    return rows.join(chosen.select("row"), "row", "left_semi").select(*own.columns).withColumnsRenamed(back)
