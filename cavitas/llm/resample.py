"""Operator 13, importance resampling towards the n-grams of a target table.

Texts are cut into words, and the runs of one to `most` words of a batch of texts lie side by side in one buffer, so that
an n-gram is a stretch of bytes. An open-addressed table of NumPy arrays interns them: keys are their
XXH64, computed for all n-grams at once, and a slot is shared only by equal bytes. A slot has
an n-gram's bucket (crc32 modulo `buckets`) and its count in the batch. Counts per bucket (at most
`buckets` numbers a task) give each bucket's gain; the second reading gathers the gains by each occurrence's slot and
adds them up per document. Gumbel noise from a hash of the id then makes the best `percent` scores a
sample by weight without replacement.

Ranks come from sorted ranges: only the number of rows in each range is summed up globally.

Edge cases: null and empty texts have no features and weight 0; texts of any length are read whole, in pieces of about
BATCH bytes whose last runs reach into the next one; repeated rows count and are drawn each; ties go to the smaller
doc_id, null first, and a null doc_id is noise of the text '42:'. Without any document of enough words nobody is drawn; an empty target
table has the gains of T = 0. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cavitas.llm.shared import apart, slices, stored, utf8

BUCKETS, LONGEST, SEED = 10_000, 3, 42
LEAST_WORDS, PERCENT = 20, 5
#: Lower-case ASCII letters, digits and all bytes beyond ASCII are parts of words; the rest parts them.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
WORD = re.compile(rb"[^ ]+")
#: Bytes of text whose n-grams are interned together.
BATCH = 1 << 20

# the fixed values of XXH64
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


#: Longest word, and its blank, whose CRC is joined by a table.
JOINED = 64


@lru_cache(maxsize=1)
def _zeros() -> np.ndarray:
    """[n, k, b]: what becomes of byte k of a CRC, b, when n zero bytes follow."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    tables = [np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]]
    for _ in range(JOINED):
        tables.append(tables[-1] >> 8 ^ step[tables[-1] & 255])
    return np.stack(tables)


def joined_crc(crc: np.ndarray, other: np.ndarray | int, size: np.ndarray | int) -> np.ndarray:
    """The crc32 of two byte strings in a row from those of either and the second one's size, JOINED at most."""
    t = _zeros()
    return t[size, 0, crc & 255] ^ t[size, 1, crc >> 8 & 255] ^ t[size, 2, crc >> 16 & 255] ^ t[size, 3, crc >> 24] ^ other


class Stretches:
    """Stretches (start, length) of one buffer, read eight bytes at a time; each is a run of words, from word `first` to word `last`."""

    def __init__(self, buffer: bytes, start: np.ndarray, length: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None):
        self.buffer, self.start, self.length, self.first, self.last = buffer, start, length, first, last
        data = np.zeros(len(buffer) + 8, np.uint8)
        data[: len(buffer)] = np.frombuffer(buffer, np.uint8)
        self.data = data
        self.words = np.ndarray(len(buffer) + 1, "<u8", data, strides=(1,)).astype(np.uint64)
        self.masks = np.asarray([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

    def lane(self, at: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8k to 8k + 7 of the stretches `at`, those beyond the end as zero."""
        return self.words[np.minimum(self.start[at] + 8 * k, len(self.buffer))] & self.masks[np.clip(self.length[at] - 8 * k, 0, 8)]

    def hashes(self) -> np.ndarray:
        """XXH64 with seed 0: those below 32 bytes all together, longer ones one by one."""
        size = self.length.astype(np.uint64)
        h = P5 + size
        place = self.start.copy()
        for k in range(3):
            at = np.flatnonzero((self.length >= 8 * k + 8) & (self.length < 32))
            h[at] = _turned(h[at] ^ _turned(self.words[place[at]] * P2, 31) * P1, 27) * P1 + P4
            place[at] += 8
        at = np.flatnonzero((self.length & 4 > 0) & (self.length < 32))
        h[at] = _turned(h[at] ^ (self.words[place[at]] & self.masks[4]) * P1, 23) * P2 + P3
        place[at] += 4
        for k in range(3):
            at = np.flatnonzero((self.length & 3 > k) & (self.length < 32))
            h[at] = _turned(h[at] ^ self.data[place[at]].astype(np.uint64) * P5, 11) * P1
            place[at] += 1
        h = (h ^ h >> np.uint64(33)) * P2
        h = (h ^ h >> np.uint64(29)) * P3
        h ^= h >> np.uint64(32)
        long = np.flatnonzero(self.length >= 32)
        view = memoryview(self.buffer)
        h[long] = np.fromiter((xxhash.xxh64_intdigest(view[a : a + n]) for a, n in zip(self.start[long].tolist(), self.length[long].tolist(), strict=True)), np.uint64, len(long))
        return h

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes of stretches a and b are the same, pair by pair."""
        same = self.length[a] == self.length[b]
        k = 0
        while True:
            at = np.flatnonzero(same & (self.length[a] > 8 * k))
            if not len(at):
                return same
            if k >= 8:  # the few that are still longer are compared whole
                view = memoryview(self.buffer)
                for i in at.tolist():
                    x, y, n = int(self.start[a[i]]), int(self.start[b[i]]), int(self.length[a[i]])
                    same[i] = view[x : x + n] == view[y : y + n]
                return same
            same[at] = self.lane(a[at], k) == self.lane(b[at], k)
            k += 1


class Interned:
    """The open-addressed table of a batch: which slot each n-gram has; by slot its bucket and its count."""

    def __init__(self, grams: Stretches, buckets: int):
        n = len(grams.start)
        size = 1 << max(4, (2 * n).bit_length())
        key = grams.hashes()
        first = np.full(size, -1, np.int64)  # the n-gram that took the slot
        self.slot = np.zeros(n, np.int64)
        left, at = np.arange(n), (key & np.uint64(size - 1)).astype(np.int64)
        while len(left):
            free = np.flatnonzero(first[at] < 0)
            first[at[free]] = left[free]  # of several, the last one has it
            taken = first[at]
            same = (taken == left) | (key[taken] == key[left])
            other = np.flatnonzero(same & (taken != left))
            same[other] = grams.equal(taken[other], left[other])
            self.slot[left[same]] = at[same]
            left, at = left[~same], (at[~same] + 1) & (size - 1)
        used = np.flatnonzero(first >= 0)
        self.bucket = np.zeros(size, np.int64)
        self.bucket[used] = self._crc(grams, first, used)[used] % buckets
        self.count = np.bincount(self.slot, minlength=size)

    def _crc(self, grams: Stretches, gram: np.ndarray, used: np.ndarray) -> np.ndarray:
        """The crc32 of each used slot's n-gram: of different words it is computed, of runs of words joined."""
        found, view = np.zeros(len(gram), np.uint32), memoryview(grams.buffer)
        size = grams.last[gram[used]] - grams.first[gram[used]]

        def direct(slots: np.ndarray) -> None:
            where = zip(grams.start[gram[slots]].tolist(), grams.length[gram[slots]].tolist(), strict=True)
            found[slots] = np.fromiter((zlib.crc32(view[a : a + k]) for a, k in where), np.uint32, len(slots))

        direct(used[size == 0])
        single = np.flatnonzero(grams.last == grams.first)
        words = int(grams.last.max(initial=-1)) + 1
        crc, length = np.zeros(words, np.uint32), np.full(words, JOINED, np.int64)  # a word that begins no run counts as long
        crc[grams.first[single]], length[grams.first[single]] = found[self.slot[single]], grams.length[single]
        blank = np.uint32(zlib.crc32(b" "))
        for k in range(1, int(size.max(initial=0)) + 1):
            slots = used[size == k]
            at = grams.first[gram[slots]]
            short = np.max([length[at + j] for j in range(k + 1)], axis=0) < JOINED
            direct(slots[~short])
            slots, at = slots[short], at[short]
            run = crc[at]
            for j in range(1, k + 1):
                run = joined_crc(joined_crc(run, blank, 1), crc[at + j], length[at + j])
            found[slots] = run
        return found


def pieces(text: bytes, most: int = LONGEST) -> Iterator[tuple[bytes, int]]:
    """The words of a text, parted by one blank, in pieces of about BATCH bytes, and how many words are a piece's own.

    Up to most - 1 words of the next piece follow, for the runs that begin in this one.
    """
    plain, at = text.translate(WORD_BYTES), 0
    while at < len(plain):
        cut = plain.find(b" ", at + BATCH) if at + BATCH < len(plain) else -1
        end = cut if cut >= 0 else len(plain)
        words = plain[at:end].split()
        after = [m[0] for m in islice(WORD.finditer(plain, end), most - 1)] if end < len(plain) else []
        if words:
            yield b" ".join(words + after), len(words)
        at = end


def together(texts: list[bytes], most: int = LONGEST) -> Iterator[list[tuple[int, bytes, int]]]:
    """The pieces of the texts, each with its text's place, in groups of about BATCH bytes."""
    group, size = [], 0
    for i, text in enumerate(texts):
        for line, own in pieces(text, most):
            group.append((i, line, own))
            size += len(line)
            if size >= BATCH:
                yield group
                group, size = [], 0
    if group:
        yield group


def grams(group: list[tuple[int, bytes, int]], most: int = LONGEST) -> tuple[Stretches, np.ndarray]:
    """All runs of up to `most` words that begin with a piece's own words, and the text of each run."""
    texts, lines, own = zip(*group, strict=True)
    words = np.asarray([x.count(b" ") + 1 for x in lines], np.int64)
    buffer = b" ".join(lines)
    gaps = np.flatnonzero(np.frombuffer(buffer, np.uint8) == 0x20)
    start, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(buffer)]])
    piece = np.repeat(np.arange(len(lines)), words)
    begins = np.arange(len(piece)) - np.repeat(np.cumsum(words) - words, words) < np.asarray(own)[piece]
    starts, lengths, owners, firsts, lasts = [], [], [], [], []
    for k in range(1, min(most, len(piece)) + 1):
        i = np.flatnonzero(begins[: len(piece) - k + 1] & (piece[: len(piece) - k + 1] == piece[k - 1 :]))
        starts.append(start[i])
        lengths.append(end[i + k - 1] - start[i])
        owners.append(np.asarray(texts)[piece[i]])
        firsts.append(i)
        lasts.append(i + k - 1)
    return Stretches(buffer, *map(np.concatenate, (starts, lengths, firsts, lasts))), np.concatenate(owners)


def _count(buckets: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text", BATCH):
            for group in together(utf8(batch["text"]), most):
                table = Interned(grams(group, most)[0], buckets)
                total += np.bincount(table.bucket, table.count, buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, most: int = LONGEST) -> np.ndarray:
    """Occurrences in each bucket over all rows of texts; one row per bucket reaches the driver."""
    found = texts.select("text").mapInArrow(_count(buckets, most), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(buckets, np.int64)
    for r in found:
        counts[r["bucket"]] = r["n"]
    return counts


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier a bucket is in the target, with one more of each bucket on either side."""
    up, down = (target + 1.0) * (own.sum() + float(len(own))), (own + 1.0) * (target.sum() + float(len(own)))
    return np.floor(1000.0 * np.log(up / down)).astype(np.int64)


def _weigh(gain: np.ndarray, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH):
            words, features, weight = np.zeros((3, batch.num_rows), np.int64)
            for group in together(utf8(batch["text"]), most):
                own, of = grams(group, most)
                table = Interned(own, len(gain))
                np.add.at(weight, of, gain[table.bucket][table.slot])
                features += np.bincount(of, minlength=len(features))
                np.add.at(words, [i for i, _, _ in group], [n for _, _, n in group])
            columns = [c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != "text"]
            names = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, (words, features, weight))], names=[*names, "n_words", "n_features", "weight"])

    return run


def weights(docs: DataFrame, target: DataFrame, keep: tuple[str, ...] = (), buckets: int = BUCKETS, most: int = LONGEST) -> DataFrame:
    """doc_id, keep, n_words, n_features and weight of every row of docs against the texts of target."""
    gain = gains(bucket_counts(docs, buckets, most), bucket_counts(target, buckets, most))
    rows = docs.select("doc_id", *keep, "text")
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "text")
    return rows.mapInArrow(_weigh(gain, most), f"{kinds}, n_words long, n_features long, weight long")


def with_scores(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds score: the weight and Gumbel noise by the id, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return rows.withColumn("score", F.col("weight") + noise)


def ranked(rows: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Adds rank: 1, 2, 3 ... for the best percent of the rows of enough words, null for the others.

    rows: a stored table with doc_id, n_words and score. Eligible rows are sorted in ranges and written;
    a row's place is its place in its range after the rows of all ranges before.
    """
    spark = rows.sparkSession
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    able = rows.where(F.col("n_words") >= least_words)
    ranged = stored(able.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftrightunsigned("at", 33)
    sizes = sorted(map(tuple, ranged.groupBy(part.alias("part")).agg(F.count("*"), F.min("at")).collect()))  # one row per partition
    before, shifts = 0, []
    for k, n, first in sizes:
        shifts.append((k, first - before - 1))
        before += n
    drawn = percent * before // 100
    starts = spark.createDataFrame(shifts, "part long, shift long")
    placed = ranged.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.col("at") - F.col("shift")).drop("part", "shift", "at")
    rest = rows.where(F.col("n_words").isNull() | (F.col("n_words") < least_words)).withColumn("rank", F.lit(None).cast("long"))
    return placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(rest)


def score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs."""
    rows = stored(with_scores(weights(docs, target)), "scores")
    return ranked(rows).select("doc_id", "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The drawn rows of docs, in all their columns."""
    own, back = apart(docs, "row", "n_words", "n_features", "weight", "score", "rank")
    rows = stored(own.withColumn("row", F.monotonically_increasing_id()), "rows")
    chosen = ranked(stored(with_scores(weights(rows, target, ("row",))), "scores")).where("rank is not null").select("row")
    return rows.join(chosen, "row", "left_semi").select(*own.columns).withColumnsRenamed(back)
