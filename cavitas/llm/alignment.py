"""Operator 12, alignment of two tokenizers' tokens by skipping along diagonals.

Each text is encoded by a byte-level BPE vocabulary (A) and a piece vocabulary with byte fallback (B).
Both see a blank and the text. Where a blank follows another character no token of either goes across, so
the chunks between such places are encoded once per task and remembered.

The end offsets of A's and B's tokens are two rising arrays. At the current shift between
their indexes whole stretches are compared, twice as long each time, and halved at the first difference: a
stretch of equal ends is as many one-to-one groups. The group after it is resolved token by token until two ends meet,
which gives the new shift. Where ends meet, the two tokens that end there are linked.

Links are counted over all rows by (A id, B id). The most frequent pairs, MOST_HELD at most, go to all tasks as sorted
arrays; rarer ones, of which none is in more rows than the least of those counts, are joined by a shuffle.

Edge cases: null and empty texts have no tokens, nor has a text that one of the vocabularies does not give back byte by byte (as one with
U+2581, which is B's blank); the numbers are then 0 and the digest is empty. Texts of any length are
aligned whole, in memory that grows by some 100 bytes for each of their tokens. Repeated rows count and are aligned each;
columns besides doc_id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cavitas.llm.shared import slices, stored, utf8

#: A blank that follows anything but white space; no token of either vocabulary lies across its front.
CUT = re.compile(r"(?<=\S) ")
#: Where a text, after the blank before it, has others.
UNCLEAR = re.compile(r"(?:^|\s) ")
#: B's blank.
MARK = "▁"
BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Bytes that a task's remembered chunks take, about; what one takes beside its text and ids; chunks encoded in one go.
MOST_KNOWN, ENTRY, TOGETHER = 160 << 20, 160, 1000
#: Ends compared one by one before stretches are.
SINGLY = 8
#: Pairs of ids whose counts all tasks hold.
MOST_HELD = 1 << 19


class Rows:
    """Rows of numbers of different lengths, one after another in one array that grows."""

    def __init__(self):
        self.data, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64)
        self.rows = 0

    @staticmethod
    def room(array: np.ndarray, size: int) -> np.ndarray:
        return array if size <= len(array) else np.concatenate([array, np.zeros(max(len(array), size - len(array)), array.dtype)])

    def add(self, numbers: np.ndarray, sizes: np.ndarray) -> None:
        """Rows of these sizes; numbers has all of them."""
        first = int(self.ends[self.rows])
        self.data = self.room(self.data, first + len(numbers))
        self.ends = self.room(self.ends, self.rows + len(sizes) + 1)
        self.data[first : first + len(numbers)] = numbers
        self.ends[self.rows + 1 : self.rows + len(sizes) + 1] = first + np.cumsum(sizes)
        self.rows += len(sizes)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the rows `at`, one row after another, and the size of each."""
        sizes = self.ends[at + 1] - self.ends[at]
        shift = self.ends[at] - (np.cumsum(sizes) - sizes)
        return self.data[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))], sizes


class Vocabularies:
    """The two tokenizers, and the bytes of each of their tokens."""

    def __init__(self, bpe: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(bpe)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.size_b = self.b.get_piece_size()
        visible = byte_characters()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(visible[c] for c in token) if all(c in visible for c in token) else token.encode()
        self.b_bytes = []
        for i in range(self.size_b):
            piece = self.b.id_to_piece(i)
            found = BYTE.fullmatch(piece) if self.b.is_byte(i) else None
            self.b_bytes.append(bytes([int(found[1], 16)]) if found else piece.replace(MARK, " ").encode())
        #: No piece may hold B's blank after another character, or chunks would not be independent.
        self.cuts = not any(MARK in self.b.id_to_piece(i).lstrip(MARK) for i in range(self.size_b) if not self.b.is_control(i) and not self.b.is_unknown(i))
        self.a_length, self.b_length = (np.asarray([len(t) for t in own], np.uint32) for own in (self.a_bytes, self.b_bytes))
        #: Each id as text of one width, before a comma or what stands after the last one of a group.
        self.width = len(str(max(len(self.a_bytes), self.size_b))) + 1
        self.a_text, self.b_text = (np.asarray([[f"{i}{after}" for i in range(n)] for after in (",", last)], f"S{self.width}") for n, last in ((len(self.a_bytes), "|"), (self.size_b, ";")))
        self._forget()

    def _forget(self) -> None:
        #: The number of each chunk that is remembered; `wrong` has those that are not given back.
        self.known: dict[str, int] = {}
        self.a_rows, self.b_rows, self.wrong = Rows(), Rows(), set()
        self.uses = np.zeros(1 << 14, np.int32)
        self.held = 0

    def _forget_most(self) -> None:
        """Keeps the chunks that were met more than once, unless they are many, too."""
        names, used = list(self.known), np.flatnonzero(self.uses[: len(self.known)] > 1)
        (ia, na), (ib, nb), wrong = self.a_rows.take(used), self.b_rows.take(used), self.wrong
        self._forget()
        chunks = [names[k] for k in used.tolist()]
        if sum(map(len, chunks)) + ENTRY * len(chunks) + 4 * (len(ia) + len(ib)) < MOST_KNOWN // 2:
            self._add(chunks, ia, na, ib, nb, [k not in wrong for k in used.tolist()])

    def _one(self, chunk: str) -> tuple[list[int], list[int], bool]:
        """A chunk is a stretch of text after a blank, which B adds itself."""
        a = self.a.encode(" " + chunk, add_special_tokens=False).ids
        b = self.b.encode(chunk) or [self.b.piece_to_id(MARK)]
        data = b" " + chunk.encode()
        return a, b, b"".join([self.a_bytes[i] for i in a]) == data == b"".join([self.b_bytes[i] for i in b])

    def _cut(self, ids: np.ndarray, own: list[bytes], length: np.ndarray, data: bytes, ends: np.ndarray) -> np.ndarray | None:
        """How many ids each chunk has, or None if the ids don't give the chunks back."""
        after = np.cumsum(length[ids])
        if not len(ids) or after[-1] != len(data) or b"".join([own[i] for i in ids.tolist()]) != data:
            return None
        at = np.searchsorted(after, ends)
        return np.diff(at + 1, prepend=0) if (after[at] == ends).all() else None

    def _learn(self, chunks: list[str]) -> None:
        """Many chunks side by side are a text in which they are parted; those that end in white space would not be."""
        plain = [c for c in chunks if self.cuts and c and not c[-1].isspace()]
        alone = [c for c in chunks if not self.cuts or not c or c[-1].isspace()]
        blocks = [plain[k : k + TOGETHER] for k in range(0, len(plain), TOGETHER)]
        texts = [" ".join(block) for block in blocks]
        ours = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        theirs = self.b.encode(texts, num_threads=1)
        for block, text, a, b in zip(blocks, texts, ours, theirs, strict=True):
            ia, ib, data = np.asarray(a.ids, np.int32), np.asarray(b, np.int32), b" " + text.encode()
            ends = np.cumsum([len(c.encode()) + 1 for c in block])
            na, nb = self._cut(ia, self.a_bytes, self.a_length, data, ends), self._cut(ib, self.b_bytes, self.b_length, data, ends)
            if na is None or nb is None:
                alone += block
                continue
            self._add(block, ia, na, ib, nb, [True] * len(block))
        if alone:
            a, b, right = zip(*map(self._one, alone), strict=True)
            flat = [np.asarray([i for x in own for i in x], np.int32) for own in (a, b)]
            self._add(alone, flat[0], np.asarray(list(map(len, a))), flat[1], np.asarray(list(map(len, b))), list(right))

    def _add(self, chunks: list[str], ia: np.ndarray, na: np.ndarray, ib: np.ndarray, nb: np.ndarray, right: list[bool]) -> None:
        first = len(self.known)
        self.known.update(zip(chunks, range(first, first + len(chunks)), strict=True))
        self.wrong.update(first + k for k, good in enumerate(right) if not good)
        self.a_rows.add(ia, na)
        self.b_rows.add(ib, nb)
        self.held += sum(map(len, chunks)) + ENTRY * len(chunks) + 4 * (len(ia) + len(ib))

    @staticmethod
    def _split(text: str) -> list[str]:
        """The chunks of a text where a blank may follow white space, which is no cut."""
        return CUT.split(text)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, ...] | None]:
        """a_ids, a_ends, b_ids, b_ends of each text, or None where it has no tokens."""
        if self.held > MOST_KNOWN:
            self._forget_most()
        parts = [[t] if not self.cuts else t.split(" ") if not UNCLEAR.search(t) else self._split(t) for t in texts]
        chunks = list(chain.from_iterable(parts))
        at = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            self._learn(list(dict.fromkeys(chunks[k] for k in new)))
            at[new] = [self.known[chunks[k]] for k in new]
        self.uses = Rows.room(self.uses, len(self.known))
        self.uses += np.bincount(at, minlength=len(self.uses)).astype(np.int32)
        first = np.cumsum([0, *map(len, parts)])
        wrong = set(np.repeat(np.arange(len(texts)), np.diff(first))[np.isin(at, list(self.wrong))].tolist()) if self.wrong else ()
        (ia, na), (ib, nb) = self.a_rows.take(at), self.b_rows.take(at)
        ends_a, ends_b = (np.concatenate([[0], np.cumsum(n)])[first] for n in (na, nb))
        result: list[tuple[np.ndarray, ...] | None] = []
        for k, text in enumerate(texts):
            if not text or k in wrong:
                result.append(None)
                continue
            a, b = ia[ends_a[k] : ends_a[k + 1]], ib[ends_b[k] : ends_b[k + 1]]
            result.append((a, np.cumsum(self.a_length[a], dtype=np.int64), b, np.cumsum(self.b_length[b], dtype=np.int64)))
        return result


def byte_characters() -> dict[str, int]:
    """The byte of each character that stands for one: printable ones stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def vocabularies(bpe: str, pieces: str) -> Vocabularies:
    return Vocabularies(bpe, pieces)


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group of tokens the number of A's and of B's tokens up to its end. Both arrays rise to the same last end."""
    a, b = a_ends.tolist(), b_ends.tolist()
    wide_a, wide_b = a_ends.astype("<i8").tobytes(), b_ends.astype("<i8").tobytes()
    n, m = len(a), len(b)
    i = j = 0  # the shift is j - i
    starts: list[int] = []  # of each stretch of one-to-one groups, or irregular group: its first end in a and in b, and how many there are
    shifted: list[int] = []
    runs: list[int] = []
    while i < n:
        if a[i] == b[j]:
            run, step = 1, SINGLY
            most = min(n - i, m - j)
            few = min(most, SINGLY)
            while run < few and a[i + run] == b[j + run]:
                run += 1
            if run < SINGLY:
                step = 1
            while step > 1 and run + step <= most and wide_a[8 * (i + run) : 8 * (i + run + step)] == wide_b[8 * (j + run) : 8 * (j + run + step)]:
                run += step
                step *= 2
            while step > 1:  # the first difference lies within the next `step`
                step //= 2
                if run + step <= most and wide_a[8 * (i + run) : 8 * (i + run + step)] == wide_b[8 * (j + run) : 8 * (j + run + step)]:
                    run += step
            starts.append(i)
            shifted.append(j)
            runs.append(run)
            i += run
            j += run
            if i == n:
                break
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        starts.append(i)
        shifted.append(j)
        runs.append(1)
        i += 1
        j += 1
    size = np.asarray(runs, np.int64)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + 1
    return np.repeat(np.asarray(starts, np.int64), size) + within, np.repeat(np.asarray(shifted, np.int64), size) + within


def written(own: Vocabularies, ia: np.ndarray, ib: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> bytes:
    """The groups as text: ids of A, a bar, ids of B; semicolons between groups."""
    last_a, last_b = np.zeros(len(ia), np.int8), np.zeros(len(ib), np.int8)
    last_a[to_a - 1] = last_b[to_b - 1] = 1
    before_b = np.concatenate([[0], to_b[:-1]])
    found = np.empty(len(ia) + len(ib), f"S{own.width}")
    found[np.arange(len(ia)) + np.repeat(before_b, np.diff(to_a, prepend=0))] = own.a_text[last_a, ia]
    found[np.arange(len(ib)) + np.repeat(to_a, np.diff(to_b, prepend=0))] = own.b_text[last_b, ib]
    return found.tobytes().translate(None, b"\0")[:-1]


def _texts(batch: pa.RecordBatch) -> list[str]:
    """Bytes that are no UTF-8 become another character, so such a text is not given back."""
    return [t.decode("utf-8", "replace") for t in utf8(batch["text"])]


def _align(bpe: str, pieces: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabularies(bpe, pieces)
        for batch in slices(batches, "text", 1 << 20):
            rows = []
            for found in own.encode(_texts(batch)):
                if found is None:
                    rows.append(([], [], [], []))
                    continue
                ia, ea, ib, eb = found
                to_a, to_b = groups(ea, eb)
                rows.append((ia, ib, to_a, to_b))
            columns = [pa.array(x, pa.list_(pa.int32())) for x in zip(*rows, strict=True)]
            rest = [c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != "text"]
            yield pa.RecordBatch.from_arrays([*rest, *columns], names=[*(x for x in batch.schema.names if x != "text"), "a_ids", "b_ids", "a_ends", "b_ends"])

    return run


def align(docs: DataFrame, bpe: str, pieces: str) -> DataFrame:
    """doc_id, a_ids, b_ids and, for each group, how many tokens of A (a_ends) and B (b_ends) precede its end."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    lists = ", ".join(f"{c} array<int>" for c in ("a_ids", "b_ids", "a_ends", "b_ends"))
    return docs.select("doc_id", "text").mapInArrow(_align(bpe, pieces), f"doc_id {kind}, {lists}")


def _digest(bpe: str, pieces: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabularies(bpe, pieces)
        for batch in slices(batches, "text", 1 << 20):
            numbers, digests, pairs, times, ends = [], [], [], [], [0]
            for found in own.encode(_texts(batch)):
                if found is None:
                    numbers.append((0, 0, 0))
                    digests.append("")
                    ends.append(0)
                    continue
                ia, ea, ib, eb = found
                to_a, to_b = groups(ea, eb)
                key, n = np.unique(ia[to_a - 1].astype(np.int64) * own.size_b + ib[to_b - 1], return_counts=True)
                pairs.append(key)
                times.append(n)
                ends.append(len(key))
                numbers.append((len(ia), len(ib), len(to_a)))
                digests.append(hashlib.sha256(written(own, ia, ib, to_a, to_b)).hexdigest())
            at = pa.array(list(accumulate(ends)), pa.int32())
            flat = [pa.array(np.concatenate(x) if x else np.zeros(0), pa.int64()) for x in (pairs, times)]
            columns = [*map(pa.array, zip(*numbers, strict=True)), pa.array(digests), *(pa.ListArray.from_arrays(at, x) for x in flat)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])

    return run


def _held(pairs: np.ndarray, counts: np.ndarray, best: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n = (batch[c].flatten().to_numpy() for c in ("pairs", "times"))
            row = np.repeat(np.arange(batch.num_rows), batch["pairs"].value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(pairs, key), max(len(pairs) - 1, 0))
            held = pairs[at] == key if len(pairs) else np.zeros(len(key), bool)
            own = row[held], n[held], at[held]
            sums, bests = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums, own[0], own[1] * counts[own[2]])
            np.add.at(bests, own[0], own[1] * best[own[2]])
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[~held], minlength=batch.num_rows))]), pa.int32())
            left = [pa.ListArray.from_arrays(ends, pa.array(x[~held])) for x in (key, n)]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(sums), pa.array(bests), *left], names=["row", "held_sum", "held_best", "pairs", "times"])

    return run


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """pair, n (links over all rows) and whether that is the highest of the pair's B id. rows: pairs, times."""
    each = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    counts = each.groupBy(F.col("l.pairs").alias("pair")).agg(F.sum("l.times").alias("n")).withColumn("b", F.col("pair") % size_b)
    counts = stored(counts, "pair_counts")
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))
    return counts.join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))  # a row per id of B's vocabulary


def linked(docs: DataFrame, bpe: str, pieces: str, most_held: int = MOST_HELD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>"
    rows = docs.select("doc_id", "text").mapInArrow(_digest(bpe, pieces), schema).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "aligned")
    size_b = vocabularies(bpe, pieces).size_b
    counts = stored(pair_counts(rows, size_b), "counts")
    octaves = {r["o"]: r["c"] for r in counts.groupBy(F.floor(F.log2("n")).alias("o")).agg(F.count("*").alias("c")).collect()}  # 63 at most
    least, held = 63, 0
    while least > 0 and held + octaves.get(least - 1, 0) <= most_held:
        least -= 1
        held += octaves.get(least, 0)
    bound = min(1 << least, (1 << 63) - 1)
    top = counts.where(F.col("n") >= F.lit(bound)).toPandas().sort_values("pair")  # most_held rows at most
    arrays = top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(np.int64)
    known = stored(rows.select("row", "pairs", "times").mapInArrow(_held(*arrays), "row long, held_sum long, held_best long, pairs array<long>, times array<long>"), "held")
    rare = known.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    rare = rare.join(counts.where(F.col("n") < F.lit(bound)), "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("rare_sum"), F.sum(F.when(F.col("best"), F.col("times"))).alias("rare_best"))
    found = rows.drop("pairs", "times").join(known.drop("pairs", "times"), "row").join(rare, "row", "left")
    zero = F.lit(0).cast("long")
    return found.select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        F.col("n_groups").alias("n_links"),  # a token ends at one place, so a place where both end is one link
        (F.col("held_best") + F.coalesce("rare_best", zero)).alias("n_best"),
        (F.col("held_sum") + F.coalesce("rare_sum", zero)).alias("count_sum"),
        "groups_sha256",
    )
