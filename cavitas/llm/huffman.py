"""Operator 9, token ids as canonical length-limited Huffman blocks.

Texts are tokenised once; ids are counted over all documents (one number per id
reaches the driver, so the vocabulary bounds it) and give a canonical
Huffman code of at most LIMIT bits. The ids, range-partitioned by doc_id, are
packed into independent blocks of whole documents, each with its documents'
lengths and the bit offset of every EVERY-th id. The folder `blocks` holds Parquet files of such
blocks, which ascend by doc_id; the folder `code` holds the bits of each id's code, from
which a reader builds the canonical code. Nothing else is needed to read. Reading decodes all
stretches between checkpoints side by side, one table lookup per id.

Edge cases: a null or empty text is the end id alone; documents of any length
stay in one block; repeated rows are kept each, those of one doc_id in the order of
their ids; a null doc_id comes first. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cavitas.llm.shared import scratch_path, slices, stored

END_ID = 1
#: Bits of the longest code; the decoding table has 2**LIMIT entries.
LIMIT = 16
#: Ids between two checkpoints, and ids from which a block is closed.
EVERY, BLOCK = 128, 1 << 18
#: Bytes that a task holds at most in words and their ids before it forgets them, and bytes of an entry besides these.
MOST_HELD, ENTRY = 272 << 20, 160
#: Latin letters in lower case.
LETTERS = "".join(chr(c) for c in (*range(97, 123), *range(223, 247), *range(248, 256)))
#: Words of Latin letters and the marks that end them. An apostrophe may start a contraction; no added token has this form.
LETTERS_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def _width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


class Tokens:
    """The library's tokenizer, asked once for each distinct word between blanks.

    Blanks and line feeds end a word for the tokenizer and leave no id, so the
    ids of a text are those of its words, one after another. Words of Latin letters and
    the marks that end them are asked for apart, the letters in lower case and of the model, as the tokenizer lowers
    case and parts letters from marks itself. Added tokens are one id each.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = _width(self.tokenizer.get_vocab_size())
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.held_words = self.held_parts = 0
        #: What the pre-tokenizer makes of each letter, if it leaves their runs whole; the model may then be asked for such words directly.
        self.forms = {ord(c): self._form(c) for c in LETTERS}
        self.direct = self._form(LETTERS) == "".join(self.forms.values())

    @property
    def held(self) -> int:
        return self.held_words + self.held_parts

    def _form(self, text: str) -> str:
        """What the model is asked for; with blanks between, if that is several words."""
        text = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return " ".join(x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)) if self.tokenizer.pre_tokenizer else text

    def _letters(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Words of LETTERS alone."""
        tokenize, order = self.tokenizer.model.tokenize, np.dtype(self.width).char
        for word in words:
            ids = [t.id for t in tokenize(word if word.isascii() else word.translate(self.forms))]
            yield word, struct.pack(f"<{len(ids)}{order}", *ids)

    def _one_by_one(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        for word, found in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            yield word, np.asarray(found.ids, self.width).tobytes()

    def _learn(self, words: list[bytes]) -> None:
        letters, others, cores, marks = set(), set(), [], []
        for raw in words:
            word = raw.decode("utf-8", "replace")
            found = LETTERS_MARKS.fullmatch(word) if self.direct else None
            core, mark = (found[1].lower(), found[2]) if found else (word, "")
            if core not in self.parts:
                (letters if found else others).add(core)
            if mark and mark not in self.parts:
                others.add(mark)
            cores.append(core)
            marks.append(mark)
        self.parts.update(self._letters(letters))
        self.parts.update(self._one_by_one(list(others)))
        for some, width in ((letters, 1), (others, 4)):
            self.held_parts += width * sum(map(len, some)) + sum(map(len, map(self.parts.__getitem__, some))) + ENTRY * len(some)
        own = [self.parts[core] + self.parts[mark] if mark else self.parts[core] for core, mark in zip(cores, marks, strict=True)]
        self.known.update(zip(words, own, strict=True))
        self.held_words += sum(map(len, words)) + sum(map(len, own)) + ENTRY * len(words)

    def encode_column(self, texts: pa.Array) -> pa.Array:
        """Each text's ids, with the end id, as little-endian integers of the tokenizer's width; null counts as empty."""
        if not len(texts):
            return pa.array([], pa.binary())
        words = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.cast(pa.binary()), b""), pattern=b"\n", replacement=b" "), pattern=b" ")
        coded = words.flatten().dictionary_encode()
        own = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.held > MOST_HELD:  # parts give words again without the tokenizer, so they stay longer
            self.known.clear()
            self.held_words = 0
            if self.held_parts > MOST_HELD // 2:
                self.parts.clear()
                self.held_parts = 0
        found = list(map(self.known.get, own))
        if None in found:
            self._learn([w for w, ids in zip(own, found, strict=True) if ids is None])
            found = map(self.known.__getitem__, own)
        ids = pa.array([*found, np.asarray([END_ID], self.width).tobytes()], pa.binary())
        ends = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))
        taken = ids.take(pa.array(np.insert(coded.indices.to_numpy(), ends, len(own))))
        places = np.frombuffer(taken.buffers()[1], np.int32)[np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])]
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(places), taken.buffers()[2]])

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.string())).to_pylist()


@lru_cache(maxsize=1)
def tokens_of(path: str) -> Tokens:
    return Tokens(path)


def _tokenise(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens_of(path)
        for batch in slices(batches, "text", 8 << 20):
            yield pa.record_batch([batch["doc_id"], own.encode_column(batch["text"])], names=["doc_id", "ids"])

    return run


def _ids(column: pa.Array, size: int) -> np.ndarray:
    """The ids of all rows, one after another."""
    wide = column.cast(pa.large_binary())
    if not len(wide):
        return np.zeros(0, _width(size))
    _, places, data = wide.buffers()
    first, last = np.frombuffer(places, np.int64)[[wide.offset, wide.offset + len(wide)]]
    return np.frombuffer(data or b"", np.uint8)[first:last].view(_width(size))


def _count(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in slices(batches, "ids"):
            total += np.bincount(_ids(batch["ids"], size), minlength=size)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["id", "n"])

    return run


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most limit bits, by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(float)
    weights, levels = leaf, []  # per level: which entries of the merged list are leaves
    for _ in range(limit - 1):
        n = len(weights) // 2
        pairs = weights[: 2 * n].reshape(n, 2).sum(axis=1)
        merged = np.concatenate([leaf, pairs])
        by = np.argsort(merged, kind="stable")
        levels.append(by < len(leaf))
        weights = merged[by]
    take = 2 * (len(leaf) - 1)  # entries taken of the last list; packages open two of the list before
    taken = np.zeros(len(leaf), np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        taken[:leaves] += 1
        take = 2 * (take - leaves)
    taken[:take] += 1
    lengths[order] = taken
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes by id, and the decoding table: for each LIMIT-bit prefix id << 5 | length."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    own = lengths[ids]
    ends = np.cumsum(np.left_shift(1, LIMIT - own))
    starts = ends - np.left_shift(1, LIMIT - own)
    codes = np.zeros(len(lengths), np.uint64)
    codes[ids] = starts >> (LIMIT - own)
    table = np.zeros(1 << LIMIT, np.int64)
    table[: ends[-1] if len(ids) else 0] = np.repeat(ids << 5 | own, ends - starts)
    return codes, table


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of the ids, and the bit offset of every EVERY-th."""
    size = lengths[ids]
    at = np.cumsum(size) - size
    word, shift = at >> 5, 64 - (at & 31) - size
    both = codes[ids] << shift.astype(np.uint64)
    if not len(ids):
        return b"", at
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    out[word[first]] = np.add.reduceat(both >> np.uint64(32), first)  # no two codes share a bit
    out[word[first] + 1] += np.add.reduceat(both & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes(), at[::EVERY]


def unpack(bits: list[bytes], points: list[np.ndarray], sizes: list[int], table: np.ndarray) -> np.ndarray:
    """The ids of several blocks, one after another; all stretches are decoded side by side."""
    data = np.frombuffer(b"".join(bits) + b"\0" * 8, np.uint8).astype(np.uint32)
    word = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    base = np.cumsum([0, *map(len, bits)])[:-1] * 8
    at = np.concatenate([p + b for p, b in zip(points, base, strict=True)]).astype(np.int64)
    left = np.concatenate([np.minimum(EVERY, n - np.arange(len(p)) * EVERY) for p, n in zip(points, sizes, strict=True)])
    table = table.astype(np.uint32)
    out = np.zeros((EVERY, len(at)), np.uint32)
    order = np.argsort(-left, kind="stable")  # the shorter stretches end first
    at, live = at[order], np.searchsorted(-left[order], -np.arange(EVERY), side="left")
    for k in range(EVERY):
        n = live[k]
        if not n:
            break
        own = at[:n]
        entry = table[word[own >> 3] >> (32 - LIMIT - (own & 7)).astype(np.uint32) & ((1 << LIMIT) - 1)]
        out[k, :n] = entry >> 5
        own += entry & 31
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out.T[back][np.arange(EVERY) < left[:, None]]


def _write(size: int, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, lengths = model.value
        start, block, docs, sizes, waiting = 0, 0, [], [], []

        def close() -> pa.RecordBatch:
            nonlocal start, block, docs, sizes, waiting
            ids = np.frombuffer(b"".join(waiting), _width(size))
            bits, points = pack(ids, codes, lengths)
            row = [pa.array([block], pa.int64()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([docs], pa.list_(kind)), pa.array([sizes], pa.list_(pa.int64())), pa.array([bits], pa.binary()), pa.array([points.tolist()], pa.list_(pa.int64()))]
            start, block, docs, sizes, waiting = start + len(ids), block + 1, [], [], []
            return pa.record_batch(row, names=["block", "start", "n", "docs", "sizes", "bits", "points"])

        n = 0
        for batch in batches:
            kind = batch["doc_id"].type
            for doc, ids in zip(batch["doc_id"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                docs.append(doc)
                sizes.append(len(ids) // np.dtype(_width(size)).itemsize)
                waiting.append(ids)
                n += sizes[-1]
                if n >= BLOCK:
                    yield close()
                    n = 0
        if docs:
            yield close()

    return run


def _read(share):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = share.value
        for batch in batches:
            for k in range(0, batch.num_rows, 4):
                rows = batch.slice(k, 4)
                points = [np.asarray(p, np.int64) for p in rows["points"].to_pylist()]
                ids = unpack(rows["bits"].to_pylist(), points, rows["n"].to_pylist(), table).astype("<u4")
                sizes = [np.asarray(x, np.int64) for x in rows["sizes"].to_pylist()]
                starts = np.concatenate([a + np.cumsum(x) - x for a, x in zip(rows["start"].to_pylist(), sizes, strict=True)])
                flat = np.concatenate(sizes)
                ends = np.cumsum(flat)
                crc = [zlib.crc32(ids[a:b].data) for a, b in zip((ends - flat).tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch([rows["docs"].flatten(), pa.array(starts), pa.array(flat), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def _lengths(rows: DataFrame) -> np.ndarray:
    """Bits by id of the rows (id, bits); one row per id of the vocabulary reaches the driver."""
    found = rows.toPandas()
    lengths = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.int64)
    lengths[found["id"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return lengths


def write(docs: DataFrame, path: str, into: str | None = None) -> str:
    """Tokenise docs with the tokenizer at path and write the files; returns their folder (one in the shared folder if not given)."""
    spark = docs.sparkSession
    into = into or scratch_path(spark, "token_files")
    kind = dict(docs.dtypes)["doc_id"]
    size = tokens_of(path).tokenizer.get_vocab_size()
    tokens = stored(docs.select("doc_id", "text").mapInArrow(_tokenise(path), f"doc_id {kind}, ids binary"), "tokens")
    found = tokens.select("ids").mapInArrow(_count(size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[found["id"].to_numpy()] = found["n"].to_numpy()
    lengths = code_lengths(counts)
    model = spark.sparkContext.broadcast((canonical(lengths)[0], lengths))
    spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths) if n], "id int, bits int").coalesce(1).write.parquet(f"{into}/code")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = tokens.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.length("ids")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.length("ids"), "ids")
    schema = f"block long, start long, n long, docs array<{kind}>, sizes array<long>, bits binary, points array<long>"
    blocks = ranged.mapInArrow(_write(size, model), schema).withColumn("part", F.spark_partition_id())
    blocks.write.option("compression", "zstd").parquet(f"{into}/blocks")
    return into


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, decoded from the files in the folder."""
    files = spark.read.parquet(f"{path}/blocks")
    kind = files.schema["docs"].dataType.elementType.simpleString()
    table = spark.sparkContext.broadcast(canonical(_lengths(spark.read.parquet(f"{path}/code")))[1])
    # one row per file
    totals = files.groupBy("part").agg(F.sum("n").alias("total"))
    before = F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = files.join(totals.select("part", before.alias("before")), "part").withColumn("start", F.col("start") + F.col("before"))
    rows = blocks.select("start", "n", "docs", "sizes", "bits", "points")
    return rows.mapInArrow(_read(table), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
