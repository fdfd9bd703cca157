"""Operator 6, removal of repeated passages by difference-cover suffix sorts.

Candidates. Every string of LENGTH bytes has a least gram (GRAM bytes, by a hash), and equal
strings have equal ones. Texts are stored once in blocks of about BLOCK bytes. Each block asks
about the hashes of its least grams; a hash that one document alone has rules its
strings out. The others go on as pieces: the bytes of successive starts with the same
least gram. This loses nothing and decides nothing.

Dealing. A piece goes to the task of its gram's hash, so equal strings meet. Equal pieces of a
block travel once, with their smallest document. A gram of over HEAVY occurrences
would fill one task; its strings are dealt one by one, by hashes of the strings themselves.

Suffix sort. Letters are words of 8 bytes; a suffix goes on 8 bytes later. Of
every three successive letters two begin sampled suffixes (a difference cover
modulo 3). Triples of letters of the sampled suffixes are sorted and named, and triples
of names again, until names are distinct or reach LENGTH bytes. The remaining suffixes are
sorted by first letter and the rank of the sampled suffix that follows, and merged
with the others by the difference-cover comparison. Neighbours in the order whose LENGTH bytes
are equal, byte for byte, form a group; a string is removed wherever its document is not
the smallest of its group. Each sort takes whole grams, about AT_ONCE pieces; grams
with a single piece, or of a single document, have no neighbour and are left out.

Why not one sort of all suffixes: its triples, names and ranks are some 130 bytes for each byte
of the candidates, which exceeds four times the input on disk; pieces are about 4.

Edge cases: a null text is empty; texts under LENGTH bytes are never touched; a null doc_id
counts as larger than all others, and documents of equal id do not match each
other; repeated rows are treated each; doc_id has to be an integer, anything else is
refused. Other columns of any name are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cavitas.llm.shared import slices, stored, utf8

LENGTH = 50
GRAM = 24
WINDOW = LENGTH - GRAM + 1
#: Bytes of text in a block, and bytes of text for each task that hashes or pieces go to.
BLOCK, SHARE = 1 << 20, 1 << 24
#: Starts hashed at once.
HASHED = 1 << 18
#: Pieces sorted at once, and occurrences from which a gram's strings are dealt one by one.
AT_ONCE, HEAVY = 1 << 12, 1 << 14
NO_ID = np.iinfo(np.int64).max
_FACTOR = 0x9E3779B97F4A7C15
_LETTERS = np.random.default_rng(6).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
#: A piece has at most WINDOW starts; letters are looked up to two letters past its end.
LONGEST = LENGTH + WINDOW - 1
WIDTH = LONGEST + 24
SAMPLED = np.asarray([o for o in range(LONGEST) if o // 8 % 3])
#: What goes from task to task: an answer's or a piece's block, and packed columns.
DEALT = "bucket int, kind int, block long, columns binary, bytes binary"
ANSWERS = "block long, bucket int, columns binary"


def _powers(n: int) -> np.uint64:
    return np.uint64(pow(_FACTOR, n, 1 << 64))


def hashes(x: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit polynomial hash of the `length` bytes from each place on."""
    have, out, done = _LETTERS[x], None, 0
    n = 1
    while True:
        if length & n:
            tail = have[done:] if out is not None else have
            out = have if out is None else out[: len(tail)] * _powers(n) + tail[: len(out)] if done else have
            done += n
        if n * 2 > length:
            break
        have = have[:-n] * _powers(n) + have[n:] if len(have) > n else have[:0]
        n *= 2
    out = out[: max(0, len(x) - length + 1)]
    out = (out ^ out >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(29)


def _sliding(a: np.ndarray, width: int, f: Callable) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        a, n = f(a[:-n], a[n:]), 2 * n
    return f(a[: len(a) - (width - n)], a[width - n :]) if width > n else a


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal entries begin."""
    return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])) if len(columns[0]) else np.zeros(0, np.int64)


def press(*columns: np.ndarray) -> bytes:
    """Columns of equal length, byte by byte of their entries, compressed."""
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns]
    return zstandard.compress(b"".join(planes), 3)


def unpress(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, found = len(raw) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes, strict=True):
        found.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).reshape(-1).view(kind))
        at += n * size
    return found


class Block:
    """Rows of a stored block, and the runs of starts in them that share their least gram."""

    def __init__(self, data: bytes):
        self.batch = next(iter(pa.ipc.open_stream(data)))
        texts = utf8(self.batch["text"])
        self.docs = np.asarray([NO_ID if x is None else x for x in self.batch["doc_id"].to_pylist()], np.int64)
        self.sizes = np.asarray([len(t) for t in texts], np.int64)
        self.bytes = b"".join(texts)
        self.x = np.frombuffer(self.bytes, np.uint8)

    def runs(self) -> None:
        """at, n, hash and doc of every run: its first start, its number of starts, the hash of its gram."""
        total, ends = len(self.x) - LENGTH + 1, np.cumsum(self.sizes)
        crossing = np.zeros(len(self.x) + 1, bool)  # starts whose string would leave its text
        for a, b in zip((ends - self.sizes).tolist(), ends.tolist(), strict=True):
            crossing[max(a, b - LENGTH + 1) : b] = True
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for low in range(0, max(0, total), HASHED):
            least = _sliding(hashes(self.x[low : low + HASHED + LENGTH - 1], GRAM), WINDOW, np.minimum)
            out = crossing[low : low + len(least)]
            edges = _edges(least, out)
            n = np.diff(np.append(edges, len(least)))[~out[edges]]
            edges = edges[~out[edges]]
            pieces = -(-n // WINDOW)
            nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            at = np.repeat(edges, pieces) + nth * WINDOW
            found.append((low + at, np.minimum(np.repeat(n, pieces) - nth * WINDOW, WINDOW), least[at]))
        self.at, self.n, self.hash = (np.concatenate(c) for c in zip(*found, strict=True))
        self.doc = self.docs[np.searchsorted(ends, self.at, side="right")] if len(self.at) else self.at

    def strings(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the strings that start there."""
        out = np.empty(len(at), np.uint64)
        for low in range(0, len(self.x), HASHED):
            own = (at >= low) & (at < low + HASHED)
            if own.any():
                out[own] = hashes(self.x[low : low + HASHED + LENGTH - 1], LENGTH)[at[own] - low]
        return out

    def asked(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes, ascending and cut to their upper bits; where each run's is; occurrences << 1 | in several documents."""
        spread = self.hash * np.uint64(_FACTOR)  # least hashes are small; after this they are even again
        short = (spread ^ spread >> np.uint64(32)) * np.uint64(_FACTOR) >> np.uint64(64 - bits)
        order = np.argsort(short, kind="stable")
        first = _edges(short[order])
        count = np.diff(np.append(first, len(order)))
        several = np.minimum.reduceat(self.doc[order], first) != np.maximum.reduceat(self.doc[order], first) if len(first) else first > 0
        place = np.empty(len(order), np.int64)
        place[order] = np.repeat(np.arange(len(first)), count)
        return short[order][first], place, (np.minimum(count, 0x7FFF) << 1 | several).astype("<u2")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with all their columns, as compressed Arrow streams of about BLOCK bytes of text."""
    block = TaskContext.get().partitionId() << 33
    packed = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
    for batch in slices(batches, "text", BLOCK):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=packed) as out:
            out.write_batch(batch)
        size = sum(map(len, utf8(batch["text"])))
        yield pa.record_batch([pa.array([block], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "size", "data"])
        block += 1


def _limits(n: int, bits: int) -> np.ndarray:
    return np.asarray([(k << bits) // n for k in range(1, n)], np.uint64)


def _ask(n: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch["block"].to_pylist(), batch["data"], strict=True):
                block = Block(data.as_py())
                block.runs()
                short, _, code = block.asked(bits)
                cuts = [0, *np.searchsorted(short, _limits(n, bits)).tolist(), len(short)]
                rows = [(k, number, press(np.diff(short[a:b], prepend=short[a] * 0), code[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]  # noqa: B905
                if rows:
                    bucket, own, columns = zip(*rows, strict=True)
                    yield pa.record_batch([pa.array(own, pa.int64()), pa.array(bucket, pa.int32()), pa.array(columns, pa.binary())], names=["block", "bucket", "columns"])

    return run


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for whole in batches:
        for at in range(0, whole.num_rows, 32):
            batch = whole.slice(at, 32)
            yield from zip(*(batch[c].to_pylist() for c in names), strict=True)


def _answer(heavy: int):
    """For each hash that a block asked about: 0 no other document has it, 1 some has, 2 it is a heavy one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in groupby(_rows(batches, "bucket", "block", "columns"), key=lambda r: r[0]):
            blocks, parts = zip(*((b, unpress(c, "<u8", "<u2")) for _, b, c in rows), strict=True)
            short, code = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(short, kind="stable")
            first = _edges(short[order])
            sizes = np.diff(np.append(first, len(order)))
            code = code[order].astype(np.int64)
            shared = (sizes > 1) | (np.bitwise_or.reduceat(code, first) & 1 > 0)
            found = np.where(shared, np.where(np.add.reduceat(code >> 1, first) > heavy, 2, 1), 0).astype(np.uint8)
            out = np.empty(len(order), np.uint8)
            out[order] = np.repeat(found, sizes)
            each = np.split(out, np.cumsum([len(p[0]) for p in parts])[:-1])
            yield pa.record_batch([pa.array(blocks, pa.int64()), pa.array([bucket] * len(blocks), pa.int32()), pa.array([press(x) for x in each], pa.binary())], names=["block", "bucket", "columns"])

    return run


def _deal(n: int, bits: int):
    """Pieces to the tasks of their grams, and to the block itself (kind 0) where each piece lies."""

    def rows_of(number: int, data: bytes, answers: list) -> Iterator[tuple]:
        block = Block(data)
        block.runs()
        _, place, _ = block.asked(bits)
        found = np.concatenate([np.zeros(0, np.uint8), *(unpress(c, "u1")[0] for _, c in sorted(answers))])[place]
        at, count, doc, key = block.at[found == 1], block.n[found == 1], block.doc[found == 1], block.hash[found == 1]
        if (found == 2).any():
            each, ends = block.n[found == 2], np.cumsum(block.n[found == 2])
            alone = np.repeat(block.at[found == 2] - (ends - each), each) + np.arange(ends[-1])
            at, count = np.concatenate([at, alone]), np.concatenate([count, np.ones(len(alone), np.int64)])
            doc, key = np.concatenate([doc, np.repeat(block.doc[found == 2], each)]), np.concatenate([key, block.strings(alone)])
        text, distinct = block.bytes, {}
        index = np.asarray([distinct.setdefault(text[a:b], len(distinct)) for a, b in zip(at.tolist(), (at + count + LENGTH - 1).tolist(), strict=True)], np.int64)
        least = np.full(len(distinct), NO_ID)
        np.minimum.at(least, index, doc)
        _, first = np.unique(index, return_index=True)
        key, pieces = key[first], list(distinct)
        yield number % n, 0, number, press(np.diff(at, prepend=0).astype("<i4"), index.astype("<u4"), count.astype(np.uint8), (doc > least[index]).astype(np.uint8)), None
        bucket = (key % np.uint64(n)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = [*_edges(bucket[order]).tolist(), len(order)]
        for a, b in zip(cuts, cuts[1:]):  # noqa: B905
            own = order[a:b]
            columns = press(np.diff(own, prepend=0).astype("<u4"), count[first][own].astype(np.uint8), (key[own] >> np.uint64(32)).astype("<u4"), least[own])
            yield int(bucket[own[0]]), 1, number, columns, zstandard.compress(b"".join([pieces[k] for k in own.tolist()]), 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            for number, data, answers in zip(batch["block"].to_pylist(), batch["data"], batch["answers"].to_pylist(), strict=True):
                rows = rows_of(number, data.as_py(), [(a["bucket"], a["columns"]) for a in answers])
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "kind", "block", "columns", "bytes"])

    return run


def named(*keys: np.ndarray) -> np.ndarray:
    """The rank, from 1, of each row of keys; equal rows share it."""
    order = np.lexsort(keys[::-1])
    sorted_keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in sorted_keys], axis=0)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def sampled_ranks(word: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ranks (pieces, places) of the sampled suffixes, 0 elsewhere.

    Triples of letters are named; triples of names are named again until all names
    differ or stand for LENGTH bytes. Only what a start's comparison reaches is ranked at the end.
    """
    row, at = np.nonzero(sizes[:, None] > SAMPLED)
    at, reach = SAMPLED[at], 24
    names = np.zeros((len(word), WIDTH + 3 * LENGTH), np.int64)
    names[row, at] = named(word[row, at], word[row, at + 8], word[row, at + 16])
    while reach < LENGTH and len(at) > names.max(initial=0):
        wanted = at < starts[row] + 16 if 3 * reach >= LENGTH else at >= 0
        row, at = row[wanted], at[wanted]
        found = named(*(names[row, at + k * reach] for k in range(3)))
        names = np.zeros_like(names)
        names[row, at] = found
        reach *= 3
    return names


def merge_order(x: dict[str, np.ndarray]) -> np.ndarray:
    """The order of suffixes: sampled ones by rank, the rest merged in by the difference-cover comparison."""
    sampled, rest = np.flatnonzero(x["phase"] > 0), np.flatnonzero(x["phase"] == 0)
    sampled = sampled[np.argsort(x["rank"][sampled], kind="stable")]
    rest = rest[np.lexsort((x["rank1"][rest], x["a"][rest]))]
    if not len(sampled) or not len(rest):
        return np.concatenate([sampled, rest])
    low, high = np.zeros(len(rest), np.int64), np.full(len(rest), len(sampled))
    a, b, r1, r2 = (x[k][rest] for k in ("a", "b", "rank1", "rank2"))
    while (low < high).any():  # binary search of all remaining suffixes at once
        mid = np.minimum((low + high) // 2, len(sampled) - 1)
        s = sampled[mid]
        one = x["phase"][s] == 1
        same = x["a"][s] == a
        second = np.where(one, x["rank1"][s] < r1, (x["b"][s] < b) | ((x["b"][s] == b) & (x["rank2"][s] < r2)))
        less = (x["a"][s] < a) | (same & second)
        open_ = low < high
        low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
    order = np.empty(len(sampled) + len(rest), np.int64)
    # suffixes that agree in all ranked bytes may come in any order; their places still have to ascend
    place = np.maximum.accumulate(low) + np.arange(len(rest))
    order[place] = rest
    free = np.ones(len(order), bool)
    free[place] = False
    order[free] = sampled
    return order


def repeated_starts(pieces: list[bytes], starts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Per piece, bit by bit, whether the string at each start is also in a piece of a smaller document.

    starts: number of starts of each piece, whose bytes end LENGTH - 1 after the last.
    """
    sizes = starts + LENGTH - 1
    text = np.zeros((len(pieces), WIDTH + 7), np.uint8)
    text[np.arange(WIDTH + 7) < sizes[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
    word = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, 8, axis=1)).view(">u8")[:, :, 0].astype(np.uint64)
    rank = sampled_ranks(word, sizes, starts)
    row, at = np.nonzero(np.arange(WINDOW) < starts[:, None])
    own = {"a": word[row, at], "b": word[row, at + 8], "phase": at // 8 % 3}
    order = merge_order(own | {f"rank{k or ''}": rank[row, at + 8 * k] for k in range(3)})
    row, at = row[order], at[order]
    same = np.ones(max(0, len(order) - 1), bool)
    for k in (*range(0, LENGTH - 7, 8), LENGTH - 8):  # all LENGTH bytes of neighbours, 8 at a time
        w = word[row, at + k]
        same &= w[1:] == w[:-1]
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    least = np.repeat(np.minimum.reduceat(docs[row], first), np.diff(np.append(first, len(row))))
    gone = least < docs[row]
    bits = np.zeros(len(pieces), np.uint32)
    np.bitwise_or.at(bits, row[gone], np.uint32(1) << at[gone].astype(np.uint32))
    return bits


def _bucket(rows: list[tuple], at_once: int) -> Iterator[tuple[int, bytes]]:
    """Answers to the blocks of one bucket's pieces: index and bits of the pieces with something to remove."""
    distinct: dict[bytes, int] = {}
    blocks, index, counts, classes, least, owner = [], [], [], [], [], []
    for block, columns, data in rows:
        own, count, part, doc = unpress(columns, "<u4", "u1", "<u4", "<i8")
        ends = np.cumsum(count.astype(np.int64) + LENGTH - 1)
        data = zstandard.decompress(data)
        owner.append(np.asarray([distinct.setdefault(data[a:b], len(distinct)) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], np.int64))
        blocks.append(block)
        for column, value in ((index, np.cumsum(own, dtype=np.uint32)), (counts, count), (classes, part), (least, doc)):
            column.append(value)
    whose, doc = np.concatenate(owner), np.concatenate(least)
    smallest = np.full(len(distinct), NO_ID)
    np.minimum.at(smallest, whose, doc)
    _, first = np.unique(whose, return_index=True)
    count, part = np.concatenate(counts)[first].astype(np.int64), np.concatenate(classes)[first]
    bits, pieces = np.zeros(len(distinct), np.uint32), list(distinct)
    order = np.argsort(part, kind="stable")
    edges = _edges(part[order])
    sizes = np.diff(np.append(edges, len(order)))
    mixed = np.minimum.reduceat(smallest[order], edges) < np.maximum.reduceat(smallest[order], edges)
    order, sizes = order[np.repeat(mixed, sizes)], sizes[mixed]
    ends = np.cumsum(sizes)
    a = 0
    while a < len(order):  # whole grams, about at_once pieces at a time
        b = int(ends[min(np.searchsorted(ends, a + at_once), len(ends) - 1)])
        own = order[a:b]
        bits[own] = repeated_starts([pieces[k] for k in own.tolist()], count[own], smallest[own])
        a = b
    for block, own, of, value in zip(blocks, index, owner, least, strict=True):
        found = np.where(smallest[of] < value, (1 << count[of]) - 1, bits[of]).astype("<u4")
        if found.any():
            yield block, press(own[found > 0], found[found > 0])


def _sort(at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = [pa.int64(), pa.int32(), pa.binary()], ["block", "kind", "columns"]
        for (_, kind), rows in groupby(_rows(batches, "bucket", "kind", "block", "columns", "bytes"), key=lambda r: r[:2]):
            found = [(b, kind, c) for b, c in (_bucket([r[2:] for r in rows], at_once) if kind else ((r[2], r[3]) for r in rows))]
            if found:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    return run


def covered(block: Block, parts: list[tuple[int, bytes]]) -> np.ndarray:
    """Which bytes of the block's texts the removed strings cover."""
    turn = np.zeros(len(block.x) + 1, np.int32)

    def remove(at: np.ndarray, n: np.ndarray | int) -> None:
        np.add.at(turn, at, 1)
        np.add.at(turn, at + n + LENGTH - 1, -1)

    for kind, columns in sorted(parts):
        if not kind:
            step, index, count, larger = unpress(columns, "<i4", "<u4", "u1", "u1")
            at = np.cumsum(step, dtype=np.int64)
            remove(at[larger > 0], count[larger > 0])
            least = np.flatnonzero(larger == 0)
            least = least[np.argsort(index[least], kind="stable")]
        else:
            wanted, bits = unpress(columns, "<u4", "<u4")
            low, high = (np.searchsorted(index[least], wanted, side=s) for s in ("left", "right"))
            row = least[np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low) + np.arange(int((high - low).sum()))]
            bits = np.repeat(bits, high - low)
            for k in range(WINDOW):
                remove(at[row[bits >> np.uint32(k) & 1 > 0]] + k, 1)
    return np.cumsum(turn[:-1]) > 0


def _digests(block: Block, gone: np.ndarray) -> pa.RecordBatch:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of a block's rows."""
    rows, ends = [], np.cumsum(block.sizes)
    for a, b in zip((ends - block.sizes).tolist(), ends.tolist(), strict=True):
        own = gone[a:b]
        rows.append((b - a, int(own.sum()), int((np.diff(own.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(block.x[a:b][~own].tobytes()).hexdigest()))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.record_batch([block.batch["doc_id"], *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _kept(block: Block, gone: np.ndarray) -> pa.RecordBatch:
    """A block's rows, their texts without the characters all of whose bytes are covered."""
    if gone.any():
        first = np.flatnonzero(block.x & 0xC0 != 0x80)
        whole = np.logical_and.reduceat(gone, first)
        stays = ~np.repeat(whole, np.diff(np.append(first, len(block.x))))
        ends = np.cumsum(block.sizes)
        texts = [block.x[a:b][stays[a:b]].tobytes().decode("utf-8", "replace") for a, b in zip((ends - block.sizes).tolist(), ends.tolist(), strict=True)]
        text = pa.array([t if some else None for t, some in zip(texts, block.batch["text"].is_valid().to_pylist(), strict=True)], block.batch["text"].type)
        columns = [text if c == "text" else block.batch[c] for c in block.batch.schema.names]
        return pa.RecordBatch.from_arrays(columns, schema=block.batch.schema)
    return block.batch


def _finish(give: Callable[[Block, np.ndarray], pa.RecordBatch]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, parts in zip(batch["data"], batch["parts"].to_pylist(), strict=True):
                block = Block(data.as_py())
                yield give(block, covered(block, [(p["kind"], p["columns"]) for p in parts or []]))

    return run


def _without_repeats(docs: DataFrame, give: Callable[[Block, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """give's rows for every block of docs and the bytes to remove from it."""
    if dict(docs.dtypes)["doc_id"] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("suffixes: doc_id has to be an integer, as documents are compared by it")
    blocks = stored(docs.mapInArrow(_blocks, "block long, size long, data binary"), "blocks")
    total = blocks.agg(F.sum("size")).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(min(parts, 24), -(-total // SHARE))
    bits = min(64, total.bit_length() + 8)  # so that few hashes agree by chance
    blocks = blocks.select("block", "data")

    def dealt(df: DataFrame, *order: str) -> DataFrame:
        return df.repartition(n, "bucket").sortWithinPartitions("bucket", *order)

    answers = dealt(blocks.mapInArrow(_ask(n, bits), ANSWERS)).mapInArrow(_answer(HEAVY), ANSWERS)
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "columns")).alias("answers"))
    pieces = dealt(blocks.join(answers, "block").mapInArrow(_deal(n, bits), DEALT), "kind").mapInArrow(_sort(AT_ONCE), "block long, kind int, columns binary")
    found = pieces.groupBy("block").agg(F.collect_list(F.struct("kind", "columns")).alias("parts"))
    return blocks.join(found, "block", "left").mapInArrow(_finish(give), schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    kind = dict(docs.dtypes)["doc_id"]
    return _without_repeats(docs.select("doc_id", "text"), _digests, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame) -> DataFrame:
    """docs with all columns, their texts without repeated passages."""
    return _without_repeats(docs, _kept, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))
