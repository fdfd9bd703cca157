"""Operator 1, byte-level BPE encoding and decoding by DuckDB queries inside each task.

A task cuts its texts into words by the vocabulary's pattern and keeps the
distinct ones. A recursive DuckDB query joins the words' token-position rows to
the merge table and contracts, in every word, the leftmost pair of least rank
until no pair is left. Decoding joins the ids to the vocabulary and
aggregates their bytes in order of position.

In words of over LONG bytes one contraction a step would take too many steps. They are cut where
no token of the vocabulary lies across, as no pair ever goes beyond such a place, and
what is still longer contracts all pairs in one step that have the least rank among the
pairs within `reach` places, reach being the bytes of the longest token found in the
word. The result is that of one pair at a time:

* What comes before such a pair in rank begins outside its reach, and touches it only through a
  token that grew over all places between them, with more bytes than any token in the word has.
* Contracting a pair makes only pairs of higher rank. Were the new token L and its neighbour x to
  make a token T of lower rank, nothing could have crossed T's ends, so T's bytes would have been
  merged as if alone; alone they give T by steps of rising ranks (a test checks this for
  every token of the vocabulary), before L. So equal pairs that do not overlap go in any order.
  Of a run of overlapping ones (aaaa) every other one goes, from the left, and only once the
  whole run is least, so that nothing can take its first token away.

Edge cases: a null or empty text has no tokens and decodes to nothing; a text
of any length is cut into words whole, and a word of any length is encoded whole, in memory
that grows by some 300 bytes for each of its bytes; repeated rows are encoded each; other columns
are kept out of the way, as only doc_id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import tempfile
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property, lru_cache
from sys import getsizeof

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cavitas.llm.shared import slices, utf8

#: Bytes that a task holds at most in chunks and words and their ids before it forgets them, and bytes of an entry besides these.
MOST_HELD, ENTRY = 320 << 20, 80
#: Bytes of these that a worker keeps when a task ends, as other operators' tasks run in it next.
MOST_KEPT = 64 << 20
#: A blank next to white space or to an end of the text; elsewhere blanks part the pattern's words.
UNCLEAR = re.compile(r"\s (?=.)| \s|^ | $", re.DOTALL)
PART = re.compile(r"(?<=\S)(?= \S)")

#: Words of more bytes are cut between tokens, and parts that are still longer merged by LONG_MERGE.
LONG = 64

#: One contraction a step in each word: the pair of least rank, the leftmost of equal ones.
MERGE = """
with recursive t(w, p, tok, nxt, done) as (
    select w, p, tok, nxt, false from start
  union all (
    with pair as materialized (
      select a.w, a.p, a.tok, a.nxt, b.nxt as after, m.into_tok, m.rank::bigint << 32 | a.p as key
      from (select * from t where not done) a
      left join (select p, tok, nxt from t where not done) b on a.nxt = b.p
      left join merges m on m.l = a.tok and m.r = b.tok
    ), least_pair as materialized (
      select w, min(key) as best, arg_min(nxt, key) as gone from pair group by w
    )
    select pair.w, p, case when key = best then into_tok else tok end, case when key = best then after else nxt end, best is null
    from pair join least_pair on pair.w = least_pair.w
    where gone is null or p <> gone
  )
)
select w, list(tok order by p) as ids from t where done group by w order by w
"""

#: The same for long words: every pair goes that is least among the {reach} pairs on either side of it.
LONG_MERGE = """
with recursive t(w, p, tok, done) as (
    select w, p, tok, false from start
  union all
    select w, p, case when chosen then into_tok else tok end, not more
    from (
      select *, coalesce(lag(chosen) over (partition by w order by p), false) as gone, bool_or(rank is not null) over (partition by w) as more
      from (
        select w, p, tok, into_tok, rank,
          rank is not null and bool_and(least_rank) over (partition by w, run) and (tok <> nxt or row_number() over (partition by w, run order by p) % 2 = 1) as chosen
        from (
          select *, coalesce(rank <= near, false) as least_rank, sum(case when same then 0 else 1 end) over (partition by w order by p) as run
          from (
            select *, rank is not null and tok = nxt and coalesce(lag(tok) over (partition by w order by p) = tok, false) as same,
              min(rank) over (partition by w order by p rows between {reach} preceding and {reach} following) as near
            from (
              select a.w, a.p, a.tok, a.nxt, m.rank, m.into_tok
              from (select w, p, tok, lead(tok) over (partition by w order by p) as nxt from t where not done) a
              left join merges m on m.l = a.tok and m.r = a.nxt
            )
          )
        )
      )
    )
    where not gone
)
select w, list(tok order by p) as ids from t where done group by w order by w
"""

#: The vocabulary has a character for each byte of a token; the ordered rows are aggregated as they come.
DECODE = """
select d, string_agg(chars, '') as chars
from (select i.d, i.p, v.chars from ids i join vocab v on v.id = i.id order by i.p) group by d order by d
"""


class Codec:
    """One vocabulary: its ranks, and a DuckDB connection with its merge and byte tables."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.held = 0
        merges = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, into = (pa.array(c, pa.int32()) for c in (zip(*merges, strict=True) if merges else ((), (), ())))
        chars = pa.array([t.decode("latin-1") for t in self.ranks], pa.string())
        self.tables = {"merges": {"l": left, "r": right, "rank": into, "into_tok": into}, "vocab": {"id": pa.array(self.ranks.values(), pa.int32()), "chars": chars}}
        self.single = np.asarray([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)

    @cached_property
    def db(self) -> duckdb.DuckDBPyConnection:
        db = self.__dict__["db"] = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})  # beyond that it spills to the task's own folder
        db.execute("set temp_directory = ?", [tempfile.gettempdir()])
        for name, columns in self.tables.items():
            self._load(name, **columns)
        return db

    def forget(self) -> None:
        self.known.clear()
        self.words.clear()
        self.held = 0

    def rest(self) -> None:
        """At a task's end: after much work, what was remembered and the database's memory go; the next task opens it anew."""
        if self.held > MOST_KEPT:
            self.forget()
            if db := self.__dict__.pop("db", None):
                db.close()

    def _load(self, name: str, **columns: pa.Array) -> None:
        table = pa.table(columns)
        self.db.register("arrow_rows", table)
        self.db.execute(f"create or replace table {name} as select * from arrow_rows")
        self.db.unregister("arrow_rows")

    def _contract(self, query: str, words: list[bytes]) -> list[list[int]]:
        sizes = np.asarray([len(w) for w in words])
        flat = self.single[np.frombuffer(b"".join(words), np.uint8)]
        w, p = np.repeat(np.arange(len(words), dtype=np.int32), sizes), np.arange(len(flat), dtype=np.int32)
        nxt = p + 1
        nxt[np.cumsum(sizes) - 1] = -1
        self._load("start", w=pa.array(w), p=pa.array(p), tok=pa.array(flat), nxt=pa.array(nxt))
        return [ids for _, ids in self.db.execute(query).fetchall()]

    @cached_property
    def beginnings(self) -> set[bytes]:
        """Every beginning of a token."""
        return {t[:i] for t in self.ranks for i in range(1, len(t) + 1)}

    def parts(self, word: bytes) -> tuple[list[bytes], int]:
        """The word cut where no token lies across, and the bytes of the longest token in it."""
        cuts, covered, longest = [0], 0, 1
        for i in range(len(word)):
            if i and covered <= i:
                cuts.append(i)
            j = i + 1
            while j <= len(word) and word[i:j] in self.beginnings:
                if word[i:j] in self.ranks:
                    covered, longest = max(covered, j), max(longest, j - i)
                j += 1
        return [word[a:b] for a, b in zip(cuts, [*cuts[1:], len(word)], strict=True)], longest

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word: itself if it is a token, else its bytes, contracted to the fixpoint."""
        found: list = [[self.ranks[w]] if w in self.ranks else [] for w in words]
        short = [k for k, w in enumerate(words) if w not in self.ranks and 0 < len(w) <= LONG]
        if short:
            for k, ids in zip(short, self._contract(MERGE, [words[k] for k in short]), strict=True):
                found[k] = ids
        for k, w in enumerate(words):
            if w not in self.ranks and len(w) > LONG:
                parts, reach = self.parts(w)
                small = {p for p in parts if len(p) <= LONG}
                known = dict(zip(small, self._contract(MERGE, list(small)), strict=True)) if small else {}
                for p in set(parts) - small:
                    known[p] = self._contract(LONG_MERGE.format(reach=reach), [p])[0]
                found[k] = [i for p in parts for i in known[p]]
        return found

    def chunks(self, text: str) -> list[str]:
        """Parts of the text between which no word of the pattern runs on."""
        if UNCLEAR.search(text):
            return PART.split(text)
        first, *rest = text.split(" ")
        return [first, *(f" {x}" for x in rest)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self.chunks(t) if t else [] for t in texts]
        if self.held > MOST_HELD:
            self.forget()
        new = list(set().union(*parts) - self.known.keys())
        cut = [self.pattern.findall(c) for c in new]
        words = list({x for c in cut for x in c} - self.words.keys())
        for word, ids in zip(words, self.merge([x.encode() for x in words]), strict=True):
            self.words[word] = array("i", ids).tobytes()
            self.held += getsizeof(word) + getsizeof(self.words[word]) + ENTRY
        get = self.words.__getitem__
        self.known.update((chunk, get(ws[0]) if len(ws) == 1 else b"".join(map(get, ws))) for chunk, ws in zip(new, cut, strict=True))
        self.held += sum(map(getsizeof, new)) + sum(getsizeof(self.known[c]) for c, ws in zip(new, cut, strict=True) if len(ws) != 1) + ENTRY * len(new)
        return [np.frombuffer(b"".join([self.known[c] for c in p]), "<i4") for p in parts]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        sizes = np.asarray([len(x) for x in ids])
        d = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        p = np.arange(int(sizes.sum()), dtype=np.int32)
        flat = np.concatenate(ids) if len(ids) else np.zeros(0, np.int32)
        table = pa.table({"d": pa.array(d), "p": pa.array(p), "id": pa.array(flat, pa.int32())})
        self.db.register("ids", table)
        found = self.db.execute(DECODE).fetchall()
        self.db.unregister("ids")
        out = [b""] * len(ids)
        for k, chars in found:
            out[k] = chars.encode("latin-1")
        return out


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


@contextmanager
def at_work(path: str, pattern: str) -> Iterator[Codec]:
    """The worker's codec for one task."""
    own = codec(path, pattern)
    try:
        yield own
    finally:
        own.rest()


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with at_work(path, pattern) as own:
            for batch in slices(batches, "text"):
                ids = own.encode([t.decode("utf-8", "replace") for t in utf8(batch["text"])])
                keys = [c for c in batch.schema.names if c != "text"]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in keys), column], names=[*keys, "ids"])

    return run


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and ids, the tokens of the whole text."""
    rows = docs.select(*keep, "text")
    kept = "".join(f"`{c}` {t}, " for c, t in rows.dtypes if c != "text")
    return rows.mapInArrow(_encode(path, pattern), kept + "ids array<int>")


def _decode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with at_work(path, pattern) as own:
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    ids = batch["ids"]
                    flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum([len(x) if x.is_valid else 0 for x in ids])
                    column = pa.array(own.decode(np.split(flat, ends[:-1])), pa.binary())
                    keys = [c for c in batch.schema.names if c != "ids"]
                    yield pa.RecordBatch.from_arrays([*(batch[c] for c in keys), ids, column], names=[*keys, "ids", "bytes"])

    return run


def _round_trip(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with at_work(path, pattern) as own:
            name = [str(i) for i in range(max(own.ranks.values()) + 1)].__getitem__
            for batch in slices(batches, "text"):
                ids = own.encode([t.decode("utf-8", "replace") for t in utf8(batch["text"])])
                texts = [hashlib.sha256(",".join(map(name, x.tolist())).encode()).hexdigest() for x in ids]
                out = [hashlib.sha256(x).hexdigest() for x in own.decode(ids)]
                yield pa.record_batch([batch["doc_id"], pa.array([len(x) for x in ids], pa.int64()), pa.array(texts), pa.array(out)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of what they decode to, in one pass over the texts."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_round_trip(path, pattern), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of tokens and their decoded bytes."""
    kept = "".join(f"`{c}` {t}, " for c, t in tokens.dtypes if c != "ids")
    return tokens.select(*(c for c in tokens.columns if c != "ids"), "ids").mapInArrow(_decode(path, pattern), kept + "ids array<int>, bytes binary")
