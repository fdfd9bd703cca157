"""Operator 11, quality rules with the frequency of lines across the documents of a host.

Each task measures its texts and hashes their normalised lines (words in lower-case ASCII letters, parted by
one blank). The distinct documents of each (host, line) are counted over all rows; lines
in more documents than the host's limit are removed, and a document that is left with too few words, or too
small a share of them, is rejected, as is one that fails the rules on its own text.

A host's limit is `most_documents`, or `most_share` of its documents where that is more. Lines are known by 64 bits
of XXH64 within their host. Of the frequent lines those with more than one part in `spark.sql.shuffle.partitions` of all
(document, line) rows are at most as many as partitions, so they are broadcast; the others are joined by
a shuffle in which no line has more than a partition's share.

Edge cases: a null text has no words; a null or empty text fails the rules. A null host is a host of its own. Rows
of one doc_id are one document where documents are counted (all null ids are one, too) and are judged each. Lines without a
word are neither counted nor removed. Texts of any length are worked through whole, their words in parts of PART
bytes. Columns of other names are not read by `judge`, and kept by `cleaned`. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cavitas.llm.shared import apart, slices, stored, utf8

BLANK = b" \t\n\v\f\r"
#: Bytes that are no code point of a word: white space and all but the first byte of each character.
NO_START = BLANK + bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
NEXT_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of text whose words are held as objects at once.
PART = 4 << 20
#: Words of a window, and what the rules ask for.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: Lines in more documents of a host than both of these are removed.
MOST_DOCUMENTS, MOST_SHARE = 20, 0.001
#: Percentage of a document's words that has to be left.
LEAST_LEFT = 50

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, hashes array<long>, line_words array<long>"


def word_ids(text: bytes) -> tuple[np.ndarray, int]:
    """A number for each word of the text, equal for equal words, and how many different ones there are."""
    known: dict[bytes, int] = {}
    found, at = [], 0
    while at < len(text):
        cut = NEXT_BLANK.search(text, at + PART) if at + PART < len(text) else None
        end = cut.start() if cut else len(text)
        words = text[at:end].split()
        for w in words:
            known.setdefault(w, len(known))
        found.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.int64), len(known)


def repeated_words(ids: np.ndarray, different: int, window: int = WINDOW) -> int:
    """Words that lie in a window that the text has twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    key, size = ids[:n], different
    for k in range(1, window):
        if size * different >= 1 << 62:
            values, key = np.unique(key, return_inverse=True)
            size = len(values)
        key, size = key * different + ids[k : k + n], size * different
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    step = np.zeros(len(ids) + 1, np.int64)
    step[:n] += again
    step[window : window + n] -= again
    return int(np.count_nonzero(np.cumsum(step[:-1])))


def normal(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def line_hash(line: bytes) -> int:
    """64 bits of a normalised line, signed."""
    return xxhash.xxh64_intdigest(line) - (1 << 63)


def measure(text: bytes) -> tuple:
    """The values of MEASURES: the hashes are those of the different lines with a word, beside them all their words in the text."""
    ids, different = word_ids(text)
    seen: set[bytes] = set()
    lines: dict[int, int] = {}
    again = 0
    for line in text.split(b"\n"):
        own = normal(line)
        if not own:
            continue
        again += line in seen
        seen.add(line)
        h = line_hash(own)
        lines[h] = lines.get(h, 0) + own.count(b" ") + 1
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(ids), len(text.translate(None, NO_START)), symbols, again, repeated_words(ids, different), list(lines), list(lines.values())


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
    for batch in slices(batches, "text"):
        columns = zip(*map(measure, utf8(batch["text"])), strict=True)
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, columns, kinds)], names=[*batch.schema.names, *(m.split()[0] for m in MEASURES.split(", "))])


def _measured(docs: DataFrame) -> DataFrame:
    """The rows of docs with their MEASURES and a number `row` of each."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(_measures, f"{kinds}, {MEASURES}").withColumn("row", F.monotonically_increasing_id())


def frequent_lines(lines: DataFrame, hosts: DataFrame, most_documents: int, most_share: float) -> DataFrame:
    """host, h and n (documents) of the lines above their host's limit. lines: host, h, doc_id; hosts: host, documents."""
    counts = lines.groupBy("host", "h").agg(F.countDistinct(F.struct("doc_id")).alias("n")).where(F.col("n") > most_documents)
    # only a host of more documents has a higher limit
    large = hosts.where(F.col("documents") * most_share > most_documents)
    found = counts.alias("c").join(large.alias("l"), F.expr("c.host <=> l.host"), "left")
    return found.where(F.col("l.documents").isNull() | (F.col("n") > F.col("l.documents") * most_share)).select("c.host", "h", "n")


def _found(rows: DataFrame, most_documents: int, most_share: float) -> DataFrame:
    """row, h and words of each frequent line of each row. rows: doc_id, host, hashes, line_words, row."""
    hosts = rows.groupBy("host").agg(F.countDistinct(F.struct("doc_id")).alias("documents"))
    lines = rows.select("row", "doc_id", "host", F.explode(F.arrays_zip("hashes", "line_words")).alias("l")).select("row", "doc_id", "host", F.col("l.hashes").alias("h"), F.col("l.line_words").alias("words"))
    frequent = stored(frequent_lines(lines, hosts, most_documents, most_share), "frequent")
    total = rows.agg(F.sum(F.size("hashes"))).first()[0] or 0
    share = total // max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    hot, cold = frequent.where(F.col("n") > share), frequent.where(F.col("n") <= share)
    same = F.expr("l.host <=> f.host and l.h = f.h")
    in_hot = lines.alias("l").join(F.broadcast(hot).alias("f"), same, "left_semi")  # at most one row per shuffle partition
    in_cold = lines.alias("l").join(F.broadcast(hot).alias("f"), same, "left_anti").alias("l").join(cold.hint("shuffle_merge").alias("f"), same, "left_semi")
    return in_hot.unionByName(in_cold).select("row", "h", "words")


def verdicts(rows: DataFrame) -> DataFrame:
    """Adds base_failed and kept to rows with n_words, n_repeat_words and words_removed."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    left = F.col("n_words") - F.col("words_removed")
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (left >= LEAST_WORDS) & (100 * left >= LEAST_LEFT * F.col("n_words")))


def judge(docs: DataFrame, host: str = "source", most_documents: int = MOST_DOCUMENTS, most_share: float = MOST_SHARE) -> DataFrame:
    """doc_id, the measures of each text, words_removed (those of its frequent lines), base_failed and kept."""
    rows = stored(_measured(docs.select("doc_id", F.col(host).alias("host"), "text")).drop("text"), "measured")
    removed = _found(rows, most_documents, most_share).groupBy("row").agg(F.sum("words").alias("words_removed"))
    own = rows.drop("hashes", "line_words", "host").join(removed, "row", "left").withColumn("words_removed", F.coalesce("words_removed", F.lit(0)))
    return verdicts(own).drop("row")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        left = []
        for text, gone in zip(batch["text"].to_pylist(), batch["gone"].to_pylist(), strict=True):
            if text is None or not gone:
                left.append(text)
                continue
            lines = text.encode().split(b"\n")
            left.append(b"\n".join(x for x in lines if not (own := normal(x)) or line_hash(own) not in gone).decode())
        columns = [pa.array(left, pa.string()) if c == "text" else batch[c] for c in batch.schema.names if c != "gone"]
        yield pa.RecordBatch.from_arrays(columns, names=[c for c in batch.schema.names if c != "gone"])


def cleaned(docs: DataFrame, host: str = "source", most_documents: int = MOST_DOCUMENTS, most_share: float = MOST_SHARE) -> DataFrame:
    """The kept rows of docs, in all their columns, without their frequent lines."""
    measures = [m.split()[0] for m in MEASURES.split(", ")]
    own, back = apart(docs, "row", "host", "h", "gone", "words_removed", "base_failed", "kept", *measures)
    rows = stored(_measured(own.withColumn("host", F.col({c: k for k, c in back.items()}.get(host, host)))), "measured")
    removed = _found(rows.select("doc_id", "host", "hashes", "line_words", "row"), most_documents, most_share)
    removed = removed.groupBy("row").agg(F.sum("words").alias("words_removed"), F.collect_list("h").alias("gone"))  # lines of one document
    kept = verdicts(rows.join(removed, "row", "left").withColumn("words_removed", F.coalesce("words_removed", F.lit(0)))).where("kept")
    kinds = ", ".join(f"`{c}` {t}" for c, t in own.dtypes)
    return kept.select(*own.columns, "gone").mapInArrow(_without, kinds).withColumnsRenamed(back)


#: The same in DuckDB's SQL, for documents.
SQL = rf"""
with texts as (
  select row_number() over () as r, doc_id, source as host, coalesce(text, '') as text from documents
), words as (
  select r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from texts
), numbered as (
  select r, unnest(ws) as w, generate_subscripts(ws, 1) as i from words
), runs as (
  select r, i, {" || ' ' || ".join(f"lead(w, {k}) over (partition by r order by i)" for k in range(WINDOW))} as run from numbered
), windows as (
  select r, i, count(*) over (partition by r, run) as n from runs where run is not null
), repeated as (
  select r, count(distinct k) as n_repeat_words from (select r, unnest(range(i, i + {WINDOW})) as k from windows where n > 1) group by r
), lines as (
  select r, doc_id, host, line, array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') as norm
  from (select r, doc_id, host, unnest(string_split(text, chr(10))) as line from texts)
), said as (
  select *, len(norm) - len(replace(norm, ' ', '')) + 1 as n from lines where norm <> ''
), again as (
  select r, sum(k - 1)::bigint as n_dup_lines from (select r, count(*) as k from said group by r, line) group by r
), hosts as (
  select host, count(distinct coalesce(doc_id::varchar, '')) as documents from texts group by host
), frequent as (
  select l.host, l.norm from (select host, norm, count(distinct coalesce(doc_id::varchar, '')) as n from said group by host, norm) l
  join hosts h on l.host is not distinct from h.host where n > {MOST_DOCUMENTS} and n > documents * {MOST_SHARE}::double
), gone as (
  select s.r, sum(s.n)::bigint as words_removed from said s join frequent f on s.norm = f.norm and s.host is not distinct from f.host group by s.r
), m as (
  select t.doc_id, len(w.ws)::bigint as n_words, length(array_to_string(w.ws, ''))::bigint as word_chars,
    length(regexp_replace(t.text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(a.n_dup_lines, 0) as n_dup_lines,
    coalesce(p.n_repeat_words, 0)::bigint as n_repeat_words, coalesce(g.words_removed, 0) as words_removed
  from texts t join words w using (r) left join again a using (r) left join repeated p using (r) left join gone g using (r)
), b as (
  select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed, n_words - words_removed as rest from m
)
select * exclude (rest), not base_failed and rest >= {LEAST_WORDS} and 100 * rest >= {LEAST_LEFT} * n_words as kept from b
"""
