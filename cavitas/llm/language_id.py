"""Operator 10, language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A word's probability is the sum, over all ways to cut it into pieces, of the
products of the pieces' probabilities; a forward pass computes it. The piece
probabilities are learned by expectation-maximisation over the words of all
training documents: word counts are a Spark aggregation, each round is one job
over the distinct words, and what reaches the driver is one number per
(language, piece), bounded by the vocabulary.

Words are as long as the text has them: both passes carry a logarithm of what they have been
divided by, so runs of letters of any length keep all their segmentations. Memory grows
with the longest run, by some 300 bytes a letter.

Edge cases: a text that is null or has no letter gets ``und`` and score 0;
training rows without a language or a letter are ignored; without any training
row every prediction is ``und``. Repeated rows are scored each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cavitas.llm.shared import held_out, slices, stored, utf8

#: A maximal run of letters and their marks is a word.
WORD = regex.compile(r"[\p{L}\p{M}]*\p{L}[\p{L}\p{M}]*")
#: Places of a word after which the passes are scaled again.
RESCALE = 16
#: Distinct words, and letters, a task holds before it passes its counts on or starts afresh.
MOST_WORDS, MOST_LETTERS = 400_000, 1 << 26
#: Letters of the words worked on at once.
AT_ONCE = 1 << 17
#: The probability of a character that no piece of the vocabulary covers.
UNSEEN = 1e-9
#: Added to the expected count of every piece in every language.
SMOOTH = 0.01
#: The vocabulary's mark for a word's start.
START = "▁"


class Pieces:
    """The vocabulary's pieces of letters, as a trie whose steps are looked up in batches."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        self.pieces = [p for p in pieces if regex.fullmatch(rf"{START}?[\p{{L}}\p{{M}}]*", p)]
        nodes, ends = {"": 0}, [-1]
        for k, piece in enumerate(self.pieces):
            for n in range(1, len(piece) + 1):
                if piece[:n] not in nodes:
                    nodes[piece[:n]] = len(nodes)
                    ends.append(-1)
            ends[nodes[piece]] = k
        self.ends = np.asarray(ends)
        self.steps = pd.Index(np.asarray([(nodes[x[:-1]] << 21) | ord(x[-1]) for x in nodes if x]))
        self.child = np.asarray([n for x, n in nodes.items() if x])
        self.longest = max(map(len, self.pieces), default=1)

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where each word starts among the joined cells, and (from, to, piece, place of from in its word) of every piece that fits.

        A word of n letters has n + 2 cells: before its mark, after it, and after each letter.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        first = np.cumsum(sizes) - sizes
        chars = np.frombuffer("".join(f"{START}{w}\0" for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
        at, node, found = np.flatnonzero(chars), None, []
        node, start, single = np.zeros(len(at), np.int64), at, np.zeros(len(chars), bool)
        n = 0
        while len(at):
            step = self.steps.get_indexer((node << 21) | chars[at])
            going = step >= 0
            at, start, node = at[going] + 1, start[going], self.child[step[going]]
            n += 1
            ends = self.ends[node]
            fit = ends >= 0
            found.append((start[fit], at[fit], ends[fit]))
            if n == 1:
                single[start[fit]] = True
        rest = np.flatnonzero(~single & (chars > 0))
        found.append((rest, rest + 1, np.full(len(rest), -1)))
        a, b, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        return first, a, b, piece, a - np.repeat(first, sizes)[a]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Pieces:
    return Pieces(path)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _passes(place: np.ndarray) -> Iterator[np.ndarray]:
    """The arcs, place after place."""
    order = np.argsort(place, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(place[order])) + 1) if len(order) else ()


def _pass(begin: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray, p: np.ndarray, longest: int) -> np.ndarray:
    """Logarithms of the sums over all ways from each word's begin to each of its cells.

    begin and end: a word's outer cells, in the direction of the pass; a, b, p: from, to and
    weight of each arc. Sums are divided by their greatest every RESCALE places.
    """
    sign = 1 if len(end) and end[0] > begin[0] else -1
    size = (end - begin) * sign + 1
    word = np.repeat(np.arange(len(size)), size)  # of each cell
    place = np.abs(np.arange(len(word)) - begin[word])
    steps = -(-size // RESCALE)
    first_step = np.cumsum(steps) - steps
    value, logs = np.zeros((len(word), p.shape[1])), np.zeros((int(steps.sum()), p.shape[1]))
    value[begin] = 1
    alive = np.arange(len(size))
    for k, arcs in enumerate(_passes(place[a])):  # every cell but the last has an arc, so no place is left out
        if k and k % RESCALE == 0:
            alive = alive[size[alive] > k]
            open_ = begin[alive, None] + sign * np.minimum(k + np.arange(longest + 1), size[alive, None] - 1)
            most = value[open_].max(axis=1)
            logs[first_step[alive] + k // RESCALE] = np.log(most)
            value[open_] = value[open_] / most[:, None]
        value[b[arcs]] += value[a[arcs]] * p[arcs]  # arcs from one place of a word lead to different cells
    logs = np.cumsum(logs, axis=0)
    with np.errstate(divide="ignore"):
        return np.log(value) + logs[first_step[word] + place // RESCALE] - logs[first_step[word]]


def log_likelihoods(words: list[str], pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """Per word and language, the log of the word's probability over all segmentations."""
    first, a, b, piece, _ = pieces.arcs(words)
    last = np.append(first[1:], first[-1] + len(words[-1]) + 2) - 1
    p = np.vstack([probs, np.full((1, probs.shape[1]), UNSEEN)])[piece]
    return _pass(first, last, a, b, p, pieces.longest)[last]


def expected_counts(words: list[str], column: np.ndarray, n: np.ndarray, pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words, each in its language's column and n times."""
    first, a, b, piece, _ = pieces.arcs(words)
    last = np.append(first[1:], first[-1] + len(words[-1]) + 2) - 1
    word = np.searchsorted(first, a, side="right") - 1
    p = np.vstack([probs, np.full((1, probs.shape[1]), UNSEEN)])[piece, column[word]]
    ahead, behind = (_pass(x, y, i, j, p[:, None], pieces.longest)[:, 0] for x, y, i, j in ((first, last, a, b), (last, first, b, a)))
    share = n[word] * np.exp(ahead[a] + np.log(p) + behind[b] - ahead[last][word])
    real = piece >= 0
    return np.bincount(piece[real] * probs.shape[1] + column[word[real]], share[real], probs.size).reshape(probs.shape)


def _groups(words: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of words of about AT_ONCE letters."""
    ends = np.cumsum([len(w) + 2 for w in words])
    at = 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, side="right")))
        yield at, to
        at = to


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of what a task has read; repeats are summed by Spark later."""

    def out(counts: dict[str, Counter]) -> pa.RecordBatch:
        lang, word, n = [], [], []
        for x, raw in counts.items():
            words: Counter = Counter()
            for chunk, k in raw.items():
                for w in words_of(chunk):
                    words[w] += k
            lang += [x] * len(words)
            word += words.keys()
            n += words.values()
        return pa.record_batch([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    counts: dict[str, Counter] = {}
    letters = 0
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), utf8(batch["text"]), strict=True):
            counts.setdefault(lang, Counter()).update(text.decode("utf-8", "replace").split())
            letters += len(text)
            if sum(map(len, counts.values())) > MOST_WORDS or letters > MOST_LETTERS:
                yield out(counts)
                counts, letters = {}, 0
    yield out(counts)


def _expected(path: str, langs: list[str], model):
    """One round's expected piece counts, as (lang, piece, n), per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, probs, column = vocabulary(path), model.value, {x: k for k, x in enumerate(langs)}
        total = np.zeros(probs.shape)
        for batch in slices(batches, "word", AT_ONCE):
            lang = np.asarray([column[x] for x in batch["lang"].to_pylist()], np.int64)
            total += expected_counts(batch["word"].to_pylist(), lang, batch["n"].to_numpy(), pieces, probs)
        at = np.argwhere(total > 0)
        yield pa.record_batch([pa.array([langs[k] for _, k in at], pa.string()), pa.array(at[:, 0], pa.int32()), pa.array(total[at[:, 0], at[:, 1]])], names=["lang", "piece", "n"])

    return run


def train(docs: DataFrame, path: str, rounds: int = 2) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities, from all rows of docs that have text and lang."""
    spark = docs.sparkSession
    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    counts = rows.mapInArrow(_word_counts, "lang string, word string, n long")
    counts = stored(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    probs = np.full((len(vocabulary(path).pieces), len(langs)), 1 / max(1, len(vocabulary(path).pieces)))
    for _ in range(rounds if langs else 0):
        found = counts.mapInArrow(_expected(path, langs, spark.sparkContext.broadcast(probs)), "lang string, piece int, n double")
        found = found.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        total = np.full(probs.shape, SMOOTH)
        total[found["piece"].to_numpy(), found["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(int)] += found["n"].to_numpy()
        probs = total / total.sum(axis=0)
    return langs, probs


def _predict(path: str, langs: list[str], model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, probs = vocabulary(path), model.value
        known: dict[str, int] = {}  # chunk between white space -> row of scores, the last column its words
        scores, letters = np.zeros((0, len(langs) + 1)), 0

        def learn(chunks: list[str]) -> None:
            nonlocal scores
            words = [words_of(c) for c in chunks]
            flat = list(dict.fromkeys(w for ws in words for w in ws))
            each = np.zeros((len(flat) + 1, len(langs) + 1))
            for i, k in _groups(flat) if langs else ():
                each[i:k, :-1] = log_likelihoods(flat[i:k], pieces, probs)
            each[:-1, -1] = 1
            at = {w: k for k, w in enumerate(flat)}
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            into = np.fromiter((at[w] for ws in words for w in ws), np.int64, int(sizes.sum()))
            sums = np.stack([np.bincount(np.repeat(np.arange(len(words)), sizes), each[into, c], len(words)) for c in range(each.shape[1])], axis=1)
            known.update(zip(chunks, range(len(scores), len(scores) + len(chunks)), strict=True))
            scores = np.concatenate([scores, sums])

        for batch in slices(batches, "text", 4 << 20):
            if len(known) > 2 * MOST_WORDS or letters > MOST_LETTERS:
                known.clear()
                scores, letters = scores[:0], 0
            texts = [t.decode("utf-8", "replace").split() for t in utf8(batch["text"])]
            if new := list(set().union(*texts) - known.keys()):
                letters += sum(map(len, new))
                learn(new)
            total = np.asarray([scores[[known[c] for c in t]].sum(axis=0) if t else np.zeros(len(langs) + 1) for t in texts])
            und = (total[:, -1] == 0) | (not langs)
            each = total[:, :-1] if langs else np.zeros((len(texts), 1))
            best = each.argmax(axis=1)
            score = np.where(und, 0.0, 1 / np.exp(np.maximum(each - each.max(axis=1, keepdims=True), -700)).sum(axis=1))
            lang = ["und" if u else langs[k] for u, k in zip(und, best, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, path: str, model: tuple[list[str], np.ndarray], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, text, lang_pred and score for every row; the rows' text is read whole."""
    langs, probs = model
    share = docs.sparkSession.sparkContext.broadcast(probs)  # vocabulary x languages doubles
    rows = docs.select(*keep, "text")
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", lang_pred string, score double"
    return rows.mapInArrow(_predict(path, langs, share), schema)


def identify(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learns from the rows that are not held out."""
    model = train(docs.where(~held_out(4, 2)), path)
    return predict(docs, path, model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
