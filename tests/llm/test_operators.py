"""The numbered operators against brute force, round trips, and odd rows: nulls, empty and long texts, repeats, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cavitas.llm import audio, bpe, huffman, language_id, mixing, quality, simhash, suffixes, topk, warc
from cavitas.llm.shared import held_out

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, row string, copies string, ids string"
PASSAGE = "a passage of more than fifty bytes that several of the documents share, word for word"


def texts() -> list[tuple]:
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    plain = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(24)]
    rows = [(k, t, ("en", "de", None)[k % 3], f"s{k % 4}" if k % 5 else None) for k, t in enumerate(plain)]
    rows += [(30, None, "en", "s0"), (31, "", "de", "s1"), (32, "  \n ", None, None), (None, "an id is missing here", "en", "s2"), (33, plain[0], "en", "s0"), (33, plain[0], "en", "s0")]
    rows += [(34, plain[1] + " " + PASSAGE + " end", "en", "s1"), (35, PASSAGE + plain[2], "de", "s2"), (36, "x" + PASSAGE, "de", "s2"), (37, "Ünïcode ß 日本語 é́  don't\tI'LL <|endoftext|>", "de", "s3"), (38, " ".join(plain) * 40, "en", "s3"), (39, "aaaa" * 400, "en", "s0")]
    return [(i, t, lang, s, None if t is None else len(t), "f", "r", "c", "i") for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(rows) -> list:
    return sorted(map(repr, map(tuple, rows)))


def test_bpe_equals_tiktoken(docs, empty):
    own = bpe.codec(BPE, public_tokenizers.PATTERN)
    ref = tiktoken.Encoding("ref", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    want = []
    for i, t, *_ in texts():
        ids = ref.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert bag(bpe.round_trip(docs, BPE, public_tokenizers.PATTERN).collect()) == bag(want)
    assert bpe.round_trip(empty, BPE, public_tokenizers.PATTERN).count() == 0
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text"), BPE, public_tokenizers.PATTERN), BPE, public_tokenizers.PATTERN)
    assert sorted(bytes(r["bytes"] or b"") for r in back.collect()) == sorted((t or "").encode() for _, t, *_ in texts())


def test_every_token_is_merged_from_its_bytes_in_the_order_of_ranks():
    """What the joint contractions of long words rest on, for the whole vocabulary."""
    own = bpe.codec(BPE, public_tokenizers.PATTERN)
    for token, rank in own.ranks.items():
        parts, last = [token[k : k + 1] for k in range(len(token))], -1
        while len(parts) > 1:
            least, k = min((own.ranks.get(parts[k] + parts[k + 1], 1 << 30), k) for k in range(len(parts) - 1))
            assert last <= least <= rank
            parts[k : k + 2], last = [parts[k] + parts[k + 1]], least
        assert parts == [token]
    some = [t for t in own.ranks if 2 <= len(t) <= 12][::40]
    assert own._contract(bpe.MERGE, some) == own._contract(bpe.LONG_MERGE.format(reach=12), some) == [[own.ranks[t]] for t in some]


def test_caches_are_bounded_in_bytes(monkeypatch):
    """Long chunks count by their bytes; what was forgotten is learned again."""
    rng = random.Random(21)
    texts_ = ["".join(rng.choice("abcdefgh") for _ in range(3000)) + f" word{k} und {k} ,mark." for k in range(12)] * 2
    monkeypatch.setattr(bpe, "MOST_HELD", 20_000)
    monkeypatch.setattr(huffman, "MOST_HELD", 20_000)
    coder, tokens, library = bpe.Codec(BPE, public_tokenizers.PATTERN), huffman.Tokens(WORDS), Tokenizer.from_file(WORDS)
    ref = tiktoken.Encoding("ref", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    for text in texts_:
        assert coder.encode([text])[0].tolist() == ref.encode_ordinary(text)
        assert np.frombuffer(tokens.encode([text])[0], tokens.width).tolist() == [*library.encode(text, add_special_tokens=False).ids, huffman.END_ID]
        assert coder.held < 80_000 and len(coder.known) < 40 and tokens.held < 80_000 and len(tokens.known) < 60


def test_a_task_leaves_little_in_its_worker(monkeypatch):
    """After a task of many words neither they nor the database stay; the next task gives the same rows."""
    monkeypatch.setattr(bpe, "MOST_KEPT", 10_000, raising=False)
    own = bpe.codec(BPE, public_tokenizers.PATTERN)
    rows = pa.record_batch([pa.array([1, 2]), pa.array([" ".join(f"wq{k}x" for k in range(500)), None])], names=["doc_id", "text"])
    run = bpe._round_trip(BPE, public_tokenizers.PATTERN)
    first = [b.to_pylist() for b in run(iter([rows]))]
    assert own.held == 0 and not own.known and not own.words and "db" not in vars(own)
    assert [b.to_pylist() for b in run(iter([rows]))] == first


def test_long_words_equal_tiktoken():
    """Words of up to 100,000 bytes: random letters, runs, text without blanks, other scripts."""
    own = bpe.codec(BPE, public_tokenizers.PATTERN)
    ref = tiktoken.Encoding("ref", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(5)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    tokens = [t.decode() for t in own.ranks if t.isalpha() and t.isascii()]
    words = [some("abcdefghijklmnopqrstuvwxyz", n) for n in (65, 200, 3000, 100_000)]
    words += ["a" * 5000, "ab" * 700 + "a" * 333 + "b", some("ab", 3000), some("aé", 2000), some("日本語のテキスト", 2000), "".join(rng.choice(tokens) for _ in range(3000)), "=" * 777, some("-=", 900), "b" + "a" * 99 + "c" + "a" * 100]
    words += [some("aaaab", rng.randint(65, 140)) for _ in range(60)]
    for text, ids in zip(words, own.encode(words), strict=True):
        assert ids.tolist() == ref.encode_ordinary(text), text[:80]


def test_mix_equals_sql(spark, docs, empty):
    plain = docs.select("doc_id", "text", "source").toPandas()
    db = duckdb.connect()
    db.register("documents", plain.astype({"doc_id": "Int64"}))
    got = mixing.mix(docs)
    want = db.execute(f"select {', '.join(got.columns)} from ({mixing.SQL})").fetchall()
    assert bag([tuple(r) for r in got.collect()]) == bag(want)
    assert all(r["taken"] <= 3 * r["size"] for r in got.collect())
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(empty).count() == 0


def test_mix_near_targets_and_caps(spark):
    rows = [(k, "w " * (1 + k % 9), "big" if k % 10 else "small") for k in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("target", "source_size").agg(F.sum("taken").alias("taken")).collect()
    for r in got:
        assert r["target"] <= 3 * r["source_size"] and abs(r["taken"] - r["target"]) <= 10
    assert sum(r["target"] for r in got) == pytest.approx(sum(r["source_size"] for r in got))


def test_warc_round_trip(spark):
    big, small = "<html>" + "p" * 200, "<p>"
    inner = "<html>WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n" + "q" * 99
    rows = [(5, "http://a/\r\nx", big), (3, None, big), (3, None, big), (9, "u", inner), (8, "v", inner), (1, "w", small), (2, "w", small), (4, "n", None), (None, "n", big)]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        low = min((p for p, _, x in rows if x == h and p is not None), default=None)
        again = len(data) >= 100 and i != low
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", low if again else None))
    assert bag(got.collect()) == bag(want)
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pointer_jumping_equals_a_walk():
    rng = np.random.default_rng(2)
    for _ in range(20):
        at = np.unique(np.append(rng.integers(0, 500, 60), 0))
        following = np.asarray([rng.choice(at[at > a]) if (at > a).any() and rng.random() < 0.9 else 10_000 for a in at])
        want, here = set(), 0
        while here in at:
            want.add(here)
            here = following[np.searchsorted(at, here)]
        assert set(at[warc.reached(at, following)]) == want


def test_quality_learns_and_leaves_held_out_alone(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(("fine", "good", "calm") if k % 2 else ("$$$", "!!!", "spam")) + rng.choice("abc") for _ in range(30))) for k in range(240)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(240)] + [(7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = held_out(3, 1)
    got = {r["doc_id"]: r for r in quality.classify(docs, labels, out).collect()}
    tested = [r for k, r in got.items() if k < 240 and r["held_out"]]
    assert len(tested) > 50 and sum(r["predicted"] == r["doc_id"] % 2 for r in tested) / len(tested) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items()) and 0 <= got[900]["score"] <= 1
    swapped = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.classify(docs, swapped, out).collect()}
    assert all(again[k] == pytest.approx(r["score"]) for k, r in got.items())
    twice = docs.union(docs.where("doc_id < 5")).selectExpr("*", "1 as score", "'k' as key", "0 as quality", "2 as predicted")
    more = quality.classify(twice, labels.selectExpr("*", "'x' as text", "3 as key"), out).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("score").alias("values")).collect()
    assert {(r["doc_id"], r["n"], r["values"]) for r in more} == {(k, 2 if k < 5 else 1, 1) for k in got}
    none = quality.classify(docs, labels.where("false"), out).collect()
    assert {r["score"] for r in none} == {0.5} and quality.classify(docs.where("false"), labels, out).count() == 0


def direct_buckets(text: str) -> list[int]:
    """Buckets of a text's character grams and words, one after another, in plain integers."""
    hashed = lambda c, place: int(quality._LOW[place][ord(c) % 256]) ^ (ord(c) // 256 * int(quality._HIGH[place]) & 0xFFFFFFFF)
    top = lambda h: (h * int(quality._MIX) & 0xFFFFFFFF) >> (32 - quality.BUCKET_BITS)
    found = []
    for n in quality.N_GRAMS:
        for k in range(len(text) - n + 1):
            h = 0
            for i, c in enumerate(text[k : k + n]):
                h ^= hashed(c, i)
            found.append(top(h))
    for word in re.findall(r"[^\x09-\x0D\x20]+", text):
        found.append(top(sum(hashed(c, 1) * int(quality._PLACE[i & 63]) for i, c in enumerate(word)) & 0xFFFFFFFF))
    return found


def direct_descent(texts: list[list[int]], labels: list[int], seed: int = 7):
    """Vectors, output weights and bias by the same descent, text by text and bucket by bucket."""
    random_, dim = np.random.default_rng(seed), quality.DIM
    vectors, out = random_.uniform(-1 / dim, 1 / dim, (1 << quality.BUCKET_BITS, dim)), np.zeros((dim, 2))
    bias = np.log([1 - np.mean(labels), np.mean(labels)])
    steps, done = quality.EPOCHS * len(labels), 0
    for _ in range(quality.EPOCHS):
        for k in random_.permutation(len(labels)):
            rate, done = quality.RATE * (1 - done / steps), done + 1
            share = {b: texts[k].count(b) / len(texts[k]) for b in set(texts[k])}
            mean = sum(n * vectors[b] for b, n in share.items())
            p = np.exp(mean @ out + bias)
            error = p / p.sum() - np.eye(2)[labels[k]]
            back = out @ error
            out, bias = out - rate * np.outer(mean, error), bias - rate * 0.1 * error
            for b, n in share.items():
                vectors[b] -= rate * n * len(share) * back
    return vectors, out, bias


def test_quality_equals_a_direct_version(spark):
    """Features, descent and score: the folded score equals the softmax over the averaged vectors."""
    rng = random.Random(14)
    rows = [(k, " ".join(rng.choice(("fine", "good", "Ünder", "x", "品质很好", "😀") if k % 2 else ("bad", "$$", "n\tn")) for _ in range(rng.randint(1, 12)))) for k in range(24)]
    texts_, labels = [direct_buckets(t) for _, t in rows], [k % 2 for k, _ in rows]
    assert len(direct_buckets("品质很好")) == 2 + 1 + 1  # grams of characters, not of bytes
    for (_, t), want in zip(rows, texts_, strict=True):
        got = [b[lo[0] : hi[0]] for b, lo, hi in quality.features(*quality._joined([t]))]
        assert sorted(np.concatenate(got).tolist()) == sorted(want)
    counted = [np.unique(x, return_counts=True) for x in texts_]
    weight, level = quality.descend([b for b, _ in counted], [n for _, n in counted], np.asarray(labels))
    vectors, out, bias = direct_descent(texts_, labels)
    df = spark.createDataFrame([*rows, (100, "w " * 300_000 + "good"), (101, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality.score(df, (weight, level)).collect()}
    for k, _ in rows:
        logits = np.mean([vectors[b] for b in texts_[k]], axis=0) @ out + bias if texts_[k] else bias
        assert got[k] == pytest.approx(np.exp(logits[1]) / np.exp(logits).sum(), abs=1e-6)
    assert got[101] == pytest.approx(1 / (1 + np.exp(-level))) and 0 < got[100] < 1


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = [(k, [float(x) for x in rng.normal(size=8) * (0.2 + k % 3)]) for k in range(400)]
    vectors += [(400, vectors[7][1]), (401, vectors[7][1]), (402, None), (403, [1.0, None]), (404, [float("nan")] * 8), (405, []), (None, vectors[0][1]), (450, [1.0, 2.0]), (451, [2.0, 1.0]), (100, vectors[100][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    monkeypatch.setattr(topk, "BLOCK", 1024)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0)
    db = duckdb.connect()
    db.register("embeddings", df.toPandas().astype({"vec_id": "Int64"}))
    assert bag(got.select("query_id", "rank", "vec_id", "score").collect()) == bag(db.execute(topk.SQL).fetchall())
    assert topk.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def without_repeats(rows: list[tuple]) -> list[tuple]:
    """Digests by brute force: every string of 50 bytes with its smallest document."""
    rows = [(suffixes.NO_ID if i is None else i, (t or "").encode()) for i, t in rows]
    low: dict[bytes, int] = {}
    for i, t in sorted(rows):
        for p in range(len(t) - 49):
            low.setdefault(t[p : p + 50], i)
    found = []
    for i, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - 49):
            if low[t[p : p + 50]] < i:
                gone[p : p + 50] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        found.append((None if i == suffixes.NO_ID else i, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone[:-1]].tobytes()).hexdigest()))
    return found


@pytest.mark.parametrize(("at_once", "heavy"), [(suffixes.AT_ONCE, suffixes.HEAVY), (40, 3)])
def test_repeats_equal_brute_force(docs, empty, monkeypatch, at_once, heavy):
    """Sorts of few pieces, and grams that are dealt string by string, give the same."""
    monkeypatch.setattr(suffixes, "AT_ONCE", at_once)
    monkeypatch.setattr(suffixes, "HEAVY", heavy)
    want = without_repeats([(i, t) for i, t, *_ in texts()])
    assert bag(suffixes.digest(docs).collect()) == bag(want)
    assert suffixes.digest(empty).count() == 0
    left = {r["doc_id"]: r["text"] for r in suffixes.remove(docs).collect()}
    assert PASSAGE in left[34] and PASSAGE not in left[35] and left[36] == "x"
    assert left[30] is None and suffixes.remove(docs).columns == docs.columns and {r["copies"] for r in suffixes.remove(docs).collect()} == {"c"}
    with pytest.raises(TypeError, match="integer"):
        suffixes.digest(docs.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_difference_cover_order_equals_sorting_the_strings():
    rng = random.Random(3)
    for _ in range(30):
        base = bytes(rng.choice(b"ab\0") for _ in range(200))
        pieces, starts, owners = [], [], []
        for _ in range(rng.randint(1, 60)):
            n = rng.randint(1, suffixes.WINDOW)
            at = rng.randrange(0, 151 - n)
            own = bytearray(base[at : at + n + 49])
            own[rng.randrange(len(own))] = rng.choice(b"ab")
            pieces.append(bytes(own))
            starts.append(n)
            owners.append(rng.randint(0, 9))
        low: dict[bytes, int] = {}
        for p, n, d in zip(pieces, starts, owners, strict=True):
            for k in range(n):
                low[p[k : k + 50]] = min(low.get(p[k : k + 50], d), d)
        want = [sum((low[p[k : k + 50]] < d) << k for k in range(n)) for p, n, d in zip(pieces, starts, owners, strict=True)]
        assert suffixes.repeated_starts(pieces, np.asarray(starts), np.asarray(owners)).tolist() == want


def test_a_line_in_most_documents_equals_brute_force(spark):
    """A hot line between texts that differ, runs of one letter, and a very long text."""
    rng = random.Random(12)
    line = " this line of more than fifty bytes is found in nearly all of the documents of this table "
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    rows = [(k, noise(40) + line + noise(40)) for k in range(400)] + [(400, "z" * 3000), (401, "z" * 2000 + line), (402, noise(600_000) + line)]
    assert bag(suffixes.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()) == bag(without_repeats(rows))


def test_suffixes_tell_rows_of_a_null_id_apart(spark):
    """Two texts without an id whose 32-bit checksums are equal: only one has a passage to remove."""
    with_it, without = f"47261 is a number, and so on, before {PASSAGE}", "number 17524 shares no passage with any other of these texts at all"
    assert len({zlib.crc32(hashlib.md5(t.encode()).digest()) for t in (with_it, without)}) == 1 and len(without) < len(with_it)
    rows = spark.createDataFrame([(1, PASSAGE), (None, with_it), (None, without)], "doc_id long, text string")
    got = {r["kept_sha256"]: (r["n_bytes"], r["n_removed"]) for r in suffixes.digest(rows).collect()}
    want = [(PASSAGE, PASSAGE), (with_it, with_it.removesuffix(PASSAGE)), (without, without)]
    assert got == {hashlib.sha256(kept.encode()).hexdigest(): (len(t), len(t) - len(kept)) for t, kept in want}


def reference_fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(docs, empty):
    rows = [(i, reference_fingerprint(t)) for i, t, *_ in texts()]
    group = list(range(len(rows)))
    for _ in rows:
        for a, (_, x) in enumerate(rows):
            for b, (_, y) in enumerate(rows):
                if (x ^ y).bit_count() <= 4:
                    group[a] = group[b] = min(group[a], group[b])
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group)}
    want = [(i, fp, least[group[k]]) for k, (i, fp) in enumerate(rows)]
    got = [(r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert bag(got) == bag(want)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


@pytest.mark.parametrize(("small", "large"), [(48, 20_000), (2, 20_000), (48, 5), (2, 1)])
def test_links_connect_the_same_components(spark, monkeypatch, small, large):
    monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
    monkeypatch.setattr(simhash, "LARGE_BUCKET", large)
    rng = random.Random(6)
    found = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            found.add(x)
    near = {x: {y for y in found if (x ^ y).bit_count() <= 4} for x in found}

    def spread(edges):
        label = {x: x for x in found}
        for _ in found:
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        return label

    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in found], "fp long")
    got = [(r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)) for r in simhash.links(df).collect()]
    assert all(b in near[a] for a, b in got)
    assert spread(got) == spread([(a, b) for a in found for b in near[a]])


def direct_log_mel(payload: bytes) -> np.ndarray:
    """Zeros between the samples, one long filter, every DOWN-th kept; then frame by frame."""
    taps, window, filters = audio._tables()
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    up = np.zeros(len(x) * audio.UP)
    up[:: audio.UP] = x
    y = np.convolve(up, taps)[len(taps) // 2 :][: len(up)][:: audio.DOWN]
    found = []
    for k in range(-(-len(y) // audio.STEP)):
        part = np.zeros(audio.WINDOW)
        part[: len(y[k * audio.STEP :][: audio.WINDOW])] = y[k * audio.STEP :][: audio.WINDOW]
        power = np.abs(np.fft.rfft(part * window, audio.FFT)) ** 2
        found.append([np.log(power @ filters[:, b] + 1e-6) for b in range(audio.BANDS)])
    return np.asarray(found)


def direct_segments(mel: np.ndarray) -> list[tuple[int, int]]:
    loud, on, found = [10 * max(f) / np.log(10) for f in mel.astype(float)], None, []
    for k, x in enumerate(loud):
        if on is None and x >= max(loud) - audio.GATE_ON:
            on = k
        elif on is not None and x < max(loud) - audio.GATE_OFF:
            found.append((on, k))
            on = None
    return found + ([(on, len(loud))] if on is not None else [])


def test_audio_is_lossless_and_its_features_equal_a_direct_version(docs, empty):
    want = {}
    for _, t, *_ in texts():
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        mel = direct_log_mel(payload)
        want[hashlib.sha256(payload).hexdigest()] = (len(data), payload, mel)
    for r in audio.features(audio.to_audio(docs.select("doc_id", "text"))).collect():
        n_bytes, payload, mel = want[r["payload_sha256"]]
        frames, patches = audio.frames_of(bytes(r["tensors"]), r["n_frames"])
        assert len(frames) == len(mel) and np.allclose(frames, mel, rtol=2e-3, atol=1e-2) and patches == -(-len(mel) // audio.PATCH)
        spans = [(a * audio.SECONDS, b * audio.SECONDS) for a, b in direct_segments(audio.log_mel(payload))]
        assert np.allclose([(s["start_s"], s["end_s"]) for s in r["spans"]], spans)
        assert n_bytes == r["n_bytes"] and r["media_sha256"] == hashlib.sha256(audio.wav(payload)).hexdigest() and audio.samples_of(audio.wav(payload)) == payload
    got = audio.digest(docs).collect()
    assert len(got) == len(texts())
    for r in got:
        n_bytes, payload, mel = want[r["payload_sha256"]]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (n_bytes, len(payload), zlib.crc32(payload[-32:]))
        means = [float(x) for x in r["feature"].rpartition("=")[2].split(",")]
        assert f"frames={len(mel)};" in r["feature"] and means == pytest.approx(mel.mean(axis=0).tolist(), abs=0.02)
    assert len({r["payload_sha256"] for r in got}) == len({(r["payload_sha256"], r["media_sha256"], r["feature"]) for r in got})
    assert audio.digest(empty).count() == 0


@pytest.mark.parametrize("ratio", [(3, 4), (1, 2), (2, 3), (5, 3)])
def test_resampling_equals_zeros_filter_and_leaving_out(monkeypatch, ratio):
    monkeypatch.setattr(audio, "UP", ratio[0])
    monkeypatch.setattr(audio, "DOWN", ratio[1])
    audio._tables.cache_clear()
    y = np.random.default_rng(8).normal(size=997)
    taps, up = audio._tables()[0], np.zeros(997 * ratio[0])
    up[:: ratio[0]] = y
    assert np.allclose(audio.resample(y), np.convolve(up, taps)[len(taps) // 2 :][: len(up)][:: ratio[1]])
    audio._tables.cache_clear()


def test_pieces_of_a_long_payload_go_on(monkeypatch):
    data = np.random.default_rng(8).integers(0, 256, 50_000).astype(np.uint8).tobytes()
    whole = audio.log_mel(data)
    assert np.allclose(whole, direct_log_mel(data), rtol=1e-4, atol=1e-4)
    monkeypatch.setattr(audio, "PIECE", 20 * audio.DOWN * audio.STEP)
    assert np.allclose(audio.log_mel(data), whole)


def test_token_files_equal_the_library(docs, empty, spark):
    own = Tokenizer.from_file(WORDS)
    rows = sorted(((i is not None, i or 0, t or "") for i, t, *_ in texts()), key=lambda r: r[:2])
    coded = [(i if some else None, np.asarray(own.encode(t, add_special_tokens=False).ids + [1], "<u4")) for some, i, t in rows]
    want, start = [], 0
    for i, ids in coded:
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert bag(huffman.read(spark, huffman.write(docs, WORDS)).collect()) == bag(want)
    assert huffman.read(spark, huffman.write(empty, WORDS)).count() == 0


def test_token_files_are_read_from_their_folder_alone(spark, tmp_path):
    """A very long text, nulls and repeats; decoded by plain Python from what the files hold."""
    rng = random.Random(13)
    long = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) for _ in range(60_000))
    rows = [(3, long), (1, "Some words, then"), (1, "Some words, then"), (2, None), (4, "")]
    huffman.write(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, str(tmp_path / "files"))
    bits_of = {r["id"]: r["bits"] for r in spark.read.parquet(str(tmp_path / "files" / "code")).collect()}
    code, last, words = 0, 0, {}
    for n, i in sorted((n, i) for i, n in bits_of.items()):  # canonical: by length, then by id
        code, last = code << (n - last), n
        words[n, code] = i
        code += 1
    own = Tokenizer.from_file(WORDS)
    want = {(i, tuple(own.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows}
    got = set()
    for block in spark.read.parquet(str(tmp_path / "files" / "blocks")).collect():
        text, ids, at = "".join(f"{b:08b}" for b in block["bits"]), [], 0
        points = list(block["points"])
        while len(ids) < block["n"]:
            if len(ids) % huffman.EVERY == 0:
                assert points[len(ids) // huffman.EVERY] == at
            n = next(n for n in range(1, huffman.LIMIT + 1) if (n, int(text[at : at + n], 2)) in words)
            ids.append(words[n, int(text[at : at + n], 2)])
            at += n
        for doc, size in zip(block["docs"], block["sizes"], strict=True):
            got.add((doc, tuple(ids[:size])))
            ids = ids[size:]
    assert got == want
    crc = {r["doc_id"]: r["ids_crc32"] for r in huffman.read(spark.newSession(), str(tmp_path / "files")).collect()}
    assert all(crc[i] == zlib.crc32(np.asarray(ids, "<u4").tobytes()) for i, ids in want)


def test_token_files_hold_added_tokens_as_the_library_gives_them(spark):
    lines = ["<|endoftext|>", "<|startoftext|>", "hello <|endoftext|> world", "a<|endoftext|>b.", "A<|startoftext|>B!", "<|EndOfText|>", "x <|STARTOFTEXT|>, <|endoftext|>\n<|startoftext|>", "<|endoftext|><|endoftext|>", "<|endoftext| >", "ÄÖ<|endoftext|>É", "plain Words, here."]
    own = Tokenizer.from_file(WORDS)
    want, start = [], 0
    for i, text in enumerate(lines):
        ids = np.asarray(own.encode(text, add_special_tokens=False).ids + [1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert bag(huffman.read(spark, huffman.write(rows, WORDS)).collect()) == bag(want)
    tokens = huffman.Tokens(WORDS)
    assert np.frombuffer(tokens.encode(["hello <|endoftext|> world"])[0], tokens.width).tolist() == [3306, 49407, 1002, 1]


def test_words_that_differ_in_case_and_marks_are_asked_for_once():
    """Letters of any Latin word go to the model once, marks once, whatever their combinations."""
    cores = ["straße", "Straße", "ÉTÉ", "été", "word", "Word", "ñandú", "ÿþ"]
    marks = ["", ".", "!!", "***", "&&&", ".,!!", "_", "<|", "$$$"]
    lines = [c + m for c in cores for m in marks] + ["don't!!", "l'été***", "it's.", "x1!!", "é-é", "_a", "e\u0301!", "ǅ!!", "日本。", "a<|endoftext|>!", " \n a  b\n", ""]
    tokens, library, asked = huffman.Tokens(WORDS), Tokenizer.from_file(WORDS), []
    own = tokens.tokenizer

    class Seen:
        model = own.model

        def encode_batch_fast(self, words, **options):
            asked.extend(w for text in words for w in text.split(" "))
            return own.encode_batch_fast(words, **options)

    tokens.tokenizer = Seen()
    for _ in range(2):
        for line, ids in zip(lines, tokens.encode(lines), strict=True):
            assert np.frombuffer(ids, tokens.width).tolist() == [*library.encode(line, add_special_tokens=False).ids, huffman.END_ID], line
    assert len(asked) < 40 and len(asked) == len(set(asked))


def test_ids_of_a_slice_are_those_of_its_rows():
    rows = [np.arange(k, dtype="<u2").tobytes() for k in (3, 0, 5, 2, 0)]
    for kind in (pa.binary(), pa.large_binary()):
        column = pa.array(rows, kind)
        for a in range(6):
            for b in range(a, 6):
                assert huffman._ids(column.slice(a, b - a), 49_408).tobytes() == b"".join(rows[a:b])


def test_code_lengths_are_limited_and_best():
    rng = np.random.default_rng(9)
    counts = np.zeros(700, np.int64)
    counts[:600] = rng.pareto(0.4, 600) * 5 + 1
    lengths = huffman.code_lengths(counts)
    assert lengths.max() <= huffman.LIMIT and (2.0 ** -lengths[lengths > 0]).sum() == 1
    codes, table = huffman.canonical(lengths)
    ids = rng.choice(600, 5000, p=counts[:600] / counts.sum())
    bits, points = huffman.pack(ids, codes, lengths)
    assert (huffman.unpack([bits, bits], [points, points], [len(ids)] * 2, table) == np.tile(ids, 2)).all()
    assert sorted(huffman.code_lengths(np.asarray([1, 1, 2, 4]))) == [1, 2, 3, 3]


def test_forward_pass_sums_all_segmentations():
    pieces = language_id.vocabulary(PIECES)
    at = {p: k for k, p in enumerate(pieces.pieces)}
    probs = np.random.default_rng(3).random((len(at), 2)) / len(at)

    def total(s: str, c: int) -> float:
        if not s:
            return 1.0
        known = [n for n in range(1, len(s) + 1) if s[:n] in at]
        found = sum(probs[at[s[:n]], c] * total(s[n:], c) for n in known)
        return found if 1 in known else found + language_id.UNSEEN * total(s[1:], c)

    words = ["the", "straße", "q", "日x"]
    got = language_id.log_likelihoods(words, pieces, probs)
    for w, row in zip(words, got, strict=True):
        assert row == pytest.approx([np.log(total(language_id.START + w, c)) for c in (0, 1)])


def segmentations(s: str, at: dict) -> list[list[int]]:
    """Every way to cut s into pieces; -1 stands for a character without one."""
    if not s:
        return [[]]
    known = [n for n in range(1, len(s) + 1) if s[:n] in at]
    found = [[at[s[:n]], *rest] for n in known for rest in segmentations(s[n:], at)]
    return found if 1 in known else found + [[-1, *rest] for rest in segmentations(s[1:], at)]


def direct_model(rows: list[tuple[str, str]], pieces, rounds: int = 2) -> np.ndarray:
    """Expectation-maximisation by listing all segmentations of all words."""
    at, langs = {p: k for k, p in enumerate(pieces.pieces)}, sorted({x for x, _ in rows})
    probs = np.full((len(at), len(langs)), 1 / len(at))
    for _ in range(rounds):
        total = np.full(probs.shape, language_id.SMOOTH)
        for lang, text in rows:
            c = langs.index(lang)
            for w in language_id.words_of(text):
                ways = segmentations(language_id.START + w, at)
                weights = [np.prod([probs[k, c] if k >= 0 else language_id.UNSEEN for k in way]) for way in ways]
                for way, x in zip(ways, weights, strict=True):
                    for k in way:
                        if k >= 0:
                            total[k, c] += x / sum(weights)
        probs = total / total.sum(axis=0)
    return probs


def test_the_learned_model_equals_listing_all_segmentations(spark):
    pieces = language_id.vocabulary(PIECES)
    rows = [("aa", "the house and the green"), ("bb", "das haus 日x und"), ("aa", "the their"), ("bb", "grün das")]
    langs, probs = language_id.train(spark.createDataFrame(rows, "lang string, text string"), PIECES)
    want = direct_model(rows, pieces)
    assert langs == ["aa", "bb"] and np.allclose(probs, want, rtol=1e-9, atol=0)
    docs = spark.createDataFrame([(1, "the house"), (2, "grün und"), (3, "!"), (4, None)], "doc_id long, text string")
    at = {p: k for k, p in enumerate(pieces.pieces)}
    for r in language_id.predict(docs, PIECES, (langs, probs)).collect():
        words = language_id.words_of(r["text"] or "")
        each = [sum(np.log(sum(np.prod([want[k, c] if k >= 0 else language_id.UNSEEN for k in way]) for way in segmentations(language_id.START + w, at))) for w in words) for c in (0, 1)]
        assert (r["lang_pred"], r["score"]) == ((langs[int(np.argmax(each))], pytest.approx(np.exp(max(each)) / np.exp(each).sum())) if words else ("und", 0))


def test_long_runs_of_letters_are_scored_whole():
    """Against the same sum in exact fractions; both passes agree on how many pieces begin a word."""
    pieces = language_id.vocabulary(PIECES)
    at = {p: k for k, p in enumerate(pieces.pieces)}
    probs = np.random.default_rng(3).random((len(at), 2)) / len(at)
    words = ["the", "the" * 11, "straße" * 40, "日x" * 60, "q" * 700, "a"]
    got = language_id.log_likelihoods(words, pieces, probs)
    for w, row in zip(words, got, strict=True):
        s = language_id.START + w
        for c in (0, 1):
            ways = [Fraction(1)] + [Fraction(0)] * len(s)
            for i in range(len(s)):
                for j in range(i + 1, len(s) + 1 if i + pieces.longest > len(s) else i + pieces.longest + 1):
                    p = probs[at[s[i:j]], c] if s[i:j] in at else language_id.UNSEEN if j == i + 1 else 0
                    ways[j] += ways[i] * Fraction(p)
            n = ways[-1].denominator.bit_length() - ways[-1].numerator.bit_length()
            assert row[c] == pytest.approx(np.log(float(ways[-1] * 2**n)) - n * np.log(2))
    counts = language_id.expected_counts(words, np.zeros(len(words), np.int64), np.ones(len(words)), pieces, probs)
    starting = sum(counts[k, 0] for p, k in at.items() if p.startswith(language_id.START))
    assert starting == pytest.approx(len(words), abs=0.01) and counts[:, 1].sum() == 0


def test_language_id(spark, docs, empty):
    rng = random.Random(1)
    words = {"aa": ("the", "and", "of", "house", "green"), "bb": ("der", "und", "von", "haus", "grün")}
    rows = [(k, " ".join(rng.choice(words[x]) for _ in range(12)), x) for k in range(120) for x in (("aa", "bb")[k % 2],)] + [(500, None, "aa"), (501, "123 !?", "bb"), (502, "the green house", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(df, PIECES).collect()}
    assert all(got[k]["lang_pred"] == ("aa", "bb")[k % 2] for k in range(120)) and got[502]["lang_pred"] == "aa"
    assert [got[k]["lang_pred"] for k in (500, 501)] == ["und", "und"] and got[500]["score"] == 0
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for k, r in got.items())
    assert language_id.identify(docs, PIECES).count() == len(texts()) and language_id.identify(empty, PIECES).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(df.withColumn("lang", F.lit(None).cast("string")), PIECES).collect()} == {"und"}


def test_a_long_chain_is_one_component(spark):
    """No bound on rounds: a path of nodes that are no neighbours in number."""
    n = 3000
    place = list(range(n))
    random.Random(4).shuffle(place)
    edges = spark.createDataFrame(list(zip(place, place[1:], strict=False)), "a long, b long")
    got = simhash.components(edges).collect()
    assert len(got) == n - 1 and {r["root"] for r in got} == {0}


def test_released_deletes_its_own_folders_alone(spark):
    """Two pipelines at once, and one that fails."""
    import threading
    from pathlib import Path

    from cavitas.llm import shared

    rows, ready, checked, kept = spark.range(5), threading.Event(), threading.Event(), []

    def other():
        with shared.released(spark):
            kept.append(shared.stored(rows, "other"))
            ready.set()
            checked.wait(60)

    thread = threading.Thread(target=other)
    thread.start()
    ready.wait(60)
    path = []
    with pytest.raises(ValueError, match="stop"), shared.released(spark):
        path.append(shared.scratch_path(spark, "mine"))
        rows.write.parquet(path[0])
        raise ValueError("stop")
    assert not Path(path[0].removeprefix("file:")).exists() and kept[0].count() == 5
    checked.set()
    thread.join()
