"""Line rules, token alignment and resampling against SQL, the libraries and direct versions; odd rows as in test_operators."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from cavitas.llm import alignment, line_rules, resample
from tests.llm.test_operators import bag

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, source string, row string, n_words string, kept string, gone string, score string"


def rows() -> list[tuple]:
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    line = lambda n: " ".join(word() for _ in range(n))
    found = [(k, "\n".join(line(rng.randint(1, 12)) for _ in range(rng.randint(1, 9))), f"s{k % 3}") for k in range(60)]
    found += [(100 + k, f"{line(14)}\n  A Line of  the HOST, again\n{line(3)}", "s0") for k in range(30)]
    found += [(200 + k, f"a line of the host, again\nall rights\treserved\n{line(9 + k % 3)}", "s0" if k % 2 else None) for k in range(50)]
    found += [(300, None, "s1"), (301, "", None), (302, " \t\n\x0b\x0c\r ", "s1"), (303, "one two three four five\n" * 9, "s2"), (304, "Ünïcode ß 日本語 é́ #1 <b>&amp;</b> 100% x|y  don't $5\n\n" * 3, "s2"), (None, line(30), "s0"), (None, line(30), "s0")]
    found += [(305, found[0][1], "s1"), (305, found[0][1], "s1"), (306, line(40_000), "s2"), (307, "z" * 60_000 + " " + "yx " * 500, "s2"), (308, "no break space \x1c \x85 here <|endoftext|> <s> </s> ▁ mark", "s1"), (309, "<|endoftext|><s>[INST]  two   blanks \n\n\ttab ", "s1")]
    return [(*r, "r", "n", "k", "g", "s") for r in found]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def direct_repeats(words: list[str]) -> int:
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return len({i + k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(5)})


@pytest.mark.parametrize("partitions", [8, 300])
def test_line_rules_equal_sql_and_a_direct_version(spark, docs, empty, partitions, monkeypatch):
    """With 300 partitions each frequent line is a hot one; with 8 some are."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(line_rules, "PART", 1000)
    try:
        own = line_rules._found

        def found(rows, documents, share):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            out = own(rows, documents, share)
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            return out

        monkeypatch.setattr(line_rules, "_found", found)
        got = line_rules.judge(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    db = duckdb.connect()
    db.register("documents", docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    columns = list(got[0].asDict())
    assert bag(got) == bag(db.execute(f"select {', '.join(columns)} from ({line_rules.SQL})").fetchall())
    by_line = defaultdict(set)
    lines_of = lambda t: [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    plain = lambda x: " ".join(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x)))
    for i, t, host, *_ in rows():
        for x in lines_of(t):
            by_line[host, plain(x)].add(i)
    want = []
    for i, t, host, *_ in rows():
        words, lines = re.findall(r"[^\x20\x09-\x0D]+", t or ""), lines_of(t)
        gone = sum(len(plain(x).split(" ")) for x in lines if len(by_line[host, plain(x)]) > 20)
        again, n = direct_repeats(words), len(words)
        failed = n < 10 or 100 * again > 20 * n
        want.append((i, n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), again, gone, failed, not failed and n - gone >= 10 and 100 * (n - gone) >= 50 * n))
    assert bag(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "words_removed", "base_failed", "kept")) for r in got) == bag(want)
    assert sum(r["words_removed"] > 0 for r in got) > 60 and any(not r["kept"] and not r["base_failed"] for r in got)
    assert line_rules.judge(empty).count() == 0


def test_cleaned_rows_lose_their_frequent_lines(docs, empty):
    got = line_rules.cleaned(docs)
    assert got.columns == docs.columns and line_rules.cleaned(empty).count() == 0
    left = got.collect()
    verdicts = line_rules.judge(docs).where("kept").collect()
    assert bag((r["doc_id"],) for r in left) == bag((r["doc_id"],) for r in verdicts)
    assert all("host" not in (r["text"] or "") for r in left if r["source"] == "s0" and (r["doc_id"] or 0) >= 100)
    assert all((r["row"], r["kept"], r["gone"], r["score"]) == ("r", "k", "g", "s") for r in left)
    untouched = {r[0]: r[1] for r in rows() if r[0] is not None and r[0] < 60}
    assert all(untouched[r["doc_id"]] == r["text"] for r in left if r["doc_id"] in untouched)


def test_repeated_windows_with_many_words():
    """More different words than fit a packed key."""
    rng = random.Random(1)
    for different, n in ((1, 3), (1, 40), (3, 200), (20_000, 40_000)):
        words = [str(rng.randrange(different)) for _ in range(n)]
        words[n // 2 : n // 2 + n // 9] = words[: n // 9]
        ids, k = line_rules.word_ids(" ".join(words).encode())
        assert line_rules.repeated_words(ids, k) == direct_repeats(words)


def direct_groups(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    ends_a, ends_b = ({int(e): k + 1 for k, e in enumerate(np.cumsum([len(t) for t in x]))} for x in (a, b))
    return [(ends_a[e], ends_b[e]) for e in sorted(ends_a.keys() & ends_b.keys())]


def direct_alignment() -> list[tuple]:
    own = Tokenizer.from_file(A)
    own.encode_special_tokens = True
    other = sentencepiece.SentencePieceProcessor(model_file=B)
    visible = {c: b for b, c in enumerate_bytes()}
    counts, found = Counter(), []
    for i, t, *_ in rows():
        if not t:
            found.append((i, [], [], []))
            continue
        ours, theirs = own.encode(" " + t, add_special_tokens=False).ids, other.encode(t)
        a = [bytes(visible[c] for c in own.id_to_token(k)) for k in ours]
        b = [bytes([int(p[3:5], 16)]) if other.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(theirs, other.encode(t, out_type=str), strict=True)]
        if not b"".join(a) == b"".join(b) == (" " + t).encode():
            found.append((i, [], [], []))
            continue
        ends = direct_groups(a, b)
        counts.update((ours[p - 1], theirs[q - 1]) for p, q in ends)
        found.append((i, ours, theirs, ends))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    result = []
    for i, a, b, ends in found:
        links = [(a[p - 1], b[q - 1]) for p, q in ends]
        text, x, y = [], 0, 0
        for p, q in ends:
            text.append(",".join(map(str, a[x:p])) + "|" + ",".join(map(str, b[y:q])))
            x, y = p, q
        digest = hashlib.sha256(";".join(text).encode()).hexdigest() if a else ""
        result.append((i, len(a), len(b), len(ends), len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links), digest))
    return result


def enumerate_bytes() -> list[tuple[int, str]]:
    """The byte-level vocabulary's character of each byte, from the library itself."""
    from tokenizers import pre_tokenizers

    level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    found = {}
    for code in [*range(0x80), *range(0x80, 0x800, 7), 0x3042, 0x65E5, 0xD7A3, 0xE000, 0xF8FF, *range(0x800, 0xD800, 500), *range(0x10000, 0x10FFFF, 9000), *range(0x80, 0x800)]:
        c = chr(code)
        for b, x in zip(c.encode(), level.pre_tokenize_str(c)[0][0], strict=True):
            found[b] = x
    return sorted(found.items())


@pytest.mark.parametrize("most_held", [1 << 19, 60, 0])
def test_alignment_equals_the_libraries(docs, empty, most_held):
    got = alignment.linked(docs, A, B, most_held)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.columns == columns
    want = direct_alignment()
    assert bag(got.collect()) == bag(want) and sum(r[1] for r in want) > 50_000 and sum(r[1] == 0 for r in want) >= 3
    assert alignment.linked(empty, A, B, most_held).count() == 0


def test_aligned_rows_hold_the_groups(docs):
    got = alignment.align(docs, A, B).collect()
    want = {(r[0], r[1], r[2], r[3]) for r in direct_alignment()}
    assert {(r["doc_id"], len(r["a_ids"]), len(r["b_ids"]), len(r["a_ends"])) for r in got} == want


def test_groups_equal_a_merge_of_the_ends():
    rng = np.random.default_rng(4)
    for n, share in [(1, 1.0), (40, 0.9), (500, 0.5), (500, 0.97), (3000, 0.999), (3000, 0.1)]:
        for _ in range(20):
            a, b = (np.unique(np.append(np.flatnonzero(rng.random(n) < share) + 1, n)) for _ in range(2))
            common = np.intersect1d(a, b)
            to_a, to_b = alignment.groups(a, b)
            assert to_a.tolist() == (np.searchsorted(a, common) + 1).tolist() and to_b.tolist() == (np.searchsorted(b, common) + 1).tolist()


def test_chunks_are_encoded_as_whole_texts(monkeypatch):
    own = alignment.Vocabularies(A, B)
    assert own.cuts
    rng = random.Random(8)
    letters = ["a", "b", " ", " ", "\n", "\t", ".", "'s", "1", "é", "日", " ", "　", "\x1c", "\x00", "Z", "word", " the", "<s>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    each = [x for k in range(0, len(texts), 500) for x in own.encode(texts[k : k + 500])]
    monkeypatch.setattr(alignment, "MOST_KNOWN", 10_000)  # forgotten and learned again
    assert [x is None for x in each] == [x is None for k in range(0, len(texts), 7) for x in own.encode(texts[k : k + 7])]
    for text, found in zip(texts, each, strict=True):
        a, b = own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)
        whole = b"".join(own.a_bytes[i] for i in a) == b"".join(own.b_bytes[i] for i in b) == (" " + text).encode()
        assert (found is not None) == whole
        if whole:
            assert found[0].tolist() == a and found[2].tolist() == b


def direct_sample(docs_rows: list[tuple], target: list[str | None]) -> list[tuple]:
    def features(t: str | None) -> tuple[int, list[int]]:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]

    each = [(r[0], *features(r[1])) for r in docs_rows]
    own, other = Counter(), Counter()
    for _, _, found in each:
        own.update(found)
    for t in target:
        other.update(features(t)[1])
    s, t = own.total(), other.total()
    gain = lambda b: math.floor(1000 * math.log((other[b] + 1.0) * (s + 10000) / ((own[b] + 1.0) * (t + 10000))))
    scored = []
    for i, n, found in each:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        scored.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in scored if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = 5 * len(able) // 100
    ranked = [(r[0], *r[2:], k + 1 if k < drawn else None) for k, r in enumerate(able)]
    return ranked + [(r[0], *r[2:], None) for r in scored if r[1] < 20]


def test_resampling_equals_a_direct_version(spark, docs, empty, monkeypatch):
    target = ["All rights reserved, again a line", "abc abc ABC 12", None, "", "日本語 é́ ünïcode"]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    want = direct_sample(rows(), target)
    for batch in (resample.BATCH, 300):
        monkeypatch.setattr(resample, "BATCH", batch)
        got = resample.score(docs, table)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert bag(got.collect()) == bag(want)
    assert sum(r[4] is not None for r in want) >= 4
    assert bag(resample.score(docs, table.where("false")).collect()) == bag(direct_sample(rows(), []))
    assert resample.score(empty, table).count() == 0
    drawn = resample.resampled(docs, table)
    assert drawn.columns == docs.columns and bag((r["doc_id"], r["score"]) for r in drawn.collect()) == bag((r[0], "s") for r in want if r[4] is not None)


def test_hashes_of_stretches_are_xxh64():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 4000, np.uint8).tobytes()
    start = np.concatenate([np.arange(100), np.zeros(3, np.int64), [3990, 4000]])
    length = np.concatenate([np.arange(100), [31, 32, 4000], [10, 0]])
    own = resample.Stretches(data, start, length)
    assert own.hashes().tolist() == [xxhash.xxh64_intdigest(data[a : a + n]) for a, n in zip(start.tolist(), length.tolist(), strict=True)]


def test_slots_are_shared_by_equal_bytes_alone(monkeypatch):
    """All keys the same: bytes alone decide, along the probes."""
    monkeypatch.setattr(resample.Stretches, "hashes", lambda self: np.full(len(self.start), 7, np.uint64))
    text = b"aa bb aa cc aaa bb " + b"x" * 90 + b" " + b"x" * 89 + b"y " + b"x" * 90
    own, _ = resample.grams(next(resample.together([text])))
    table = resample.Interned(own, 10_000)
    view = memoryview(own.buffer)
    by_slot = defaultdict(Counter)
    for a, n, slot in zip(own.start.tolist(), own.length.tolist(), table.slot.tolist(), strict=True):
        by_slot[slot][bytes(view[a : a + n])] += 1
    assert all(len(x) == 1 for x in by_slot.values()) and len(by_slot) == len({g for x in by_slot.values() for g in x})
    assert all(table.count[k] == x.total() and table.bucket[k] == zlib.crc32(next(iter(x))) % 10_000 for k, x in by_slot.items())
