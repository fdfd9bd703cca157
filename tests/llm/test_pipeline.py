"""The pipeline's stages, each on its own input."""

from __future__ import annotations

import hashlib
import os
import random

import duckdb
import numpy as np
import pytest
import tiktoken

import corpus_pipeline
from cavitas.llm import bpe, language_id, mixing
from tests.llm.test_operators import BPE, PIECES, bag, direct_model, public_tokenizers, reference_fingerprint, segmentations, without_repeats

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no supplied tables")
def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], DATA).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert seen[-1].columns == COLUMNS
    raw, tongue, near, passages, mixed, tokens = seen
    assert tongue.count() == raw.count()  # all supplied texts have letters
    assert near.count() < tongue.count() and near.count() == near.select("doc_id").distinct().count()
    before = {r["doc_id"]: r["text"] for r in near.collect()}
    after = {r["doc_id"]: r["text"] for r in passages.collect()}
    assert set(after) <= set(before) and sum(map(len, after.values())) < sum(map(len, before.values()))
    grams: set[str] = set()
    for _, text in sorted(after.items()):
        own = {text[p : p + 60] for p in range(len(text) - 59)}
        assert not own & grams
        grams |= own
    assert {r["doc_id"] for r in mixed.select("doc_id").distinct().collect()} <= set(after)
    want = {d: hashlib.sha256(t.encode()).hexdigest() for d, t in after.items()}
    rows = tokens.collect()
    assert len(rows) == mixed.count() and all(r["decoded_sha256"] == want[r["doc_id"]] for r in rows)


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


LINE = " a line of rather more than fifty bytes that many documents of this table hold "
EXTRA = ("fp", "row", "copies", "lang_pred", "score", "kept__row", "block", "before")


def fixture() -> list[tuple]:
    """Two languages, nulls in every column, copies, a shared line, a long text, ties and repeated rows; extra columns with the operators' own names."""
    rng = random.Random(21)
    words = {"aa": ("the", "and", "of", "house", "green", "to"), "bb": ("der", "und", "von", "haus", "ein", "ist")}
    text = lambda x, n: " ".join(rng.choice(words[x]) for _ in range(n))
    rows = [(k, text(x, rng.randint(8, 40)), x, f"s{k % 3}") for k in range(40) for x in (("aa", "bb")[k % 2],)]
    rows += [(40, rows[3][1], "bb", "s1"), (41, rows[4][1] + " end", None, "s2"), (42, LINE + text("aa", 9), "aa", "s0"), (43, text("bb", 9) + LINE, "bb", None)]
    rows += [(44, None, "aa", "s0"), (45, "", None, None), (46, "12 !?", "bb", "s1"), (None, text("aa", 12), "aa", "s1"), (47, text("aa", 12), None, "s2"), (47, rows[-1][1], "aa", "s2")]
    rows += [(48, text("bb", 3000), "bb", "s0"), (49, LINE.strip(), "aa", "s1"), (50, LINE.strip() + " ", "aa", "s1")]
    return [(i, t, x, s, None if t is None else len(t), *EXTRA) for i, t, x, s in rows]


def languages(rows: list[tuple]) -> list[str]:
    """The most likely language of each text by listing all segmentations of its words; learned from the same rows."""
    pieces = language_id.vocabulary(PIECES)
    at = {p: k for k, p in enumerate(pieces.pieces)}
    known: dict[str, np.ndarray] = {}
    probs = direct_model([(r[2], r[1]) for r in rows if r[1] is not None and r[2] is not None], pieces)
    found = []
    for _, text, *_ in rows:
        words = language_id.words_of(text or "")
        for w in {*words} - known.keys():
            ways = segmentations(language_id.START + w, at)
            known[w] = np.log([sum(np.prod([probs[k, c] if k >= 0 else language_id.UNSEEN for k in way]) for way in ways) for c in (0, 1)])
        found.append(("aa", "bb")[int(np.argmax(sum(known[w] for w in words)))] if words else "und")
    return found


def test_each_stage_equals_brute_force(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
    rows = fixture()

    def stage(name: str, given: list[tuple]) -> list[tuple]:
        found = dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame(given, schema).repartition(3), "")
        assert name == "tokens" or found.columns == [*COLUMNS, *EXTRA]
        return sorted(map(tuple, found.collect()), key=repr)

    spoken = stage("language_id", rows)
    assert spoken == sorted(((*r[:2], x, *r[3:]) for r, x in zip(rows, languages(rows), strict=True) if x != "und"), key=repr)

    near = stage("near_duplicates", spoken)
    fps, group = [reference_fingerprint(r[1]) for r in spoken], list(range(len(spoken)))
    for _ in spoken:
        for a in range(len(spoken)):
            for b in range(len(spoken)):
                if (fps[a] ^ fps[b]).bit_count() <= 4:
                    group[a] = group[b] = min(group[a], group[b])
    best = {g: min((spoken[k][0] is None, spoken[k][0] or 0) for k in range(len(spoken)) if group[k] == g) for g in set(group)}
    assert len(near) == len(best) < len(spoken) and {(r[0] is None, r[0] or 0) for r in near} == {*best.values()} and {*near} <= {*spoken}

    left = stage("repeated_passages", near)
    digests = without_repeats([r[:2] for r in near])
    want = {d[0]: d[4] for d in digests if d[1] > d[2] or d[1] == 0}
    assert {r[0]: hashlib.sha256(r[1].encode()).hexdigest() for r in left} == want  # all texts are ASCII, so whole characters go
    assert len(left) < len(near) and sum(d[2] for d in digests) > 100 and all(r[4] == len(r[1]) for r in left)

    mixed = stage("mix_sources", left)
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    db.executemany("insert into documents values (?, ?, ?)", [(r[0], r[1], r[3]) for r in left])
    taken = {i: n // size for i, n, size in db.execute(f"select doc_id, taken, size from ({mixing.SQL})").fetchall()}
    assert mixed == sorted((r for r in left for _ in range(taken[r[0]])), key=repr)

    ref = tiktoken.Encoding("ref", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(BPE, public_tokenizers.PATTERN).ranks, special_tokens={})
    ids = [(r[0], ref.encode_ordinary(r[1]), r[1]) for r in mixed]
    assert bag(stage("tokens", mixed)) == bag((i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, x, t in ids)
