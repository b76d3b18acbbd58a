import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from feedmatch.llm import dac, packing
from feedmatch.llm.scratch import scratch_path
from feedmatch.llm.tokens import TokenMemo
from pyspark.sql import functions as F
from tokenizers import Tokenizer

WORDS, BYTES = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
DOCS = "doc_id long, text string, ids string, start int"  # the last two clash with output names
ROWS = [(5, "It's a fine day, isn't it?", "x", 1), (2, "", None, None), (3, None, "y", 2), (9, "á ß ÷ \t two\n\n lines ", "z", 3),
        (5, "It's a fine day, isn't it?", "x", 1), (None, "no id", None, None), (7, "long words " * 3000, "w", 0), (1, "<|endoftext|> 'S x ", "", 0)]


@cache
def _tokenizer(path):
    return Tokenizer.from_file(path)


def _ids(path, text):
    return [*_tokenizer(path).encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_memo_equals_library_on_whole_texts(path):
    rnd = np.random.default_rng(3)
    letters = list("ab'sT .,\n\t 1é́ß×² d　_\x1c") + ["<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "  ", "   ", " \n"]
    texts = ["".join(rnd.choice(letters, rnd.integers(0, 30))) for _ in range(3000)] + [t for _, t, *_ in ROWS]
    for memo in (TokenMemo(path), TokenMemo(path, entries=50)):  # the second forgets all the time
        assert memo.mode
        for _ in range(2):  # first unknown, then remembered
            assert [[*np.frombuffer(raw, "<u4"), 1] for raw in memo.encode(texts)] == [_ids(path, t) for t in texts]


def test_special_token_strings_follow_the_plain_call():
    for path, special in ((WORDS, 49407), (BYTES, 50256)):
        assert special in np.frombuffer(next(TokenMemo(path).encode(["hello <|endoftext|> world"])), "<u4")


def test_dac_random_access():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 7, 511, 512, 513, 5000):
        ids = (rnd.integers(0, 1 << 32, n) >> rnd.integers(0, 32, n)).astype(np.uint32)
        reader = dac.Reader(dac.pack(ids))
        assert len(reader) == n
        assert [reader[i] for i in range(0, n, 13)] == ids[::13].tolist()
        for a, b in [(0, n), (n // 3, n // 2), (n, n)]:
            assert (reader.read(a, b) == ids[a:b]).all()


def test_dac_table_round_trip(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    path = scratch_path(spark, "dac-test")
    dac.write_tokens(docs, path, WORDS, segment_tokens=50)
    got = dac.read_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 5, 5, 7, 9]
    texts = {d: t for d, t, *_ in ROWS}
    start = 0
    for r in got:
        want = _ids(WORDS, texts[r["doc_id"]])
        assert np.frombuffer(r["ids"], "<u4").tolist() == want
        assert (r["start"], r["n_tokens"]) == (start, len(want))
        start += len(want)
    empty = scratch_path(spark, "dac-empty")
    dac.write_tokens(docs.where("false"), empty, WORDS)
    assert dac.read_tokens(spark, empty).count() == 0


def _check_packing(pieces, texts, size):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for doc, own in by_doc.items():
        own.sort(key=lambda p: (p["start"], p["sequence_id"]))
        want = _ids(BYTES, texts[doc])
        copies = sum(p["length"] for p in own) // len(want)
        assert all(p["doc_tokens"] == len(want) for p in own)
        assert all(want[p["start"]:p["start"] + p["length"]] == np.frombuffer(p["ids"], "<u4").tolist() for p in own)
        covered = sorted(i for p in own for i in range(p["start"], p["start"] + p["length"]))
        assert covered == sorted([*range(len(want))] * copies) and copies == 1 + (doc == 5)
    padding = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        at = 0
        for p in own:
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def test_packing_covers_every_id_once(spark):
    docs = spark.createDataFrame(ROWS, DOCS).repartition(2, "doc_id")
    pieces = packing.pack_documents(docs, BYTES, size=64).collect()
    assert {p["doc_id"] for p in pieces} == {d for d, *_ in ROWS}
    assert _check_packing(pieces, {d: t for d, t, *_ in ROWS}, 64) == 0
    assert packing.pack_documents(docs.where("false"), BYTES).count() == 0


def test_sum_of_squares_takes_the_level_of_least_sum():
    rnd, size = np.random.default_rng(5), 50
    packer, levels = packing.SumOfSquares(size), np.zeros(size + 1, int)
    for s in rnd.integers(1, size, 400).tolist():
        best = None
        for h in [*range(size - s, 0, -1), 0]:  # fullest first, a new window last
            if h and not levels[h]:
                continue
            after = levels.copy()
            after[h] -= h > 0
            after[h + s] += h + s < size
            cost = int((after[1:size] ** 2).sum())
            if best is None or cost < best[0]:
                best = (cost, after)
        levels = best[1]
        packer.add((0, 0, s, bytes(4 * s)))
        assert (packer.levels[1:size] == levels[1:size]).all()


def test_queries_against_brute_force(spark):
    from conftest import SF_SMALL
    from feedmatch.llm.queries import op1_dac_tokens, op3_sum_of_squares_packing

    texts = dict(spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect())
    start = 0
    for r in op1_dac_tokens(spark, SF_SMALL).orderBy("doc_id").collect():
        want = np.array(_ids(WORDS, texts[r["doc_id"]]), "<u4")
        assert tuple(r) == (r["doc_id"], start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    pieces = op3_sum_of_squares_packing(spark, SF_SMALL).collect()
    for p in pieces:
        want = np.array(_ids(BYTES, texts[p["doc_id"]])[p["start"]:p["start"] + p["length"]], "<u4")
        assert (p["ids_crc32"], p["length"]) == (zlib.crc32(want.tobytes()), len(want))
    total = spark.createDataFrame(pieces).agg(F.sum("length")).first()[0]
    assert total == sum(len(_ids(BYTES, t)) for t in texts.values())
