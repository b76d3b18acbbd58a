"""run() of the corpus pipeline against plain Python on a small folder."""

import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from feedmatch.llm import toxicity
from tests.conftest import SF_SMALL
from tests.llm.test_simhash_decontam import _brute_components, _brute_fingerprint


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _expected(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    weight = dict(zip(model.names, model.weights, strict=True))
    texts = {}
    for row in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        score = np.array([sum(weight.get(f, 0.0) for f in toxicity.features(row["text"]))])
        if model.severity(score)[0] < toxicity.TOXIC_AT:
            texts[row["doc_id"]] = row["text"]
    ids = sorted(texts)
    groups = _brute_components([_brute_fingerprint(texts[i]) for i in ids])
    kept = [i for k, i in enumerate(ids) if groups[k] == k]
    windows = set()
    for item in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect():
        words = _words(item["text"])
        windows |= {tuple(words[k:k + 10]) for k in range(max(1, len(words) - 9))} if words else set()
    sizes = {len(w) for w in windows}

    def clean(text):
        words = _words(text)
        return not any(tuple(words[k:k + n]) in windows for n in sizes for k in range(len(words) - n + 1))

    return {i: texts[i] for i in kept if clean(texts[i])}


def test_run_equals_brute_force(spark):
    want = _expected(spark)
    pieces = corpus_pipeline.run(spark, SF_SMALL).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, sequences = {}, {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        assert p["start"] == len(got.get(p["doc_id"], b"")) // 4 and p["length"] * 4 == len(p["ids"])
        got[p["doc_id"]] = got.get(p["doc_id"], b"") + p["ids"]
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert sorted(got) == sorted(want)
    for doc_id, text in want.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert got[doc_id] == np.array(ids, "<u4").tobytes()
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert 0 < len(want) < spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
