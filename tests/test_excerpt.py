"""FN-18 against a model that marks every kept character."""

import random

from pyspark.sql import functions as F

from feedmatch import dims
from feedmatch.operators.excerpt import visa_excerpt


def marked(text):
    body = (text or "").strip()
    if len(body) <= dims.EXCERPT_BUDGET:
        return body
    low, keep, at = body.lower(), [i < dims.EXCERPT_HEAD for i in range(len(body))], dims.EXCERPT_HEAD
    while at < len(low):
        term = next((t for t in dims.VISA_TERMS if low.startswith(t, at)), None)
        if term:
            for i in range(max(0, at - dims.EXCERPT_WINDOW), min(len(body), at + len(term) + dims.EXCERPT_WINDOW)):
                keep[i] = True
        at += len(term or "x")
    out, n, last = [], 0, -1
    for i, c in enumerate(body):
        if keep[i] and n < dims.EXCERPT_BUDGET:
            out.append(c if last == i - 1 else dims.EXCERPT_JOIN + c)
            n, last = n + 1, i
    return "".join(out)


def test_excerpt_matches_model(spark):
    rnd = random.Random(3)
    words = ["lorem", "größe", "vis", "Team", "office"]
    texts = [None, "", "   ", "  short posting  ", "z" * 2500, "z" * 2501, "q " * 900 + "Blue Card" + " q" * 900]
    for density in (0.0, 0.002, 0.01, 0.2):
        for _ in range(6):
            texts.append(" ".join(rnd.choice(dims.VISA_TERMS).title() if rnd.random() < density else rnd.choice(words)
                                  for _ in range(rnd.randrange(200, 1500))))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.e for r in df.select("i", visa_excerpt(F.col("t")).alias("e")).collect()}
    assert [got[i] for i in range(len(texts))] == [marked(t) for t in texts]
