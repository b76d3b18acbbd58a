"""op2, op6 and op7 against statements of their own."""

import heapq
import random
import re

import numpy as np
from conftest import SF_SMALL
from feedmatch.llm import ann, chat, toxicity
from pyspark.sql import functions as F


# op2

def _loss(weights, thresholds, rows, grade):
    """Mean negative log-likelihood of the grades, one row at a time; rows: feature numbers of each."""
    total = 0.0
    for features, g in zip(rows, grade, strict=True):
        score = sum(weights[f] for f in features)
        below = [0.0, *(1 / (1 + np.exp(score - t)) for t in thresholds), 1.0]
        total -= np.log(below[g + 1] - below[g])
    return total / len(grade)


def test_ordinal_fit_is_a_minimum():
    rnd = np.random.default_rng(3)
    rows = [sorted(rnd.choice(6, rnd.integers(0, 4), replace=False).tolist()) for _ in range(300)]
    true = np.array([2.0, 1.0, 0.5, -1.0, 0.0, 1.5])
    score = np.array([true[r].sum() for r in rows]) + rnd.logistic(size=300)
    grade = np.digitize(score, [0.5, 2.0])
    row, col = np.repeat(np.arange(300), [len(r) for r in rows]), np.concatenate([np.array(r, int) for r in rows])
    weights, thresholds = toxicity.fit_ordinal(row, col, grade, 6, l2=0.0, steps=3000, rate=0.05)
    assert (np.diff(thresholds) > 0).all()
    best = _loss(weights, thresholds, rows, grade)
    for k in range(6):  # no step along any weight or threshold is better
        for step in (-0.05, 0.05):
            assert _loss(weights + step * (np.arange(6) == k), thresholds, rows, grade) > best
    for k in range(2):
        for step in (-0.05, 0.05):
            assert _loss(weights, thresholds + step * (np.arange(2) == k), rows, grade) > best


def test_toxicity_query_by_hand(spark):
    from feedmatch.llm.queries import op2_toxicity

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    texts, toxic = dict(docs.select("doc_id", "text").collect()), {}
    for d, t in labels.select("doc_id", "toxic").collect():
        if d is not None and t is not None and d in texts:
            toxic[d] = max(t, toxic.get(d, 0))
    model = toxicity.train(docs, labels)
    counts = {}
    for d, t in toxic.items():
        words = set(re.findall(r"[^\W\d_]+", (texts[d] or "").lower()))
        for f in {w for w in words} | {w[:k] + "*" for w in words for k in (4, 5, 6, 7) if len(w) >= k}:
            counts.setdefault(f, [0, 0])[int(t > 0)] += 1
    p, n, z = sum(t > 0 for t in toxic.values()), sum(t == 0 for t in toxic.values()), {}
    for f, (other, own) in counts.items():
        if own + other >= 4:
            a, b = own + 0.5, other + 0.5
            odds = np.log(a / (p + 1 - a) / (b / (n + 1 - b)))
            z[f] = odds / np.sqrt(1 / a + 1 / (p + 1 - a) + 1 / b + 1 / (n + 1 - b))
    assert set(model.names) == {f for f, v in z.items() if v >= 3.5}
    weight = dict(zip(model.names, model.weights, strict=True))
    for r in op2_toxicity(spark, SF_SMALL).collect():
        score = sum(weight[f] for f in toxicity.features(texts[r["doc_id"]]) if f in weight)
        above = [1 / (1 + np.exp(t - score)) for t in model.thresholds]
        assert abs(r["severity"] - sum(above)) < 1e-9 and r["toxic"] == (r["severity"] >= 0.4)
        each = [1 - above[0], above[0] - above[1], above[1]]
        assert r["grade"] == each.index(max(each))


def test_repeated_labels_count_as_toxic(spark):
    rows = [(i, ("vile words " if i % 3 == 0 else "kind words ") + f"w{i}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = [(i, int(i % 3 == 0)) for i in range(90)]
    labels = spark.createDataFrame(once + [(i, 0) for i in range(0, 90, 3)] + [(None, 1), (4, None)], "doc_id long, toxic int")
    one, two = toxicity.train(docs, spark.createDataFrame(once, "doc_id long, toxic int")), toxicity.train(docs, labels)
    assert one.names == two.names and np.allclose(one.weights, two.weights)


# op6

def test_hashing_answers_with_high_recall(spark):
    rnd = np.random.default_rng(11)
    centres = rnd.normal(size=(300, 12))
    vectors = centres[rnd.integers(0, 300, 9000)] + 0.15 * rnd.normal(size=(9000, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(9000 + i, vectors[i].tolist()) for i in range(0, 200, 20)]  # ties
    rows += [(9500, [1.0, 2.0]), (9501, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    every = np.array([v for i, v in rows if i < 9500])
    names = np.array([i for i, _ in rows if i < 9500])
    hit = total = 0
    assert sorted(got) == sorted(i for i in names.tolist() if i % 50 == 0)
    for query, found in got.items():
        found.sort()
        scores = every @ every[names.tolist().index(query)]
        order = [i for i in np.lexsort((names, -scores)) if names[i] != query][:20]
        assert [r for r, *_ in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)  # ties to the smaller vec_id
        hit += len({names[i] for i in order} & {i for _, i, _ in found})
        total += 20
    assert hit / total >= 0.95
    # the buckets answer: with the fewest probes some neighbours are missed, which a search of all rows would not do
    few = ann.nearest(df, F.col("vec_id") % 50 == 0, 20, probes=1).collect()
    assert {(r["query_id"], r["vec_id"]) for r in few} != {(q, i) for q, found in got.items() for _, i, _ in found}


# op7

LEGAL = re.compile(r"s?(?:ua)+|")


def _least_cost(roles):
    """By uniform-cost search over (turns read, last role): keep 0, relabel 3, merge 1 more, an empty turn 2; s?(ua)* at the end."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, 0, "")], set()
    while True:
        cost, at, last = heapq.heappop(heap)
        if at == len(roles) and last in ("", "a"):
            return cost
        if (at, last) in done:
            continue
        done.add((at, last))
        for role in follows[last]:
            if role != "s":
                heapq.heappush(heap, (cost + 2, at, role))
        if at < len(roles):
            for role in "sua":
                relabel = 0 if roles[at] == role else 3
                if role in follows[last]:
                    heapq.heappush(heap, (cost + relabel, at + 1, role))
                if role == last:
                    heapq.heappush(heap, (cost + relabel + 1, at + 1, role))


def test_role_repair_is_cheapest_and_renders_legal_turns(spark):
    rnd = random.Random(12)
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    given = {c: [rnd.choice("suuaax") for _ in range(rnd.randint(1, 7))] for c in range(150)}
    rows = [(c, t, names[r], f"t{t}", "x", 1) for c, roles in given.items() for t, r in enumerate(roles)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, action string, piece int")  # clashing names
    found = {}
    for r in chat.format_conversations(df).collect():
        found.setdefault(r["conv_id"], []).append(r)
    for conv, roles in given.items():
        turns, cost, messages = sorted(found[conv], key=lambda r: r["turn"]), 0, []
        for r, role in zip(turns, roles, strict=True):
            merged = r["action"].endswith("merge")
            cost += 3 * (r["new_role"] != names[role]) + merged + 2 * len(r["inserted"] + r["closing"])
            messages += [[i, ""] for i in r["inserted"]]
            if merged:
                assert messages[-1][0] == r["new_role"]
                messages[-1][1] += f"\nt{r['turn']}"
            else:
                messages.append([r["new_role"], f"t{r['turn']}"])
            messages += [[i, ""] for i in r["closing"]]
        assert LEGAL.fullmatch("".join(m[0][0] for m in messages))
        assert cost == _least_cost(roles)
        assert "".join(r["piece"] for r in turns) == "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in messages)
