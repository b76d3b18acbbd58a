"""op11 radix audit, op12 block tables, op13 bin completion against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from conftest import SF_SMALL
from feedmatch.llm import bincompletion, blocktables, queries, radixaudit
from tokenizers import Tokenizer

WORDS = public_tokenizers.path("word_bpe_49k.json")
SPACE = " \t\n\x0b\x0c\r"


# op11

def _fails(doc_id, text, smaller):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return {f for f, bad in zip("ABCDE", (
        len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
        any(c in "#$%&*|" for c in text), doc_id is not None and doc_id > smaller.get(text, doc_id)), strict=True) if bad}


def _audit(docs, labels):
    """Rows of the audit by walking all documents through every order."""
    smaller, rows, shapley = {}, {}, Counter()
    for doc_id, text, _ in docs:
        if doc_id is not None:
            smaller[text or ""] = min(smaller.get(text or "", doc_id), doc_id)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    judged = [(d, lang or "", _fails(d, text or "", smaller)) for d, text, lang in docs]
    for part in {lang for _, lang, _ in judged}:
        own = [(d, f) for d, lang, f in judged if lang == part]
        for order in permutations("ABCDE"):
            alive = own
            for step, f in enumerate(order, 1):
                here, failing = [d for d, bad in alive if f in bad], [bad for _, bad in own if f in bad]
                alive = [(d, bad) for d, bad in alive if f not in bad]
                rows[part, "".join(order), step] = [len(alive), len(here), len(failing) - len(here), sum(bad == {f} for bad in failing),
                                                    sum(d in good for d in here), sum(d in toxic for d in here)]
                shapley[part, f] += len(here)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def _found(df):
    return {tuple(r)[:3]: tuple(r)[3:] for r in df.collect()}


def test_audit_edges(spark):
    rnd = random.Random(4)
    begin = "A shared licence line that every document begins with, long enough for several levels of prefixes. " * 3
    long = " ".join(f"w{i}" for i in range(3000))
    texts = ["", None, "x", long, long + " y", long.upper(), begin + "a", begin + "b", begin, "same " * 250, "é" * 40 + "A", "50 % | of", "\x1f\x85 a b"]
    docs = [(rnd.randint(0, 60), rnd.choice(texts), rnd.choice(["en", "fr", None, ""])) for _ in range(150)]
    docs += [(None, long, "en"), (None, "x", None), (None, long, "en"), *docs[:10]] + [(1000 + i, begin + str(i), "en") for i in range(80)]
    docs += [(5000 - i, "hot", "de") for i in range(200)]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(80)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    table = spark.createDataFrame([(d, t, lang, 1, "x") for d, t, lang in docs], "doc_id long, text string, lang string, mask int, h string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = _audit(docs, labels)
    assert _found(radixaudit.audit(table, marks)) == want
    assert _found(radixaudit.audit(table, marks, part_bytes=4000)) == want  # many parts, several prefix levels
    heavy = radixaudit._prefixes(radixaudit._rows(table), 1, 20)
    assert {len(p) for p in heavy} >= {8, 32, 128}
    assert radixaudit.audit(table.where("false"), marks).count() == 0
    none = _found(radixaudit.audit(table, marks.where("false")))
    assert {k: v[:4] for k, v in none.items()} == {k: v[:4] for k, v in want.items()} and not any(v[4] or v[5] for v in none.values())


def test_radix_trie_holds_every_text_once():
    rnd = random.Random(6)
    trie, want = radixaudit.RadixTrie(), {}
    for _ in range(3000):
        text = bytes(rnd.choices(b"ab", k=rnd.randint(0, 9))) + b"tail" * rnd.randint(0, 2)
        doc, lang = rnd.randint(0, 500), rnd.choice(["en", "de"])
        trie.insert(text, doc, lang)
        held = want.setdefault(text, [doc, Counter()])
        if doc < held[0]:
            want[text] = held = [doc, Counter()]
        if doc == held[0]:
            held[1][lang] += 1
    assert {t: (d, n) for t, d, n in trie.terminals()} == {t: (d, dict(n)) for t, (d, n) in want.items()}


def test_audit_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert _found(queries.op11_radix_audit(spark, SF_SMALL)) == _audit(docs, labels)


# op12

def _cheapest(rows):
    """(cost, audit) by uniform-cost search over whole audits; rows: (initial, must go, truncated)."""
    done, heap = set(), [(0, "", 0, "")]
    while True:
        cost, audit, at, last = heapq.heappop(heap)
        if (at, last) in done:
            continue
        done.add((at, last))
        if at == len(rows) and last in ("", "a"):
            return cost, audit
        due = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 5, audit + "I", at, due))
        if at < len(rows):
            initial, gone, cut = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, last))
            if not gone:
                if initial == due or (initial == "s" and not last):
                    heapq.heappush(heap, (cost + 5 * cut, audit + "K", at + 1, initial))
                heapq.heappush(heap, (cost + 1 + 5 * cut, audit + "R", at + 1, due))


def _digest(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of (turn, role, text) rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, *_ in rows if t is not None}
    cost, audit = _cheapest([(r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, faults, strict=True)])
    lines, given, last = [], iter(rows), ""
    for edit in audit:
        due = "assistant" if last == "u" else "user"
        if edit == "I":
            lines.append(f"{due}:")
            last = due[0]
            continue
        _, role, text = next(given)
        if edit != "D":
            role = role if edit == "K" else due
            lines.append(f"{role}:{text}")
            last = role[0]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def _damage(rows):
    by_conv = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        fate, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            by_conv[conv] += [(turn, "user" if fate == 4 else role, text)] * (1 + (fate == 3))
    return {c: _digest(own) for c, own in by_conv.items()}


def _digests(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in df.collect()}


def test_tables_give_the_least_audit():
    rnd = random.Random(2)
    for block in (1, 3, 4):
        tables = blocktables.Tables(block)
        for _ in range(700):
            rows = [(rnd.choice("suuaax"), rnd.random() < 0.2, rnd.random() < 0.25) for _ in range(rnd.randint(0, 14))]
            symbols = np.array([blocktables.symbol(*r) for r in rows], np.uint8)
            edits, end = tables.trace(symbols)
            cost, audit = _cheapest(rows)
            assert "".join(edits) + blocktables.CLOSING[end] == audit
            at, plus = tables.effect(symbols)
            assert tables.vectors[at[0]][blocktables.START] + plus[0] == cost
            middle = rnd.randint(0, len(rows))  # two slices, chained by the vector between them
            behind, _ = tables.effect(symbols[middle:])
            first, state = tables.trace(symbols[:middle], blocktables.START, int(behind[0]))
            second, last = tables.trace(symbols[middle:], state)
            assert (first + second, last) == (edits, end)


def _conversations():
    rnd = random.Random(8)
    texts = ["Yes.", "No!", "What? ", "so", "", None, " \t\n", "end.\x85", "end. ", "long text. " * 500, "a", "b."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    rows = [(rnd.randint(0, 60), rnd.choice([*range(12), None]), rnd.choice(roles), rnd.choice(texts)) for _ in range(900)]
    rows += [(None, rnd.choice([0, 1, None]), "user", rnd.choice(texts)) for _ in range(20)] + rows[:30]
    return rows + [(777, t, rnd.choice(roles), rnd.choice([*texts, f"t{t}."])) for t in range(700)] + [(778, None, None, None)]


@pytest.mark.parametrize("coalesce", ["true", "false"])  # one slice, and many that cut conversations
def test_conversation_repair_edges(spark, coalesce):
    rows = _conversations()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, cost int")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        got = blocktables.audit(table).collect()
        edits = blocktables.repair(blocktables.damaged(table).where("NOT dropped")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    want = _damage(rows)
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    if coalesce == "false":
        assert not all(r["whole"] for r in edits) and len({r["part"] for r in edits if r["conv_id"] == 777}) > 1
    assert sum(r["cost"] for r in edits) == sum(w[5] for w in want.values())


def test_conversation_repair_empty(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert blocktables.audit(table).count() == 0 and blocktables.repair(table).count() == 0


def test_conversation_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _digests(queries.op12_block_tables(spark, SF_SMALL)) == _damage(rows)


# op13

def _fewest(sizes, window):
    best, order = len(sizes), sorted(sizes, reverse=True)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(order):
            best = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + order[i] <= window:
                bins[k] += order[i]
                place(i + 1, bins)
                bins[k] -= order[i]
        place(i + 1, [*bins, order[i]])

    place(0, [])
    return best


def test_bin_completion_finds_the_fewest_windows():
    rnd, better = random.Random(1), 0
    for _ in range(1500):
        window = rnd.choice([10, 30, 100])
        sizes = [rnd.randint(1, window) if rnd.random() < 0.5 else rnd.randint(window // 5 + 1, window // 2 + 1) for _ in range(rnd.randint(0, 11))]
        got = bincompletion.complete_bins(sizes, window)
        assert sorted(s for b in got for s in b) == sorted(sizes) and all(sum(b) <= window for b in got)
        assert len(got) == _fewest(sizes, window)
        if sizes:
            assert bincompletion.lower_bound(sizes, window) <= len(got)
            better += len(got) < len(bincompletion.best_fit_decreasing(sizes, window))
    assert better > 5  # the search improves on its first incumbent


def test_bin_completion_keeps_the_incumbent_without_steps():
    sizes = random.Random(3).choices(range(400, 1000), k=500)
    got = bincompletion.complete_bins(sizes, 2048, steps=10)
    assert sorted(s for b in got for s in b) == sorted(sizes) and all(sum(b) <= 2048 for b in got)


@cache
def _ids(text):
    return np.array(Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def _check_pieces(pieces, texts, size):
    """texts: list of (doc_id, text), repeats included."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for own in by_sequence.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= size
    assert set(by_doc) == {d for d, _ in texts}
    for doc, text in dict(texts).items():
        ids, copies = _ids(text), sum(d == doc for d, _ in texts)
        want = [(k, k * size, len(ids[k * size:][:size]), zlib.crc32(ids[k * size:][:size].tobytes())) for k in range(-(-len(ids) // size))]
        assert sorted((p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in by_doc[doc]) == sorted(want * copies)
    return len(by_sequence)


def test_bin_completion_packs_every_id_once(spark):
    from pyspark.sql import functions as F

    rows = [(1, "It's a fine day."), (2, ""), (3, None), (4, "word " * 700), (4, "word " * 700), (None, "no id"), (6, "<|endoftext|> x"), (7, "a " * 63), (8, "b " * 64)]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, sequence_id string, piece int").repartition(2)
    pieces = bincompletion.pack_documents(docs, WORDS, size=64, block_pieces=4).withColumn("ids_crc32", F.crc32("ids")).collect()
    _check_pieces(pieces, rows, 64)
    assert bincompletion.pack_documents(docs.where("false"), WORDS).count() == 0


def test_bin_completion_query(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    number = _check_pieces(queries.op13_bin_completion(spark, SF_SMALL).collect(), texts, 2048)
    parts = spark.read.parquet(f"{SF_SMALL}/documents.parquet").rdd.getNumPartitions()
    assert number <= -(-sum(len(_ids(t)) for _, t in texts) // 2048) + parts
