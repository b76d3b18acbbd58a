import re

import numpy as np
import xxhash
from feedmatch.llm import decontam, simhash
from feedmatch.llm.components import components


def _brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _brute_components(fps, max_bits=4):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_equals_brute_force(spark):
    texts = ["", None, "one", "A b\tC d", "Ünï É x　y z w", "the same words " * 400, "A\xa0b c d e"]
    assert [simhash.fingerprint(t) for t in texts] == [_brute_fingerprint(t) for t in texts]


def _clouds(rnd, n):
    out = []
    for centre in rnd.integers(0, 1 << 63, 6, dtype=np.uint64).tolist():
        fp = centre
        for _ in range(n):
            fp ^= 1 << int(rnd.integers(0, 64))
            out.append(fp if rnd.random() < 0.7 else centre ^ (1 << int(rnd.integers(0, 64))))
    return sorted({*out, 0, 1, (1 << 64) - 1, *rnd.integers(0, 1 << 63, 200, dtype=np.uint64).tolist()})


def test_trie_links_connect_what_all_pairs_connect(spark):
    rnd = np.random.default_rng(2)
    for bits, rows in [(4, 1 << 16), (4, 5), (0, 100), (2, 7)]:  # 5: hot subtries are dealt into units
        fps = _clouds(rnd, 40)
        df = spark.createDataFrame([(fp - (1 << 64) if fp >> 63 else fp,) for fp in fps], "fp long")
        got = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in components(simhash.links(df, bits, rows)).collect()}
        roots = _brute_components(fps, bits)
        ours, theirs = {}, {}
        for i, fp in enumerate(fps):
            ours.setdefault(got.get(fp, fp), set()).add(fp)
            theirs.setdefault(roots[i], set()).add(fp)
        assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (7, 3), (200, 201), (None, 5)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(path).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 200: 200, 201: 200}
    assert components(path.where("false")).count() == 0


def test_near_duplicates_and_kept_rows(spark):
    from conftest import SF_SMALL

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    fps = [_brute_fingerprint(t) for _, t in docs]
    roots = _brute_components(fps)
    least = {}
    for (doc, _), root in zip(docs, roots, strict=True):
        least[root] = min(doc, least.get(root, doc))
    from feedmatch.llm.queries import op4_simhash_trie

    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op4_simhash_trie(spark, SF_SMALL).collect()}
    assert got == {doc: (f"{fp:016x}", least[root]) for (doc, _), fp, root in zip(docs, fps, roots, strict=True)}


def test_keep_first_edge_cases(spark):
    rows = [(4, "a b c d e f", "k"), (2, "a b c d e f", "l"), (2, "a b c d e f", "l"), (7, None, "m"), (6, "", None), (9, "other words than those are here", "n"),
            (None, "nameless row of its own words", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in simhash.keep_first(docs).collect()) == [(False, 2), (False, 6), (False, 9), (True, None)]
    assert simhash.keep_first(docs).columns == docs.columns
    assert simhash.keep_first(docs.where("false")).count() == 0
    assert simhash.near_duplicates(docs).count() == len(rows)


def test_keep_first_chooses_rows_not_ids(spark):
    rows = [(None, "first row without a name of its own"), (None, "second text that nobody gave any name"), (None, "second text that nobody gave any name"),
            (3, "words that two of the rows share here"), (5, "words that two of the rows share here"), (5, "quite other words under the same number")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, id string")
    want = [rows[0], rows[1], rows[3], rows[5]]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in simhash.keep_first(docs).collect()) == sorted((d or 0, t) for d, t in want)


def _brute_hits(text, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    w, hit, found = words(text), set(), set()
    for item, t in items:
        p = words(t)
        m = min(10, len(p))
        for k in range(len(p) - m + 1) if m else ():
            for i in range(len(w) - m + 1):
                if w[i:i + m] == p[k:k + m]:
                    hit |= set(range(i, i + m))
                    found.add(item)
    return len(w), len(hit), sorted(found)


def test_wu_manber_equals_brute_force(spark):
    rnd = np.random.default_rng(4)
    vocabulary = ["a", "b", "The", "naïve", "x1", "日本"]

    def text(n):
        return " ".join(rnd.choice(vocabulary, n)).replace("b a", "b-a") + "."

    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 4, 9, 10, 11, 12, 25, 40])] + [(90, ""), (91, None), (None, "a b"), (3, "a b The x1 x1 a b a")]
    docs = [(i, text(int(rnd.integers(0, 60)))) for i in range(40)] + [(50, None), (51, ""), (52, items[8][1] + " " + items[9][1]), (0, "a")]
    docs += [(60 + k, t + " and more") for k, (_, t) in enumerate(items) if t]
    df = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, row int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = [(i, t) for i, t in items if i is not None]
    want = sorted((d, *_brute_hits(t, whole)) for d, t in docs)
    for size in (1 << 20, 60):  # one block of items, many blocks
        got = decontam.hits(df, benchmark, block_bytes=size).select("row.doc_id", "n_words", decontam.n_hit(), "items").collect()
        assert sorted(map(tuple, got)) == want
    assert decontam.clean(df, benchmark).columns == df.columns
    assert {r[0] for r in decontam.clean(df, benchmark).collect()} == {d for d, _, n, _ in want if not n}
    assert decontam.clean(df, benchmark.where("false")).count() == len(docs)
    assert decontam.hits(df.where("false"), benchmark).count() == 0


def test_nameless_items_are_searched(spark):
    items = [(None, "passage without a name"), (None, "another such passage"), (4, "a named passage"), (None, None), (None, "")]
    texts = ["it holds a passage without a name here", "another such passage and a named passage", "nothing of them", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 30):
        got = decontam.hits(df, benchmark, block_bytes=size, nameless=True).select("row.doc_id", decontam.n_hit(), "items").collect()
        assert sorted(map(tuple, got)) == [(0, 4, [None]), (1, 6, [4, None]), (2, 0, []), (3, 0, [])]
    assert {r[0] for r in decontam.clean(df, benchmark, nameless=True).collect()} == {2, 3}


def test_one_block_of_items_is_held_at_a_time(spark):
    df = spark.createDataFrame([(0, "one two three")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, f"item {i} of many") for i in range(4)], "item_id long, text string")
    plan = decontam.hits(df, benchmark, block_bytes=60)._jdf.queryExecution().toString()
    assert plan.split("Physical Plan")[1].count("MapInArrow") == 1


def test_tables_of_a_block_are_small_and_confirm_words(spark):
    rnd = np.random.default_rng(8)
    words = [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(rnd.choice(words, 400))) for i in range(400)] + [(1000, "one"), (1001, "one two"), (1002, "one")]
    machines = decontam.searchers(items)
    patterns = sum(len(m.items) for m in machines)
    assert sum(m.nbytes() - len(m.shift) for m in machines) < 60 * patterns and patterns > 150_000 and max(len(m.shift) for m in machines) <= 1 << 26
    text = items[7][1].split()[100:112] + ["one", "two", "x"]
    found = {(begin, machine.length): sorted(items[i][0] for i in of) for machine in machines for begin, of in machine.search([w.encode() for w in text])}
    assert found == {(0, 10): [7], (1, 10): [7], (2, 10): [7], (12, 1): [1000, 1002], (12, 2): [1001]}


def test_colliding_places_are_compared_with_the_text():
    machine = decontam.searchers([(0, " ".join(f"a{i}" for i in range(30)))])[0]
    other = [f"b{i}".encode() for i in range(2000)]
    machine.shift = bytes(len(machine.shift))  # every place looks like a suffix
    assert not list(machine.search(other)) and [b for b, _ in machine.search([f"a{i}".encode() for i in range(30)])] == list(range(21))
