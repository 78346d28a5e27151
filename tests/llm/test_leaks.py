import random
from collections import defaultdict

import numpy as np

from quadrille.llm.leaks import drop_leaks, find_leaks, randomised_svd
from tests.llm.conftest import SF

VOCABULARY = [f"{a}{b}{c}" for a in "bcdfgl" for b in "aeiou" for c in "mnrst"]


def prose(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def test_verbatim_and_paraphrased_items_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(1)
    items = [(i, prose(rng, rng.randrange(14, 60))) for i in range(30)]
    docs, want = [], set()
    for d in range(200):
        words = prose(rng, rng.randrange(5, 400))
        if d % 4 == 0:
            i, item = items[d % 30]
            item = list(item)
            if d % 8 == 0:  # every ninth word replaced
                item[::9] = prose(rng, len(item[::9]))
            at = rng.randrange(len(words))
            words[at:at] = item
            want.add((d, i))
        docs.append((d, " ".join(words).upper() if d % 5 == 0 else "\n".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(df, bench).collect()}
    assert got == want
    assert {r.doc_id for r in drop_leaks(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def holds(text, item):
    """Whether a text has all words of an item in a row."""
    w, x = (text or "").lower().split(), (item or "").lower().split()
    return len(x) >= 8 and any(w[k : k + len(x)] == x for k in range(len(w) - len(x) + 1))


def test_items_of_the_benchmark_inside_documents(spark, documents):
    """Brute force: an item is in a text whose words hold all of the item's, in a row."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text.lower().split()) for r in bench.collect()]
    starts = defaultdict(list)
    for i, w in items:
        starts[tuple(w[:4])].append((i, w))
    want = set()
    for d, t in documents:
        w = (t or "").lower().split()
        for k in range(len(w)):
            want |= {(d, i) for i, x in starts.get(tuple(w[k : k + 4]), ()) if w[k : k + len(x)] == x}
    got = {(r.doc_id, r.item_id): r.overlap for r in find_leaks(spark.createDataFrame(documents, "doc_id long, text string"), bench).collect()}
    assert want <= set(got) and all(o >= 0.55 for o in got.values())


def test_odd_rows_and_empty_tables(spark, odd):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "w1 w2"), (4, " ".join(f"w{i}" for i in range(200, 230))), (4, " ".join(f"w{i}" for i in range(200, 230)))], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in find_leaks(odd, bench).collect()]
    assert sorted(got) == [(6, 4), (6, 4), (7, 4), (7, 4)]
    assert find_leaks(odd.limit(0), bench).count() == 0 and find_leaks(odd, bench.limit(0)).count() == 0
    kept = drop_leaks(odd, bench)
    assert kept.schema == odd.schema and {r.doc_id for r in kept.collect()} & {6, 7} == set()
    assert kept.count() == odd.count() - 2


def test_svd_spans_the_rows(spark):
    rng = np.random.default_rng(3)
    dense = rng.standard_normal((12, 5)) @ rng.standard_normal((5, 40))
    rows = spark.createDataFrame([(list(range(40)), x.tolist()) for x in dense], "at array<int>, x array<double>").repartition(3)
    basis = randomised_svd(rows, 40, 5)
    assert np.allclose(dense @ basis @ basis.T, dense, atol=1e-8)


def test_a_thousand_items(spark):
    """Brute force: verbatim containment; every block's space holds all its items."""
    rng = random.Random(9)
    items = [(i, [f"w{rng.randrange(6000)}" for _ in range(rng.randrange(15, 60))]) for i in range(1000)]
    docs, want = [], set()
    for d in range(120):
        words = [f"w{rng.randrange(6000)}" for _ in range(rng.randrange(100, 600))]
        i, item = items[rng.randrange(len(items))]
        at = rng.randrange(len(words))
        words[at:at] = item
        docs.append((d, " ".join(words)))
        want.add((d, i))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert want <= got


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b):
            last, row[k + 1] = row[k + 1], last + 1 if x == y else max(row[k], row[k + 1])
    return row[-1]


def test_what_the_decision_accepts_is_a_candidate(spark):
    """An item in a third of the rows, paraphrases with up to 45 % of words replaced, items of several hundred words."""
    rng = random.Random(17)
    frequent = [f"f{k}" for k in range(30)]
    some = lambda n: [rng.choice(frequent) if rng.random() < 0.5 else f"w{rng.randrange(4000)}" for _ in range(n)]
    items = [(i, some(rng.randrange(15, 60))) for i in range(60)] + [(60, some(300)), (61, some(500)), (62, some(700))]
    docs, want = [], set()
    for d in range(300):
        words = some(rng.randrange(60, 500))
        i, item = items[0] if d % 3 == 0 else items[rng.randrange(1, len(items))]
        n, answer = len(item), 3 * len(item) // 4
        copy = list(item)
        for k in rng.sample(range(n), int(n * rng.choice([0, 0, 0.3, 0.4, 0.45]))):
            copy[k] = f"other{rng.randrange(10**6)}"
        share, part = common(item, copy) / n, common(item[answer:], copy) / (n - answer)
        if share >= 0.8 or share >= 0.55 and part >= 0.6:
            want.add((d, i))
        at = rng.randrange(len(words))
        words[at:at] = copy
        docs.append((d, " ".join(words)))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert len(want) > 200 and not want - got
    # what the copy's surroundings add to it
    assert all(common(items[i][1], docs[d][1].split()) >= 0.55 * len(items[i][1]) for d, i in got - want)
