import random
import re

import numpy as np

from quadrille.llm.likeness import BUCKETS, PARITY, Likeness, Sets, _across, alike_components, keep_one_of_each


def brute_alike(docs, percent=80):
    """id -> the smallest id that links of a Jaccard similarity of the bound or more reach, by all pairs."""
    sets = {}
    for i, t in docs.items():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall("[^\x20\x09-\x0d]+", low)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def near(rng, words, share):
    """A copy whose sets differ: words replaced, cut off and put in."""
    out = list(words)
    for _ in range(int(len(out) * share)):
        k = rng.randrange(len(out))
        out[k : k + rng.randrange(2)] = [f"n{rng.randrange(10**6)}"]
    return out[: len(out) - rng.randrange(1 + len(out) // 12)]


def test_groups_equal_brute_force_whatever_the_similarity(spark):
    rng, docs = random.Random(11), []
    shared = [f"s{k}" for k in range(60)]  # a passage that a third of all hold
    for _ in range(40):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 200))]
        words += shared if rng.random() < 0.35 else []
        docs += [words] + [near(rng, words, rng.choice([0, 0.01, 0.02, 0.04, 0.05, 0.1])) for _ in range(rng.randrange(7))]
    base = [f"g{k}" for k in range(150)]
    docs += [near(rng, base, 0.02) for _ in range(80)]  # one large group
    chain = [f"c{k}" for k in range(120)]
    docs += [chain[k : k + 60] for k in range(0, 60, 5)]  # links from one to the next only
    rng.shuffle(docs)
    rows = [(i, " ".join(w).upper() if i % 4 == 0 else "\n".join(w)) for i, w in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in alike_components(df).collect()}
    want = brute_alike(dict(rows))
    assert got == want and len(set(want.values())) < len(want) - 60
    assert {r.doc_id for r in keep_one_of_each(df).collect()} == set(want.values())
    lower = {r.doc_id: r.component_id for r in alike_components(df, rule=Likeness(percent=50)).collect()}
    assert lower == brute_alike(dict(rows), 50)


def test_parities_never_differ_in_more_than_the_sets():
    rng = random.Random(4)
    sets = [np.array(rng.sample(range(3000), rng.randrange(1, 900)), np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(60)]
    first = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    made = Sets(np.concatenate(sets), first, np.zeros(BUCKETS, np.int64))
    odd = np.array(made.parities().to_pylist(), np.int64).view(np.uint64)
    for i in range(60):
        for j in range(i):
            assert int(np.bitwise_count(odd[i] ^ odd[j]).sum()) <= len(set(sets[i].tolist()) ^ set(sets[j].tolist()))


def test_pairs_meet_at_the_first_shingle_they_share(spark):
    rng, rule, sets = random.Random(6), Likeness(), []
    for _ in range(12):
        base = rng.sample(range(2000), 120)
        sets += [sorted({k if rng.random() > share else rng.randrange(2000) for k in base}) for share in (0, 0.05, 0.1, 0.2, 0.5)]
    prefixes = [s[: len(s) - rule.least_common(len(s)) + 1] for s in sets]  # the order is that of the numbers
    marked = spark.createDataFrame([(i, i, len(sets[i]), n, k) for i, p in enumerate(prefixes) for n, k in enumerate(p)], "node long, label long, n int, pos int, key long")
    parity = spark.range(len(sets)).selectExpr("id AS node", *(f"0L AS odd{i}" for i in range(PARITY)))
    got = [tuple(r) for r in _across(marked, marked.select("key").distinct(), parity, rule).collect()]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len({*sets[i]} & {*sets[j]}) >= 80 * len({*sets[i]} | {*sets[j]})}
    shared = sum(len({*prefixes[i]} & {*prefixes[j]}) for j in range(len(sets)) for i in range(j))
    assert len(want) > 12 and want <= set(got) and len(got) < shared / 4 and len(got) < 2 * len(set(got))


def test_odd_rows(odd):
    got = {(r.doc_id, r.component_id) for r in alike_components(odd).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (6, 6), (7, 6), (None, None)} <= got
    kept = keep_one_of_each(odd)
    rows = kept.collect()
    assert kept.schema == odd.schema and sorted(r.doc_id or 0 for r in rows) == [0, 1, 4, 5, 5, 6, 8, 9, 10]
    assert alike_components(odd.limit(0)).count() == 0
