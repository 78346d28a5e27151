import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from quadrille.llm.ngrams import digest, discounts, score_texts
from tests.llm.conftest import ODD

WORD = "[^\x20\x09-\x0d]+"


def brute(docs):
    def tokens(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return [*re.findall(WORD, low), None]

    held = {i for i, _ in docs if zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2}
    words, pairs, context = Counter(), Counter(), Counter()
    for i, t in docs:
        if i not in held:
            w = tokens(t)
            words.update(w)
            pairs.update(zip(["<s>", *w], w))
            context.update(["<s>", *w[:-1]])
    n, v = sum(words.values()), len(words)
    after, follow = Counter(), defaultdict(Counter)
    for (a, b), c in pairs.items():
        after[b] += 1
        follow[a][min(c, 3)] += 1
    cc, ca = Counter(pairs.values()), Counter(after.values())
    d2, d1 = discounts(*(cc[i] for i in (1, 2, 3, 4))), discounts(*(ca[i] for i in (1, 2, 3, 4)))
    total = len(pairs)
    left = sum(d1[min(c, 3)] for c in after.values()) / total if total else 1.0

    def word(b):
        return max(after[b] - d1[min(after[b], 3)], 0) / max(1, total) + left / (v + 1)

    def pair(a, b):
        if not context[a]:
            return word(b)
        c = pairs[a, b]
        return max(c - d2[min(c, 3)], 0) / context[a] + sum(d2[k] * m for k, m in follow[a].items()) / context[a] * word(b)

    for i, t in docs:
        w = tokens(t)
        base = sum(math.log10((words[x] + 1) / (n + v + 1)) for x in w)
        yield i, i in held, len(w), sum(words[x] > 0 for x in w), n, base, sum(math.log10(pair(a, b)) for a, b in zip(["<s>", *w], w))


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9), (a, b)


def test_scores_equal_brute_force(spark, documents, tmp_path):
    docs = [tuple(d) for d in documents]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "d"))
    got = score_texts(spark.read.parquet(str(tmp_path / "d"))).collect()
    want = list(brute(docs))
    same(got, want)
    out = [r for r in want if r[1]]
    assert sum(r[6] for r in out) > sum(r[5] for r in out)  # held-out texts: better than the base


def test_odd_rows(odd):
    same(score_texts(odd).collect(), list(brute(ODD)))
    assert score_texts(odd.limit(0)).count() == 0


def test_shares_of_a_context_add_up_to_one(spark):
    docs = [(i, f"a b{i % 5} c a b{i % 3}") for i in range(40)]
    words = ["a", "c", "unknown", *(f"b{i}" for i in range(5))]
    probe = [(1000 + i, f"a {w}") for i, w in enumerate(words)]
    probe = [(i, t) for i, t in probe]
    same(score_texts(spark.createDataFrame(docs + probe, "doc_id long, text string")).collect(), list(brute(docs + probe)))


def test_other_texts_have_another_digest():
    v, w = np.array([3, 4, 5], np.uint64), np.array([7, 8, 9], np.uint64)
    assert digest(v, w) == digest(v.copy(), w.copy())
    assert digest(v, w) != digest(v, w[::-1]) and digest(v, w) != digest(v[::-1], w[::-1])
    assert digest(v, w) != digest(v, np.array([7, 8, 10], np.uint64)) and digest(v[:0], w[:0]) == 0
