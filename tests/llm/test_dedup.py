import hashlib
import random
import re

import numpy as np
import pytest

from quadrille.llm.dedup import bucket_search, cut_repeats, index_search, repeated_bytes, repeated_words
from quadrille.llm.windows import Windows
from tests.llm.conftest import ODD

WORD = "[^\x20\x09-\x0d]+"


def brute(docs, split, length):
    """(id, text) rows -> the removed places of each distinct row, judged on the input."""
    seen, gone = {}, {}
    for key in sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0)):
        items = split(key[1] or "")
        held = set()
        for i in range(len(items) - length + 1):
            window = tuple(items[i : i + length]) if isinstance(items, list) else items[i : i + length]
            if window in seen:
                held.update(range(i, i + length))
            else:
                seen[window] = key
        gone[key] = (items, held)
    return gone


def brute_bytes(docs):
    out = []
    gone = brute(docs, lambda t: t.encode(), 100)
    for d in docs:
        b, held = gone[d]
        spans = sum(1 for i in held if i - 1 not in held)
        out.append((d[0], len(b), len(held), spans, hashlib.sha256(bytes(x for i, x in enumerate(b) if i not in held)).hexdigest()))
    return out


def brute_words(docs):
    out = []
    gone = brute(docs, lambda t: re.findall(WORD, t), 20)
    for d in docs:
        w, held = gone[d]
        out.append((d[0], len(w), len(held), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in held).encode()).hexdigest()))
    return out


key = lambda r: (r[0] is None, *(x or 0 if i == 0 else x for i, x in enumerate(r)))


@pytest.mark.parametrize("operator,reference", [(repeated_bytes, brute_bytes), (repeated_words, brute_words)])
def test_equal_brute_force_on_documents_and_odd_rows(spark, documents, odd, operator, reference):
    docs = [tuple(d) for d in documents]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, operator(df).collect()), key=key) == sorted(reference(docs), key=key)
    assert sorted(map(tuple, operator(odd).collect()), key=key) == sorted(reference(ODD), key=key)
    assert operator(odd.limit(0)).count() == 0


@pytest.mark.parametrize("search", [bucket_search, index_search])
def test_searches_find_the_same_windows_as_counting(search):
    rng = random.Random(4)
    for _ in range(60):
        n, k = rng.choice([5, 7, 12]), rng.choice([2, 3, 20])
        passages = [[rng.randrange(1, k + 1) for _ in range(n - 1 + rng.randrange(1, 20))] for _ in range(rng.randrange(1, 8))]
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in passages])))
        windows = [tuple(p[i : i + n]) for p in passages for i in range(len(p) - n + 1)]
        got = search(np.array(sum(passages, []), np.uint8), offsets, np.array([len(p) - n + 1 for p in passages]), n)
        named = {}
        for window, g in zip(windows, got):
            assert (g >= 0) == (windows.count(window) > 1)
            assert g < 0 or named.setdefault(window, g) == g
        assert len(set(named.values())) == len(named)


def test_cut_keeps_layout_and_columns(spark):
    shared = " ".join(f"s{i}" for i in range(30))
    rows = [(1, f"first\n{shared}\nend", "x", 3), (2, f"other\n\n  start {shared}\n tail", "y", 5), (3, shared, "z", 7), (4, None, "w", 0), (5, "short", "v", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, n_chars long")
    got = {r.doc_id: r for r in cut_repeats(df).collect()}
    assert cut_repeats(df).schema == df.schema and set(got) == {1, 2, 4, 5}
    assert got[1].text == rows[0][1] and got[2].text == "other\n\n  start tail" and got[2].n_chars == len(got[2].text)
    assert got[4].text is None and got[5].text == "short"


def test_other_lengths(spark):
    docs = [(1, "abcdefghij"), (2, "xxcdefghyy"), (3, "abcabcabcabc")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in repeated_bytes(df, w=Windows("bytes", 6, 3)).collect()}
    assert got == {1: 0, 2: 6, 3: 9}
