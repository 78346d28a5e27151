import re

from quadrille.llm.quality import Limits, keep_quality, quality_measures
from tests.llm.conftest import ODD

WORD = "[^\x20\x09-\x0d]+"


def brute(text, limits=Limits()):
    text = text or ""
    w = re.findall(WORD, text)

    def cover(m):
        seen, held = {}, set()
        for i in range(len(w) - m + 1):
            seen.setdefault(tuple(w[i : i + m]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                held.update(*(range(i, i + m) for i in at))
        return len(held)

    longest = 0
    while len(s := [tuple(w[i : i + longest + 1]) for i in range(len(w) - longest)]) > len(set(s)):
        longest += 1
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    repeated, spans = cover(limits.window), cover(limits.repeat_words)
    failed = len(w) < limits.least_words or 100 * repeated > limits.window_percent * len(w)
    kept = not failed and 100 * spans <= limits.covered_percent * len(w) and longest <= limits.longest
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeated, failed, kept, spans, longest)


def test_measures_equal_brute_force_on_odd_rows(odd):
    got = sorted(tuple(r) for r in quality_measures(odd).collect() if r.doc_id is not None)
    assert got == sorted((i, *brute(t)) for i, t in ODD if i is not None)


def test_measures_on_documents(spark, documents):
    some = [d for d in documents if len(d[1] or "") < 4000]
    got = {r[0]: tuple(r)[1:] for r in quality_measures(spark.createDataFrame(some, "doc_id long, text string")).collect()}
    assert got == {i: brute(t) for i, t in some}


def test_a_long_repeat_is_rejected_and_other_limits_move_it(spark):
    part = " ".join(f"p{i}" for i in range(110))
    text = part + " " + " ".join(f"q{i}" for i in range(2000)) + " " + part
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert keep_quality(df).count() == 0
    assert keep_quality(df, limits=Limits(longest=110)).count() == 1


def test_keep_returns_every_column_and_takes_an_empty_table(odd):
    kept = keep_quality(odd)
    assert kept.schema == odd.schema
    assert {r.doc_id for r in kept.collect()} == {i for i, t in ODD if brute(t)[6]}
    assert keep_quality(odd.limit(0)).count() == 0
