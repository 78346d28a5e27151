import zlib
from collections import defaultdict

from quadrille.llm.shards import kd_shards
from tests.llm.conftest import ODD, SF


def gapless(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_law_slots_and_digests(spark, documents):
    texts = dict(documents)
    rows = kd_shards(spark.createDataFrame(documents, "doc_id long, text string"), lang_col=None, shards=8).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    gapless(rows)
    held, where = defaultdict(int), defaultdict(set)
    for r in rows:
        b = (texts[r.doc_id] or "").encode()
        assert r.size == len(b) + 8 and r.text_crc32 == zlib.crc32(b) and r.law == "bytes" and r.grown_shard is None
        held[r.shard] += r.size
        where[b].add(r.shard)
    longest = max(r.size for r in rows)
    assert set(held) == set(range(8)) and max(held.values()) - min(held.values()) <= 3 * longest
    assert sum(len(s) > 1 for s in where.values()) <= 7  # at most one text per cut


def test_production_parameters_over_whole_rows(spark):
    """24 shards over all dimensions: near equal sizes, equal texts together, gapless slots."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in df.select("doc_id", "text").collect()}
    rows = kd_shards(df).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    gapless(rows)
    held, where = defaultdict(int), defaultdict(set)
    for r in rows:
        held[r.shard] += r.size
        where[texts[r.doc_id]].add(r.shard)
    mean = sum(held.values()) / 24
    assert set(held) == set(range(24)) and max(held.values()) - min(held.values()) <= max(0.02 * mean, 2 * max(r.size for r in rows))
    assert sum(len(s) > 1 for s in where.values()) <= 23


def test_the_widest_dimension_is_cut(spark):
    """Languages at both ends of the alphabet, sizes alike: the first cut parts the languages; sizes apart: shards are ranges of sizes."""
    two = [(i, f"{i % 97:02d} word word {i:04d}", "aa" if i % 2 else "zz") for i in range(960)]
    side = defaultdict(set)
    for r in kd_shards(spark.createDataFrame(two, "doc_id long, text string, lang string")).collect():
        side[r.shard // 12].add(two[r.doc_id][2])
    assert all(len(s) == 1 for s in side.values()) and len(side) == 2
    sizes = [(i, "ab " * (i + 20), "en") for i in range(400)]
    spans = defaultdict(list)
    for r in kd_shards(spark.createDataFrame(sizes, "doc_id long, text string, lang string"), shards=4).collect():
        spans[r.shard].append(r.size)
    spans = sorted((min(s), max(s)) for s in spans.values())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_a_group_larger_than_a_shard_is_cut_by_ids(spark):
    docs = [(i, "same text " * 5) for i in range(600)] + [(i, f"text {i} " * (i % 7)) for i in range(600, 1200)]
    rows = kd_shards(spark.createDataFrame(docs, "doc_id long, text string"), lang_col=None).collect()
    held = defaultdict(int)
    for r in rows:
        held[r.shard] += r.size
    gapless(rows)
    assert set(held) == set(range(24)) and max(held.values()) <= 1.25 * min(held.values())


def test_odd_rows(odd):
    rows = kd_shards(odd, lang_col="fp").collect()
    assert len(rows) == len(ODD) and all(0 <= r.shard < 24 for r in rows)
    gapless(rows)
    assert kd_shards(odd.limit(0), lang_col=None).count() == 0
