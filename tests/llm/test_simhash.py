import random
import re

import pyarrow as pa
import xxhash

from quadrille.llm.components import stars
from quadrille.llm.simhash import fingerprint_links, fingerprints, simhash_components
from tests.llm.conftest import ODD


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """prints: id -> fingerprint; the smallest id reachable over links of at most 3 bits."""
    ids, parent = sorted(prints), {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_fingerprints_equal_brute_force():
    rng = random.Random(3)
    texts = [t for _, t in ODD] + ["".join(rng.choice(["Ab", "cÉd", "x"]) + rng.choice([" ", "\n", " \t"]) for _ in range(rng.randrange(12))) for _ in range(100)]
    assert fingerprints(pa.array(texts)).tolist() == [brute_fingerprint(t) for t in texts]


def test_components_on_documents(spark, documents):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_components(spark.createDataFrame(documents, "doc_id long, text string")).collect()}
    prints = {i: brute_fingerprint(t) for i, t in documents}
    whole = brute_components(prints)
    assert got == {i: (f"{prints[i]:016x}", whole[i]) for i in prints}


def test_chains_of_links_are_followed(spark):
    rng = random.Random(5)
    prints, bits = [], 0
    for k in range(120):  # a chain of steps of up to three bits, and strangers
        for b in rng.sample(range(64), rng.randrange(1, 4)):
            bits ^= 1 << b
        prints += [bits, rng.getrandbits(64)]
    signed = {x - (1 << 64) if x >> 63 else x for x in prints}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute_components({x: x % (1 << 64) for x in signed})
    for large in (1 << 16, 0):  # 0: every bucket is cut along the pivots
        # 0 links in a task: rounds over all
        root = {r.u: r.v for r in stars(fingerprint_links(df, large=large), in_task=large).collect()}
        assert {x: root.get(x, x) for x in signed} == want


def test_odd_rows(odd):
    got = simhash_components(odd).collect()
    assert len(got) == len(ODD)
    zero = {r.doc_id: r.component_id for r in got if r.fingerprint == "0" * 16}
    assert zero == {1: 1, 2: 1, 3: 1}
    assert simhash_components(odd.limit(0)).count() == 0
