import random
import re
from collections import Counter

import numpy as np
import xxhash

from kappaflow.llm import simhash as S
from kappaflow.llm.components import connected_components
from kappaflow.llm.queries import QUERIES


def brute_print(text, shingle=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints, radius):
    """Class (least id reachable) of each (id, print) row."""
    kinds = sorted(set(prints))
    parent = {k: k for k in kinds}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(kinds):
        for b in kinds[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    return {k: root(k) for k in kinds}


def expected(rows, radius=2, shingle=3):
    prints = [brute_print(t, shingle) for _, t in rows]
    root = brute_classes(prints, radius)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    return Counter((i, f"{p:016x}", least.get(root[p])) for (i, _), p in zip(rows, prints))


def got(df):
    return Counter((r["doc_id"], f"{r['fp'] % 2 ** 64:016x}", r["class"]) for r in df.collect())


def test_fingerprints_in_runs(monkeypatch):
    rng = random.Random(3)
    texts = ["", " ", "One", "a b", "É A b C", " ".join(rng.choice("abcdefg") * rng.randint(1, 9) for _ in range(4000))]
    want = [brute_print(t) for t in texts]
    assert [S.fingerprint(t) for t in texts] == want
    monkeypatch.setattr(S, "RUN_WORDS", 2)
    assert [S.fingerprint(t) for t in texts] == want


def test_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert got(S.near_classes(odd_docs)) == expected(rows)
    assert S.near_classes(no_docs).count() == 0 and S.drop_near_copies(no_docs).count() == 0


def links_of(fps, radius, spark, **how):
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    parts = {r["node"]: r["component"] for r in connected_components(S.near_links(df, radius=radius, **how)).collect()}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    return {f: parts.get(s, s) for f, s in zip(fps, signed)}


def same_classes(found, want):
    pairs = lambda d: {frozenset(k for k in d if d[k] == v) for v in d.values()}
    return pairs(found) == pairs(want)


def test_links_match_brute_force_also_in_split_buckets(spark):
    """Clouds around centres, with chains; tiny buckets force the deeper blocks."""
    rng = random.Random(4)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(40):
            value = centre
            for _ in range(rng.randint(0, 5)):
                value ^= 1 << rng.randrange(64)
            fps.add(value)
    fps |= {rng.getrandbits(64) for _ in range(200)} | {0, 2 ** 64 - 1}
    fps = sorted(fps)
    for radius in (1, 2, 3):
        want = brute_classes(fps, radius)
        assert same_classes(links_of(fps, radius, spark), want)
        assert same_classes(links_of(fps, radius, spark, bucket=4), want)


def test_bit_sliced_pairs_are_all_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2 ** 63, 3, dtype=np.uint64)
    fps = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 90).astype(np.uint64)) ^ (
        np.uint64(1) << rng.integers(0, 64, 90).astype(np.uint64)) for b in base]))
    rng.shuffle(fps)
    size = np.array([130, 5, len(fps) - 135])
    first = np.array([0, 130, 135])
    for tile in (50, 65536):
        monkeypatch.setattr(S, "TILE", tile)
        for radius in (1, 2, 3, 4):
            found = {frozenset(p) for a, b in S.near_lanes(fps, first, size, radius) for p in zip(a.tolist(), b.tolist())}
            bucket = np.repeat(np.arange(3), size)
            want = {frozenset((i, j)) for i in range(len(fps)) for j in range(i) if bucket[i] == bucket[j]
                    and int(fps[i] ^ fps[j]).bit_count() <= radius}
            assert found == want


def test_long_chains_end_in_one_component(spark):
    n = 700
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5000, 5001), (3, 3)], "u long, v long")
    out = connected_components(df)
    assert out.where("component = 0").count() == n + 1 and out.where("component = 5000").count() == 2


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got_ = Counter(tuple(r) for r in QUERIES["op6_simhash"](spark, sf).select("doc_id", "fingerprint", "component_id").collect())
    assert got_ == expected(rows)


def test_one_document_of_each_class_stays(odd_docs):
    docs = odd_docs.where("doc_id is not null")
    classes = {r["class"] for r in S.near_classes(docs).collect()}
    kept = S.drop_near_copies(docs)
    assert kept.schema.names == odd_docs.schema.names and {r["doc_id"] for r in kept.collect()} == classes


def test_an_id_that_repeats_with_another_text(spark):
    """The row of id 5 that belongs to the class of id 2 goes, the other one stays; null ids never name a class."""
    a, b, c = "one two three four five", "six seven eight nine ten eleven", "twelve thirteen fourteen fifteen"
    rows = [(5, a), (5, b), (2, b), (None, b), (None, c), (7, a), (7, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in S.drop_near_copies(docs).collect()))) == sorted(map(str, [(5, a), (2, b), (None, c)]))


def test_one_row_of_each_class_stays(spark):
    """Null ids, rows that share id and class, wholly equal rows: whatever repeats, one row of a class stays."""
    a, b = "one two three four five", "six seven eight nine ten eleven"
    rows = [(None, a, "x"), (None, a, "x"), (None, a.upper(), "y"), (5, b, "x"), (5, b.title(), "x"), (5, b, "w"), (5, b, "w"), (None, b, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [tuple(r) for r in S.drop_near_copies(docs).collect()]
    assert sorted((r[0] is None, r[1].lower()) for r in kept) == [(False, b), (True, a)] and set(kept) <= set(rows)
    again = [tuple(r) for r in S.drop_near_copies(docs.repartition(5)).collect()]
    assert sorted(map(str, again)) == sorted(map(str, kept))
