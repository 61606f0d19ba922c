import hashlib
import math
from collections import Counter

import pytest

from kappaflow.llm.mixing import mix_sources, mixing_rates


def drawn(seed, doc_id, rate):
    u = int(hashlib.md5(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 16 ** 13
    k, p = 0, math.exp(-rate)
    total = p
    while u >= total and k < 10_000:
        k += 1
        p *= rate / k
        total += p
    return k if rate > 0 else 0


def test_counts_match_the_inverse_distribution(odd_docs):
    weights = {"src0": 0.7, "src1": 0.2, "gone": 5.0}
    rates = mixing_rates(odd_docs, weights, other_weight=0.1)
    assert "gone" not in rates and set(rates) == {"src0", "src1", None}
    sizes = Counter(r["source"] if r["source"] in weights else None for r in odd_docs.collect())
    assert sum(rates[s] * sizes[s] for s in rates) == pytest.approx(sum(sizes.values()))
    got = Counter((r["doc_id"], r["text"]) for r in mix_sources(odd_docs, weights, other_weight=0.1).collect())
    want = Counter()
    for r in odd_docs.collect():
        want[r["doc_id"], r["text"]] += drawn(42, r["doc_id"], rates.get(r["source"], rates[None]))
    assert got == +want


def test_high_rates_and_target_shares(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "if(id < 10, 'small', 'big') AS source")
    out = mix_sources(df, {"small": 0.5, "big": 0.5})
    by = dict(out.groupBy("source").count().collect())
    assert by["small"] == pytest.approx(2000, rel=0.1) and by["big"] == pytest.approx(2000, rel=0.1)
    for r in out.where("source = 'small'").groupBy("doc_id").count().collect():
        assert r["count"] == drawn(42, r["doc_id"], 200.0)
    # Copies are dealt out over all partitions, not left beside each other.
    order = [r["doc_id"] for r in out.collect()]
    assert sum(a == b for a, b in zip(order, order[1:])) < len(order) / 20


def test_nothing_to_draw(odd_docs, no_docs):
    assert mix_sources(no_docs, {"src0": 1.0}).count() == 0
    assert mix_sources(odd_docs, {}, other_weight=0.0).count() == 0
    assert mix_sources(odd_docs, {"src0": 0.0}, other_weight=0.0).count() == 0
    with pytest.raises(ValueError):
        mix_sources(odd_docs, {"src0": -1.0})


def test_columns(odd_docs):
    assert mix_sources(odd_docs, {"src0": 1.0}, other_weight=1.0, numbered=False).schema.names == odd_docs.schema.names
    again = mix_sources(odd_docs.withColumnRenamed("kept", "copy_no"), {"src0": 1.0}, other_weight=1.0)
    assert again.schema.names[-2:] == ["_copy_no", "n_copies"]


def test_equal_rows_part(spark):
    """Twenty thousand equal rows of one id are dealt out over all partitions."""
    df = spark.range(0, 20_000, 1, 6).selectExpr("7L AS doc_id", "'s' AS source", "'t' AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = mix_sources(df, {"s": 1.0}, epochs=2.0)
        per = [len(p) for p in out.rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    each = drawn(42, 7, 2.0)
    assert sum(per) == 20_000 * each and min(per) > 0.5 * sum(per) / len(per)
    assert len(per) == int(spark.conf.get("spark.sql.shuffle.partitions"))
