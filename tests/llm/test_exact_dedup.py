import hashlib
from collections import Counter, defaultdict

from kappaflow.llm.exact_dedup import _directory, bucket_of, build_index, drop_exact_copies, exact_duplicates, resolve, split_directory


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    out, stayed = [], set()
    for text, ids in groups.items():
        some = [i for i in ids if i is not None]
        keep = max(some) if some else None
        for i in sorted(ids, key=str):
            kept = i == keep and text not in stayed
            if kept:
                stayed.add(text)
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


def got(df):
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect())


def test_odd_rows(odd_docs):
    assert got(exact_duplicates(odd_docs)) == brute(odd_docs.collect())


def test_few_key_bits_chain_and_compare_bytes(odd_docs):
    """Three key bits and tiny buckets: overfull buckets split to the depth limit, then chain."""
    found = exact_duplicates(odd_docs, key_bits=3, capacity=1, max_depth=3)
    assert got(found) == brute(odd_docs.collect())
    assert max(r["chain_pos"] for r in found.collect()) > 1
    kept = drop_exact_copies(odd_docs, key_bits=3, capacity=1, max_depth=3).collect()
    assert Counter(r["text"] or "" for r in kept) == Counter({r["text"] or "" for r in odd_docs.collect()})


def test_rows_that_stay_keep_their_columns(odd_docs):
    rows = [tuple(r) for r in odd_docs.collect()]
    kept = drop_exact_copies(odd_docs)
    assert kept.schema.names == odd_docs.schema.names
    stay = [tuple(r) for r in kept.collect()]
    assert set(stay) <= set(rows) and len(stay) == len({r[1] or "" for r in rows})
    for r in stay:
        same = [x[0] for x in rows if (x[1] or "") == (r[1] or "") and x[0] is not None]
        assert r[0] == (max(same) if same else None)


def test_wholly_equal_rows(spark):
    df = spark.createDataFrame([(1, "t", "s")] * 5, "doc_id long, text string, source string")
    assert sorted(r["kept"] for r in exact_duplicates(df).collect()) == [False] * 4 + [True]
    assert drop_exact_copies(df).count() == 1


def test_hot_group(spark):
    df = spark.range(30_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', cast(id AS string)) AS text")
    out = exact_duplicates(df, capacity=500)
    assert out.where("kept").count() == 20_001
    assert out.where("group_size > 1").selectExpr("max(group_size)", "count(*)").first() == (10_000, 10_000)
    assert out.select("bucket").distinct().count() > 16


def test_empty(no_docs):
    assert exact_duplicates(no_docs).count() == 0 and drop_exact_copies(no_docs).count() == 0


def test_directory_doubles_only_while_a_bucket_is_overfull():
    assert split_directory({}, 4, 3) == [0]
    assert split_directory({0: 3, 7: 4}, 7, 3) == [0]
    # All keys in slot 0 of 8: the directory doubles to the limit, the other halves stay whole.
    assert split_directory({0: 9}, 4, 3) == [0, 1, 2, 2, 4, 4, 4, 4]
    assert split_directory({0: 3, 4: 3}, 4, 3) == [0, 1]


def test_the_written_entry_decides(odd_docs):
    """Rows take what the index says, and nothing else: a changed entry changes the result."""
    from pyspark.sql import functions as F
    rows, entries = build_index(odd_docs)
    assert entries.where("text is not null").count() == 0
    changed = entries.withColumn("keep_id", F.lit(-5).cast("long")).withColumn("group_size", F.lit(77).cast("long"))
    assert {(r["keep_id"], r["group_size"]) for r in resolve(rows, changed).collect()} == {(-5, 77)}
    some = entries.where("chain_pos = 1 and group_size > 1")
    assert resolve(rows, some).count() < rows.count()


def test_texts_with_equal_digests_are_told_apart(odd_docs):
    """Keys of two bits and digests of one: chains of different texts that share both are resolved by the bytes."""
    import pyspark.sql.functions as F
    digest = lambda text: F.substring(F.sha2(text.cast("binary"), 256), 1, 1)
    found = exact_duplicates(odd_docs, key_bits=2, capacity=1, max_depth=2, digest=digest).collect()
    want = Counter((i, k, n, kept, sha[:1]) for (i, k, n, kept, sha), m in brute(odd_docs.collect()).items() for _ in range(m))
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in found) == want
    assert len({(r["bucket"], r["chain_pos"]) for r in found}) == len({r["text"] or "" for r in odd_docs.collect()})


def test_a_second_tier_splits_what_the_first_cannot(spark):
    """Overfull slots get further bits: buckets hold few keys, and rows of one key one bucket."""
    df = spark.range(4000).selectExpr("id AS doc_id", "cast(id % 3000 AS string) AS text")
    out = exact_duplicates(df, capacity=40, max_depth=4)
    per = [r["n"] for r in out.selectExpr("bucket", "text_sha256").distinct().groupBy("bucket").agg({"*": "count"}).toDF("bucket", "n").collect()]
    assert len(per) > 16 and max(per) <= 40
    assert got(out) == brute(df.collect())
    assert drop_exact_copies(df, capacity=40, max_depth=4).count() == 3000
    keys = spark.createDataFrame([(i << 40,) for i in range(2000)], "key long")  # all in the first slot
    first, further = _directory(keys, "key", 100, 6)
    assert further == {0: 6}
    assert keys.select(bucket_of(keys["key"], (first, further)).alias("b")).distinct().count() == 1  # equal bits: one long chain
