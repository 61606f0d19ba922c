import hashlib
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from kappaflow.llm import quality as Q
from kappaflow.llm.mixing import mixing_rates
from kappaflow.llm.queries import MIX_SEED, OTHER_WEIGHT, SOURCE_WEIGHTS, TOKENIZER

from .test_mixing import drawn
from .test_simhash import brute_classes, brute_print

SF = "/root/testdata/sf0.001"


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    field = Q.train_field(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = Q.judge([r["text"] for r in rows], field)[3]
    rows = [r for r, k in zip(rows, kept) if k]
    last = {r["text"]: max(x["doc_id"] for x in rows if x["text"] == r["text"]) for r in rows}
    rows = [r for r in rows if last[r["text"]] == r["doc_id"]]
    prints = {r["doc_id"]: brute_print(r["text"]) for r in rows}
    root = brute_classes(list(prints.values()), 2)
    least = {}
    for i, p in prints.items():
        least[root[p]] = min(i, least.get(root[p], i))
    rows = [r for r in rows if least[root[prints[r["doc_id"]]]] == r["doc_id"]]
    rates = mixing_rates(spark.createDataFrame([(r["source"],) for r in rows], "source string"), SOURCE_WEIGHTS, other_weight=OTHER_WEIGHT)
    tok = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    want = Counter()
    for r in rows:
        n = drawn(MIX_SEED, r["doc_id"], rates[r["source"]])
        if n:
            want[r["doc_id"], r["text"], sha(tok.encode(r["text"], add_special_tokens=False).ids)] = n
    got = Counter((r["doc_id"], r["text"], sha(r["ids"])) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and len(got) > 50


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema.names == docs.schema.names, name
        assert stage(spark, empty, SF).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SF).count() == 0


def test_a_named_run_is_resumed(spark, tmp_path, monkeypatch):
    """Stages that were completed for the same documents are read; other documents are computed anew."""
    import uuid

    from kappaflow.plans.model import clear_run
    name = f"t-{uuid.uuid4().hex[:8]}"
    calls = []
    stages = [(n, lambda s, d, sf, n=n: (calls.append(n), d)[1]) for n, _ in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    first = corpus_pipeline.run(spark, SF, name=name).count()
    assert calls == [n for n, _ in stages]
    assert corpus_pipeline.run(spark, SF, name=name).count() == first
    assert calls[len(stages):] == [stages[-1][0]]
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(20).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path), name=name).count() == 20
    assert clear_run(spark, name)
