import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline as P  # noqa: E402

from fenwatch.llm import decontaminate as D  # noqa: E402
from fenwatch.llm import mixing as M  # noqa: E402
from fenwatch.llm import quality as Q  # noqa: E402
from fenwatch.llm.common import written  # noqa: E402


def test_stages_in_turn(spark):
    """Each stage on what its predecessor kept: planted copies, passages and rejected documents are gone, all else stays."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for _, stage in P.STAGES[:-1]:
        out = written(stage(spark, kept[-1], sf), "test")
        assert out.columns == columns
        kept.append(out)
    counts = [k.count() for k in kept]
    model = Q.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert counts[1] == Q.score(docs, model).where("predicted = 1").count()
    texts = [r["text"] for r in kept[2].collect()]
    assert len(texts) == len(set(texts)) == counts[2] < counts[1]
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert D.report(kept[2], items).where("contaminated").count() > 0
    assert D.report(kept[3], items).where("contaminated").count() == 0
    assert counts[3] >= 0.95 * counts[2]
    size = lambda df: df.select(M.word_count(df["text"]).alias("n")).agg({"n": "sum"}).first()[0]
    assert 0.9 * 1.5 * size(kept[3]) <= size(kept[4]) <= 1.5 * size(kept[3]) * 1.05
    last = P.STAGES[-1][1](spark, kept[4], sf).collect()
    assert len(last) == counts[4]
    assert sorted(r["start"] for r in last)[0] == 0 and sum(r["n_tokens"] for r in last) == max(r["start"] + r["n_tokens"] for r in last)
