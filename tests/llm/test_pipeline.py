"""The pipeline's stages against brute force on the small tables."""

from collections import Counter

import corpus_pipeline
from loomstat.llm import queries
from loomstat.llm.common import materialize, table
from tests.llm.test_llm import brute_hits, brute_near, brute_tokens


def test_stages(spark, data):
    docs = table(spark, data, "documents")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.toPandas()
        docs = materialize(stage(spark, docs, data), name)
        after = docs.toPandas()
        seen.append(name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "language_id":
            gone = before[~before["doc_id"].isin(after["doc_id"])]
            assert all(not any(c.isalpha() for c in t or "") for t in gone["text"])
        elif name == "near_dedup":
            want = brute_near(zip(before["doc_id"], before["text"], strict=True), corpus_pipeline.NEAR_PERCENT)
            assert set(after["doc_id"]) == {i for i, x in want.items() if x[2]}
        elif name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in table(spark, data, "benchmark").collect()]
            want = brute_hits(before["text"], items)
            assert set(after["doc_id"]) == {i for i, h in zip(before["doc_id"], want, strict=True) if not h[4]}
        elif name == "mixing":
            n = Counter(after["doc_id"])
            assert set(n) <= set(before["doc_id"]) and max(n.values()) <= 3
        else:
            want = brute_tokens({(int(i), t) for i, t in zip(before["doc_id"], before["text"], strict=True)})
            assert len(after) == len(before) and all(want[r.doc_id][1:] == (r.n_tokens, r.ids_crc32) for r in after.itertuples())
    assert len(seen) == 5


def test_registered(spark, data):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(queries.queries()) | {"pipeline"} <= set(names)
    assert corpus_pipeline.run(spark, data).count() > 0
