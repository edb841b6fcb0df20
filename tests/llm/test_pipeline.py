"""The corpus pipeline, stage by stage."""

from collections import Counter

import corpus_pipeline
from test_operators import brute_lines, brute_pieces

from voxquarry.llm.common import staged


def test_stages(spark, docs, rows, tmp_path):
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).select("c0", "c1", "c2", "c3", "c4").toDF("doc_id", "text", "lang", "source", "n_chars")
    now = staged(plain, "t")
    columns = now.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = staged(stage(spark, now, ""), name)
        assert now.columns == columns
        seen.append([tuple(r) for r in now.collect()])
    first, second, third = seen
    assert {r[0] for r in first} >= set(range(120)) and not {400, 401, 402, 403, 406} & {r[0] for r in first}
    assert Counter((r[0], r[1]) for r in second) == Counter(brute_lines(first))
    assert len(third) == len({r[0] for r in third})
    packed = corpus_pipeline.STAGES[-1][1](spark, now, "").collect()
    assert Counter(tuple(r)[:5] for r in packed) == brute_pieces(third)


def test_run(spark, rows, docs, tmp_path):
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).select("c0", "c1", "c2", "c3", "c4").toDF("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 100
    plain.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
