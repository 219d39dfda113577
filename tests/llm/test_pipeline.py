"""The pipeline against a brute-force version of its stages on a small table."""

import random

import corpus_pipeline
import sentencepiece

from quern.llm import decontaminate, pieces, substrings, toxicity

from .test_simhash import brute_components
from .test_substrings import brute as brute_substrings


def test_stages_and_run(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rng = random.Random(9)
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    passage = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60))
    rows += [(9000 + i, f"{rows[i][1][:200]} {passage} {rows[i][1][200:500]}", "en", "src1", 0) for i in range(4)]
    rows += [(9100, f"{rows[3][1][:300]} {bench[2][1]}", "en", "src2", 5), (9200, rows[1][1], "en", "src3", 7), (9300, None, "en", None, None), (9301, "", "en", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.selectExpr("*", "1 as __q_id", "'x' as _c0", "2 as removed_bytes", "3 as th", "4 as spans", "5 as piece_id")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    docs = df
    kept = {r[0]: r for r in rows}
    # 1 toxicity
    model = toxicity.train(toxicity.labelled_sample(df, spark.read.parquet(f"{sf}/labels.parquet"), "toxic"))
    scores = dict(zip(kept, toxicity.score_texts([(r[1] or "").encode() for r in kept.values()], model, {})))
    want = [{d: r[1] for d, r in kept.items() if scores[d] < 0.5}]
    # 2 near duplicates
    left = list(want[-1].items())
    _, comps = brute_components(left)
    want.append({d: t for (d, t), c in zip(left, comps) if d == c})
    # 3 repeated passages
    want.append(dict(brute_substrings(list(want[-1].items()))))
    # 4 benchmark items
    block = decontaminate.Items(bench)
    import numpy as np

    seq, starts = decontaminate._sequences([t or "" for t in want[-1].values()], block.vocab)
    counts = np.bincount(seq, minlength=block.size)
    counts[0] -= 2 * len(want[-1])
    block.seed(counts, int(counts.sum()))
    ids = list(want[-1])
    bad = {ids[h[0]] for h in decontaminate.find([want[-1][d] or "" for d in ids], block) if h[2] >= decontaminate.CONTAMINATED or h[3] >= decontaminate.RUN_WORDS}
    want.append({d: t for d, t in want[-1].items() if d not in bad})
    for (name, stage), expected in zip(corpus_pipeline.STAGES, want):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == df.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert {r.doc_id: r.text for r in docs.collect()} == expected, name
    assert 9100 not in want[-1] and 9200 not in want[-1]
    assert sum(passage in (t or "") for t in want[-1].values()) <= 1
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = {r.doc_id: r.piece_ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {d: lib.encode(t or "") for d, t in want[-1].items()}
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "sentencepiece"]


def test_empty_documents(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
