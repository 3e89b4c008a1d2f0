import hashlib
import re

import corpus_pipeline
from oddsmill.llm import bpe, quality_rules, queries

from .helpers import DOCS, WORD, LOWER, corpus, near_classes, stripped, words


def test_pipeline_as_by_plain_stages(spark, tmp_path):
    rows = corpus(2)
    items = [(k, " ".join((rows[k][1] or "").split()[3:40])) for k in range(4)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)

    kept = quality_rules.judged(spark.createDataFrame(rows, DOCS)).where("kept").collect()
    left = [(r.doc_id, r.text) for r in kept]
    roots = near_classes([t for _, t in left], 0.8)
    first: dict[int, tuple] = {}
    for (i, t), root in zip(left, roots):
        key = (i is None, i or 0, t)
        if root not in first or key < first[root]:
            first[root] = key
    left = sorted(((None if k[0] else k[1], k[2]) for k in first.values()), key=str)
    left = [(i, kept.decode("utf-8", "ignore")) for (i, _), (_, kept) in zip(left, stripped([t for _, t in left], 400))]
    windows = {tuple(words(t)[k : k + 10]) for _, t in items for k in range(len(words(t)) - 9)}
    out = []
    own = bpe.codec(*bpe.default_vocabulary())
    for i, t in left:
        data = t.encode()
        places = [m.span() for m in WORD.finditer(data.translate(LOWER))]
        w = words(t)
        hit = {j for k in range(len(w) - 9) if tuple(w[k : k + 10]) in windows for j in range(k, k + 10)}
        for run in sorted(_runs(hit), reverse=True):
            data = data[: places[run[0]][0]] + data[places[run[1]][1] :]
        joined, back, n = next(own.run([data.decode()]))
        out.append((i, n, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back).hexdigest()))
    assert got == sorted(out, key=str)


def _runs(hit):
    out = []
    for j in sorted(hit):
        if out and out[-1][1] == j - 1:
            out[-1][1] = j
        else:
            out.append([j, j])
    return out


def test_stages_and_queries_are_all_there():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "suffix_dedup", "decontaminate", "byte_bpe"]
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES) == list(range(1, 11))
