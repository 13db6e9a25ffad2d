"""The corpus pipeline, stage by stage on its own input."""

import re
from collections import defaultdict

import corpus_pipeline
from tallyveil.llm import quality
from tallyveil.llm.store import materialise


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "best_fit_packing"]
    inputs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(materialise(stage(spark, inputs[-1], folder), name))
    for df in inputs[:-1]:
        assert df.columns == corpus_pipeline.COLUMNS
    rows = [{r.doc_id: r for r in df.collect()} for df in inputs[:-1]]
    kept = {r.doc_id for r in quality.classify(docs, quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))).collect() if r.predicted}
    assert set(rows[1]) == kept and all(rows[0][i] == r for i, r in rows[1].items())
    have = defaultdict(set)
    for i, r in rows[1].items():
        for x in r.text.split("\n"):
            have[low(x.strip())].add(i)
    assert set(rows[2]) == set(rows[1])
    for i, r in rows[2].items():
        want = "\n".join(x for x in rows[1][i].text.split("\n") if not low(x.strip()) or len(have[low(x.strip())]) < 10)
        assert r.text == want and r.n_chars == len(want)
    sets = {}
    for i, r in rows[2].items():
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(r.text))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert set(rows[3]) == {find(i) for i in sets}
    packed = inputs[-1].collect()
    assert {r.doc_id for r in packed} == set(rows[4]) and set(rows[4]) <= set(rows[3])
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).drop("sequence_id", "offset").collect()) == sorted(tuple(r)[:5] for r in packed)


def test_repeated_and_null_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "few words", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        docs.collect()
