import corpus_pipeline as p
from gradeloom.llm import toxicity as T
from tests.conftest import SF
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_jaccard_join import gram_set


def near(rows):
    sets = {r.doc_id: gram_set(r.text, p.SHINGLE_WORDS) for r in rows}
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and x and 100 * min(len(x), len(y)) >= p.SIMILARITY_PERCENT * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= p.SIMILARITY_PERCENT * (len(x) + len(y) - n):
                    lo, hi = sorted((root(i), root(j)))
                    top[hi] = lo
    return {i for i in top if top[i] == i}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    labels = spark.read.parquet(SF + "/labels.parquet")
    rows = docs.collect()
    model = T.fit_toxicity(docs, labels)
    want = [r for r, s in zip(rows, T.text_scores(model, [r.text for r in rows])) if s < T.THRESHOLD]
    last = {r.text: r.doc_id for r in sorted(want, key=lambda r: r.doc_id)}
    items = [(r.item_id, r.text) for r in spark.read.parquet(SF + "/benchmark.parquet").collect()]
    for (name, stage), step in zip(p.STAGES[:4], (
            lambda x: {r.doc_id for r in x}, lambda x: {r.doc_id for r in x if last[r.text] == r.doc_id}, near,
            lambda x: {r.doc_id for r in x} - {d for d, *_ in contaminated([(r.doc_id, r.text) for r in x], items)})):
        keep = step(want)
        want = [r for r in want if r.doc_id in keep]
        docs = stage(spark, docs, SF)
        got = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert sorted(got) == sorted(want), name
        docs = spark.createDataFrame(got, docs.schema)
    pieces = p.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in want}


def test_empty_documents(spark):
    docs = spark.read.parquet(SF + "/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, SF).collect() == []
