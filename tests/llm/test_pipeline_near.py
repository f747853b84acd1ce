"""The pipeline's near_duplicates stage against brute force on planted copies of similarity about 0.8."""

import random

import corpus_pipeline


def test_near_duplicates_stage_links_from_080_on(spark):
    random.seed(3)
    texts = []
    for _ in range(30):
        words = [f"w{random.randrange(10**6)}" for _ in range(104)]
        # n words cut off at the end leave 100 - n of 100 runs: 0.80 and 0.84 are linked, 0.79 is not
        texts += [" ".join(words)] + [" ".join(words[: 104 - n]) for n in random.sample((15, 16, 20, 21), 1)]
    runs = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    label = list(range(len(texts)))
    links = [(a, b) for b in range(len(texts)) for a in range(b) if 100 * len(runs[a] & runs[b]) >= 80 * len(runs[a] | runs[b])]
    for _ in texts:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    between = [(a, b) for a, b in links if 100 * len(runs[a] & runs[b]) < 85 * len(runs[a] | runs[b])]
    assert between and len(links) < 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate(spark, docs, "").collect()}
    assert kept == {i for i, x in enumerate(label) if i == x}
