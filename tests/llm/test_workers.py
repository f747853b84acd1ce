"""Fitting quality runs one Python operator, so that a task takes one worker, with the model of statistics made apart."""

import re

import numpy as np

from paperlark.llm.qda import fit_qda, fit_quality, with_statistics

TEXTS = [None, "", "one two two three.", "A LINE\nand another | line; 12 34", "Σας ὈΔΥΣΣΕΎΣ é", "same same same", "The end. Of it? Yes!", "x" * 3000, "a b " * 500]


def test_fit_quality_takes_one_worker_a_task(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2 if i < 8 else None) for i in range(9)], "doc_id long, quality int")
    plans, map_in_pandas = [], type(docs).mapInPandas

    def planned(self, *args, **named):
        out = map_in_pandas(self, *args, **named)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(type(docs), "mapInPandas", planned)
    model = fit_quality(docs, labels)
    assert [re.findall(r"(\w*EvalPython|MapIn\w+)", p) for p in plans] == [["MapInPandas"]]
    apart = fit_qda(with_statistics(docs).join(labels, "doc_id"))
    for name in ("means", "factors", "log_dets", "log_shares"):
        assert np.allclose(getattr(model, name), getattr(apart, name), rtol=1e-9, atol=1e-12)
