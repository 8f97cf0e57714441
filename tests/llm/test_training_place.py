"""Where the classifier is trained."""

import os

from spanloom.llm import toxicity


def test_classifier_is_not_trained_on_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "bad awful words here" if i % 3 == 0 else "calm and plain words here", "en") for i in range(60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    want = toxicity.fit(docs, labels)
    driver, train = os.getpid(), toxicity.train

    def told(*args):
        assert os.getpid() != driver
        return train(*args)

    monkeypatch.setattr(toxicity, "train", told)
    got = toxicity.fit(docs, labels)
    assert (got.emb == want.emb).all() and got.shift == want.shift and got.thresholds == want.thresholds
