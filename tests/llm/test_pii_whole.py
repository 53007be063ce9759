"""Training takes every text, and copies count once."""

import hashlib

import pytest

from routeloom.llm import pii


def test_training_counts_every_text(spark, monkeypatch):
    texts = [f"call +1 (415) 555-{k:04d} or id {k * 7919 % 10**7} 10.0.{k % 256}.1 v {k}.{k}.{k}" for k in range(4500)]
    fitted = []

    def counted(self, sums, rate):
        self.rounds, self.bias = 1, 0.0  # each row's second derivative is 1/4
        fitted.append(sums(self, None)[0][0, :, 1].sum() * 4)
        return self

    monkeypatch.setattr(pii.Boosting, "fit", counted)
    assert pii.fit(spark.createDataFrame([(t,) for t in texts + texts[:500]], "text string"))
    digests = [hashlib.sha256(t.encode()).digest() for t in texts]
    asked = sum(len(pii.examples(t, d[0])) for t, d in zip(texts, digests, strict=True) if d[1] % 3 != 2)
    assert fitted == [pytest.approx(asked)]
