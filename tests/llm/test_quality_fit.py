import numpy as np

from folioforge.llm import quality as Q
from folioforge.llm.common import labelled_sample, read


def test_fit_holds_few_rows_at_once(spark, sf, monkeypatch):
    sample = labelled_sample(read(spark, sf, "documents"), read(spark, sf, "labels"), "quality", Q.MODULUS, Q.HELD_OUT, Q.SAMPLE)
    whole, held, weighted = Q.fit(sample), [], Q.weighted
    monkeypatch.setattr(Q, "weighted", lambda x, idf: held.append(len(x)) or weighted(x, idf))
    found = Q.fit(sample, rows=16)
    assert max(held) == 16 < len(found.labels)
    assert np.array_equal(found.idf, whole.idf) and np.array_equal(found.labels, whole.labels) and found.prior == whole.prior
    assert np.allclose(found.vectors, whole.vectors, atol=1e-4)
