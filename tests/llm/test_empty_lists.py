"""A query whose nearest list is empty is answered from the others."""

import numpy as np

from lamina.llm import ads_search


def test_first_list_without_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=4) * (1e-6 if i % 20 == 0 else 1)).tolist()) for i in range(60)]
    kmeans = ads_search._kmeans
    # A list for each vector, and one at the origin: small queries lie nearest to it, no vector does (all are lifted to one length).
    monkeypatch.setattr(ads_search, "_kmeans", lambda x, lists: np.vstack([kmeans(x, lists), np.zeros(x.shape[1])]))
    out = ads_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lists=60).collect()
    assert {r["query_id"] for r in out} == {0, 20, 40}
    assert all(sum(r["query_id"] == i for r in out) == 20 for i in (0, 20, 40))
