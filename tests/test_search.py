import json

import pytest

from quirelake.operators import search


@pytest.mark.parametrize("needle", ['A1="x"', "a\\b", "one\ttwo", "line\nfeed", "2000", "e+22", "e", "Infinity", "rate → a!b1", "É", "\u00c9t", "margin"])
def test_every_leaf_is_found(spark, needle):
    texts = ['=IF(A1="x",1)', "a\\b", "one\ttwo\nline\nfeed", "\u00c9t\u00e9", "Margin"]
    body = json.dumps({"t": texts, "named_ranges": [{"name": "Rate", "formula": "A!B1"}]}, ensure_ascii=False)
    models = spark.createDataFrame([("t", body), ("n", '{"x": [2E3, 1E999]}'), ("b", '{"x": 10000000000000000000000.0}'), ("u", '{"x": "m\\u0061rgin"}')], "path string, payload string")
    leaves = search.model_leaves(models, "path", "payload")
    want = sorted((r.path, r.leaf) for r in leaves.where(search.tx.contains_folded(leaves["leaf"], needle)).collect())
    assert want and sorted((r.path, r.leaf) for r in search.search_models(models, "path", "payload", needle).collect()) == want
