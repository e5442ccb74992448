"""The sampled rows of the classifier are fitted in a task, not in the driver."""

from tavola.llm import nbsvm
from tavola.llm.shared import ship_package


def test_driver_gets_weights_and_no_rows(spark, monkeypatch):
    def in_driver(*_a, **_k):
        raise AssertionError("fitted in the driver")
    for name in ("dual_coordinate_descent", "_columns", "_margins"):
        monkeypatch.setattr(nbsvm, name, in_driver)
    ship_package(spark)
    docs = spark.createDataFrame([(i, f"good words stand here {i}" if i % 2 else f"BAD # junk | {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = nbsvm.fit(docs, labels)
    assert model["weight"].shape == model["square"].shape == (nbsvm.DIM,)
    assert len(model["curve"]) == 2
    one_class = nbsvm.fit(docs, labels.where("quality = 1"))
    assert one_class == {"share": 1.0}
