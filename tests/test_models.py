from eventide.operators import models


def test_missing_features_count_as_zero_and_no_row_is_left_out(spark):
    data = [(k, float(k % 5) if k % 4 else None, float("nan") if k % 7 == 0 else 1.0, float(k % 5)) for k in range(40)]
    table = spark.createDataFrame(data, "k INT, a DOUBLE, b DOUBLE, y DOUBLE")
    model = models.boosted_model(table, ["a", "b"], "y", trees=2)
    out = models.boosted_scores(model, table, ["k"])
    assert out.count() == 40 and out.where("pred is null or isnan(pred)").count() == 0
    filled = table.fillna(0.0, subset=["a", "b"])
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, models.boosted_scores(model, filled, ["k"]).collect()))
