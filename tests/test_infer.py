"""The model loader runs once per task; rows reach it in batches."""

from qforge.operators.infer import apply_model


def test_loader_once_per_task(spark):
    sc = spark.sparkContext
    loads, calls = sc.accumulator(0), sc.accumulator(0)

    def loader():
        loads.add(1)

        def model(texts):
            calls.add(1)
            assert len(texts) <= 10
            return [t.upper() for t in texts]
        return model

    df = spark.range(0, 400).selectExpr("id", "concat('q', cast(id as string)) AS inputs").repartition(4)
    out = apply_model(df, "inputs", loader, "prediction", batch_size=10)
    rows = out.collect()
    assert len(rows) == 400 and all(r["prediction"] == r["inputs"].upper() for r in rows)
    assert loads.value == 4            # one load per task (4 partitions)
    assert calls.value >= 40           # batches of at most 10 rows
