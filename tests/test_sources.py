"""Tables and configs, written and read again; sessions on a stream."""

from pyspark.sql import functions as F

from loomstat.operators import detection as D
from loomstat.sources import tables as T
from loomstat.streaming import scoring


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", None)], "i int, s string, x double")
    for kind in ("csv", "tsv", "parquet"):
        T.write_table(df, f"{tmp_path}/t.{kind}")
        back = T.read_table(spark, f"{tmp_path}/t.{kind}")
        assert back.columns == df.columns and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    both = T.concat_columns(df, df.withColumn("x", F.lit(9.0)), ["i"])
    assert both.columns == ["i", "s", "x", "s_1", "x_1"] and both.count() == 2


def test_configs(tmp_path):
    (tmp_path / "c.json5").write_text("{a: 1, // one\n 'b': \"x // y\", /* two\n lines */ c: [1, 2,],}")
    assert T.load_config(str(tmp_path / "c.json5")) == {"a": 1, "b": "x // y", "c": [1, 2]}
    for kind in ("yml", "json"):
        T.write_result({"f1": 0.5, "n": [1, 2]}, f"{tmp_path}/r.{kind}")
        assert T.load_config(f"{tmp_path}/r.{kind}") == {"f1": 0.5, "n": [1, 2]}


def test_stream(spark, tmp_path, data):
    events = spark.read.parquet(f"{data}/events.parquet").select("user_id", "ts", "value")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    fitted = D.ZScoreScorer(["value"]).fit(events)
    scored = scoring.score_stream(stream, fitted, D.ThresholdDecider(threshold=2.0))
    q = scored.writeStream.format("memory").queryName("scored").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    want = D.ThresholdDecider(threshold=2.0).transform(fitted.transform(events))
    assert spark.table("scored").groupBy().sum("label").first()[0] == want.groupBy().sum("label").first()[0]
    w = scoring.window_statistics(stream, "ts", "value", "1 day")
    q = w.writeStream.format("memory").outputMode("complete").queryName("windows").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").groupBy().sum("n").first()[0] == events.count()
