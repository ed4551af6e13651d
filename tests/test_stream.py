"""The streaming variant answers what the batch plan answers."""

from lorequery.streaming.questions import ask_stream


def test_stream_equals_batch(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<title>Light</title><body><p>" + "Light is what eyes see in daytime here. " * 3 + "</p></body>")], "page_id long, url string, html string")
    spark.createDataFrame([(1, "What is light?")], "q_id int, question string").write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema("q_id int, question string").parquet(str(tmp_path / "in"))
    run = ask_stream(stream, pages, lambda df, number: got.extend(df.collect()), str(tmp_path / "cp"), availableNow=True)
    run.awaitTermination(180)
    assert [(r.q_id, r.answer) for r in got] == [(1, "Light is what eyes see in daytime here. [1]")]
