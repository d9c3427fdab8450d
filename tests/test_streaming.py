"""New pages as a stream."""

from screenrel.streaming.pages import run_on_new_pages


def test_new_pages_are_processed_once(spark, tmp_path):
    kind = "page_id long, ord long, id string, x0 long, y0 long, x1 long, y1 long"
    source, sink, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def arrive(page):
        rows = [(page, 0, "outer", 0, 0, 200, 200), (page, 1, "inner", 20, 20, 100, 100)]
        frame = spark.createDataFrame(rows, kind).coalesce(1)
        frame.write.mode("append").parquet(source)
        query = run_on_new_pages(spark, source, frame.schema, "spatial_relations", sink, mark)
        query.awaitTermination(120)
        return sorted((r.batch, r.page_id, r.a, r.relation) for r in spark.read.parquet(sink).collect())

    assert arrive(1) == [(0, 1, "outer", "contains")]
    assert arrive(2) == [(0, 1, "outer", "contains"), (1, 2, "outer", "contains")]
