"""The url filter splits branches at any depth."""

from tesserae.llm import url_filter


def test_branches_that_part_below_the_fourth_segment(spark):
    start = "http://h.test/a/b/c/d/e"
    pages = [(i, f"{start}/{'bad' if i % 4 == 0 else 'good'}/{i}") for i in range(400)] + [(1000, f"{start}/bad/new"), (1001, "http://lone.test/1/2/3/4/5/6")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "page_id long, bad int")
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), labels).collect()}
    assert got[1000].template.endswith("/bad/*") and got[1000].verdict == "block" and got[1].template.endswith("/good/*") and got[1].verdict == "allow"
    assert got[1001].template == "/*" * 6
