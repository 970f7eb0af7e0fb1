import time

from veriloom.llm import url_filters


def test_slashes(spark):
    url = "http://" + "a." * 300 + "example.com/en/" + "x/" * 6000
    df = spark.createDataFrame([(1, url), (2, url + "?q"), (3, "http://b.net/de/")], "page_id long, url string")
    rules = url_filters.fixed_rules(spark)
    url_filters.judge_urls(df, rules).collect()
    began = time.perf_counter()
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.judge_urls(df, rules).collect()}
    assert time.perf_counter() - began < 5 and got == {1: ("example.com/en/", "block"), 2: ("example.com/en/", "block"), 3: (None, "allow")}
    deep = spark.createDataFrame([("block", "a.example.com", "/en/x/x/x/"), ("allow", "com", "/e")], "verdict string, host string, path string")
    assert {r["rule"] for r in url_filters.judge_urls(df.where("page_id < 3"), deep).collect()} == {"a.example.com/en/x/x/x/"}
    assert {r["verdict"] for r in url_filters.judge_urls(df, deep.where("false")).collect()} == {"allow"}
