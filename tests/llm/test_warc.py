"""WARC records: written files read back, hostile pages and headers."""

import time

import pytest

from rastra.llm import warc


@pytest.mark.parametrize("open_tag", ["<a", "<script", "<title>", "<!--", "</script ", "<p <"])
def test_hostile_pages_take_linear_time(open_tag):
    began = time.time()
    warc.plain_text(open_tag * 200_000)
    warc.title_of(open_tag * 200_000)
    warc.plain_text("<p>x</p>" + open_tag * 200_000)
    assert time.time() - began < 3


def test_text_and_title():
    page = "<html><head><title> A &amp; B </title><script>x < 1</script></head><body><p>one<br>two</p><!-- no --><div>3 &lt; 4</div> tail <b"
    assert warc.title_of(page) == "A & B"
    assert warc.plain_text(page) == "A & B\none\ntwo\n3 < 4\ntail <b"
    assert warc.title_of("<title>never closed") is None and warc.plain_text("") == ""


def test_files_read_back(spark, tmp_path):
    rows = [(1, "http://a/\r\nWARC-Type: response", "<p>a</p>", "X-A: 1\r\nX-B: 2"), (None, None, None, None), (2, "http://b/", "", None), (2, "http://b/", "", None), (3, "http://c/é", "<p>日本</p>" * 1000, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, headers string").repartition(2)
    made = warc.derivatives(df)
    warc.write_warc(made, f"file://{tmp_path}/w", file_bytes=600)
    got = warc.read_warc(spark, f"file://{tmp_path}/w")
    want = made.drop("source_headers").select(*got.columns)
    clean = lambda d: sorted((tuple(r) for r in d.collect()), key=str)
    expected = [tuple(v.replace("\r", "%0D").replace("\n", "%0A") if c == "target_uri" and v else v for c, v in zip(got.columns, r)) for r in clean(want)]
    assert clean(got) == sorted(expected, key=str)
    assert {r["record_type"] for r in got.collect()} == {"metadata", "conversion"}
    heads = {r["page_id"]: r["source_headers"] for r in made.collect()}
    assert heads == {1: "X-A: 1\r\nX-B: 2", None: None, 2: None, 3: None}
