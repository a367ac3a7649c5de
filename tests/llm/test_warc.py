import base64
import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from kappaloom.llm import warc

PAGES = "page_id long, url string, html string, archive string"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree(runs):
    merged = list(warc.LoserTree([iter(sorted(r)) for r in runs]))
    assert [x for x, _ in merged] == sorted(x for r in runs for x in r)
    # equal entries come from earlier runs first
    assert merged == sorted(merged)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "bb", "c {", "d\ne"]), max_size=40), st.sampled_from(["", "a", "b", "bc", "d", "z"]))
def test_a_run_is_entered_by_halving(tmp_path_factory, names, low):
    folder = f"file://{tmp_path_factory.mktemp('run')}"
    entries = [{"url_key": warc.url_key(f"http://h/{n}"), "captured": "1", "archive": "x" * (i % 7 * 900), "offset": i} for i, n in enumerate(names)]
    entries.sort(key=warc.sort_key)
    url, n, keys = warc.write_run(folder, iter(entries))
    key = (warc.url_key(f"http://h/{low}"), "1", "x" * len(low), len(low))
    assert n == len(entries) and list(warc.read_run(url)) == entries and len(keys) <= warc.TOLD
    assert list(warc.read_run(url, key, None, chunk=50)) == [e for e in entries if warc.sort_key(e) >= key]
    assert list(warc.read_run(url, None, key)) == [e for e in entries if warc.sort_key(e) < key]


def test_records_round_trip(tmp_path):
    data = warc.record(5, "http://a\r\nb/é", b"\r\n\r\nbody", None, warc.EPOCH)
    headers, http, payload = warc.parse(data)
    assert payload == b"\r\n\r\nbody" and headers["X-Page-ID"] == "5" and headers["WARC-Type"] == "response"
    headers, http, payload = warc.parse(warc.record(5, None, b"body", 9, warc.EPOCH))
    assert payload == b"" and http.endswith(b"Content-Length: 4") and headers["X-Refers-To-Page"] == "9"


def test_capture_table(spark):
    long = "<p>" + "word " * 80000
    rows = [(1, "http://b.org/x", "same", "clash"), (7, "http://a.org/x", "same", None), (3, "http://b.org/x", "same", None), (4, None, None, None), (5, "", "", None), (6, "https://www.b.org/X#y", long, None), (None, "http://c.org", "same", None), (8, "http://b.org/x", "alone", None), (8, "http://b.org/x", "alone", None)]
    found = warc.capture_table(spark.createDataFrame(rows, PAGES)).collect()
    assert len(found) == len(rows)
    last = {"same": 7, "": 5, long: 6, "alone": 8}
    expected = []
    for page_id, _, html, _ in rows:
        payload = (html or "").encode()
        refers = last[html or ""]
        refers = None if page_id == refers else refers
        expected.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if refers is None else "revisit", refers))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr) == sorted(expected, key=repr)
    history = sorted(found, key=lambda r: r.position)
    assert [r.position for r in history] == list(range(len(rows)))
    keys = [(r.url_key, r.captured) for r in history]
    assert keys == sorted(keys)
    assert warc.capture_table(spark.createDataFrame([], PAGES)).count() == 0


def test_small_payloads_stay_responses(spark):
    rows = spark.createDataFrame([(1, "u", "ab", None), (2, "u", "ab", None), (3, "u", "abcd", None), (4, "u", "abcd", None)], PAGES)
    found = {r.page_id: r.refers_to for r in warc.capture_table(rows, least_bytes=3).collect()}
    assert found == {1: None, 2: None, 3: 4, 4: None}


def test_many_runs_are_merged_in_passes(spark):
    folder = warc.fresh_path(spark, "runs")
    rows = spark.range(200).selectExpr("id AS page_id", "concat('http://h', id % 7, '.org/', id % 13) AS url", "CAST(id AS string) AS html").repartition(9)
    archives = warc.write_archives(rows, folder)
    assert archives.count() > 4
    history = warc.merge_runs(archives, folder, fan_in=3, range_lines=40)
    found = sorted(warc.read_history(history).collect(), key=lambda r: r.position)
    keys = [(r.url_key, r.captured) for r in found]
    assert len(found) == 200 and keys == sorted(keys)


def test_damage_is_found(spark, tmp_path):
    folder = f"file://{tmp_path}/warc"
    archives = warc.write_archives(spark.createDataFrame([(1, "u", "text", None)], PAGES), folder)
    path = archives.first().archive.removeprefix("file://")
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-4] + b"\0\0\0\0")
    try:
        warc.read_archives(archives).collect()
        raise AssertionError("damage went unseen")
    except Exception as e:
        assert "Error" in str(e)


def test_the_captures_of_one_url_are_divided(spark):
    folder = warc.fresh_path(spark, "runs")
    rows = spark.range(300).selectExpr("id % 2 AS page_id", "IF(id % 3 > 0, 'http://hot.org/', concat('http://h.org/', id)) AS url", "CAST(id AS string) AS html").repartition(3)
    archives = warc.write_archives(rows, folder)
    history = warc.merge_runs(archives, folder, range_lines=20)
    assert max(r.lines for r in history.collect()) <= 60
    found = sorted(warc.read_history(history).collect(), key=lambda r: r.position)
    keys = [(r.url_key, r.captured, r.archive, r.offset) for r in found]
    assert len(set(keys)) == 300 and keys == sorted(keys)
