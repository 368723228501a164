"""WARC bundles and URL filters."""

import hashlib
import io

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm.op9 import RULES
from spanloom.llm.url_filter import entries_of, judge_urls
from spanloom.llm.warc import BundleWriter, archive_folder, parse, read_archives, record, seek_table, write_archives

PAGE = "page_id long, url string, html string, digest string, payload string"


@pytest.fixture(scope="module")
def pages(spark):
    big, other = "<p>é</p>" * 300, "y" * 1000
    rows = [(1, "http://a/", big), (7, "http://b/", big), (3, None, big), (4, "u\r\nx", None), (5, "http://c", "y" * 999), (6, "http://c", "y" * 999), (8, "http://d", other), (9, "http://d", other), (9, "http://d", other), (None, "http://e", big), (10, "http://f", "")]
    return spark.createDataFrame([(*r, "d", "p") for r in rows], PAGE).repartition(3)


def expected(rows):
    large = {}
    for r in rows:
        raw = (r["html"] or "").encode()
        if len(raw) >= 1000:
            large.setdefault(raw, []).append(r["page_id"])
    out = []
    for r in rows:
        raw = (r["html"] or "").encode()
        same = large.get(raw, [])
        top = max((x for x in same if x is not None), default=None)
        revisit = len(same) > 1 and r["page_id"] != top
        out.append((r["page_id"], len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("how", [{}, {"frame_bytes": 500, "bundle_bytes": 100}, {"broadcast_groups": 0}, {"broadcast_groups": 1}])
def test_round_trip(spark, pages, how):
    folder = archive_folder(spark)
    index = write_archives(pages, folder, **how)
    got = read_archives(index, folder).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(pages.collect())
    if "frame_bytes" in how:
        assert index.select("bundle").distinct().count() > 3


def test_no_pages(spark, pages):
    folder = archive_folder(spark)
    assert read_archives(write_archives(pages.limit(0), folder), folder).collect() == []


def test_frames_are_independent(tmp_path):
    out = io.BytesIO()
    writer = BundleWriter(out, frame_bytes=400)
    places = [writer.add(record("response", k, f"http://{k}", b"x" * 150, b"\x00" * 20, None)) for k in range(5)]
    writer.close()
    (tmp_path / "b").write_bytes(out.getvalue())
    import zstandard

    with pa.OSFile(str(tmp_path / "b")) as f:
        table = seek_table(f)
        assert len(table) == len({p[0] for p in places}) > 1
        for k, (frame, at) in enumerate(places):
            raw = zstandard.ZstdDecompressor().decompress(f.read_at(table[frame][1], table[frame][0]))
            fields, _, payload = parse(raw[at:])
            assert fields["WARC-Target-URI"] == f"http://{k}" and payload == b"x" * 150
    # Any reader of Zstandard sees the records alone: the seek table is in a skippable frame.
    text = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert text.count(b"WARC/1.1") == 5


URLS = {
    "http://Www.Example.ORG/es/x?q#f": ("www.example.org", "/es/x", "example.org/es/", "block"),
    "https://example.org/en/17": ("example.org", "/en/17", "example.org/en/1", "block"),
    "https://example.org/fr": ("example.org", "/fr", "org/", "allow"),
    "https://notexample.org": ("notexample.org", "", None, "allow"),
    "https://a.com/de/": ("a.com", "/de/", "com/de/", "block"),
    "https://a.com/d": ("a.com", "/d", None, "allow"),
    "a.com/de/": ("", "", None, "allow"),
    "x://com/de/?://org/": ("com", "/de/", "com/de/", "block"),
    "http://?org/": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    "http://" + "a." * 5000 + "com/fr/" + "z" * 9000: ("a." * 5000 + "com", "/fr/" + "z" * 9000, "com/fr/", "allow"),
}


@pytest.mark.parametrize("how", [{}, {"literal_words": 0}, {"literal_words": 0, "broadcast_words": 0, "broadcast_entries": 0}, {"literal_words": 0, "bits_per_key": 1}, {"bits_per_key": 1}])
def test_verdicts(spark, how):
    rows = [(k, u, None, "h", "p") for k, u in enumerate(URLS)] + [(0, next(iter(URLS)), None, "h", "p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, host string, path string")
    got = judge_urls(pages, entries_of(spark, RULES), **how).collect()
    assert len(got) == len(rows)
    want = dict(enumerate(URLS.values()))
    assert all((r["host"], r["path"], r["rule"], r["verdict"]) == want[r["page_id"]] for r in got)


def test_empty_and_repeated_entries(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    nothing = entries_of(spark, RULES).where(F.lit(False))
    assert judge_urls(pages, nothing).first()["verdict"] == "allow"
    twice = entries_of(spark, [("allow", "org", "/"), ("block", "ORG", "/"), ("block", "org", "/")])
    assert judge_urls(pages, twice).first()["verdict"] == "block"
    assert judge_urls(pages.limit(0), twice).collect() == []


def test_long_lists_need_few_keys(spark):
    """Thousands of hosts, paths of 300 lengths: the plan stays small, and most rows pass by the join."""
    rules = [("block", f"h{i}.net", "/" + "p" * (i % 300)) for i in range(1000)] + [("allow", "h7.net", "/ppppppp/")]
    pages = spark.createDataFrame([(i, f"http://www.h{i}.net/" + "p" * 150 + "/q") for i in range(0, 2000, 50)], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in judge_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()}
    for i in range(0, 2000, 50):
        fits = i < 1000 and i % 300 <= 150
        assert got[i] == ((f"h{i}.net/" + "p" * (i % 300), "block") if fits else (None, "allow"))


def test_a_list_too_long_for_a_literal_shuffles_possible_hits_alone(spark):
    pages = spark.createDataFrame([(i, f"http://www.h{i}.net/q") for i in range(40)], "page_id long, url string")
    rules = spark.range(20_000).select(F.lit("block").alias("verdict"), F.concat(F.lit("h"), "id", F.lit(".org")).alias("host"), F.lit("/").alias("path"))
    rules = rules.unionByName(entries_of(spark, [("block", "h7.net", "/q"), ("block", "h8.net", "/other")]))
    out = judge_urls(pages, rules)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # The filter meets rows by broadcast; what is shuffled are the possible hits, by their row.
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in out.collect()} == {i: ("h7.net/q", "block") if i == 7 else (None, "allow") for i in range(40)}
