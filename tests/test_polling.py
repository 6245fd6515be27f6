"""The polled day feed: days come once, in order of completion, over stops and later days; days without pages say so."""

import json

from binweave.sources import rest
from binweave.streaming.closed_bins import run_available


def page(folder, day, token, after=None):
    data = {"n": f"{day}/{token}"} | ({"paginationToken": after} if after else {})
    (folder / f"{day}-{token}.json").write_text(json.dumps({"code": 0, "data": data}))


def test_poll_stops_and_goes_on(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    for day in ("2024-01-01", "2024-01-02", "2024-01-04", "2024-01-05"):  # none on the third
        page(feed, day, "first", "b")
        page(feed, day, "b")
    url, out, check = f"file://{feed}/{{day}}-{{token}}.json", str(tmp_path / "out"), str(tmp_path / "check")
    seen = []
    for last in ("2024-01-01", "2024-01-03", "2024-01-03", "2024-01-05"):
        run_available(rest.polled_days(spark, url, "2024-01-01", last), out, check).awaitTermination()
        seen.append(sorted((r.day, r.page, r.state) for r in spark.read.schema(rest.SCHEMA).parquet(out).collect()))
    ok = lambda day: [(day, 1, "ok"), (day, 2, "ok")]
    first = ok("2024-01-01")
    second = first + ok("2024-01-02") + [("2024-01-03", 1, "no_data")]
    assert seen == [first, second, second, second + ok("2024-01-04") + ok("2024-01-05")]
    assert seen[-1] == sorted((r.day, r.page, r.state) for r in rest.days(spark, url, "2024-01-01", "2024-01-05").collect())


def test_offsets_never_go_back():
    poll = rest._Poll({"url": "", "first": "2024-01-03", "last": "2024-01-01"})
    assert poll.initialOffset() == poll.latestOffset() == {"day": "2024-01-03"}
    assert poll.partitions({"day": "2024-01-03"}, {"day": "2024-01-05"}) and [p.day for p in poll.partitions({"day": "2024-02-28"}, {"day": "2024-03-01"})] == ["2024-02-28", "2024-02-29"]
    assert rest._Poll({"url": "", "first": "2024-01-03"}).latestOffset()["day"] > "2024-01-03"
