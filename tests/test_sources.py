import json
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.sources import feed, html_feeds, json_feeds, store


def pages(spark, *markup):
    return spark.createDataFrame([(i, m, "https://e.org/app") for i, m in enumerate(markup)], "page_no int, html string, base_url string")


def test_array_feed(spark, tmp_path):
    docs = [
        {"id": "1", "b_id": [77], "b_bid_number": ["B/1"], "b_category_name": ["Short"], "bd_category_name": [" Long  name "], "b_total_quantity": [5], "b_total_value": ["12.5"], "b_bid_type": [2], "b_eval_type": [1], "is_rc_bid": [1], "ba_official_details_minName": ["Ministry"], "final_end_date_sort": ["2026-08-01T10:00:00Z"]},
        {"id": "2", "b_bid_number": [], "b_category_name": ["x"]},
    ]
    (tmp_path / "a.json").write_text(json.dumps(docs))
    (tmp_path / "b.json").write_text("{broken")
    feed = json_feeds.read_feed(spark, str(tmp_path), json_feeds.ARRAY_FEED)
    rows = json_feeds.array_feed(feed, "p", "https://e.org").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.notice_id, r.title, r.organisation, r.department, r.category, r.description) == ("B/1", "Long name", "Ministry", "Ministry", "Short", "Quantity: 5 | Rate Contract")
    assert (float(r.value), r.closing, r.url) == (12.5, datetime(2026, 8, 1, 10), "https://e.org/list-ra-schedules/77")
    assert feed.cache().where("_corrupt is not null").count() == 1


def test_epoch_and_flat_feeds(spark):
    epoch = spark.createDataFrame([(9, None, " r1 ", "Work  A", 0, 4, 0, 86_400_000, None), (1, 2, None, " ", 1, 1, 1, 1, 1)], json_feeds.EPOCH_FEED)
    rows = json_feeds.epoch_feed(epoch, "b", "State", "u").collect()
    assert [(r.notice_id, r.title, r.organisation, r.department, r.description, r.published, r.closing) for r in rows] == [("9", "Work A", "State Organisation 4", None, "Work A | r1", None, datetime(1970, 1, 2))]
    flat = spark.createDataFrame([(5, " ", "T", "d", None, "ct", "dep", "01-02-2026 03:04:05", "x"), (0, "", "T", None, None, None, None, None, None)], json_feeds.FLAT_FEED)
    rows = json_feeds.flat_feed(flat, "k", "u").collect()
    assert [(r.notice_id, r.category, r.published, r.closing) for r in rows] == [("5", "ct", datetime(2026, 2, 1, 3, 4, 5), None)]


def test_corrigendum(spark):
    body = json.dumps([{"sTenderNo": "T1", "sNameOfWork": "W", "mEstimatedCost": "190000", "dtBidSubmissionClosingDate": "05/08/2026 11:00 AM"}, {"sTenderNo": "T1", "sNameOfWork": "again"}, {"nTenderID": 3, "sNameOfWork": "V", "mEstimatedCost": "0"}])
    raw = spark.createDataFrame([(body,), ("not json",), ("{}",)], "body string")
    rows = {r.notice_id: r for r in json_feeds.corrigendum_feed(raw, "body", "t", "u").collect()}
    assert set(rows) == {"T1", "3"}
    assert float(rows["T1"].value) == 190000 and rows["T1"].title == "W" and rows["T1"].closing == datetime(2026, 8, 5, 11)
    assert rows["3"].value is None


def test_listing_and_index(spark):
    row = '<tr><td>1</td><td><a href="d?id=1">Radio set</a></td><td>Reference No: R/1</td><td>21-Jul-2026 05:00 PM</td><td>22-Jul-2026</td></tr>'
    nav = '<tr><td><a href="/more">More</a></td><td>credits</td></tr>'
    got = html_feeds.listing(pages(spark, f"<table><tr><th>a</th></tr>{row}{nav}</table>", f"<table>{row}</table>"), "g").collect()
    assert [(r.title, r.closing, r.opening, r.url) for r in got] == [("Radio set", datetime(2026, 7, 21, 17), datetime(2026, 7, 22), "https://e.org/app/d?id=1")]
    index = '<table class="list_table"><tr class="list_header"><td>S.No</td><td>Organisation Name</td><td>Tender Count</td></tr><tr><td>1</td><td>Org &amp; Co</td><td><a href="/app?DirectLink=1">1,204</a></td></tr><tr><td>2</td><td>None</td><td><a href="?DirectLink">0</a></td></tr></table>'
    assert [tuple(r) for r in html_feeds.organisation_index(pages(spark, index, "<p>other</p>")).collect()] == [("Org & Co", 1204, "https://e.org/app?DirectLink=1")]


def test_organisation_notices(spark):
    page = (
        '<table class="list_table"><tr class="list_header"><td>e-Published Date</td><td>Title and Ref.No./Tender ID</td></tr>'
        '<tr class="even"><td>1</td><td>01-Jul-2026 09:00 AM</td><td>09-Jul-2026 09:00 AM</td><td>10-Jul-2026 09:00 AM</td><!-- <td>old</td> -->'
        '<td><a title="View Tender Information" href="/t">[Boots]</a> [REF/1][2026_X_1]</td><td>Army||Ordnance||Depot</td></tr></table>'
    )
    (r,) = html_feeds.organisation_notices(pages(spark, page), "g").collect()
    assert (r.notice_id, r.title, r.organisation, r.department, r.url) == ("2026_X_1", "Boots", "Army", "Ordnance", "https://e.org/t")
    assert (r.published, r.closing, r.opening) == tuple(datetime(2026, 7, d, 9) for d in (1, 9, 10))


def test_blocks(spark):
    one = '<div class="samer"><a class="coli-id">11</a><a class="coli-tno">A/1</a><a class="tDesc">Bridge in Division No: PWD.</a><span class="coli-date">05/08/2026 03:00 PM</span></div>'
    two = '<div class="update-nag"><div class="update-split"><h4>Aug</h4><h4>9</h4><h4>05:00 PM</h4></div><div class="update-text"><p><a>12</a></p><p><a> </a></p><p><a>Well</a></p></div></div>'
    now = F.lit("2026-08-01").cast("timestamp")
    rows = {r.notice_id: r for r in html_feeds.block_listing(pages(spark, one + one, two), "c", now).collect()}
    assert set(rows) == {"A/1", "12"}
    assert (rows["A/1"].title, rows["A/1"].department, rows["A/1"].closing) == ("Bridge", "PWD", datetime(2026, 8, 5, 15))
    assert rows["12"].closing == datetime(2026, 8, 9, 17)


def test_report_and_calendar(spark):
    rows = '<tr><td class="table_heading_row" colspan="4">Org-Dept-Office</tr><tr><td>1</td><td>55</td><td>N/1</td><td>30-07-2026 15:00</td></tr><tr><td>2</td><td>56</td><td></td><td>x</td></tr>'
    got = {r.notice_id: r for r in html_feeds.closing_report(pages(spark, f'<table id="mytable"><tbody>{rows}</tbody></table>'), "r").collect()}
    assert (got["N/1"].organisation, got["N/1"].department, got["N/1"].closing) == ("Org", "Dept - Office", datetime(2026, 7, 30, 15))
    assert (got["56"].title, got["56"].organisation, got["56"].closing) == ("Tender 56", "Org", None)
    script = r"""<script>var d = JSON.parse('{\"2026-07-30\": 3, \"2026-07-31\": 0}');</script>"""
    assert [tuple(r) for r in html_feeds.calendar_counts(pages(spark, script, "<p>none</p>")).collect()] == [("2026-07-30", 3)]


def test_visible_rows(spark):
    rows = [(["Home", "Contact"], []), (["GEM/2026/B/123", "Supply of night vision sights", "Ministry of X", "01/07/2026 10:00", "09/07/2026"], ["/a", "https://e.org/1"]), (["no results found", "12345678"], [])]
    (r,) = html_feeds.visible_rows(spark.createDataFrame(rows, "cells array<string>, links array<string>"), "v", "https://e.org").collect()
    assert (r.notice_id, r.title, r.organisation, r.url) == ("GEM/2026/B/123", "Supply of night vision sights", "Ministry of X", "https://e.org/1")
    assert (r.published, r.closing) == (datetime(2026, 7, 1, 10), datetime(2026, 7, 9))


def test_snapshot_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, None, datetime(2026, 1, 1)), (2, "x", None)], "id long, name string, at timestamp")
    first, counts = store.export_snapshot({"a": df, "b": df.limit(0)}, str(tmp_path / "s"), {"a": ["id"]})
    assert counts == {"a": 2, "b": 0}
    later, _ = store.export_snapshot({"a": df}, str(tmp_path / "s"))
    assert store.exports(spark, str(tmp_path / "s")) == [first, later] and store.exports(spark, str(tmp_path / "none")) == []
    back = store.restore_snapshot(spark, first, ["a", "b", "missing"], confirm=True)
    assert set(back) == {"a", "b"} and sorted(back["a"].collect()) == sorted(df.collect()) and back["b"].schema == df.schema


def test_versions_change_together(spark, tmp_path):
    root = str(tmp_path / "v")
    for n in (1, 2):
        store.write_version(spark, root, {"a": spark.range(n), "b": spark.range(n)})
        assert store.read_version(spark, root, "a").count() == store.read_version(spark, root, "b").count() == n


def test_a_lost_writer_harms_nothing_and_of_two_one_fails(spark, tmp_path):
    import pytest

    root = str(tmp_path / "b")
    store.write_version(spark, root, {"notices": spark.range(5), "other": spark.range(3)})
    spark.range(9).write.parquet(root + "/v-lost/notices")  # written, never published
    (tmp_path / "b" / "pointers" / "000000000002.json").write_text("")  # claimed by a writer that was lost
    assert store.read_version(spark, root, "notices").count() == 5 and store.read_version(spark, root, "other").count() == 3
    with pytest.raises(Exception, match="exist"):
        store.write_version(spark, root, {"notices": spark.range(6)})
    (tmp_path / "b" / "pointers" / "000000000002.json").unlink()
    store.write_version(spark, root, {"notices": spark.range(6)})
    assert store.read_version(spark, root, "notices").count() == 6 and store.read_version(spark, root, "other").count() == 3


def test_feed_reads_as_the_last_versions_and_folds_without_change(spark, tmp_path):
    import random

    root, keys, rng = str(tmp_path / "f"), ["portal", "notice_id"], random.Random(2)
    base = "portal string, notice_id string, title string, content_hash string, last_seen_at timestamp, last_seen_run string"
    model = {str(i): (f"t{i}", "r0") for i in range(40)}
    store.write_version(spark, root, {"notices": spark.createDataFrame([("p", k, t, "h", datetime(2026, 1, 1), r) for k, (t, r) in model.items()], base)})
    read = lambda df: {r.notice_id: (r.title, r.last_seen_run) for r in df.collect()}
    states = []
    for n in range(6):
        states.append(dict(model))
        rows = []
        for k in rng.sample([str(i) for i in range(60)], 5):
            new = (f"t{k}-{n}", "h") if k not in model or rng.random() < 0.5 else None
            model[k] = (new[0] if new else model[k][0], f"r{n + 1}")
            rows.append(("p", k, new, datetime(2026, 1, 2 + n), f"r{n + 1}"))
        changes = spark.createDataFrame(rows, "portal string, notice_id string, v struct<title:string,content_hash:string>, last_seen_at timestamp, last_seen_run string")
        feed.append(root, "notices", changes.limit(1), n)  # an attempt that was lost
        feed.append(root, "notices", changes, n)
        assert read(feed.present(spark, root, "notices", keys)) == model
        assert read(feed.present(spark, root, "notices", keys, before=n)) == states[n]
    wanted = spark.createDataFrame([("p", "1"), ("p", "55"), ("q", "1")], "portal string, notice_id string")
    some = feed.present_keys(spark, root, "notices", keys, wanted, ["title", "last_seen_run"])
    assert read(some) == {k: model[k] for k in ("1", "55") if k in model}
    assert feed.fold(spark, root, "notices", keys, before=3) and read(store.read_version(spark, root, "notices")) == states[3]
    assert read(feed.present(spark, root, "notices", keys)) == model
    assert not feed.fold(spark, root, "notices", keys, share=1.0) and feed.fold(spark, root, "notices", keys, share=0.1)
    assert read(store.read_version(spark, root, "notices")) == model and feed.changes(spark, root, "notices", keys).isEmpty()


def test_restored_tables_are_checked_and_published(spark, tmp_path):
    import pytest

    parents, children = spark.range(3), spark.createDataFrame([(1, 2), (2, None)], "id long, parent long")
    out, _ = store.export_snapshot({"parents": parents, "children": children}, str(tmp_path / "s"))
    names, refs, root = ["parents", "children", "missing"], [("children", "parent", "parents", "id")], str(tmp_path / "r")
    assert store.publish_snapshot(spark, out, root, names, refs, confirm=True) == {"parents": 3, "children": 2}
    assert store.read_version(spark, root, "children").count() == 2
    out, _ = store.export_snapshot({"parents": parents.limit(0), "children": children}, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        store.publish_snapshot(spark, out, root, names, refs, confirm=True)
    assert store.read_version(spark, root, "parents").count() == 3


def test_character_references_and_other_tables(spark):
    index = "<table><tr><td>Organisation Name</td><td>x</td><td>Tender Count</td></tr><tr><td>1</td><td>Caf&eacute; &#8364; &amp;lt; &#60;b&#62;</td><td><a href='/app?DirectLink=1'>4</a></td></tr></table>"
    other = "<table><tr><td>1</td><td>Not this</td><td><a href='/app?DirectLink=2'>9</a></td></tr></table>"
    assert [(r.name, r.n) for r in html_feeds.organisation_index(pages(spark, index + other)).collect()] == [("Caf\u00e9 \u20ac &lt; <b>", 4)]
