import datetime as dt
import random

import pytest

from shardframe.llm import url_filter as U

DAY = dt.date(2024, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


def brute(captures, entries):
    known = sorted({(a, k, p if k == "prefix" else p.lower(), d, x) for a, k, p, x, d in entries if None not in (a, k, p, x, d)})
    out = []
    for i, url, fetched in captures:
        host, segs = "", []
        if url and "://" in url and url.split("://")[0].isalpha():
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host = rest[:cut].rpartition("@")[2]
            host = host.partition(":")[0].removesuffix(".").lower()
            path = rest[cut:].split("?")[0].split("#")[0]
            segs = [s for s in path.split("/") if s]
        active = []
        for a, k, p in sorted({e[:3] for e in known}):
            past = [e for e in known if e[:3] == (a, k, p) and fetched is not None and e[3] <= fetched]
            if not past or past[-1][4] != "add" or not host:
                continue
            hit = host == p if k == "host" else host == p or host.endswith("." + p)
            if k == "prefix":
                want = p.split("/")
                hit = want == [host, *segs][: len(want)] and len(want) > 1
            if hit:
                active.append((a, past[-1][3]))
        out.append((i, host, bool(active), ",".join(sorted({a for a, _ in active})), len(active), min((d for _, d in active), default=None)))
    return sorted(out, key=repr)


COLUMNS = ("page_id", "host", "blocked", "lists", "n_active", "active_since")


def run(spark, rows, captures, entries, extra=False):
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_on date")
    e = spark.createDataFrame(entries, "list string, kind string, pattern string, action string, dated date")
    return rows(U.filter_captures(c, e), *COLUMNS)


def test_against_brute_force(spark, rows):
    r = random.Random(7)
    hosts = ["a.com", "www.a.com", "x.y.a.com", "B.org", "ba.com", "c.co.uk"]
    paths = ["", "/", "/p", "/p/q", "/p//q/r", "/pq", "/P", "/p?x=/q", "/p#y", "/q/../p"]
    forms = ["http://{}{}", "HTTPS://user:pw@{}:8080{}", "ftp://{}.{}"]
    captures = [(k, r.choice(forms).format(r.choice(hosts), r.choice(paths)), day(r.randint(0, 800))) for k in range(400)]
    captures += [(900, None, day(5)), (901, "not a url", day(5)), (902, "http://a.com/", None), (None, "http://a.com/", day(400)), (903, "http://", day(5)), captures[0]]
    patterns = [("host", h) for h in hosts] + [("domain", d) for d in ("a.com", "com", "org", "A.COM", "co.uk")] + [("prefix", p) for p in ("a.com/p", "www.a.com/p/q", "b.org/P")]
    entries = []
    for _ in range(160):
        kind, p = r.choice(patterns)
        entries.append((r.choice(["spam", "adult"]), kind, p, r.choice(["add", "add", "remove"]), day(r.randint(-300, 900))))
    entries += [entries[0], (None, "host", "a.com", "add", day(0)), ("spam", "host", None, "add", day(0)), ("spam", "host", "a.com", "add", None)]
    assert run(spark, rows, captures, entries) == brute(captures, entries)


def test_interval_ends_are_exclusive(spark, rows):
    entries = [("l", "host", "a.com", "add", day(10)), ("l", "host", "a.com", "remove", day(20)), ("l", "host", "a.com", "add", day(20)), ("l", "host", "a.com", "remove", day(21))]
    captures = [(k, "http://a.com/", day(k)) for k in (9, 10, 19, 20, 21)]
    assert [(i, b) for i, _, b, *_ in run(spark, rows, captures, entries)] == [(10, True), (19, True), (20, False), (21, False), (9, False)]


@pytest.mark.parametrize("captures, entries", [([], []), ([(1, "http://a.com/", day(1))], []), ([], [("l", "host", "a.com", "add", day(1))]), ([(1, "http://a.com", None)], [("l", "host", "a.com", "add", day(1))])])
def test_empty_tables(spark, rows, captures, entries):
    assert run(spark, rows, captures, entries) == brute(captures, entries)


def test_extra_columns(spark):
    c = spark.createDataFrame([(1, "http://a.com/", day(3), "x", "y")], "page_id long, url string, fetched_on date, month string, pattern string")
    e = spark.createDataFrame([("l", "host", "a.com", "add", day(1), 5)], "list string, kind string, pattern string, action string, dated date, month int")
    got = U.filter_captures(c, e).first()
    assert (got["month"], got["pattern"], got["blocked"]) == ("x", "y", True)


def test_long_host_and_path(spark, rows):
    captures = [(1, "http://" + "a." * 3000 + "com/" + "p/" * 3000, day(3))]
    entries = [("l", "domain", "com", "add", day(1)), ("l", "prefix", "z.com/p/q", "add", day(1))]
    assert run(spark, rows, captures, entries)[0][2:4] == (True, "l")


@pytest.mark.parametrize("kind, pattern", [("prefix", p) for p in ("Example.com/ads/", "example.com//ads", "example.com:8080/ads", "example.com./ads//")] + [("host", "Example.com."), ("host", "EXAMPLE.com:80"), ("domain", "Com.")])
def test_patterns_are_read_like_captures(spark, rows, kind, pattern):
    captures = [(1, "http://example.com/ads/x", day(3)), (2, "https://EXAMPLE.com.:443//ads", day(3)), (3, "http://example.org/ads", day(3)), (4, "http://example.com/Ads", day(3))]
    got = [b for _, _, b, *_ in run(spark, rows, captures, [("l", kind, pattern, "add", day(1))])]
    assert got == [True, True, False, kind != "prefix"]


def test_spellings_of_a_pattern_are_one_pattern(spark, rows):
    entries = [("l", "prefix", "Example.com/ads/", "add", day(1)), ("l", "prefix", "example.com//ads", "remove", day(3)), ("l", "prefix", "example.com/", "add", day(1))]
    got = run(spark, rows, [(k, "http://example.com/ads/x", day(k)) for k in (2, 3)], entries)
    assert {i: b for i, _, b, *_ in got} == {2: True, 3: False}


def test_a_far_capture_makes_no_rows_for_the_months_between(spark, rows, monkeypatch):
    """One capture of the year 9999 and open entries: intervals meet the months that have captures."""
    captures = [(k, f"http://h{k % 50}.com/p", day(k % 90)) for k in range(300)] + [(999, "http://h3.com/", dt.date(9999, 1, 1))]
    entries = [("adult", "host", f"h{k}.com", "add", day(k % 40)) for k in range(50)]
    made = []
    plain = U.written

    def counted(df, name):
        out = plain(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(U, "written", counted)
    assert run(spark, rows, captures, entries) == brute(captures, entries)
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_on date")
    e = spark.createDataFrame(entries, "list string, kind string, pattern string, action string, dated date")
    assert U.monthly_intervals(U.intervals(e), U.captured_months(c, "fetched_on")).count() <= 50 * 5


def test_columns_named_as_added_ones_are_replaced(spark):
    c = spark.createDataFrame([(1, "http://a.com/", day(3), "x", "y")], "page_id long, url string, fetched_on date, lists string, note string")
    e = spark.createDataFrame([("spam", "host", "a.com", "add", day(1))], "list string, kind string, pattern string, action string, dated date")
    (row,) = U.filter_captures(c, e).collect()
    assert row["lists"] == "spam" and row["note"] == "y"
