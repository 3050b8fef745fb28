import datetime as dt

from tideline.llm import url_lists

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(n)


def run(spark, captures, events):
    c = spark.createDataFrame(captures, "page_id long, url string, fetched date, key string, rule string")
    e = spark.createDataFrame(events, "key string, verdict string, action string, at date")
    return {(r.page_id, r.fetched): r for r in url_lists.filter_urls(c, e).collect()}


def brute(url, fetched, events):
    host = url.split("://")[1].split("/")[0]
    path = url.split("://")[1][len(host) :]
    keys = ["d:" + ".".join(host.split(".")[i:]) for i in range(host.count(".") + 1)]
    parts = path.split("/")
    keys += ["p:" + host + "/".join(parts[:i]) for i in range(2, len(parts) + 1)]
    active = []
    for k in set(keys):
        before = sorted((e[3], e[2], e[1]) for e in events if e[0] == k and e[3] is not None and e[3] <= fetched)
        if before and before[-1][1] == "add":
            active.append((len(k), k, before[-1][2]))
    return max(active, default=None)


def test_equals_a_loop(spark):
    events = [
        ("d:a.org", "block", "add", day(3)), ("d:a.org", "block", "remove", day(6)), ("d:a.org", "block", "add", day(9)), ("d:x.a.org", "allow", "add", day(4)), ("d:x.a.org", "allow", "remove", day(4)),
        ("p:x.a.org/en", "allow", "add", day(5)), ("p:x.a.org/en/bad", "block", "add", day(7)), ("d:org", "block", "add", day(11)), (None, "block", "add", day(1)), ("d:b.org", "block", "add", None),
    ]
    urls = ["http://x.a.org/en/bad/1", "http://a.org", "https://b.org/q", "http://x.a.org/en"]
    captures = [(i, u, day(n), "k", "r") for i, u in enumerate(urls) for n in range(13)]
    got = run(spark, captures, events)
    for i, u, f, *_ in captures:
        want = brute(u, f, events)
        r = got[(i, f)]
        assert (r.rule_key, r.blocked) == ((want[1], want[2] == "block") if want else (None, False)), (u, f)


def test_odd_urls_and_repeats(spark):
    events = [("d:a.org", "block", "add", day(0))]
    captures = [(1, None, day(1), "", ""), (2, "nonsense", day(1), "", ""), (3, "HTTP://User:pw@A.ORG.:80/x?y#z", day(1), "", ""), (3, "HTTP://User:pw@A.ORG.:80/x?y#z", day(1), "", ""), (4, "http://a.org", None, "", ""), (None, "http://a.org", day(1), "", "")]
    got = run(spark, captures, events)
    assert len(got) == 5
    assert got[(3, day(1))].blocked and got[(3, day(1))].n_captures == 2 and got[(3, day(1))].host == "a.org"
    assert got[(None, day(1))].blocked and not got[(4, None)].blocked and not got[(1, day(1))].blocked


def test_empty_tables(spark):
    assert run(spark, [], [("d:a.org", "block", "add", day(0))]) == {}
    assert not run(spark, [(1, "http://a.org", day(1), "", "")], [])[(1, day(1))].blocked


def test_addresses_and_very_long_urls(spark):
    events = [("d:[2001:db8::1]", "block", "add", day(1)), ("d:10.0.0.1", "block", "add", day(1)), ("d:0.1", "block", "add", day(1)), ("p:a.org/x", "block", "add", day(1)), ("d:org", "allow", "add", day(1))]
    urls = ["http://u@[2001:DB8::1]:80/p", "http://10.0.0.1/", "http://10.0.0.2/", "http://a.org/x" + "/y" * 200_000, "http://" + "b." * 100_000 + "org/"]
    got = run(spark, [(i, u, day(2), "k", "r") for i, u in enumerate(urls)], events)
    assert [got[i, day(2)].rule_key for i in range(5)] == ["d:[2001:db8::1]", "d:10.0.0.1", None, "p:a.org/x", "d:org"]
    assert got[0, day(2)].host == "[2001:db8::1]"
