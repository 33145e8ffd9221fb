import datetime

from tidemark.llm import url_filters as uf

D = datetime.datetime
EVENTS = "kind string, pattern string, action string, listed_at timestamp_ntz"


def brute(captures, events):
    log = {}
    for k, p, a, t in events:
        if None not in (k, p, a, t) and a in ("add", "remove"):
            at = log.setdefault((k, p), {})
            at[t] = max(at.get(t, a), a)
    out = []
    for i, url, at in captures:
        keys = set()
        if url and "://" in url and at:
            rest = url.split("://", 1)[1]
            host = rest.split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0].lower()
            path = "/".join(rest.split("?")[0].split("#")[0].split("/")[1:])
            labels, segs = host.split("."), [s for s in path.split("/") if s]
            keys |= {("domain", ".".join(labels[k:])) for k in range(len(labels))} | {("host", host)}
            keys |= {("prefix", host + "/" + "/".join(segs[:k])) for k in range(len(segs) + 1)}
        n = 0
        for k in keys:
            past = [t for t in log.get(k, {}) if at and t <= at]
            n += bool(past) and log[k][max(past)] == "add"
        out.append((i, n))
    return sorted(out)


def test_against_brute_force(spark):
    events = [
        ("domain", "bad.com", "add", D(2024, 1, 5)), ("domain", "bad.com", "remove", D(2024, 2, 1)), ("domain", "bad.com", "add", D(2024, 6, 1)),
        ("host", "a.b.c.d.e.f.org", "add", D(2023, 1, 1)), ("domain", "d.e.f.org", "add", D(2024, 3, 1)), ("prefix", "ok.net/x/y/z/w/v", "add", D(2024, 1, 1)),
        ("prefix", "ok.net/", "add", D(2024, 9, 1)), ("host", "ok.net", "add", D(2024, 5, 1)), ("host", "ok.net", "remove", D(2024, 5, 1)), ("host", None, "add", D(2024, 1, 1)),
        ("host", "m.bad.com", "add", D(2024, 1, 1)), ("host", "m.bad.com", "add", D(2024, 1, 9)), ("host", "m.bad.com", "remove", D(2024, 1, 20)), ("domain", "bad.com", "explode", D(2024, 7, 1)),
        ("domain", "zip", "add", D(2024, 2, 1)), ("domain", "localhost", "add", D(2024, 1, 1)), ("host", "intranet", "add", D(2024, 1, 1)),
    ]
    urls = ["http://bad.com/", "https://m.bad.com:8080/p?q#f", "http://user@M.BAD.com/x", "http://notbad.com", "http://a.b.c.d.e.f.org/1", "http://ok.net/x/y/z/w/v/u", "http://ok.net", "nonsense", None, "", "http://x.y.zip/a", "http://localhost:80/", "http://intranet", "http://zip"]
    days = [D(2023, 12, 31), D(2024, 1, 5), D(2024, 1, 19, 23), D(2024, 1, 31, 23, 59), D(2024, 2, 1), D(2024, 5, 1), D(2024, 6, 1), D(2024, 12, 31), None]
    captures = [(i * 100 + j, u, t) for i, u in enumerate(urls) for j, t in enumerate(days)]
    df = spark.createDataFrame([(*c, "m") for c in [*captures, captures[3]]], "id long, url string, fetched_at timestamp_ntz, month string")
    got = uf.blocked(df, spark.createDataFrame(events, EVENTS)).collect()
    assert sorted((x.id, x.n_entries or 0) for x in got) == brute([*captures, captures[3]], events)


def test_empty(spark):
    events = spark.createDataFrame([], EVENTS)
    caps = spark.createDataFrame([(1, "http://a.com", D(2024, 1, 1))], "id long, url string, fetched_at timestamp_ntz")
    assert [x.n_entries for x in uf.blocked(caps, events).collect()] == [None]
    assert uf.blocked(caps.limit(0), events).count() == 0


def test_clashing_columns_and_very_long_urls(spark):
    """Columns named like the answer's are replaced, all others kept; a url of 64 kB makes only keys that can match."""
    long = "http://ok.net/" + "/".join("ab" for _ in range(30_000))
    rows = [(1, long, D(2024, 3, 1), 7, 8, 9, 10), (2, "http://b.org", D(2024, 3, 1), 7, 8, 9, 10)]
    caps = spark.createDataFrame(rows, "id long, url string, fetched_at timestamp_ntz, n_entries int, First_Entry int, `a.b` int, asked_url int")
    events = spark.createDataFrame([("prefix", "ok.net/ab/ab/ab", "add", D(2024, 1, 1)), ("prefix", "ok.net/ab/x", "add", D(2024, 1, 1))], EVENTS)
    out = uf.blocked(caps, events)
    assert out.columns == ["id", "url", "fetched_at", "a.b", "asked_url", "n_entries", "first_entry", "listed_from"]
    assert sorted((x.id, x["a.b"], x.asked_url, x.n_entries, x.first_entry) for x in out.collect()) == [(1, 9, 10, 1, "prefix:ok.net/ab/ab/ab"), (2, 9, 10, None, None)]
    from pyspark.sql import functions as F

    assert caps.select(F.size(uf.keys_of(F.col("url"), 2, 3)).alias("n")).collect()[0].n == 2 + 1 + 4
