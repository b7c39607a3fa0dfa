import random

from ledgerline.llm import url_filters
from pyspark.sql import functions as F

ENTRIES = "list string, kind string, pattern string, action string, effective_at long, day int, url string"
CAPTURES = "page_id long, url string, fetched_at long, id string, list string, day int"


def entries(spark, rows):
    return spark.createDataFrame([(*row, 1, "u") for row in rows], ENTRIES).repartition(3)


def captures(spark, rows):
    return spark.createDataFrame([(*row, "i", "l", 2) for row in rows], CAPTURES).repartition(3)


def keys(url):
    scheme, _, rest = (url or "").partition("://")
    if not rest:
        return set()
    site, path = (rest.split("/", 1) + [""])[:2]
    host, path = site.lower(), "/" + path.split("?")[0].split("#")[0]
    labels, steps = host.split("."), path.split("/")
    found = {("host", host), ("prefix", host + path)} | {("domain", ".".join(labels[i:])) for i in range(len(labels))}
    return found | {("prefix", host + "/".join(steps[:i]) + "/") for i in range(1, len(steps))}


def brute(url, at, rows):
    found = 0
    for key in {r[:3] for r in rows if None not in r}:
        past = [(r[4], r[3] == "add") for r in rows if r[:3] == key and None not in r and at is not None and r[4] <= at]
        found += bool(past) and max(past)[1] and key[1:] in keys(url)
    return found


def test_captures_meet_what_was_valid(spark):
    rng = random.Random(1)
    hosts = ["a.example.com", "b.example.com", "example.com", "Other.org"]
    urls = [f"https://{h}{p}" for h in hosts for p in ("", "/", "/x", "/x/", "/x/y?q=1", "/x/y/z#f")] + [None, "", "/relative", "no url"]
    patterns = sorted({k for u in urls for k in keys(u)})
    day = 86_400
    listed = [(rng.choice("ab"), *rng.choice(patterns), rng.choice(["add", "add", "remove"]), rng.choice([rng.randrange(6 * day), rng.randrange(6) * day])) for _ in range(400)]
    listed += [(None, "host", "example.com", "add", 1), ("a", "host", "example.com", None, 1), ("a", "host", "example.com", "add", None), *listed[:20]]
    fetched = [(rng.choice([i, None]), rng.choice(urls), rng.choice([rng.randrange(-day, 7 * day), rng.randrange(7) * day, None])) for i in range(300)]
    fetched += fetched[:10]
    found = url_filters.evaluate(captures(spark, fetched), entries(spark, listed)).collect()
    expected = [(p, u, t, brute(u, t, listed)) for p, u, t in fetched]
    assert sorted(((r["page_id"], r["url"], r["seconds"], r["n_active"]) for r in found), key=repr) == sorted(expected, key=repr)
    assert all(r["blocked"] == (r["n_active"] > 0) for r in found) and sum(r["blocked"] for r in found) > 50


def test_allow_lists_go_first(spark):
    listed = [("block", "domain", "x.com", "add", 0), ("allow", "host", "good.x.com", "add", 10), ("allow", "host", "good.x.com", "remove", 20)]
    fetched = [(i, "http://good.x.com/p", t) for i, t in enumerate([-1, 5, 15, 20])]
    found = url_filters.evaluate(captures(spark, fetched), entries(spark, listed), allow_lists=["allow"]).orderBy("page_id").collect()
    assert [(r["blocked"], r["allowed"]) for r in found] == [(False, False), (True, False), (False, True), (True, False)]


def test_intervals(spark):
    listed = [("a", "host", "h", action, at) for action, at in [("add", 5), ("remove", 5), ("add", 7), ("remove", 90_000), ("add", 400_000)]]
    found = url_filters.validity_intervals(entries(spark, listed)).orderBy("valid_from")
    assert [(r["valid_from"], r["valid_to"]) for r in found.collect()] == [(5, 7), (7, 90_000), (400_000, url_filters.FOREVER)]


def test_empty_tables(spark):
    one = captures(spark, [(1, "http://h/", 1)])
    assert [r["blocked"] for r in url_filters.evaluate(one, entries(spark, []).where(F.lit(False))).collect()] == [False]
    assert url_filters.evaluate(one.where("page_id < 0"), entries(spark, [("a", "host", "h", "add", 0)])).count() == 0
