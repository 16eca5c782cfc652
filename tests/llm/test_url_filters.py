import random
import re

from millrace.llm.url_filters import RULES, rule_table, url_filters


def judge(url, rules=RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_equals_brute_force(spark):
    rnd = random.Random(1)
    hosts = ["example.com", "a.EXAMPLE.com", "com", "x.net", "example.net", "b.a.example.net", "y.org", "org.com", "mycom", "", "a..com", ".com"]
    paths = ["/en/7", "/en/", "/en", "/de/8/x", "/de/9", "/es/é?q=/en/", "", "?x", "#/en/", "/EN/7", "/es/", "//en/"]
    urls = [rnd.choice(["http://", "https://", "://", "x", ""]) + rnd.choice(hosts) + rnd.choice(paths) for _ in range(400)] + [None, "", "a://b://c.com/en/"]
    rows = list(enumerate(urls)) * 2
    pages = spark.createDataFrame([(i, u, "h", "r", "p") for i, u in rows], "page_id long, url string, host string, rule string, path string")
    got = url_filters(pages, rule_table(spark)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *judge(u)) for i, u in rows), key=str)
    assert {r.rule for r in got} == {h + p for h, p, _ in RULES} | {None}


def test_plan_has_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string").coalesce(1)
    plan = url_filters(pages.where("page_id > 0"), rule_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_no_rules_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string")
    assert [tuple(r) for r in url_filters(pages, rule_table(spark).where("false")).collect()] == [(1, "a.com", "/en/", None, "allow")]
    assert url_filters(pages.where("false"), rule_table(spark)).collect() == []
