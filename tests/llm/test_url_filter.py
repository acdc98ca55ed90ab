import re

from glenfare.llm import url_filter as U
from helpers import SF, as_rows

COLS = ["page_id", "host", "path", "rule", "verdict"]


def brute(page_id, url, rules=U.RULES):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), v == "block", h + p, v) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return page_id, host, path, best[2], best[3]


def test_query_matches_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = as_rows(U.op8_url_filter(spark, SF), *COLS)
    assert got == sorted([brute(r["page_id"], r["url"]) for r in pages], key=repr)


URLS = ["http://a.ORG/", "http://a.org", "https://example.org/es/x?y#z", "https://WWW.Example.org/en/12", "ftp://example.org/en/1",
        "http://badexample.org/es/", "http://x.com/fr/", "http://x.com/fr", "http://com/de/1", None, "", "no scheme", "://",
        "http://a.org?/de/", "http://a..org/x", "http://example.org/es/", "http://x.com/de/?a=://b.org/", "http://example.org/en/1\n2",
        "http://x.com/FR/", "http://" + "a." * 300 + "com/de/" + "y" * 5000]


def test_edges(spark):
    rows = [(k, u, "clash", "clash") for k, u in enumerate(URLS * 2)] + [(None, "http://a.org/", "", ""), (3, URLS[3], "", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, rule string, host string")
    got = as_rows(U.url_verdicts(pages, U.rule_table(spark)), *COLS)
    assert got == sorted([brute(r[0], r[1]) for r in rows], key=repr)
    assert U.url_verdicts(pages.limit(0), U.rule_table(spark)).count() == 0
    none = U.url_verdicts(pages, U.rule_table(spark).limit(0))
    assert {r["verdict"] for r in none.collect()} == {"allow"} and none.count() == len(rows)


def test_short_hash_collisions_and_ties(spark, monkeypatch):
    monkeypatch.setattr(U, "PREFIX_HEX", 1)  # nearly every short hash meets a rule
    rules = U.RULES + [("allow", "Example.org", "/es/"), ("block", "net", "/")]
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string")
    got = as_rows(U.url_verdicts(pages, U.rule_table(spark, rules)), *COLS)
    exp = [(v, h.lower(), p) for v, h, p in rules]
    assert got == sorted([brute(k, u, exp) for k, u in enumerate(URLS)], key=repr)


def test_no_python_on_the_main_path(spark):
    plan = U.op8_url_filter(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_a_host_of_many_labels(spark):
    """Only the suffixes that a rule could have are built: a 5 MB host is one short row."""
    from glenfare.llm import url_filter
    host = "a." * 2_500_000 + "example.org"
    pages = spark.createDataFrame([(1, f"https://{host}/es/x"), (2, "https://org/"), (3, "https://x.fr.com/fr/")], "page_id bigint, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.url_verdicts(pages, url_filter.rule_table(spark)).select("page_id", "rule", "verdict").collect()}
    assert got == {1: ("example.org/es/", "block"), 2: ("org/", "allow"), 3: ("com/fr/", "allow")}
