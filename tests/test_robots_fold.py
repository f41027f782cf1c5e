"""Robots documents read in one row: patterns against regular expressions, groups, and the shape of the plan."""

import random
import re

from pyspark.sql import functions as F

from checks.source_queries import QUERIES
from listingspark.operators import robots

SF = "/root/testdata/sf0.001"


def test_patterns_match_like_regular_expressions(spark):
    r, rows = random.Random(3), []
    for _ in range(1500):
        pattern = "/" + "".join(r.choice(["a", "b", "*", "/", "ab", "?", ".", "$" if r.random() < 0.3 else "a"]) for _ in range(r.randrange(6))) + r.choice(["", "", "$", "*", "*$"])
        rows.append((pattern, "/" + "".join(r.choice(["a", "b", "/", "ab", "?", ".", "$", "\n"]) for _ in range(r.randrange(9)))))
    df = spark.createDataFrame(rows, "pattern string, path string")
    got = df.select("pattern", "path", robots._pattern_hit(F.col("pattern"), F.col("path")).alias("hit")).collect()
    hits = 0
    for pattern, path, hit in got:
        body = pattern[:-1] if pattern.endswith("$") else pattern
        regex = ".*".join(map(re.escape, body.split("*"))) + (r"\Z" if pattern.endswith("$") else "")
        assert hit == (re.match(regex, path, re.S) is not None), (pattern, path)
        hits += hit
    assert 200 < hits < 1400


def test_groups_of_a_document(spark):
    body = "Disallow: /early\nUser-agent: A\nuser-agent: b\nCrawl-delay: x\ncrawl-delay: 2\nDisallow: /one\nUSER-AGENT: C # c\n\nSitemap: u\nAllow: rel\nUser-agent: d\r\nUser-agent:\nAllow: /two*$\rcrawl-delay: -1"
    docs = spark.createDataFrame([("o", body), ("none", None), ("blank", "")], "origin string, body string")
    got = [tuple(r) for r in robots.robots_rules(docs).orderBy("origin", "group_no", "rule_no").collect()]
    assert got == [("o", 1, ["a", "b"], 2.0, 0, "disallow", "/one", 4), ("o", 2, ["c"], None, None, None, None, None), ("o", 3, ["d"], None, 0, "allow", "/two*$", 6)]


def test_a_long_document_stays_in_its_row(spark):
    body = "\n".join(f"User-agent: bot{i}\nDisallow: /{i}/" for i in range(3000)) + "\nUser-agent: *\nDisallow: /"
    docs, urls = spark.createDataFrame([("https://x.example", body)], "origin string, body string"), spark.createDataFrame([("https://x.example/77/a",)], "url string")
    assert robots.robots_verdicts(urls, docs, "MyBot77").first().evidence == "Disallow: /77/ matched /77/a"
    assert robots.robots_verdicts(urls, docs, "other").first().verdict == "disallowed"


def test_gate_has_one_join_and_no_window(spark):
    plan = QUERIES["robots_gate"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    assert sum(line.lstrip(" :+-").startswith("Join") for line in plan.split("\n")) <= 2
