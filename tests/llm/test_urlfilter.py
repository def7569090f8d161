import random
import re

import pytest

from emberlake.llm import urlfilter
from emberlake.llm.urlfilter import PAGE_RULES, Rule, ShiftAnd


def test_automaton_equals_regular_expressions():
    rng = random.Random(3)
    globs = ["".join(rng.choice("ab/*%?.") for _ in range(rng.randint(0, 9))) for _ in range(60)]
    texts = ["".join(rng.choice("ab/.") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    got = ShiftAnd(globs).run([t.encode() for t in texts])
    for k, g in enumerate(globs):
        pattern = re.compile(urlfilter._like(g), re.DOTALL)
        assert [bool(pattern.fullmatch(t)) for t in texts] == got[:, k].tolist(), g


def test_states_cross_word_borders():
    long = "x" * 150
    hits = ShiftAnd([long, long[:-1] + "y", "*" + long]).run([long.encode(), (long + "x").encode()])
    assert hits.tolist() == [[True, False, True], [False, False, True]]


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        (None, "", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("http://Example.COM/en/x?q#f", "example.com", "/en/x", "example.com/en/", "block"),
        ("http://www.example.com/en/x", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("http://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://a.com", "a.com", "", None, "allow"),
        ("http://a.net/es/1://x", "a.net", "/es/1://x", "net/es/", "block"),
        ("http://a.org/x.com/", "a.org", "/x.com/", None, "allow"),
        ("http://spam.a.org/x", "spam.a.org", "/x", None, "block"),
        ("http://10.0.0.1/x", "10.0.0.1", "/x", None, "block"),
        ("http://é.org/ü?x", "é.org", "/ü", None, "allow"),
        ("http://a.com/" + "y" * 20_000, "a.com", "/" + "y" * 20_000, "com/", "allow"),
    ],
)
def test_judgement(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "old")], "page_id long, url string, verdict string")
    r = urlfilter.judged(df, PAGE_RULES).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"], r["url"]) == (host, path, rule, verdict, url)


def test_empty_table_repeated_rows_and_no_rules(spark):
    df = spark.createDataFrame([(1, "http://a.com/")] * 3, "page_id long, url string")
    assert urlfilter.judged(df.where("false"), PAGE_RULES).count() == 0
    assert [r["rule"] for r in urlfilter.judged(df, PAGE_RULES).collect()] == ["com/"] * 3
    assert urlfilter.judged(df, [], blocked=()).first()["verdict"] == "allow"


def test_equally_long_rules_go_to_the_longer_host(spark):
    rules = [Rule("block", "com", "/ab/"), Rule("allow", "ab.com", "/")]
    df = spark.createDataFrame([("http://ab.com/ab/",)], "url string")
    assert urlfilter.judged(df, rules).first()["rule"] == "ab.com/"
