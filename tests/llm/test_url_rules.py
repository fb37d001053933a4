import __spark_entry__ as entry
from pyspark.sql import functions as F

from delaylens.llm.components import components
from delaylens.llm.url_rules import judge_urls, without_dots
from tests.conftest import SMALL
from tests.harness import differences


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def result(df):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.collect()}


def test_same_as_sql(spark, con):
    assert differences(entry.queries()["op8_url_rules"](spark, SMALL), con, entry.oracle_sql()["op8_url_rules"]) == []


def test_rules_and_odd_urls(spark):
    got = result(judge_urls(pages(spark, [
        (1, "http://A.Example.COM/en/x?q#f", None), (2, "https://www.example.com/en/", ""), (3, "x://b.net/es/1", ""), (4, "x://bnet/fr/", ""),
        (5, "http://com", ""), (6, None, None), (7, "no scheme", ""), (8, "a://b.com/x://c", ""), (9, "http://xexample.com/en/", ""),
        (10, "http://example.com?en/", ""), (11, "http:///path", "")])))
    assert got == {
        1: ("a.example.com", "/en/x", "example.com/en/", "block"), 2: ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        3: ("b.net", "/es/1", "net/es/", "block"), 4: ("bnet", "/fr/", None, "allow"), 5: ("com", "", None, "allow"),
        6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("b.com", "/x://c", "com/", "allow"),
        9: ("xexample.com", "/en/", "com/", "allow"), 10: ("example.com", "", None, "allow"), 11: ("", "/path", None, "allow")}
    assert judge_urls(pages(spark, [])).count() == 0


def test_aliases_take_the_block(spark):
    canonical = '<html><head><LINK href="%s" rel=canonical></head>'
    refresh = "<meta http-equiv='refresh' content='0; url=%s'>"
    rows = [
        (1, "http://a.org/1", canonical % "https://b.org/2#x=1"), (2, "http://b.org/2", refresh % "//c.net/es/3"), (3, "http://c.net/es/3", None),
        (4, "http://d.com/4", canonical % "http://c.net/es/3#top"), (5, "http://e.org/dir/5", canonical % "6"), (6, "http://e.org/dir/6", ""),
        (7, "http://a.org/1#again", ""), (8, "http://f.org", canonical % "/8"), (9, "http://g.org/9", canonical % "http://never.net/fr/seen"), (3, "http://c.net/es/3", None)]
    df = pages(spark, rows).withColumn("host", F.lit("h")).withColumn("node", F.lit("n")).withColumn("verdict", F.lit(1))
    got = judge_urls(df)
    assert {(r.page_id, r.verdict) for r in got.collect()} == {
        (1, "block"), (2, "block"), (3, "block"), (4, "allow"), (5, "allow"), (6, "allow"), (7, "block"), (8, "allow"), (9, "block")}
    assert got.count() == len(rows)
    alias = {r.page_id: r.alias_of for r in got.collect()}
    assert alias[5] == alias[6] == "e.org/dir/5" and alias[1] == alias[4] == "a.org/1"


def test_query_strings_and_dots_name_pages(spark):
    canonical = '<link rel="canonical" href="%s">'
    rows = [
        (1, "http://a.org/view?id=1", canonical % "http://b.net/es/1"), (2, "http://a.org/view?id=2", ""), (3, "http://a.org/view?id=1#top", ""),
        (4, "http://a.org/d/e/4", canonical % "../../view?id=1"), (5, "http://a.org/d/x/../5", canonical % "./../view?id=1"),
        (6, "http://a.org/d/5", ""), (7, "http://a.org/view", canonical % "?id=1"), (8, "http://a.org/view?", ""),
        (9, "http://c.org/9?q", canonical % "#part"), (10, "http://c.org/..a/b", canonical % "http://c.org/../../9?q"),
        (11, "http://e.org/x", canonical % "http://d.net/?u=/fr/")]
    got = judge_urls(pages(spark, rows)).collect()
    assert {r.page_id: r.verdict for r in got} == {
        1: "block", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "block", 7: "block", 8: "block", 9: "allow", 10: "allow", 11: "allow"}
    alias = {r.page_id: r.alias_of for r in got}
    assert alias[2] == "a.org/view?id=2" and alias[9] == alias[10] == "c.org/..a/b" and alias[11] == "d.net/?u=/fr/"


def test_dots_are_resolved(spark):
    paths = {"/a/../b": "/b", "/a/./b": "/a/b", "/a/..": "/", "/../..": "/", "/a/b/..": "/a/", "/a/b/.": "/a/b/", "/a..b/.c": "/a..b/.c",
             "//a/../b": "//b", "/": "/", "": ""}
    df = spark.createDataFrame([(k,) for k in paths], "p string")
    assert {r.p: r.q for r in df.select("p", without_dots(F.col("p")).alias("q")).collect()} == paths


def test_components_of_chains_stars_and_repeats(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (140, 139), (139, 140), (500, 400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 141)} | {400: 400, 500: 400}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
