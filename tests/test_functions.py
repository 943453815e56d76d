from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import kv, scalar


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_timestamps(spark):
    given = ["2024-05-01T10:11:12.123456+01:00", '"2024-05-01T10:11:12+00:00"', "1 May 2024 10:30", "1 May 2024 3:30pm", "2024-05-01", "x", None, "12 January 2024 9:05AM"]
    found = values(spark, given, scalar.string_to_timestamp("x"))
    assert found == [datetime(2024, 5, 1, 9, 11, 12, 123456), datetime(2024, 5, 1, 10, 11, 12), datetime(2024, 5, 1, 9, 30), datetime(2024, 5, 1, 14, 30), None, None, None, datetime(2024, 1, 12, 9, 5)]


def test_dates(spark):
    given = ["2024-05-01", "1 May 2024", "2024-05-01T23:30:00-02:00", "", None]
    assert values(spark, given, scalar.string_to_date("x")) == [date(2024, 5, 1), date(2024, 5, 1), date(2024, 5, 2), None, None]


def test_int_arrays(spark):
    assert values(spark, ["[3,75,2,1]", "[]", "[1,x,2]", None], scalar.string_to_int_array("x")) == [[3, 75, 2, 1], [], [1, 2], []]


def test_casts_that_never_fail(spark):
    assert values(spark, ["TRUE", "false", "yes", "1", "t", None], scalar.safe_bool("x")) == [True, False, None, None, None, None]
    assert values(spark, ["12", "12.5", " 7 ", "x", "99999999999999999999"], scalar.safe_int("x")) == [12, None, 7, None, None]
    assert values(spark, ["1.5", "1d", "1e3", ".5", "x"], scalar.safe_float("x")) == [1.5, None, 1000.0, 0.5, None]


def test_decode_uri(spark):
    given = ["a%20b", "%C3%A9", "50%", "a+b", "%FF", "%e2%82%AC!", None]
    assert values(spark, given, scalar.decode_uri("x")) == ["a b", "é", "50", "a+b", "�", "€!", None]


def test_standardise_path_query(spark):
    given = ["/a", "/a?", "/a?b=2&a=1&a=1", "/a?x?y", None]
    assert values(spark, given, scalar.standardise_path_query("x")) == ["/a", "/a?", "/a?a=1&b=2", "/a?x", None]


def test_device_category(spark):
    given = ["Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36", "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) Version/17.0 Safari/604.1", "Googlebot/2.1", None, "SomethingElse"]
    assert values(spark, given, scalar.device_category("x")) == ["desktop", "mobile", "bot", "unknown", "unknown"]


def payload(spark, entries):
    return spark.createDataFrame([(entries,)], f"d {kv.KV}")


@pytest.mark.parametrize(
    ("entries", "kind", "is_array", "wanted"),
    [
        ([("a", ["1"])], "string", False, "1"), ([("a", ["1", "2"])], "string", False, "1,2"), ([("a", ["1"]), ("a", ["2"])], "string", False, "1,2"), ([("a", [""])], "string", False, None),
        ([("b", ["1"])], "string", False, None), ([("a", ["7"])], "integer", False, 7), ([("a", ["7", "8"])], "integer", False, None), ([("b", ["1"])], "string", True, []),
        ([("a", ["1"]), ("a", ["2", "3"])], "string", True, ["1", "2", "3"]), (None, "string", False, None), ([("a", ["1", "x"])], "integer", True, [1, None]), ([("a", ["true"])], "boolean", False, True),
    ],
)
def test_extract(spark, entries, kind, is_array, wanted):
    assert payload(spark, entries).select(kv.extract("d", "a", kind, is_array)).first()[0] == wanted


def test_has_and_replace_key(spark):
    one, two = payload(spark, [("a", ["1"]), ("b", ["2"])]), payload(spark, [("a", ["1"]), ("a", ["2"])])
    assert one.select(kv.has_key("d", "a"), kv.has_key("d", "c")).first()[:] == (True, False)
    assert two.select(kv.has_key("d", "a")).first()[0] is False
    assert payload(spark, None).select(kv.has_key("d", "a")).first()[0] is False
    assert [(e.key, e.value) for e in one.select(kv.replace_key("d", "a", "9")).first()[0]] == [("b", ["2"]), ("a", ["9"])]


@pytest.mark.parametrize(
    ("a", "b", "wanted"),
    [
        ([], [], True), (None, [], True), ([("a", "1"), ("b", "2")], [("b", "2"), ("a", "1")], True), ([("a", "1")], [("a", "2")], False), ([("a", "1")], [("b", "1")], False), ([("a", "1")], [], False),
        ([("a", "1"), ("a", "1")], [("a", "1")], True), ([("a", "1"), ("a", "2")], [("a", "2"), ("a", "1")], True), ([("a", "1"), ("a", "1"), ("a", "2")], [("a", "1"), ("a", "2")], False),
        ([("a", None)], [("a", "5")], True), ([(None, "1")], [(None, "1")], False),
    ],
)
def test_pairs_equal(spark, a, b, wanted):
    kind = "array<struct<key:string,value:string>>"
    assert spark.createDataFrame([(a, b)], f"a {kind}, b {kind}").select(kv.pairs_equal("a", "b")).first()[0] is wanted


def test_medium(spark):
    rows = [("https://www.own.org/x", None, None), ("https://www.google.com/s", None, None), ("https://t.co/x", None, None), (None, "cpc", None), ("https://else.org/", None, None), (None, None, None), (None, None, "g1"), ("https://else.org", "email", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, r string, m string, g string")
    found = scalar.traffic_medium(F.col("r"), F.get(F.split("r", "/"), F.lit(2)), {"utm_medium": F.col("m"), "gclid": F.col("g")}, "www.own.org")
    assert [r[0] for r in df.orderBy("i").select(found).collect()] == [None, "Organic", "Social", "PPC", "Referral", "Direct or unknown", "PPC", "Email"]


AGENTS = [
    ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36", "pc", "Chrome", "120.0.0.0", "Windows", "10.0"),
    ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/120.0.0.0 Safari/537.36 Edg/120.0.2210.91", "pc", "Edge", "120.0.2210.91", "Windows", "10.0"),
    ("Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0", "pc", "Firefox", "121.0", "Linux", "unknown"),
    ("Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.1 Safari/605.1.15", "pc", "Safari", "17.1", "Mac OSX", "10.15.7"),
    ("Mozilla/5.0 (iPhone; CPU iPhone OS 17_1_2 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) CriOS/120.0.6099.50 Mobile/15E148 Safari/604.1", "smartphone", "Chrome", "120.0.6099.50", "iPhone", "17.1.2"),
    ("Mozilla/5.0 (iPad; CPU OS 16_6 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/16.6 Mobile/15E148 Safari/604.1", "smartphone", "Safari", "16.6", "iPad", "16.6"),
    ("Mozilla/5.0 (Linux; Android 13; SM-S901B) AppleWebKit/537.36 (KHTML, like Gecko) SamsungBrowser/23.0 Chrome/115.0.0.0 Mobile Safari/537.36", "smartphone", "SamsungBrowser", "23.0", "Android", "13"),
    ("Mozilla/5.0 (X11; CrOS x86_64 14541.0.0) AppleWebKit/537.36 Chrome/119.0.0.0 Safari/537.36", "pc", "Chrome", "119.0.0.0", "ChromeOS", "14541.0.0"),
    ("Mozilla/5.0 (Windows NT 6.1; Trident/7.0; rv:11.0) like Gecko", "pc", "Internet Explorer", "11.0", "Windows", "6.1"),
    ("Mozilla/5.0 (Windows Phone 10.0; Android 6.0.1; Microsoft; Lumia 950) AppleWebKit/537.36 Chrome/52.0.2743.116 Mobile Safari/537.36 Edge/15.14977", "smartphone", "Edge", "15.14977", "Windows Phone OS", "10.0"),
    ("Mozilla/5.0 (PlayStation 4 3.11) AppleWebKit/537.73 (KHTML, like Gecko)", "appliance", "unknown", "unknown", "PlayStation", "3.11"),
    ("Mozilla/5.0 (Nintendo Switch; WifiWebAuthApplet) AppleWebKit/601.6", "appliance", "unknown", "unknown", "Nintendo", "unknown"),
    ("DoCoMo/2.0 N901iS(c100;TB;W24H12)", "mobilephone", "unknown", "unknown", "docomo", "unknown"),
    ("Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)", "crawler", "unknown", "unknown", "unknown", "unknown"),
    ("python-requests/2.31.0", "misc", "HTTP Library", "2.31.0", "unknown", "unknown"),
    ("curl/8.0", "unknown", "curl", "8.0", "unknown", "unknown"),
    (None, "unknown", "unknown", "unknown", "unknown", "unknown"),
]


def test_user_agents(spark):
    rows = spark.createDataFrame([(i, a[0]) for i, a in enumerate(AGENTS)], "i int, agent string")
    found = rows.select("i", scalar.parse_user_agent("agent").alias("a")).orderBy("i").collect()
    for r, want in zip(found, AGENTS, strict=True):
        assert (r.a.category, r.a.name, r.a.version, r.a.os, r.a.os_version) == want[1:], want[0]
