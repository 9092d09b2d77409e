"""Should-fire and should-not-fire scenarios."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plans import plan_of
from huntframe.functions import predicates as P
from huntframe.operators.aggregates import dcount
from huntframe.operators.stages import ANY, Capture, fires, where
from huntframe.plans import detections as D

NOW = datetime(2026, 6, 24)


def events(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("n, fire", [(2, False), (3, False), (5, True)])
def test_threshold_in_ten_minutes(spark, n, fire):
    df = events(spark, [("bob", NOW)] * n + [("eve", NOW + timedelta(minutes=11 * i)) for i in range(5)],
                "TargetUsername string, TimeGenerated timestamp")
    got = D.threshold_per_entity(df, ["TargetUsername"], "PT10M", 3).collect()
    assert [r.TargetUsername for r in got] == (["bob"] if fire else [])


def test_baseline_vs_current(spark):
    rows = [("quiet", NOW - timedelta(days=d, hours=1)) for d in range(14)]
    rows += [("loud", NOW - timedelta(days=d, hours=1)) for d in range(14)] + [("loud", NOW - timedelta(hours=2))] * 60
    rows += [("gone", NOW - timedelta(days=5))] * 99 + [("future", NOW)] * 99
    df = events(spark, rows, "src string, TimeGenerated timestamp")
    got = D.baseline_vs_current(df, ["src"], NOW, 50).collect()
    assert [(r.src, r.CurrentCount, r.BaselineCount) for r in got] == [("loud", 61, 74)]


def test_ordered_pair(spark):
    def at(m):
        return NOW + timedelta(minutes=m)
    df = events(spark, [("ok", "export", at(0)), ("ok", "remove", at(30)), ("backwards", "remove", at(0)),
                        ("backwards", "export", at(10)), ("late", "export", at(0)), ("late", "remove", at(90)),
                        ("half", "export", at(0))], "user string, cmd string, TimeGenerated timestamp")
    got = D.ordered_pair(df, ["user"], P.eq("cmd", "export"), P.eq("cmd", "remove"), "minute", 60).collect()
    assert [(r.user, r.Between) for r in got] == [("ok", 30.0)]
    assert "Join" not in plan_of(D.ordered_pair(df, ["user"], P.eq("cmd", "a"), P.eq("cmd", "b")))


def test_rare_entities(spark):
    rows = [(f"p{i}",) for i in range(1, 21) for _ in range(i)]
    got = D.rare_entities(events(spark, rows, "proc string"), ["proc"], 5).collect()
    assert sorted(r.proc for r in got) == ["p1"] and got[0].Limit == pytest.approx(1.95)


def test_regularity(spark):
    rows = [("steady", NOW - timedelta(days=d, hours=h)) for d in range(10) for h in range(1, 5)]
    rows += [("wild", NOW - timedelta(days=d, hours=1 + h % 20)) for d in range(10) for h in range(1 + 9 * (d % 2))]
    got = D.regularity(events(spark, rows, "src string, TimeGenerated timestamp"), ["src"], "P1D", 0.2).collect()
    assert [r.src for r in got] == ["steady"]


@pytest.mark.parametrize("spike, fire", [(40, True), (2, False)])
def test_spike_of_names(spark, spike, fire):
    rows = [("192.168.7.9", NOW - timedelta(days=d), f"usual{i}") for d in range(2, 8) for i in range(2)]
    rows += [("192.168.7.9", NOW - timedelta(days=1), f"n{i}.test") for i in range(spike)]
    df = events(spark, rows, "SrcIpAddr string, TimeGenerated timestamp, DnsQuery string")
    got = D.outlier_buckets(df, ["SrcIpAddr"], NOW - timedelta(days=7), NOW, "P1D", dcount("DnsQuery"))
    assert fires(got.filter("AnomalyFlag = 1")) is fire


def test_renamed_deletion_tool(spark):
    df = events(spark, [(1, "notes.bin", "notes.bin --wipe --deep --mute D:\\"), (2, "eraser.bin", "eraser.bin --wipe --deep --mute D:\\"),
                        (3, "third.bin", "third.bin --wipe --deep D:\\")], "id int, name string, cmd string")
    assert [r.id for r in D.renamed_tool(df, "cmd", ["wipe", "--deep", "--mute"], "name", "eraser.bin").collect()] == [1]


def test_port_mismatch(spark):
    df = events(spark, [(1, "dns", 53), (2, "dns", 5353), (3, "http", 53), (4, "ssh", 99)], "id int, app string, port int")
    assert sorted(r.id for r in D.category_mismatch(df, "app", "port", {"dns": 53, "http": 80}).collect()) == [2, 3]


def test_first_seen(spark):
    rows = [("old", NOW - timedelta(days=3)), ("old", NOW - timedelta(hours=1)), ("new", NOW - timedelta(hours=2)),
            ("ancient", NOW - timedelta(days=40)), ("ancient", NOW - timedelta(hours=3)), ("past", NOW - timedelta(days=2))]
    df = events(spark, rows, "p string, TimeGenerated timestamp").withColumn("TimeGenerated", F.col("TimeGenerated").cast("timestamp_ntz"))
    got = D.first_seen(df, ["p"], NOW - timedelta(days=1), NOW - timedelta(days=14)).collect()
    assert sorted(r.p for r in got) == ["ancient", "new"]


@pytest.mark.parametrize("n, fire", [(8, True), (1, False)])
def test_parse_then_count(spark, n, fire):
    url = "https://shop.test/cart?next=ftp://mirror-9.test/list"
    df = events(spark, [(url,)] * n + [("https://shop.test/",)] * 9, "Url string")
    got = D.extract_and_count(df, "Url", (ANY, "next=ftp://", Capture("Mirror"), "/", ANY), "Mirror", 3).collect()
    assert [(r.Mirror, r.n) for r in got] == ([("mirror-9.test", n)] if fire else [])


def test_touched_items(spark):
    df = events(spark, [("a", "http://x/login"), ("a", "http://x/setup.tmp"), ("a", "http://x/setup.tmp"), ("b", "http://x/report.pdf")],
                "src string, Url string")
    assert [(r.src, r.Url) for r in D.touched_items(df, ["src"], "Url", P.endswith("Url", ".TMP")).collect()] == [("a", "http://x/setup.tmp")]


def test_external_to_management_ports(spark):
    df = events(spark, [(1, "8.8.8.8", 5985), (2, "10.0.0.5", 5985), (3, "8.8.8.8", 80)], "id int, ip string, port int")
    assert [r.id for r in D.external_to_ports(df, "ip", "port", [5985, 5986, 1270]).collect()] == [1]


def test_two_term_sets_and_exact_fragment(spark):
    df = events(spark, [(1, "net user /domain"), (2, "net user /add"), (3, "net group /do"), (4, "y -RAW Qk1NQQ=="), (5, "y -raw qk1nqq==")],
                "id int, cmd string")
    assert sorted(r.id for r in D.two_term_sets(df, "cmd", ["user", "group"], ["/do", "/domain"]).collect()) == [1, 3]
    assert [r.id for r in D.fragment_and_flag(df, "cmd", "Qk1NQQ==", "-raw").collect()] == [4]


def test_indicators_and_activity(spark):
    versions = events(spark, [("ip1", NOW, False), ("ip1", NOW - timedelta(days=1), True), ("ip2", NOW, True)],
                      "ip string, TimeGenerated timestamp, active boolean")
    activity = events(spark, [("ip1", 1), ("ip2", 2), ("ip3", 3)], "ip string, id int")
    got = D.active_indicators_seen(versions, activity, "ip", F.col("active"), "ip").collect()
    assert [r.id for r in got] == [2]


def test_evidence_does_not_split_the_count(spark):
    rows = [("a", f"u{i % 3}", NOW + timedelta(seconds=i)) for i in range(9)] + [("b", "u", NOW)]
    df = events(spark, rows, "src string, url string, TimeGenerated timestamp")
    got = D.threshold_with_evidence(df, ["src"], 5, "url", 2, ("TimeGenerated",)).collect()
    assert [(r.src, r.n, r.Evidence) for r in got] == [("a", 9, ["u0", "u1"])]
    many = D.many_values(df, ["src"], "url", 3, 10, ("TimeGenerated",)).collect()
    assert [(r.src, r.Distinct, r.Values) for r in many] == [("a", 3, ["u0", "u1", "u2"])]


def test_fragment_of_a_path(spark):
    df = events(spark, [(1, "D:\\Parcels\\Outbox\\item.bin"), (2, "D:\\Inbox\\item.bin")], "id int, p string")
    assert [r.id for r in where(df, P.contains("p", "\\parcels\\")).collect()] == [1]


def test_no_python_in_detection_plans(spark, folder):
    from huntframe.queries.catalog import QUERIES

    for name, build in QUERIES.items():
        if name[0] in "PFXAJTL":
            plan = plan_of(build(spark, folder))
            assert "Python" not in plan and "Pandas" not in plan, name
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
