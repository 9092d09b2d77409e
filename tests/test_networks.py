import ipaddress
import random

import pytest
from plans import plan_of
from pyspark.sql import functions as F

from huntframe.functions import addresses as A
from huntframe.operators import networks, skew
from huntframe.operators.networks import in_networks, most_specific_network, within_intervals
from huntframe.operators.skew import balanced_join


def _number(text):
    ip = ipaddress.ip_address(text)
    return int(ip) + (0xFFFF << 32 if ip.version == 4 else 0)


def _both(row):
    return None if row is None else ((row.high % (1 << 64)) << 64) + row.low % (1 << 64)


READABLE = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "2001:DB8::a:0:FF", "fe80::1", "ffff::",
            "::ffff:1.2.3.4", "64:ff9b::192.0.2.33", "8000:0:0:0:8000::", "10.0.0.1", "255.255.255.255", "0.0.0.0"]
OTHER = ["", ":", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "g::", "1.2.3", "1.2.3.256", "::1.2.3.999",
         "1:2:3:4:5:6:7:8::", "::1:2:3:4:5:6:7:8", "fe80::1/64", "a", None, ":1:2:3:4:5:6:7"]


def test_any_spelling(spark):
    rows = spark.createDataFrame([(t,) for t in READABLE + OTHER + [" fe80::1%eth0 "]], "ip string").select(
        "ip", A.parse_ip("ip").alias("n")).collect()
    got = {r.ip: _both(r.n) for r in rows}
    assert got == {**{t: _number(t) for t in READABLE}, **dict.fromkeys(OTHER), " fe80::1%eth0 ": _number("fe80::1")}


def test_masks_and_networks(spark):
    nets = ["10.1.2.3/8", "10.1.2.3", "0.0.0.0/0", "2001:db8::ff/32", "::/0", "fe80::1/65", "ffff::/1", "1.2.3.4/33", "::1/129", "x/8",
            "1.2.3.4/", "1.2.3.4/8/8", "1.2.3.4/-1", None]
    got = spark.createDataFrame([(n,) for n in nets], "net string").select("net", A.parse_network("net").alias("n")).collect()
    for r in got[:7]:
        net = ipaddress.ip_network(r.net, strict=False)
        assert (_both(r.n), r.n.bits) == (_number(str(net.network_address)), net.prefixlen + (96 if net.version == 4 else 0))
    assert [r.n for r in got[7:]] == [None] * 7
    one = spark.range(1).select(
        A.ipv6_is_match(F.lit("2001:db8::1"), F.lit("2001:0DB8::ffff"), 112).alias("a"), A.ipv6_is_match(F.lit("::1"), F.lit("::2")).alias("b"),
        A.ipv6_is_match(F.lit("10.0.0.1"), F.lit("::ffff:10.0.0.1")).alias("c"), A.ipv6_is_match(F.lit("x"), F.lit("::")).alias("d"),
        A.ip_is_in_range(F.lit("10.9.9.9"), F.lit("10.0.0.0/8")).alias("e"), A.ip_is_in_range(F.lit("::1"), F.lit("10.0.0.0/8")).alias("f"),
        A.ip_is_in_range(F.lit("::1"), F.lit("y")).alias("g")).first()
    assert tuple(one) == (True, False, True, None, True, False, None)


def _random_ip(rng):
    if rng.random() < 0.3:
        return str(ipaddress.ip_address((0x20010DB8 << 96) + rng.choice([0, 1, 1 << 64, 5]) + rng.randint(0, 3)))
    return f"10.{rng.choice([0, 0, 1, 200])}.{rng.choice([0, 1])}.{rng.randint(0, 20)}"


def test_longest_prefix_wins(spark):
    rng = random.Random(3)
    nets = [(f"{_random_ip(rng)}/{rng.choice([0, 8, 12, 16, 24, 28, 30, 32])}", i) for i in range(40)]
    nets = [(n if ":" not in n else n.replace("/", "/9"), i) for n, i in nets] + [("none", 90), (None, 91), ("2001:db8::/32", 92), ("2001:db8::/32", 93)]
    seen = [(i, rng.choice([_random_ip(rng), "10.0.0.7", None, "host"])) for i in range(400)]
    events = spark.createDataFrame(seen, "id int, ip string").withColumn("zone", F.lit("own"))
    table = spark.createDataFrame(nets, "net string, zone int")
    found = most_specific_network(events, table, "ip", "net", ["zone"])
    assert found.columns == ["id", "ip", "zone", "net", "zone_right"]

    def best(ip):
        try:
            n = _number(ip)
        except ValueError:
            return None, None
        held = []
        for net, zone in nets:
            try:
                known = ipaddress.ip_network(net, strict=False)
            except ValueError:
                continue
            bits = known.prefixlen + (96 if known.version == 4 else 0)
            if n >> (128 - bits) == _number(str(known.network_address)) >> (128 - bits):
                held.append((-bits, net, zone))
        return min(held)[1:] if held else (None, None)

    assert {r.id: (r.net, r.zone_right) for r in found.collect()} == {i: best(ip) for i, ip in seen}
    inside = in_networks(events, table, "ip", "net")
    assert inside.columns == events.columns
    assert {r.id for r in inside.collect()} == {i for i, ip in seen if best(ip)[0]}
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)


def test_no_networks_and_no_events(spark):
    events = spark.createDataFrame([(1, "10.0.0.1")], "id int, ip string")
    nets = spark.createDataFrame([], "net string")
    assert [tuple(r) for r in most_specific_network(events, nets, "ip", "net").collect()] == [(1, "10.0.0.1", None)]
    assert in_networks(events, nets, "ip", "net").collect() == []
    assert most_specific_network(events.limit(0), spark.createDataFrame([("::/0",)], "net string"), "ip", "net").collect() == []


def test_one_address_with_a_third_of_the_events(spark):
    events = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, "10.0.0.1").otherwise(
        F.concat(F.lit("10.0."), (F.col("id") % 250).cast("string"), F.lit("."), (F.col("id") % 199).cast("string"))).alias("ip"))
    nets = spark.createDataFrame([("10.0.0.0/8",), ("10.0.0.0/24",)], "net string")
    plain = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        found = most_specific_network(events, nets, "ip", "net", salts=32)
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 30_000 and max(sizes) < 6_000  # 10 000 and more in one task without spreading
        assert found.filter("net = '10.0.0.0/24'").count() > 10_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", plain)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("seed", [1, 2])
def test_intervals_of_all_lengths(spark, seed):
    rng = random.Random(seed)
    spans = [(i, a := rng.randint(-1000, 1000), a + rng.choice([0, 1, 2, 3, 7, 8, 100, 5000, -1])) for i in range(120)]
    spans += [(200, None, 5), (201, 5, None), (202, -(1 << 51), 1 << 51), (203, 0, 1 << 50), (203, 0, 1 << 50)]
    points = [(i, rng.randint(-1500, 1500)) for i in range(200)] + [(900, None), (901, 1 << 50), (902, -(1 << 51)), (903, (1 << 50) + 1)]
    left = spark.createDataFrame(points, "id int, at long").withColumn("low", F.lit("x"))
    right = spark.createDataFrame(spans, "span int, low long, high long")
    found = within_intervals(left, right, "at", "low", "high")
    assert found.columns == ["id", "at", "low", "low_right", "high", "span"]
    want = sorted((i, s) for i, at in points for s, a, b in spans if None not in (at, a, b) and a <= at <= b)
    assert sorted((r.id, r.span) for r in found.collect()) == want
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    assert within_intervals(left, right.limit(0), "at", "low", "high").collect() == []


def test_points_are_dealt_out_once_and_intervals_by_what_they_hold(spark, monkeypatch):
    sides = []
    monkeypatch.setattr(networks, "RANGE", 16)
    monkeypatch.setattr(networks, "balanced_join", lambda a, b, keys: sides.append((a, b)) or balanced_join(a, b, keys))
    points = spark.range(400).select("id", F.when(F.col("id") < 100, 7).otherwise(F.col("id") * 37 % 5003).alias("at"))
    spans = spark.range(60).selectExpr("id AS span", "id * 83 AS low", "id * 83 + pmod(id, 6) * pmod(id, 6) * pmod(id, 6) * 9 AS high")
    found = within_intervals(points, spans, "at", "low", "high")
    at = [r.at for r in points.collect()]
    assert found.count() == sum(r.low <= v <= r.high for r in spans.collect() for v in at)
    (left, right), = sides
    assert left.count() == 400  # not once for each length of interval
    assert right.count() <= found.count() + 2 * 60


def test_a_key_of_many_pairs_is_split(spark, monkeypatch):
    monkeypatch.setattr(skew, "PAIRS", 100)
    left = spark.createDataFrame([(1, i) for i in range(200)] + [(2, 0), (3, 0), (None, 5)], "k int, a int")
    right = spark.createDataFrame([(1, i) for i in range(9)] + [(2, i) for i in range(300)] + [(4, 0), (None, 1)], "k int, b int")
    out = balanced_join(left, right, ["k"])
    assert sorted(map(tuple, out.collect())) == sorted([(1, i, j) for i in range(200) for j in range(9)] + [(2, 0, j) for j in range(300)])
    assert balanced_join(left, right.limit(0), ["k"]).count() == 0
