import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from huntframe.plans import corpus as C
from huntframe.plans import evaluation as E
from huntframe.plans import retrieval as R
from huntframe.plans.conformance import conform, conformance_report, field_reference


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "q string").select(build("q").alias("x")).first().x


@pytest.mark.parametrize("query, tier", [
    ("imDns | where A == 1", "simple"),
    ("imDns | where A == 1 | where B == 2 | where C == 3", "simple"),
    ("imDns" + " | where A == 1" * 5, "complex"),
    ("imDns | summarize count() by A, B", "moderate"),
    ("imDns | summarize count() by A, bin(TimeGenerated, 10m)", "moderate"),
    ("imDns | summarize count() by A, B, C, D", "complex"),
    ("imDns | summarize count() by f(g(a, b), [c, d]), B | where n > 1, 2", "moderate"),
    ("imDns | summarize count() by A), B, C", "moderate"),
    ("imDns | join (imWebSession) on A", "complex"),
    ("imDns | where x" + " | where y" * 6 + " | summarize n = count()", "moderate"),
])
def test_complexity_tier(spark, query, tier):
    assert one(spark, query, C.complexity_tier) == tier


def test_usable_rules(spark):
    df = spark.createDataFrame([
        (1, "  a long enough description ", "imDns | where x"), (2, "  too short \n\n\n        ", "imDns"),
        (3, "a long enough description {{x}}", "imDns"), (4, "a long enough description", "SecurityEvent | where claim"),
        (5, None, "imDns"), (6, "a long enough description", "x {{y}}"), (7, "a long enough description", "_Im_Dns(a=1)")],
        "id int, d string, q string")
    assert {r.id: r.is_normalized for r in C.usable_rules(df, "d", "q").collect()} == {1: True, 4: False, 7: True}


def test_audit(spark):
    df = spark.createDataFrame([
        (1, "imDns | where DnsQuery == 'Secret \\' x' // trailing Comment\n| summarize Total = count() by SrcIpAddr | where Total > 3"),
        (2, "let window = 1d;\nimDns | where Bogus > ago(window)"), (3, "SecurityEvent | where A"),
        (4, "imDns | make-series n = count() default = 0 by SrcIpAddr | extend (Flag, Score) = series_decompose_anomalies(n)"),
        (5, "SELECT DnsQuery from imDns")], "id int, q string")
    got = {r.id: r for r in C.audit_rules(df, "q", {"DnsEvent": ["DnsQuery", "SrcIpAddr"]}).collect()}
    assert (got[1].event_type, got[1].unknown_names, got[1].flags) == ("DnsEvent", [], [])
    assert (got[2].unknown_names, got[2].flags) == (["Bogus"], ["UNKNOWN_TOKENS"])
    assert got[3].flags == ["NO_EVENT_TYPE_DETECTED"]
    assert got[4].unknown_names == ["default"]
    assert "FOREIGN_SYNTAX" in got[5].flags


@pytest.mark.parametrize("query, kind", [("_Im_Authentication()", "AuthenticationEvent"), ("ASimProcessEvent", "ProcessEvent"),
                                         ("improcesscreate", "ProcessEvent"), ("imFileEvent", "FileEvent"), ("claims", None)])
def test_event_type(spark, query, kind):
    assert one(spark, query, C.event_type_of) == kind


def test_split_is_exact_repeatable_and_whole(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2500, "big").when(F.col("id") < 2995, "mid").otherwise("tiny").alias("s"), "id")
    first = C.stratified_split(df.union(df), "id", "s", 0.3, 7).collect()
    counts = {}
    for r in first:
        counts[r.s, r.split] = counts.get((r.s, r.split), 0) + 1
    assert counts == {("big", "test"): 750, ("big", "train"): 1750, ("mid", "test"): 148, ("mid", "train"): 347,
                      ("tiny", "test"): 2, ("tiny", "train"): 3}
    assert sorted(first) == sorted(C.stratified_split(df.repartition(7), "id", "s", 0.3, 7).collect())
    assert sorted(first) != sorted(C.stratified_split(df, "id", "s", 0.3, 8).collect())


def test_evaluation_pool(spark):
    rows = [(f"s{i}", "a perfectly good description", "imDns | where x") for i in range(4)]
    rows += [(f"c{i}", "a perfectly good description", "imDns | join x") for i in range(30)]
    rows += [("d1", "this query has been DEPRECATED now", "imDns"), ("u1", "a perfectly good description", "imDns")]
    df, used = spark.createDataFrame(rows, "id string, d string, q string"), spark.createDataFrame([("u1",)], "id string")
    got = [r.id for r in C.evaluation_pool(df, used, "id", "d", "q", 10).collect()]
    assert len(got) == 10 and {f"s{i}" for i in range(4)} <= set(got) and not {"d1", "u1"} & set(got)
    assert len(C.evaluation_pool(df, used, "id", "d", "q", 3).collect()) == 4


def test_verified_pairs(spark):
    rules = spark.createDataFrame([("a", "A text"), ("b", "B text")], "id string, t string")
    verdicts = spark.createDataFrame([("a", "keep"), ("b", "discard")], "id string, verdict string")
    variants = spark.createDataFrame([("a", "cas", "sop"), ("b", "x", "y")], "id string, casual string, sop_imperative string")
    got = {(r.id, r.phrasing, r.description) for r in C.verified_pairs(rules, verdicts, variants, "id", "t").collect()}
    assert got == {("a", "original", "A text"), ("a", "casual", "cas"), ("a", "sop_imperative", "sop")}


def test_closest_name(spark):
    names = ["SrcIpAddr", "DstIpAddr", "DnsQuery"]
    df = spark.createDataFrame([("srcipaddress",), ("DNSQUERY",), ("zstIpAddr",)], "n string")
    assert {r.n: r.closest for r in C.closest_names(df, "n", names).collect()} == {
        "srcipaddress": "SrcIpAddr", "DNSQUERY": "DnsQuery", "zstIpAddr": "DstIpAddr"}
    assert {r.closest for r in C.closest_names(spark.createDataFrame([("xxx",)], "n string"), "n", ["bbb", "aaa"]).collect()} == {"bbb"}


@pytest.mark.parametrize("value, told, expected", [
    ("rundll32.exe", "uses RunDll32 to load", False), ("evil.exe", "uses rundll32", True), ("NXDOMAIN", "x", False), ("abc", "x", False),
    ("mimikatz", "finds Mimikatz", False), ("mimikatz", "finds tools", True), (None, "x", False), ("mimikatz", None, False), ("x.ps1", "no", True)])
def test_grounding(spark, value, told, expected):
    df = spark.createDataFrame([(value, told)], "v string, d string")
    assert df.select(C.is_ungrounded("v", "d")).first()[0] is expected


def test_camel_case(spark):
    assert one(spark, "ProcessEvent2Name IPAddr", C.split_camel_case) == "Process Event2 Name IPAddr"


def test_rates(spark):
    df = spark.createDataFrame([("a", True, 1), ("a", True, 2), ("a", False, 3), ("b", True, 1), ("b", None, None)], "t string, ok boolean, n int")
    got = {r.t: (r.total, r.passed, r.rate) for r in E.validity_rate(df, F.col("ok"), ["t"]).collect()}
    assert got == {None: (5, 3, 0.6), "a": (3, 2, pytest.approx(2 / 3)), "b": (2, 1, 0.5)}
    got = {r.t: (r.failed_first, r.recovered, r.rate) for r in E.recovery_rate(df, F.col("ok"), "n", ["t"]).collect()}
    assert got == {"a": (2, 1, 0.5), "b": (1, 0, 0.0)}
    assert E.validity_rate(df.filter("t = 'z'"), F.col("ok")).first().rate == 0.0


def exact_p(b, c):
    n, k = b + c, min(b, c)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)


@pytest.mark.parametrize("b, c", [(0, 0), (1, 0), (3, 9), (12, 12), (1, 37), (30, 25), (0, 24), (0, 25)])
def test_mcnemar(spark, b, c):
    rows = [(True, False)] * b + [(False, True)] * c + [(True, True)] * 4 + [(False, False)] * 2
    r = E.mcnemar(spark.createDataFrame(rows, "a boolean, b boolean"), F.col("a"), F.col("b")).first()
    assert (r.both, r.a_only, r.b_only, r.neither) == (4, b, c, 2)
    if b + c < 25:
        assert r.test == "exact" and r.p_value == pytest.approx(exact_p(b, c))
    else:
        assert r.test == "chi-square" and r.p_value == pytest.approx(math.erfc(math.sqrt((abs(b - c) - 1) ** 2 / (b + c) / 2)))


@pytest.mark.parametrize("values", [[1.0] * 39 + [0.0] * 6, [float(x) for x in range(200)], [3.0] * 10])
def test_bootstrap_is_like_row_by_row_resampling(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = E.bootstrap_ci(df, F.col("v"), replicates=4000).first()
    rng = np.random.default_rng(0)
    means = rng.choice(values, (4000, len(values))).mean(axis=1)
    spread = np.std(values) / math.sqrt(len(values))
    assert got.n == len(values) and got.mean == pytest.approx(np.mean(values))
    assert abs(got.low - np.percentile(means, 2.5)) <= 0.2 * spread + 1e-9
    assert abs(got.high - np.percentile(means, 97.5)) <= 0.2 * spread + 1e-9
    every = E.bootstrap_means(df, F.col("v"), 4000)
    row = every.agg(F.count("mean").alias("n"), F.avg("mean").alias("m"), F.stddev_pop("mean").alias("s")).first()
    assert row.n == 4000 and abs(row.m - np.mean(values)) <= 0.1 * spread + 1e-9 and row.s == pytest.approx(spread, rel=0.1, abs=1e-9)


def test_bootstrap_repeats(spark):
    df = spark.range(300).select(F.col("id").cast("double").alias("v"))
    assert E.bootstrap_ci(df, F.col("v"), 500).first() == E.bootstrap_ci(df.repartition(5), F.col("v"), 500).first()


def brute_kappa(a, b, power):
    levels = sorted(set(a) | set(b))
    w = [[(i != j) if power == 0 else abs(i - j) ** power for j in range(len(levels))] for i in range(len(levels))]
    n = len(a)
    o = sum(w[levels.index(x)][levels.index(y)] for x, y in zip(a, b)) / n
    e = sum(w[levels.index(x)][levels.index(y)] for x in a for y in b) / n / n
    return 1 - o / e


@pytest.mark.parametrize("seed", range(3))
def test_kappa(spark, seed):
    rng = random.Random(seed)
    a = [rng.choice([0, 1, 3]) for _ in range(40)]
    b = [x if rng.random() < 0.6 else rng.choice([0, 1, 2, 3]) for x in a]
    r = E.rater_agreement(spark.createDataFrame(list(zip(a, b)), "a int, b int"), "a", "b").first()
    assert r.n == 40 and r.agreement == pytest.approx(sum(x == y for x, y in zip(a, b)) / 40)
    assert (r.kappa, r.kappa_linear, r.kappa_quadratic) == tuple(pytest.approx(brute_kappa(a, b, p)) for p in (0, 1, 2))


def test_scorecard_confusion_wins_and_runs(spark):
    df = spark.createDataFrame([("t", True, True, None), ("t", False, None, None), ("t", True, False, None)],
                               "template string, completed boolean, fire_ok boolean, nofire_ok boolean")
    r = E.scorecard(df, "template", "completed", "fire_ok", "nofire_ok").first()
    assert (r.n, r.completion, r.fire, r.nofire) == (3, pytest.approx(2 / 3), 0.5, None)
    checks = spark.createDataFrame([(True, True)] * 10 + [(True, False)] * 4 + [(False, True)] * 2 + [(False, False)], "m boolean, v boolean")
    assert {r.m: (r.predicted_true, r.predicted_false) for r in E.confusion(checks, "m", "v").collect()} == {True: (10, 4), False: (2, 1)}
    scores = spark.createDataFrame([("x", "r1", "base", 3), ("x", "r1", "rag", 2), ("y", "r1", "base", 1), ("y", "r1", "rag", 1)],
                                   "id string, rater string, cond string, score int")
    got = {r.cond: (r.total, r.best_or_tied) for r in E.wins_by_condition(scores, "id", "rater", "cond", "score").collect()}
    assert got == {"base": (4, 2), "rag": (3, 1)}
    runs = spark.createDataFrame([(x,) for x in (88.9, 91.1, 91.1, 88.9, 88.9)], "v double")
    r = E.replication_summary(runs, "v").first()
    assert (r.runs, r.median, r.low, r.high, r.iqr) == (5, 88.9, 88.9, 91.1, pytest.approx(2.2))


def test_construct_coverage(spark):
    df = spark.createDataFrame([("a | where x",)] * 6 + [("b | join y",)] * 2, "q string")
    constructs = {"where": (r"\| where", "supported"), "join": (r"\| join", "partial"), "pipe": (r"\|", "partial")}
    got = C.construct_coverage(df, "q", constructs)
    assert {(r.construct, r.rules) for r in got.collect()} == {("where", 6), ("pipe", 8)}
    assert {r.status: r.share for r in C.coverage_share(got).collect()} == {"supported": 0.5, "partial": 0.5}


def test_tfidf(spark):
    docs = spark.createDataFrame([(1, "The lateral movement via remote services"), (2, "remote remote file deletion"),
                                  (3, "unrelated words entirely"), (4, "")], "id int, text string")
    asked = spark.createDataFrame([("q", "remote services"), ("none", "zzz"), ("blank", "")], "q string, text string")
    stop = ["the", "via"]
    index = R.build_index(docs, "id", "text", stop)
    got = [(r.q, r["rank"], r.id, r.score) for r in R.search(index, asked, "q", "text", 3).orderBy("rank").collect()]

    def grams(text):
        words = [w for w in text.lower().split() if len(w) > 1 and w not in stop]
        return words + [" ".join(p) for p in zip(words, words[1:])]
    texts = {r.id: grams(r.text) for r in docs.collect()}
    df = {t: sum(t in g for g in texts.values()) for g in texts.values() for t in g}

    def vector(g):
        w = {t: g.count(t) * (math.log((1 + 4) / (1 + df[t])) + 1) for t in set(g) if t in df}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1
        return {t: x / norm for t, x in w.items()}
    q = vector(grams("remote services"))
    scores = {i: sum(q.get(t, 0) * x for t, x in vector(g).items()) for i, g in texts.items()}
    best = sorted((i for i in scores if scores[i] > 0), key=lambda i: -scores[i])
    assert [(x[0], x[2]) for x in got] == [("q", i) for i in best]
    assert [x[3] for x in got] == [pytest.approx(scores[i]) for i in best]


def test_stored_index_lies_in_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "BATCH_BYTES", 400, raising=False)
    rng = random.Random(6)
    texts = [(i, " ".join(["often"] * 2 + rng.choices([f"w{k}" for k in range(40)], k=10))) for i in range(60)]
    docs = spark.createDataFrame([*texts, (None, "often w1 w2"), (7, "w3 w3 w4"), (61, None)], "id int, text string")
    asked = spark.createDataFrame([(0, texts[7][1]), (1, "often"), (2, "w1 w2 often"), (3, "zz")], "q int, text string")

    def found(path):
        index = R.build_index(docs, "id", "text", [], path=path)
        rows = [(r.q, r["rank"], r.id, round(r.score, 9)) for r in R.search(index, asked, "q", "text", 4).collect()]
        return index, sorted(rows, key=str)

    index, got = found(str(tmp_path / "index"))
    assert got == found(None)[1]
    parts = {r[0] for r in spark.read.parquet(str(tmp_path / "index" / "counts")).select("_part").distinct().collect()}
    assert parts == set(range(index.batches)) and index.batches > 3
    assert [f.name for f in R.build_index(docs, "id", "text", []).vocabulary.schema] == ["term", "idf"]
    empty = R.build_index(docs.limit(0), "id", "text", [], path=str(tmp_path / "none"))
    assert R.search(empty, asked, "q", "text").collect() == []


def test_vocabulary_limit(spark):
    docs = spark.createDataFrame([(1, "aa aa aa bb bb cc"), (2, "bb dd")], "id int, text string")
    index = R.build_index(docs, "id", "text", [], max_terms=3)
    assert {r.term for r in index.vocabulary.collect()} == {"aa", "bb", "aa aa"}


def test_clean_document(spark):
    raw = ("---\nauthor: x\n---\nTitle\n> [!INCLUDE applies]\n:::moniker range\nold\n:::moniker-end\n"
           "> [!div class]\n> <a href=\"u\">Run</a>\n:::image a.png\nBody  ")
    assert one(spark, raw, R.clean_document) == "Title\nBody"
    long = "".join(chr(97 + i % 26) for i in range(9001))
    df = spark.createDataFrame([("k", "short"), ("l", long), ("m", "y" * 4000), ("n", None)], "id string, t string")
    pieces = sorted((r.id, r.piece, r.text) for r in R.chunks(df, "id", "t").collect())
    assert [(i, n) for i, n, _ in pieces] == [("l", 1), ("l", 2), ("l", 3), ("m", 1)]
    assert "".join(t for i, _, t in pieces if i == "l") == long


def test_a_term_in_every_document(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(["common"] * 3 + rng.choices(words, k=12)) for i in range(150)}
    docs = spark.createDataFrame(list(texts.items()), "id int, text string")
    asked = spark.createDataFrame([(0, texts[7]), (1, "common"), (2, "common w1 w2 w3"), (3, "w5")], "q int, text string")
    index = R.build_index(docs, "id", "text", [])
    got = {(r.q, r["rank"]): (r.id, r.score) for r in R.search(index, asked, "q", "text", 4).collect()}

    def grams(text):
        words_ = text.split()
        return words_ + [" ".join(p) for p in zip(words_, words_[1:])]

    seen = {}
    for text in texts.values():
        for term in set(grams(text)):
            seen[term] = seen.get(term, 0) + 1

    def vector(text):
        weights = {t: grams(text).count(t) * (math.log(151 / (1 + seen[t])) + 1) for t in set(grams(text)) if t in seen}
        size = math.sqrt(sum(x * x for x in weights.values()))
        return {t: x / size for t, x in weights.items()}

    vectors = {i: vector(t) for i, t in texts.items()}
    for q, text in ((r.q, r.text) for r in asked.collect()):
        wanted = vector(text)
        scores = {i: sum(wanted.get(t, 0) * x for t, x in v.items()) for i, v in vectors.items()}
        best = sorted((i for i in scores if scores[i] > 0), key=lambda i: (-round(scores[i], 9), i))[:4]
        assert [got[(q, n + 1)][0] for n in range(len(best))] == best
        assert [got[(q, n + 1)][1] for n in range(len(best))] == [pytest.approx(scores[i]) for i in best]


def test_conformance(spark):
    from pyspark.sql import types as T
    schema = T.StructType.fromDDL("a int, b string, c timestamp")
    df = spark.createDataFrame([("1", "x"), ("z", None)], "a string, extra string")
    assert [tuple(r) for r in conform(df, schema).collect()] == [(1, None, None), (None, None, None)]
    kept = conform(df, schema, keep_unknown=True)
    assert kept.columns == ["a", "b", "c", "extra"] and [tuple(r) for r in kept.collect()] == [(1, None, None, "x"), (None, None, None, None)]
    got = {r["column"]: (r.status, r.filled) for r in conformance_report(df, schema).collect()}
    assert got == {"a": ("ok", 2), "extra": ("unknown", 1), "b": ("missing", 0), "c": ("missing", 0)}
    rows = spark.createDataFrame([("common.md", "T"), ("web.md", "Url"), ("net.md", "Port")], "document string, field string")
    got = {r.event_type: r.fields for r in field_reference(rows, {"Web": "web.md", "Net": "net.md"}, "common.md", {"Web": "Net"}).collect()}
    assert got == {"Web": ["Port", "T", "Url"], "Net": ["Port", "T"]}


def test_schemas_of_a_whole_reference(spark):
    from huntframe.sources.schemas import schemas_of_reference

    names = [f"Field{i}{end}" for i in range(60) for end in ("", "Time", "Count", "PortNumber", "IsActive")]
    rows = spark.createDataFrame([("c.md", "TimeGenerated"), *[("d.md", n) for n in names], ("d.md", names[0])], "document string, field string")
    schema = schemas_of_reference(field_reference(rows, {"Dns": "d.md"}, "c.md"))["Dns"]
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    assert len(kinds) == 301 and kinds["TimeGenerated"] == kinds["Field3Time"] == "timestamp" and kinds["Field3"] == "string"
    assert (kinds["Field3Count"], kinds["Field3PortNumber"], kinds["Field3IsActive"]) == ("bigint", "int", "boolean")


def test_closest_within_against_all_names(spark):
    import random

    rng = random.Random(3)
    names = {"".join(rng.choices("abC", k=rng.randint(0, 6))) for _ in range(60)}
    values = ["".join(rng.choices("Abcd", k=rng.randint(0, 7))) for _ in range(80)] + [None, ""]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for most in (0, 1, 2, 3):
        got = C.closest_within(spark.createDataFrame([(v,) for v in values], "v string"), "v",
                               spark.createDataFrame([(n,) for n in names] + [(None,)], "n string"), "n", most)
        firsts = {}
        for n in names:
            firsts[n.lower()] = min(n, firsts.get(n.lower(), n))
        want = {}
        for v in set(values):
            near = sorted((d, n) for w, n in firsts.items() if v is not None and (d := distance(v.lower(), w)) <= most)
            want[v] = near[0][::-1] if near else (None, None)
        assert {r.v: (r.closest, r.distance) for r in got.collect()} == want
    with pytest.raises(ValueError):
        C.closest_within(got, "v", got, "v", 4)


def test_a_hundred_thousand_names(spark):
    names = spark.range(100_000).select(F.concat(F.lit("h"), F.lpad(F.conv(F.col("id") * 7919, 10, 36), 7, "0")).alias("n"))
    asked = names.sample(0.001, 1).select(F.concat(F.col("n"), F.lit("x")).alias("v"))
    got = C.closest_within(asked, "v", names, "n", 1).collect()
    assert got and all(r.distance <= 1 for r in got) and sum(r.v == r.closest + "x" for r in got) > len(got) / 2


def test_bootstrap_by_group(spark):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 > 0, "most").otherwise("rest").alias("g"), (F.col("id") * 7919 % 1013).cast("double").alias("x"))
    df = df.unionByName(spark.createDataFrame([(1, "rest", None), (None, "rest", 5.0), (7, "one", 2.0)], "id long, g string, x double"))
    got = {r.g: r for r in E.bootstrap_by(df, ["g"], "x", "id", 300).collect()}
    for g in ("most", "rest"):
        rows = [r.x for r in df.filter((F.col("g") == g) & F.col("x").isNotNull() & F.col("id").isNotNull()).collect()]
        mean = sum(rows) / len(rows)
        half = 1.96 * (sum((x - mean) ** 2 for x in rows) / len(rows) / len(rows)) ** 0.5
        assert got[g].n == len(rows) and got[g].mean == pytest.approx(mean)
        assert mean - got[g].low == pytest.approx(half, rel=0.2) and got[g].high - mean == pytest.approx(half, rel=0.2)
    assert tuple(got["one"]) == ("one", 1, 2.0, 2.0, 2.0)
    # weights are Poisson numbers of mean 1, and those of two resamples have nothing to do with each other
    weights = spark.range(2000).crossJoin(spark.range(20).withColumnRenamed("id", "r")).select(
        "id", "r", F.expr(E.weight_of_draw("(" + E.poisson_weight("id", "r") + ")")).alias("w"))
    moments = weights.agg(F.avg("w").alias("m"), F.var_samp("w").alias("v"), F.avg((F.col("w") == 0).cast("int")).alias("z")).first()
    assert moments.m == pytest.approx(1, abs=0.03) and moments.v == pytest.approx(1, abs=0.05) and moments.z == pytest.approx(math.exp(-1), abs=0.02)
    table = weights.groupBy("id").pivot("r").agg(F.first("w"))
    assert max(abs(table.stat.corr(str(a), str(b))) for a in (0, 3) for b in (1, 2, 7, 19)) < 0.09
