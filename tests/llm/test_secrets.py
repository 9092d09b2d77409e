import base64
import hashlib
import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from huntframe.llm import queries, secrets

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"""
                    r"""[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def window_bits(window):
    return -sum(c / len(window) * math.log2(c / len(window)) for c in Counter(window).values())


def brute(text, classes=secrets.CLASSES, allowed=secrets.ALLOWED):
    """Every window on its own, by the definition of the entropy."""
    text = text or ""
    base = base_spans(text)
    found = list(base)
    for number, kind in enumerate(classes):
        for run in re.finditer("[" + re.escape(kind.characters.decode()) + "]+", text):
            before = text[:run.start()].encode()[-secrets.CONTEXT:]
            if any(re.search(p, before + run[0].encode()) for p in allowed):
                continue
            for s, e in unions(run, kind, text):
                if not any(b <= s and e <= f for b, _, f in base):
                    found.append((s, 3 + number, e))
    return sorted(found)


def unions(run, kind, text):
    out = []
    for i in range(run.start(), run.end() - kind.window + 1):
        if window_bits(text[i:i + kind.window]) >= kind.bits - 1e-9:
            if out and i <= out[-1][1]:
                out[-1][1] = i + kind.window
            else:
                out.append([i, i + kind.window])
    return out


def random_texts(n, seed):
    rng = random.Random(seed)
    parts = [
        lambda: rng.choice(["password", "PassWd", "API_KEY", "apikey", "Secret", "token", "ſecret"]) + rng.choice(["", '"', "'"])
        + " " * rng.randint(0, 2) + rng.choice(":= ") + rng.choice(["", " ", '"']) + "".join(rng.choices("abcXYZ019+/_.=-", k=rng.randint(1, 14))),
        lambda: "AKIA" + "".join(rng.choices("ABCXYZ0129", k=rng.randint(5, 20))),
        lambda: "".join(rng.choices("0123456789abcdef", k=rng.randint(20, 90))),
        lambda: "".join(rng.choices("0123456789ABCDEFabcdef", k=rng.randint(20, 90))),
        lambda: base64.b64encode(rng.randbytes(rng.randint(5, 90))).decode(),
        lambda: "a" * rng.randint(10, 60) + base64.b64encode(rng.randbytes(20)).decode() + "b" * 30,
        lambda: rng.choice(["é漢字😀", "\x85", " ", "\n", "sha256:", "example", "data:image/png;base64,", "://"]),
        lambda: "the quick brown fox " * rng.randint(0, 3),
        lambda: "".join(rng.choices("abcdefgh", k=rng.randint(20, 60))),
    ]
    return ["".join(rng.choice(parts)() + rng.choice(["", " ", ",", "token="]) for _ in range(rng.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("together", [secrets._TOGETHER, 40])
def test_against_every_window(monkeypatch, together):
    monkeypatch.setattr(secrets, "_TOGETHER", together)
    texts = random_texts(300, 3) + [None, "", "é", "password=", "AKIA" * 9, "secret=token=abcdefgh12", "password: token:abcdefghi"]
    got = secrets.Scanner().scan(pa.array(texts))
    assert got == [brute(t) for t in texts]
    assert sum(k >= 3 for spans in got for _, k, _ in spans) > 50


def test_other_classes():
    classes = (secrets.CharacterClass("few", b"ab01", 4, 1.5), secrets.CharacterClass("letters", b"abcdefghij", 3, 1.0))
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab01cdefghij  é", k=rng.randint(0, 80))) for _ in range(200)]
    assert secrets.Scanner(classes, ()).scan(pa.array(texts)) == [brute(t, classes, ()) for t in texts]


def test_allowed_strings():
    key = "q7Zx0PvLm2RtYw9KsHd4FgJb8NcA5eUi"
    digest = hashlib.sha256(b"x").hexdigest().upper()
    scan = lambda t: [k for _, k, _ in secrets.Scanner().scan(pa.array([t]))[0]]
    assert scan(f"x {key} y") == [4]
    assert scan(f"integrity sha256-{key}=") == []
    assert scan(f"SHA256: {digest}") == []
    assert 3 in scan(f"key {digest}")
    assert scan(f"data:image/png;base64,{key}") == []
    assert scan("123E4567-E89B-12D3-A456-426614174000") == []
    assert scan("the-internationalization-of-regional-organizations") == []
    # the patterns' own spans are not suppressed
    assert scan("sha256:" + digest.lower()) == [2]


def test_odd_rows_and_columns(spark, documents, odd_rows):
    found = secrets.scan(documents(odd_rows + [(20, "token=abcdefgh"), (20, "token=abcdefgh")]).selectExpr("*", "1 AS secrets"))
    rows = found.collect()
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "secrets"]
    assert len(rows) == len(odd_rows) + 2
    assert [len(r.secrets) for r in rows if r.doc_id == 20] == [1, 1]
    assert all(r.secrets == [] for r in rows if r.text is None or r.text == "")
    assert secrets.scan(documents([])).collect() == []
    with pytest.raises(ValueError):
        secrets.scan(documents([]), to="text")
    with pytest.raises(ValueError):
        secrets.scan(documents([]), classes=[secrets.CharacterClass("hex", b"ab", 2, 1.0)])


def test_query(spark, folder, plain_rows, tmp_path):
    extra = [(i, t, "en", "s", 0) for i, t in enumerate([*random_texts(40, 8), None, ""], 100_000)]
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    documents.union(spark.createDataFrame(extra, documents.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    plain_rows = plain_rows + [(i, t) for i, t, *_ in extra]
    got = {r.doc_id: r.asDict() for r in queries.op11_secrets(spark, str(tmp_path)).collect()}
    kinds = ["assign", "access", "hex", *[c.kind for c in secrets.CLASSES]]
    assert len(got) == len(plain_rows)
    for doc_id, text in plain_rows:
        spans = brute(text)
        base = [s for s in spans if s[1] < 3]
        joined = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in base)
        assert got[doc_id] == {
            "doc_id": doc_id, **{f"n_{name}": sum(k == i for _, k, _ in base) for i, name in enumerate(kinds[:3])},
            "base_sha256": hashlib.sha256(joined.encode()).hexdigest(),
            "spans": ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)}
    assert any(r["n_assign"] and r["n_hex"] for r in got.values()) and any(r["n_access"] for r in got.values())
