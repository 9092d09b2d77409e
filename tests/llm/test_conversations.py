import hashlib
import itertools
import random
import re
import zlib

import pytest

from huntframe.llm import conversations, queries

LEGAL = re.compile("(s?(ua)+)?")
BLANK = re.compile(r"[\x20\x09-\x0D]*")
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    """{conv: rows after damage, in order}, every conversation of the table among them."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        what = zlib.crc32(key.encode()) % 20
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        role = "user" if what == 4 else role
        out.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(what, 1))
    return {c: in_order(r, c) for c, r in out.items()}


def in_order(rows, conv=None):
    def key(row):
        turn, role, text = row
        name = "" if conv is None else f"={conv}"
        mark = hashlib.sha256(f"{len(name)}:{name}:{len(role)}:{role}:{text}".encode()).digest()
        return turn is not None, turn or 0, role.encode(), text[:32].encode(), mark
    return sorted(rows, key=key)


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        if BLANK.fullmatch(text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("truncated" if text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def every_repair(rows, marks, most):
    """All (cost, audit, repaired) with at most ``most`` inserted rows, found by trying all edits."""
    ways = []
    for (_, role, text), fault in zip(rows, marks):
        own = [(3, "D", None)]
        if fault not in ("blank", "duplicate"):
            extra = fault == "truncated"
            own += [(extra, "K", (role, text)), (2 + extra, "R", ("user", text)), (2 + extra, "R", ("assistant", text))]
        ways.append(own)
    for chosen in itertools.product(*ways):
        for count in range(most + 1):
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), count):
                for roles in itertools.product(("user", "assistant"), repeat=count):
                    audit, repaired, cost = "", [], 2 * count
                    added = list(zip(places, roles))
                    for i in range(len(rows) + 1):
                        for place, role in added:
                            if place == i:
                                audit, repaired = audit + "I", [*repaired, (role, "")]
                        if i < len(rows):
                            cost += chosen[i][0]
                            audit += chosen[i][1]
                            repaired += [chosen[i][2]] if chosen[i][2] else []
                    if LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in repaired)):
                        yield cost, audit, tuple(repaired)


def plain_repair(rows, marks):
    """The same by dynamic programming over whole strings, one edit at a time."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, done) in list(best.items()):
                for role in ("user", "assistant"):
                    if role[0] in follows[state]:
                        new = (cost + 2, audit + "I", (*done, (role, "")))
                        best[role[0]] = min(best.get(role[0], new), new)
        return best

    for (_, role, text), fault in zip(rows, marks):
        after = {}
        for state, (cost, audit, done) in inserted(best).items():
            ways = [(3, "D", None)]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                ways += [(extra, "K", (role, text)), (2 + extra, "R", ("user", text)), (2 + extra, "R", ("assistant", text))]
            for more, edit, row in ways:
                if row and (row[0][:1] or "?") not in follows[state]:
                    continue
                to = row[0][0] if row else state
                new = (cost + more, audit + edit, (*done, row) if row else done)
                after[to] = min(after.get(to, new), new)
        best = after
    best = inserted(best)
    return min(best[s] for s in ("", "a") if s in best)


def expected(rows, repair=plain_repair):
    marks = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, repaired = repair(rows, marks)
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            **{k: marks.count(k) for k in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()}


def random_rows(rng, conversations, most, turns=9):
    texts = ["Yes.", "No", "  ", "", "Why?", "é!  \n", "Long " * 9 + "a.", "Long " * 9 + "b.", "x\x85"]
    roles = ["user", "assistant", "system", "tool", "user", "assistant", "", None]
    return [(c, rng.choice([*range(turns), None]), rng.choice(roles), rng.choice([*texts, None]))
            for c in range(conversations) for _ in range(rng.randint(1, most))]


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def found(df):
    rows = df.filter("last").collect()
    out = {r.conv_id: {c: r[c] for c in COLUMNS} for r in rows}
    assert len(out) == len(rows)
    return out


def test_plain_repair_is_the_cheapest_of_all_edits():
    rng = random.Random(2)
    for _ in range(60):
        rows = in_order([(t, r or " ", x or " ") for _, t, r, x in random_rows(rng, 1, 3)])
        marks = faults(rows)
        assert plain_repair(rows, marks) == min(every_repair(rows, marks, 4))


def test_against_plain_repair(spark):
    rows = random_rows(random.Random(1), 250, 9)
    got = found(conversations.repair(conversations.damage(table(spark, rows)), copies="copies"))
    assert got == {c: expected(r) for c, r in damaged(rows).items()}


@pytest.mark.parametrize("partitions, piece_rows", [(1, 4096), (9, 4096), (7, 3)])
def test_long_conversations_in_pieces(spark, monkeypatch, partitions, piece_rows):
    monkeypatch.setattr(conversations, "PIECE_ROWS", piece_rows)
    monkeypatch.setattr(conversations, "PIECE_CHARACTERS", 400 if piece_rows < 10 else 1 << 20)
    rng = random.Random(4)
    roles = ["user", "assistant", "user", "assistant", "system", "tool"]
    rows = [(0, t, rng.choice(roles), rng.choice(["Yes.", "no", f"Said {t}.", f"cut {t}", ""])) for t in range(700)]
    rows += [(1, t % 3, "user", "Same.") for t in range(300)] + [(None, None, "system", "Hello."), (2, 0, None, None)]
    rows += random_rows(rng, 6, 60)
    plain = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = conversations.repair(conversations.damage(table(spark, rows)), copies="copies").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", plain)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    last = {r.conv_id: r for r in parts if r.last}
    want = {c: expected(r) for c, r in damaged(rows).items()}
    assert {c: {k: r[k] for k in COLUMNS} for c, r in last.items()} == want
    for conv, r in last.items():
        text = "".join(p.repaired for p in sorted((p for p in parts if p.conv_id == conv), key=lambda p: p.part))
        assert hashlib.sha256(text.encode()).hexdigest() == r.repaired_sha256
    if partitions > 1:
        assert sum(p.conv_id == 0 for p in parts) > 1


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(conversations.Audits, "MODULUS", 3)
    rng = random.Random(6)
    for _ in range(200):
        rows = in_order([(t, r or " ", x or " ") for _, t, r, x in random_rows(rng, 1, 12, 30)])
        piece = conversations.Piece()
        for (turn, role, text), fault in zip(rows, faults(rows)):
            piece.add(turn, role, text, 1, fault == "duplicate")
        audits, now = piece.ways(conversations.START)
        cost, node, ending = conversations._ended(audits, now)
        assert (cost, audits.text(node) + ending) == expected_audit(rows)


def expected_audit(rows):
    return plain_repair(rows, faults(rows))[:2]


def test_very_many_copies_of_a_row(spark):
    rows = [(5, 0, "user", "Hello."), (5, 1, "assistant", "Hi."), (5, 2, "user", "Again."), (6, 0, "user", " ")]
    counted = table(spark, rows).selectExpr("*", "CASE WHEN turn = 2 THEN 100000 WHEN conv_id = 6 THEN 3 ELSE 1 END AS copies",
                                            "1 AS mark", "2 AS conv", "3 AS last")
    got = found(conversations.repair(counted, copies="copies"))
    assert got[5]["duplicate"] == got[5]["illegal"] == 99_999
    assert (got[5]["cost"], got[5]["audit"]) == (3 * 99_999 + 2, "KKK" + "D" * 99_999 + "I")
    assert (got[6]["blank"], got[6]["audit"], got[6]["cost"]) == (3, "DDD", 9)


def test_empty_tables_and_text_ids(spark):
    assert conversations.repair(conversations.damage(table(spark, [])), copies="copies").collect() == []
    rows = spark.createDataFrame([("a", 0, "user", "One."), ("a", 1, "assistant", "Two."), ("b", None, "user", None)],
                                 "conv_id string, turn int, role string, text string")
    got = found(conversations.repair(rows))
    assert (got["a"]["audit"], got["b"]["audit"]) == ("KK", "D")
    gone = conversations.repair(rows.selectExpr("*", "0 AS copies"), copies="copies")
    empty = {**dict.fromkeys(COLUMNS[:-2], 0), "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    assert found(gone) == {"a": empty, "b": empty}


def test_query(spark, folder):
    import duckdb

    rows = duckdb.connect().sql(f"select conv_id, turn, role, text from '{folder}/conversations.parquet'").fetchall()
    result = queries.op12_conversation_repair(spark, folder)
    assert result.columns == ["conv_id", *COLUMNS]
    got = {r.conv_id: {c: r[c] for c in COLUMNS} for r in result.collect()}
    assert got == {c: expected(r) for c, r in damaged(rows).items()}
