"""Structure repair against an exhaustive search of edits and against SQL."""

import hashlib
import heapq
import os
import random
import re

import duckdb
import pytest

from listingspark.llm import queries, structure

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")
SCHEMA = "conv_id long, turn long, role string, text string, cost int, seg string, signature string"
SOUND = re.compile(r"(s?(ua)+)?")


def brute(rows):
    """Faults and the cheapest, then least, edits of ordered (role, text) rows, by a search over prefixes of edits."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\f\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            break

        def may(c):
            return c == "s" and state == "" or c == "u" and state != "u" or c == "a" and state == "u"

        steps = [(3, "I", i, c, (f"{name}:",)) for c, name in (("u", "user"), ("a", "assistant")) if may(c)]
        if i < len(rows):
            (role, text), extra = rows[i], 3 if faults[i] == "truncated" else 0
            steps.append((4, "D", i + 1, state, ()))
            if faults[i] not in ("blank", "duplicate"):
                if may(role[:1]):
                    steps.append((extra, "K", i + 1, role[:1], (f"{role}:{text}",)))
                steps += [(3 + extra, "R", i + 1, c, (f"{name}:{text}",)) for c, name in (("u", "user"), ("a", "assistant")) if may(c)]
        for c, edit, j, after, line in steps:
            heapq.heappush(heap, (cost + c, audit + edit, j, after, out + line))
    assert SOUND.fullmatch("".join(line[0] for line in out))
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (*(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def order(r):
    role, text = " " if r[2] is None else r[2], " " if r[3] is None else r[3]
    return (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()), (role, text)


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(order(r) for r in rows if r[0] == conv)
        turns = [k[1] for k, _ in own if k[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *brute([x for _, x in own]))
    return out


def found(df, **options):
    conversations, turns = structure.repair(df, **options)
    digests = {r.conv_id: r.repaired_sha256 for r in structure.joined_sha256(turns).collect()}
    rows = conversations.collect()
    assert len(digests) == len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: (*tuple(r)[1:], digests[r.conv_id]) for r in rows}, turns


def drawn(n, seed, most=14):
    r = random.Random(seed)
    texts = ["yes.", "no!", "why?", "cut off", "", " \n\t", "yes.", "a.b", "end. \x0b", None, "Ünï 😀."]
    rows = []
    for conv in range(n):
        for turn in range(r.randrange(1, most)):
            rows.append((conv, r.choice([turn, turn, turn, turn * 2, None]), r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "unknown", "User"]),
                         r.choice(texts) if r.random() < 0.5 else f"text {r.randrange(9)}."))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", "g") for r in rows], SCHEMA)


@pytest.mark.parametrize("segment", [1, 3, 256])
def test_drawn_conversations(spark, segment):
    rows = drawn(120, segment)
    rows += [(None, 1, "user", "hello."), (None, None, "assistant", "hm"), (10**12, 5, "user", "x." * 9000)]
    got, turns = found(frame(spark, rows), segment=segment)
    want = expected(rows)
    assert got == want
    sizes = {r.conv_id: r.n_segments for r in turns.collect()}
    assert max(sizes.values()) == 1 if segment == 256 else max(sizes.values()) > 3


def test_one_conversation_over_many_partitions(spark, monkeypatch):
    """A hot conversation is cut at partitions and segments and composed again."""
    monkeypatch.setattr(structure, "FEW", 3)
    rows = [(7, t, random.Random(t).choice(["user", "assistant", "user", "assistant", "tool"]), f"t{t}" + ("." if t % 5 else "")) for t in range(1500)]
    rows += [(7, None, "user", "same.") for _ in range(300)] + drawn(20, 4)
    rows += [(c, t, r, x) for c in (8, 9) for t in range(2) for r, x in [("user", "q?")]]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got, turns = found(frame(spark, rows).repartition(6), segment=16)
        places = {r.segment >> 40 for r in turns.filter("conv_id = 7").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == expected(rows)
    assert len(places) > 1


def test_all_rows_to_be_deleted(spark):
    rows = [(1, t, "user", " ") for t in range(5)] + [(2, 0, "system", "be kind.")]
    got, _ = found(frame(spark, rows), segment=2)
    assert got == expected(rows)
    assert got[1][6] == "DDDDD" and got[1][7] == hashlib.sha256(b"").hexdigest() and got[2][6] == "D"


def test_empty(spark):
    conversations, turns = structure.repair(frame(spark, []))
    assert conversations.collect() == [] and turns.collect() == [] and structure.joined_sha256(turns).collect() == []


def test_suffixes_are_solved_once():
    words = ["uaua", "suaua", "Uaua", "ddua", "uua", "uaua", "a" * 50 + "ua"]
    automaton = structure.Automaton(None)
    for w in sorted(w[::-1] for w in words):
        alone = structure.Automaton(None)
        assert automaton.solve(w) == alone.solve(w)
    assert automaton.made == len({w[i:] for w in words for i in range(len(w))})


def test_turns(spark):
    rows = [(1, 0, "assistant", "first."), (1, 1, "tool", "second."), (1, 2, "user", "third")]
    _, turns = structure.repair(frame(spark, rows))
    (row,) = turns.collect()
    assert [tuple(t) for t in row.turns] == [("R", 0, "user", "first."), ("R", 1, "assistant", "second.")]
    _, turns = structure.repair(frame(spark, [(1, 3, "assistant", "alone.")]))
    assert [tuple(t) for t in turns.collect()[0].turns] == [("I", None, "user", ""), ("K", 3, "assistant", "alone.")]


def test_query_and_sql(spark, tmp_path):
    rows = drawn(60, 11) + [(None, 0, "user", "a?"), (None, 1, "assistant", "b.")]
    frame(spark, [r for r in rows if r[1] is not None]).write.parquet(str(tmp_path / "conversations.parquet"))
    for folder in (SF, str(tmp_path)):
        got = queries.QUERIES["op12_structure"](spark, folder)
        con = duckdb.connect()
        pattern = f"{folder}/conversations.parquet" if os.path.isfile(f"{folder}/conversations.parquet") else f"{folder}/conversations.parquet/*.parquet"
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{pattern}')")
        want = con.sql(queries.ORACLES["op12_structure"])
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
