"""Repair of conversation structure by cheapest edits.

A conversation is sound when the initials of its roles read ``(s?(ua)+)?``: a system turn or none, then pairs of user
and assistant, or nothing at all.  Its rows, in order, may be kept (0), given the role user or assistant (3) or deleted
(4), and empty user or assistant turns may be inserted anywhere (3).  Each row counts for its first fault: *blank* (no
character but white space) and *duplicate* (role and text seen earlier in the conversation) must be deleted,
*truncated* (the last character that isn't white space is none of ``.!?``) costs 3 more when it stays.  Of equally cheap
repairs the one whose initials of edits (``D``, ``I``, ``K``, ``R``) are least in ASCII order is taken.

*Signatures.*  Rows are put in order by one range partitioning, so that no task holds a whole hot conversation, and cut
into segments of at most ``SEGMENT`` rows; a segment's signature has one symbol per row: role class, truncated or
not, or to be deleted.

*Suffix-shared automaton.*  Distinct signatures are sorted by their reversed spelling, so those that end alike are
neighbours.  From the end on every distinct suffix is one node, made once; for each state of the grammar it holds the
cost to go and the best audit suffix, computed from the node behind it.  A signature's first node is its answer, for
all conversations that share it.  A segment that doesn't end its conversation is solved for each state it may leave.

*Long conversations.*  Segments of a conversation are composed by state in and state out, first within each partition, then
over the partitions, and the states at the borders go back down to the segments.

Null role and null text read as one space.  Rows are ordered by turn (nulls first), equal turns by SHA-256 of role and
text; equal rows are interchangeable and all but the first are duplicates.  A null conversation id is a conversation of its
own.  Empty and very long texts are rows like others.  Extra columns are not read; the input may have any names.  An
empty table gives empty tables.  The audit of a conversation is one string, so it may have up to 2**31 edits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ship, stored

SEGMENT = 256
SALTS = 16
FEW = 32
STATES = 4  # nothing yet, after system, after user, after assistant
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ADDED = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}  # the role that an insertion or a new role must have
SOUND = (0, 3)
RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_SPACE = " \t\n\x0b\f\r"

Way = tuple[int, str]


def _least(a: Way | None, b: Way | None) -> Way | None:
    return b if a is None or b is not None and b < a else a


def _after(way: Way | None, cost: int, edit: str) -> Way | None:
    return None if way is None else (way[0] + cost, edit + way[1])


def _inserted(ways: list[Way | None]) -> list[Way | None]:
    """Ways from each state when turns may be inserted first; no way profits from more than three."""
    for _ in range(STATES - 1):
        ways = [_least(w, _after(ways[ADDED[p][0]], INSERT, "I")) for p, w in enumerate(ways)]
    return ways


def end_node(target: int | None) -> list[Way | None]:
    """Behind the last row: nothing to do in a sound state, or, within a conversation, in the state to be left."""
    if target is None:
        return _inserted([(0, "") if p in SOUND else None for p in range(STATES)])
    return [(0, "") if p == target else None for p in range(STATES)]


def node(symbol: str, behind: list[Way | None]) -> list[Way | None]:
    """Cost to go and best audit suffix per state before a row, from those behind it."""
    ways = [_after(w, DELETE, "D") for w in behind]
    if symbol != "d":
        role, extra = symbol.lower(), TRUNCATED if symbol.isupper() else 0
        for p in range(STATES):
            if (p, role) in NEXT:
                ways[p] = _least(ways[p], _after(behind[NEXT[p, role]], extra, "K"))
            ways[p] = _least(ways[p], _after(behind[ADDED[p][0]], RELABEL + extra, "R"))
    return _inserted(ways)


class Automaton:
    """Nodes of the suffixes of the signature looked up last; sorted by reversed spelling, signatures share them."""

    def __init__(self, target: int | None):
        self.path: list[list[Way | None]] = [end_node(target)]
        self.spelled = ""
        self.made = 0

    def solve(self, reversed_signature: str) -> list[Way | None]:
        old, new = self.spelled, reversed_signature
        shared = 0
        for x, y in zip(old, new):
            if x != y:
                break
            shared += 1
        del self.path[shared + 1:]
        for symbol in new[shared:]:
            self.path.append(node(symbol, self.path[-1]))
            self.made += 1
        self.spelled = new
        return self.path[-1]


def _place(rows: DataFrame, segment: int) -> DataFrame:
    """Rows in order: ``place`` over all rows, and ``seg``, the place at which the row's segment begins."""
    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("mark"), F.asc("nr")]
    ordered = rows.withColumn("nr", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("nr")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done, begin, last = TaskContext.get().partitionId(), 0, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            conv = batch.column(0).fill_null(0).to_numpy()
            new = np.concatenate(([last != (bool(known[0]), int(conv[0]))], (conv[1:] != conv[:-1]) | (known[1:] != known[:-1])))
            at = np.arange(done, done + n)
            begins = np.maximum.accumulate(np.where(new, at, begin))
            base = np.int64(part) << 40
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(base + at), pa.array(base + at - (at - begins) % segment)],
                                             names=[*batch.schema.names, "part", "place", "seg"])
            done, begin, last = done + n, int(begins[-1]), (bool(known[-1]), int(conv[-1]))

    return ordered.mapInArrow(number, "conv_id long, turn long, role string, text string, mark binary, part long, place long, seg long")


def _solved(signatures: DataFrame) -> DataFrame:
    """Ways of each distinct (``signature``, ``ends``): per state in and out at ``4 * in + out`` the cost and the audit.
    Where the conversation ends, ``out`` is 0."""
    spelled = signatures.select("signature", "ends").distinct().withColumn("spelled", F.reverse("signature"))
    ordered = spelled.repartitionByRange("ends", "spelled").sortWithinPartitions("ends", "spelled")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [Automaton(None)]
        inner = [Automaton(t) for t in range(STATES)]
        for batch in batches:
            costs, audits = [], []
            for text, ends in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [a.solve(text) for a in (last if ends else inner)]
                ways = [found[q][p] if q < len(found) else None for p in range(STATES) for q in range(STATES)]
                costs.append([w and w[0] for w in ways])
                audits.append([w and w[1] for w in ways])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))],
                                             names=["signature", "ends", "costs", "audits"])

    return ordered.mapInArrow(solve, "signature string, ends boolean, costs array<bigint>, audits array<string>")


def _illegal(before: str, after: str) -> int:
    return int(before + after not in ("su", "ua", "au"))


def _compose(parts: list[dict], last: bool) -> dict:
    """One part from neighbours: ways for each state in and out (out is 0 at an end), and with each the states at which
    the parts are left, in a row.  Many parts are composed by tens, so that audits are copied a few times only."""
    if len(parts) > FEW:
        cuts = range(0, len(parts), FEW)
        parts = [_compose(parts[i:i + FEW], last and i == cuts[-1]) for i in cuts]
        return _compose(parts, last)
    whole = {"costs": [None] * STATES * STATES, "audits": [None] * STATES * STATES, "states": [None] * STATES * STATES}
    for q in [0] if last else range(STATES):
        behind: list[tuple[int, str, str] | None] = [(0, "", "") if last or p == q else None for p in range(STATES)]
        for i in range(len(parts) - 1, -1, -1):
            costs, audits, states = parts[i]["costs"], parts[i]["audits"], parts[i].get("states")
            outs = [0] if last and i == len(parts) - 1 else range(STATES)
            ways = []
            for p in range(STATES):
                found = [(costs[4 * p + out] + behind[out][0], audits[4 * p + out] + behind[out][1], out)
                         for out in outs if costs[4 * p + out] is not None and behind[out] is not None]
                best = min(found, default=None)
                ways.append(best and (*best[:2], (states[4 * p + best[2]] if states else str(best[2])) + behind[best[2]][2]))
            behind = ways
        for p, way in enumerate(behind):
            if way is not None:
                for name, value in zip(whole, way, strict=True):
                    whole[name][4 * p + q] = value
    return whole


_WAYS = "costs array<bigint>, audits array<string>"


def _long(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations of several segments: their summary, and the states at which each segment is entered and left."""

    def within(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["seg"])
        ends = rows[-1]["ends"]
        whole = _compose(rows, ends)
        illegal = sum(r["illegal"] for r in rows) + sum(_illegal(a["initials"][-1], b["initials"][0]) for a, b in zip(rows, rows[1:]))
        return pa.Table.from_pylist([{
            "conv_id": rows[0]["conv_id"], "part": rows[0]["part"], "ends": ends, **whole, "segs": [r["seg"] for r in rows], "initials": rows[0]["initials"][0] + rows[-1]["initials"][-1], "illegal": illegal}],
            schema=pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("ends", pa.bool_()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())),
                              ("states", pa.list_(pa.string())), ("segs", pa.list_(pa.int64())), ("initials", pa.string()), ("illegal", pa.int64())]))

    def over(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        whole = _compose(rows, True)
        cost, audit = whole["costs"][0], whole["audits"][0]
        illegal = sum(r["illegal"] for r in rows) + sum(_illegal(a["initials"][-1], b["initials"][0]) for a, b in zip(rows, rows[1:]))
        enter, out = 0, [{"conv_id": rows[0]["conv_id"], "cost": cost, "audit": audit, "illegal": illegal}]
        for r, leave in zip(rows, whole["states"][0], strict=True):
            out.append({"conv_id": r["conv_id"], "part": r["part"], "enter": enter, "leave": int(leave)})
            enter = int(leave)
        return pa.Table.from_pylist(out, schema=pa.schema([("conv_id", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64()),
                                                           ("part", pa.int64()), ("enter", pa.int32()), ("leave", pa.int32())]))

    by_part = stored(segments.groupBy("conv_id", "part").applyInArrow(
        within, f"conv_id long, part long, ends boolean, {_WAYS}, states array<string>, segs array<bigint>, initials string, illegal long"), "structure-parts")
    whole = stored(by_part.drop("segs", "states").groupBy("conv_id").applyInArrow(
        over, "conv_id long, cost long, audit string, illegal long, part long, enter int, leave int"), "structure-long")
    found = by_part.alias("p").join(whole.filter("part IS NOT NULL").alias("w"), F.expr("p.conv_id <=> w.conv_id AND p.part = w.part"))
    found = found.select(F.col("p.segs").alias("segs"), "enter", F.expr("p.states[4 * w.enter + if(p.ends, 0, w.leave)]").alias("left"))
    entered = F.posexplode("segs")
    found = found.select("enter", "left", entered.alias("i", "seg")).selectExpr(
        "seg", "int(if(i = 0, enter, int(substring(left, i, 1)))) AS enter", "int(substring(left, i + 1, 1)) AS leave")
    return whole.filter("part IS NULL").select("conv_id", "cost", "audit", "illegal"), found


_TURN = pa.struct([("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of each segment after its edits, from the state in which it is entered."""
    for batch in batches:
        out = []
        for rows, audit, state in zip(batch.column("rows").to_pylist(), batch.column("audit").to_pylist(), batch.column("enter").to_pylist(), strict=True):
            turns, waiting = [], iter(rows)
            for edit in audit:
                row = next(waiting) if edit != "I" else None
                if edit == "D":
                    continue
                if edit == "K":
                    state, role = NEXT[state, row["role"][0]], row["role"]
                else:
                    state, role = ADDED[state]
                turns.append({"edit": edit, "turn": row and row["turn"], "role": role, "text": row["text"] if row else ""})
            out.append(turns)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("seg"), batch.column("n_segments"), pa.array(out, pa.list_(_TURN))],
                                         names=["conv_id", "segment", "n_segments", "turns"])


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` per conversation, and the repaired
    turns as ``conv_id, segment, n_segments, turns`` (an array of edit, turn, role and text; segments in ascending order).

    ``gaps`` are the turn numbers missing between the least and the greatest; ``illegal`` are neighbours whose initials
    aren't ``su``, ``ua`` or ``au``.
    """
    ship(rows.sparkSession)
    role, text = F.coalesce(rows[role_col].cast("string"), F.lit(" ")), F.coalesce(rows[text_col].cast("string"), F.lit(" "))
    base = rows.select(rows[conv_col].cast("long").alias("conv_id"), rows[turn_col].cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    base = base.withColumn("mark", F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text")), 256)))
    placed = stored(_place(base, segment), "structure-rows")
    firsts = placed.groupBy("conv_id", "mark").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("is_first"))
    seen = placed.select(
        "conv_id", "turn", "part", "place", "seg", F.expr("CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'o' END AS initial"),
        F.right(F.rtrim(F.col("text"), F.lit(_SPACE)), F.lit(1)).alias("ending"))
    seen = seen.join(firsts, "place", "left").selectExpr(
        "*", "CASE WHEN ending = '' THEN 'blank' WHEN is_first IS NULL THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' END AS fault")
    seen = seen.withColumn("symbol", F.expr("CASE fault WHEN 'blank' THEN 'd' WHEN 'duplicate' THEN 'd' WHEN 'truncated' THEN upper(initial) ELSE initial END"))
    seen = stored(seen.select("conv_id", "turn", "part", "place", "seg", "initial", "symbol", "fault"), "structure-faults")

    counts = seen.groupBy("conv_id").agg(
        F.expr("coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)").alias("gaps"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    segments = seen.groupBy("conv_id", "part", "seg").agg(F.sort_array(F.collect_list(F.struct("place", "initial", "symbol"))).alias("rows")).selectExpr(
        "*", "array_join(rows.symbol, '') AS signature", "array_join(rows.initial, '') AS initials").drop("rows")
    segments = segments.withColumn("illegal", F.expr(
        "if(length(initials) < 2, 0L, bigint(size(filter(sequence(1, length(initials) - 1), i -> substring(initials, i, 2) NOT IN ('su', 'ua', 'au')))))"))
    several = segments.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("seg").alias("final")).filter("n > 1")
    segments = segments.alias("s").join(several.alias("m"), F.expr("s.conv_id <=> m.conv_id"), "left").selectExpr(
        "s.*", "coalesce(n, 1L) AS n_segments", "coalesce(seg = final, true) AS ends")
    segments = stored(segments, "structure-segments")

    # One signature may be a third of all segments: it is met under several salts.
    solved = stored(_solved(segments), "structure-solved").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    ways = segments.withColumn("salt", F.pmod(F.xxhash64("seg"), F.lit(SALTS)).cast("int")).join(solved, ["signature", "ends", "salt"]).drop("salt")
    short = ways.filter("n_segments = 1").selectExpr("conv_id", "seg", "0 AS enter", "0 AS leave", "costs[0] AS cost", "audits[0] AS audit", "illegal")
    more = stored(ways.filter("n_segments > 1"), "structure-ways")
    summaries, borders = _long(more)
    summary = short.select("conv_id", "cost", "audit", "illegal").unionByName(summaries)
    conversations = counts.alias("c").join(summary.alias("s"), F.expr("c.conv_id <=> s.conv_id")).select(
        "c.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    inner = more.join(borders, "seg").selectExpr("seg", "enter", "audits[4 * enter + if(ends, 0, leave)] AS audit", "n_segments")
    edits = short.selectExpr("seg", "enter", "audit", "1L AS n_segments").unionByName(inner)
    texts = placed.groupBy("seg").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("place", "turn", "role", "text"))).alias("rows"))
    turns = texts.join(edits, "seg").select("conv_id", "seg", "n_segments", "rows", "audit", "enter").mapInArrow(
        _apply, "conv_id long, segment long, n_segments long, turns array<struct<edit:string,turn:bigint,role:string,text:string>>")
    return conversations, stored(turns, "structure-turns")


def joined_sha256(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: digest of all ``role:text`` of a conversation, joined by line ends.

    A digest reads its text in order, so a conversation of several segments passes through one task, segment by segment,
    sorted outside Python's memory; nothing of it is held but the running digest.
    """
    text = "array_join(transform(turns, t -> concat(t.role, ':', t.text)), '\n')"
    one = turns.filter("n_segments = 1").select("conv_id", F.expr(f"sha2({text}, 256)").alias("repaired_sha256"))
    more = turns.filter("n_segments > 1 AND size(turns) > 0").select("conv_id", "segment", F.expr(text).alias("text"))
    nothing = turns.filter("n_segments > 1").select("conv_id").distinct().withColumns({"segment": F.lit(-1).cast("long"), "text": F.lit(None).cast("string")})

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        current, running, first = None, None, True
        for batch in batches:
            done = []
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if running is None or conv != current:
                    if running is not None:
                        done.append((current, running.hexdigest()))
                    current, running, first = conv, hashlib.sha256(), True
                if text is not None:
                    running.update(("" if first else "\n").encode() + text.encode())
                    first = False
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([c for c, _ in done], pa.int64()), "repaired_sha256": pa.array([d for _, d in done], pa.string())})
        if running is not None:
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([current], pa.int64()), "repaired_sha256": pa.array([running.hexdigest()], pa.string())})

    ordered = more.unionByName(nothing).repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return one.unionByName(ordered.mapInArrow(digest, "conv_id long, repaired_sha256 string"))


def oracle() -> str:
    """The same by SQL: one pass over each conversation's rows, holding the best edits so far for each state."""
    struct = "{{c: {c}, a: {a}, r: {r}}}"

    def step(state: str, cost: str, edit: str, line: str) -> str:
        return struct.format(c=f"{state}.c + {cost}", a=f"{state}.a || '{edit}'", r=f"{state}.r || {line}")

    def least(*ways: str) -> str:
        return f"list_min(list_filter([{', '.join(ways)}], lambda w: w.c IS NOT NULL))"

    none = "{c: NULL::BIGINT, a: NULL::VARCHAR, r: NULL::VARCHAR}"

    def or_none(way: str) -> str:
        return f"coalesce({way}, {none})"

    user, assistant = "'user:' || chr(10)", "'assistant:' || chr(10)"
    insert_u = or_none(least("f2", *[step(f"f{p}", str(INSERT), "I", user) for p in (0, 1, 3)]))
    insert_a = or_none(least("f3", step("g2", str(INSERT), "I", assistant)))
    keep, text = f"if(fault = 'truncated', {TRUNCATED}, 0)", "text || chr(10)"

    def entered(state: int) -> str:
        ways = [step(f"g{state}", str(DELETE), "D", "''")]
        for (p, role), q in NEXT.items():
            if q == state:
                kept = step(f"g{p}", keep, "K", f"role || ':' || {text}")
                ways.append(f"if(initial = '{role}' AND {keeps}, {kept}, {none})")
        for p, (q, role) in ADDED.items():
            if q == state:
                named = step(f"g{p}", f"{RELABEL} + {keep}", "R", f"'{role}:' || {text}")
                ways.append(f"if({keeps}, {named}, {none})")
        return or_none(least(*ways))

    keeps = "coalesce(fault, '') NOT IN ('blank', 'duplicate')"
    return f"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1)) AS v FROM (SELECT unnest(range(256)) AS i))),
hashed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295::BIGINT,
    [ord(x)::BIGINT for x in string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')]),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS hit FROM conversations, crc),
damaged AS (SELECT conv_id, turn, if(hit = 4, 'user', role) AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(if(hit = 3, 2, 1))) AS copy FROM hashed WHERE hit <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS i,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS initial, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ending FROM damaged),
judged AS (SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM placed),
best AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, {{c: 0::BIGINT, a: '', r: ''}} AS f0, {none} AS f1, {none} AS f2, {none} AS f3 FROM judged
    UNION ALL
    SELECT conv_id, i, {entered(0)}, {entered(1)}, {entered(2)}, {entered(3)}
    FROM (SELECT *, {insert_a} AS g3 FROM (SELECT b.conv_id, j.i, f0 AS g0, f1 AS g1, f3, {insert_u} AS g2, role, text, initial, fault
        FROM best b JOIN judged j ON b.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = b.i + 1))),
ended AS (SELECT conv_id, {least('f0', 'g3')} AS way FROM (SELECT *, {insert_a} AS g3 FROM (
    SELECT conv_id, f0, f3, {insert_u} AS g2 FROM best QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1))),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate,
    count_if(fault = 'truncated') AS truncated, count_if(earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(way.c, 0)::BIGINT AS cost, coalesce(way.a, '') AS audit,
    sha256(coalesce(left(way.r, greatest(length(way.r) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
    LEFT JOIN counts k ON o.conv_id IS NOT DISTINCT FROM k.conv_id"""
