"""Conversation structure repair: cheapest edits that make roles alternate, by a square-root checkpointed DP.

A conversation is right where the initials of its roles read ``(s?(ua)+)?``. The automaton has four states: nothing
yet, after s, after u, after a. For the rows from i on, a vector holds the least cost from every state; it follows
from the vector at i + 1 alone, so vectors run backward while edits are read off forward. Vectors are kept at
checkpoints only:

* rows of the whole table have one order, cut in blocks of ``BLOCK`` rows. A conversation that lies in several
  blocks first gives one 4 x 4 matrix a block (least cost from state to state, a min-plus product), all
  blocks in parallel; the vectors at the ends of blocks follow from the matrices, 16 numbers for 4096 rows;
* inside a block vectors are kept at every square root of its rows, and the stretch between two of them is computed
  again when the walk gets there.

The walk takes the ASCII-least of the edits that are tight (D, I, K, R), so the audit is the least of the cheapest ones.
Texts pass through the walk one by one; what a task holds is one block's signs, whatever a conversation's length.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import with_group
from .common import BLANKS, only, stored, table

BLOCK_BITS = 12  # rows of a block: 4096
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
END = (0, 10, 5, 0)  # least cost from every state when no row is left
INSERTED = (2, 2, 3, 2)  # the state after an insertion, which is a user's turn or, after a user's, an assistant's
FAR = 1 << 40
INPUTS = ["conv_id", "turn", "role", "text"]
REPORT = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the planted damage, which crc32 of ``conv_id:turn`` chooses; nulls count as a blank."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    out = only(rows, *INPUTS).filter(kind != 0)
    out = out.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return out.withColumn("copy", F.explode(F.expr("sequence(1, times)"))).select(*INPUTS)


@lru_cache(maxsize=1 << 16)
def step(sign: str, after: tuple):
    """The vector before a row of this sign, less its minimum; the minimum; and per state the edits and the next state.

    Signs: the initial of the role (x for any other than s, u, a), upper case where the row is truncated, or D for a row that
    must go. An edit is its letter with the role that it makes (for I and R).
    """
    low, more = sign.lower(), TRUNCATED if sign.isupper() else 0
    plain, ways = [], []
    for q in range(4):
        turn, name = (3, "assistant") if q == 2 else (2, "user")
        way = [(DELETE + after[q], "D", q, None)]
        if sign != "D":
            if low == "s" and q == 0:
                way.append((more + after[1], "K", 1, None))
            if low == name[0]:
                way.append((more + after[turn], "K", turn, None))
            way.append((more + REROLE + after[turn], "R", turn, name))
        ways.append(way)
        plain.append(min(w[0] for w in way))
    u, a = min(plain[2], INSERT + plain[3]), min(plain[3], INSERT + plain[2])
    best = [min(plain[0], INSERT + u), min(plain[1], INSERT + u), u, a]
    moves = []
    for start in range(4):
        q, edits = start, []
        while True:
            if ways[q][0][0] == best[q]:
                edits, q = [*edits, ("D", None)], q
                break
            if INSERT + best[INSERTED[q]] == best[q]:
                edits.append(("I", "assistant" if q == 2 else "user"))
                q = INSERTED[q]
                continue
            _, letter, then, role = next(w for w in ways[q][1:] if w[0] == best[q])
            edits, q = [*edits, (letter, role)], then
            break
        moves.append((tuple(edits), q))
    least = min(best)
    return tuple(min(b - least, FAR) for b in best), least, tuple(moves)


def backward(signs: str, end: tuple, every: int | None = None):
    """The absolute vector before the first row, and the vectors (less their minima) at multiples of ``every``."""
    marks, v, off = {}, end, 0
    for i in range(len(signs) - 1, -1, -1):
        v, least, _ = step(signs[i], v)
        off += least
        if every and i % every == 0:
            marks[i] = v
    return tuple(min(x + off, FAR) for x in v), marks


def walk(signs: str, end: tuple, state: int):
    """Per row its tight edits, ASCII-least first, from ``state`` on; the state after each row comes with them."""
    n = len(signs)
    every = max(1, isqrt(n))
    _, marks = backward(signs, end, every)
    for lo in range(0, n, every):
        hi = min(n, lo + every)
        v, moves = marks.get(hi, end) if hi < n else end, []
        for i in range(hi - 1, lo - 1, -1):
            v, _, m = step(signs[i], v)
            moves.append(m)
        for m in reversed(moves):
            edits, state = m[state]
            yield edits, state


def _base(end) -> tuple:
    """A vector less its minimum, so that equal steps are met again."""
    return tuple(x - min(end) for x in end)


def block_matrix(signs: str) -> list[int]:
    """Least costs from the states before the block (rows) to those after it (columns), as 16 numbers."""
    columns = [backward(signs, tuple(0 if j == q else FAR for j in range(4)))[0] for q in range(4)]
    return [columns[j][i] for i in range(4) for j in range(4)]


def _messages(batches):
    """The walk over sorted rows of whole conversations: ("line", conv, edit, role, text) for every line of a repaired
    conversation and every deleted row, then ("end", conv, counts) for each conversation."""
    conv, open_ = None, False
    for b in batches:
        for c, tag, rk, turn, sign, role, text, vector in zip(*[b.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6, 7, 8)], strict=True):
            if not open_ or c != conv:
                if open_:
                    yield from _close(conv, state, counts)
                conv, open_, state, last_turn, last = c, True, 0, None, None
                counts = {"turns": 0, "first": None, "last": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": None}
                copies, signs, end, edits = set(), [], END, None
            if tag in (1, 2, 3) and edits is not None:  # a block begins
                copies, signs, end, edits = set(), [], END, None
            if tag == 1:
                end = tuple(vector)
            elif tag == 2:
                copies.add(rk)
            elif tag == 3:
                if turn is not None:
                    counts["first"] = turn if counts["first"] is None else counts["first"]
                    counts["turns"] += turn != counts["last"]
                    counts["last"] = turn
                if last is not None and last + role not in ("su", "ua", "au"):
                    counts["illegal"] += 1
                last = role
                fault = "blank" if sign == "D" else "duplicate" if rk in copies else "truncated" if sign.isupper() else None
                if fault:
                    counts[fault] += 1
                signs.append("D" if fault == "duplicate" else sign)
            elif tag == 4:
                if edits is None:
                    whole = "".join(signs)
                    if counts["cost"] is None:
                        counts["cost"] = backward(whole, end)[0][0]
                    edits = walk(whole, _base(end), state)
                made, state = next(edits)
                for letter, new in made:
                    yield ("line", conv, letter, new or role, "" if letter == "I" else text)
    if open_:
        yield from _close(conv, state, counts)


def _close(conv, state, counts):
    while END[state]:
        yield ("line", conv, "I", "assistant" if state == 2 else "user", "")
        state = INSERTED[state]
    yield ("end", conv, counts)


def _stream(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows for ``_messages``: per conversation a mark, then per block its end vector, copies, signs and texts, in this order.

    ``ids`` holds the conversations that must be reported, ``rows`` their rows.
    """
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    first = F.left("role", F.lit(1))
    initial = F.when(first.isin("s", "u", "a"), first).otherwise("x")
    sign = F.when(last == "", "D").when(last.isin(".", "!", "?"), initial).otherwise(F.upper(initial))
    key = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    # The row's own number comes last in the order, so that any number of equal rows can be cut in ranges.
    order = ["conv_id", "turn", "role", "key", "row"]
    base = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("sign", sign).withColumn("key", key)
    base = base.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rk", F.monotonically_increasing_id()).drop("row")
    base = stored(base).withColumn("blk", F.shiftright("rk", BLOCK_BITS))

    signs = base.select("conv_id", "blk", "rk", "turn", "sign", first.alias("role"))
    keyed = base.filter("sign <> 'D'").select(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), "key").alias("key"), "conv_id", "blk", "rk")
    copies = stored(with_group(keyed, "key", "rk", {"_m": F.min("rk")}, {"m": F.min("_m")}).filter("rk > m").select("conv_id", "blk", "rk"))

    conv = rows.schema["conv_id"].dataType.simpleString()
    ends = checkpoints(signs, copies, conv)
    kinds = {"turn": "long", "sign": "string", "role": "string", "text": "string", "vector": "array<long>"}

    def tagged(df, tag, *have):
        rk = F.col("rk") if "rk" in df.columns else F.lit(None).cast("long")
        return df.select("conv_id", F.col("blk") if "blk" in df.columns else F.lit(-1).cast("long").alias("blk"), F.lit(tag).alias("tag"), rk.alias("rk"), *[(F.col(n).cast(k) if n in have else F.lit(None).cast(k)).alias(n) for n, k in kinds.items()])

    every = tagged(ids, 0).unionByName(tagged(ends, 1, "vector")).unionByName(tagged(copies, 2)).unionByName(tagged(signs, 3, "turn", "sign", "role")).unionByName(tagged(base, 4, "role", "text"))
    return every.repartition("conv_id").sortWithinPartitions("conv_id", "blk", "tag", "rk")


def checkpoints(signs: DataFrame, copies: DataFrame, conv: str) -> DataFrame:
    """conv_id, blk, vector: least costs after each block of the conversations that lie in several blocks."""
    several = signs.groupBy("conv_id").agg(F.min("blk").alias("lo"), F.max("blk").alias("hi")).filter("lo < hi").select(F.col("conv_id").alias("c"))
    some = signs.join(several, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").select("conv_id", "blk", "rk", "sign")
    some = some.join(copies.select("rk", F.lit("D").alias("gone")), "rk", "left").select("conv_id", "blk", "rk", F.coalesce("gone", "sign").alias("sign"))

    def matrices(t: pa.Table) -> pa.Table:
        m = block_matrix("".join(t.sort_by("rk")["sign"].to_pylist()))
        return pa.table({"conv_id": t["conv_id"].slice(0, 1), "blk": t["blk"].slice(0, 1), "m": pa.array([m], pa.list_(pa.int64()))})

    def vectors(t: pa.Table) -> pa.Table:
        t = t.sort_by([("blk", "descending")])
        out, v = [], END
        for m in t["m"].to_pylist():
            out.append(list(v))
            v = tuple(min(m[4 * i + j] + v[j] for j in range(4)) for i in range(4))
        return pa.table({"conv_id": t["conv_id"], "blk": t["blk"], "vector": pa.array(out, pa.list_(pa.int64()))})

    blocks = some.groupBy("conv_id", "blk").applyInArrow(matrices, f"conv_id {conv}, blk long, m array<long>")
    return blocks.groupBy("conv_id").applyInArrow(vectors, f"conv_id {conv}, blk long, vector array<long>")


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place, edit, role, text: the lines of every repaired conversation in order (place from 0), with their edits.

    Rows (conv_id, turn, role, text) go by turn, nulls first, rows of one turn by role and a digest. Nulls of role and
    text count as one blank; rows without conv_id make one conversation. Blank rows and later copies of a row go.
    A conversation of which nothing stays, and an empty table, give no lines; other columns are left out.
    """
    conv = rows.schema["conv_id"].dataType.simpleString()
    kept = _whole(rows)

    def lines(batches):
        conv_type = None
        out, place, at = [[], [], [], [], []], 0, None

        def flush():
            made = pa.record_batch([pa.array(out[0], conv_type), pa.array(out[1], pa.int64()), *[pa.array(x, pa.string()) for x in out[2:]]], ["conv_id", "place", "edit", "role", "text"])
            for x in out:
                x.clear()
            return made

        def typed():
            nonlocal conv_type
            for b in batches:
                conv_type = b.schema.field(0).type
                yield b

        size = 0
        for kind, *x in _messages(typed()):
            if kind == "end":
                place = 0
                continue
            if x[1] == "D":
                continue
            for o, v in zip(out, (x[0], place, x[1], x[2], x[3]), strict=True):
                o.append(v)
            place += 1
            size += len(x[3])
            if len(out[0]) >= 5000 or size > 4_000_000:
                size = 0
                yield flush()
        if out[0]:
            yield flush()

    return _stream(kept, kept.select("conv_id").distinct()).mapInArrow(lines, f"conv_id {conv}, place long, edit string, role string, text string")


def _whole(rows: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return only(rows, *INPUTS).select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))


def repair_report(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for every conv_id of ``ids``: gaps, faults, illegal neighbours, cost, audit, and the digest of the repaired lines.

    The lines are those of ``repaired``, digested one by one as the walk gives them. Conversations without rows: zeros,
    an empty audit and the digest of nothing. An audit is one string, a letter an edit.
    """
    def digests(batches):
        held, audit, sha, kind_of = [], [], hashlib.sha256(), None

        def typed():
            nonlocal kind_of
            for b in batches:
                kind_of = b.schema.field(0).type
                yield b

        names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

        def flush():
            cols = list(zip(*held, strict=True))
            held.clear()
            return pa.record_batch([pa.array(cols[0], kind_of), *[pa.array(c, pa.int64()) for c in cols[1:7]], pa.array(cols[7], pa.string()), pa.array(cols[8], pa.string())], ["conv_id", *names])

        any_line = False
        for kind, conv, *x in _messages(typed()):
            if kind == "line":
                letter, role, text = x
                audit.append(letter)
                if letter != "D":
                    sha.update(f"{chr(10) if any_line else ''}{role}:{text}".encode())
                    any_line = True
                continue
            n = x[0]
            gaps = n["last"] - n["first"] + 1 - n["turns"] if n["turns"] else 0
            held.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], n["illegal"], n["cost"] or 0, "".join(audit), sha.hexdigest()))
            audit, sha, any_line = [], hashlib.sha256(), False
            if len(held) >= 2000:
                yield flush()
        if held:
            yield flush()

    conv = rows.schema["conv_id"].dataType.simpleString()
    return _stream(_whole(rows), ids).mapInArrow(digests, REPORT.format(conv))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on every conversation after the planted damage."""
    rows = table(spark, sf_dir, "conversations")
    return repair_report(damaged(rows), rows.select("conv_id").distinct())
