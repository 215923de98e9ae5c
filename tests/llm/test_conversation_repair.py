import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

from tracemill.llm import op13_conversation_repair as op
from tracemill.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def damage(rows):
    for c, t, role, text in rows:
        sp = lambda v: " " if v is None else str(v)
        k = zlib.crc32(f"{sp(c)}:{sp(t)}".encode()) % 20
        if k:
            row = (c, t, "user" if k == 4 else sp(role), "" if k == 1 else re.sub("[.!?]", "", sp(text)) if k == 2 else sp(text))
            yield from [row] * (2 if k == 3 else 1)


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        last = text.rstrip(BLANK)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else None if last in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Plain search: for every state the least (cost, audit), over rows in order, with the roles it makes."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {"": (0, "", ())}

    def inserts(now):
        for _ in range(4):
            for q, (cost, audit, lines) in list(now.items()):
                for to in ("u", "a"):
                    if to in step[q]:
                        new = (cost + 5, audit + "I", (*lines, ({"u": "user", "a": "assistant"}[to], "")))
                        if to not in now or new[:2] < now[to][:2]:
                            now[to] = new
        return now

    for (_, _, role, text), fault in zip(rows, faults(rows), strict=True):
        now = {}
        for q, (cost, audit, lines) in inserts(best).items():
            moves = [(2, "D", q, ())]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if role[:1] in step[q]:
                    moves.append((more, "K", step[q][role[:1]], ((role, text),)))
                for to, name in (("u", "user"), ("a", "assistant")):
                    if to in step[q]:
                        moves.append((more + 1, "R", step[q][to], ((name, text),)))
            for c, letter, to, line in moves:
                new = (cost + c, audit + letter, lines + line)
                if to not in now or new[:2] < now[to][:2]:
                    now[to] = new
        best = now
    return min((v for q, v in inserts(best).items() if q in ("", "a")), key=lambda v: v[:2])


def report(rows):
    """What the operator must return for one conversation's rows in order."""
    f = faults(rows)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, lines = cheapest(rows)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return (gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, digest)


def key(r):
    return (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).hexdigest())


def expected(rows, ids):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    return {c: report(sorted(by[c], key=key)) for c in ids}


def random_rows(r, n, convs, roles=("user", "assistant", "system", "tool", "", None, "user", "assistant")):
    texts = ["Yes.", "no", " ", "", None, "What?", "cut off", "Ok!", "same text.", "é.\t\n", "x" * 30]
    return [(r.choice([*range(convs), None]), r.choice([None, *range(9)]), r.choice(roles), r.choice(texts)) for _ in range(n)]


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_query_equals_plain_search(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").collect()]
    out = op.op13_conversation_repair(spark, SF)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got(out) == expected(damage(rows), {r[0] for r in rows})


def test_awkward_rows(spark):
    rows = random_rows(random.Random(3), 300, 25)
    rows += [(100, 0, "user", "Long. " * 60000), (100, 1, "assistant", None), (101, None, None, None), (102, 5, "assistant", "Alone."), (103, 2**40, "user", "Far."), (103, -5, "system", "Far?")]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3).select("*", *[F.lit("clash").alias(c) for c in ("blk", "rk", "sign", "tag", "key", "row", "vector", "times", "copy")])
    want = expected(damage(rows), {r[0] for r in rows})
    assert got(op.repair_report(op.damaged(df), df.select("conv_id").distinct())) == want
    empty = spark.createDataFrame([], SCHEMA)
    assert op.repair_report(empty, empty.select("conv_id")).count() == 0
    assert op.repaired(empty).count() == 0


def test_conversations_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_BITS", 2)
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", "system", "x"]), r.choice(["A.", "b", "c?", " ", f"{t}.", f"{t}!"])) for c, n in ((1, 150), (2, 3), (3, 40), (None, 60)) for t in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(op.repair_report(df, df.select("conv_id").distinct())) == expected(rows, {r[0] for r in rows})


def test_repaired_lines_are_right_and_digest_alike(spark):
    rows = random_rows(random.Random(8), 200, 12)
    df = spark.createDataFrame(rows, SCHEMA)
    lines = defaultdict(list)
    for c, place, edit, role, text in sorted(map(tuple, op.repaired(df).collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        assert place == len(lines[c])
        lines[c].append((role, text))
    for c, row in got(op.repair_report(df, df.select("conv_id").distinct())).items():
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines[c]))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines[c]).encode()).hexdigest() == row[-1]


def test_checkpoints_do_not_change_the_walk():
    r = random.Random(1)
    for n in (0, 1, 2, 5, 30, 200):
        signs = "".join(r.choice("suaxSUAXD") for _ in range(n))
        cost, _ = op.backward(signs, op.END)
        edits = [e for e, _ in op.walk(signs, op.END, 0)]
        assert len(edits) == n
        v, flat = op.END, []
        for s in reversed(signs):
            v, _, m = op.step(s, v)
            flat.append(m)
        state, plain = 0, []
        for m in reversed(flat):
            e, state = m[state]
            plain.append(e)
        assert edits == plain
        matrix = op.block_matrix(signs)
        assert min(matrix[j] + op.END[j] for j in range(4)) == cost[0] or n == 0
