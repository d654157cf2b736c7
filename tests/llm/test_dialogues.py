import functools
import hashlib
import random
import re
import zlib

import pytest

from larkspur.llm import dialogues

SCHEMA = "conv_id long, turn long, role string, text string, at int, audit string, place long"
LEGAL = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(k, 1)
    return out


def brute(rows):
    """Counts, edits and digest of one conversation, by trying all edits."""
    rows = sorted(((t, r or " " if r is None else r, " " if x is None else x) for _, t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    seen, kinds = set(), []
    for _, role, text in rows:
        kept = text.rstrip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))

    @functools.cache
    def best(i, state, inserts):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def more(cost, letter, i, state, inserts, row):
            rest = best(i, state, inserts)
            if rest:
                found.append((cost + rest[0], letter + rest[1], row + rest[2]))

        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        names = {"u": "user", "a": "assistant"}
        if inserts < 3:
            for x in follow.replace("s", ""):
                more(3, "I", i, x, inserts + 1, ((names[x], ""),))
        if i < len(rows):
            _, role, text = rows[i]
            more(4, "D", i + 1, state, 0, ())
            if kinds[i] not in ("blank", "duplicate"):
                extra = 3 * (kinds[i] == "truncated")
                if initials[i] and initials[i] in follow:
                    more(extra, "K", i + 1, initials[i], 0, ((role, text),))
                for x in follow.replace("s", ""):
                    more(3 + extra, "R", i + 1, x, 0, ((names[x], text),))
        return min(found) if found else None

    for i in range(len(rows), -1, -1):  # from the end, so that calls don't nest
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    cost, audit, out = best(0, "", 0)
    assert LEGAL.fullmatch("".join(r[0] for r, _ in out))
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()), out


def some(r, n, longest=9):
    rows = []
    for conv in range(n):
        texts = ["Yes.", "No!", "cut", "what?", "", " \n", None, "long one \x1c", "end. \t", "é.", "mehr…"]
        for turn in range(r.randint(1, longest)):
            role = r.choice([*["user", "assistant"] * 4, "system", "tool", "", None, "User", "assistant2"]) if r.random() < 0.5 else ("user", "assistant")[turn % 2]
            rows.append((conv, r.choice([turn, turn + 1, None, 3 * turn, turn]) if r.random() < 0.4 else turn, role, r.choice(texts) if r.random() < 0.6 else f"t{r.random()}."))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, 0, "K", 5) for x in rows], SCHEMA).repartition(3)


def result(df):
    return {x.conv_id: tuple(x[c] for c in (*dialogues.COUNTS, "audit", "repaired_sha256")) for x in df.collect()}


def by_conversation(rows, ids):
    out = {i: [] for i in ids}
    for x in rows:
        out[x[0]].append(x)
    return out


@pytest.mark.parametrize("held", [100_000, 7])
def test_repairs_equal_brute_force(spark, monkeypatch, held):
    if held == 7:  # the workers import the module anew, so that the small bound is tested in this process
        rows = frame(spark, some(random.Random(1), 30))
        table = dialogues.faults(rows, None).coalesce(1).toArrow()
        monkeypatch.setattr(dialogues, "HELD", held)
        parts = list(dialogues.solved(iter(table.to_batches(max_chunksize=3))))
        assert len(parts) > 1
        got = {x["conv_id"]: x for p in parts for x in p.to_pylist()}
        assert got == {x["conv_id"]: x.asDict() for x in dialogues.repair(rows).collect()}
        return
    r = random.Random(12)
    rows = some(r, 120) + [(None, 1, "user", "a."), (None, None, None, None), (500, 4, "user", "x."), *[(501, i % 700, ("user", "assistant")[i % 3 % 2], f"{i % 90}.") for i in range(400)]]
    df = frame(spark, rows)
    found = dialogues.repair(df)
    want = {i: brute(x) for i, x in by_conversation(rows, {x[0] for x in rows}).items()}
    assert result(dialogues.digests(df, found)) == {i: x[0] for i, x in want.items()}
    repaired = {}
    for x in sorted(dialogues.repaired(df, found).collect(), key=lambda x: x.place):
        repaired.setdefault(x.conv_id, []).append((x.role, x.text))
    assert repaired == {i: [*x[1]] for i, x in want.items() if x[1]}


def test_damage_and_whole_conversations(spark):
    rows = some(random.Random(3), 200) + [(900 + i, i, "user", "Gone?") for i in range(60)] + [(None, None, "user", "a?")]
    df = frame(spark, rows)
    bad = damaged(rows)
    assert sorted(map(str, (tuple(x) for x in dialogues.damage(df).collect()))) == sorted(map(str, bad))
    ids = {x[0] for x in rows}
    got = result(dialogues.digests(dialogues.damage(df), dialogues.repair(dialogues.damage(df), df)))
    assert got == {i: brute(x)[0] for i, x in by_conversation(bad, ids).items()}
    assert any(not x for x in by_conversation(bad, ids).values())


def test_empty_tables_and_long_texts(spark):
    assert dialogues.repair(frame(spark, []), frame(spark, [])).count() == 0
    rows = [(1, 0, "user", "a " * 2_000_000 + "."), (1, 2**62, "assistant", "b."), (1, 2**62, "assistant", "b.")]
    df = frame(spark, rows)
    assert result(dialogues.digests(df, dialogues.repair(df))) == {1: brute(rows)[0]}


def test_one_shuffle_by_conversation(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    plan = dialogues.faults(rows, None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(conv_id") - plan.count("hashpartitioning(conv_id, ") <= 2
    assert "hashpartitioning(role" not in plan and plan.count("Exchange") <= 3
