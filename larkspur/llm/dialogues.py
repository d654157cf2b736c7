"""Conversation structure repair: the cheapest edits that give a conversation a legal order of roles.

The role initials of a repaired conversation match ``(s?(ua)+)?``.  Edits: keep (0),
rerole to user or assistant (3), delete (4), insert a user or assistant turn without text
anywhere (3); a truncated row that isn't deleted costs 3 more, and blank and duplicate
rows must be deleted.  Of the cheapest edit strings the ASCII-least is taken.

1. Spark finds the faults of each row: blank, duplicate (role and text seen earlier in the
   conversation), truncated.  One shuffle by conversation serves the windows and step 2.
2. Each task reads its conversations in order and holds a byte a row until it has some
   thousand conversations; these are put in buckets by length, as tensors with time first.
   One step goes over a turn of all conversations of a bucket: backward over the costs of
   the four states (nothing yet, after s, after u, after a), which are stored, then
   forward along the least letters that keep the cost.
3. Repaired rows and their digests are made by reading the rows again beside the edits.

A task holds ``HELD`` rows' bytes and costs (some 40 bytes a row), or one conversation's if
it is longer, never its texts.  A conversation isn't split: its digest is over all of it.

Rows go by turn (nulls first), then role and text.  Null roles, texts and, where hashed, ids
count as one space; null ids are one conversation.  A role counts by its first character;
only s, u and a can be kept.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.store import arrow_rows

#: Rows whose facts a task holds before it works on them.
HELD = 100_000
WHITE = r" \t\n\u000b\u000c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: Where the next user or assistant turn leads from each state.
NEXT = np.array([AFTER_U, AFTER_U, AFTER_A, AFTER_U])
FAR = np.int64(1) << 50
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
#: A row in a byte: its role (s, u, a, other), whether it must go, whether it is truncated.
ROLE, MUST, CUT = 3, 4, 8


def damage(rows: DataFrame) -> DataFrame:
    """Rows with planted faults, by the crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes ``[.!?]``, 3 repeats it, 4 makes it the user's."""
    named = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    id_, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    how = named.withColumn("k", F.crc32(F.concat(id_, F.lit(":"), turn)) % 20)
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return how.where("k != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def together(rows: DataFrame, heads: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and one head for each conversation in one table, in which ``at`` is 0 for heads."""
    plain = rows.select("conv_id", F.lit(1).alias("at"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return heads.withColumn("at", F.lit(0)).unionByName(plain, allowMissingColumns=True).select("conv_id", "at", "turn", "role", "text", *columns).repartition("conv_id")


def in_order(rows: DataFrame) -> DataFrame:
    return rows.sortWithinPartitions("conv_id", "at", F.col("turn").asc_nulls_first(), "role", "text")


def faults(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    """conv_id, at, turn, code (see ``CUT``), blank and duplicate of each row, in order within each partition."""
    heads = (rows if ids is None else ids).select("conv_id").distinct()
    if ids is not None:
        heads = heads.unionByName(rows.select("conv_id")).distinct()
    every = together(rows, heads, [])
    trimmed = F.expr(f"trim(TRAILING '{WHITE}' FROM text)")
    seen = F.expr("row_number() OVER (PARTITION BY conv_id, at, role, text ORDER BY turn NULLS FIRST) > 1")
    role = F.expr("CASE left(role, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END")
    judged = every.withColumn("blank", trimmed == "").withColumn("duplicate", ~F.col("blank") & seen).withColumn("cut", ~F.right(trimmed, F.lit(1)).isin(".", "!", "?"))
    must = F.col("blank") | F.col("duplicate")
    code = role + F.when(must, MUST).otherwise(0) + F.when(~must & F.col("cut"), CUT).otherwise(0)
    return in_order(judged).select("conv_id", "at", "turn", F.when(F.col("at") == 1, code).cast("tinyint").alias("code"), "blank", "duplicate")


def backward(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Least costs [turn, state, conversation] of what follows; codes are [turn, conversation]."""
    most, n = codes.shape
    costs = np.empty((most + 1, 4, n), np.int64)
    after = np.array([0, FAR, FAR, 0])[:, None].repeat(n, 1)
    costs[most] = inserted(after)
    for t in range(most - 1, -1, -1):
        after = costs[t + 1]
        best = np.minimum(DELETE + after, np.minimum(keep(codes[t], after), rerole(codes[t], after)))
        costs[t] = np.where(t < lengths, inserted(best), after)
    return costs


def inserted(cost: np.ndarray) -> np.ndarray:
    """Costs by state if turns can be inserted first."""
    out = cost.copy()
    out[AFTER_U] = np.minimum(cost[AFTER_U], cost[AFTER_A] + INSERT)
    out[AFTER_A] = np.minimum(cost[AFTER_A], cost[AFTER_U] + INSERT)
    for state in (START, AFTER_S):
        out[state] = np.minimum(cost[state], out[AFTER_U] + INSERT)
    return out


def stays(code: np.ndarray) -> np.ndarray:
    return np.where(code & MUST, FAR, np.where(code & CUT, TRUNCATED, 0))


def keep(code: np.ndarray, after: np.ndarray) -> np.ndarray:
    role, out = code & ROLE, np.full(after.shape, FAR)
    for state in range(4):
        out[state] = np.where(role == (2 if state == AFTER_U else 1), after[NEXT[state]], FAR)
    out[START] = np.where(role == 0, after[AFTER_S], out[START])
    return out + stays(code)


def rerole(code: np.ndarray, after: np.ndarray) -> np.ndarray:
    return after[NEXT] + REROLE + stays(code)


def traced(codes: np.ndarray, lengths: np.ndarray, costs: np.ndarray) -> list[bytes]:
    """The least letters of cheapest edits, of all conversations of a bucket at once."""
    n = len(lengths)
    every, at, state = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    letters: list[np.ndarray] = []
    live = every
    while True:
        a, s = at[live], state[live]
        now = costs[a, s, live]
        more = (a < lengths[live]) | (now > 0)
        live, a, s, now = live[more], a[more], s[more], now[more]
        if not len(live):
            break
        inside = a < lengths[live]
        code = np.where(inside, codes[np.minimum(a, len(codes) - 1), live] if len(codes) else 0, MUST)
        later = np.minimum(a + 1, len(codes))
        there = stays(code)
        matches = (code & ROLE) == np.where(s == AFTER_U, 2, 1)
        first = (code & ROLE == 0) & (s == START)
        kept = np.where(first, AFTER_S, NEXT[s])
        delete = inside & (DELETE + costs[later, s, live] == now)
        insert = ~delete & (INSERT + costs[a, NEXT[s], live] == now)
        stay = ~delete & ~insert & inside & (matches | first) & (costs[later, kept, live] + there == now)
        letter = np.full(n, 0, np.uint8)
        letter[live] = np.select([delete, insert, stay], [ord("D"), ord("I"), ord("K")], ord("R"))
        letters.append(letter)
        at[live] = np.where(insert, a, later)
        state[live] = np.select([delete, stay], [s, kept], NEXT[s])
    if not letters:
        return [b""] * n
    return [row.tobytes().rstrip(b"\0") for row in np.stack(letters, 1)]


def cheapest(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Cost and edits of each conversation, whose rows are ``codes[start:start + length]``; buckets hold lengths up to a power of two."""
    cost, edits = np.zeros(len(lengths), np.int64), [b""] * len(lengths)
    bucket = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for b in np.unique(bucket[lengths > 0]):
        some = np.flatnonzero((bucket == b) & (lengths > 0))
        turns = np.arange(lengths[some].max())[:, None]
        inside = turns < lengths[some]
        tensor = np.where(inside, codes[np.where(inside, starts[some] + turns, 0)], 0)
        costs = backward(tensor, lengths[some])
        cost[some] = costs[0, START]
        for i, letters in zip(some, traced(tensor, lengths[some], costs)):
            edits[i] = letters
    return cost, edits


def summaries(table: pa.Table) -> pa.RecordBatch:
    """The counts, cost and edits of whole conversations, each a head and its rows."""
    head = table.column("at").to_numpy() == 0
    code = table.column("code").fill_null(0).to_numpy()
    turn = table.column("turn")
    known, turns = turn.is_valid().to_numpy(), turn.fill_null(0).to_numpy()
    heads = np.flatnonzero(head)
    starts, lengths = heads + 1, np.diff(np.append(heads, len(head))) - 1
    role = code & ROLE
    second = ~head[1:] & ~head[:-1]
    legal = ((role[:-1] == 0) | (role[:-1] == 2)) & (role[1:] == 1) | (role[:-1] == 1) & (role[1:] == 2)
    other = np.append(True, ~(known[:-1] & second & (turns[:-1] == turns[1:])))
    sums = lambda x: np.add.reduceat(np.append(x, 0).astype(np.int64), heads)
    flag = lambda name: table.column(name).fill_null(False).to_numpy(zero_copy_only=False) & ~head
    least = np.minimum.reduceat(np.where(known, turns, np.iinfo(np.int64).max), heads)
    largest = np.maximum.reduceat(np.where(known, turns, np.iinfo(np.int64).min), heads)
    distinct = sums(known & ~head & other)
    with np.errstate(over="ignore"):
        gaps = np.where(distinct > 0, largest - least + 1 - distinct, 0)
    cost, edits = cheapest(code, starts, lengths)
    found = (gaps, sums(flag("blank")), sums(flag("duplicate")), sums((code & CUT > 0) & ~head), sums(np.append(False, second & ~legal)), cost)
    ids = table.column("conv_id").combine_chunks().take(pa.array(heads))
    return pa.RecordBatch.from_arrays([ids, *[pa.array(x, pa.int64()) for x in found], pa.array([x.decode() for x in edits])], ["conv_id", *COUNTS, "audit"])


def solved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``summaries`` of a partition's conversations, some at once."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < HELD:
            continue
        table = pa.Table.from_batches(held)
        last = int(np.flatnonzero(table.column("at").to_numpy() == 0)[-1])
        if last:
            yield summaries(table.slice(0, last))
        held = table.slice(last).combine_chunks().to_batches()
        rows = table.num_rows - last if last else 0  # a conversation that doesn't end is looked at again after as many rows
    table = pa.Table.from_batches(held) if held else None
    if table is not None and table.num_rows:
        yield summaries(table)


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit (the edits' initials) of each conversation.

    ``ids`` (conv_id) names conversations that are to be told of even if they have no rows.
    """
    arrow_rows(rows.sparkSession)
    found = faults(rows, ids)
    return found.mapInArrow(solved, f"conv_id {found.schema['conv_id'].dataType.simpleString()}, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string")


def edited(audit: str, texts: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """Edit, role and text of each repaired row."""
    rows = iter(texts)
    state = START
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K" and role[:1] == "s":
            state = AFTER_S
        else:
            state = int(NEXT[state])
            if letter != "K":
                role = "user" if state == AFTER_U else "assistant"
        yield letter, role, text


def conversations(batches: Iterable[pa.RecordBatch], others: list[str]) -> Iterator[tuple[tuple, Iterator[tuple[str, str]]]]:
    """Each conversation's id, audit and ``others``, and an iterator of its rows, which is read up before the next."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch.column(c).to_pylist() for c in ("at", "role", "text", "conv_id", "audit", *others)])

    stream = rows()
    pending: list[tuple] = [x for x in [next(stream, None)] if x]

    def own() -> Iterator[tuple[str, str]]:
        for row in stream:
            if row[0] == 0:
                pending.append(row)
                return
            yield row[1], row[2]

    while pending:
        texts = own()
        yield pending.pop()[3:], texts
        for _ in texts:
            pass


def beside(rows: DataFrame, found: DataFrame, others: list[str]) -> DataFrame:
    """Rows behind a head with their conversation's audit, in order within each partition."""
    return in_order(together(rows, found.select("conv_id", "audit", *others), ["audit", *others]))


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit, role and text of the repaired rows; ``found`` is what ``repair`` gave."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, out = ["conv_id", "place", "edit", "role", "text"], []
        for (conv, audit), texts in conversations(batches, []):
            for place, row in enumerate(edited(audit, texts)):
                out.append((conv, place, *row))
                if len(out) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)

    kind = rows.schema["conv_id"].dataType
    kinds = [arrow_type(kind), pa.int64(), pa.string(), pa.string(), pa.string()]
    return beside(rows, found, []).mapInArrow(run, f"conv_id {kind.simpleString()}, place bigint, edit string, role string, text string")


def arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with repaired_sha256: of ``role:text`` of the repaired rows, joined by newlines."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        names = ["conv_id", "audit", *COUNTS, "repaired_sha256"]
        for head, texts in conversations(batches, list(COUNTS)):
            sha, joint = hashlib.sha256(), b""
            for _, role, text in edited(head[1], texts):
                sha.update(joint + role.encode() + b":" + text.encode())
                joint = b"\n"
            out.append((*head, sha.hexdigest()))
            if len(out) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)

    kind = rows.schema["conv_id"].dataType
    kinds = [arrow_type(kind), pa.string(), *[pa.int64()] * len(COUNTS), pa.string()]
    made = beside(rows, found, list(COUNTS)).mapInArrow(run, f"conv_id {kind.simpleString()}, audit string, {', '.join(f'{c} bigint' for c in COUNTS)}, repaired_sha256 string")
    return made.select("conv_id", *COUNTS, "audit", "repaired_sha256")
