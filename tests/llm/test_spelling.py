import collections
import random
import re
import zlib

from larkspur.llm import spelling
from larkspur.llm.store import written


def words_of(rows, drop):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if drop and h % drop == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return n


def edits(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least_letters=6, least_n=5, ratio=5, drop=None):
    n = {w: c for w, c in words_of(rows, drop).items() if len(w) >= least_letters and c >= least_n}
    form, out = {}, {}
    for w in n:
        near = [v for v in n if edits(v, w)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
        out[w] = [len(near)]
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], out[w][0], n.get(form[w]))
    return out


def some(r, n):
    letters = "abcdeéÿ×÷zÀ"
    pool = ["".join(r.choice(letters) for _ in range(r.randint(4, 9))) for _ in range(25)]
    for w in list(pool):
        for _ in range(5):
            k = r.randrange(len(w))
            pool.append(r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1 :], w.upper() if w.isascii() else w]))
    weights = [r.choice([1, 3, 20, 150, 800]) for _ in pool]
    return [" ".join(x + r.choice(["", ".", "1", "ß", "Ω", "Ā"]) for x in r.choices(pool, weights, k=r.randint(0, 120))) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "a", "b") for i, t in rows], "doc_id long, text string, n int, word string, key string").repartition(3)


def check(spark, rows, **how):
    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in spelling.variants(table(spark, rows), drop_every=how.get("drop"), **{k: v for k, v in how.items() if k != "drop"}).collect()}
    assert got == brute(rows, **how)
    return got


def test_variants_equal_brute_force(spark):
    r = random.Random(11)
    rows = [*enumerate(some(r, 300)), (None, "aaaaaa " * 7), (300, None), (300, ""), (0, "zzzzzz zzzzzzz " * 5), (0, "zzzzzz zzzzzzz " * 5)]
    got = check(spark, rows, drop=7)
    assert any(x[0] for x in got.values()) and any(x[0] and x[0] != x[1] for x in got.values())
    check(spark, rows, least_letters=1, least_n=1, ratio=2)


def test_chains_and_ties(spark):
    texts = {"abcdef": 5, "abcdeg": 25, "abcdgg": 125, "abcggg": 625, "bbcggg": 625, "abcgg": 40, "xyxyxy": 5, "xyxyxyx": 25, "yxyxyxy": 25, "é" * 6: 30, "é" * 7: 6}
    rows = [(i, f"{w} " * n) for i, (w, n) in enumerate(texts.items())]
    got = check(spark, rows, least_letters=5)
    assert got["abcdef"][:2] == ("abcdeg", "abcggg") and got["xyxyxy"][0] == "xyxyxyx" and got["é" * 7][0] == "é" * 6
    assert got["abcggg"][3] == 3 and got["abcgg"][0] == "abcggg"


def test_every_edit_is_found(spark):
    """All words one edit from a word, and it: each is near to it."""
    for w in ("abcabcd", "àáâabc"):
        letters = "abczàÿ"
        near = {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in letters} | {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in letters}
        got = check(spark, [(1, " ".join([*near - {w}] * 2 + [w] * 20))], least_n=1, least_letters=5)
        assert got[w][3] == len(near - {w})
        assert all(x[1] == w for x in got.values())


def test_held_words_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    rows = [(1, "abcdefg " * 1000 + "x" * 50_000 + " " + ("x" * 49_999 + " ") * 6)] * 5
    check(spark, rows)
    assert spelling.variants(table(spark, rows).limit(0)).count() == 0


def test_nothing_is_broadcast(spark):
    """Files of a vocabulary are small beside its rows, and these beside its keys: none of them may go through the driver."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    docs = table(spark, [(1, "abcdef " * 25 + "abcdeg " * 5)])
    words = written(spelling.vocabulary(docs), "spelling-words")
    for df in (spelling.near_pairs(words), spelling.variants(docs)):
        assert "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)
    assert [tuple(x) for x in spelling.near_pairs(words).collect()] == [("abcdef", 25, "abcdeg", 5)]
