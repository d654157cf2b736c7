import collections
import random
import re

import pytest

from larkspur.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STOPS = set().union(*map(quality.in_case, quality.STOP_WORDS))
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = collections.Counter(windows)
    covered = {j for i, g in enumerate(windows) if count[g] > 1 for j in range(i, i + 3)}
    lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n, len(lines), sum(x in STOPS for x in w)


def verdict(m):
    n, chars, symbols, dup, _, base, lines, stops = m
    return not base and n <= 100_000 and 3 * n <= chars <= 10 * n and 10 * symbols <= n and stops >= 2 and 10 * dup <= 3 * lines


def texts():
    r = random.Random(5)
    out = ["", None, " \t\n\x0b\x0c\r ", "one", "a b c", "a a a", "a a a a", "a b c a b c", "x\x0cy\x0bz\rw\tv\nu", "f f f ff f f f", "a b \x1c \x85 c d", "\n\nA\nA\nA \nB\n", "# # #\n# # #", "\U0001f600 é\U0001f600 |"]
    for size, vocabulary in ((60, 5), (60, 30), (60, 400), (300, 12), (3000, 8), (3000, 40), (60_000, 100)):
        for _ in range(1 if size > 10_000 else 12):
            w = [r.choice(["the", "of", "Der", "été", f"wo{r.randrange(vocabulary)}rd", f"x{r.randrange(vocabulary)}"]) for _ in range(size)]
            out.append("".join(x + r.choice([" ", " ", " ", "\n", "\t", "\x0c", " | " if r.random() < 0.2 else " "]) for x in w))
    out.append("the of wordy\n" * 40)
    out.append("\n".join(f"line {i} of the {i * i}" for i in range(200)))
    return out


@pytest.mark.parametrize("halves", [False, True])
def test_measures_equal_brute_force(spark, monkeypatch, halves):
    if halves:  # hashes of two values only: all windows are candidates, and are told apart by their words
        monkeypatch.setitem(quality.MEASURES, "n_repeat_words", quality.MEASURES["n_repeat_words"].replace("xxhash64(", "(1 & xxhash64("). replace("]), 32)", "])), 32)"))
    every = texts()
    rows = [*enumerate(every), (None, "no id"), (3, "one"), (3, "one")]
    df = spark.createDataFrame([(i, t, 1, "a") for i, t in rows], "doc_id long, text string, kept int, q string").repartition(3)
    got = collections.Counter((x.doc_id, tuple(x[c] for c in (*COLUMNS, "n_lines", "n_stop_words")), x.kept) for x in quality.measured(df).collect())
    assert got == collections.Counter((i, brute(t), verdict(brute(t))) for i, t in rows)


def test_keeping(spark):
    prose = " ".join(f"the word{i} of some{i}" for i in range(30))
    df = spark.createDataFrame([(1, prose, 2, "x"), (1, prose, 2, "x"), (2, None, 3, None), (None, prose, None, "y"), (3, prose.replace("so", "|"), 1, "z")], "doc_id long, text string, quality int, `a.b` string")
    kept = quality.keep(df)
    assert kept.schema == df.schema
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.where("doc_id = 1 or doc_id is null").collect()))
    assert quality.keep(df, rules=()).count() == 4
    assert quality.measured(df.limit(0)).count() == 0
    only = quality.measured(df, (quality.Rule("short", "n_words", None, None, 10), quality.Rule("plain", "n_symbols", "n_words", None, 0.25))).collect()
    assert sorted((x.failed, x.kept) for x in only) == sorted([(["short"], False)] * 3 + [([], False)] + [(["short"], False)])


def test_one_projection(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = quality.measured(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Join|Aggregate", plan)
