import collections
import datetime
import hashlib
import random
import re

import numpy as np
import pytest

from larkspur.llm import decontaminate, html_text, licenses, near_dup, neighbours, substrings, toxicity, url_filter
from larkspur.llm.components import components

DOCS = "doc_id long, text string, row int, id string, node string, block string"


def docs(spark, texts, more=()):
    rows = [(i, t, 1, "a", "b", "c") for i, t in [*enumerate(texts), *more]]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def some_words(r, n, vocabulary=400):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


# substring dedup


def removed(texts, k):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    count = collections.Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - k + 1):
            if count[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("k,vocabulary", [(4, 5), (7, 60), (35, 3)])
def test_repeats_equal_brute_force(spark, k, vocabulary):
    r = random.Random(k)
    passage = " ".join(some_words(r, 3 * k, 10_000))
    texts = ["", None, " \t\n ", "one", passage, passage.replace(" ", " \n\t"), "x\u00a0y \x1c z " * k, "a" * 300 + " " + "b " * (2 * k)]
    for _ in range(60):
        t = " ".join(some_words(r, r.randint(0, 6 * k), vocabulary))
        texts.append(t if r.random() < 0.7 else t + r.choice([" ", "\n"]) + passage[r.randint(0, 20) :])
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substrings.remove_repeats(docs(spark, texts), k).collect()}
    assert [got[i] for i in range(len(texts))] == removed(texts, k)


def test_repeats_over_blocks_and_stripping(spark, monkeypatch):
    r = random.Random(3)
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 3000)
    passage = " ".join(some_words(r, 60, 10_000))
    texts = [" ".join(some_words(r, 80, 10_000)) + (" " + passage if i % 3 == 0 else "") for i in range(60)] + [passage, ""]
    rows = docs(spark, texts, [(None, "no id"), (7, None), (0, texts[0]), (0, texts[0])])
    every = texts + ["no id", None, texts[0], texts[0]]
    want = collections.Counter(zip([*range(len(texts)), None, 7, 0, 0], removed(every, 35)))
    got = substrings.remove_repeats(rows).collect()
    assert collections.Counter((x.doc_id, (x.n_words, x.n_removed, x.kept_sha256)) for x in got) == want
    kept = substrings.strip_repeats(rows)
    assert kept.columns == rows.columns
    kept = kept.collect()
    assert all(x.row == 1 and x.block == "c" for x in kept)
    # emptied documents go, untouched ones stay as they are
    assert sorted(x.doc_id for x in kept if x.doc_id is not None) == sorted(i for i, (n, m, _) in zip([*range(len(texts)), 7, 0, 0], removed(every[:-4] + every[-3:], 35)) if m < n or not n)
    assert substrings.remove_repeats(rows.limit(0)).count() == 0


def test_stripping_keeps_other_columns(spark):
    when = datetime.datetime(2020, 1, 2, 3, 4, 5, 123456)
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(1, f"a {passage}", when, {1: "x"}, "r", 0), (2, f"{passage} b", when, None, None, 0), (3, "c", None, {2: None}, "r", 5), (None, None, when, {}, "r", None), (None, None, when, {}, "r", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, block timestamp_ntz, rest map<int,string>, kept string, n_chars int").repartition(2)
    got = substrings.strip_repeats(table)
    assert got.schema == table.schema
    want = [(1, "a", *rows[0][2:5], 1), (2, "b", *rows[1][2:5], 1), *rows[2:]]
    assert sorted(map(str, (tuple(x) for x in got.collect()))) == sorted(map(str, want))


def test_colliding_word_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(substrings.Words, "hashes", lambda self: np.zeros(len(self), np.uint64))
    counts, marks = substrings.repeated_windows([b"a b c", b"a b d", b"x a b c"], np.zeros(3, bool), 3)
    assert counts.tolist() == [1, 1, 2] and marks.tolist() == [True, False, False, True]
    monkeypatch.undo()
    monkeypatch.setattr(substrings, "window_hashes", lambda h, k: np.zeros(max(len(h) - k + 1, 0), np.uint64))
    counts, marks = substrings.repeated_windows([b"a b c", b"a b d", b"x a b c"], np.zeros(3, bool), 3)
    assert marks.tolist() == [True, False, False, True]


# licences


def test_licenses_equal_brute_force(spark):
    r = random.Random(1)
    lines = [t for v in licenses.TEMPLATES.values() for t in v]
    texts = ["", None, "one", "\n\n", "All rights reserved", "all RIGHTS -- reserved!!", "Licensed under the Apache License", "x " * 5000 + "\nReleased under the MIT License."]
    for _ in range(150):
        parts = []
        for _ in range(r.randint(1, 5)):
            w = r.choice(lines).split()
            if r.random() < 0.6:
                w[r.randrange(len(w))] = "zz"
            if r.random() < 0.3:
                w.insert(r.randrange(len(w)), "été")
            parts.append(" ".join(w))
        texts.append("\n".join(parts))

    def best(text):
        found = []
        for u in {" ".join(re.sub(r"[\W_]+", " ", u.lower()).split()) for u in [*(text or "").split("\n"), text or ""]}:
            w = u.split()
            a = {f"{x} {y}" for x, y in zip(w, w[1:])}
            for name, ts in licenses.TEMPLATES.items():
                for t in ts:
                    b = set(licenses.bigrams_of(t))
                    if a and 2 * len(a & b) / (len(a) + len(b)) >= 0.8:
                        found.append((-2 * len(a & b) / (len(a) + len(b)), name))
        return (min(found)[1], round(-min(found)[0], 6), len(found)) if found else (None, None, 0)

    got = {x.doc_id: (x.license, x.score, x.n_matches) for x in licenses.scan(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [best(t) for t in texts]
    assert licenses.scan(docs(spark, texts, [(None, "x"), (1, "x"), (1, "x")])).count() == len(texts) + 3
    assert licenses.scan(docs(spark, []), {}).count() == 0


# urls


def test_urls_equal_brute_force(spark):
    r = random.Random(2)
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.b.c", "", "block")]
    urls = [None, "", "no scheme", "http://", "http://ORG", "http://org/", "http://.org/x", "https://EXAMPLE.org/es/a?b#c", "x://Éxample.ORG/es/", "http://org?x/", "http://com#/fr/", "http://notexample.org/es/", "a://b://org/", "http://a.b.c", "http://x.a.b.c?q"]
    for _ in range(300):
        host = ".".join(r.choice(["a", "b", "c", "www", "example", "EXAMPLE"]) for _ in range(r.randint(0, 3)))
        urls.append(f"http://{host}{r.choice(['.org', '.com', '.a.b.c', ''])}{r.choice(['', '/', '/es/', '/en/12', '/fr/x', '/de/', '/es'])}{r.choice(['', '?a=/fr/', '#b', 'zz'])}")

    def judge(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
        host, path = re.match(r"([^/]*)(.*)", rest, re.S).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[1:] if fit else (None, "allow")))

    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in [*enumerate(urls), (None, "http://org/"), (0, "http://com/de/")]], "page_id long, url string, host string, rule string")
    got = url_filter.filter_urls(pages, rules).collect()
    want = [(i, *judge(u)) for i, u in [*enumerate(urls), (None, "http://org/"), (0, "http://com/de/")]]
    key = lambda x: tuple(str(y) for y in x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0 and url_filter.filter_urls(pages, []).count() == len(want)


def test_cascade_is_exact_for_every_key(spark):
    inside = spark.range(3000).selectExpr("concat('k', id) as key")
    universe = spark.range(20_000).selectExpr("concat('k', id) as key")
    levels = url_filter.cascade(inside, universe, bits_per_key=3)
    assert len(levels) > 2
    got = universe.where(url_filter.listed(levels, universe.key))
    assert got.count() == 3000 and got.join(inside, "key", "left_anti").count() == 0


# toxicity


def test_chain_finds_toxic_documents_that_it_has_not_seen(spark):
    r = random.Random(5)
    bad = ["scum", "moron", "idiot", "trash"]

    def text(toxic, junk):
        w = some_words(r, r.randint(5, 60), 2000)
        if junk:
            w = [x + "%%%" for x in w] + ["&&&"] * 5 + ["buy", "now"]
        if toxic:
            for _ in range(r.randint(1, 3)):
                w.insert(r.randrange(len(w)), r.choice(bad))
        return " ".join(w)

    rows = [(i, toxic, junk, text(toxic, junk)) for i in range(1500) for toxic, junk in [(r.random() < 0.15, r.random() < 0.2)]]
    labels = spark.createDataFrame([(i, int(not j), int(t)) for i, t, j, _ in rows if i < 800] + [(5000, 1, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    table = docs(spark, [t for *_, t in rows], [(None, "scum idiot"), (2000, None), (2001, ""), (0, "again")])
    got = toxicity.score(table, labels, sample=700).collect()
    assert len(got) == len(rows) + 4 and all(0 <= x.p_low_quality <= 1 for x in got)
    seen = {x.doc_id: x.rejected for x in got if x.doc_id is not None and 800 <= x.doc_id < 1500}
    truth = {i: t for i, t, *_ in rows if i >= 800}
    assert sum(seen[i] == truth[i] for i in truth) / len(truth) > 0.98
    kept = toxicity.clean(table, labels, sample=700)
    assert kept.columns == table.columns and kept.count() == sum(not x.rejected for x in got)
    assert toxicity.score(table.limit(0), labels).count() == 0
    assert not any(x.rejected for x in toxicity.score(table, labels.limit(0)).collect())


# decontamination


def test_tiles_are_greedy_and_apart():
    r = random.Random(6)
    for _ in range(200):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 25))] for _ in range(2))
        size = 3
        seeds = [(i, j) for i in range(len(a) - size + 1) for j in range(len(b) - size + 1) if a[i : i + size] == b[j : j + size]]
        got = decontaminate.tiles(seeds, size)
        # brute force: the longest match of unmarked words, again and again
        ma, mb, want = set(), set(), []
        while True:
            best = (0, 0, 0)
            for i in range(len(a)):
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in ma and j + n not in mb:
                        n += 1
                    best = max(best, (n, -i, -j))
            n, i, j = best[0], -best[1], -best[2]
            if n < size:
                break
            want.append((i, j, n))
            ma.update(range(i, i + n))
            mb.update(range(j, j + n))
        assert got == want


def test_tiles_without_pairs_are_the_same(monkeypatch):
    r = random.Random(16)
    for n in range(300):
        letters = "ab" if n % 2 else "abcd"
        a, b = ([r.choice(letters) for _ in range(r.randint(1, 40))] for _ in range(2))
        size = r.choice([1, 2, 3, 5])
        seeds = [(i, j) for i in range(len(a) - size + 1) for j in range(len(b) - size + 1) if a[i : i + size] == b[j : j + size]]
        got = decontaminate.longest_first(np.array([ord(x) for x in a]), np.array([ord(x) for x in b]), size)
        assert got == decontaminate.tiles(seeds, size)
    texts = [" ".join(r.choice(["la", "lala", "so"]) for _ in range(300)) for _ in range(12)] + ["x " * 400, "so so la"]
    items = [(i, " ".join(r.choice(["la", "lala"]) for _ in range(r.randint(3, 60))).encode()) for i in range(10)] + [(10, b"x " * 30), (11, b"so")]
    every = []
    for most in (0, 10**9):
        monkeypatch.setattr(decontaminate, "MOST_PAIRS", most)
        words = decontaminate.Words(decontaminate.Block([t.encode() for t in texts]), decontaminate.PUNCT)
        every.append(decontaminate.Benchmark(items, 5).coverage(words, words.hashes()))
    assert every[0] == every[1] and every[0][12][10] == 1.0


def test_one_word_thousands_of_times():
    words = decontaminate.Words(decontaminate.Block([b"buy " * 20_000, b"buy now " * 10_000]), decontaminate.PUNCT)
    found = decontaminate.Benchmark([(1, b"buy " * 5000), (2, b"now " * 9 + b"buy " * 9)], 5).coverage(words, words.hashes())
    assert found == {0: {0: 1.0, 1: 0.5}}


def test_contaminated_documents_are_found(spark):
    r = random.Random(7)
    items = [" ".join(some_words(r, r.randint(12, 40), 5000)) for _ in range(20)] + ["two words", "", None]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    w = items[3].split()
    half = len(w) // 2
    noise = lambda n: " ".join(some_words(r, n, 5000))
    texts = [
        f"{noise(30)} {items[0]} {noise(30)}", items[1].upper().replace(" ", ", "), " ".join(w[half:]) + " . " + noise(10) + " " + " ".join(w[:half]),
        " ".join(items[4].split()[: len(items[4].split()) // 2]), noise(200), "", None, f"here are Two, words {items[5]} {items[6]}", " ".join(reversed(items[2].split())),
    ]
    want = [[0], [1], [3], [], [], [], [], [5, 6, 20], []]
    for size in (30, 10**6):
        got = {x.doc_id: x for x in decontaminate.decontaminate(docs(spark, texts, [(None, items[0])]), bench, block_words=size).collect()}
        assert [got[i]["items"] for i in range(len(texts))] == want and got[None].contaminated
        assert 0.3 < got[3].coverage < 0.8 and got[2].coverage == 1
    table = docs(spark, texts)
    kept = decontaminate.clean(table, bench)
    assert kept.columns == table.columns and {x.doc_id: x.text for x in kept.collect()} == {i: t for i, t in enumerate(texts) if not want[i]}
    assert decontaminate.decontaminate(table, bench.limit(0)).where("contaminated").count() == 0 and decontaminate.decontaminate(table.limit(0), bench).count() == 0


# near-duplicates


def test_components_of_chains_and_stars(spark):
    links = [(f"a{i:04}", f"a{i + 1:04}") for i in range(300)] + [("b0", f"b{i}") for i in range(1, 50)] + [("c", "c"), ("d", "e"), ("e", "d")]
    got = {x.node: x.label for x in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert set(got.values()) == {"a0000", "b0", "d"} and len(got) == 301 + 50 + 2


def test_classes_equal_brute_force(spark):
    r = random.Random(21)
    texts = []
    for _ in range(25):
        base = some_words(r, r.randint(30, 120), 3000)
        for _ in range(r.choice([1, 2, 4])):
            w = list(base)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += [texts[0].upper(), " ".join(some_words(r, 20_000, 50_000)), "one two", "One  two", "", None]
    table = docs(spark, texts)
    idf = near_dup.inverse_frequencies(table)
    _, _, h, doc, count = near_dup.shingled([(t or "").lower().encode() for t in texts])
    weight = idf.of(h, count)
    assert 1 <= weight[count == 1].min() and weight[count == 1].max() <= 2
    sets = [dict(zip(h[doc == d].tolist(), weight[doc == d].tolist())) for d in range(len(texts))]

    def alike(a, b):
        both = sum(min(w, b[x]) for x, w in a.items() if x in b)
        return bool(a) and both >= 0.8 * (sum(a.values()) + sum(b.values()) - both) - 1e-6

    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    got = {x.doc_id: x for x in near_dup.near_duplicates(table).collect()}
    assert [got[i].class_id for i in range(len(texts))] == label
    assert [got[i].n_members for i in range(len(texts))] == [label.count(x) for x in label]


def test_weights_depend_on_shares_and_not_on_the_number_of_documents():
    r = np.random.default_rng(3)
    weights = []
    for docs_, load in ((40_000, 15), (12_000_000, 4460)):
        table = r.poisson(load, 1 << near_dup.DF_BITS)
        table[:3] = [docs_, docs_ // 100, 1 + load]
        weights.append(near_dup.Idf(docs_, table).weights[:3])
    assert np.abs(weights[0] - weights[1]).max() < 0.03


def test_unique_texts_of_a_repeated_id_stay(spark):
    w, u = "a b c d e f g h i j k l", "z y x w v u t s r q p o"
    rows = [(1, w, "g", 1, "n", {1: "a"}), (5, w, "g", 2, "n", None), (5, u, "g", 3, "n", {2: None}), (None, w, "g", 4, "n", None), (7, None, "g", 5, "n", None), (8, " ", "g", 6, "n", None), (9, u, "g", 7, "n", None), (1, w, "g", 8, "n", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, _gone string, id int, node string, first map<int,string>")
    kept = near_dup.one_of_each(table)
    assert kept.schema == table.schema
    assert sorted(x.id for x in kept.collect()) == [1, 3, 4, 5, 6, 8]


def test_near_duplicates_have_one_class(spark):
    r = random.Random(8)
    texts, group = [], []
    for g in range(40):
        base = some_words(r, r.randint(40, 150), 5000)
        for c in range(r.choice([1, 1, 2, 6])):
            w = list(base)
            if c > 1:
                w[r.randrange(len(w))] = f"edit{g}x{c}"
            texts.append(" ".join(w).upper() if c % 2 else " , ".join(w))
            group.append(g)
    texts += ["", " . ", None, "short one", "Short, one"]
    group += [100, 101, 102, 103, 103]
    got = {x.doc_id: x for x in near_dup.near_duplicates(docs(spark, texts, [(None, texts[0])])).collect()}
    assert len(got) == len(texts) + 1 and got[None].class_id is None
    for i, g in enumerate(group):
        first = group.index(g)
        same = near_dup_similarity(texts[i] or "", texts[first] or "")
        if i == first or same >= 0.85:
            assert got[i].class_id == first, (i, first, same)
    assert all(group[x.class_id] == group[i] for i, x in got.items() if i is not None)
    table = docs(spark, texts, [(None, texts[0]), (0, texts[0])])
    kept = near_dup.one_of_each(table)
    assert kept.columns == table.columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(str(i) for i in [*(i for i in range(len(texts)) if got[i].class_id == i), None, 0])
    assert near_dup.near_duplicates(table.limit(0)).count() == 0


def near_dup_similarity(a, b):
    sets = []
    for t in (a, b):
        w = re.findall(r"[a-z0-9]+", t.lower())
        sets.append(collections.Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))))
    return sum((sets[0] & sets[1]).values()) / sum((sets[0] | sets[1]).values())


def test_samples_agree_as_often_as_sets_are_alike():
    r = np.random.default_rng(1)
    n = 400
    shared = r.integers(0, 2**63, 300).astype(np.uint64)
    agree = []
    for s in range(n // 10):
        h = near_dup.mix(shared + np.uint64(s))
        a, b = np.sort(h[:270]), np.sort(h[30:])
        weight = np.ones(270, np.float32) * 3
        tables = near_dup._tables()
        x, y = (near_dup.bands_of(v, np.zeros(270, np.int64), weight, 1, tables)[0] for v in (a, b))
        agree += (x == y).tolist()
    assert abs(np.mean(agree) - (240 / 300) ** near_dup.ROWS) < 0.1


# nearest neighbours


@pytest.mark.parametrize("sent", [2_000_000, 0])
def test_neighbours_are_exact_in_form_and_near_in_rank(spark, monkeypatch, sent):
    monkeypatch.setattr(neighbours, "MOST_SENT", sent)
    monkeypatch.setattr(neighbours, "AT_ONCE", 100)
    r = np.random.default_rng(2)
    centres = r.normal(size=(20, 32))
    rows = [(i, [float(x) for x in np.float32(centres[i % 20] + 0.4 * r.normal(size=32))], "x", 1) for i in range(1500)]
    same = [(i, rows[0][1], "x", 1) for i in range(2000, 2060)]
    odd = [(3000, None, "x", 1), (3050, [0.0] * 32, "x", 1), (3100, [float("nan")] + [1.0] * 31, "x", 1), (3150, [None] + [1.0] * 31, "x", 1), (None, [1.0] * 32, "x", 1), (3200, [1.0, 2.0], "x", 1), (3201, [2.0, 1.0], "x", 1), (3250, [], "x", 1)]
    every = rows + same + odd
    table = spark.createDataFrame(every, "vec_id long, embedding array<float>, key string, cls int")
    got = collections.defaultdict(list)
    for x in sorted(neighbours.nearest(table).collect(), key=lambda x: (x.query_id, x["rank"])):
        got[x.query_id].append((x.vec_id, x.score))
    valid = rows + same
    ids = np.array([v[0] for v in valid])
    m = np.array([v[1] for v in valid], np.float32).astype(np.float64)
    norm = np.sqrt((m * m).sum(1))
    hits = total = 0
    for i in ids[ids % 50 == 0]:
        score = m @ m[ids == i][0] / (norm * norm[ids == i][0])
        want = sorted((-s, j) for s, j in zip(score.tolist(), ids.tolist()) if j != i)[:5]
        assert len(got[i]) == 5 and got[i] == sorted(got[i], key=lambda x: (-x[1], x[0]))
        for j, s in got[i]:
            assert abs(s - score[ids == j][0]) < 1e-12
        hits += len({j for j, _ in got[i]} & {j for _, j in want})
        total += 5
        if i in (0, 2000, 2050):
            assert [j for j, _ in got[i]] == [j for j in [0, 2000, 2001, 2002, 2003, 2004] if j != i][:5]
    assert hits / total >= 0.9
    assert got[3200] == [(3201, pytest.approx(0.8))] and set(got) == {*ids[ids % 50 == 0].tolist(), 3200}
    assert neighbours.nearest(table.limit(0)).count() == 0


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(neighbours.rotated(x, 1, 1, 1), axis=1), np.linalg.norm(x, axis=1))


# pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar"><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<!-- c --><div class="ad">Buy</div><div class="cookie-notice">Cookies</div>%s<aside>Side</aside><div id="comments"><p>Nice</p></div><form><input>Mail</form><footer>&copy; Foot</footer></body></html>"""


@pytest.mark.parametrize(
    "article,text",
    [
        ("<article><h1>A &amp; B</h1><p>One<b>two</b>\n\t three &lt;x&gt; &am</p><p>unclosed <i>tag<p>next<br>line</article>", "A & B Onetwo three <x> &am unclosed tag next line"),
        ("<article><h1>H</h1><p><b>bold <br><p>para</p></article>", "H bold para"),
        ("<main><h2>M</h2><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></main>", "M a b 1 2"),
        ("<div><p>plain</p>tail</div>", "plain tail"),
        ("<article><p>text</p><div class='share-box'>Share</div><aside>x</aside><form>y</form></article>", "text"),
        ("<article><p data-x=\"a>b\">q</p><P>Upper</P><svg><path d='x'/></svg></article>", "q Upper"),
        ("<article><pre>a\n  b</pre>&nbsp;&#233;&#x263A;</article>", "a b é☺"),
        ("<article></article>", ""),
    ],
)
def test_blocks_of_pages(article, text):
    assert " ".join(html_text.blocks_of(PAGE % article)) == text


def test_odd_pages_do_not_break():
    for page in ["", "<", "<p", "</", "<!--", "<!-- x", "<script>x", "a<b", "<a href=\"x", "&", "<p>x</p", "<div>" * 3000 + "deep", "</div>" * 100, "<article><p>cut &am", "\x00<p>\x00"]:
        html_text.blocks_of(page)
    assert html_text.blocks_of("<div>" * 3000 + "deep") == ["deep"]
    assert html_text.blocks_of("<article><p>cut") == ["cut"]


def test_site_templates_are_deleted_per_host(spark):
    pages = []
    for i in range(12):
        body = f"<div class='x'><p>Best site</p></div><div><p>text {i}</p></div><section>Once {i}</section>"
        pages.append((i, f"http://Site.example/{i}", f"<html><body>{body}</body></html>"))
    pages += [(100 + i, f"http://other.example/{i}", "<body><div class='x'><p>Best site</p></div><p>copy</p></body>") for i in range(12)]
    pages += [(200 + i, f"http://news.example/{i}", f"<article><p>quoted by all</p><p>own {i}</p><div>Follow us</div></article>") for i in range(12)]
    pages += [(300, None, None), (None, "x", ""), (301, "odd", "<p>solo</p>"), (301, "odd", "<p>solo</p>")]
    table = spark.createDataFrame([(*p, "h", 1) for p in pages], "page_id long, url string, html string, host string, row int")
    got = collections.defaultdict(list)
    for x in html_text.main_text(table).collect():
        got[x.page_id].append(x.text)
        assert x.n_chars == len(x.text)
    assert all(got[i] == [f"text {i} Once {i}"] for i in range(12))
    assert all(got[100 + i] == ["Best site copy"] for i in range(12))  # copies of one page
    assert all(got[200 + i] == [f"quoted by all own {i}"] for i in range(12))
    assert got[300] == [""] and got[None] == [""] and got[301] == ["solo", "solo"]
    assert html_text.main_text(table.limit(0)).count() == 0


def test_menus_and_footers_are_counted(spark):
    # the list is in the menu of most pages, and outside any listed element on the others
    menu = "<ul class='m'><li>Home</li><li>News</li></ul>"
    pages = [(i, f"http://a.example/{i}", f"<nav>{menu}</nav><article><p>own {i}</p></article><footer>Foot</footer>") for i in range(8)]
    pages += [(100, "http://a.example/x", f"<article>{menu}<p>odd one</p></article>"), (101, "http://b.example/x", f"<article>{menu}<p>odd one</p></article>")]
    got = {x.page_id: x.text for x in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"own {i}" for i in range(8))
    assert got[100] == "odd one" and got[101] == "Home News odd one"


@pytest.mark.parametrize("sent", [2_000_000, 0])
def test_templates_equal_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(html_text, "MOST_SENT", sent)
    r = random.Random(8)
    parts = [f"<nav><ul><li>{w}</li></ul></nav>" for w in "abc"] + [f"<div class='{w}'>box {w}</div>" for w in "xyz"] + ["<section><p>related</p></section>", "<p>quoted</p>", "<aside>side</aside>"]
    pages = []
    for i in range(300):
        host = r.choice(["h.example"] * 4 + ["I.Example", "i.example", "few.example"])
        body = "".join(r.sample(parts, 3)) + r.choice(["<article>%s</article>", "%s"]) % (f"<p>own {r.randrange(200)}</p>" + r.choice(parts))
        pages.append((i, f"http://{host}/{i}", body))
    pages += [(i + 1000, u, h) for i, u, h in pages[:20]] + [(2000, "http://long.example/", "<article>" + "<p>long text</p>" * 20_000 + "</article>")]

    found = [(u.split("/")[2].lower(), *html_text.parsed_page(h)) for _, u, h in pages]
    by_host = collections.defaultdict(dict)
    for host, kept, subtrees in found:
        content = tuple(html_text.main_blocks(kept))
        by_host[host][content] = min(subtrees, by_host[host].get(content, subtrees))
    want = {}
    for (i, _, _), (host, kept, _) in zip(pages, found):
        every = list(by_host[host].values())
        site = {x for some in every for x in some if (n := sum(x in y for y in every)) >= 3 and n >= 0.05 * len(every)}
        left = [(t, n) for t, n in kept if not html_text.in_templates(n, site)]
        want[i] = (" ".join(html_text.main_blocks(left)), len(kept) - len(left))
    got = {x.page_id: (x.text, x.n_template_blocks) for x in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string"), min_share=0.05).collect()}
    assert {i: got[i][0] for i in want} == {i: t for i, (t, _) in want.items()}
    assert sum(n for _, n in got.values()) > 300 and got[2000][0] == " ".join(["long text"] * 20_000)


def test_recurrence_is_judged_by_the_share_of_the_host(spark):
    page = "<article><p>own %s</p><div>%s</div></article>"
    pages = [(i, f"http://large.example/{i}", page % (i, "quoted" if i < 6 else "all" if i < 20 else f"d{i}")) for i in range(100)]
    pages += [(1000 + i, f"http://small.example/{i}", page % (i, "all")) for i in range(3)]
    pages += [(2000 + i, f"http://two.example/{i}", page % (i, "all")) for i in range(2)]
    got = {x.page_id: x.text for x in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string"), min_share=0.1).collect()}
    assert all(got[i] == f"own {i} quoted" for i in range(6)) and all(got[i] == f"own {i}" for i in range(6, 20))
    assert got[50] == "own 50 d50"
    assert all(got[1000 + i] == f"own {i}" for i in range(3)) and got[2000] == "own 0 all"


@pytest.mark.parametrize(
    "page,text",
    [
        ("<div id='content' class='with-sidebar'><article><p>a</p></article></div>", "a"),
        ("<div id='content' class='with-sidebar'><p>a long paragraph</p><p>another</p></div><div class='ad'>Buy</div>", "a long paragraph another"),
        ("<article class='post comments-open'><p>a</p></article>", "a"),
        ("<article><h2 id='related-work'>Related work</h2><p class='notice'>b</p></article>", "Related work b"),
        ("<article><section id='search-methods'><h2>Search</h2><p>b</p></section><div class='share'>Share</div></article>", "Search b"),
        ("<article hidden><p>a</p></article><p>b</p>", "b"),
    ],
)
def test_words_of_classes_do_not_drop_prose(page, text):
    assert " ".join(html_text.blocks_of(page)) == text


LONG = "<p>A long paragraph of the post, with many words.</p>"


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<article>{LONG}<section class='comments'><p>Great post!</p></section></article>", "A long paragraph of the post, with many words."),
        (f"<article>{LONG}<div class='advert'><p>Buy now!</p></div><div class='cookie-notice'><p>We use them</p></div><div id='related'><h3>More</h3></div></article>", "A long paragraph of the post, with many words."),
        (f"<article>{LONG}<div id='comments'>" + "".join(f"<article class='comment'><p>Remark {i}</p></article>" for i in range(20)) + "</div></article>", "A long paragraph of the post, with many words."),
        (f"<article>{LONG}</article><div id='comments'>" + "".join(f"<article class='comment'><p>Remark {i}</p></article>" for i in range(20)) + "</div>", "A long paragraph of the post, with many words."),
        (f"<div class='post'>{LONG}</div><article><h3>Teaser</h3></article><article><p>Other Teaser.</p></article>", "A long paragraph of the post, with many words."),
        ("<main><p>A main text.</p></main><article><p>A card of more words than that.</p></article>", "A main text."),
        (f"<main><article>{LONG}</article><article><p>Card</p></article></main>", "A long paragraph of the post, with many words."),
        ("<article><p>First of two</p></article><article><p>Second of two</p></article>", "First of two Second of two"),
        (f"<main>Search</main><article>{LONG}</article>", "A long paragraph of the post, with many words."),
        (f"<article class='post has-sidebar'>{LONG}</article>", "A long paragraph of the post, with many words."),
        (f"<div class='page sidebar-left'><article>{LONG}</article></div>" + "<div>Unmarked words of the site. </div>" * 9, "A long paragraph of the post, with many words."),
    ],
)
def test_articles_and_what_is_beside_them(page, text):
    assert " ".join(html_text.blocks_of(page)) == text
    assert " ".join(html_text.blocks_of(f"<body><header><p>Site</p></header>{page}<footer>F</footer></body>")) == text


def test_ties_of_many_classes_go_to_the_smallest_ids(spark):
    # a hundred different vectors of each of two directions: scores are 1 or 0
    ids = list(range(1, 201))
    random.Random(4).shuffle(ids)
    rows = [(i, [float(2**j), 0.0] if j < 100 else [0.0, float(2 ** (j - 100))]) for j, i in enumerate(ids)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    by_axis = [sorted(i for i, v in rows if v[axis]) for axis in (0, 1)]
    got = collections.defaultdict(list)
    for x in sorted(neighbours.nearest(table, every=7).collect(), key=lambda x: (x.query_id, x["rank"])):
        got[x.query_id].append((x.vec_id, x.score))
    assert set(got) == {i for i, _ in rows if i % 7 == 0}
    for q, found in got.items():
        same = next(a for a in by_axis if q in a)
        assert found == [(i, 1.0) for i in same if i != q][:5]


def test_capitals_of_other_scripts_and_long_texts(spark):
    items = ["ΟΔΥΣΣΕΥΣ ΕΙΣ ΤΗΝ ΠΟΛΙΝ ΤΗΣ ΙΘΑΚΗΣ ΗΛΘΕΝ", "İSTANBUL IŞIK İLE DOLU BİR ŞEHİR OLDU"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    table = docs(spark, [items[0], items[1], items[0].lower(), f"{long} {items[0]} {long}", long, items[0]], [(0, items[0])])
    for size in (7, 10**6):
        got = sorted((x.doc_id, x["items"], x.coverage) for x in decontaminate.decontaminate(table, bench, block_words=size).collect())
        assert [(i, k) for i, k, _ in got] == [(0, [0]), (0, [0]), (1, [1]), (2, got[3][1]), (3, [0]), (4, []), (5, [0])]
        assert all(c == 1.0 for i, _, c in got if i in (0, 1, 3, 5))


def test_items_without_id_contaminate(spark):
    items = ["one two three four five six seven", "a b c d e f g h", "never found in any of them"]
    bench = spark.createDataFrame([(None, items[0]), (None, items[1]), (3, items[1]), (None, items[2])], "item_id long, text string")
    table = docs(spark, [f"x {items[0]} y", f"{items[0]} z {items[1]}", "clean"])
    for size in (5, 10**6):
        got = {x.doc_id: x for x in decontaminate.decontaminate(table, bench, block_words=size).collect()}
        assert [got[i]["items"] for i in range(3)] == [[None], [3, None], []] and [got[i].contaminated for i in range(3)] == [True, True, False]
    assert [x.doc_id for x in decontaminate.clean(table, bench).collect()] == [2]


def test_licenses_in_longer_lines_and_texts(spark):
    words = "some prose of the document that says nothing of it"
    body = licenses.PASSAGES["MIT"][1]
    bsd = licenses.PASSAGES["BSD-3-Clause"][0]
    cases = [
        (f"{words} Released under the MIT License. {words}", "MIT"),
        (f"{words}\nThis work is licensed under the GNU\nGeneral Public License, version 3. {words}", "GPL-3.0"),
        ("The MIT License (MIT)\n\nCopyright (c) 2020 A. Writer\n\n" + body.replace(", ", ",\n"), "MIT"),
        ("Copyright (c) 2020, A. Writer. All rights reserved.\n\n" + bsd.replace("copyright holder", "University"), "BSD-3-Clause"),
        (licenses.PASSAGES["BSD-2-Clause"][0] + f"\n{words}", "BSD-2-Clause"),
        ("# " + licenses.PASSAGES["GPL-2.0"][1].replace(" the ", "\n# the "), "GPL-2.0"),
        (licenses.PASSAGES["LGPL-3.0"][0], "LGPL-3.0"),
        (f"{words} {words}", None),
        (None, None),
        ("", None),
        ("one", None),
        ("license", None),
        ("All rights reserved.", "Proprietary"),
    ]
    got = {x.doc_id: x for x in licenses.scan(docs(spark, [t for t, _ in cases]), passages=licenses.PASSAGES).collect()}
    assert [got[i].license for i in range(len(cases))] == [x for _, x in cases]
    assert all((got[i].score is None) == (x is None) and (got[i].n_matches == 0) == (x is None) for i, (_, x) in enumerate(cases))


def test_windows_of_every_size_equal_brute_force(spark):
    r = random.Random(5)
    passages = {"A": [" ".join(f"a{i % 37}" for i in range(45))], "B": ["licence " + " ".join(f"b{i}" for i in range(30))], "C": ["c d e c d f"]}
    texts = ["", None, "c", "c d " * 40, "c d e " * 30 + "c d f", "x " * 50 + passages["A"][0] + " x" * 50]
    for _ in range(90):
        words = []
        for _ in range(r.randint(1, 3)):
            # words put in, left out and said twice: the best windows are of all sizes
            words += [r.choice("vwxyz") for _ in range(r.randint(0, 8))]
            for w in r.choice(list(passages.values()))[0].split():
                words += [w] * (r.random() > 0.04) + ["zz"] * (r.random() < 0.06) + [w] * (r.random() < 0.03)
        texts.append(r.choice([" ", "\n"]).join(words))

    def best(text):
        w = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
        pairs = [f"{a} {b}" for a, b in zip(w, w[1:])]
        found = []
        for name, (t,) in passages.items():
            b = set(licenses.bigrams_of(t))
            windows = (set(pairs[i:j]) for i in range(len(pairs)) for j in range(i + 1, len(pairs) + 1))
            score, shared = max(((2 * len(a & b) / (len(a) + len(b)), len(a & b)) for a in windows), default=(0, 0))
            found += [(shared, score, name)] if score >= 0.8 else []
        return (max(found)[2], round(max(found)[1], 6), len(found)) if found else (None, None, 0)

    got = {x.doc_id: (x.license, x.score, x.n_matches) for x in licenses.scan(docs(spark, texts), {}, passages=passages).collect()}
    want = [best(t) for t in texts]
    assert len({x for _, x, _ in want}) > 20
    assert [got[i] for i in range(len(texts))] == want


def joined_rows(spark):
    """The rows that merge joins on keys have made so far."""
    store = spark._jsparkSession.sharedState().statusStore()
    total, runs = 0, store.executionsList().iterator()
    while runs.hasNext():
        run = runs.next().executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes().iterator()
        while nodes.hasNext():
            node = nodes.next()
            metrics = node.metrics().iterator() if node.name().startswith("SortMergeJoin") and "[key" in node.desc() else None
            while metrics and metrics.hasNext():
                metric = metrics.next()
                value = values.get(metric.accumulatorId()) if metric.name() == "number of output rows" else None
                total += int(value.get().replace(",", "")) if value and value.isDefined() else 0
    return total


def test_near_copies_are_split_and_found(spark):
    r = np.random.default_rng(11)
    near = r.normal(size=64) + 0.1 * r.normal(size=(3000, 64))
    near[0] = near.mean(0)
    scaled = r.normal(size=64) * 2.0 ** r.permutation(300)[:, None]
    m = np.concatenate([near, scaled, r.normal(size=(700, 64))])
    table = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "vec_id long, embedding array<double>").repartition(5)
    before = joined_rows(spark)
    got = collections.defaultdict(list)
    for x in sorted(neighbours.nearest(table).collect(), key=lambda x: (x.query_id, x["rank"])):
        got[x.query_id].append((x.vec_id, x.score))
    # each of the 60 queries of the near copies met all 3,000 of them in most of the 64 tables before
    assert 0 < joined_rows(spark) - before < 2_000_000
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    score = unit @ unit[::50].T
    score[np.arange(0, 4000, 50), np.arange(80)] = -2
    hits = [len({j for j, _ in got[50 * q]} & set(np.argsort(-score[:, q])[:5].tolist())) for q in range(80)]
    assert sum(hits[:60]) / 300 >= 0.9 and sum(hits[66:]) / 70 >= 0.9 and hits[0] == 5
    for q in range(3000, 3300, 50):
        assert [j for j, _ in got[q]] == [j for j in range(3000, 3006) if j != q][:5]


def split_rows(spark):
    """The keys that rows and queries got in split buckets so far."""
    store = spark._jsparkSession.sharedState().statusStore()
    total, runs = 0, store.executionsList().iterator()
    while runs.hasNext():
        run = runs.next().executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes().iterator()
        while nodes.hasNext():
            node = nodes.next()
            metrics = node.metrics().iterator() if node.name().startswith("MapInArrow") and "radius" in node.desc() else None
            while metrics and metrics.hasNext():
                metric = metrics.next()
                value = values.get(metric.accumulatorId()) if metric.name() == "number of output rows" else None
                total += int(value.get().replace(",", "")) if value and value.isDefined() else 0
    return total


def test_queries_look_once_in_each_table_of_a_group(spark):
    r = np.random.default_rng(3)
    m = np.concatenate([r.normal(size=64) + 0.1 * r.normal(size=(1500, 64)), r.normal(size=(500, 64))])
    table = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "vec_id long, embedding array<double>").repartition(5)
    before = split_rows(spark)
    got = collections.defaultdict(set)
    for x in neighbours.nearest(table).collect():
        got[x.query_id].add(x.vec_id)
    # a key for each of 64 tables and 1,500 rows, and about 45 for each of them and of 30 queries of the group
    assert 96_000 <= split_rows(spark) - before < 64 * (1500 + 30 * 60)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    score = unit @ unit[::50].T
    score[np.arange(0, 2000, 50), np.arange(40)] = -2
    assert sum(len(got[50 * q] & set(np.argsort(-score[:, q])[:5].tolist())) for q in range(30)) / 150 >= 0.95


def test_few_links_take_no_star_and_many_have_the_same_labels(spark, monkeypatch):
    import larkspur.llm.components as module

    r = random.Random(6)
    links = [(f"{r.randrange(300):03}", f"{r.randrange(300):03}") for _ in range(200)] + [(f"n{i:02}", f"n{i + 1:02}") for i in range(40)] + [("z", "z")]
    label = {x: x for link in links[:-1] for x in link if link[0] != link[1]}
    for _ in links:
        for a, b in links[:-1]:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    table = spark.createDataFrame(links, "a string, b string")
    monkeypatch.setattr(module, "FEW", 0, raising=False)
    assert {x.node: x.label for x in components(table).collect()} == label
    monkeypatch.undo()
    monkeypatch.setattr(module, "_star", None)
    assert {x.node: x.label for x in components(table).collect()} == label
    assert components(table.where("a = b")).collect() == []


def test_frequencies_take_few_jobs(spark):
    for name, value in (("spark.sql.shuffle.partitions", "40"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(name, value)
    try:
        spark.sparkContext.setJobGroup("frequencies", "")
        idf = near_dup.inverse_frequencies(docs(spark, ["a b c d e f g"] * 300 + ["a b c d e"] * 5))
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("frequencies")) < 10  # one for each partition before
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    _, _, h, doc, count = near_dup.shingled([b"a b c d e f g", b"x y z v w"])
    floor = near_dup.FLOOR
    want = [1 + np.log((1 + floor) / (n / 305 + floor)) / np.log((1 + floor) / floor) for n in (305, 300, 300, 1)]
    assert np.allclose(sorted(idf.of(h, count)), sorted(want), atol=0.01)
