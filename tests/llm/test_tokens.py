import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from larkspur.llm.packing import document_ids, pack, plan
from larkspur.llm.pretokens import IdCache, Pieces, char_classes, supported, tokenizer
from larkspur.llm.token_counts import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "a", "it's he'll they've I'm 'sabc ''s 'S 's's don't", "  two  spaces ", "tab\t x\n\n y  z 　　w",
    "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>z", "日本語 ½ ٣ x²", "éàü 😀 á \x1c \x85 ​", "a" * 5000, "\x00\x01", "!'s \n's 're'll", None,
]


def random_texts(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    bits = ["a", "the", " ", "  ", "\n", "\t", "'", "s", "re", "ll", "1", "²", "!", "?", "é", " ", "　", "日", "<|endoftext|>", "<|", "́", "😀", "d"]
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(n)]


def ids_of(texts):
    return [e.ids for e in tokenizer(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_every_code_point_is_classed_as_by_the_library():
    pre = tokenizer(PATH).pre_tokenizer
    classes = char_classes(PATH)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 50_000):
        text = "".join(f"\n!{chr(c)}!\na{chr(c)}\n1{chr(c)}" for c in points[i : i + 50_000])
        found = Pieces([text.encode()], [], classes)
        want = np.zeros(len(text), bool)
        want[[b for _, (b, _) in pre.pre_tokenize_str(text)]] = True
        char_at = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1
        got = np.zeros(len(text), bool)
        got[char_at[found.start]] = True
        assert (got == want).all(), (i, np.flatnonzero(got != want)[:5] // 10)


@pytest.mark.parametrize("seed", range(3))
def test_ids_equal_the_librarys(seed):
    texts = [t or "" for t in TEXTS] + random_texts(400, seed)
    got = document_ids([t.encode() for t in texts], IdCache(PATH, limit=50), supported(PATH), char_classes(PATH))
    assert [x.tolist() for x in got] == ids_of(texts)


def test_plan_places_every_rank_once_without_overlap():
    for seed in range(30):
        r = random.Random(seed)
        histogram = {r.randint(1, 64): r.randint(1, 40) for _ in range(r.randint(1, 20))}
        steps = plan(histogram, 64)
        used, seen = collections.defaultdict(list), collections.Counter()
        for k, (length, rank, first, fits, offset) in enumerate(steps.tolist()):
            nxt = steps[k + 1] if k + 1 < len(steps) and steps[k + 1][0] == length else None
            n = (int(nxt[1]) if nxt is not None else histogram[length]) - rank
            for i in range(n):
                used[first + i // fits].append((offset + i % fits * length, length))
                seen[length] += 1
        assert seen == collections.Counter(histogram)
        for items in used.values():
            at = 0
            for offset, length in sorted(items):
                assert offset == at
                at += length
            assert at <= 64
        rooms = []  # best-fit decreasing, piece by piece
        for length in sorted((a for a, b in histogram.items() for _ in range(b)), reverse=True):
            k = min((k for k, room in enumerate(rooms) if room >= length), key=lambda k: rooms[k], default=None)
            if k is None:
                rooms.append(64 - length)
            else:
                rooms[k] -= length
        assert len(used) == len(rooms)


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", "1 as row", "'x' as id", "2 as token", "3 as n") if extra else df


def test_counts_of_odd_texts(spark):
    texts = TEXTS + random_texts(50, 9)
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "again"), (0, "again"), (None, "no id")]
    want = sorted((-1 if i is None else i, len((t or "").encode()), len(x), len(x) > 3) for (i, t), x in zip(rows, ids_of([t for _, t in rows])))
    for head in (0, 5, 1000):
        got = token_counts(frame(spark, rows), PATH, limit=3, head_rows=head).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts(frame(spark, []), PATH).count() == 0


def test_packing_is_whole_and_gapless(spark):
    texts = TEXTS + random_texts(80, 4)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id")]
    want = collections.Counter()
    for (i, t), ids in zip(rows, ids_of([t for _, t in rows])):
        ids = [*ids, 2]
        at = 0
        for p, size in enumerate([len(ids) % 64 or 64, *[64] * ((len(ids) - 1) // 64)]):
            want[(i, p, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes()))] += 1
            at += size
    got = pack(frame(spark, rows).repartition(5), PATH, capacity=64).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for items in seqs.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 64
    assert len(seqs) <= sum(r.length for r in got) / 64 * 1.1 + 2
    assert pack(frame(spark, []), PATH).count() == 0
