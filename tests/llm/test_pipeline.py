"""The pipeline over small tables, each stage against what it must do."""

import collections
import random
import re

import pytest

import corpus_pipeline
from larkspur.llm.queries import vocabulary
from tests.llm.test_text_ops import removed

PASSAGE = " ".join(f"passage{i}" for i in range(60))
ITEM = " ".join(f"item{i}" for i in range(20))


def texts():
    r = random.Random(21)
    prose = lambda n: " ".join(f"word{r.randrange(3000)}" for _ in range(n))
    clean = [prose(r.randint(60, 120)) for _ in range(100)]
    toxic = [" ".join(r.choice(["vile", "rotten", "trash", f"word{r.randrange(3000)}"]) for _ in range(80)) for _ in range(60)]
    return clean, toxic, prose


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    clean, toxic, prose = texts()
    rows = [(i, t) for i, t in enumerate(clean)] + [(100 + i, t) for i, t in enumerate(toxic)]
    near = clean[0].split()
    near[30] = "changed"
    long = prose(20_000)
    rows += [(200, clean[0]), (201, " ".join(near)), (202, f"{prose(80)} {PASSAGE} {prose(80)}"), (203, f"{prose(80)} {PASSAGE} {prose(80)}"), (204, f"{prose(50)} {ITEM} {prose(50)}"), (205, None), (206, ""), (None, prose(70)), (207, long), (207, long)]
    frame = spark.createDataFrame([(i, t, "en", "src", len(t or ""), 7, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row long, token string")
    frame.repartition(4).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(90)] + [(100 + i, 0, 1) for i in range(50)] + [(None, 1, None), (999, None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (None, "two words")], "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def test_stages_and_run(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.schema == docs.schema, name
        path = f"{folder}/after-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = [(x.doc_id, x.text) for x in docs.collect()]
        assert all((x.row, x.token) == (7, "x") for x in docs.select("row", "token").collect())
    # toxicity: all toxic documents but few go, of the clean ones few
    left = collections.Counter(i for i, _ in kept["toxicity"])
    assert sum(left[100 + i] for i in range(60)) <= 3 and sum(left[i] for i in range(100)) >= 97
    assert left[None] == 1 and left[205] == left[206] == 1 and left[207] == 2
    # near-duplicates: one of the copies and the near copy; rows of one id and text are one document
    left = collections.Counter(i for i, _ in kept["near_dedup"])
    assert left[0] + left[200] + left[201] == 1 and left[207] == 2 and left[202] == left[203] == 1
    gone = set(kept["toxicity"]) - set(kept["near_dedup"])
    assert {i for i, _ in gone} <= {0, 200, 201}
    # repeated passages: as by brute force over what was left
    before = kept["near_dedup"]
    want = {}
    for (i, text), (n, m, _) in zip(before, removed([t for _, t in before], 35)):
        want[i] = (n, m)
    after = dict(kept["substring_dedup"])
    for i, text in before:
        n, m = want[i]
        if m == 0:
            assert after[i] == text
        elif m < n:
            assert len(after[i].split()) == n - m and PASSAGE not in after[i]
        else:
            assert i not in after
    assert want[202][1] >= 60 and want[203][1] >= 60
    # decontamination: the document with the item goes
    assert {i for i, _ in kept["substring_dedup"]} - {i for i, _ in kept["decontamination"]} == {204}
    # packing: every token of what is left has one place, and places are gapless
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    pieces = corpus_pipeline.run(spark, folder).collect()
    tokens = collections.Counter()
    places = collections.defaultdict(list)
    for p in pieces:
        tokens[p.doc_id] += p.length
        places[p.sequence_id].append((p.offset, p.length))
    assert tokens == collections.Counter({i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in kept["decontamination"]})
    for some in places.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 1024


def test_empty_tables(spark, tables, tmp_path):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    some = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 5")
    assert {x.doc_id for x in corpus_pipeline.reject_toxic(spark, some, str(tmp_path)).collect()} == {0, 1, 2, 3, 4}
    assert corpus_pipeline.drop_contaminated(spark, some, str(tmp_path)).count() == 5


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None and re.fullmatch(r"\w+", corpus_pipeline.run.__name__)
