import random
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from test_operators import brute_near

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __sha string"


def write(spark, folder, rows, labels):
    docs = [(i, t, "en", f"src{k % 3}", len(t or ""), "x") for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_against_brute_force(spark, tmp_path):
    random.seed(9)
    words = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 8))) for _ in range(800)]
    plain = lambda n: " ".join(random.choice(words) for _ in range(n)).capitalize() + "."
    good = [(k, plain(random.randint(20, 80))) for k in range(60)]
    bad = [(100 + k, " ".join(random.choice(["LOUD!!", "$$$", "###", "|||", "WIN!!"]) for _ in range(30))) for k in range(30)]
    copies = [(200 + k, good[k][1].replace(" ", "  " if k % 2 else " ")) for k in range(10)] + [(3, good[3][1])]
    near = [(300 + k, good[20 + k][1].rstrip(".") + " " + words[k] + ".") for k in range(10)]
    private = [(400 + k, good[40 + k][1] + f" Write to user{k}@example.org today and then {plain(40)}") for k in range(5)]
    rows = good + bad + copies + near + private
    write(spark, tmp_path, rows, [(i, int(i < 100), 0) for i, _ in good + bad])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = {}
    for i, t in sorted(good + copies + near + private):
        kept.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t), (i, t))
    kept = sorted(kept.values())
    groups, _ = brute_near(kept)
    kept = [r for r, g in zip(kept, groups) if r[0] == g]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*tokenizer.encode(re.sub(r"user\d@example.org", "<EMAIL>", t), add_special_tokens=False).ids, 0] for i, t in kept}
    got = {}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == len(got.get(r["doc_id"], [])) and r["doc_tokens"] == len(want[r["doc_id"]])
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert got == want
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1].tolist()] and ends[-1] <= 1024


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    write(spark, tmp_path / "none", [], [])
    docs = spark.read.parquet(str(tmp_path / "none/documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path / "none"))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_near_copies_leave_in_small_batches_and_without_python(spark):
    docs = spark.createDataFrame([(1, "some words of a text"), (2, "some words  of a text"), (3, "other")], "doc_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        out = corpus_pipeline.drop_near(spark, docs, "")
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == corpus_pipeline.BATCH < 10_000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert not re.search("Python|Pandas", out._jdf.queryExecution().executedPlan().toString())
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3]
