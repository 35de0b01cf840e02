import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from quarry.llm import lm

PATH = public_tokenizers.path("byte_bpe_50k.json")
BIG = 2**60 + 1


def is_held(i):
    return i is None or zlib.crc32(str(i).encode()) % 7 == 2


@pytest.fixture(scope="module")
def rows():
    """Texts of two tongues, so that earlier words tell what kind of word comes next."""
    random.seed(5)
    tongues = [["".join(random.choice(part) for _ in range(random.randint(2, 6))) for _ in range(400)] for part in ("abcdefg", "mnoprstuvw")]
    text = lambda n: " ".join(random.choice(tongue) for tongue in [random.choice(tongues)] for _ in range(n))
    out = [(i, text(random.randint(1, 120))) for i in range(150)]
    out += [(1000, None), (1001, ""), (1002, " \t\x0b\n"), (1003, "A\u00a0B Ab aB"), (1004, "x" * 30_000), (1005, " ".join(f"w{k}" for k in range(30_000))), (None, "a b"), (BIG, "a b"), (7, out[7][1]), (7, out[7][1])]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, __score string, row int").repartition(3)


@pytest.fixture(scope="module")
def scored(docs):
    return lm.score_texts(docs, lm.is_training(docs["doc_id"]), PATH).collect()


def key(r):
    return (r["doc_id"] is None, r["doc_id"], r["n_tokens"])


def test_base_columns(rows, scored):
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()), b""]
    c = Counter(w for i, t in rows if not is_held(i) for w in tokens(t))
    n, v = c.total(), len(c)
    want = sorted(((i, is_held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows), key=lambda r: (r[0] is None, r[0], r[2]))
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in sorted(scored, key=key)]
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)


def test_held_out_texts_score_above_the_base(scored):
    held = [r for r in scored if r["held_out"] and r["n_tokens"] < 1000]
    assert len(held) > 10 and sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.1 * sum(r["n_tokens"] for r in held)


def test_scores_do_not_depend_on_the_layout(docs, scored):
    again = lm.score_texts(docs.repartition(7), lm.is_training(docs["doc_id"]), PATH).collect()
    assert np.allclose([r["score"] for r in sorted(again, key=key)], [r["score"] for r in sorted(scored, key=key)], rtol=1e-3)


def test_rare_words_count_exactly(docs, scored, monkeypatch):
    monkeypatch.setattr(lm, "COMMON", 50)
    again = lm.score_texts(docs, lm.is_training(docs["doc_id"]), PATH).collect()
    for name in ("n_known", "base_score", "score"):
        assert np.allclose([r[name] for r in sorted(again, key=key)], [r[name] for r in sorted(scored, key=key)], rtol=1e-6)


@pytest.mark.parametrize("kept", [20, 10**9])
def test_repeated_words_are_kept_once(spark, rows, docs, monkeypatch, kept):
    """Rows hold their distinct words only, and tell the same ids, counts and sums as every word taken alone."""
    monkeypatch.setattr(lm, "COUNTED", kept)
    tokens = {i: [*lm.words_of(t or ""), b""] for i, t in rows if i is not None}
    logs = {w: 1.0 for t in tokens.values() for w in t if len(w) % 2}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        some = docs.filter("doc_id is not null").selectExpr("string(doc_id) doc_id", "coalesce(text, '') text", "false held_out")
        encoded = lm.encoded(some, PATH, spark.sparkContext.broadcast(logs))
        got, sums = encoded.collect(), {r["id"]: tuple(r)[1:] for r in lm.id_sums(encoded, PATH).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    own, want = lm.signs(lm._subwords(PATH).n_vocab + 1), {}
    for r in got:
        words = tokens[int(r["doc_id"])]
        one = lm.Encoded.read(PATH, [r["ids"]], [r["ends"]], [r["tokens"]])
        assert len(one.sizes) == len(set(words)) and one.lengths.tolist() == [len(words)]
        ids, sizes = lm.word_ids(PATH, words)
        each = np.split(one.ids, np.cumsum(one.sizes)[:-1])
        assert np.concatenate([each[k] for k in one.tokens]).tolist() == ids.tolist() and one.sizes[one.tokens].tolist() == sizes.tolist()
        rare = Counter(w for w in words if w not in logs)
        assert dict(zip(map(bytes, r["rare"]), r["times"])) == rare
        assert r["n_common"] == r["common"] == len(words) - rare.total()
        times = Counter(ids.tolist())
        doc = sum(n * own[i] for i, n in times.items())
        doc = np.round(100 * doc / max(1.0, math.sqrt(doc @ doc))).astype(int)
        for i, n in times.items():
            want[i] = want.get(i, 0) + n * np.append(1, doc)
    assert len(got) == len([i for i, _ in rows if i is not None]) and sums == {i: tuple(x.tolist()) for i, x in want.items()}


def test_a_whole_score_against_a_plain_sum(docs, scored, monkeypatch):
    """The class part of a score, taken from documents alone, comes to what all of them together give."""
    fitted = []
    fit = lm.fit
    monkeypatch.setattr(lm, "fit", lambda *a: fitted.append(fit(*a)) or fitted[0])
    again = {(r["doc_id"], r["n_tokens"]): r for r in lm.score_texts(docs, lm.is_training(docs["doc_id"]), PATH).collect()}
    (weights, sizes, vocabulary), n = fitted[0], scored[0]["train_tokens"]
    p, texts = lm.unpacked(weights, "float64"), [r for r in docs.collect() if r["doc_id"] is not None and r["doc_id"] < 40]
    counts = Counter(w for r in docs.collect() if not is_held(r["doc_id"]) for w in [*lm.words_of(r["text"] or ""), b""])
    for r in texts:
        words = [*lm.words_of(r["text"]), b""]
        x, kind = vocabulary.value.of(*lm.word_ids(PATH, words))
        far = ((x[:, None, :].astype("float64") - vocabulary.value.centres) ** 2).sum(2)
        assert kind.tolist() == [*far.argmin(1)[:-1], lm.CLASSES - 1]
        logs = np.concatenate([lm.forward(p, *step)[0][real] for *step, real in lm._steps(x, kind, np.array([len(words)]), vocabulary.value.vectors[-1])])
        want = logs.sum() / math.log(10) + sum(math.log10((counts[w] + 1) / sizes[k]) for w, k in zip(words, kind))
        assert abs(again[r["doc_id"], len(words)]["score"] - want) < 1e-4 * abs(want)
    assert n == counts.total()


def test_empty_and_untrained(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_texts(none, lm.is_training(none["doc_id"]), PATH).count() == 0
    one = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    (r,) = lm.score_texts(one, lm.is_training(one["doc_id"]), PATH).collect()
    assert (r["n_known"], r["train_tokens"], r["base_score"]) == (0, 0, 0) and r["score"] <= 0


def model(rng, kinds=40):
    p = {k: rng.standard_normal(s) * 0.3 for k, s in lm.SHAPES.items()}
    return p, rng.standard_normal((kinds, lm.WIDTH))


def test_gradient():
    rng = np.random.default_rng(0)
    p, x = model(rng, 4 * lm.CONTEXT)
    first, targets = np.array([True, False, True, False]), rng.integers(0, lm.CLASSES, 4 * lm.CONTEXT)
    weights = rng.integers(0, 2, len(targets)).astype(float)
    logs, kept = lm.forward(p, x, first, targets)
    g = lm.gradient(p, kept, weights)
    for name in lm.SHAPES:
        at = tuple(k // 2 for k in p[name].shape)
        q = {k: v.copy() for k, v in p.items()}
        q[name][at] += 1e-6
        slope = -((lm.forward(q, x, first, targets)[0] - logs) * weights).sum() / 1e-6
        assert abs(slope - g[name][at]) < 1e-3 * max(1, abs(slope)), name


def test_attention_against_a_plain_loop():
    """Each token is scored once, from the tokens of its block and the one before in its own document."""
    rng = np.random.default_rng(1)
    p, vectors = model(rng)
    kinds = rng.integers(0, lm.CLASSES, 40)
    lengths = np.array([1, 5, 40, 16, 17, 33])
    numbers = np.concatenate([np.append(rng.integers(1, 40, n - 1), 0) for n in lengths])
    got = np.concatenate([lm.forward(p, x, f, t)[0][own] for x, f, t, own in lm._steps(vectors[numbers], kinds[numbers], lengths, vectors[0])])
    want, at = [], 0
    for n in lengths:
        own = numbers[at : at + n]
        before = np.concatenate([[0], own[:-1]])
        at += n
        for t in range(n):
            low = max(0, t // lm.CONTEXT * lm.CONTEXT - lm.CONTEXT)
            keys = vectors[before[low : t + 1]]
            place = np.arange(low, t + 1) - (t // lm.CONTEXT * lm.CONTEXT - lm.CONTEXT)
            a = np.exp(keys @ (p["match"].T @ vectors[before[t]]) + p["near"][t % lm.CONTEXT][place])
            h = np.concatenate([vectors[before[t]], (a / a.sum()) @ keys @ p["value"]])
            z = np.maximum(h @ p["inner"] + p["shift"], 0) @ p["out"] + p["prior"]
            want.append(z[kinds[own[t]]] - np.log(np.exp(z - z.max()).sum()) - z.max())
    assert np.allclose(got, want, atol=1e-9)


def test_chances_of_all_words_sum_to_one():
    """Over known words and one unseen word for each class."""
    rng = np.random.default_rng(2)
    counts, kind = rng.integers(1, 9, 300), rng.integers(0, lm.CLASSES, 300)
    sizes = 1 + np.bincount(kind, counts, lm.CLASSES) + np.bincount(kind, minlength=lm.CLASSES)
    share = rng.dirichlet(np.ones(lm.CLASSES))
    assert abs((share[kind] * (counts + 1) / sizes[kind]).sum() + (share / sizes).sum() - 1) < 1e-9


def test_words_are_encoded_alike_together_and_alone():
    random.seed(4)
    words = ["".join(random.choice(["a", "'s", "é", "\u00a0", "1", "-", "漢", "ing", "\u0085", "😀"][: random.choice([3, 10])]) for _ in range(random.randint(1, 9))).encode() for _ in range(2000)] + [b"y" * 5000, b""]
    for some in (words, [w for w in words[:2000] if not lm._SPACES.search(w.decode())]):
        ids, sizes = lm.word_ids(PATH, some)
        assert len(sizes) == len(some)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [lm.word_ids(PATH, [w])[0].tolist() for w in some]
    parts = [lm.word_ids(PATH, d) for d in (words, [b""])]
    ends = []
    for ids, sizes in parts:
        ends.append(np.zeros(len(ids), bool))
        ends[-1][np.cumsum(sizes) - 1] = True
    got = lm.Encoded.read(PATH, [x.astype("<u2").tobytes() for x, _ in parts], [np.packbits(e).tobytes() for e in ends])
    assert (got.ids == np.concatenate([x for x, _ in parts])).all() and (got.sizes == np.concatenate([n for _, n in parts])).all()
    assert got.lengths.tolist() == [len(words), 1]
