import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import bpe, chat, components, embeddings, exact_dedup, lm, minhash, packing, pii, quality, registry, substrings

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, __sha string"


def texts():
    random.seed(3)
    word = lambda: "".join(random.choice("abcdeé") for _ in range(random.randint(2, 7)))
    vocabulary = [word() for _ in range(300)]
    passage = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    shared = [passage(120) for _ in range(3)]
    out = [(i, f"{passage(random.randint(0, 90))} {random.choice(shared)}") for i in range(40)]
    out += [(100, None), (101, ""), (102, "a" * 5000), (103, "a\tb  c"), (104, "a b\nc"), (105, out[3][1]), (105, out[3][1]), (106, out[4][1] + " more"), (None, out[5][1]), (107, "<|endoftext|> </s>")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "en", "x") for r in texts()], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_exact(docs, none):
    got = exact_dedup.exact_groups(docs).collect()
    by = {}
    for i, t in texts():
        by.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    groups = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in by.items()}
    assert len(got) == len(texts()) and sum(r["kept"] for r in got) == len(by)
    for r in got:
        ids = groups[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == min((i for i in ids if i is not None), default=None)
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.drop_exact_copies(docs).count() == len(by)
    assert exact_dedup.drop_exact_copies(docs).columns == docs.columns


def test_packing(docs, none):
    tokenizer = Tokenizer.from_file(PATH)
    rows = packing.pack(docs, PATH, capacity=64, windows=4).collect()
    want = Counter((i, zlib.crc32(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes())) for i, t in texts() if i != 105)
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        seq.setdefault(r["sequence_id"], []).append(r)
    assert all(sum(r["length"] for r in s) <= 64 for s in seq.values())
    for s in seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
    got = Counter((i, zlib.crc32(b"".join(bytes(r["ids"]) for r in sorted(p, key=lambda r: r["start"])))) for i, p in by.items() if i != 105)
    assert got == want
    assert packing.pack(none, PATH).count() == 0


def test_differencing():
    groups = packing.difference([8, 7, 6, 5, 4], 2)
    assert sorted(sum(groups, [])) == [0, 1, 2, 3, 4]
    assert abs(sum([8, 7, 6, 5, 4][i] for i in groups[0]) - 15) <= 1


def test_bpe(docs, none):
    tokenizer = Tokenizer.from_file(PATH)
    encoder = bpe.TrieEncoder(PATH)
    random.seed(2)
    chars = [*map(chr, range(32, 127)), *"éß\u0085　漢かな😀٣½\x00\t\n\r", "<|endoftext|>", "'ll", "   ", "ing"]
    some = ["".join(random.choice(chars) for _ in range(random.randint(0, 60))) for _ in range(2000)] + ["a" * 3000, " " * 3000]
    for t, ids, want in zip(some, encoder.encode_batch(some), tokenizer.encode_batch(some, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids
        assert encoder.decode(ids) == tokenizer.decode(want.ids, skip_special_tokens=False)
    got = sorted((r["doc_id"] or -1, r["decoded"]) for r in bpe.encode_texts(docs, PATH).collect())
    assert got == sorted((i or -1, t or "") for i, t in texts())
    assert bpe.encode_texts(none, PATH).count() == 0


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(x) for x in m[0] if x.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(x.isdigit() for x in m[0]) <= 15]


def test_pii(spark):
    random.seed(1)
    parts = ["1", "45", "4111111111111111", "+1", "+", ".", " ", "-", "@", "a.b", "(", ")", "\n", "é", "_", "10.0.0.1", "%", "😀", "999"]
    rows = [(i, "".join(random.choice(parts) for _ in range(random.randint(0, 40)))) for i in range(3000)] + [(5000, None), (5001, ""), (5002, "1 " * 50_000)]
    found = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in found:
        got = [(s["kind"], s["start"], s["end"]) for k in ("email", "ip", "card", "phone") for s in r[f"pii_{k}"]]
        assert got == base_spans(r["text"] or ""), r["text"]
    out = pii.redact(spark.createDataFrame([(1, "iban GB82 WEST 1234 5698 7654 32, mail a.b@c.de."), (2, None)], "doc_id long, text string")).collect()
    assert [r["text"] for r in out] == ["iban <IBAN>, mail <EMAIL>.", None]


def test_chat(spark):
    rows = [(1, 1, "assistant", "a\\<|im_end|>\n[/INST]"), (1, 0, "user", None), (2, 0, None, "<s>\\"), (2, 0, "user\n", "x"), (2, 0, "user\n", "x")]
    rows += [(k, j, ("user", "assistant")[j % 2], f"{k} 😀 {j} \\ [INST]") for k in range(10, 40) for j in range(k % 4)] + [(None, 0, "user", "no id"), (50, 0, "human", "h" * 100_000)]
    rows += [(60, j, ("user", "assistant")[j % 2], f"turn {j}") for j in range(9000)]
    want = {}
    for i, n, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1], r[2] or "", r[3] or "")):
        want.setdefault(i, []).append((role or "", text or ""))
    records = chat.as_records(chat.gathered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    out = chat.format_turns(chat.canonical_turns(records)).withColumn("back", chat.parsed()).collect()
    assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["back"]] for r in out} == want
    assert len({r["fingerprint"] for r in out}) == 6
    for r in out:
        loss = [re.sub(r"(?s)\\(.)", r"\1", r["formatted"][s["start"] : s["end"]]) for s in r["loss_spans"]]
        assert loss == [t for role, t in want[r["conv_id"]] if role == "assistant"]


def test_chat_layouts(spark):
    kinds = {
        '{"prompt":"p","response":"r"}': [("user", "p"), ("assistant", "r")],
        '{"instruction":"i","input":"","output":"o"}': [("user", "i"), ("assistant", "o")],
        '{"instruction":"i","input":null,"output":"o"}': [("user", "i"), ("assistant", "o")],
        '{"conversations":[{"from":"human","value":"v"}]}': [("user", "v")],
        '{"messages":[{"role":"user"},{"content":"c","role":"assistant"}]}': [("user", ""), ("assistant", "c")],
        '{"messages":[{"role":"user","content":[{"type":"text","text":"a"},{"type":"text","text":"b"}]}]}': [("user", "ab")],
        '{"data":{"turns":[{"utterance":"u","speaker":"s"}]}}': [("s", "u")],
        '{"messages":[]}': [],
        '{"messages":["a"]}': None,
        '{"odd":1}': None,
        '{"data":{"turns":{"utterance":"u","speaker":"s"}}}': None,
        "[1]": None,
        "no json": None,
        None: None,
    }
    df = spark.createDataFrame([(k, "a", "b", "c", "d") for k in kinds], "record string, turns string, fingerprint string, __pieces string, formatted string")
    out = chat.format_turns(chat.canonical_turns(df), "_turns")
    assert out.columns == [*df.columns, "_fingerprint", "_turns", "_formatted", "loss_spans"]
    for r in out.collect():
        assert (r["_turns"] and [tuple(t) for t in r["_turns"]]) == kinds[r["record"]] or kinds[r["record"]] == r["_turns"] == [], r["record"]
        assert (r["turns"], r["fingerprint"], r["__pieces"], r["formatted"]) == ("a", "b", "c", "d")
    assert chat.format_turns(chat.canonical_turns(df.select("record").limit(0))).count() == 0


@pytest.mark.parametrize("crowd", [1000, 2])
def test_substrings(docs, none, monkeypatch, crowd):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substrings.remove_repeats(docs).collect())
    raw = [(i, (t or "").encode()) for i, t in texts()]
    seen = Counter(r[k : k + 400] for _, r in raw for k in range(len(r) - 399))
    want = Counter()
    for i, r in raw:
        cover = np.zeros(len(r), bool)
        for k in range(len(r) - 399):
            if seen[r[k : k + 400]] > 1:
                cover[k : k + 400] = True
        want[i, len(r), int(cover.sum()), len(substrings._runs(cover)), bytes(np.frombuffer(r, "uint8")[~cover])] += 1
    assert got == want
    assert substrings.remove_repeats(none).count() == 0


def test_suffix_ranks():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4, 5, 8, 9, 50, 200):
        s = rng.integers(1, 4, n)
        order = sorted(range(n), key=lambda i: s[i:].tolist())
        assert (substrings.suffix_ranks(s)[order] == np.arange(1, n + 1)).all()


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 64))
    rows = [(int(k), (base[k % 30] + rng.standard_normal(64) * 0.2).tolist()) for k in range(120)] + [(200, base[0].tolist()), (201, base[0].tolist()), (300, None), (301, [0.0] * 64), (302, [float("nan")] * 64), (303, []), (304, [1.0, None])]
    x = np.array([v for _, v in rows[:122]], "float32").astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    got = {r["vec_id"]: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert len(got) == len(rows) and all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(300, 305))
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * (linked.sum() - 122)
    assert all(got[rows[k][0]]["n_links"] <= linked[k].sum() - 1 for k in range(122))


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 43


def test_minhash(docs, none):
    out = minhash.near_groups(docs).collect()
    by = {r["doc_id"]: r["component_id"] for r in out}
    assert len(out) == len(texts()) and by[106] == by[4] == 4 and by[105] == 3 and by[103] == by[104]
    assert by[100] == by[101] == 100
    assert minhash.near_groups(none).count() == 0
    assert minhash.drop_near_copies(docs).columns == docs.columns


def test_weighted_similarity_estimate():
    rng = np.random.default_rng(0)
    values = np.sort(rng.integers(0, 1 << 63, 800, dtype="uint64"))
    weights = rng.uniform(1, 8, 800)
    other = np.concatenate([values[:600], rng.integers(0, 1 << 63, 200, dtype="uint64")])
    agree = (minhash.sample(values, weights) == minhash.sample(other, weights)).mean()
    assert abs(agree - minhash.similarity((values, weights), (np.sort(other), weights[np.argsort(other)]))) < 0.25


def test_quality(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(61, None)], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, "Plain words and more of them here." if i % 2 else "LOUD!! WORDS!! HERE!! $$$") for i in range(60)] + [(61, None)], "doc_id long, text string")
    score = quality.scorer(quality.fit(docs, labels))
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", score("text").alias("s")).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(60)) and 0 <= got[61] <= 1
    assert quality.keep_good(docs, labels).columns == docs.columns


def prose(n, words):
    return " ".join(random.choice(words) for _ in range(n)).capitalize() + "."


def test_quality_against_brute_force(spark):
    """Scores of whole texts, from features counted one by one, by weights at which the loss has no slope."""
    random.seed(21)
    words = ["the", "stone", "river", "under", "light", "shall", "carry", "winter", "to", "and", "lantern", "moss"]
    good = [(k, prose(random.randint(5, 120), words)) for k in range(0, 300, 2)]
    bad = [(k, " ".join(random.choice(["BUY!!", "$$$", "###", "now!!"]) for _ in range(random.randint(5, 60)))) for k in range(1, 300, 2)]
    other = [(1000, ""), (1001, None), (1002, " \n\t"), (1003, "qzxv " * 100), (1004, prose(300_000, words)), (None, good[3][1]), (good[3][0], good[3][1]), (1005, "x")]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(7, None), (None, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame([(*r, "en", 0.5, "x") for r in good + bad + other], "doc_id long, text string, lang string, quality double, __score string").repartition(3)
    model = quality.fit(docs, labels)
    score = quality.scorer(model)
    got = Counter((r["doc_id"], r["text"], round(r["s"], 9)) for r in docs.select("doc_id", "text", score("text").alias("s")).collect())
    want = lambda t: float(model.score(np.array([quality.features(t or "")]))[0])
    assert got == Counter((i, t, round(want(t), 9)) for i, t in good + bad + other)
    assert all(want(t) >= 0.5 for _, t in good) and all(want(t) < 0.5 for _, t in bad)
    gibberish = ["", " \n", *["".join(random.choice("abcdefghijklmnopqrstuvwxyz") if c.isalpha() else c for c in t) for _, t in good if len(t) > 100]]
    letters = [c for c in good[0][1] if c.isalpha()]
    random.shuffle(letters)
    gibberish.append("".join(letters.pop() if c.isalpha() else c for c in good[0][1]))
    assert all(want(t) < 0.5 for t in gibberish)
    assert want(other[4][1]) >= 0.5 and quality.keep_good(docs, labels).count() == len(good) + 3

    # Features one by one.
    text = "Ab ab\nÉ9"
    raw = [ord(c) + 32 if "A" <= c <= "Z" else ord(c) for c in text.encode().decode("latin-1")]
    low = [x if x >= 128 or chr(x).isalpha() else 32 for x in raw]
    runs, found, held = np.zeros(quality.RUNS), np.zeros(quality.WORDS), []
    for a, b, c in zip(low, low[1:], low[2:]):
        runs[(a * 961 + b * 31 + c) * 40_503 % 65_521 % quality.RUNS] += 1
    for x in [*low, 32]:
        if x != 32:
            held.append(x)
        elif held:
            found[sum(y * pow(31, k % 32 + 1, 1_000_003) for k, y in enumerate(held)) * 40_503 % 65_521 % quality.WORDS] += 1
            held = []
    assert np.allclose(quality.features(text)[-1 - quality.RUNS - quality.WORDS : -1], np.sqrt(np.concatenate([runs / runs.sum(), found / found.sum()])))

    # The fit: at its weights the penalised loss has no slope, in whatever pieces the pairs are summed.
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 6))
    better, worse = rng.integers(0, 500, 30_000), rng.integers(0, 500, 30_000)
    swap = (x[better] - x[worse]) @ [1, -2, 0.5, 0, 0, 3] + rng.logistic(size=30_000) < 0
    better, worse = np.where(swap, worse, better), np.where(swap, better, worse)
    w = quality.fit_pairs(x, better, worse)
    d = x[better] - x[worse]
    assert np.abs(d.T @ (1 / (1 + np.exp(d @ w))) / len(d) - 1e-3 * w).max() < 1e-9 and np.dot(w, [1, -2, 0.5, 0, 0, 3]) > 0.999 * np.linalg.norm(w) * np.linalg.norm([1, -2, 0.5, 0, 0, 3])
    one = quality.fit(docs, labels.filter("quality = 1"))
    assert one.score(np.array([quality.features("")]))[0] < 0.5 <= one.score(np.array([quality.features(good[0][1])]))[0]
    assert quality.fit(docs, labels.filter("quality = 0")).score(np.array([quality.features("a b")]))[0] == 0.5


def test_anchors_of_a_very_long_text():
    raw = np.random.default_rng(4).integers(0, 256, (1 << 25) + 9000, dtype="uint8")
    raw[-3000:] = raw[1000:4000]
    text, at, first, last, hashes = substrings.anchors([b"short", raw.tobytes()], 400)
    assert (text == 1).all() and (last - first + 1).sum() == len(raw) - 399
    assert (at >= last).all() and (at <= first + 400 - substrings.GRAM).all()
    order = np.argsort(first)
    of = lambda window: hashes[order][np.searchsorted(first[order], window, "right") - 1]
    assert all(of(1000 + k) == of(len(raw) - 3000 + k) for k in range(0, 2601, 100))


def brute_near(rows):
    """component_id and kept of each row, by all pairs of whole texts; and the least similarity that links."""
    found = [(i, (t or "").split()) for i, t in rows]
    shingles = [Counter(zip(*(w[k:] for k in range(min(5, len(w)))))) for _, w in found]
    n, df = len(rows), Counter(x for c in shingles for x in c)
    idf = lambda x: np.log((n + 1) / (max(df[x], n / minhash.SATURATION) + 1)) + 1

    def similarity(a, b):
        both = sum(min(a[x], b[x]) * idf(x) for x in a.keys() & b.keys())
        return both / (sum(c * idf(x) for x, c in a.items()) + sum(c * idf(x) for x, c in b.items()) - both) if a or b else 1

    group = list(range(n))
    pairs = [(i, j) for i in range(n) for j in range(i) if similarity(shingles[i], shingles[j]) >= 0.8 or shingles[i] == shingles[j]]
    while any(group[i] != group[j] for i, j in pairs):
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])
    least = {g: min((rows[i][0] for i in range(n) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    return [least[g] for g in group], len(pairs)


@pytest.mark.parametrize("saturation", [2, 512])
def test_minhash_against_all_pairs(spark, monkeypatch, saturation):
    monkeypatch.setattr(minhash, "SATURATION", saturation)
    random.seed(8)
    words = [f"w{k}" for k in range(3000)]
    boilerplate = " ".join(random.choice(words) for _ in range(60))
    rows = []
    for k in range(40):
        own = [random.choice(words) for _ in range(random.choice([3, 20, 150]))]
        for edits in random.choice([(0,), (0, 1, 2), (0, 0, 3, 8, 20)]):
            other = list(own)
            for _ in range(edits):
                other[random.randrange(len(other))] = random.choice(words)
            rows.append((len(rows), " ".join(other) + (" " + boilerplate if k % 2 else "")))
    rows += [(900, None), (901, ""), (902, " \n "), (903, rows[5][1]), (903, rows[5][1]), (None, rows[5][1]), (904, rows[7][1].replace(" ", "\n"))]
    want, pairs = brute_near(rows)
    docs = spark.createDataFrame([(*r, k, "d") for k, r in enumerate(rows)], "doc_id long, text string, n long, __id string").repartition(5)
    got = Counter((r["doc_id"], r["component_id"]) for r in minhash.near_groups(docs).collect())
    assert pairs > 40 and got == Counter((r[0], c) for r, c in zip(rows, want))


def test_minhash_weights_are_exact(spark):
    """Frequencies above the saturation are exact however full the counters are."""
    boilerplate = " ".join(f"b{k}" for k in range(944))
    rows = [(k, f"{boilerplate} " + " ".join(f"r{k}_{i}" for i in range(60))) for k in range(4)]
    rows += [(4, rows[0][1] + " more words")]
    rows += [(10 + k, f"{boilerplate} " + " ".join(f"f{k}_{i}" for i in range(400_000))) for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    of = minhash.fit(docs)
    df = Counter(x for _, t in rows for x in np.unique(minhash.shingles(minhash.word_hashes(t))).tolist())
    assert dict(zip(of.common.tolist(), of.idf)) == {x: np.log(15 / (k + 1)) + 1 for x, k in df.items() if k > len(rows) / minhash.SATURATION}
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_groups(docs).collect() if r["doc_id"] < 5} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}


CLASHES = ["__hits0", "__word1", "__id", "__y", "__sha", "__maybe", "__keep_sha", "__keep_id", "__digest", "__own_digest", "__score", "row", "digest", "sha"]


def test_filters_keep_clashing_columns(spark):
    texts = [(1, "plain words of a text"), (1, "plain words of a text"), (2, "plain  words of a text"), (3, None), (None, ""), (4, "OTHER!! text")]
    docs = spark.createDataFrame([(*r, *CLASHES) for r in texts], ", ".join(["doc_id long", "text string", *(f"`{c}` string" for c in CLASHES)]))
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int")
    for step in (exact_dedup.drop_exact_copies, minhash.drop_near_copies, pii.redact, lambda d: quality.keep_good(d, labels)):
        out = step(docs)
        assert out.columns == docs.columns and all(tuple(r)[2:] == tuple(CLASHES) for r in out.collect())
        assert step(docs.limit(0)).count() == 0
    assert sorted((r["doc_id"] or 0, r["text"]) for r in exact_dedup.drop_exact_copies(docs).collect()) == [(1, texts[0][1]), (3, None), (4, "OTHER!! text")]


def test_oracles_are_sql():
    assert registry.ORACLE_SQL and all(isinstance(x, str) for x in registry.ORACLE_SQL.values())


def test_pii_long_domains(spark):
    """Domains have no bound; a possessive group takes them in a loop, without the stack."""
    rows = [(n, f"to a@b{'.c' * n}..d, x@y.z") for n in (1, 5_000, 300_000)]
    for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert [("email", s["start"], s["end"]) for s in r["pii_email"]] == [x for x in base_spans(r["text"]) if x[0] == "email"]


def test_running_totals(spark):
    from pyspark.sql import functions as F

    from quarry.llm import common

    random.seed(6)
    rows = [(k, [random.randint(-9, 9) for _ in range(n)]) for k, n in enumerate([0, 1, 63, 64, 65, 4096, 4097, 20_000])]
    df = spark.createDataFrame(rows, "k long, v array<long>")
    got = df.select("k", F.expr(common.running("v", "a + x", "0L")).alias("s"), F.expr(common.running("v", "greatest(a, x)", "-99L")).alias("m")).collect()
    for r in got:
        assert r["s"] == np.cumsum(rows[r["k"]][1]).tolist() and r["m"] == np.maximum.accumulate(np.array(rows[r["k"]][1], int)).tolist()


def test_reading_in_chunks(spark):
    from pyspark.sql import functions as F

    from quarry.llm import common

    text = "".join(random.choice("ab\n😀é") for _ in range(2000))
    places = [(a, b) for a in (0, 1, 511, 512, 513, 1024, 1999, 2000) for b in (0, 1, 511, 512, 513, 1024, 1999, 2000) if a <= b]
    df = spark.createDataFrame([(text, a, b) for a, b in places], "t string, a long, b long")
    got = df.select("a", "b", F.expr(f"transform(array({common.in_chunks('t')}), c -> {common.read('c', 'a', 'b')})[0]").alias("x")).collect()
    assert all(r["x"] == text[r["a"] : r["b"]] for r in got)


def test_pii_names_ties_and_many_matches(spark):
    many = " ".join(f"email user{k}@example.org now" for k in range(20_000))
    rows = [(None, None, 1, "x", "y"), (2, many, 2, "x", "y"), (2, many, 2, "x", "y"), (3, "call +1 (555) 123-4567", 3, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii_email long, __t string, __spans string")
    out = pii.find_spans(docs)
    assert out.columns[:5] == docs.columns and pii.span_columns(docs)[0] == "_pii_email"
    found = out.collect()
    assert sorted(len(r["_pii_email"]) for r in found) == [0, 0, 20_000, 20_000]
    assert all(s["score"] > 1 for s in found[1]["_pii_email"])
    red = pii.redact(docs).collect()
    assert [tuple(r)[2:] for r in red] == [r[2:] for r in rows] and red[0]["text"] is None
    assert red[1]["text"] == " ".join(["email <EMAIL> now"] * 20_000) and red[3]["text"] == "call <PHONE>"
    assert pii.redact(docs.limit(0)).count() == 0 == pii.find_spans(docs.limit(0)).count()


def test_exact_ids_beside_nulls(spark):
    """Ids beyond 2^53 stay exact in a batch that also holds a null."""
    big = 2**60 + 1
    docs = spark.createDataFrame([(big, "some text"), (None, "other words here"), (big + 2, None)], "doc_id long, text string").coalesce(1)
    for out in (packing.pack(docs, PATH), bpe.encode_texts(docs, PATH), substrings.remove_repeats(docs), minhash.near_groups(docs), exact_dedup.exact_groups(docs)):
        assert {r["doc_id"] for r in out.collect()} == {big, None, big + 2} and out.schema["doc_id"].dataType.simpleString() == "bigint"


def test_window_count_rises_until_all_fit():
    random.seed(7)
    for _ in range(50):
        sizes = [random.randint(1, 100) for _ in range(random.randint(1, 60))]
        groups = packing.deal(sizes, 100)
        assert sorted(sum(groups, [])) == list(range(len(sizes))) and max(sum(sizes[i] for i in g) for g in groups) <= 100
        full = packing.level([[(i, 0, np.arange(sizes[i]), sizes[i]) for i in g] for g in groups], 100)
        filled = sorted(sum(len(p[2]) for p in g) for g in full)
        # As few windows as the total allows, so the padding of all is less than one window.
        assert len(full) == -(-sum(sizes) // 100) and filled[-1] <= 100 and sum(filled) == sum(sizes)
    assert len(packing.deal([60, 60, 60], 100)) == 3


def test_words_hash_by_eight_bytes():
    """Hashes part and tell words as str.split() does, in whatever company, and no draw depends on the way it is looked up."""
    random.seed(4)
    texts = ["".join(random.choice("ab\0é中 \t\x1c\x85\xa0 　​") for _ in range(random.choice([0, 1, 9, 60]))) for _ in range(400)]
    texts += [c * n + "z " + "y" * n for n in (0, 6, 7, 8, 9, 16, 254, 255, 256, 257, 900) for c in "xz"]
    both = {(w, h) for t, (hashes, _) in zip(texts, minhash.parsed(texts), strict=True) for w, h in zip(t.split(), hashes.tolist(), strict=True)}
    assert len(both) == len({w for w, _ in both}) == len({h for _, h in both}) > 200
    for t, (hashes, found) in zip(texts, minhash.parsed(texts)):
        assert np.array_equal(hashes, minhash.word_hashes(t)) and np.array_equal(found, minhash.shingles(hashes))
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype="uint64"))
    weights = np.where(np.arange(5000) % 7, 7.2, np.arange(5000) / 1000 + 1)
    assert np.array_equal(minhash.sample(values, weights, 7.2), minhash.sample(values, weights))
