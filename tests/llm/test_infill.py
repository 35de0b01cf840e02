import hashlib
import random
import re

import pytest

from quarry.llm import infill

DOCS = "doc_id long, text string, form string, __sha string"


def brute(doc_id, text, rate=100, spm=50):
    """The contract, text by text."""
    t = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", t)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(lines)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    turned = h[3] % 100 < spm
    return n, "spm" if turned else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if turned else f"<P>{p}<S>{s}<M>{m}"


def texts():
    random.seed(12)
    piece = lambda: "".join(random.choice(["a", "é", "文", "😀", " ", "\n", "\n\n", "\r", "<", "P>", "<S", "M", "\x00"]) for _ in range(random.randint(0, 40)))
    out = [(k, piece()) for k in range(400)] + [(-k, f"{piece()}\n{piece()}") for k in range(1, 60)]
    out += [(1000, None), (1001, ""), (None, "x\ny\n"), (None, None), (1002, "\n"), (1003, "one"), (1004, "a<M>b"), (1005, "a<P"), (1006, "<<P>"), (7, "twice\nover"), (7, "twice\nover")]
    return [*out, (2000, "né\n" * 900_000), (2001, "x" * 2_000_000), (2002, "l\n" * 30 + "<P")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "other", "x") for r in texts()], DOCS).repartition(3)


@pytest.mark.parametrize("rate, spm", [(100, 50), (40, 0), (0, 100)])
def test_outputs_and_restored_texts(docs, rate, spm):
    key = lambda r: (r[0] is None, r[0] or 0, r[1:3], r[-2])
    got = infill.restore(infill.fill_in_middle(docs, rate, spm)).collect()
    want = [(i, *brute(i, t, rate, spm), t or "") for i, t in texts()]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_steps_and_blocks(docs, monkeypatch):
    import numpy as np

    monkeypatch.setattr(infill, "STEP", 5)
    some = [(i, t or "") for i, t in texts() if len(t or "") < 1000]
    data = np.frombuffer("".join(t for _, t in some).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for _, t in some])
    rolls = np.array([[int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)] for i, _ in some])
    out, out_ends, facts = infill.scatter(data, ends, rolls, 100, 50)
    back, back_ends, good = infill.gather(out, out_ends, [f[1] for f in facts])
    assert good.all() and back.tobytes() == data.tobytes() and (back_ends == ends).all()
    want = [brute(i, t) for i, t in some]
    assert facts == [w[:4] for w in want] and out.tobytes().decode() == "".join(w[4] for w in want)


def test_broken_outputs_and_empty_tables(spark, docs):
    rows = [("psm", "<P>a<S>b"), ("spm", "<P>a<S>b<M>c"), ("psm", None), (None, "x"), ("plain", "<P>"), ("psm", "<P>a<S>c<M>b"), ("spm", "<S>c<P>a<M>")]
    got = infill.restore(spark.createDataFrame([(*r, "old") for r in rows], "form string, output string, restored string")).collect()
    assert [r["restored"] for r in got] == [None, None, None, None, "<P>", "abc", "ac"]
    none = infill.restore(infill.fill_in_middle(spark.createDataFrame([], DOCS)))
    assert none.count() == 0 and none.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
