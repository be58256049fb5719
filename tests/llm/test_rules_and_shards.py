"""Repetition rules, shards and the classifier."""

import re
import zlib
from collections import Counter

import numpy as np

from mountwait.llm import nbsvm, repetition, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_rules(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    inside = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i:i + 8])] > 1:
            inside.update(range(i, i + 8))
    failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
    chars = sum(map(len, w))
    kept = not failed
    for n, limit in repetition.NGRAM_LIMITS.items():
        seen, again = set(), set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i:i + n])
            if g in seen:
                again.update(range(i, i + n))
            seen.add(g)
        kept &= sum(len(w[i]) for i in again) <= limit * max(chars, 1) + 1e-9
    n_symbols = sum(c in "#*$%&|<>" for c in text)
    dup, seen = [], set()
    for x in lines:
        dup += [x] if x in seen else []
        seen.add(x)
    kept &= sum(map(len, dup)) <= repetition.LINE_LIMIT * max(len(text), 1) and n_symbols <= repetition.SYMBOL_WORDS * len(w)
    return len(w), chars, n_symbols, len(dup), len(inside), failed, bool(kept)


def test_rules_equal_brute_force(docs, real, odd):
    rows = real + odd + [(800, "a line of text\n" * 9), (801, "x\n\nx\n \nx"), (802, "### " * 40 + "tail")]
    got = repetition.repetition_rules(docs(rows)).collect()
    have = sorted(map(str, ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                             r.base_failed, r.kept) for r in got)))
    assert have == sorted(str((i, *brute_rules(t))) for i, t in rows)
    assert repetition.repetition_rules(docs([])).count() == 0


def test_shards_hold_groups_and_balance(docs, real, odd):
    rows = real + odd + [(1000 + i, real[0][1]) for i in range(20)]
    got = sharding.shard_documents(docs(rows)).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, group, load = {}, {}, Counter()
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        group.setdefault((r.text_crc32, r.size), set()).add(r.shard)
        load[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for v in group.values()) and set(slots) <= set(range(24))
    # LPT: no shard is above the mean by more than the largest group.
    sizes = Counter()
    for i, t in rows:
        sizes[t or ""] += len((t or "").encode()) + 8
    assert max(load.values()) <= sum(load.values()) / 24 + max(sizes.values())


def test_lpt_takes_the_least_loaded_shard():
    assert Counter(sharding.lpt([(5, "a"), (4, "b"), (3, "c"), (3, "d"), (3, "e")], 2).values()) in (Counter({0: 2, 1: 3}), Counter({0: 3, 1: 2}))
    assert sharding.lpt([], 3) == {}


def test_shards_of_empty_table(docs):
    assert sharding.shard_documents(docs([])).count() == 0


def test_dual_descent_reaches_the_primal_optimum():
    """The duality gap closes on a small problem."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    y = np.sign(x[:, 0] + 0.5 * rng.normal(size=60))
    cost = np.full(60, 0.7)
    w, b = nbsvm.dual_descent([np.arange(8)] * 60, list(x), y, cost, 8, epochs=2000)
    primal = 0.5 * (w @ w + b * b) + cost @ np.maximum(0, 1 - y * (x @ w + b))
    better = []
    for _ in range(400):
        v, c = w + 0.02 * rng.normal(size=8), b + 0.02 * rng.normal()
        better.append(0.5 * (v @ v + c * c) + cost @ np.maximum(0, 1 - y * (x @ v + c)))
    assert primal <= min(better) + 1e-3


def test_held_out_accuracy(llm):
    d = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = llm.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = nbsvm.score_documents(d, lab)
    assert out.count() == d.count()
    rows = out.where("held_out").join(lab, "doc_id").select("predicted", "quality").collect()
    assert len(rows) > 40 and np.mean([r.predicted == r.quality for r in rows]) > 0.88


def test_classifier_on_odd_rows_and_without_labels(llm, docs, odd):
    none = llm.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in nbsvm.score_documents(docs(odd), none).collect()} == {0.5}
    lab = llm.createDataFrame([(i, i % 2, None) for i in range(40)] + [(3, 0, 0), (None, 1, 0), (4, None, 0)],
                              "doc_id long, quality int, toxic int")
    rows = odd + [(i, "good clean text here" if i % 2 else "bad | bad | bad") for i in range(10, 40)]
    got = nbsvm.score_documents(docs(rows), lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert nbsvm.score_documents(docs([]), lab).count() == 0


def test_the_sample_is_bounded_by_rows(llm, docs, monkeypatch):
    """An id on a third of the rows, with many texts or with one, does not go to the driver as a whole."""
    rows = [(i, f"good text {i} of words") for i in range(1, 40)] + [(100 + i, f"bad text {i} of junk") for i in range(1, 40)]
    rows += [(1, f"good row {i} again") for i in range(300)] + [(101, "bad row")] * 300
    lab = llm.createDataFrame([(i, int(i < 100)) for i, _ in rows[:78]], "doc_id long, quality int")
    sizes, real = [], nbsvm.dual_descent
    monkeypatch.setattr(nbsvm, "dual_descent", lambda r, v, y, *a, **k: sizes.append(len(y)) or real(r, v, y, *a, **k))
    for sample in (10, 60):
        nbsvm.fit(docs(rows), lab, sample=sample)
        assert 0 < max(sizes) <= 2 * sample
        sizes.clear()
