"""SimHash components and substring removal against brute force."""

import hashlib
import re

import numpy as np
import xxhash

from mountwait.llm import simhash, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    sh = [" ".join(w[i:i + 4]) for i in range(max(len(w) - 3, 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), f"{fps[i]:016x}", str(least.get(find(i)))) for i, (d, _) in enumerate(rows))


def test_components_equal_brute_force(docs, real, odd):
    rows = real + odd + [(900, real[0][1]), (901, real[0][1] + " tail"), (902, real[1][1].upper())]
    got = simhash.near_duplicates(docs(rows)).collect()
    assert sorted((str(r.doc_id), f"{r.fp & (2**64 - 1):016x}", str(r.component_id)) for r in got) == brute_components(rows)


def test_links_keep_components_of_dense_groups(llm):
    rng = np.random.default_rng(2)
    fps = set()
    for _ in range(6):
        base = int(rng.integers(0, 2**63)) * 2
        for _ in range(80):
            x = base
            for b in rng.choice(64, 5, replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    df = llm.createDataFrame([(s,) for s in signed], "fp long")
    # The default, and with nearly every entry cut into sub-entries.
    for hot in (simhash.HOT_ENTRY, 3):
        parts = {}
        got = {r.node: r.root for r in simhash.components(simhash.links(df, hot_entry=hot)).collect()}
        for f, s in zip(fps, signed):
            parts.setdefault(got.get(s, s), set()).add(find(f))
        assert all(len(v) == 1 for v in parts.values()) and len(parts) == len({find(f) for f in fps})


def test_sub_entries_meet_every_near_pair():
    """Each pair within 4 bits agrees on one of an entry's bytes and half of the other half bytes."""
    rng = np.random.default_rng(8)
    masks = simhash._bit_masks(4)
    assert len(masks) == 70 and all(len(sub) == 70 and all(m.bit_count() == 48 for m in sub) for _, sub in masks)
    for _ in range(300):
        diff = sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False))
        own = [(m, sub) for m, sub in masks if not m & diff]
        assert own and all(any(not x & diff for x in sub) for _, sub in own)


def test_large_component_and_many_copies(llm):
    """One component with a third of the nodes, one fingerprint with a third of the rows: joined by broadcast."""
    star = [1 << b | 1 << c for b in range(62) for c in range(b)]  # two bits each, so all linked
    far = [int(x) for x in np.random.default_rng(4).integers(1 << 40, 1 << 62, 3800)]
    rows = [(10 + i, f) for i, f in enumerate(star)] + [(5000 + i, f) for i, f in enumerate(far)] + [(9000 + i, star[7]) for i in range(3000)]
    df = llm.createDataFrame([(d, d, f) for d, f in rows], "doc_id long, key long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.classes(df).collect()}
    assert len(got) == len(rows) and all(got[d] == 10 for d, f in rows if f in set(star))
    lone = [d for d, f in rows if 5000 <= d < 9000 and got[d] == d]
    assert len(lone) > 3700 and all(got[d] != 10 for d in lone)


def test_keep_one_row_of_each_component(docs, real, odd):
    rows = real[:50] + [(i and i + 1000, t) for i, t in odd] + [(500, real[0][1]), (real[0][0], real[0][1])]
    kept = simhash.keep_one(docs(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
    want = {c for _, _, c in brute_components(rows)}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(want)


def test_keep_one_with_clashing_columns_and_many_repeats(docs, real):
    rows = [(1, real[0][1])] * 40 + [(2, real[1][1]), (None, real[2][1])]
    df = docs(rows).selectExpr("*", "doc_id AS id", "text AS row", "1 AS no", "2 AS `key`", "3 AS fp", "4 AS root",
                               "5 AS component_id", "6 AS f", "7 AS fs")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "None"]
    assert all(r.row == r.text and (r.no, r.key, r.fp, r.root, r.component_id, r.f, r.fs) == (1, 2, 3, 4, 5, 6, 7) for r in got)


def test_simhash_of_empty_table(docs):
    assert simhash.near_duplicates(docs([])).count() == 0 and simhash.keep_one(docs([])).count() == 0


def brute_removal(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for b in texts:
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for (d, _), b in zip(rows, texts):
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if seen[b[s:s + length]] > 1:
                gone[s:s + length] = True
        gone = gone[:len(b)]
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        out.append((str(d), len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def removal(df, length, **kw):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest())
                  for r in suffixes.remove_duplicates(df, length=length, **kw).collect())


def test_removal_equals_brute_force(docs, real):
    a, b = real[3][1], real[4][1]
    rows = real[:40] + [(700, a[:450] + b), (701, b[200:] + a[100:]), (702, None), (703, ""), (704, a), (704, a),
                        (705, "ab" * 900), (706, "x" * 400), (707, "x" * 401), (708, b[:399])]
    assert removal(docs(rows), 400) == brute_removal(rows, 400)


def test_removal_with_shared_passages_and_edges(docs):
    """A passage in many texts, with other words around it and cut short at either end."""
    rng = np.random.default_rng(5)

    def words(n):
        return " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    passage = words(40)
    rows = []
    for i in range(60):
        cut = int(rng.integers(0, 60))
        rows.append((i, words(30) + passage[cut:len(passage) - int(rng.integers(0, 60))] + words(int(rng.integers(0, 30)))))
    assert removal(docs(rows), 100) == brute_removal(rows, 100)


def test_hot_open_extents_are_split(docs, real, monkeypatch):
    rows = real[:30] + [(800 + i, f"{i} " * 3 + real[5][1][:300] + f" {i}" * 9) for i in range(20)]
    found = suffixes.duplicate_runs
    monkeypatch.setattr(suffixes, "duplicate_runs", lambda d, n: found(d, n, hot=1))
    want = brute_removal(rows, 200)
    assert removal(docs(rows), 200) == want
    # The same with every window of the open extents as a row, copies of a text included.
    monkeypatch.setattr(suffixes, "_MAX_PARTS", -1)
    rows += [(900, rows[-1][1]), (901, rows[-1][1])]
    assert removal(docs(rows), 200) == brute_removal(rows, 200) != want


def test_removal_of_empty_table(docs):
    assert suffixes.remove_duplicates(docs([])).count() == 0
