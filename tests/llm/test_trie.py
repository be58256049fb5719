"""Conversation trie against plain dictionaries."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from mountwait.llm import trie


def brute(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()[:32]
            convs.setdefault(c, []).append(((t is not None, t or 0, digest), (role or "", text or "")))
    convs = {c: [x for _, x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
    members, ends = {}, {}
    for c, p in built.items():
        ends.setdefault(p, []).append(c)
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        saved[p] = own + sum(saved[k] for k in below)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids.get(p, [])), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
                  for p, m in members.items())


COLS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def result(df):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLS) for r in df.collect())


@pytest.fixture()
def table(llm):
    def make(rows):
        return llm.createDataFrame([(*r, 5, "x") for r in rows],
                                   "conv_id long, turn long, role string, text string, depth int, node string").repartition(4)
    return make


def sample(convs, seed=1, words=3, longest=9):
    rng = random.Random(seed)
    return [(c, t, "user" if t % 2 == 0 else "assistant", f"ä{rng.randrange(words)}" * rng.randrange(3))
            for c in convs for t in range(rng.randrange(1, longest))]


def test_equals_brute_force(table):
    rows = sample(range(400)) + sample(range(1003, 1060, 7)) + sample([10**12 + i for i in range(30)])
    rows += [(3, None, "user", "first"), (4, None, None, None), (5, 2, "user", None), (5, 2, "user", ""), (5, 2, None, "x"),
             (None, 1, "user", "lost"), (2001, None, None, ""), (7000, 0, "", "y" * 50_000)]
    assert result(trie.nodes(table(rows))) == brute(rows)


def test_turnless_conversations_are_members_of_the_root(table):
    # 5k+1..4 without a base: own turns after the first h only, so short ones end at the root
    rows = [(c, 0, "user", "a") for c in (6, 7, 8, 9)]
    got = result(trie.nodes(table(rows)))
    assert got == brute(rows)
    assert any(r[1] == 0 and r[3] == 4 for r in got)


def test_deep_and_hot(table, monkeypatch):
    """A path of 700 turns, a third of all conversations equal, blocks of few turns."""
    rows = [(c, t, "user", "same" if t < 3 else f"tail {c // 3}") for c in range(0, 1500, 5) for t in range(1 + (c % 3) * 2)]
    rows += [(5000, t, "user", f"deep {t}") for t in range(700)] + [(5005, t, "user", f"deep {t}") for t in range(690)]
    assert result(trie.nodes(table(rows))) == brute(rows)


def test_empty_table(table):
    assert trie.nodes(table([]).limit(0)).collect() == []


def test_blocks_add_up():
    """Partial nodes of any cut of the sorted paths sum to the nodes of the whole."""
    rng = np.random.default_rng(5)
    paths = sorted({tuple(rng.integers(0, 3, rng.integers(0, 7))) for _ in range(300)})
    size = np.array([len(p) for p in paths])
    digest = np.array([[x, x] for p in paths for x in p], np.uint64).reshape(-1, 2)
    off = np.r_[0, np.cumsum(size)]
    lens = (digest[:, 0] * 7 % 11).astype(int)  # equal turns have equal lengths
    n, conv = rng.integers(1, 9, len(paths)), rng.permutation(len(paths))
    lcp = trie.shared(digest, off)
    before, after = np.maximum(lcp, 0), np.r_[lcp[1:], -1]

    def nodes(blocks):
        out = {}
        for rows in blocks:
            o = np.r_[0, np.cumsum(size[rows])]
            take = np.concatenate([np.arange(off[r], off[r + 1]) for r in rows]).astype(int)
            for depth, at, *vals, end in trie.peel(digest[take], o, lens[take], conv[rows], n[rows], before[rows],
                                                   (after < size)[rows].astype(int)):
                for i, a in enumerate(at):
                    got = out.setdefault(paths[rows[a]][:depth], [10**9, 0, 0, 0, 0, -1])
                    got[0] = min(got[0], int(vals[0][i]))
                    for k in range(1, 5):
                        got[k] += int(vals[k][i])
                    got[5] = max(got[5], -1 if end[i] < 0 else rows[end[i]])
        return out
    whole = nodes([list(range(len(paths)))])
    assert len(whole) == len({p[:d] for p in paths for d in range(len(p) + 1)})
    for width in (1, 2, 7, 50):
        blocks = [list(range(i, min(i + width, len(paths)))) for i in range(0, len(paths), width)]
        assert nodes(blocks) == whole
        rng.shuffle(blocks)  # blocks of rows that are not neighbours
        mixed = [sum(blocks[i:i + 3], []) for i in range(0, len(blocks), 3)]
        assert nodes(mixed) == whole
