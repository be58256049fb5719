"""Token counts and sampled segmentations against the tokenizer's own library."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece

from mountwait.llm import lattice, transducer

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_equal_the_library(docs, real, odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = real + odd
    got = transducer.token_counts(docs(rows), PATH).collect()
    want = sorted((str(i), len((t or "").encode()), len(sp.encode(t or ""))) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)


def test_chunk_maps_compose_at_any_cut():
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    t = transducer.load(PATH)
    rng = random.Random(3)
    for _ in range(800):
        x = "".join(rng.choice("ab e  thin▁\n\t.é中文😀ñ0 1ingXYZ'\"") for _ in range(rng.randint(0, 50)))
        assert transducer.count_tokens(t, x, rng.choice([1, 2, 3, 7, 100])) == len(sp.encode(x)), x
    maps = [transducer.chunk_map(t, "▁the▁end"[k:k + 2]) for k in range(0, 8, 2)]
    assert transducer.prefix_scan(t, maps)[-1].apply(t, t.start)[1] == len(sp.encode("the end"))
    for n in (1, 2, 5, 8, 13):  # every prefix is that of the text up to its chunk
        parts = ["▁ab▁▁c", "def", "▁", "gh▁i", "j"] * 3
        for k, m in enumerate(transducer.prefix_scan(t, [transducer.chunk_map(t, p) for p in parts[:n]])):
            assert m.apply(t, t.start) == t.run(t.start, "".join(parts[:k + 1]))


def test_count_of_empty_table(docs):
    assert transducer.token_counts(docs([]), PATH).count() == 0


def test_sampled_ids_decode_to_the_text(docs, real, odd):
    rows = lattice.round_trip(docs(real[:60] + odd), PATH).collect()
    assert len(rows) == 60 + len(odd) and all(r.lossless for r in rows)


def test_sampling_depends_on_key_and_text_only(llm, docs, real):
    one = lattice.encode_sampled(docs(real[:40]), PATH).select("doc_id", "ids", "score")
    two = lattice.encode_sampled(docs(real[10:40][::-1]), PATH).select("doc_id", "ids", "score")
    assert {(r.doc_id, tuple(r.ids)) for r in two.collect()} <= {(r.doc_id, tuple(r.ids)) for r in one.collect()}


def test_sampling_follows_the_lattice_chances():
    """Shares of the segmentations of a short text agree with brute force over all of them."""
    lat = lattice.load(PATH)
    text, *_ = lattice.read_pieces(PATH)
    word = " then"
    ways = {}

    def walk(at, ids, w):
        if at == len(word):
            ways[tuple(ids)] = w
        for k in range(at + 1, len(word) + 1):
            if (i := text.get(word[at:k])) is not None:
                walk(k, [*ids, i], w * lat.pieces.weight[i])
    walk(0, [], 1.0)
    n = 40_000
    keys = lattice.seeds_of(pa.array(range(n)), 1)
    ids, off = lattice.sample(lat, ["then"] * n, keys)
    seen = {}
    for a, b in zip(off[:-1], off[1:]):
        k = tuple(ids[a:b].tolist())
        seen[k] = seen.get(k, 0) + 1
    total = sum(ways.values())
    assert set(seen) <= set(ways)
    for k, w in ways.items():
        p = w / total
        assert abs(seen.get(k, 0) / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-4


def test_memory_of_unbroken_text_grows_with_the_text():
    """16 MiB without a space: well under what quadratic heads took; a shorter one equals the library."""
    import tracemalloc
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    t = transducer.load(PATH)
    x = "abcabdabe" * 30_000
    assert transducer.count_tokens(t, x, 1000) == len(sp.encode(x))
    t._reset()
    x = "abcabdab" * (1 << 21)
    tracemalloc.start()
    n = transducer.count_tokens(t, x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 0 and peak < 200 << 20, peak
