"""Exact dedup against a dictionary of whole texts."""

import hashlib
import re

import pytest

from mountwait.llm import exact
from mountwait.llm.common import written

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute(rows):
    """(doc_id, keep_id, group_size, sha) and the number of kept rows per text."""
    groups = {}
    for d, t in rows:
        groups.setdefault(SPACE.sub(" ", t or ""), []).append(d)
    out = []
    for d, t in rows:
        n = SPACE.sub(" ", t or "")
        ids = [i for i in groups[n] if i is not None]
        out.append((str(d), str(min(ids) if ids else None), len(groups[n]), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out), len(groups)


def seen(got):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256.hex()) for r in got)


@pytest.mark.parametrize("section_bytes", [exact.SECTION_BYTES, 1])
def test_groups_equal_brute_force(docs, real, odd, section_bytes):
    rows = real + odd + [(900 + i, real[0][1]) for i in range(300)] + [(-5, real[3][1].replace(" ", "\t \n")), (None, "one")]
    rows += [(10_000 + i, f"text {i % 5000}") for i in range(6_000)]
    want, texts = brute(rows)
    got = exact.mark(docs(rows), section_bytes=section_bytes).collect()
    assert seen(got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == texts == len({bytes(r.text_sha256) for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)
    assert exact.mark(docs(rows)).schema.simpleString() == \
        "struct<doc_id:bigint,keep_id:bigint,group_size:bigint,kept:boolean,text_sha256:binary>"


def test_white_space_and_null(docs):
    rows = [(4, "a b"), (3, "a\n\n b"), (5, " a b"), (6, None), (7, ""), (8, "\t"), (9, " "), (10, "a b")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.mark(docs(rows)).collect()}
    assert got == {4: (3, 2, False), 3: (3, 2, True), 5: (5, 1, True), 6: (6, 2, True), 7: (6, 2, False),
                   8: (8, 2, True), 9: (8, 2, False), 10: (10, 1, True)}


@pytest.mark.parametrize("section_bytes", [exact.SECTION_BYTES, 1])
def test_keep_one_keeps_whole_rows(docs, real, odd, section_bytes):
    rows = real + odd + [(900 + i, real[0][1]) for i in range(50)] + [(10_000 + i, f"text {i % 4000}") for i in range(5_000)]
    table = docs(rows)
    got = exact.keep_one(table, section_bytes=section_bytes)
    assert got.columns == table.columns
    groups = {}
    for d, t in rows:
        n = SPACE.sub(" ", t or "")
        groups.setdefault(n, []).append((d is None, d))
    assert sorted((str(r.doc_id), SPACE.sub(" ", r.text or "")) for r in got.collect()) == \
        sorted((str(min(ids)[1]), n) for n, ids in groups.items())


def test_empty_table(docs):
    assert exact.mark(docs([]).limit(0)).collect() == []
    assert exact.keep_one(docs([]).limit(0)).collect() == []


def test_only_suspects_shuffle(llm, docs):
    """Distinct texts: the filter flags few of them, and none that repeats is missed."""
    n = 20_000
    rows = docs([(i, f"text {i if i % 10 else 0}") for i in range(n)])
    hashes = written(rows.selectExpr("doc_id", "xxhash64(text) as h"), "t")
    blocks = exact._blocks(n)
    marked = exact.probe(hashes, exact.repeated_bits(hashes, blocks), blocks)
    flagged = {r.doc_id for r in marked.where("suspect").collect()}
    assert flagged >= set(range(0, n, 10))
    assert len(flagged) - n // 10 < 0.03 * n


def test_main_path_is_native(docs, real):
    plan = exact.mark(docs(real))._jdf.queryExecution().toString()
    for word in ("Python", "Arrow", "ExistingRDD", "MapPartitions", "CartesianProduct", "NestedLoop"):
        assert word not in plan, word
