"""The stages over the smallest tables against a brute-force version of each on its own input."""

from __future__ import annotations

import hashlib
from collections import Counter

import corpus_pipeline as P
import pytest

from tempograph.llm.common import stored

from .test_operators import awkward, brute_lines, brute_quality, reference_codec, shingles, weighted

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in P.STAGES:
        new, _ = stored(f(spark, docs, SF), name)
        out.append((docs.collect(), new.collect()))
        if name != "bpe_encode":
            assert tuple(new.columns) == P.COLUMNS
        docs = new
    return out


def test_quality(steps):
    before, after = steps[0]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if not brute_quality(r.text)[5])


def test_lines(steps):
    before, after = steps[1]
    assert sorted((r.doc_id, r.text) for r in after) == sorted(x[:2] for x in brute_lines([(r.doc_id, r.text) for r in before]))
    assert all(r.n_chars == len(r.text) for r in after)


def test_near_duplicates(steps):
    before, after = steps[2]
    bags = {r.doc_id: shingles(r.text) for r in before}
    parent = {i: i for i in bags}
    find = lambda x: x if parent[x] == x else find(parent[x])
    ids = sorted(bags)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if weighted(bags[a], bags[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert sorted(r.doc_id for r in after) == sorted({find(i) for i in ids})


def test_mix(steps):
    before, after = steps[3]
    n = Counter(r.doc_id for r in after)
    assert set(n) == {r.doc_id for r in before} and set(n.values()) <= {1, 2}
    had, got = Counter(), Counter()
    for r in before:
        had[r.source] += len(r.text.encode())
    for r in after:
        got[r.source] += len(r.text.encode())
    assert all(1 <= got[s] / had[s] <= P.MAX_REPEATS + 1e-6 for s in had)


def test_tokens(spark, steps):
    before, after = steps[4]
    enc = reference_codec()
    want = [(r.doc_id, len(ids := enc.encode_ordinary(r.text)), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r in before]
    assert sorted(map(tuple, after)) == sorted(want)
    assert sorted(map(tuple, P.run(spark, SF).collect())) == sorted(want)


def test_stages_take_awkward_rows(spark):
    """Nulls, empty and long texts, repeated rows and ids, columns that clash; and no rows at all."""
    clash = "doc_id long, text string, source string, n_lines string, cut string, row string, host string, id string"
    rows = [(i, t, s, "a", "b", "c", "d", "e") for i, t, s, *_ in awkward()]
    docs = spark.createDataFrame(rows, clash).selectExpr("*", "'en' as lang", "cast(length(text) as long) as n_chars")
    for table in (docs, docs.limit(0)):
        for name, f in P.STAGES:
            out, _ = stored(f(spark, table, SF), name)
            got = out.collect()
            if name != "bpe_encode":
                lost = {"n_lines"} if name == "line_dedup" else set()
                assert out.columns == [c for c in table.columns if c not in lost], name
                assert {r.cut for r in got} <= {"b"} and {r.id for r in got} <= {"e"}
            if name in ("line_dedup", "bpe_encode"):
                assert len(got) == table.count(), name
            if name == "mix_sources":
                assert {r.doc_id for r in got} == {r.doc_id for r in table.collect()}
