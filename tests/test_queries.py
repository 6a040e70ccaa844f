"""Every registered query with SQL gives the SQL's rows."""

import pytest
from oracle import compare

from tidemark.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, name):
    assert compare(spark, sf, QUERIES[name], ORACLES[name]) > 0


def test_bloom_probe(spark, sf):
    """No key of any run is missed, and about one probe in a hundred is a false positive."""
    from tidemark.sources.changelog import read_changelog

    got = {tuple(r) for r in QUERIES["bloom_probe"](spark, sf).select("key", "run_id").collect()}
    have = {tuple(r) for r in read_changelog(spark, sf).select("k", "run_id").distinct().collect()}
    keys, run_ids = {k for k, _ in have}, {i for _, i in have}
    assert len(run_ids) > 4 and have <= got
    assert len(got - have) <= 0.05 * len(keys) * len(run_ids)


def test_sparse_index_seek(spark, sf):
    """The last index entry not above each key, by bisection, for all pairs that the filters admit."""
    from bisect import bisect_right
    from collections import defaultdict

    index = defaultdict(list)
    for r in QUERIES["sparse_index"](spark, sf).collect():
        index[r["run_id"]].append((r["k"].encode(), r["offset"]))
    want = set()
    for k, i in {tuple(r) for r in QUERIES["bloom_probe"](spark, sf).select("key", "run_id").collect()}:
        e = sorted(index[i])
        at = bisect_right([x for x, _ in e], k.encode())
        want.add((i, k, e[at - 1][1] if at else 0))
    rows = [tuple(r) for r in QUERIES["sparse_index_seek"](spark, sf).select("run_id", "k", "offset").collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_compact_picked(spark, sf):
    from tidemark.operators import resolve
    from tidemark.sources.changelog import read_changelog

    chosen = [r["run_id"] for r in QUERIES["compaction_pick"](spark, sf).collect()]
    want = resolve.lww(read_changelog(spark, sf).where(f"run_id in ({','.join(map(str, chosen))})"))
    assert {tuple(r) for r in QUERIES["kv_compact_picked"](spark, sf).select("k", "seq").collect()} == {tuple(r) for r in want.select("k", "seq").collect()}
