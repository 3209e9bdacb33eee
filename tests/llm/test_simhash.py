import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from newsloom.llm import components, simhash

from .conftest import sentence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, distance=4):
    """Smallest member of each print's component, all pairs compared."""
    array = np.array(prints, np.uint64)
    parent = list(range(len(array)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(array)):
        for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= distance):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(array))]


def near_copies(n):
    rows = []
    for i in range(n):
        words = sentence(i // 6, 200).split()
        if i % 6:
            words[(i * 37) % 200] = f"changed{i}"
        if i % 6 == 5:
            words[(i * 11) % 200] = f"again{i}"
        rows.append((i, " ".join(words)))
    return rows


def test_components_are_those_of_all_pairs(make_docs, odd_rows):
    rows = near_copies(240) + [(1000 + k, t) for k, (_, t) in enumerate(odd_rows)]
    found = {r.doc_id: r for r in simhash.components_of(make_docs(rows, clashing=True)).collect()}
    prints = [fingerprint(t) for _, t in rows]
    assert [int(found[i].fingerprint, 16) for i, _ in rows] == prints
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in found.values())
    expected = [rows[k][0] for k in classes(prints)]
    assert [found[i].component_id for i, _ in rows] == expected
    assert len(set(expected)) < 200  # there are near copies


def test_hash_is_that_of_spark(spark):
    text = "the quick brown fox jumps over the lazy dog"
    expected = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
    assert xxhash.xxh64_intdigest(text.encode(), 42) == expected % (1 << 64)


def some_prints(rng, n):
    """Clusters, chains and single prints."""
    base = rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)
    out = [base]
    for flips in (1, 2, 4):
        copy = base.copy()
        for _ in range(flips):
            copy ^= np.uint64(1) << rng.integers(0, 64, len(copy)).astype(np.uint64)
        out.append(copy)
    return np.unique(np.concatenate([*out, np.array([0, 1, 3, (1 << 64) - 1], np.uint64)]))


@pytest.mark.parametrize("block", [8192, 4])
def test_links_join_what_all_pairs_join(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    prints = some_prints(np.random.default_rng(7), 400)
    # Bits that hardly vary, so that values are crowded.
    dense = (prints & np.uint64(0xFF)) | np.uint64(0xABCDEF0123456700)
    for case in (prints, np.unique(dense)):
        rows = spark.createDataFrame([(int(x),) for x in case.view(np.int64)], "fp long")
        found = components.components(simhash.links(rows)).collect()
        label = {r.node % (1 << 64): r.root for r in found}
        expected = classes(case.tolist())
        groups = {}
        for x, c in zip(case.tolist(), expected):
            groups.setdefault(c, set()).add(label.get(x, ("alone", x)))
        assert all(len(labels) == 1 for labels in groups.values())
        assert len({next(iter(labels)) for labels in groups.values()}) == len(groups)


def test_plan_covers_the_distance():
    rng = np.random.default_rng(1)
    for n in (10, 10_000, 10**9):
        share = rng.random(64)
        both = np.outer(share, share) * n
        np.fill_diagonal(both, share * n)
        groups = simhash.plan(both, n)
        assert sum(g.threshold + 1 for g in groups) == simhash.MAX_DISTANCE + 1
        bits = [b for g in groups for b in g.bits]
        assert len(bits) == len(set(bits))
        for _ in range(200):
            differ = set(rng.choice(64, rng.integers(0, 5), replace=False).tolist())
            assert any(len(differ & set(g.bits)) <= g.threshold for g in groups)


def test_correlated_bits_share_a_group():
    rng = np.random.default_rng(3)
    bits = rng.random((4000, 64)) > 0.5
    bits[:, 40] = bits[:, 3]
    bits[:, 50] = bits[:, 3]
    x = bits.astype(float)
    groups = simhash.correlated_groups(x.T @ x, 4000, 5)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert any({3, 40, 50} <= set(g) for g in groups)


def test_spanning_forest_has_no_pairs_to_spare():
    base = np.uint64(12345)
    star = np.array([base ^ (np.uint64(1) << np.uint64(k)) for k in range(60)], np.uint64)
    froms, tos = simhash.spanning_forest(star, 4)
    assert len(froms) == 59 and (np.bitwise_count(froms ^ tos) <= 4).all()


def test_one_of_each_component_stays(make_docs):
    rows = near_copies(60) + [(7, "twice the same id"), (7, "twice the same id"), (None, "no id at all"), (None, None)]
    docs = make_docs(rows, clashing=True)
    left = simhash.deduplicate(docs)
    assert left.columns == docs.columns
    kept = left.collect()
    prints = [fingerprint(t) for _, t in rows]
    members = {}
    for k, c in enumerate(classes(prints)):
        members.setdefault(c, []).append(rows[k])
    assert len(kept) == len(members)
    smallest = [min((i is None, i or 0) for i, _ in m) for m in members.values()]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted(smallest)
    assert kept[0]["fp"] == "own fp"


def test_odd_tables(odd_docs, odd_rows, no_docs):
    assert simhash.components_of(no_docs).collect() == []
    assert simhash.deduplicate(no_docs).collect() == []
    rows = simhash.components_of(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.component_id for r in zero} == {1}


def test_chains_are_one_component(spark):
    n = 3000
    links = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    ring = spark.createDataFrame([(10**6 + k, 10**6 + (k * 7 + 1) % 50) for k in range(50)], "a long, b long")
    found = components.components(links.unionByName(ring)).collect()
    roots = {r.node: r.root for r in found}
    assert all(roots[k] == 0 for k in range(n + 1))
    assert {roots[10**6 + k] for k in range(50)} <= set(roots.values()) and len(found) == n + 51
    assert components.components(links.limit(0)).collect() == []
