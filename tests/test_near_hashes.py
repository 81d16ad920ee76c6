import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogops.operators import duplicates as D
from catalogops.operators import near_hashes as N
from catalogops.operators.components import connected_components
from catalogops.plans import queries as Q


def hashes(n, digits, letters="0123456789abcdef", seed=3):
    """Families of near hashes, and others that share their first half."""
    r = random.Random(seed)
    out, head = [], "".join(r.choices(letters, k=digits // 2))
    while len(out) < n:
        x = "".join(r.choices(letters, k=digits)) if len(out) % 5 else head + "".join(r.choices(letters, k=digits - digits // 2))
        for _ in range(4):
            at = r.sample(range(digits), digits // 5)
            x = "".join(r.choice(letters) if i in at else c for i, c in enumerate(x))
            out.append(x)
    return sorted(set(out))


def classes(n, links):
    group = list(range(n))
    for a, b in links:
        if group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = [low if g == high else g for g in group]
    return group


def brute(found, threshold):
    return [(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(found), 2) if sum(x != y for x, y in zip(a, b)) <= threshold]


@pytest.mark.parametrize("digits, threshold", [(16, 4), (64, 20), (70, 12)])
def test_links_of_a_bucket(digits, threshold):
    found = hashes(300, digits)
    bits, n = N.planes(found, digits), len(found)
    expected = classes(n, brute(found, threshold))
    assert len(set(expected)) < n
    assert classes(n, N.bucket_links(bits, np.zeros(n, int), threshold)) == expected
    rows, to = N.small_links(np.zeros(n, int), bits, threshold)
    assert classes(n, zip(rows.tolist(), to.tolist())) == expected
    side = np.arange(n) % 2 + 1
    links = N.bucket_links(bits, side, threshold)
    for s in (1, 2):
        at = np.flatnonzero(side == s)
        links += [(int(at[a]), int(at[b])) for a, b in N.bucket_links(bits[at], np.zeros(len(at), int), threshold)]
    assert classes(n, links) == expected


@pytest.mark.parametrize("part", [40, 1 << 14])
def test_links_over_parts_of_large_buckets(spark, monkeypatch, part):
    monkeypatch.setattr(N, "SMALL", 8)
    found = hashes(400, 16)
    rows = N.packed(spark.createDataFrame(list(enumerate(found)), "node long, hash string"), 16)
    got = connected_components(N.near_links(rows, 4, 16, part), "a", "b").collect()
    expected = classes(len(found), brute(found, 4))
    assert {r.node: r.component for r in got} == {i: g for i, g in enumerate(expected) if expected.count(g) > 1}


def test_near_hashes_are_not_paired_by_a_join(spark):
    """All 400 rows share a band; the pairs that a join of bands would make are 79,800."""
    rows = [(f"p{i:03}", f"{i:04x}" + "0" * 12) for i in range(400)]
    assert D.hash_links(spark.createDataFrame(rows, "path string, hash string"), 15, 16).count() < 20 * 400
    assert {r.group_id for r in D.similar_groups(spark.createDataFrame(rows, "path string, hash string"), 15, 16).collect()} == {"p000"}


def test_block_hashes_do_not_explode_words(spark, tmp_path):
    texts = [(1, "b a a"), (1, "c\n"), (2, " a a b c "), (3, ""), (4, None), (5, "\tÄ x"), (6, "ä x\n\n y "), (7, "\n")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = Q._histogram_hashes(spark, str(tmp_path))
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    words = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", F.explode(F.split(F.trim(F.lower("text")), r"\s+")).alias("w"))
    counts = {}
    for r in words.select("doc_id", F.conv(F.substring(F.md5("w"), 1, 2), 16, 10).cast("int").alias("bin")).collect():
        counts.setdefault(r.doc_id, [0] * 256)[r.bin] += 1
    expected = {}
    for doc, bins in counts.items():
        middles = [sum(sorted(bins[b * 64 : b * 64 + 64])[31:33]) / 2 for b in range(4)]
        bits = "".join("1" if n > middles[i // 64] else "0" for i, n in enumerate(bins))
        expected[doc] = f"{int(bits, 2):064x}"
    assert {r.path: r.hash for r in got.collect()} == expected
