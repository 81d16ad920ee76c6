"""Near-duplicate classes of signature sets against brute force."""

import itertools
import random

import pytest

pytest.importorskip("catalogops.llm")
import numpy as np  # noqa: E402

from catalogops.llm import signature_classes, spotsigs  # noqa: E402

DDL = "doc_id long, text string, id string, tag string, class_id string"


def _brute(rows, percent):
    sets = [set(spotsigs.signatures(t or "", spotsigs._Hashes()).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[top(j)] = top(i)
    members = {}
    for i in range(len(rows)):
        members.setdefault(top(i), []).append(i)
    out = []
    for group in members.values():
        known = [rows[i][0] for i in group if rows[i][0] is not None]
        out += [(rows[i][0], len(rows[i][1] or ""), min(known, default=None), len(group)) for i in group]
    return sorted(out, key=str)


def _near(spark, rows, small=signature_classes.SMALL, percent=80):
    docs = spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], DDL)
    classes = signature_classes.near_classes(spotsigs.rows_of(docs), percent, small)
    got = spotsigs.neighbour_fingerprints(docs, classes=classes).select("doc_id", "n_chars", "class_id", "class_size").collect()
    return sorted(map(tuple, got), key=str)


def _family(rng, words, text, copies, edits):
    for _ in range(copies):
        own = text.split()
        for _ in range(rng.randint(1, edits)):
            own[rng.randrange(len(own))] = rng.choice(words)
        yield " ".join(own)


@pytest.mark.parametrize("small", [2, signature_classes.SMALL])
def test_classes_match_brute_force(spark, small):
    rng = random.Random(small)
    words = ["the", "of", "and", "is", *("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(200))]
    texts = [" ".join(rng.choice(words[:4] if rng.random() < 0.3 else words) for _ in range(rng.randint(1, 160))) for _ in range(40)]
    for text in texts[:4]:
        texts += _family(rng, words, text, 25, 6)
    common = " ".join(rng.choice(words[:12]) for _ in range(60))
    texts += [common + " " + " ".join(rng.choice(words) for _ in range(40)) for _ in range(30)]
    texts += [*texts[:3], texts[0], None, "", "", "one", "one", "the " * 3000, " ".join(rng.choice(words) for _ in range(30_000))]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert _near(spark, rows, small) == _brute(rows, 80)


def test_classes_of_repeated_and_null_ids(spark):
    a, b = " ".join(f"the w{i} x{i}" for i in range(50)), " ".join(f"of y{i} z{i}" for i in range(50))
    rows = [(1, a), (1, a), (1, b), (None, a + " end"), (None, "lone text here"), (7, b), (None, None), (None, "p q r s"), (None, "p q r s"), (9, "p of q")]
    assert _near(spark, rows) == _brute(rows, 80)


def test_classes_of_empty_tables(spark):
    docs = spark.createDataFrame([], DDL)
    classes = signature_classes.near_classes(spotsigs.rows_of(docs))
    assert classes.count() == 0 and spotsigs.neighbour_fingerprints(docs, classes=classes).count() == 0


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(5)
    names = np.arange(0, 400, 3, dtype=np.uint32)
    frequent = names, rng.integers(1, 9, len(names))
    linked = 0
    for _ in range(3000):
        x = np.unique(rng.integers(0, 400, rng.integers(1, 60)).astype(np.uint32))
        y = np.setdiff1d(x, rng.choice(x, rng.integers(0, 1 + len(x) // 5)))
        y = np.union1d(y, rng.integers(0, 400, rng.integers(0, 1 + len(x) // 8)).astype(np.uint32))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both):
            linked += 1
            assert len(np.intersect1d(signature_classes.bucket_keys(x, frequent, 80), signature_classes.bucket_keys(y, frequent, 80)))
    assert linked > 500


def test_frequent_signatures_are_found(spark):
    sets = [np.unique(np.array([7, 9, 1000 + i, 5000 + i], np.uint32)).tobytes() for i in range(200)]
    df = spark.createDataFrame([(4, bytes(s)) for s in sets] + [(4, None)], "n long, sigs binary").repartition(3)
    names, seen = signature_classes.frequent_signatures(df, 8)
    assert names.tolist() == [7, 9] and (seen <= 200).all()


def _shuffled(spark, work):
    """Bytes that the stages of ``work`` wrote for shuffles."""
    sc = spark.sparkContext

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    before = max(stages(), default=-1)
    work()
    return sum(n for i, n in stages().items() if i > before)


def test_signatures_shared_by_chance_are_not_shuffled_further(spark):
    rng = random.Random(3)
    texts = [" ".join(f"the w{i} x{i}" for i in rng.sample(range(1200), 200)) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)], DDL).coalesce(2)
    found = []
    moved = _shuffled(spark, lambda: found.append(signature_classes.near_classes(spotsigs.rows_of(docs)).count()))
    assert moved < 3 * sum(map(len, texts))  # 7 times with keys of single signatures
    assert found == [0]


def test_packed_keys_come_back():
    rng = np.random.default_rng(2)
    for count in (1, 2, 5000):
        keys, places = rng.integers(0, 2**64, count, np.uint64), rng.integers(0, 1 << 16, count)
        keys[-1] = keys[0]
        got = [(part, *signature_classes.unpacked_keys(*rest)) for part, *rest in signature_classes.packed_keys(keys, places, 7)]
        short = keys >> np.uint64(64 - signature_classes.KEY_BITS)
        assert sorted(zip(short.tolist(), places.tolist())) == sorted((k, p) for _, ks, ps in got for k, p in zip(ks.tolist(), ps.tolist()))
        assert all((ks * np.uint64(7) >> np.uint64(signature_classes.KEY_BITS) == part).all() for part, ks, _ in got)
