import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("catalogops.llm.queries")

from catalogops.llm import chat, filter_audit, gnat  # noqa: E402


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


CHAT = "conv_id long, turn long, role string, text string, formatted string, id int"


def formatted(spark, rows):
    return chat.format_conversations(spark.createDataFrame([(*r, "clash", 1) for r in rows], CHAT))


def chats():
    rng = random.Random(5)
    bits = ["a", "é", "\n", "<", "[", "\\", "<s>", "</s>", "[INST]", "[/INST]", "<|end|>", "<|next|>", "<|turn|>", "<|text|>", "<\\|end|>", "[\\\\/INST]", "|>", "INST]", "s>", "﻿", "😀"]
    text = lambda: rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))])
    role = lambda: rng.choice(["user", "assistant", "assistant", "system", None, "", "<|end|>x"])
    rows = [(c, t, role(), text()) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(100, t, "assistant" if t % 3 else "user", f"{t}<s>") for t in range(1500)]
    rows += [(None, 1, "user", "null id"), (101, None, "user", "null turn"), (101, 0, "assistant", "b"), (101, 0, "assistant", "a"), (101, 0, "assistant", "a"), (102, 0, "assistant", "x[INST]" * 200_000)]
    rng.shuffle(rows)
    return rows


def test_chat_round_trip(spark):
    rows = chats()
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    done = formatted(spark, rows)
    got = {r.conv_id: r for r in done.select("conv_id", "formatted", "loss_spans", chat.parse(F.col("formatted")).alias("turns")).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        r = got[c]
        assert [tuple(t) for t in r.turns] == turns
        assert r.formatted.count(chat.TURN) == r.formatted.count(chat.END) == len(list(itertools.groupby(turns, lambda t: t[0])))
        inside = re.split(r"<\|(?:turn|text|next|end)\|>", r.formatted)
        assert not any(re.search(r"</?s>|\[/?INST\]|<\|\w+\|>", x) for x in inside)
        back = lambda x: re.sub(chat.CONTROL.replace(r"(\\*", r"\\(\\*"), r"\1\2", x)
        assert [back(r.formatted[s.start : s.stop]) for s in r.loss_spans] == [t for role, t in turns if role == "assistant"]
    digests = {r.conv_id: r for r in chat.digest_columns(done).collect()}
    for c, turns in want.items():
        learned = "".join(t for role, t in turns if role == "assistant")
        d = digests[c]
        assert (d.n_turns, d.turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (d.loss_chars, d.loss_sha256, d.formatted_chars) == (len(learned), sha(learned), len(got[c].formatted))


def test_chat_of_nothing(spark):
    none = spark.createDataFrame([], CHAT)
    assert chat.digest_columns(chat.format_conversations(none)).count() == 0
    assert chat.digest_columns(formatted(spark, [(1, 1, "user", "x")])).first().loss_chars == 0


DOCS = "doc_id long, text string, source string, row string, part string, n long"


def audited(docs, labels):
    """The audit by going through all orders one filter at a time."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    texts = [(i, t or "", s or "") for i, t, s in docs]
    first = {}
    for i, t, _ in texts:
        if i is not None:
            first[t] = min(i, first.get(t, i))
    fails = []
    for i, t, _ in texts:
        w = words(t)
        fails.append({"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i})
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    for part in {s for _, _, s in texts}:
        mine = [k for k, t in enumerate(texts) if t[2] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [k for k in left if fails[k][f]]
                left = [k for k in left if not fails[k][f]]
                total[f] += len(gone)
                unique = sum(fails[k][f] and sum(fails[k].values()) == 1 for k in mine)
                redundant = sum(fails[k][f] for k in mine) - len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, unique, sum(texts[k][0] in good for k in gone), sum(texts[k][0] in toxic for k in gone), f]
        for key, value in out.items():
            if key[0] == part and isinstance(value[-1], str):
                value[-1] = total[value[-1]]
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]

    def text():
        few = rng.random() < 0.3
        t = " ".join(rng.choice(vocabulary[:20] if few else vocabulary) for _ in range(rng.choice([5, 199, 200, 260])))
        return rng.choice([t, t, t.upper(), t + " #", t + "\x0b|", t.title()])

    texts = [text() for _ in range(60)]
    docs = [(i, rng.choice(texts), rng.choice(["a", "b", None, ""])) for i in range(150)]
    docs += [(7, texts[0], "a"), (7, texts[0], "a"), (None, texts[1], "b"), (None, None, None), (500, None, "c"), (501, "", "c"), (502, "é" * 300_000 + " Z", "c"), (503, "w " * 200_000, "c")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1)]
    table = spark.createDataFrame([(*d, "clash", "clash", 0) for d in docs], DOCS)
    got = filter_audit.audit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == audited(docs, labels)


def test_filter_audit_with_hot_texts(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HOT_SHARE", 5)
    docs = [(i, "copied" if i % 3 else f"t{i % 7}", "s") for i in range(90)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.audit(table, labels).collect()} == audited(docs, [])
    assert filter_audit.audit(table.where("false"), labels).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, row string, window string"


def mined(rows, positives=5, negatives=5):
    dim = max((len(v) for _, v, _ in rows if v is not None), default=0)
    use = []
    for k, (i, v, label) in enumerate(rows):
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        steps = [int(np.floor(256 * float(np.float32(x)))) for x in v] + [0] * (dim - len(v))
        use.append((k, i, (label + 1) % 10 if i % 7 == 0 else label, steps))
    out = []
    for k, i, label, v in use:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), j, o, m) for m, j, o, x in use if m != k)
        for s, j, o, _ in [t for t in scored if t[2] == label][:positives]:
            hits = [t for t in scored if t[2] != label and 80 * -s <= 100 * -t[0] <= 100 * -s][:negatives]
            out += [(i, j, rank, t[1], -s, -t[0]) for rank, t in enumerate(hits, 1)]
    return sorted(out)


def vectors(n, dim, seed, centres=12):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    v = c[rng.integers(centres, size=n)] + 0.3 * rng.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True) * rng.uniform(0.5, 2, size=(n, 1))
    return [(int(i), [float(x) for x in v[i]], int(rng.integers(10))) for i in rng.permutation(n)]


def run(spark, rows, **args):
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], VECTORS)
    return sorted(tuple(r) for r in gnat.hard_negatives(table, **args).collect())


def test_hard_negatives(spark):
    rows = vectors(1500, 12, 1)
    rows += [(2000, None, 1), (2100, [0.1] * 12, None), (2200, [0.1, None] * 6, 1), (2300, [float("nan")] * 12, 1), (2400, [float("inf")] + [0.1] * 11, 1), (None, [0.2] * 12, 1), (2500, [0.0] * 12, 3), (2600, [0.3] * 5, 3), (2700, [], 2)]
    rows += [(3000 + i, rows[0][1], rows[0][2] + i % 2) for i in range(300)]  # a vector that many rows share
    want = mined(rows)
    assert len(want) > 200
    assert run(spark, rows) == want
    assert run(spark, rows, block_anchors=5, sample_rows=200, fanout=3, leaf_rows=8) == want


def test_hard_negatives_of_repeated_rows_and_of_nothing(spark):
    rows = [(100, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (100, [1.0, 0.5], 2), (101, [1.0, 0.5], 2), (101, [0.9, 0.5], 2)]
    assert run(spark, rows) == mined(rows)
    assert run(spark, []) == [] and run(spark, [(1, [1.0], 1), (2, [1.0], 1)]) == []


def test_subtrees_are_eliminated_without_loss(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 8)) * 400
    v = np.floor(centres[rng.integers(40, size=4000)] + rng.normal(size=(4000, 8)) * 8)
    tree = gnat.grow(v, 8, float((v * v).sum(1).max()), fanout=4, leaf_rows=30)
    at = gnat.leaves(tree, v)
    for node in tree.nodes:
        node.low, node.high = np.full((len(node.points), len(node.below)), np.inf), np.full((len(node.points), len(node.below)), -np.inf)
    for node, i, j, lo, hi in gnat.ranges(tree, v, at):
        tree.nodes[node].low[i, j], tree.nodes[node].high[i, j] = lo, hi
    own = (v[:50] * v[:50]).sum(1)
    zero = np.zeros(50, dtype=np.int64)
    open_ = gnat.reachable(tree, gnat.Windows(v[:50], zero, zero, own * 0.9, own, True, 5), np.arange(tree.n_leaves))
    score = v @ v[:50].T
    hit = (score >= own * 0.9) & (score <= own)
    assert all(open_[at[r], w] for r, w in zip(*np.nonzero(hit), strict=True))
    assert open_.mean() < 0.2
