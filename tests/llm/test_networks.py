import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("catalogops.llm.queries")

from catalogops.llm import bpe, exact_dedup, jaccard_join, language_id, line_dedup, spotsigs  # noqa: E402


def network(seed=1):
    net = language_id.ByteCnn(["a", "b", "c"], seed)
    net.embed, net.bias, net.out, net.out_bias = (x.astype(np.float64) for x in (net.embed, net.bias, net.out, net.out_bias))
    net.filters = {w: f.astype(np.float64) for w, f in net.filters.items()}
    return net


def pooled(net, window):
    """Filters laid over the window one place at a time."""
    out = []
    for w in language_id.WIDTHS:
        for f in range(language_id.FILTERS):
            sums = [sum(net.embed[window[at + j]] @ net.filters[w][j][:, f] for j in range(w)) for at in range(len(window) - w + 1)]
            out.append(max(sums))
    return np.array(out) + net.bias


def windows(n, seed=2):
    return np.random.default_rng(seed).integers(1, 256, (n, language_id.WINDOW)).astype(np.uint8)


def test_convolution_is_that_of_loops():
    net, some = network(), windows(3)
    got = net.pooled(some, net.tables())
    assert np.allclose(got, [pooled(net, w) for w in some])
    short = some[:1].copy()
    short[0, 20:] = 0
    assert np.allclose(net.pooled(short, net.tables())[0], pooled(net, short[0, :20]))


def test_gradients_are_those_of_finite_differences():
    net, some, labels = network(), windows(4), np.array([0, 1, 2, 1])

    def loss():
        logits = net.logits(net.pooled(some, net.tables()))
        return -np.log(language_id._softmax(logits)[np.arange(len(labels)), labels]).mean()

    params = [net.embed, *net.filters.values(), net.bias, net.out, net.out_bias]
    rng = np.random.default_rng(3)
    for p, g in zip(params, net._gradients(some, labels), strict=True):
        for _ in range(25):
            at = tuple(rng.integers(n) for n in p.shape)
            was, step = p[at], 1e-6
            p[at] = was + step
            up = loss()
            p[at] = was - step
            down = loss()
            p[at] = was
            assert abs((up - down) / (2 * step) - g[at]) < 1e-5


def test_empty_tables_of_the_other_operators(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, ids binary")
    assert language_id.identify(empty, None).count() == language_id.accepted(empty, None).count() == 0
    assert jaccard_join.one_of_each(empty.select("doc_id", "text")).count() == bpe.decode(empty, __import__("public_tokenizers").path("word_bpe_49k.json")).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(1, "same text\nline"), (1, "same text\nline"), (1, "other"), (None, "same text\nline"), (None, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect())
    assert sorted(g[1:3] for g in got) == sorted([("1", 3)] * 3 + [("1", 1)] + [("2", 2)] * 2) and sum(g[3] for g in got) == 3
    lines = line_dedup.dedup_lines(docs, min_docs=3).collect()
    assert sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in lines if r.text is not None) == sorted([("1", "", 2, 2)] * 2 + [("None", "", 2, 2), ("1", "other", 1, 0), ("2", "", 1, 0)])
    prints = spotsigs.neighbour_fingerprints(docs)
    assert prints.count() == len(rows) and prints.where(F.col("n_chars") == 14).select("fingerprint").distinct().count() == 1
