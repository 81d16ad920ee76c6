import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("catalogops.llm.queries")
import public_tokenizers  # noqa: E402

import corpus_pipeline  # noqa: E402
from catalogops.llm import bpe, language_id, line_dedup, mixing  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(5)
    words = {"en": "the of and thing onsh wave".split(), "de": "der die und ung schein welle".split()}
    make = lambda lang, n=40: " ".join(rng.choice(words[lang]) + str(rng.randrange(60)) for _ in range(n))
    rows = [(i, make("de" if i % 2 else "en"), "de" if i % 2 else "en", f"s{min(i % 5, 2)}") for i in range(80)]
    rows = [(i, t + "\nCommon line\nown " + str(i) if i < 14 else t, lang, s) for i, t, lang, s in rows]
    rows += [(100 + i, rows[20 + i][1] + " edited", "en", "s1") for i in range(6)]
    rows += [rows[30]] * 3 + [(31, rows[32][1] + " edited", "en", "s0"), (33, make("en"), "en", "s9")]
    rows += [(None, rows[40][1], "en", "s0"), (None, make("de"), "de", None), (201, None, "en", "s0"), (202, "", "de", "s1"), (203, " \t", "en", "s0"), (204, "123 !?", "en", "s0")]
    rows += [(205, "Common line", "en", "s1"), (205, "Common line", "en", "s1"), (206, "x", None, "s0")]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def language(rows, net):
    """Rows with a letter whose windows, weighted by length, speak for one language with the least score."""
    out = []
    for r in rows:
        if not any(map(str.isalpha, r[1] or "")):
            continue
        windows = language_id.byte_windows([r[1].encode()])
        z = np.average(net.logits(net.pooled(windows, net.tables())), axis=0, weights=(windows > 0).sum(1))
        if np.exp(z - z.max()).max() / np.exp(z - z.max()).sum() >= language_id.MIN_SCORE:
            out.append(r)
    return out


def lines(rows):
    cut = [(r[1] or "").split("\n") for r in rows]
    docs = Counter(k for ls in cut for k in {line_dedup.line_key(x) for x in ls})
    texts = ["\n".join(x for x in ls if not line_dedup.line_key(x) or docs[line_dedup.line_key(x)] < 10) for ls in cut]
    return [(r[0], t, r[2], r[3], len(t)) for r, t in zip(rows, texts)]


def near(rows):
    """Pairs of all rows; of each component the first by id, and rows without words and null ids that no id reaches."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1].lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    return [r for i, r in enumerate(rows) if root[i] == i]


def mixed(rows):
    size = Counter(r[3] for r in rows)
    total, out = sum(map(math.sqrt, size.values())), []
    for r in rows:
        rate = math.sqrt(size[r[3]]) / total * len(rows) / size[r[3]]
        parts, n = max(1, math.ceil(rate / mixing.PART_RATE)), 0
        for j in range(1, 1 + parts):
            name = "null" if r[0] is None else r[0]
            u = int(hashlib.md5(f"{name}:{mixing.SEED}:{j}".encode()).hexdigest()[:13], 16) / (1 << 52)
            k, p = 0, math.exp(-rate / parts)
            s = p
            while s <= u:
                k, n = k + 1, n + 1
                p *= rate / parts / k
                s += p
        out += [r] * n
    return out


def encoded(rows):
    library = bpe.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [(r[0], r[3], tuple(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows]


def test_stages_match_brute_force(spark, sf_dir, monkeypatch):
    """Each stage on the rows that run() gives it."""
    seen, nets, train = [], [], language_id.train

    def kept(docs, *args, **named):
        nets.append(train(docs, *args, **named))
        return nets[-1]

    def watched(name, stage):
        def run(spark, docs, sf_dir):
            seen.append((name, sorted(map(tuple, docs.select(*COLUMNS).collect()), key=repr)))
            return stage(spark, docs, sf_dir)

        return name, run

    monkeypatch.setattr(language_id, "train", kept)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(*s) for s in corpus_pipeline.STAGES])
    last = corpus_pipeline.run(spark, sf_dir).collect()
    stages = {"language_id": lambda rows: language(rows, nets[0]), "line_dedup": lines, "near_duplicates": near, "mixing": mixed, "bpe": encoded}
    assert [name for name, _ in seen] == list(stages)
    results = [rows for _, rows in seen[1:]] + [sorted(((r.doc_id, r.source, tuple(bpe.unpack(r.ids))) for r in last), key=repr)]
    for (name, rows), got in zip(seen, results):
        assert got == sorted(stages[name](rows), key=repr), name
    assert all(r.n_tokens == len(bpe.unpack(r.ids)) for r in last)
    assert len(seen[3][1]) < len(seen[2][1]) and Counter(r[0] for r in seen[2][1])[30] == 4 and Counter(r[0] for r in seen[3][1])[30] == 1
