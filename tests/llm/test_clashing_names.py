"""Tables whose columns bear the names that operators use themselves, and lines that most documents have."""

import pytest

pytest.importorskip("catalogops.llm")

from catalogops.llm import jaccard_join, line_dedup, mixing  # noqa: E402

OWN = ["__id", "__tag", "__text", "__key", "__drop", "__times", "__own", "__hash", "__row", "__CHANCE", "___id"]
DDL = "doc_id long, text string, " + ", ".join(f"{c} string" for c in OWN)


def _table(spark, texts):
    return spark.createDataFrame([(i, t, *(f"{c}{i}" for c in OWN)) for i, t in enumerate(texts)], DDL)


def test_clashing_names_pass_through(spark):
    words = " ".join(f"w{i}" for i in range(60))
    docs = _table(spark, [words, words, words + " end", "other text of its own", None, "", *(f"common\nown {i}" for i in range(10))])
    lines = line_dedup.dedup_lines(docs)
    assert lines.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert {r.doc_id: r.text for r in lines.collect()} == {0: words, 1: words, 2: words + " end", 3: "other text of its own", 4: None, 5: "", **{6 + i: f"own {i}" for i in range(10)}}
    one = jaccard_join.one_of_each(docs)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == [0, 3, 4, 5, *range(6, 16)]
    assert all(r[c] == f"{c}{r.doc_id}" for df in (lines, one) for r in df.collect() for c in OWN)


def test_hot_lines_and_rare_ones_are_dropped_alike(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 4)
    texts = ["\n".join(["Hot ", " hot", f"own {i}", f"ten {i // 10}", f"nine {i // 9}"]) for i in range(90)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(_table(spark, texts)).collect()}
    for i in range(90):
        assert got[i].text == f"own {i}\nnine {i // 9}" and (got[i].n_lines, got[i].n_dropped) == (5, 3)


MIX_OWN = ["__source", "__parts", "__sums", "__salt", "__of", "__n", "rate", "n_docs", "weight", "parts"]


@pytest.mark.parametrize("broadcast_sources", [100, 0])
def test_mixing_keeps_columns_of_its_own_names(spark, broadcast_sources):
    rows = [(i if i % 7 else None, f"t{i}", None if i % 5 == 0 else f"s{i % 3}") for i in range(60)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = spark.createDataFrame([(*r, *(f"{c}{r[1]}" for c in MIX_OWN), 9) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in MIX_OWN) + ", Copy int")
    weights = {"s0": 3.0, "s1": 1.0, None: 2.0}
    want = [(r.doc_id, r.text, r.source, r.copy) for r in mixing.mix(plain, weights=weights, broadcast_sources=broadcast_sources).collect()]
    mixed = mixing.mix(docs, weights=weights, broadcast_sources=broadcast_sources)
    assert mixed.columns == [*docs.columns[:-1], "copy", "shuffle_key"]
    got = mixed.collect()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.text, r.source, r["copy"])) for r in got) and len(got) > 20
    assert all(r[c] == f"{c}{r.text}" for r in got for c in MIX_OWN) and {r.source for r in got} <= {"s0", "s1", None}


def test_a_line_of_all_documents_is_counted_map_side(spark, monkeypatch):
    """Batches after the first compaction meet the frequent runs only after their own partial counts."""
    plans = []
    run = line_dedup.LineRuns._run

    def seen(self, rows):
        plans.append((bool(self.frequent), rows._jdf.queryExecution().optimizedPlan().toString()))
        return run(self, rows)

    monkeypatch.setattr(line_dedup.LineRuns, "_run", seen)
    docs = spark.createDataFrame([(i, f"hot\nown {i}") for i in range(80)], "doc_id long, text string")
    assert {r.text for r in line_dedup.dedup_lines(docs).collect()} == {f"own {i}" for i in range(80)}
    later = [p for known, p in plans if known and "Join" in p]
    assert later and all(p.index("Join") < p.index("Aggregate") for p in later)
