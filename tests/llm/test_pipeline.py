"""Each pipeline stage on sf0.001 against a brute-force version of its own input."""

import corpus_pipeline as P
from gleaner.llm import lines, quality
from gleaner.llm.common import materialize
from gleaner.sources.tables import table
from tests.conftest import SF_SMALL
from tests.llm.test_operators import LOWER, brute_components, brute_contamination, words


def one_edit(a, b):
    """What is left of two lines without their common start and end is a word at most."""
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return len(a) - i - j <= 1 and len(b) - i - j <= 1


def kept_lines(rows):
    seen, known, out = [], set(), {}
    for i, t in sorted(rows):
        kept = []
        for line in t.split("\n"):
            w = words(line.translate(LOWER))
            if w and (tuple(w) in known or len(w) >= lines.NEAR_WORDS and any(abs(len(x) - len(w)) < 2 and one_edit(x, w) for x in seen)):
                gone = True
            else:
                gone = False
                kept.append(line)
            if w and tuple(w) not in known:
                known.add(tuple(w))
                if len(w) >= lines.NEAR_WORDS:
                    seen.append(w)
        out[i] = "\n".join(kept)
    return out


def test_stages(spark):
    assert [name for name, _ in P.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "mixing sources"]
    docs = table(spark, SF_SMALL, "documents")
    steps = [docs]
    for name, stage in P.STAGES:
        steps.append(materialize(stage(spark, steps[-1], SF_SMALL), "stage"))
        assert steps[-1].columns[:5] == docs.columns
    assert all(s.columns == docs.columns for s in steps[:-1])
    rows = [{r.doc_id: r for r in s.collect()} for s in steps]
    scores = {r.doc_id: r.score for r in quality.classify(docs, table(spark, SF_SMALL, "labels")).collect()}
    assert set(rows[1]) == {i for i, s in scores.items() if s >= 0.3} and all(rows[0][i] == r for i, r in rows[1].items())
    want = kept_lines([(i, r.text) for i, r in rows[1].items()])
    assert {i: r.text for i, r in rows[2].items()} == want and all(r.n_chars == len(r.text) for r in rows[2].values())
    groups = brute_components([(i, r.text) for i, r in rows[2].items()])
    assert set(rows[3]) == {c for _, _, c in groups} and all(rows[2][i] == r for i, r in rows[3].items())
    items = [(r.item_id, r.text) for r in table(spark, SF_SMALL, "benchmark").collect()]
    bad = {r[0] for r in brute_contamination([(i, r.text) for i, r in rows[3].items()], items) if r[5]}
    assert set(rows[4]) == set(rows[3]) - bad
    assert {i: tuple(r)[:5] for i, r in rows[5].items()} == {i: tuple(r) for i, r in rows[4].items()}
    assert all(r.release <= r.slot < r.deadline for r in rows[5].values())


def test_stages_on_edge_rows_and_on_none(spark, edge, empty):
    """Nulls, empty and very long texts, equal ids and rows go through every stage; an empty table stays empty."""
    for docs, n in ((edge, edge.count()), (empty, 0)):
        for name, stage in P.STAGES:
            out = materialize(stage(spark, docs, SF_SMALL), "stage")
            left = out.count()
            assert out.columns[:5] == list(P.COLUMNS) and left <= n, name
            if name in ("line dedup", "mixing sources"):  # these keep every row
                assert left == n, name
            docs, n = out.select(*P.COLUMNS), left
