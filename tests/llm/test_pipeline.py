"""The pipeline's stages against plain versions, and the driver's contract."""

import collections

import pytest

import __spark_entry__ as E
import corpus_pipeline as P
from qforge.llm.common import Scratch
from qforge.llm.queries import REGISTRY, SQL


@pytest.fixture(scope="module")
def stages(spark):
    from tests.conftest import SF001
    scratch = Scratch(spark, "pipeline_test")
    out = [spark.read.parquet(f"{SF001}/documents.parquet")]
    for name, stage in P.STAGES:
        out.append(scratch.keep(stage(spark, out[-1], SF001), name))
    return out


def rows(df):
    return collections.Counter(map(tuple, df.collect()))


def test_columns_and_order(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "mixing", "bpe_encode_decode"]


def test_toxicity_keeps_whole_rows(spark, stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert after - before == collections.Counter() and 0 < sum(after.values()) < sum(before.values())


def test_line_stage(stages):
    voices, sites = {}, collections.defaultdict(set)
    for r in stages[1].collect():
        if r.text is not None:
            site = "null" if r.source is None else "s" + r.source
            voices[r.text] = min(voices.get(r.text, site), site)
    for text, site in voices.items():
        for line in text.split("\n"):
            sites[line.strip(" \t\r")].add(site)
    bad = {line for line, s in sites.items() if line and len(s) >= 10}
    want = collections.Counter()
    for r in stages[1].collect():
        text = r.text if r.text is None else "\n".join(x for x in r.text.split("\n") if x.strip(" \t\r") not in bad)
        want[r.doc_id, text, r.lang, r.source, len(text) if text is not None else None] += 1
    assert rows(stages[2]) == want


def test_line_stage_with_few_sources_and_a_hot_one(spark):
    # five sources, one of them with most rows: 3 sites make a line boilerplate, 2 don't, however often it stands there
    texts = [("hot", f"own {i}\nonly here\nfooter") for i in range(60)]
    texts += [(f"s{i % 4}", f"page {i}\nfooter" + ("\nhalf" if i % 4 < 3 else "") + ("\nonly here" if i % 4 == 0 else "")) for i in range(12)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, (s, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in P.drop_lines(spark, docs, "").collect()}
    assert got == {i: "\n".join(x for x in t.split("\n") if x not in ("footer", "half")) for i, (_, t) in enumerate(texts)}


def test_near_duplicate_stage(stages):
    from tests.llm.test_pair_ops import groups, shingle_texts
    docs = stages[2].collect()
    sets = [shingle_texts(r.text, 5) for r in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = groups(range(len(docs)), links)
    best = {}
    for i, r in enumerate(docs):
        if sets[i]:
            best[root[i]] = min(best.get(root[i], r.doc_id), r.doc_id)
    kept = sorted(r.doc_id for r in stages[3].collect())
    assert kept == sorted([*best.values(), *(r.doc_id for i, r in enumerate(docs) if not sets[i])])


def test_mixing_and_encoding_stages(stages):
    from qforge.llm import mixing
    copies = {r.doc_id: r.copies for r in mixing.mix(stages[3]).collect()}
    got = collections.Counter(r.doc_id for r in stages[4].collect())
    assert got == collections.Counter({d: c for d, c in copies.items() if c})
    last = stages[5].collect()
    assert collections.Counter(r.doc_id for r in last) == got
    assert all(r.n_tokens == len(r.ids.split()) for r in last)


def test_contract():
    names = set(E.queries())
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in REGISTRY}
    assert set(REGISTRY) | {"pipeline"} <= names
    assert set(SQL) <= set(REGISTRY) and set(SQL) <= set(E.oracle_sql())


def test_odd_tables_through_all_stages(spark):
    """Null ids, texts and sources, empty and long texts, repeated rows and an
    extra column: nothing crashes, and every row without a text passes the filters."""
    from tests.conftest import SF001
    rows = [(None, "some words stand here", "en", "a", 21, "x"), (1, None, "en", "a", None, "x"), (2, "", None, None, 0, "x"),
            (3, "one two three four five six seven", "en", "a", 33, "x"), (3, "one two three four five six seven", "en", "a", 33, "x"),
            (4, "long " * 20000, "en", "b", 100000, "x"), (5, None, None, None, None, None), (6, " \n\t\n", "en", "b", 4, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string"
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        scratch, docs = Scratch(spark, "pipeline_odd"), frame
        for name, stage in P.STAGES:
            out = scratch.keep(stage(spark, docs, SF001), name)
            if name != "bpe_encode_decode":
                assert out.columns == frame.columns
            if name == "ngram_jaccard_join" and frame.count():
                left = out.collect()
                assert sorted(r.doc_id for r in left if r.doc_id is not None) == [1, 2, 3, 4, 5, 6]
                assert sum(r.doc_id is None for r in left) == 1
            docs = out
        assert docs.columns[:3] == ["doc_id", "source", "n_tokens"]
        if not frame.count():
            assert docs.count() == 0
