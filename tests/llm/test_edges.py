"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing columns, over all operators and stages."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigevents.llm import binary_tokens, decontamination, jaccard, language_id, language_model, main_text, mixing, neighbours, toxicity, url_filter

LONG = " ".join(f"word{i % 977} und der" for i in range(60_000))
ROWS = [(None, None, None, None), (1, None, "en", "src1"), (2, "", None, "src2"), (3, LONG, "de", None), (3, LONG, "de", None), (4, "the same text of six words", "en", "src1"), (5, "the same text of six words", "en", "src1"), (6, "\t\n \r", "en", "x"), (None, "the same text of six words", "en", "src1"), (7, "½ ② Ⅷ ١٢", "en", "src3"), (8, "Ünï CÖDE 日本 語", "fr", "src9")]
CLASH = ["_row", "_path", "_at", "_file", "_whole", "ids", "learn", "word", "n", "held_out", "score", "lang_pred", "rejected", "_toxic", "pos", "neg", "node", "component", "bin", "key", "domain", "epochs", "epoch", "copies", "last_key", "share", "whole", "host", "path", "part", "guest", "place", "sum", "band", "shard", "rank", "base", "items", "spans"]


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(3)).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return clashing(spark.createDataFrame([(4, 1), (5, 0), (5, 0), (None, 1), (3, None)], "doc_id long, toxic int"))


@pytest.fixture(scope="module")
def benchmark(spark):
    return clashing(spark.createDataFrame([(1, None), (2, "same text"), (2, "same text"), (None, "the"), (3, ""), (4, LONG[-90:])], "item_id long, text string"))


def document_operators(labels, benchmark):
    return {
        "op1": lambda d: mixing.mixture_table(d, budget_share=1.0, max_epochs=1),
        "op2": lambda d: language_model.score_documents(d, steps=2),
        "op3": jaccard.near_duplicates,
        "op6": language_id.language_table,
        "op7": lambda d: decontamination.contamination_report(d, benchmark),
        "op8": lambda d: toxicity.toxicity_table(d, labels),
        "op10": binary_tokens.token_table,
    }


def test_documents(docs, labels, benchmark):
    got = {}
    for name, f in document_operators(labels, benchmark).items():
        found = f(docs)
        got[name] = found.collect()
        assert name == "op1" or Counter(r.doc_id for r in got[name]) == Counter(r[0] for r in ROWS), name
        assert f(docs.limit(0)).count() == 0, name
        if name not in ("op10",):  # repeated rows have one result, but for their place in a file
            assert len({tuple(float(f"{v:.5g}") if isinstance(v, float) else v for v in r) for r in got[name] if r.doc_id == 3}) == 1, name
    by = {n: {r.doc_id: r for r in rows} for n, rows in got.items()}
    assert by["op3"][5].component_id == by["op3"][4].component_id == 4 and by["op3"][1].n_shingles == by["op3"][6].n_shingles == 0
    assert {by["op6"][k].lang_pred for k in (1, 2, 6, 7)} == {"und"} and by["op6"][8].lang_pred != "und"
    assert by["op7"][4].contaminated and by["op7"][3].contaminated and not by["op7"][8].contaminated and by["op7"][1].n_words == 0
    assert by["op2"][1].n_tokens == by["op2"][2].n_tokens == by["op2"][6].n_tokens == 1
    assert by["op10"][1].n_tokens == by["op10"][2].n_tokens == 1
    assert all(0 <= r.score <= 1 for r in got["op8"])
    taken = Counter(r.doc_id for r in got["op1"])
    assert taken[3] == 2 and taken[4] == 1


def test_empty_side_tables(docs, labels, benchmark):
    """Nothing is contaminated by an empty benchmark; without labels all texts score alike; repeated rows have the same ids in a token file."""
    found = decontamination.contamination_report(docs, benchmark.limit(0)).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in ROWS)
    assert {(r.n_hit, r.n_items, r.contaminated) for r in found} == {(0, 0, False)}
    found = toxicity.toxicity_table(docs, labels.limit(0)).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in ROWS)
    assert len({r.score for r in found}) == 1 and 0 <= found[0].score <= 1
    same = [r for r in binary_tokens.token_table(docs).collect() if r.doc_id == 3]
    assert len(same) > 1 and len({(r.n_tokens, r.ids_crc32) for r in same}) == 1 and len({r.start for r in same}) == len(same)


def test_string_item_ids(spark, docs):
    items = spark.createDataFrame([("q-1", "same text"), ("q-2", "nowhere")], "item_id string, text string")
    got = {r.doc_id: r["items"] for r in decontamination.contamination(docs, items).collect()}
    assert got[4] == ["q-1"] and got[8] == []


def test_stages(spark, docs, benchmark, tmp_path):
    import corpus_pipeline

    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, str(tmp_path))
            rows = out.collect()
            if name == corpus_pipeline.STAGES[-1][0]:
                assert len(rows) == given.count()
            else:
                assert out.columns == docs.columns and len(rows) <= 3 * len(ROWS), name  # mixing takes a row in three epochs at most
            if given is not docs:
                assert rows == []
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, docs, str(tmp_path)).collect())
    assert kept == Counter({r[:2]: 1 for r in ROWS if r[0] not in (5,) and not (r[0] is None and r[1])})
    kept = {r.doc_id for r in corpus_pipeline.known_languages(spark, docs, str(tmp_path)).collect()}
    assert not kept & {1, 2, 6, 7}


def test_pages(spark):
    html = "<body><p>Same</p><p>Text</p></body>"
    rows = [(None, None, None), (1, "http://a.com/x", None), (2, "http://a.com/y", ""), (3, "http://a.com/z", html), (3, "http://a.com/z", html), (4, None, html), (5, "no scheme", "<article>" + "<p>a &amp; b</p>" * 50_000 + "</article>"), (6, "http://" + "ab" * 40_000 + ".org/" + "c" * 50_000, "<a \"" * 20_000)]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2))
    got = defaultdict(list)
    for r in main_text.extract(pages).collect():
        got[r.page_id].append(r)
    assert Counter(r[0] for r in rows) == Counter({k: len(v) for k, v in got.items()})
    assert [r.text for r in got[3]] == ["Same\n\nText"] * 2 and got[4][0].text == "Same\n\nText" and got[1][0].text == got[2][0].text == ""
    assert got[5][0].n_chars == 50_000 * 7 - 2 and all(r.n_chars == len(r.text) for v in got.values() for r in v)
    judged = url_filter.judge(pages).collect()
    assert Counter(r.page_id for r in judged) == Counter(r[0] for r in rows) and {r.verdict for r in judged} <= {"allow", "block"}
    for f in (main_text.extract, url_filter.judge):
        assert f(pages.limit(0)).count() == 0


def test_vectors(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 8))
    x[7] *= 1e6
    x[9] *= 1e-9
    x[11, 0] = 1e200
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (20, x[20].tolist()), (500, None), (520, [0.0] * 8), (540, [None] * 8), (560, [float("inf")] * 8), (580, []), (600, [1.0])]
    got = defaultdict(list)
    table = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    for q in neighbours.nearest(table, k=20).orderBy("query_id", "rank").collect():
        got[q.query_id].append((q.vec_id, q.score))
    assert set(got) == set(range(0, 400, 20))
    hits = 0
    with np.errstate(over="ignore"):
        for q, found in got.items():
            if q == 20:  # two rows of one id ask, and are one query
                continue
            s = x @ x[q]
            best = [int(i) for i in np.lexsort((np.arange(400), -s)) if i != q]
            assert [v for _, v in found] == sorted((v for _, v in found), reverse=True)
            hits += len({i for i, _ in found} & set(best[:20]))
    assert hits / (20 * (len(got) - 1)) > 0.95
    assert neighbours.nearest(table.limit(0)).count() == 0
