"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from rillmark.llm.queries import QUERIES

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}
LONG = "alpha beta gamma delta " * 20_000
PHRASE = " ".join(f"bench{k}" for k in range(20))
ODD = {
    "documents": [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, LONG, "en", None, 1), (4, "x y", "en", "b", 3), (4, "x y", "en", "b", 3), (5, "x y", "en", "b", 3), (6, f"before {PHRASE} after", None, "b", 1), (7, f"before {PHRASE} after", "en", "b", 1), (8, " \t\n", "en", "c", 3), (None, "Éa 　b ", "en", "c", 3)],
    "embeddings": [(None, [1.0, 0.0], 1), (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (6, [1.0, None], 1), (7, [1.0, 1.0], None), (8, [1.0, 0.5], 1), (9, [1.0, 0.5], 1), (9, [1.0, 0.5], 1), (10, [1.0, 0.5, 0.0], 1), (11, [1.0, 0.5], 2)],
    "pages": [(None, None, None), (1, "http://h/a", ""), (2, None, "<p>x"), (3, "http://h/a", "<p>x"), (3, "http://h/a", "<p>x"), (4, "http://h/b", "<article>" + "<p>word word</p>" * 5000 + "</article>"), (5, "not a url", "<<<>>&&"), (None, "http://h/c", "<p>y")],
    "benchmark": [(None, PHRASE), (1, None), (2, ""), (3, "x y"), (4, PHRASE), (4, PHRASE), (5, "..")],
    "labels": [(None, 1, 0), (1, None, None), (2, 0, 0), (2, 1, 0), (3, 1, 0), (4, 0, 1), (6, 1, 0), (7, 0, 0), (8, 1, 0)],
    "conversations": [(None, None, None, None), (1, 1, "user", "a"), (1, 2, None, ""), (2, 1, "user", "a"), (3, 1, "user", "a"), (3, 2, None, None), (4, 1, "user", "a"), (4, 1, "user", "a"), (5, None, "user", "a"), (6, 1, "user", "long " * 50_000)],
}
PER_ROW = {"op1_pii_pseudonyms": "documents", "op2_byte_shards": "documents", "op4_main_text": "pages", "op5_warc_round_trip": "pages", "op6_decontaminate": "documents", "op7_near_vectors": "embeddings", "op8_quality": "documents", "op9_mix_sources": "documents", "op10_near_dedup": "documents"}
CLASHING = ["size", "shard", "rank", "before", "score", "predicted", "spans", "items", "n_words", "n_replaced", "part", "node", "component", "host", "noise", "k", "s1", "_tie", "_row", "_part", "_size", "_source", "_copy"]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    made = {}
    for kind in ("odd", "empty", "extra"):
        made[kind] = str(tmp_path_factory.mktemp(kind))
        for name, schema in SCHEMAS.items():
            df = spark.createDataFrame([] if kind == "empty" else ODD[name], schema)
            if kind == "extra":
                df = df.select("*", *[F.lit("clash").alias(c) for c in CLASHING])
            df.write.parquet(f"{made[kind]}/{name}.parquet")
    return made


@pytest.mark.parametrize("kind", ["odd", "empty", "extra"])
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_tables(spark, folders, name, kind):
    rows = QUERIES[name](spark, folders[kind]).collect()
    if name in PER_ROW:
        assert len(rows) == (0 if kind == "empty" else len(ODD[PER_ROW[name]]))
    if kind == "empty":
        assert rows == []


@pytest.mark.parametrize("kind", ["odd", "empty", "extra"])
def test_odd_pipeline(spark, folders, kind):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folders[kind]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folders[kind])
        assert out.columns == docs.columns, name
        if kind == "extra":
            assert all(r[c] == "clash" for r in out.collect() for c in CLASHING), name
        docs = out
    corpus_pipeline.STAGES[-1][1](spark, docs, folders[kind]).collect()


def test_values(spark, folders):
    by = lambda name, key: {r[key]: r for r in QUERIES[name](spark, folders["odd"]).collect()}
    near = by("op10_near_dedup", "doc_id")
    assert near[5].component_id == 4 and near[7].component_id == 6 and near[2].component_id == 2 and near[8].n_shingles == 0 and near[3].kept
    hit = by("op6_decontaminate", "doc_id")
    assert hit[6].n_items == 2 and hit[6].contaminated and hit[4].contaminated and not hit[3].contaminated and hit[1].n_words == 0
    links = by("op7_near_vectors", "vec_id")
    assert links[9].component_id == 8 and links[10].n_links == 0 and links[11].n_links == 0 and links[3].n_links == 0
    pages = QUERIES["op5_warc_round_trip"](spark, folders["odd"]).collect()
    assert sorted((r.page_id or 0, r.record_type) for r in pages if r.page_id in (2, 3)) == [(2, "response"), (3, "revisit"), (3, "revisit")]
    assert [r.refers_to for r in pages if r.page_id == 1] == [None]
    chats = {r.conv_id for r in QUERIES["op3_chat_collapse"](spark, folders["odd"]).collect()}
    assert chats == {None, 1, 3, 4, 6}  # 5 has no turn number but says what 1 begins with
    mix = QUERIES["op9_mix_sources"](spark, folders["odd"]).collect()
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in mix)
