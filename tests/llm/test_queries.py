"""The registered queries on the smallest tables, SQL where there is some, and the pipeline against its stages."""

import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from airledger.llm.queries import ORACLE_SQL, QUERIES

sys.path.insert(0, str(Path(__file__).parent))
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SF)
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(ORACLE_SQL[name])
    order = [[d[0] for d in want.description].index(x) for x in got.columns]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("op4_warc", "op9_packing", "op11_centroids", "op12_chat", "op13_prefix_trie")])
def test_one_row_for_each_document(spark, name):
    ids = [r.doc_id for r in QUERIES[name](spark, SF).select("doc_id").collect()]
    assert sorted(ids) == list(range(200))


def rows_of(docs):
    return {r.doc_id: r for r in docs.collect()}


def test_pipeline_equals_a_plain_version(spark):
    """run() against stages written without Spark where they can be, each on what the stage before has kept."""
    from tokenizers import Tokenizer

    from airledger.llm import language, packing, pii, spotsigs
    from airledger.llm.common import remainder
    from test_operators import plain_contamination

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    text = {r.doc_id: r.text for r in docs.collect()}
    kernel = language._kernel(language.learn(docs, remainder("doc_id", 4) != 2))
    known = dict(zip(text, kernel([t or "" for t in text.values()])["lang_pred"], strict=True))
    text = {i: t for i, t in text.items() if known[i] != "und"}

    # Near copies by all pairs: fingerprints of five-word shingles, and signature sets.
    words = {i: spotsigs.words((t or "").encode()) for i, t in text.items()}
    fps = {i: plain_fingerprint(w) for i, w in words.items()}
    hashes = spotsigs.word_hashes()
    signs = {i: frozenset(spotsigs.hashed(w, hashes).tolist()) for i, w in words.items()}
    root = {i: i for i in text}
    near = [(a, b) for a in text for b in text if a < b and ((fps[a] ^ fps[b]).bit_count() <= 2 or (min(len(signs[a]), len(signs[b])) >= 10 and len(signs[a] & signs[b]) >= corpus_pipeline.LIKENESS * len(signs[a] | signs[b])))]
    for _ in text:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    text = {i: t for i, t in text.items() if root[i] == i}

    for i in list(text):
        n_words, n_hit, _ = plain_contamination(text[i], bench)
        if n_hit and 20 * n_hit >= n_words:
            del text[i]
    made = spark.createDataFrame([r for i, r in rows_of(docs).items() if i in text], docs.schema)
    field = pii.learn(made)
    text = {i: pii.mask(t, pii.find(t, field)[1]) for i, t in text.items()}
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in text.items()}
    whole: dict = {}
    for p in corpus_pipeline.run(spark, SF).collect():
        whole.setdefault(p.doc_id, []).append((p.start, bytes(p.ids)))
    got = {i: np.frombuffer(b"".join(x for _, x in sorted(own)), "<u4").tolist() for i, own in whole.items()}
    assert got == ids


def plain_fingerprint(words):
    joined = [b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in joined]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


ODD = [(1, "The river and the stone. " * 9, "en", "s", 225), (1, "The river and the stone. " * 9, "en", "s", 225), (2, None, None, None, None), (None, "no name but words", "en", "s", 17), (3, "", "en", "s", 0), (4, "12 34", "en", "s", 5), (5, "x" * 200_000 + " mail a.b@c.de", "en", "s", 200_014)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, name):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame(ODD, schema)
    got = [(r.doc_id, r["text"] if "text" in r else None) for r in stage(spark, docs, SF).collect()]
    ids = sorted({str(i) for i, _ in got})
    want = {"language": ["1", "5", "None"], "near_duplicates": ["1", "2", "4", "5", "None"], "decontamination": ["1", "2", "3", "4", "5", "None"], "personal_data": ["1", "2", "3", "4", "5", "None"], "packing": ["1", "2", "3", "4", "5", "None"]}
    assert ids == want[name]
    if name == "personal_data":
        assert len(got) == len(ODD) and dict(got)[5] == "x" * 200_000 + " mail [EMAIL]"
    assert stage(spark, docs.where("false"), SF).count() == 0
    more = docs.withColumns({c: F.lit("x") for c in ("fp", "spans", "__masked", "lang_pred", "d_text", "items")})
    made = stage(spark, more, SF)
    assert made.count() == len(got) and (name == "packing" or made.columns == more.columns)


def test_stages_match_queries(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    component = {r.doc_id: r.component_id for r in QUERIES["op8_simhash"](spark, SF).collect()}
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    exact = {min(i for i in component if component[i] == c) for c in component.values()}
    assert kept < exact  # near copies that differ in more bits go too
    bad = {r.doc_id for r in QUERIES["op3_decontamination"](spark, SF).collect() if r.contaminated}
    assert {r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, SF).collect()} == set(range(200)) - bad
