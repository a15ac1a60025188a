"""The registered queries of this subpackage on a small table: columns, types and values that their contracts fix."""

from __future__ import annotations

import hashlib
import os
import re
import zlib

import duckdb
import pandas as pd
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from mediamill.llm import queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
SCHEMAS = {
    "op1_warc_revisits": {"record_id": "bigint", "refers_to": "bigint", "verdict": "string", "headers": "string"},
    "op2_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_embedding_near_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op4_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op5_license_scan": {"doc_id": "bigint", "digest": "string", "license_id": "string", "notices": "string"},
    "op6_minhash_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op7_bpe_round_trip": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op8_html_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op9_secret_scan": {"doc_id": "bigint", "n_candidates": "bigint", "n_secrets": "bigint", "spans": "string", "top_score": "double"},
    "op10_benchmark_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op11_source_divergence": {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"},
    "op12_conversation_repair": {"conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string"},
    "op13_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
}


@pytest.fixture(scope="module")
def results(spark):
    made = {}

    def of(name):
        if name not in made:
            df = queries.queries()[name](spark, DIR)
            made[name] = dict(df.dtypes), df.toPandas()
        return made[name]

    return of


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{DIR}/documents.parquet")


def test_all_are_registered():
    assert set(queries.queries()) == set(SCHEMAS)


@pytest.mark.parametrize("name", SCHEMAS)
def test_columns_types_and_rows(results, docs, name):
    types, rows = results(name)
    assert types == SCHEMAS[name]
    if name == "op12_conversation_repair":
        assert sorted(rows.conv_id) == sorted(set(pd.read_parquet(f"{DIR}/conversations.parquet").conv_id))
    elif name not in ("op1_warc_revisits", "op11_source_divergence"):
        table, column = {"op3": ("embeddings", "vec_id"), "op8": ("pages", "page_id")}.get(name.split("_")[0], ("documents", "doc_id"))
        assert sorted(rows[column]) == sorted(pd.read_parquet(f"{DIR}/{table}.parquet")[column])


def test_held_out_and_scores(results):
    for name, modulus, rest in (("op2_toxicity", 4, 2), ("op4_language_id", 3, 1)):
        rows = results(name)[1]
        assert (rows.held_out == [zlib.crc32(str(i).encode()) % modulus == rest for i in rows.doc_id]).all() and rows.score.between(0, 1).all()
    rows = results("op2_toxicity")[1]
    assert (rows.predicted == (rows.score >= 0.3).astype(int)).all()


def test_ids_and_decoded_text(results, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation(), library.no_padding()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in results("op7_bpe_round_trip")[1].itertuples()}
    for i, text in zip(docs.doc_id, docs.text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        digests = [hashlib.sha256(x).hexdigest() for x in (b"".join(n.to_bytes(4, "little") for n in ids), library.decode(ids, skip_special_tokens=False).encode())]
        assert got[i] == (len(ids), *digests)


def test_windows_by_brute_force(results, docs):
    low = {c: c + 32 for c in range(65, 91)}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    owners = {}
    for item, text in pd.read_parquet(f"{DIR}/benchmark.parquet")[["item_id", "text"]].itertuples(index=False):
        w = words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            owners.setdefault(tuple(w[k : k + 10]), set()).add(str(item))
    lengths = sorted({len(k) for k in owners})
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in results("op10_benchmark_decontamination")[1].itertuples()}
    for i, text in zip(docs.doc_id, docs.text):
        w, hit, items = words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (own := owners.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    items |= own
        assert got[i] == (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))


def test_token_counts(results, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in results("op13_token_counts")[1].itertuples()}
    for i, text in zip(docs.doc_id, docs.text):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert got[i] == (len((text or "").encode()), n, n > 1024)


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_equals_its_sql(results, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.execute(f"create view {table} as select * from '{DIR}/{table}.parquet'")
    rows, want = results(name)[1], con.sql(queries.oracle_sql()[name]).df()
    assert sorted(rows.columns) == sorted(want.columns)
    columns = sorted(rows.columns)
    as_text = lambda df: sorted(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).astype(str).values.tolist()))
    assert as_text(rows) == as_text(want.astype(rows.dtypes.to_dict(), errors="ignore"))


def test_spans_of_secrets(results, docs):
    texts = dict(zip(docs.doc_id, docs.text))
    for r in results("op9_secret_scan")[1].itertuples():
        spans = [tuple(map(int, s.split("-"))) for s in r.spans.split(",") if s]
        assert len(spans) == r.n_secrets <= r.n_candidates and all(0 <= a < b <= len(texts[r.doc_id]) for a, b in spans)


def test_links_keep_the_least_id(results):
    for name, own in (("op3_embedding_near_dedup", "vec_id"), ("op6_minhash_near_dedup", "doc_id")):
        rows = results(name)[1]
        assert (rows.kept == (rows[own] == rows.component_id)).all() and (rows.groupby("component_id")[own].min() == sorted(set(rows.component_id))).all()


def test_n_chars_of_pages(results):
    rows = results("op8_html_extraction")[1]
    assert (rows.n_chars == rows.text.str.len()).all()
