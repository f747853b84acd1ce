"""Every registered query opN_ against its contract: columns and types, rows, folds, thresholds and what follows from the texts alone."""

import hashlib
import zlib

import pandas as pd
import pytest

from paperlark.llm import queries

FOLDER = "/root/testdata/sf0.001"
SCORED = {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
CONTRACT = {
    "op1_quality_qda": SCORED,
    "op2_png_media": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string", "hash": "binary"},
    "op3_kneser_ney": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op4_voronoi_top_products": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op5_concatenate_and_cut": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op6_minhash_near_duplicates": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op7_toxicity_nbsvm": SCORED,
    "op8_bpe_round_trip": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op9_minimax_shards": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op10_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op11_warc_chunks": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op12_collocations": {"lang": "string", "phrase": "string"} | dict.fromkeys(("rank", "a", "l", "r", "n", "score"), "bigint"),
    "op13_conversation_repair": {"conv_id": "bigint", "audit": "string", "repaired_sha256": "string"} | dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), "bigint"),
}


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


@pytest.fixture(scope="module")
def texts():
    docs = pd.read_parquet(f"{FOLDER}/documents.parquet")
    return {i: t or "" for i, t in zip(docs.doc_id, docs.text)}


def test_all_are_registered():
    assert set(CONTRACT) == set(queries.QUERIES)


@pytest.mark.parametrize("name", CONTRACT)
def test_contract(spark, texts, name):
    out = queries.QUERIES[name](spark, FOLDER)
    kinds = dict(out.dtypes)
    assert {c: kinds.get(c) for c in CONTRACT[name]} == CONTRACT[name]
    got = out.toPandas()
    if name.startswith("op4"):
        assert (got.query_id % 100 == 0).all() and (got.query_id != got.vec_id).all() and got["rank"].between(1, 10).all()
        return
    if (table := {"op11": "pages", "op12": "documents", "op13": "conversations"}.get(name.split("_")[0])):
        key = got.columns[0]
        if name.startswith("op12"):  # other tests hold it against plain counts
            assert len(got) and (got.score >= 0).all() and (got.a >= 30).all() and all(sorted(g["rank"]) == list(range(1, len(g) + 1)) for _, g in got.groupby("lang"))
        else:
            assert sorted(got[key]) == sorted(set(pd.read_parquet(f"{FOLDER}/{table}.parquet")[key]))
        return
    assert set(got.doc_id) == set(texts)
    if not name.startswith("op5"):
        assert len(got) == len(texts)
    told = got.doc_id.map(texts)
    size = told.map(lambda t: len(t.encode()))
    if "held_out" in got:
        assert (got.held_out == got.doc_id.map(lambda i: fold(i) == (1 if name.startswith("op3") else 0))).all()
    if "predicted" in got:
        assert got.score.between(0, 1).all() and (got.predicted == (got.score >= (0.3 if name.startswith("op1") else 0.5)).astype(int)).all()
    if name.startswith("op2"):
        payload = told.map(lambda t: t.encode() + bytes(-len(t.encode()) % 64 if t else 64))
        assert (got.n_bytes == size).all() and (got.payload_sha256 == payload.map(lambda p: hashlib.sha256(p).hexdigest())).all() and (got.tail_crc32 == payload.map(lambda p: zlib.crc32(p[-64:]))).all()
    if name.startswith("op3"):
        assert (got.n_known <= got.n_tokens).all() and got.train_tokens.nunique() == 1 and got.train_tokens[0] == got[~got.held_out].n_tokens.sum() and (got.score < 0).all()
    if name.startswith("op5"):
        assert got.groupby("doc_id").length.sum().eq(got.groupby("doc_id").doc_tokens.first()).all()
    if name.startswith("op8"):
        assert (got.decoded_sha256.str.len() == 64).all() and (got.ids_sha256.str.len() == 64).all()
    if name.startswith("op9"):
        assert (got["size"] == size + 1).all() and (got.text_crc32 == told.map(lambda t: zlib.crc32(t.encode()))).all() and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
        assert got.shard.between(0, 15).all() and all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard")) and got.groupby(told).shard.nunique().max() == 1
        sums = got.groupby("shard")["size"].sum()
        assert sums.max() <= max(got.groupby(told)["size"].sum().max(), -(-sums.sum() // 16) + got.groupby(told)["size"].sum().max())
    if name.startswith("op10"):
        assert (got.n_bytes == size).all() and (got.over_limit == (got.n_tokens > 4096)).all()
