"""Encoding by a table of distinct words against the tokenizers library; vector codes against a full search and SQL."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, queries, vector_codes
from tessera.llm.shingles import buffers

PATH = public_tokenizers.path("byte_bpe_50k.json")
ATOMS = ["a", "Bc", "é", "×", "ß", " ", "  ", "\n", "\t", "'", "'s", "'ll", "don't", ".", ",", "<|endoftext|>", "<|", "1", "23", "\xa0", "　", "\x1c", "\x85", "日", "я", "💥", "́", "-", "_", "\r\n", '"', "​", "﻿", "½", "ª", "\x00"]
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (None, "a b"), (6, "Ünïcödé ß 💥 \x1c x"), (7, "word " * 30_000), (8, "x" * 50_000), (None, None), (9, "<|endoftext|> it's  <|endoftext|>'s")]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_words_give_the_ids_of_whole_texts(tokenizer):
    rng = random.Random(3)
    texts = ["".join(rng.choices(ATOMS, k=rng.randint(0, 14))) for _ in range(20_000)]
    words = bpe.Words(PATH)
    data, offsets = buffers(pa.array(texts))
    starts, ends = words.bounds(data, offsets)
    raw, at = data.tobytes(), np.searchsorted(starts, offsets)
    ids = words.encode([raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    for k, whole in enumerate(tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert sum(ids[at[k] : at[k + 1]], []) == whole.ids, repr(texts[k])


def test_bpe_is_the_librarys_on_whole_documents(spark, sf, tokenizer):
    out = {r.doc_id: r for r in queries.QUERIES["op11_bpe"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(out) == len(docs)
    for r in docs:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        assert tuple(out[r.doc_id]) == (r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("block_bytes", [1, 20_000, 1 << 30])
def test_bpe_edges(spark, tokenizer, block_bytes):
    docs = spark.createDataFrame([(i, t, 7, "x", 0) for i, t in EDGE], "doc_id long, text string, block long, words string, `a.b` int")
    out = bpe.encode_documents(docs, block_bytes=block_bytes).collect()
    want = sorted((i is None, i or 0, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), t or "") for i, t in EDGE)
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids), r.decoded) for r in out) == want
    assert bpe.encode_documents(docs.limit(0)).count() == 0
    assert bpe.encode_documents(docs.where("doc_id = 2")).collect()[0].ids == b""


def test_a_word_is_in_one_bucket_of_all_blocks_and_comes_back_once(spark):
    docs = spark.createDataFrame([(i, f"the same few words {i % 7}") for i in range(400)], "doc_id long, text string").repartition(4)
    held = bpe.word_blocks(docs, PATH, 16, block_bytes=200).select("block", F.inline("held"))
    unpacked = lambda data: [bytes(v[a:b]) for at, v in [bpe._unpacked(data)] for a, b in zip(at[:-1], at[1:], strict=True)]
    where = {(w, r.bucket) for r in held.collect() for w in unpacked(r.words)}
    assert held.select("block").distinct().count() > 20 and len(where) == len({w for w, _ in where}) == 4 + 7
    out = bpe.encoded_words(held, PATH)
    assert out.count() == held.count()
    places = out.withColumn("p", F.spark_partition_id()).groupBy("bucket").agg(F.countDistinct("p").alias("n"))
    assert places.where("n > 1").isEmpty()


def test_decode_joins_pieces(spark, tokenizer):
    texts = ["Größe 💥 <|endoftext|>", "", None, "a" * 3000]
    ids = [tokenizer.encode(t, add_special_tokens=False).ids if t is not None else None for t in texts]
    cut = tokenizer.encode("💥", add_special_tokens=False).ids[:1]
    rows = [*zip([1, 2, 3, 3], ids, strict=True), (None, cut), (5, [99_999_999]), (6, cut + [64])]
    out = sorted((r.doc_id or 0, r.decoded) for r in bpe.decode_documents(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect())
    want = sorted((i or 0, tokenizer.decode([x for x in ids_ or [] if x < 60_000], skip_special_tokens=False)) for i, ids_ in rows)
    assert out == want


def brute(vectors, parts=4, entries=256, rounds=4):
    """Codes, errors and codebooks in Python's integers, by full searches."""
    x = [[[math.floor(1024 * c) for c in v[p * len(v) // parts : (p + 1) * len(v) // parts]] for p in range(parts)] for _, v in vectors]
    order = sorted(range(len(x)), key=lambda i: (vectors[i][0] is None, vectors[i][0] or 0, x[i]))[:entries]
    books = [[x[i][p] for i in order] for p in range(parts)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            at = [near(v[p], books[p])[1] for v in x]
            for j in set(at):
                own = [v[p] for v, k in zip(x, at, strict=True) if k == j]
                books[p][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [[near(v[p], books[p]) for p in range(parts)] for v in x]
    return ["".join(f"{j:02x}" for _, j in f) for f in found], [sum(d for d, _ in f) for f in found], books


def coded(out):
    return sorted((r.row.vec_id is None, r.row.vec_id or 0, "".join(f"{c:02x}" for c in r.codes), r.error) for r in out.collect())


@pytest.mark.parametrize("scale", [0.01, 1.0, 30_000.0])
def test_codes_are_those_of_full_searches(spark, scale):
    rng = np.random.default_rng(4)
    values = np.r_[rng.normal(size=(40, 8)).repeat(5, 0), rng.integers(-2, 3, (150, 8)), np.zeros((20, 8))] * scale  # repeats and many ties
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(values)) // 2, values, strict=True)] + [(None, [0.5] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    out, books = vector_codes.compress(frame, entries=32)
    codes, errors, want = brute(rows, entries=32)
    assert books.tolist() == want
    assert coded(out) == sorted((i is None, i or 0, c, e) for (i, _), c, e in zip(rows, codes, errors, strict=True))


def test_bounds_spare_searches_and_change_nothing():
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(20, 6)) * 4000).astype(int)[rng.integers(0, 20, 3000)] + rng.integers(-300, 300, (3000, 6))
    books = x[:20].copy()
    known, scans = None, 0
    for step in range(6):
        moved = None if known is None else np.sqrt(((books - before) ** 2).sum(1)) * (1 + 1e-12)
        *known, scanned = vector_codes.assign(x, books, known and tuple(known), moved)
        d = ((x[:, None].astype(object) - books[None]) ** 2).sum(2).astype(float)
        assert (known[0] == d.argmin(1)).all()
        assert (known[1] ** 2 >= d.min(1)).all() and (known[2] <= np.sqrt(np.sort(d, 1)[:, 1])).all()
        scans += scanned.sum() * (step > 0)
        before, books = books, np.array([x[known[0] == j].mean(0) if (known[0] == j).any() else books[j] for j in range(20)]).astype(int)
    assert scans < 0.5 * 5 * len(x)


def test_vector_codes_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0] * 4, 1, "p"), (1, [2.0] * 4, 1, "q"), (2, None, 1, "r"), (3, [1.0, None, 1.0, 1.0], 2, "s"), (4, [nan] * 4, 2, "t"), (5, [inf, 0.0, 0.0, 0.0], 2, "u"), (6, [], 2, "v"), (7, [0.0] * 4, None, "w"), (8, [1.0] * 3, None, "x"), (9, [1e30] * 4, None, "y"), (10, [-0.0001] * 4, None, "z")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x int, row string").withColumn("__x", F.lit(5)).withColumn("v", F.lit(6))
    out, books = vector_codes.compress(frame)
    kept = {(r.row.vec_id, r.row.row): r for r in out.collect()}
    assert sorted(kept) == [(1, "p"), (1, "q"), (7, "w"), (10, "z")] and all(r.error == 0 and r.row["__x"] == 5 and r.row.v == 6 for r in kept.values())
    assert books[0].tolist() == [[1024], [2048], [0], [-1]] and kept[(1, "q")].codes == [1] * 4
    back = out.select(vector_codes.decompress(F.col("codes"), books).alias("v"), "row").where("row.vec_id = 10").collect()[0].v
    assert back == [-1 / 1024] * 4
    none, empty = vector_codes.compress(frame.where("vec_id = 2"))
    assert none.count() == 0 and empty.size == 0


def test_vector_codes_equal_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(db.execute(queries.ORACLES["op12_vector_codes"]).fetchall())
    assert sorted(map(tuple, queries.QUERIES["op12_vector_codes"](spark, sf).collect())) == want
