"""The training-data operators against brute force, and on nulls, empty tables, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import ann, exact_dedup, jaccard_join, langid, packing, pieces, pii, quality, queries, sieve, token_counts, urls
from tessera.llm.quotient_filter import CountingQuotientFilter
from tessera.llm.shingles import buffers, hashed_words, mix, shingle_sets
from tessera.llm.tables import fold_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, score double, a string, t string, key string"


def frame(spark, rows):
    """Rows (doc_id, text) with columns whose names clash with those that operators use within."""
    return spark.createDataFrame([(i, t, "en", "src0", 7, 1, 0.5, "x", "y", "z") for i, t in rows], SCHEMA)


LONG = "word " * 30_000
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (5, "a"), (None, "a"), (6, "Ünïcödé ß 💥 \x1c x"), (7, LONG), (None, None), (8, "<|endoftext|> it's")]


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_quotient_filter_merges_losslessly():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 500, 3000).astype(np.uint64) << np.uint64(40), rng.integers(0, 2**63, 2000).astype(np.uint64)
    one, two = (CountingQuotientFilter.from_bytes(CountingQuotientFilter.build(x, 9).to_bytes()) for x in (a, b))
    both, whole = one.merge(two), CountingQuotientFilter.build(np.r_[a, b], 9)
    assert (both.prints() == whole.prints()).all() and (both.counts == whole.counts).all() and (both.runs == whole.runs).all()
    values, counts = np.unique(a, return_counts=True)
    assert (one.count(values) == counts).all() and one.count(np.array([1], np.uint64))[0] == 0
    assert CountingQuotientFilter.build(np.zeros(0, np.uint64), 4).merge(one).counts.sum() == 3000


def test_exact_dedup(spark, texts, sf):
    out = {r.doc_id: r for r in queries.QUERIES["op1_exact_dedup"](spark, sf).collect()}
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[t].append(i)
    assert len(out) == len(texts)
    for i, t in texts.items():
        r = out[i]
        assert (r.keep_id, r.group_size, r.kept) == (max(groups[t]), len(groups[t]), i == max(groups[t]))
        assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_exact_dedup_edges(spark):
    rows = exact_dedup.exact_dedup(frame(spark, EDGE)).collect()
    by = {(r.doc_id, r.text_sha256): r for r in rows}
    sha = hashlib.sha256(b"a").hexdigest()
    assert len(rows) == len(EDGE) and by[(5, sha)].kept and by[(4, sha)].keep_id == 5 and by[(4, sha)].group_size == 4 and not by[(None, sha)].kept
    assert by[(2, hashlib.sha256(b"").hexdigest())].kept  # of 1, 2 and the row without id
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0
    stage = exact_dedup.stage_exact_dedup(frame(spark, EDGE))
    assert stage.columns == frame(spark, []).columns and sorted((r.doc_id, r.text) for r in stage.select("doc_id", "text").collect() if r.text == "a") == [(5, "a")]


def test_only_copies_are_grouped_however_many_fingerprints_repeat(spark, monkeypatch):
    monkeypatch.setattr(sieve, "ROW_BITS", 3)  # 512 bits, far fewer than the 3,000 repeated fingerprints
    base = spark.range(20_000).selectExpr("id AS doc_id", "concat('text ', CASE WHEN id < 6000 THEN id % 3000 ELSE id END) AS t")
    repeated = exact_dedup.written(exact_dedup.repeated_fingerprints(base.select(F.xxhash64("t").alias("fp"))), "repeated")
    assert exact_dedup.copies(base, repeated).count() == 6000
    out = exact_dedup.exact_dedup(base, text_col="t").where("NOT kept")
    assert out.count() == 3000 and out.where("keep_id <> doc_id + 3000").count() == 0


def test_split_moves_no_row_of_the_set(spark):
    rows = spark.range(5000).selectExpr("id", "CASE WHEN id % 7 = 0 THEN NULL ELSE xxhash64(id) END AS h", "id AS `a.b`")
    some, rest = sieve.split(rows, F.col("h"), sieve.bitmap(rows.where("id % 10 = 3 AND h IS NOT NULL"), "h"))
    assert some.columns == rest.columns == rows.columns and some.count() + rest.count() == 5000
    assert some.where("id % 10 = 3").count() == rows.where("id % 10 = 3 AND h IS NOT NULL").count() and some.count() < 600


def test_one_row_of_each_repeated_document_stays(spark):
    rows = [(4, "a"), (5, "a"), (5, "a"), (None, "a"), (5, "b"), (6, "b"), (6, "b"), (6, "b"), (7, "c"), (5, "d"), (None, "n"), (None, "n"), (None, "m"), (8, None), (8, "")]
    docs = frame(spark, rows)
    docs = docs.withColumn("source", F.concat(F.lit("s"), F.monotonically_increasing_id().cast("string")))  # rows differ elsewhere
    stage = exact_dedup.stage_exact_dedup(docs)
    got = sorted((r.doc_id or 0, r.text or "") for r in stage.collect())
    assert got == sorted([(5, "a"), (6, "b"), (7, "c"), (5, "d"), (0, "n"), (0, "m"), (8, "")]) and stage.columns == docs.columns


def test_rows_without_ids_give_way_to_one_near_duplicate(spark):
    words = [f"w{k}" for k in range(40)]
    near = lambda tag, k: " ".join([f"{tag}{w}" for w in words] + [f"end{k}"])
    rows = [(None, near("a", 1)), (9, near("a", 2)), (8, near("a", 3)), (None, near("b", 1)), (None, near("b", 2)), (None, near("b", 2)), (None, near("b", 3))]
    rows += [(None, near("c", 1)), (7, "other words"), (None, None), (None, ""), (3, None)]
    stage = jaccard_join.stage_near_duplicates(frame(spark, rows))
    out = [(r.doc_id, r.text) for r in stage.collect()]
    assert [i for i, t in out if t and t.startswith("aw")] == [8] and [i for i, t in out if t and t.startswith("bw")] == [None]
    assert len(out) == 1 + 1 + 1 + 1 + 3 and stage.columns == frame(spark, []).columns
    clean = jaccard_join.stage_near_duplicates(exact_dedup.stage_exact_dedup(frame(spark, [*rows, *rows]))).collect()
    assert len(clean) == 5 and len([r for r in clean if not r.text]) == 1


INNER = ["__mask", "__id", "__sha", "__row", "__bit", "__own", "__group", "__rows", "__k", "__w", "__p", "__hk", "__hp", "__key", "__k0", "___id", "row", "mask", "linked", "moved", "fp", "h", "id", "n", "component", "kept", "keep_id", "component_id", "size", "a.b", "__gone"]


def test_stages_leave_columns_of_any_name_as_they_are(spark):
    words = [f"w{k}" for k in range(40)]
    texts = [(1, "a"), (2, "a"), (None, "a"), (3, " ".join([*words, "x"])), (4, " ".join([*words, "y"])), (None, " ".join([*words, "z"])), (None, "other"), (5, ""), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *(f"{c}:{i}" for c in INNER)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in INNER))
    for stage, stay in ((exact_dedup.stage_exact_dedup, [0, 0, 2, 3, 4, 6]), (jaccard_join.stage_near_duplicates, [0, 1, 3, 5, 6]), (pii.stage_pii, [0, 0, 0, 1, 2, 3, 4, 5, 6])):
        out = stage(docs)
        rows = out.collect()
        assert out.columns == docs.columns and sorted(r.doc_id or 0 for r in rows) == stay
        assert all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in INNER)


def brute_sets(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return sets


def brute_components(texts):
    sets = brute_sets(texts)
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            same = len(sets[i] & sets[j])
            if same and 100 * same >= 75 * (len(sets[i]) + len(sets[j]) - same):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_shingles_match_brute_force(texts):
    some = [*list(texts.values())[:40], None, "", " ", "A b", "a  B\x0bc d", "ab cd ef gh ij", "AB cd ef gh ij kl", "x " * 9]
    ours = shingle_sets(pa.array(some))[0]
    theirs = brute_sets(dict(enumerate(some)))
    assert [len(s) for s in ours] == [len(theirs[i]) for i in range(len(some))]
    for i in range(len(some)):
        for j in range(i):
            assert len(np.intersect1d(ours[i], ours[j])) == len(theirs[i] & theirs[j])


def thue_morse(n):
    return "".join("ab"[k.bit_count() % 2] for k in range(n))


HARD_WORDS = [w for n in (8, 16, 1024, 2048) for w in (thue_morse(n), thue_morse(n).translate({97: "b", 98: "a"}))] + ["a" * 8, "a" * 16, "a" * 9, "ab" * 8 + "c", "c" + "ab" * 8]


def test_words_that_collide_under_polynomial_hashes_are_told_apart(spark):
    hashes = hashed_words(*buffers(pa.array(HARD_WORDS)), hashes=2)[0]
    assert all(len(set(h.tolist())) == len(HARD_WORDS) for h in hashes)
    random_words = ["".join(random.Random(k).choices("ab", k=1 + k % 40)) for k in range(20_000)]
    hashes = hashed_words(*buffers(pa.array(random_words)), hashes=2)[0]
    assert len(np.unique(hashes[0])) == len(np.unique(hashes[1])) == len(set(random_words))
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids, bounds = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json")).encode(pa.array(HARD_WORDS))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [tok.encode(w, add_special_tokens=False).ids for w in HARD_WORDS]
    rows = jaccard_join.near_duplicates(frame(spark, list(enumerate(HARD_WORDS)))).collect()
    assert all(r.component_id == r.doc_id and r.n_shingles == 1 for r in rows)


def test_near_duplicates(spark, sf, texts):
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op7_jaccard_join"](spark, sf).collect()}
    assert out == brute_components(texts)


def test_near_duplicates_of_a_chain_and_edges(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    texts = {100: None, 101: "", 102: "one two", 103: "ONE two", 104: "two one"}
    for k in range(40):  # each is near the one before, the ends are far apart
        base = base[1:] + [f"n{k}"]
        texts[200 - k] = " ".join(base)
    docs = frame(spark, [*texts.items(), (150, None), (102, "one two")])
    rows = jaccard_join.near_duplicates(docs).collect()
    expected = brute_components(texts)
    for r in rows:
        if r.doc_id != 150:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id]
    assert expected[200][1] == 161 and len(rows) == len(texts) + 2
    assert jaccard_join.near_duplicates(frame(spark, [])).count() == 0
    assert jaccard_join.near_duplicates(frame(spark, EDGE)).count() == len(EDGE)
    assert jaccard_join.stage_near_duplicates(frame(spark, [(1, "a b c"), (2, "a b c"), (3, None)])).count() == 2


def test_long_lists_are_linked_level_by_level(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(30)]
    texts = {k: " ".join([*base, f"end{k}"]) for k in range(1500)}  # all share all shingles but one
    out = jaccard_join.near_duplicates(frame(spark, list(texts.items()))).groupBy("component_id", "n_shingles").count().collect()
    assert [tuple(r) for r in out] == [(0, 27, 1500)]
    postings = spark.range(40_000).selectExpr("7L AS element", "id", "10L AS n", "40000L AS held")
    pairs = jaccard_join._pairs_to_pivots(postings, 75, 40_000)
    most = pairs.selectExpr("explode(array(a, b)) AS x").groupBy("x").count().agg(F.max("count")).first()[0]
    assert pairs.count() == 39_999 and most < 250  # a tree over all members, in which nobody meets many


def test_near_duplicates_do_not_depend_on_the_size_of_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.range(70_000).selectExpr("id AS doc_id", "concat_ws(' ', 'x', cast(id % 35000 AS string), 'y') AS text").coalesce(1)
    before = spark.conf.get(key)
    spark.conf.set(key, "80000")
    try:
        wrong = jaccard_join.near_duplicates(docs).where("component_id <> doc_id % 35000 OR n_shingles <> 1 OR NOT linked")
        assert wrong.count() == 0
    finally:
        spark.conf.set(key, before)


def test_quality(spark, sf):
    scored = {r.doc_id: r for r in queries.QUERIES["op2_quality"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert all(r.held_out == (fold_of(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored.values())
    good = [scored[r.doc_id].predicted == r.quality for r in labels]
    assert sum(good) / len(good) > 0.93
    held = [r for r in labels if scored[r.doc_id].held_out]
    assert sum(scored[r.doc_id].predicted == r.quality for r in held) / len(held) > 0.85


def test_quality_edges(spark, sf):
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, EDGE)
    model = quality.fit(docs, labels, folds=None)
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (1, 2)} == {0.5}
    assert quality.score(docs, quality.fit(docs, labels.limit(0))).where("score = 0.5").count() == len(EDGE)
    assert quality.stage_quality(frame(spark, []), labels).columns == docs.columns


def brute_terms(text):
    """{term: weight} of a text by counting one at a time."""
    raw = text.encode()
    if not raw:
        return {}
    classes = [int(quality._CLASS[b]) for b in raw]
    shape = Counter((a * quality._CLASSES + b) * quality._CLASSES + c for a, b, c in zip(classes, classes[1:], classes[2:]))
    words = [w.translate({k: k + 32 for k in range(65, 91)}) for w in re.findall("[^ \t-\r]+", text)]
    prints = [int(hashed_words(*buffers(pa.array([w])))[0][0, 0]) for w in words]
    said = Counter(quality._SHAPE + (p >> 52) for p in prints)
    for a, b in zip(prints, prints[1:]):
        said[quality._SHAPE + (int(mix(np.array([(a * 0x9E3779B97F4A7C15 + b) % 2**64], np.uint64))[0]) >> 52)] += 1
    out = {}
    for counts in (shape, said):
        length = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values()))
        out |= {t: math.log1p(c) / length for t, c in counts.items()}
    lines = text.split("\n")
    variety = [len(set(words)) / len(words) if words else 1.0, len(set(lines)) / len(lines), sum(a != b for a, b in zip(words, words[1:])) / (len(words) - 1) if len(words) > 1 else 1.0]
    for k, v in enumerate(variety):
        for at, share in zip(*quality._spread(v, quality._TRIGRAMS + k * len(quality._KNOTS)), strict=True):
            out[at] = share * quality._VARIETY
    return out


def test_quality_of_whole_tables_matches_brute_force(spark, sf, texts):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    vectors_ = {}
    for i, t in texts.items():
        v = np.zeros(model.projection.shape[1])
        for term, w in brute_terms(t).items():
            if model.slot[term] >= 0:
                v += w * model.projection[model.slot[term]].astype(float)
        a, b = v[: model.split], v[model.split :]
        v = np.r_[a / (np.linalg.norm(a) or 1) * quality.SHARES[1] ** 0.5, b / (np.linalg.norm(b) or 1) * quality.SHARES[0] ** 0.5]
        vectors_[i] = v / (np.linalg.norm(v) or 1)
    votes = {r.doc_id: r.quality for r in labels.collect() if fold_of(r.doc_id, 5) and r.doc_id in texts}
    learnt = sorted(votes)
    assert len(learnt) == len(model.vectors) and np.allclose(model.vectors, [vectors_[i] for i in learnt], atol=1e-4)
    known = np.array([vectors_[i] for i in learnt])
    for r in queries.QUERIES["op2_quality"](spark, sf).collect():
        cosine = known @ vectors_[r.doc_id]
        top = np.argsort(-cosine)[: quality.NEIGHBOURS]
        w = np.clip(cosine[top], 0, None) ** quality.SHARPNESS
        expected = (w * [votes[learnt[k]] for k in top]).sum() / w.sum() if w.sum() > 1e-9 else model.prior
        assert abs(r.score - expected) < 2e-3 and r.predicted == (r.score >= 0.3) and r.held_out == (fold_of(r.doc_id, 5) == 0)


def test_quality_learns_one_text_of_each_id(spark):
    rows = [(k % 7, f"text {k % 7} of {k}") for k in range(400)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(7)] * 2, "doc_id long, quality int, toxic int")
    model = quality.fit(frame(spark, rows), labels, max_labelled=5, folds=None)
    assert len(model.vectors) == 5 and len(quality.fit(frame(spark, rows), labels, folds=None).vectors) == 7


def test_quality_hears_words(texts):
    a, b = "the cat sat on the mat and ran", "tho cot sit an tho met ond rin"  # of one shape
    model = quality.NeighbourModel.fit(quality.terms(pa.array([*list(texts.values())[:50], *[a, b] * 3])), np.ones(56))
    x, y = model.embed(quality.terms(pa.array([a, b])))
    assert np.allclose(x[: model.split], y[: model.split], atol=1e-5) and not np.allclose(x, y, atol=0.01)


def test_neighbour_votes_match_brute_force(texts):
    rows = quality.terms(pa.array(list(texts.values())[:60]))
    votes = np.arange(60) % 3 == 0
    model = quality.NeighbourModel.fit(rows, votes, neighbours=5)
    x = model.embed(rows)
    for i, got in enumerate(model.score(rows, block=7)):
        cosine = x @ x[i]
        top = np.argsort(-cosine, kind="stable")[:5]
        w = np.clip(cosine[top], 0, None).astype(float) ** quality.SHARPNESS
        assert abs(got - (w * votes[top]).sum() / w.sum()) < 1e-4 or np.isclose(np.sort(cosine)[-6], np.sort(cosine)[-5], atol=1e-5)


def covered(rows, lengths):
    at, sequences = defaultdict(int), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.length > 0
        at[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert dict(at) == lengths
    total = padding = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
        total += end
        padding += 0 if end & (end - 1) == 0 else 4096 - end
    return padding / total


def test_packing(spark, sf, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()}
    rows = queries.QUERIES["op3_packing"](spark, sf).collect()
    assert covered(rows, {i: len(x) for i, x in ids.items()}) < 0.01
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])


def test_packing_edges(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["it's the 3rd", "naïve CAFÉ e\u0301", "İstanbul ΣΑΣ", "a\x1cb", "x\u00a0y\u2003z", "don't!!", "ﬁ µ ª º ½", "<|endoftext|>", "日本語 テスト", "'s 't 'llama", ""]
    enc = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), memory=3)
    for _ in range(3):
        ids, bounds = enc.encode(pa.array([*texts, None]))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [*(tok.encode(t, add_special_tokens=False).ids for t in texts), []]
    assert packing.pack_documents(frame(spark, [])).count() == 0
    rows = packing.pack_documents(frame(spark, [(i, t) for i, t in EDGE if i not in (None, 4)])).collect()
    assert covered(rows, {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in EDGE if i not in (None, 4)}) == 0
    assert all(len(r.piece_ids) == 4 * r.length for r in rows)


def test_workers_forget_words_after_packing(spark, sf):
    enc = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for n in (1, 3000):  # the table grows with the words and finds them all again
        words = [f"w{i}" for i in range(n)]
        got, bounds = enc.encode(pa.array(words))
        assert [got[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [e.ids for e in enc.tokenizer.encode_batch(words, add_special_tokens=False)]
        assert enc.words == n and 2 * n <= enc.size <= max(1024, 4 * n)
    packing.pack_documents(spark.read.parquet(f"{sf}/documents.parquet")).count()

    def held(batches):
        from tessera.llm import tables

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"words": pa.array([m.words for k, m in tables._KEPT.items() if k[0].__name__ == "WordEncoder"], pa.int64())})

    found = [r.words for r in spark.range(0, 8, 1, 8).mapInArrow(held, "words long").collect()]
    assert found and not any(found)


@pytest.mark.parametrize("seed", range(6))
def test_pack_keeps_all_limits(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 300, 200)
    losses = np.minimum(lengths, rng.integers(0, 300, 200))
    limits = packing.Limits(256, int(rng.integers(2, 9)), int(rng.integers(60, 256)))
    at, used = defaultdict(int), defaultdict(lambda: np.zeros(3, int))
    pieces_ = packing.pack(lengths, losses, limits)
    for item, start, n, sequence, offset in sorted(pieces_):
        assert start == at[item]
        at[item] += n
        used[sequence] += [n, 1, max(0, start + n - max(start, lengths[item] - losses[item]))]
    assert [at[i] for i in range(200)] == lengths.tolist()
    assert all((u <= [limits.tokens, limits.segments, limits.loss]).all() for u in used.values())


def test_conversations_are_packed_under_a_loss_limit_that_binds(spark, sf):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append(r.text or "")
    rows = []
    for i, some in turns.items():  # of each conversation the last turn is the answer
        prompt = " ".join(some[:-1])
        rows.append((i, f"{prompt} {some[-1]}", len(tok.encode(prompt, add_special_tokens=False).ids)))
    docs = spark.createDataFrame([*rows, (-1, "no prompt at all", None), (-2, "beyond", 99)], "doc_id long, text string, prompt long")
    limits = packing.Limits(512, 6, 160)
    pieces_ = packing.pack_documents(docs, limits=limits, loss_from="prompt").collect()
    prompts = {i: p or 0 for i, _, p in rows} | {-1: 0, -2: 99}
    used, at = defaultdict(lambda: np.zeros(3, int)), defaultdict(int)
    for r in sorted(pieces_, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id]
        at[r.doc_id] += r.length
        used[r.sequence_id] += [r.length, 1, max(0, r.start + r.length - max(r.start, min(prompts[r.doc_id], r.doc_tokens)))]
    assert all(at[i] == len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t, _ in rows)
    assert all((u <= [limits.tokens, limits.segments, limits.loss]).all() for u in used.values())
    bound = [sum(u[k] == m for u in used.values()) for k, m in enumerate((limits.tokens, limits.segments, limits.loss))]
    assert bound[2] > 5 and bound[0] > 5  # sequences end by either limit


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (12 <= len(d) <= 19 and pii.luhn(d))) or (k == 3 and not 9 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_match_brute_force(texts):
    rng = random.Random(8)
    fuzz = ["".join(rng.choice("aB1.2@ +-().9\n,é0") for _ in range(rng.randrange(70))) for _ in range(4000)]
    for t in [*texts.values(), *fuzz, "4111111111111111 x", "1" * 5000]:
        assert pii.base_spans(t) == brute_spans(t)


def test_field_decodes_as_brute_force_and_learns():
    field = pii.ChainField.fit(pii.labelled_table(rows=250), rounds=60)
    fresh = pii.labelled_table(seed=77, rows=60)
    tags = field.decode([w for w, _ in fresh])
    right = [a == b for (_, y), p in zip(fresh, tags, strict=True) for a, b in zip(y, p, strict=True)]
    assert sum(right) / len(right) > 0.97
    from itertools import product

    words = ["call", "(706)", "555-3138"]
    node = [[0.0 if not f else field.weights[[field.index[x] for x in f if x in field.index]].sum(0)[k] for k in range(9)] if f else [0.0] + [-1e4] * 8 for f in pii.features(words)]
    best = max(product(range(9), repeat=3), key=lambda y: field.first[y[0]] + sum(node[t][y[t]] for t in range(3)) + field.steps[y[0], y[1]] + field.steps[y[1], y[2]])
    assert field.decode([words])[0] == [pii.TAGS[k] for k in best]


def test_pii(spark):
    rows = [(20, "card 4111111111111111 4012888888881881 now"), (21, "mail a.b@example.org, or 10.0.0.1"), (22, "in 2024 we sold 1234567890123456 things for $5,000.00")]
    out = {r.doc_id: r for r in pii.find_pii(frame(spark, [*EDGE, *rows])).collect() if r.doc_id is not None}
    assert out[20].n_card == 0 and "card:5:21" in out[20].spans and "card:22:38" in out[20].spans
    assert out[21].spans == "email:5:20,ip:25:33" and out[21].base_sha256 == hashlib.sha256(b"email:5:20,ip:25:33").hexdigest()
    assert out[22].spans == "" and out[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_pii(frame(spark, [])).count() == 0
    clean = {r.doc_id: r.text for r in pii.stage_pii(frame(spark, rows)).collect()}
    assert clean[21] == "mail [EMAIL], or [IP]" and clean[22] == rows[2][1]


def test_windows_decode_as_one_uncut_sentence(texts):
    field = pii.trained()
    numbers = " ".join(str(100 + k) for k in range(300))
    long_word = "x" * 500 + "7"
    cases = [f"{numbers[: 4 * n]} (706) 555-3138 now" for n in range(55, 75)] + [f"tel {'y' * 300} (706) 555-3138", f"card {long_word} 4111111111111111", numbers * 5]
    for text in [*cases, *list(texts.values())[:40]]:
        words = [m.span() for m in re.finditer(r"\S+", text)]
        whole = dict(zip(words, field.decode([[text[a:b] for a, b in words]])[0] if words else [], strict=True))
        spots = pii.windows_of(text)
        tags = field.decode([[text[a:b] for a, b in w] for w in spots])
        cut = {span: t for w, some in zip(spots, tags, strict=True) for span, t in zip(w, some, strict=True)}
        assert all(whole[span] == cut.get(span, "O") for span in words)
    for n in (62, 63, 64, 200):
        text = f"{' '.join(['12'] * n)} call (706) 555-3138 now"
        assert any(k == 3 for _, k, _ in pii.find_all([text], field)[0][1])


def test_pii_of_whole_tables_matches_brute_force(spark, sf, texts):
    field = pii.trained()
    for r in queries.QUERIES["op4_pii"](spark, sf).collect():
        base = brute_spans(texts[r.doc_id])
        words = [m.span() for m in re.finditer(r"\S+", texts[r.doc_id])]
        spans = list(base)
        for s in pii._added(texts[r.doc_id], words, field.decode([[texts[r.doc_id][a:b] for a, b in words]])[0] if words else []):
            if all(s[2] <= a or s[0] >= b for a, _, b in spans):
                spans.append(s)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert r.spans == pii.listed(sorted(spans)) and r.n_spans == len(spans) and r.base_sha256 == hashlib.sha256(pii.listed(base).encode()).hexdigest()


def test_urls(spark, sf):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    more = {-1: None, -2: "no scheme", -3: "HTTP://A.Example.NET", -4: "x://EXAMPLE.net/en/?q", -5: "x://notexample.net/en/", -6: "://org/fr/#a://b", -7: "http://example.com/de/"}
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame([(i, u, None, "h") for i, u in [*pages.items(), *more.items()]], "page_id long, url string, html string, host string")).collect()}
    for i, u in [*pages.items(), *more.items()]:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(r.name, r.action) for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best[0])
        assert best[1] in (None, got[i].verdict) and got[i].verdict in ("allow", "block")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_verdicts_of_whole_tables_match_dense_page_rank(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in urls.judge(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    assert {tuple(r) for r in queries.QUERIES["op5_url_filter"](spark, sf).collect()} == {tuple(r)[:5] for r in got.values()}
    weights, seeds = Counter(), {"allow": Counter(), "block": Counter()}
    hosts = {r.page_id: got[r.page_id].host for r in pages}
    action = {r.name: r.action for r in urls.RULES}
    for r in pages:
        for url in re.findall(r"""(?i)href\s*=\s*["']?([a-z][a-z0-9+.-]*://[^"'\s>]+)""", r.html or ""):
            weights[hosts[r.page_id], re.match(r"[^:]*://([^/?#]*)", url)[1].lower()] += 1
        if got[r.page_id].rule:
            seeds[action[got[r.page_id].rule]][hosts[r.page_id]] += 1
    for h in {x for pair in weights for x in pair} | set(hosts.values()):
        while h.count(".") > 1:
            up = h.split(".", 1)[1]
            weights[h, up] = max(weights[h, up], 1) if (h, up) in weights and weights[h, up] > 1 else 1
            weights[up, h] = weights[h, up]
            h = up
    names = sorted({x for pair in weights for x in pair} | set(hosts.values()))
    at = {n: k for k, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for (a, b), w in weights.items():
        if a != b and a and b:
            m[at[a], at[b]] = w

    def rank(matrix, counts):
        p = np.divide(matrix, matrix.sum(1, keepdims=True), out=np.zeros_like(matrix), where=matrix.sum(1, keepdims=True) > 0)
        seed = np.array([counts.get(n, 0) for n in names]) / max(1, sum(counts.values()))
        return np.linalg.solve(np.eye(len(names)) - 0.85 * p.T, 0.15 * seed)

    trust, distrust = rank(m, seeds["allow"]), rank(m.T, seeds["block"])
    open_ = 0
    for i, r in got.items():
        t, d = trust[at[r.host]], distrust[at[r.host]]
        assert np.isclose(r.trust, t, rtol=1e-3, atol=1e-9) and np.isclose(r.distrust, d, rtol=1e-3, atol=1e-9)
        if r.rule is None and abs(t - d) > 1e-6:
            assert r.verdict == ("block" if d > t else "allow")
            open_ += 1
        elif r.rule:
            assert r.verdict == action[r.rule]
    assert open_ > 10


def test_verdicts_without_a_rule_follow_the_hosts_nearby(spark):
    rows = [(1, "http://m.x.example.com/de/", None)]
    rows += [(k, f"http://m.x.example.com/en/{k}", None) for k in range(2, 6)]  # one page in five is enough for a seed
    rows += [(10, "http://a.b.c.example.com/", None), (20, "http://p.q.example.org/fr/", '<a href="http://deep.w.site.info/">')]
    rows += [(21, "http://r.example.org/x", None), (22, "http://t.site.info/", None), (30, "http://alone.info/", None)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i for i, r in got.items() if r.verdict == "block"} == {1, 2, 3, 4, 5, 10} and got[10].rule is None
    assert got[10].distrust > 0 and got[21].trust > 0  # by parents that have no pages
    assert got[22].trust > 0  # by the parent of a host that only a link names
    assert (got[30].trust, got[30].distrust) == (0, 0)
    edges = {(r.src, r.dst) for r in urls.host_graph(spark.createDataFrame([("a.b.c.d", None)], "host string, html string")).collect()}
    assert edges == {("a.b.c.d", "b.c.d"), ("b.c.d", "a.b.c.d"), ("b.c.d", "c.d"), ("c.d", "b.c.d")}


def test_trust_propagation_matches_dense_iteration(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("b", "a", 3.0), ("d", "c", 1.0)], "src string, dst string, w double")
    seeds = spark.createDataFrame([("a", 2, 0), ("c", 0, 5)], "host string, trusted long, blocked long")
    got = {r.host: (r.trust, r.distrust) for r in urls.propagate(edges, seeds, rounds=4).collect()}
    names = "abcd"
    m = np.zeros((4, 4))
    for s, d, w in (("a", "b", 1.0), ("b", "c", 1.0), ("b", "a", 3.0), ("d", "c", 1.0)):
        m[names.index(s), names.index(d)] = w

    def run(matrix, seed):
        p = np.divide(matrix, matrix.sum(1, keepdims=True), out=np.zeros_like(matrix), where=matrix.sum(1, keepdims=True) > 0)
        r = seed
        for _ in range(4):
            r = 0.85 * r @ p + 0.15 * seed
        return r

    trust, distrust = run(m, np.array([1.0, 0, 0, 0])), run(m.T, np.array([0, 0, 1.0, 0]))
    for i, n in enumerate(names):
        assert np.allclose(got.get(n, (0, 0)), (trust[i], distrust[i]), atol=1e-9)


def test_hubs_are_dealt_without_changing_scores(spark, monkeypatch):
    links = [("hub", f"h{k}", 1.0 + k % 3) for k in range(40)] + [(f"h{k}", "hub", 1.0) for k in range(0, 40, 2)] + [("h1", "h2", 2.0)]
    edges = spark.createDataFrame(links, "src string, dst string, w double")
    seeds = spark.createDataFrame([("hub", 1, 0), ("h1", 2, 1), ("h3", 0, 4)], "host string, trusted long, blocked long")
    whole = sorted(map(tuple, urls.propagate(edges, seeds).collect()))
    monkeypatch.setattr(urls, "HUB", 3)
    assert sorted(map(tuple, urls.propagate(edges, seeds).collect())) == whole and len(whole) == 41


def test_trust_reaches_far_hosts_and_does_not_depend_on_the_size_of_the_input(spark):
    chain = [f"c{k}" for k in range(13)]  # 12 edges, beyond one block of rounds
    star = [f"s{k}" for k in range(100)]
    links = [*zip(chain[:-1], chain[1:], strict=True), ("big", "twin"), ("twin", "big"), ("hub", "big")]
    links += [("one", x) for x in star] + [("s0", f"t{k}") for k in range(100)]
    seeds = {"c0": 1, "one": 1, "big": 3_000_000}
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in links], "src string, dst string, w double")
    rank = urls.propagate(edges, spark.createDataFrame([(h, n, 0) for h, n in seeds.items()], "host string, trusted long, blocked long"))
    got = {r.host: r.trust for r in rank.collect()}
    names = sorted({x for link in links for x in link})
    m, seed = np.zeros((len(names), len(names))), np.array([seeds.get(n, 0) for n in names]) / sum(seeds.values())
    for a, b in links:
        m[names.index(a), names.index(b)] = 1
    p = np.divide(m, m.sum(1, keepdims=True), out=np.zeros_like(m), where=m.sum(1, keepdims=True) > 0)
    exact = np.linalg.solve(np.eye(len(names)) - 0.85 * p.T, 0.15 * seed)
    assert min(exact[names.index(n)] for n in ("c12", "t99")) > 0
    for n, x in zip(names, exact, strict=True):
        assert np.isclose(got.get(n, 0.0), x, rtol=1e-6, atol=0)


def test_edited_counts_match_full_recounts(spark, texts):
    counter = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    tok = counter.tokenizer
    rng = random.Random(3)
    for text in [*list(texts.values())[:15], "", "a", " " * 300, "it's\n\n x"]:
        tree, now = token_counts.CountTree(text, counter), text
        for _ in range(10):
            a = rng.randint(0, len(now))
            b = min(len(now), a + rng.choice([0, 1, 5, 300]))
            new = rng.choice(["", " ", "'s", "\n", "abc", " hello world " * 4, "z " * 150])
            tree.edit(a, b, new)
            now = now[:a] + new + now[b:]
            assert tree.text() == now and tree.total == len(tok.encode(now, add_special_tokens=False).ids) and tree.length == len(now)
    rows = token_counts.count_edited(frame(spark, EDGE)).collect()
    assert len(rows) == len(EDGE) and {r.tokens_before for r in rows if r.doc_id in (1, 2)} == {0}
    assert next(r for r in rows if r.doc_id == 7).chars_recounted < len(LONG) / 20
    assert token_counts.count_edited(frame(spark, [])).count() == 0


def test_token_counts_of_whole_tables_match_full_recounts(spark, sf, texts):
    tok = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json")).tokenizer
    for r in queries.QUERIES["op6_token_counts"](spark, sf).collect():
        now = texts[r.doc_id]
        assert r.tokens_before == len(tok.encode(now, add_special_tokens=False).ids)
        for k in range(3):
            a, b, new = token_counts.edits_of(r.doc_id, len(now), 3)[k]
            now = now[:a] + new + now[b:]
        assert r.tokens_after == len(tok.encode(now, add_special_tokens=False).ids) and r.chars_after == len(now)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "q") for i, v in rows], "vec_id long, embedding array<float>, rep string")


def test_nearest(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    all_ = sorted((r.vec_id, r.embedding) for r in df.collect())
    ids, x = np.array([i for i, _ in all_]), np.array([v for _, v in all_], float)
    got = defaultdict(list)
    for r in queries.QUERIES["op8_nearest"](spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    hits = 0
    asked = [i for i in ids if i % 20 == 0]
    for q in asked:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -9
        true = ids[np.lexsort((ids, -s))[:20]]
        hits += len(set(true) & {r.vec_id for r in got[q]})
        assert [r.rank for r in got[q]] == list(range(1, 21)) and all(abs(s[ids == r.vec_id][0] - r.score) < 1e-9 for r in got[q])
    assert hits / (20 * len(asked)) >= 0.9


def test_nearest_edges(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100, [0.0, 1.0]), (101, [0.5, 0.5]), (102, None), (103, []), (104, [0.0, 0.0]), (105, [float("nan"), 1.0]), (106, [None, 1.0]), (107, [1.0]), (None, [1.0, 1.0])]
    df = vectors(spark, rows)
    out = ann.nearest(df, df.where("vec_id % 20 = 0 OR vec_id IS NULL")).orderBy("query_id", "rank").collect()
    by = defaultdict(list)
    for r in out:
        by[r.query_id].append(r.vec_id)
    assert by[0] == list(range(1, 21)) and by[20] == list(range(20)) and by[40] == list(range(20))
    assert by[100][0] == 101 and by[100][1:] == list(range(19)) and set(by) == {0, 20, 40, 100}
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    two = vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])])
    assert [(r.query_id, r.vec_id) for r in ann.nearest(two, two.where("vec_id = 0")).collect()] == [(0, 1)]


def brute_nearest(rows, asked, k=20):
    """{id: [(id, score)]} from rows (id, vector), each id once."""
    out = {}
    for i in asked:
        v = next(v for j, v in rows if j == i)
        found = sorted((-math.fsum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in rows if j != i)
        out[i] = [(j, -s) for s, j in found[:k]]
    return out


def answers(frame_):
    by = defaultdict(list)
    for r in frame_.orderBy("query_id", "rank").collect():
        assert r.rank == len(by[r.query_id]) + 1
        by[r.query_id].append((r.vec_id, r.score))
    return dict(by)


def test_nearest_breaks_ties_by_id_and_keeps_doubles(spark):
    rng = np.random.default_rng(5)
    tied = [(i, [1.0, *rng.permutation([0.5] + [0.0] * 30).tolist()]) for i in range(1, 400)]
    rows = [(0, [1.0] + [0.0] * 31), *({i: v for i, v in tied}.items())]
    got = answers(ann.nearest(vectors(spark, rows), vectors(spark, rows[:1])))
    assert got == {0: [(i, 1.0) for i in range(1, 21)]}
    many = [(i, rng.normal(size=24).tolist()) for i in range(600)]
    df = spark.createDataFrame(many, "vec_id long, embedding array<double>")
    assert answers(ann.nearest(df, df.where("vec_id % 20 = 0"), least=10**9)) == brute_nearest(many, range(0, 600, 20))


def test_nearest_of_repeated_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(40)]
    df = vectors(spark, [*rows, *([rows[0]] * 25), *([rows[7]] * 30)])
    got = answers(ann.nearest(df, df.where("vec_id = 0")))
    assert got == brute_nearest(rows, [0])
    twice = vectors(spark, [*rows, (0, rows[1][1])])  # another vector under the query's id is a row like others
    near = ann.nearest(twice, twice.where("vec_id = 0"), k=41).collect()
    assert len(near) == 2 * 40 and sum(r.vec_id == 0 for r in near) == 2


def test_forest_visiting_all_is_exact():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    forest = ann.grow_forest(x, trees=3, leaf=10)
    sizes = [np.bincount(t.assign(x), minlength=t.leaves) for t in forest]
    assert all(s.sum() == 300 and s.max() <= 10 for s in sizes)
    for found in ann.search_forest(forest, x[:5], 900, sizes, 1.0):
        assert len(set(found)) == sum(t.leaves for t in forest)
    for found, row in zip(ann.search_forest(forest, x[:20], 90, sizes, 3.0), range(20), strict=True):
        assert 90 <= sum(sizes[i][leaf] for i, leaf in found) < 100 and len(set(found)) == len(found)
        assert any(leaf == forest[i].assign(x[row : row + 1])[0] for i, leaf in found)


def made_vectors(kind, n, width, seed=9):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    if kind == "clusters":
        x += 4 * rng.normal(size=(200, width))[rng.integers(0, 200, n)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return (x * rng.lognormal(0, 1, n)[:, None] if kind == "lengths" else x).astype(np.float32)


@pytest.mark.parametrize(("kind", "n", "width", "sample", "most"), [("unit", 12_000, 32, 12_000, 0.45), ("clusters", 12_000, 32, 12_000, 0.1), ("unit", 60_000, 64, 12_000, 0.5)])
def test_recall_of_a_share_of_the_leaves(kind, n, width, sample, most):
    x = made_vectors(kind, n, width).astype(float)
    longest = float(np.linalg.norm(x, axis=1).max())
    index = ann.Index.fit(x[:sample], n, 20, longest)
    leaves = [t.assign(ann.lifted(x, longest)) for t in index.forest]
    sizes = [np.bincount(at, minlength=t.leaves) for at, t in zip(leaves, index.forest, strict=True)]
    hits = met = 0
    for q, found in enumerate(ann.search_forest(index.forest, ann.towards(x[-60:], longest), index.visits, sizes, index.rise)):
        seen = np.zeros(len(x), bool)
        for i, leaf in found:
            seen |= leaves[i] == leaf
        hits += seen[np.argsort(-(x @ x[n - 60 + q]))[1:21]].sum()
        met += seen.mean()
    assert hits / (60 * 20) >= 0.92 and met / 60 < most


@pytest.mark.parametrize(("kind", "width"), [("lengths", 64), ("unit", 256)])
def test_recall_of_unequal_lengths_and_of_wide_vectors(spark, tmp_path, kind, width):
    import pyarrow.parquet as pq

    x = made_vectors(kind, 20_000, width)
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), tmp_path / "v.parquet", row_group_size=5000)
    df = spark.read.parquet(str(tmp_path / "v.parquet"))
    got = answers(ann.nearest(df, df.where("vec_id % 400 = 0")))
    assert len(got) == 50
    hits = sum(len({i for i, _ in found} & set(np.argsort(-(x.astype(float) @ x[q].astype(float)))[:21].tolist()) - {q}) for q, found in got.items())
    assert hits / (50 * 20) >= 0.9


def test_nearest_sql_tells_rows_apart_by_more_than_their_ids(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i % 50, rng.normal(size=4).astype(np.float32).tolist(), 0) for i in range(60)]
    frame_ = spark.createDataFrame([*rows, rows[0]], "vec_id long, embedding array<float>, label int")
    frame_.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(db.execute(queries.ORACLES["op8_nearest"]).fetchall())
    assert len(want) == 4 * 20 and sorted(map(tuple, queries.QUERIES["op8_nearest"](spark, str(tmp_path)).collect())) == want


def test_pieces(spark, texts):
    model = pieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model"), memory=50)
    for t in [*list(texts.values())[:30], "a  b\n\t💥 日本 é", " ", "x", "\x00\x7f", "ßẞ" * 50]:
        assert model.decode(model.encode(t)) == t
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for word in ["▁therhean", "▁▁▁x", "▁日é", "abcabc"]:
        best = [0.0] + [-1e18] * len(word)
        for e in range(1, len(word) + 1):
            best[e] = best[e - 1] + pieces.BYTE_COST
            for s in range(e):
                i = sp.piece_to_id(word[s:e])
                if i != sp.unk_id() and not sp.is_byte(i) and not sp.is_control(i):
                    best[e] = max(best[e], best[s] + sp.get_score(i))
        ids = model.best_path(word)
        plain = [i for i in ids if i not in model.byte_of]
        score = sum(sp.get_score(i) for i in plain) + pieces.BYTE_COST * (len(word) - sum(len(model.pieces[i]) for i in plain))
        assert abs(score - best[-1]) < 1e-3
    rows = pieces.encode_documents(frame(spark, EDGE)).collect()
    assert all(r.round_trip for r in rows) and len(rows) == len(EDGE)
    assert pieces.encode_documents(frame(spark, [])).count() == 0


def test_pieces_are_those_of_the_vocabularys_own_encoder(spark, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel(path)
    assert model.merges and sp.encode("des Elle", out_type=str) == ["▁des", "▁Elle"]
    some = [(k, t) for k, t in enumerate([*texts.values(), "des Elle", " a  b ", "", "日本 💥\n", "a▁b", "▁", LONG[:5000]])]
    rows = {r.doc_id: r for r in pieces.encode_documents(frame(spark, some)).collect()}
    for k, t in some:
        ids = np.frombuffer(rows[k].ids, "<u4").tolist()
        assert ids == sp.encode(t) and rows[k].n_pieces == len(ids) and rows[k].n_bytes == sum(map(sp.is_byte, ids))
        assert rows[k].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and rows[k].round_trip == ("▁" not in t)
        assert model.decode(np.array(ids, "<u4")) == sp.decode(ids) == t.replace("▁", " ")
    rng = random.Random(1)
    plain = [p.replace("▁", " ") for p in model.pieces[300:]]
    for k in range(6000):
        letters = [rng.choice("abcdeéßñ日 -'.,0123ABC\n") for _ in range(rng.randrange(1, 25))] if k % 2 else [rng.choice(plain) for _ in range(rng.randrange(1, 6))]
        assert model.encode("".join(letters)).tolist() == sp.encode("".join(letters))


def test_language(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op10_language_id"](spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (fold_of(r.doc_id, 4) == 2) for r in rows)
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.95


def test_language_of_whole_tables_matches_brute_force(spark, sf, texts):
    model = langid.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    tables, bias = model.tables.astype(float), model.bias.astype(float)
    for r in queries.QUERIES["op10_language_id"](spark, sf).collect():
        text = texts[r.doc_id]
        code = [b if b >= 128 else b | 32 if chr(b).isalpha() else 0 for b in text.encode()] + [0, 0, 0]
        total = np.zeros(len(bias))
        for k in range(len(code) - 3):
            three = code[k] << 16 | code[k + 1] << 8 | code[k + 2]
            four = (three << 8 | code[k + 3]) % 2**32
            total += tables[three * 2654435761 % 2**32 >> 17] + tables[langid.BUCKETS + ((four ^ four >> 15) * 2246822519 % 2**32 >> 17)]
        z = (total / max(1, 2 * (len(code) - 3)) + bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        if not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == model.languages[int(p.argmax())] and abs(r.score - p.max()) < 1e-5


def test_language_learns_whole_texts_and_repeated_ids(spark):
    rows = [(k, f"{'ab' * 600}x{k}", "l1") for k in range(5)] + [(k, f"{'cd' * 600}x{k}", "l2") for k in range(5)] + [(1, f"{'ab' * 600}x1", "l1")] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    keep, langid.LanguageModel.fit = langid.LanguageModel.fit, lambda t, y: seen.append((t, y))
    try:
        langid.fit(docs, folds=None)
        langid.fit(docs, folds=None, max_bytes=5000)
    finally:
        langid.LanguageModel.fit = keep
    assert sorted(zip(*seen[0], strict=True)) == sorted({(t, y) for _, t, y in rows}) and len(seen[1][0]) == 4


def test_language_edges(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    rows = {(r.doc_id, r.lang_pred) for r in langid.identify(frame(spark, [*EDGE, (30, "123 ... !"), (31, "日本")]), model).collect() if r.doc_id in (1, 2, 3, 30)}
    assert rows == {(i, "und") for i in (1, 2, 3, 30)}
    texts = [r.text for r in docs.limit(20).collect()]
    alone = [model.probabilities(pa.array([t]))[0] for t in texts]
    assert np.allclose(alone, model.probabilities(pa.array(texts)), atol=1e-6)
    nothing = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(frame(spark, EDGE), nothing).collect()} == {"und"}


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = docs
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        sizes.append(kept.count())
    scored = quality.score(docs, quality.fit(docs, labels)).where("predicted = 1").count()
    assert sizes[0] == scored and sizes == sorted(sizes, reverse=True)
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert len(set(texts.values())) == len(texts)
    assert not any(pii.base_spans(t) for t in texts.values())
    assert all(c == i for i, (_, c) in brute_components(texts).items())
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = corpus_pipeline.run(spark, sf).collect()
    assert covered(rows, {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}) < 0.05


def test_query_names():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 13))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
