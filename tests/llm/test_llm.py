"""The ten operators and the pipeline against brute force, libraries, exact
round trips and held-out accuracy, on small tables with odd rows."""

import array
import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from convolake.llm import (bbit_minhash, byte_bpe, components, line_set_dedup, log_bilinear, order_minhash, patience_license,  # noqa: E402
                           preference_quality, queries, rans_store, secret_scan, suffix_decontamination)

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, t string, h string"
_rng = random.Random(5)
_VOCAB = ["".join(_rng.choice("abcdefghij") for _ in range(_rng.randint(2, 7))) for _ in range(400)]
PASSAGE = " ".join(_VOCAB[:60])


def _prose(n, rng):
    return " ".join(rng.choice(_VOCAB) for _ in range(n))


def _rows():
    rng = random.Random(9)
    base = _prose(120, rng)
    near = base.split(" ")
    near[60] = "changed"
    texts = [base, base.upper(), " ".join(near), _prose(80, rng), "", None, "one", "two words", " \n\t ", "é日本🙂 ß " * 5,
             PASSAGE + "\n" + _prose(30, rng), _prose(30, rng) + "\n" + PASSAGE, "x " * 3000, "y" * 5000,
             "a line that is long enough to count here\nother\na line that is long enough to count here",
             "password = hunter2hunter\nAKIA" + "A1" * 9 + " " + "0af" * 9, "token: abc", "pwd: Xk9#mQ2$vL7!", None, "one"]
    rows = [(i, t, "en", "hot" if i % 3 else "s", len(t or ""), "clash", "clash", None) for i, t in enumerate(texts)]
    return rows + [rows[0], (None, "no id but words", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _by_id(df):
    return {r.doc_id: r for r in df.collect()}


def _texts():
    return {r[0]: r[1] or "" for r in _rows()}


def test_byte_bpe_agrees_with_the_library(docs):
    import tiktoken
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = _by_id(byte_bpe.token_digests(docs, path, public_tokenizers.PATTERN))
    for i, t in _texts().items():
        ids = lib.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (
            len(ids), hashlib.sha256(array.array("I", ids).tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_token_files_round_trip(docs):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = rans_store.round_trip(docs, path, 2, block_ids=500, lanes=16).orderBy("start").collect()
    rows = sorted(((r[0], r[1] or "") for r in _rows()), key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for r, (i, t) in zip(got, rows, strict=True):
        ids = lib.encode(t, add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(array.array("I", ids).tobytes()))
        at += len(ids)


def test_rans_block_is_exact_for_skewed_symbols():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 5000):
        ids = np.minimum(rng.geometric(0.3, n), 40).astype(np.uint32)
        counts = np.bincount(ids, minlength=64) + 0
        counts[50] = 1
        freq = rans_store.normalised(counts)
        assert int(freq.sum()) == 1 << rans_store.SCALE_BITS
        start = (np.cumsum(freq) - freq).astype(np.uint64)
        payload, states = rans_store.encode_block(ids, freq, start, 8)
        slots = np.repeat(np.arange(64, dtype=np.uint32), freq.astype(np.int64))
        assert (rans_store.decode_block(payload, states, n, freq, start, slots) == ids).all()


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))


def test_minhash_components_are_exact(docs):
    texts = {i: t for i, t in _texts().items() if i is not None}
    sets = {}
    for i, t in texts.items():
        w = _words(t)
        k = min(5, len(w))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if k else set()
    parent = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    parent[a] = parent[b] = min(parent[a], parent[b])
    got = _by_id(bbit_minhash.duplicate_components(docs))
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), parent[i], parent[i] == i)
    assert got[None].kept and got[None].component_id is None
    kept = bbit_minhash.keep_first(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 0").count() == 1 and kept.where("doc_id in (1, 2)").count() == 0


def test_minhash_large_mixed_bucket(spark, monkeypatch):
    """Buckets beyond the limit are cut and then settled in turns."""
    monkeypatch.setattr(bbit_minhash, "SMALL", 2)
    monkeypatch.setattr(bbit_minhash, "CUTS", 1)
    rng = random.Random(3)
    common = _prose(60, rng)
    rows = [(i, common + " " + _prose(14, random.Random(i // 2))) for i in range(24)]
    got = _by_id(bbit_minhash.duplicate_components(spark.createDataFrame(rows, "doc_id bigint, text string")))
    sets = {i: {tuple(w[j:j + 5]) for j in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    for i, s in sets.items():
        linked = [j for j, q in sets.items() if 100 * len(s & q) >= 75 * len(s | q)]
        assert got[i].component_id <= min(linked)


def test_components_of_path_star_and_loop(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (7, 8)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


def test_order_minhash(docs):
    rows = [r for r in _rows() if r[0] is not None][:-1]
    got = _by_id(order_minhash.edited_fingerprints(docs))
    texts = sorted(((r[0], r[1] or "") for r in rows), reverse=True)
    for (i, t), (_, after) in zip(texts[:-1], texts[1:]):
        if i == 0 or after == "" and i == 1:
            continue
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert len(got[i].fingerprint) == 4 * order_minhash.SAMPLES
    assert got[4].fingerprint == got[5].fingerprint and got[6].fingerprint == got[19].fingerprint
    assert got[4].near_edited == 1.0 and got[3].near_edited > got[3].near_next


def test_order_minhash_feels_order(spark):
    rng = random.Random(2)
    w = _prose(600, rng).split(" ")
    moved = w[300:] + w[:300]
    few = list(w)
    few[10] = "zz"
    df = spark.createDataFrame([(0, " ".join(w)), (1, " ".join(few)), (2, " ".join(moved))], "doc_id bigint, t string")
    s = {r.doc_id: r.s for r in order_minhash.with_samples(df, "t", "s").collect()}
    same = lambda a, b: sum(x == y for x, y in zip(s[a], s[b])) / 64
    assert same(0, 1) > 0.9 and 0.2 < same(0, 2) < 0.8


def test_quality_held_out_accuracy(spark):
    got = queries.op3_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    n, right = got.agg(F.count("*"), F.sum((F.col("predicted") == F.col("quality")).cast("int"))).first()
    assert n > 10 and right / n >= 0.95


def test_quality_without_labels_keeps_all(docs, empty, spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    kept = preference_quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert preference_quality.score_documents(docs, None).where("predicted = 1").count() == docs.count()


def test_patience_alignment_and_licenses(spark):
    a, b = "x the license of y is mit so it is".split(), "the license is mit".split()
    pairs = patience_license.patience(a, b)
    assert [b[j] for _, j in pairs] == b and pairs == sorted(pairs)
    mit = "Released under the MIT License."
    rows = [(0, f"{PASSAGE} {mit} {PASSAGE}"), (1, f"{mit}\n{mit}"), (2, "the mit license"), (3, None), (4, ""),
            (5, patience_license.TEMPLATES["MIT-notice"] + " " + patience_license.TEMPLATES["Apache-2.0"])]
    got = _by_id(patience_license.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got[0].license == "MIT" and got[0].coverage == 1.0 and got[1].license == "MIT"
    assert got[2].license is None and got[3].license is None and got[4].licenses == []
    assert got[5].licenses == ["Apache-2.0", "MIT-notice"]


def test_suffix_search_equals_brute_force(docs, spark):
    items = [("a", " ".join(PASSAGE.split(" ")[5:30])), ("b", "one"), ("c", "two words"), ("d", None), ("e", "..."), (None, "hunter2hunter"),
             ("f", "x " * 12), ("b", "one")]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    bench = spark.createDataFrame(items, "item_id string, text string")
    for options in ({}, {"shard_words": 50}, {"chunk_words": 3}):
        got = _by_id(suffix_decontamination.contamination(docs, bench, **options))
        for i, t in _texts().items():
            w, hit, names = low(t), set(), set()
            for name, item in items:
                x = low(item)
                k = min(10, len(x))
                for j in range(len(x) - k + 1 if k else 0):
                    for p in range(len(w) - k + 1):
                        if w[p:p + k] == x[j:j + k]:
                            hit.update(range(p, p + k))
                            names.add(name)
            names = sorted(n for n in names if n is not None)
            assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (
                len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)), (i, options)
    left = suffix_decontamination.remove_contaminated(docs, bench)
    assert left.columns == docs.columns and left.where("doc_id in (10, 11, 6, 19)").count() == 0
    none = suffix_decontamination.contamination(docs, bench.limit(0))
    assert none.where("contaminated").count() == 0 and none.count() == docs.count()


def test_secret_spans(docs):
    got = _by_id(secret_scan.secret_report(docs))
    assert (got[15].n_assign, got[15].n_access, got[15].n_hex) == (1, 1, 1) and got[16].n_assign == 0
    assert got[17].spans == "guess:5:16" and got[17].n_assign == 0 and got[5].spans == ""
    assert secret_scan.guess_cost("password123") < 5 < 8 < secret_scan.guess_cost("Xk9#mQ2$vL7!")
    assert secret_scan.guess_cost("20240131") < 6 and secret_scan.guess_cost("qwertyuiop") < 5 and secret_scan.guess_cost("") == 0
    assert secret_scan.guess_cost("a" * 100_000) < 10


def _jaccard_lines(rows, percent, least):
    seen, out = [], {}
    for i, t in sorted((r for r in rows if r[0] is not None)):
        if t is None:
            out[i] = None
            continue
        kept = []
        for n, line in enumerate(t.split("\n")):
            s = set(line.lower().split(" "))
            gone = len(line) >= least and any(100 * len(s & q) >= percent * len(s | q) for q in seen)
            if len(line) >= least:
                seen.append(s)
            if not gone:
                kept.append(line)
        out[i] = "\n".join(kept)
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    lines = [_prose(rng.randint(1, 25), rng) for _ in range(40)]
    rows = []
    for i in range(60):
        part = []
        for _ in range(rng.randint(0, 6)):
            w = rng.choice(lines).split(" ")
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = rng.choice(_VOCAB)
            part.append(" ".join(w))
        rows.append((i, "\n".join(part)))
    rows += [(60, None), (61, "")]
    df = spark.createDataFrame([(*r, "k", "u") for r in rows], "doc_id bigint, text string, id string, line string")
    for percent in (70, 90):
        got = line_set_dedup.dedup_lines(df, percent=percent, min_chars=12)
        assert got.columns == [*df.columns, "n_lines", "n_removed"]
        assert {r.doc_id: r.text for r in got.collect()} == _jaccard_lines(rows, percent, 12)


def test_line_dedup_takes_short_lines_and_copies_of_three_quarters(spark):
    base = [f"w{i}" for i in range(16)]
    near, far = " ".join(base[:14] + ["x", "y"]), " ".join(base[:13] + ["p", "q", "r"])  # 14 of 18, 13 of 19 in common
    rows = [(1, " ".join(base) + "\nEnd\n\n \n終わり"), (2, near + "\nEnd\n\n \nkept"), (3, far + "\n終わり\nend")]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_set_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("\n \nkept", 2), 3: (far, 2)}


def test_line_dedup_keeps_documents_of_one_id_apart_and_replaces_clashing_counts(spark):
    rows = [(1, "one two three four", "a"), (2, "one two three four", "b"), (2, "a wholly different unique line", "c"), (2, "a wholly different unique line", "c"),
            (None, "one two three four", "d"), (3, "", "e"), (4, None, "f"), (5, "one two three four\nwords " + "long " * 3 + "x" * 100_000, "g")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_lines string")
    got = line_set_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed"]
    assert sorted((r.doc_id or 0, r.text or "", r.n_lines, r.n_removed) for r in got.collect()) == sorted(
        [(1, rows[0][1], 1, 0), (2, "", 1, 1), (2, rows[2][1], 1, 0), (2, rows[2][1], 1, 0), (0, rows[4][1], 1, 0), (3, "", 1, 0), (4, "", 0, 0), (5, rows[7][1].split("\n")[1], 2, 1)])
    assert line_set_dedup.dedup_lines(df.limit(0)).collect() == []


def test_line_dedup_of_groups_equals_brute_force(spark):
    """Groups of near copies, settled lines as the only source of later ones, lengths from 1 to 60 tokens."""
    rng = random.Random(7)
    rows = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(90)}" for _ in range(rng.randint(1, 60))]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 5)):
                k = rng.randrange(len(w))
                w[k:k + 1] = rng.choice([[], ["the"], [f"v{rng.randrange(300)}"], [w[k], f"v{rng.randrange(300)}"]]) or [w[k]]
            rows.append(" ".join(w))
            base = w if rng.random() < 0.3 else base
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    for percent in (60, 75, 85):
        got = line_set_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=percent)
        want = _jaccard_lines(rows, percent, 1)
        assert {r.doc_id: r.text for r in got.collect()} == want and 20 < sum(t == "" for t in want.values()) < 160


def test_language_model_base_and_fold(docs):
    got = _by_id(log_bilinear.score(docs))
    tokens = {i: [*_words(t), "\n"] for i, t in _texts().items()}
    counts = collections.Counter()
    for r in _rows():
        if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 != 2:
            counts.update([*_words(r[1] or ""), "\n"])
    n, v = sum(counts.values()), len(counts)
    for i, w in tokens.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert got[i].score <= 0


def test_language_model_is_normalised():
    counts = np.zeros(log_bilinear.UNITS, dtype=np.int64)
    counts[[1, 5, 9, log_bilinear.END]] = [4, 2, 1, 3]
    table = log_bilinear.Model.first(counts).log10_table(counts)
    assert np.allclose((10.0 ** table).sum(axis=1), 1, atol=1e-4) and np.isneginf(table[:, 2]).all()


def test_language_model_words_of_a_unit_sum_to_one():
    rng = np.random.default_rng(1)
    unit = rng.integers(90, 100, 500)
    total = (1000 / rng.integers(1, 500, 500)).astype(np.int64) + 1
    part = dict(zip(log_bilinear.TREE, log_bilinear._piece(*log_bilinear._trees(unit, total, rng.permutation(500)))), bucket=0)
    model = log_bilinear.Model.first(np.ones(log_bilinear.UNITS, dtype=np.int64))
    words = log_bilinear.Words({"parts": [part]})
    ctx = np.full(500, 3), np.full(500, 4), np.full(500, 95), np.full(500, 96)
    logs = words.log10(model, np.arange(500), *ctx)
    share = total / np.bincount(unit, weights=total)[unit]
    assert np.allclose(10 ** logs, share, rtol=1e-3)  # before the training
    words.own[:], words.node[:] = rng.normal(0, 1, words.own.shape), rng.normal(0, 1, words.node.shape)
    learnt = 10 ** words.log10(model, np.arange(500), *ctx)
    assert not np.allclose(learnt, share, rtol=0.1) and np.allclose(np.bincount(unit, weights=learnt)[90:], 1, atol=1e-4)


def test_language_model_learns_rare_words_by_the_word_before(spark):
    """Pairs of rare words: given the first, the second is sure; the units of
    the pairs' first words are shared with many other words."""
    rng = random.Random(2)
    firsts = [f"first{i}" for i in range(1500)]
    text = lambda: " ".join(f"{w} {w.replace('first', 'second')}" for w in rng.sample(firsts, 300))
    other = lambda: " ".join(f"{w} {rng.choice(firsts).replace('first', 'second')}" for w in rng.sample(firsts, 300))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(i, other() if i in held[::2] else text()) for i in range(400)]
    got = _by_id(log_bilinear.score(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)))
    like, unlike = (np.mean([got[i].score / got[i].n_tokens for i in at]) for at in (held[1::2], held[::2]))
    assert like > unlike + 0.1


def test_empty_tables(empty, spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert byte_bpe.token_digests(empty, path, public_tokenizers.PATTERN).count() == 0
    assert rans_store.round_trip(empty, public_tokenizers.path("word_bpe_49k.json"), 2).count() == 0
    for f in (bbit_minhash.duplicate_components, order_minhash.edited_fingerprints, patience_license.scan_licenses,
              secret_scan.secret_report, line_set_dedup.dedup_lines, log_bilinear.score):
        assert f(empty).count() == 0, f
    assert suffix_decontamination.contamination(empty, bench).count() == 0


def test_pipeline_stages_keep_columns(spark):
    cols = spark.read.parquet(f"{SF}/documents.parquet").columns
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == cols and 0 < docs.count() <= before, name
        before = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.decoded_sha256 for r in out.collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}


def test_parities_never_rule_out_a_similar_pair(spark):
    rng = random.Random(3)
    for n in (1, 8, 200, 4000):
        base = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], dtype=np.uint64))
        for _ in range(30):
            other = np.union1d(base[rng.randint(0, max(0, n // 7)):], np.array([rng.getrandbits(64) for _ in range(rng.randint(0, n // 6))], dtype=np.uint64))
            both = len(np.intersect1d(base, other))
            unequal = int(np.bitwise_count((bbit_minhash.parities(base) ^ bbit_minhash.parities(other)).view(np.uint64)).sum())
            assert unequal <= len(base) + len(other) - 2 * both
            if 100 * both >= bbit_minhash.LIMIT * (len(base) + len(other) - both):
                assert unequal * (100 + bbit_minhash.LIMIT) <= (len(base) + len(other)) * (100 - bbit_minhash.LIMIT)


def test_minhash_members_around_a_large_group(spark):
    """A group of near copies with texts around it that are near but not
    linked, and others linked only through a chain."""
    rng = random.Random(11)
    base = _prose(110, rng).split(" ")
    texts = []
    for i in range(220):
        words = list(base)
        for at in rng.sample(range(len(words)), rng.choice([1, 1, 2, 2, 3, 4, 6])):
            words[at] = f"w{i}x{at}"
        texts.append(" ".join(words))
    got = {r.doc_id: r.component_id for r in bbit_minhash.duplicate_components(
        spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    sets = [{tuple(t.split()[j:j + 5]) for j in range(len(t.split()) - 4)} for t in texts]
    want = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and want[a] != want[b]:
                low, high = sorted((want[a], want[b]))
                want = [low if w == high else w for w in want]
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) > 1


def test_pipeline_tokens_encode_and_decode_in_tasks_of_their_own(spark):
    """Two Python steps in one task held twice the workers, which outlived the stage."""
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id bigint, text string")
    out = corpus_pipeline.tokens(spark, docs, SF)
    assert "MapInArrow" not in out._jdf.queryExecution().toString()
    assert {r.doc_id: r.decoded_sha256 for r in out.collect()} == {i: hashlib.sha256(t).hexdigest() for i, t in ((1, b"some words"), (2, b""))}
