"""The training-data operators against brute force, round trips and edge cases."""

import base64
import hashlib
import json
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keylattice.llm import bpe, common, html_text, jaccard_join, media, mixing, quality, registry, token_store, toxicity, url_filter, vector_search
from keylattice.llm.components import connected_components

DIR = "/root/testdata/sf0.001"
TEXTS = [None, "", " \n\t", "one", "a b c d", "a b c d e f", "a b c d e f", "A B c d e f", "it's 12 é≠ “x” \x01 \x00", "word " * 3000, "x" * 70_000, "\x1c tab\tand\r\nlines"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, long and repeated texts, and columns that clash with those of results."""
    rows = [(i, t, "s", "old") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score string")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("pages", "embeddings", "documents", "benchmark", "conversations"):
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DIR)
    want = c.sql(registry.ORACLE_SQL[name])
    assert sorted(map(str, map(tuple, df.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_top_k_ties_and_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 9.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [tuple(r) for r in vector_search.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 256 * 128), (0, 2, 2, 256 * 128)]
    assert vector_search.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def _brute_top(rows, asks, k=5):
    ready = {(i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = {}
    for i, q in ready:
        if asks(i):
            out.setdefault(i, set()).update((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in ready if j != i and len(x) == len(q))
    return sorted((i, r + 1, j, -s) for i, found in out.items() for r, (s, j) in enumerate(sorted(found)[:k]))


def test_top_k_equals_brute_force_and_evaluates_little(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "PAGE", 3)
    monkeypatch.setattr(vector_search, "SAMPLE", 200)
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(12, 8)) * 6
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=8) * 0.05]) for i in range(1500)]
    rows += [(i, rows[i % 100][1]) for i in range(1500, 1600)] + [(7, rows[7][1]), (7, rows[8][1]), (None, rows[0][1]), (1700, None)]  # ties, repeated rows and ids, nulls
    rows += [(2000 + i, [float(x) for x in rng.normal(size=3)]) for i in range(9)] + [(3000 + i, [5e5 * (i + 1), -4e5 * i]) for i in range(4)]  # other dimensions, large numbers
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("near", F.lit("x")).repartition(5)
    got = vector_search.top_k(df, F.col("vec_id") % 50 < 8, block=64, evaluated=True).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == _brute_top(rows, lambda i: i % 50 < 8)
    tried = {r.query_id: r.evaluated for r in got if r.query_id < 1500}
    assert sum(tried.values()) < 0.2 * len(tried) * 1600
    assert sorted(map(tuple, vector_search.top_k(df, F.col("vec_id") % 50 < 8, pivots=0).collect())) == sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


def test_quality_and_toxicity_on_odd_texts(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int")
    for got in (quality.score_quality(odd, labels), toxicity.score_toxicity(odd, labels), quality.score_quality(odd, labels.limit(0)), toxicity.score_toxicity(odd, labels.limit(0))):
        rows = got.collect()
        assert len(rows) == len(TEXTS)
        assert all(0 <= r.score <= 1 and r.source == "s" for r in rows)
    assert quality.score_quality(odd.limit(0), labels).count() == 0


def test_crf_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    e, trans = rng.normal(size=5), rng.normal(size=(2, 2))
    rows = np.array([0, 0, 0, 1, 1])
    good, _ = quality.marginals(e, trans, rows)
    for at in ([0, 1, 2], [3, 4]):
        total, hit = 0.0, np.zeros(len(at))
        for code in range(2 ** len(at)):
            y = [code >> k & 1 for k in range(len(at))]
            p = np.exp(sum(e[i] * v for i, v in zip(at, y, strict=True)) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
            total, hit = total + p, hit + p * np.array(y)
        assert np.allclose(good[at], hit / total)


def test_chains_of_any_length_equal_forward_backward(monkeypatch):
    rng = np.random.default_rng(14)
    for few, sizes in ((2, [1, 5, 40, 41, 3, 300]), (16, [7]), (16, [2] * 30 + [90, 1]), (1, [4, 4])):
        monkeypatch.setattr(quality, "FEW", few)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        e, trans = rng.normal(size=len(rows)) * 3, rng.normal(size=(2, 2))
        assert np.allclose(quality.good_lines(e, trans, rows), quality.marginals(e, trans, rows)[0])
    assert len(quality.good_lines(np.zeros(0), np.zeros((2, 2)), np.zeros(0, int))) == 0


def test_quality_query_equals_brute_force(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{DIR}/labels.parquet")
    label = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    texts = {r.doc_id: r.text for r in docs.collect()}
    sample = sorted(((i, t, label[i]) for i, t in texts.items() if i in label and t is not None and len(t) <= quality.MAX_CHARS), key=lambda r: (r[2], r[0]))
    model = quality.train(sample)
    rows = quality.op2_quality(spark, DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = np.frombuffer((texts[r.doc_id] or "").encode(), np.uint8)
        x, length, _ = quality.line_features(data, np.array([0, len(data)]))
        want = model.empty
        if len(x):  # sums over all paths, line by line, in logarithms
            em = x @ model.weights
            f, b = [np.array([0, em[0]])], [np.zeros(2)]
            for v in em[1:]:
                f.append(np.logaddexp(f[-1][0] + model.trans[0], f[-1][1] + model.trans[1]) + [0, v])
            for v in em[:0:-1]:
                n = b[-1] + [0, v]
                b.append(np.logaddexp(model.trans[:, 0] + n[0], model.trans[:, 1] + n[1]))
            both = np.array(f) + np.array(b[::-1])
            good = 1 / (1 + np.exp(both[:, 0] - both[:, 1]))
            want = 1 / (1 + np.exp(-(model.slope * (length @ good) / length.sum() + model.offset)))
        assert abs(r.score - want) < 1e-6 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def _vectors_of(index):
    """Dense vectors of the examples, by place."""
    dense = np.zeros((index.size, len(index.word)))
    for t in range(len(index.word)):
        lo, hi = index.post_start[t], index.post_start[t + 1]
        dense[index.post_row[lo:hi], t] = index.post_weight[lo:hi]
    return dense


@pytest.mark.parametrize("common", [2, 20, 10**9])
def test_toxic_neighbours_are_exact(monkeypatch, common):
    monkeypatch.setattr(toxicity, "COMMON", common)
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    rng = random.Random(2)
    vocabulary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(160)]
    sample = [(i, " ".join(rng.choices(vocabulary[i % 20 * 8 : i % 20 * 8 + 8], k=4) + [f"lead{chr(97 + i % 20)}"] * 5 + ["the"] * (i % 3)), i % 2) for i in range(400)] + [(1000 + i, "the waax waax", 0) for i in range(30)]
    index = toxicity.BlockMaxIndex(sample, neighbours=16)
    assert index.size and index.k == 16
    for texts in ([], [b""], [b"zzz"]):  # pieces without any term of the vocabulary
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        assert (index.documents(np.frombuffer(b"".join(texts), np.uint8), offsets)[0] == index.base).all()
    dense = _vectors_of(index)
    index.derive()
    queries = dense[::7]
    row, term = np.nonzero(queries)
    score = index.admitted(row, term, queries[row, term], len(queries), index.k)
    assert (score == -1).mean() > 0.5  # blocks ruled out by their bounds
    for i, q in enumerate(queries):
        s, near, _ = index.nearest(np.flatnonzero(q), q[q > 0], score[i], index.k)
        scores = dense @ q
        want = [k for k in np.lexsort((np.arange(len(scores)), -scores.round(12))) if scores[k] > 0][: index.k]
        assert np.allclose(s, scores[want])


def _tfidf_by_hand(sample):
    """Unit vectors of (text, toxic) examples, and a function that makes one of any text, term by term."""

    def counted(text):
        counts = {}
        for w in re.findall(rb"[a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())):
            counts[w] = counts.get(w, 0) + 1
        return counts

    found = [counted(t) for t, _ in sample]
    df = {}
    for v in found:
        for t in v:
            df[t] = df.get(t, 0) + 1
    weights = {t: np.log((1 + len(sample)) / (1 + n)) + 1 for t, n in df.items()}

    def vector(counts):
        out = {t: (1 + np.log(c)) * weights[t] for t, c in counts.items() if t in weights}
        length = np.sqrt(sum(x * x for x in out.values()))
        return {t: x / length for t, x in out.items()}

    return [vector(v) for v in found], lambda text: vector(counted(text)), len(df)


def _by_hand(ids, labels, examples, vector, k, model, share, text):
    """Score and (similarity of each example) of a text, from plain dictionaries; None without a neighbour."""
    mine = vector(text)
    scores = {i: sum(x * e.get(t, 0) for t, x in mine.items()) for i, e in zip(ids, examples, strict=True)}
    of = dict(zip(ids, examples, strict=True))
    near = [i for i in sorted(scores, key=lambda i: -scores[i]) if scores[i] > 0][:k]
    if not near:
        return None, scores
    weight = {i: 1 / (1.05 - min(scores[i], 1)) for i in near}
    weight = {i: w * len(near) / sum(weight.values()) for i, w in weight.items()}
    toxic = sum(w for i, w in weight.items() if labels[i])
    expected, lean = (toxic / len(near) + share) / 2, []
    for t in mine:
        one = sum(w for i, w in weight.items() if labels[i] and t in of[i])
        none = sum(w for i, w in weight.items() if not labels[i] and t in of[i])
        lean.append(np.log((one + 2 * expected) / (none + 2 * (1 - expected))) - np.log(expected / (1 - expected)))
    whole = (toxic + share) / (len(near) + 1)
    x = [np.log(whole / (1 - whole)), *sorted([*lean, 0, 0] if len(lean) < 2 else lean, reverse=True)[:2], 1]
    if len(lean) == 1:
        x[1:3] = lean[0], 0
    return 1 / (1 + np.exp(-np.dot(x, model))), scores


def test_toxicity_uses_all_words_of_whole_texts():
    rng = random.Random(9)
    vocabulary = [f"{a}{b}word" for a in "abcdefghij" for b in "klmnopqrst"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(3, 60)) + ["idiot"] * (i % 5 == 0)) + f" only{'xyzw'[i % 4]}{chr(97 + i % 26)}" for i in range(400)]
    sample = [(i, t, int(i % 5 == 0)) for i, t in enumerate(texts)]
    index = toxicity.BlockMaxIndex(sample, neighbours=30)
    index.calibrate()
    assert index.size == len(texts) and set(index.labels) == {0, 1} and index.model is not None
    examples, vector, terms = _tfidf_by_hand([(t, y) for _, t, y in sample])
    assert len(index.word) == terms
    queries = ["akword", "zzz akword idiot blword " * 3, "ONLYXA", *texts[::40]]
    data = [q.encode() for q in queries]
    score, evidence = index.documents(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64))
    ids, labels = list(range(400)), {i: y for i, _, y in sample}
    for q, s, own in zip(queries, score, evidence.to_pylist(), strict=True):
        want, scores = _by_hand(ids, labels, examples, vector, 30, index.model, index.share, q)
        best = sorted((x for x in scores.values() if x > 0), reverse=True)[: toxicity.EVIDENCE]
        assert np.allclose([e["similarity"] for e in own], best, atol=1e-6) and np.allclose([scores[e["example"]] for e in own], best, atol=1e-6)
        assert abs(s - want) < 1e-4 or len(set(np.round(sorted(scores.values())[-31:-29], 9))) == 1  # unless the last voters tie


def test_toxicity_query_equals_brute_force(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{DIR}/labels.parquet")
    label = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    found = toxicity.labelled_sample(docs, labels, "toxic", toxicity.id_bucket("doc_id", 4) != 2, 3000, 20_000)[0]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(i for i, _, _ in found) == sorted(i for i in label if i in texts)
    assert all((texts[i] or "") == t or len(t) == 20_000 and t in texts[i] for i, t, _ in found)
    rows = toxicity.score_toxicity(docs, labels).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(bool(r.evidence) for r in held) > len(held) // 2
    examples, vector, _ = _tfidf_by_hand([(t, y) for _, t, y in found])
    place = {i: k for k, (i, _, _) in enumerate(found)}
    for r in rows[::5]:
        mine = vector(r.text)
        scores = np.array([sum(x * e.get(t, 0) for t, x in mine.items()) for e in examples])
        want = np.sort(scores[scores > 0])[::-1][: toxicity.EVIDENCE]
        assert np.allclose([g["similarity"] for g in r.evidence], want, atol=1e-6) and np.allclose(scores[[place[g["example"]] for g in r.evidence]], want, atol=1e-6)
    query = {r.doc_id: r for r in toxicity.op5_toxicity(spark, DIR).collect()}
    assert len(query) == len(rows)
    assert all(abs(query[r.doc_id].score - r.score) < 1e-9 and query[r.doc_id].predicted == (r.score >= 0.3) and query[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_toxicity_votes_are_calibrated():
    rng = random.Random(10)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    sample = [(i, " ".join([*rng.choices(words, k=30), *["idiot", "clown"][: i % 3 == 0 and 2]]), int(i % 3 == 0)) for i in range(600)]
    index = toxicity.BlockMaxIndex(sample, prior=0.1)
    index.calibrate()
    assert (index.model[:2] > 0).all()
    texts = [" ".join(rng.choices(words, k=30)).encode() for _ in range(100)] + [(" ".join(rng.choices(words, k=30)) + " clown idiot").encode() for _ in range(20)]
    score, _ = index.documents(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
    assert (score[:100] < 0.3).mean() > 0.95 and (score[100:] >= 0.3).all()


def test_sample_of_few_labels_and_long_texts(spark):
    """Labels without a document take no place in the sample, and long texts are cut for fitting, not left out."""
    rng = random.Random(11)
    good, bad = [f"good{chr(97 + i)}" for i in range(20)], [f"vile{chr(97 + i)}" for i in range(20)]
    docs = spark.createDataFrame([(i, "\n".join(" ".join(rng.choices(bad if i % 2 else good, k=9)) + ("!!! $$$" if i % 2 else ".") for _ in range(600))) for i in range(100)] + [(200, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0), i % 2) for i in range(5000)] + [(200, 1, 0)], "doc_id long, quality int, toxic int")
    train = common.id_bucket("doc_id", 4) != 2
    sample, share = common.labelled_sample(docs, labels, "toxic", train, 3000, 20_000)
    usable = [i for i in [*range(100), 200] if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sorted(i for i, _, _ in sample) == usable and abs(share - sum(i % 2 for i in usable[:-1]) / len(usable)) < 1e-9
    assert all(len(t) == 20_000 for i, t, _ in sample if i != 200) and len({t.index("a") for i, t, _ in sample if i != 200}) > 1
    few, _ = common.labelled_sample(docs, labels, "toxic", train, 20, 100)
    assert len(few) == 20 and sum(y for _, _, y in few) == 10
    for r in toxicity.score_toxicity(docs, labels).where("doc_id < 100").collect():
        assert r.predicted == r.doc_id % 2
    for r in quality.score_quality(docs, labels).where("doc_id < 100").collect():
        assert r.predicted == 1 - r.doc_id % 2


def test_media_round_trip_and_general_decoder():
    rng = random.Random(3)
    payloads = [b"", b"a", bytes(range(256)) * 2, rng.randbytes(3000), b"\0" * 500, b"\x01\x02\x00" * 99, "“é”\n".encode() * 50]
    for text in payloads:
        payload = media.payload_of(text)
        assert len(payload) % 64 == 0 and payload
        parts, factors, size, steps, comment = media.decode_jpeg(media.encode_jpeg(payload))
        assert media.payload_from(parts, comment) == payload
        rgb = media.rgb_tensor(parts, factors, size, steps)
        assert rgb.shape == (*size, 3)
    c = np.zeros((1, 1, 64), np.int16)
    c[0, 0, 0] = 80  # a constant block of 80 / 8
    none = np.zeros((1, 1, 64), np.int16)
    assert (media.rgb_tensor([c, none, none], [(1, 1)] * 3, (8, 8), [np.ones(64, int)] * 3) == 138).all()


def test_media_has_no_slow_text():
    every = "".join(map(chr, range(0x80))) * 3 + "".join(map(chr, [0x80, 0xFF, 0x100, 0x7FF, 0x800, 0xD7FF, 0xE000, 0xFFFF, 0x10000, 0x10FFFF]))
    blocks = np.frombuffer(media.payload_of(every.encode()), np.uint8)
    c = media.TO_COEFFICIENT[blocks]
    assert len(set(media.TO_COEFFICIENT.tolist())) == 256 and (np.abs(c) >= 2).all() and (c > -128).all()
    for units in [1, 5, 32, 33, 64, 65, 1000, 127_999, 200_000]:
        w, h = media.geometry(6 * units)
        assert units <= w * h < units + h and 16 * w < 1 << 16 and h <= 4000


def test_media_query(spark, odd):
    path = token_store.shared_path(spark, "media-test")
    rows = odd.unionByName(odd.where("doc_id < 6").withColumn("doc_id", F.lit(None).cast("long")))
    media.store_media(rows, path)
    pictures = {r.doc_id: r.media for r in spark.read.parquet(path).where("doc_id is not null").collect()}
    got = media.read_media(spark, path).collect()
    assert len(got) == len(TEXTS) + 6
    for r in got:
        if r.doc_id is None:
            continue
        text = (TEXTS[r.doc_id] or "").encode()
        payload = media.payload_of(text)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(pictures[r.doc_id]), hashlib.sha256(pictures[r.doc_id]).hexdigest())
        rgb = media.rgb_tensor(*media.decode_jpeg(pictures[r.doc_id])[:4])
        assert (r.height, r.width, 3) == rgb.shape and bytes(r.rgb) == rgb.tobytes() and r.feature == media.feature_of(rgb)
    none = token_store.shared_path(spark, "media-none")
    media.store_media(odd.limit(0), none)
    assert media.read_media(spark, none).count() == 0


def test_token_store(spark, odd):
    path = token_store.shared_path(spark, "store-test")
    token_store.write_store(odd, path)
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in token_store.read_store(spark, path).collect()}
    at = 0
    for i, t in enumerate(TEXTS):
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_store_encodes_words_of_letters_by_the_model_alone(spark):
    """Most words are letters alone, which the vocabulary's rules leave whole: they need no normaliser and no pre-tokeniser."""
    path = public_tokenizers.path(token_store.VOCABULARY)
    with open(path, encoding="utf-8") as f:
        vocabulary = f.read()
    letters = token_store.whole_letters(vocabulary)
    assert len(letters) == 26 + 32 and letters[ord("a")] == "a" and letters[ord("ß")] == "ÃŁ"
    coder = Tokenizer.from_str(vocabulary)
    words = ["a", "the", "straße", "ñandú", "ÿ", "Ünder", "e\u0301t", "x÷y", "don't", "'ll", "ſtil", "ﬁn", "a1b", "1", "..", "日本", "\x01", "a\x01b", "İstanbul", "thesßäñ" * 300]
    words += ["".join(random.Random(i).choices([*map(chr, letters)], k=1 + i % 40)) for i in range(3000)]
    encode = token_store.word_encoder(spark, path)()
    assert encode(words) == [coder.encode(w, add_special_tokens=False).ids for w in words]
    rules = json.loads(vocabulary)
    for other in (rules | {"normalizer": {"type": "NFKD"}}, rules | {"pre_tokenizer": {"type": "Whitespace"}}, rules | {"pre_tokenizer": None}, rules | {"added_tokens": [{"content": "the"}]}):
        assert token_store.whole_letters(json.dumps(other)) is None


def test_token_store_keeps_special_strings(spark):
    a, b = "<|startoftext|>", "<|endoftext|>"
    texts = [f"end {b} x", f"A{b}B", b, a + b, f" {b}{b} it's{a}'s", f"é{b}\u0301 {b.upper()} <|EndOfText|>", f"<{b}> <|end {b}\n", "<|endof", "text|> x", f"x{a}", f"{b[:-1]} {b}", f"1{a}2 \t{b}\t", "word " * 9 + b]
    texts += [f"{t} tail" for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    path = token_store.shared_path(spark, "special-test")
    token_store.write_store(docs, path)
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_store.read_store(spark, path).collect()}
    for i, t in enumerate(texts):
        ids = np.array([*coder.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes())), t


def test_token_store_gives_ids_back_and_misses_nothing(spark, odd):
    path = token_store.shared_path(spark, "store-ids")
    long = " ".join(f"w{i}" for i in range(20_000))
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(50, long), (51, "a b"), (51, "c"), (None, "d"), (52, long + " x")], "doc_id long, text string"))
    token_store.write_store(docs, path)
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((str(r.doc_id), [*coder.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in docs.collect())
    assert sorted((str(r.doc_id), r.ids) for r in token_store.read_ids(spark, path).collect()) == want
    chunks = spark.read.parquet(f"{path}/chunks").toPandas()
    recipes = spark.read.parquet(f"{path}/recipes")
    assert chunks.address.map(bytes).is_unique and len(chunks) < recipes.select(F.sum(F.size("addresses"))).first()[0]
    for what in ("missing", "damaged"):
        other = token_store.shared_path(spark, f"store-{what}")
        recipes.write.parquet(f"{other}/recipes")
        odd_chunks = chunks.iloc[1:] if what == "missing" else chunks.assign(payload=[bytes(p) if i else b"xx" + bytes(p)[2:] for i, p in enumerate(chunks.payload)])
        spark.createDataFrame(odd_chunks, "address binary, unit int, payload binary").write.parquet(f"{other}/chunks")
        for read in (token_store.read_store, token_store.read_ids):
            with pytest.raises(Exception, match="chunk"):
                read(spark, other).collect()
    assert token_store.unit_of(1 << 16) == 2 and token_store.unit_of((1 << 16) + 1) == 4


def test_token_store_and_bpe_of_nothing(spark, odd):
    none = odd.limit(0)
    path = token_store.shared_path(spark, "store-none")
    token_store.write_store(none, path)
    assert token_store.read_store(spark, path).count() == 0
    assert bpe.encode_documents(none, tokens=True).collect() == []


def test_words_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i % 3, "a b c" if i % 2 else "", i, "x", f"n{i}") for i in range(40)], "doc_id long, text string, key long, check string, c0 string").repartition(3)
    got = bpe.encode_documents(docs)
    assert got.columns == ["doc_id", "key", "check", "c0", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((r.key, r.doc_id, r.check, r.c0, r.n_tokens) for r in got.collect()) == [(i, i % 3, "x", f"n{i}", 3 * (i % 2)) for i in range(40)]


def test_chunks_follow_content():
    ids = np.random.default_rng(4).integers(0, 40_000, 20_000)
    a, b = token_store.cuts(ids), token_store.cuts(np.concatenate([[7] * 333, ids]))
    assert a[-1] == 20_000 and len({x + 333 for x in a} & set(b)) > len(a) // 2
    assert token_store.crc_combine(zlib.crc32(b"ab"), zlib.crc32(b"cde"), 3) == zlib.crc32(b"abcde")


def test_byte_bpe(spark, odd):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.encode_documents(odd, tokens=True).collect():
        want = coding.encode_ordinary(TEXTS[r.doc_id] or "")
        assert r.tokens == want
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()


def test_byte_bpe_of_mixed_white_space(spark):
    units = [" \u00a0", "\u00a0 ", " \t", "\t ", " \n", "\n ", " \r", " \u2003", "\x1c ", " \x1c", " \x85", " \u200b"]
    texts = ["a" + u * k + end for u in units for k in (1, 2, 3, 4, 8) for end in ("b", " b", "", " b c")] + ["a b\u00a0c d", "\u00a0 a b", "a b\t"]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in bpe.encode_documents(docs, tokens=True).collect()}
    assert [got[i] for i in range(len(texts))] == [coding.encode_ordinary(t) for t in texts]


def test_html():
    w = html_text.train([])
    page = '<html><head><title>x</title><script>"<p>no</p>"</script></head><body><nav><a href=x>a</a></nav><div class="cookie-notice">We use cookies.</div><article><h1>T &amp; U</h1><p>Some text,\n with  words.</p><p>More text.<section id="comments"><p>nice!</p></section></article><footer>c</footer>'
    assert html_text.main_text(page, w) == "T & U\nSome text, with words.\nMore text."
    assert html_text.main_text("", w) == ""


def test_html_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(300):  # against all labellings of random trees of elements
        n, stack, opened, parents = rng.randint(1, 9), [0], 0, []
        while len(parents) < n:
            what = rng.random()
            if what < 0.3:
                opened += 1
                stack.append(opened)
            elif what < 0.5 and len(stack) > 1:
                stack.pop()
            else:
                parents.append(stack[-1])
        gain = [rng.choice([rng.uniform(-2, 2), rng.uniform(-0.3, 0.3)]) for _ in range(n)]
        last, edges = {}, [(i, i + 1, html_text.NEXT) for i in range(n - 1)]
        for i, p in enumerate(parents):
            if p in last:
                edges.append((last[p], i, html_text.SIBLING))
            last[p] = i
        cost = lambda side: sum(abs(g) for g, s in zip(gain, side, strict=True) if s != (g > 0)) + sum(c for a, b, c in edges if side[a] != side[b])  # noqa: B023, E731
        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(2**n))
        assert abs(cost(html_text.min_cut(gain, parents)) - best) < 1e-9


def test_html_marks():
    w = html_text.train([])
    body = "<article><h1>A heading</h1><p>Some text, with words and more words.</p>{}<p>More text, with other words at the end.</p></article>"
    for kept in ('<div class="search-intro"><p>Here is what was found, in some words.</p></div>', '<div class="legal-analysis"><p>The law says many words here.</p></div>', "<p>Let <math>x+1</math> be it, in this sentence.</p>", "<p>An <object>object with a text</object> in this sentence.</p>", "<p><canvas>A picture, in words that stay here.</canvas></p>", "<noscript><p>Words for those without scripts are here.</p></noscript>", '<p>It has <span class="ad">an ad</span> in the middle of a sentence that is longer than it.</p>'):
        got = html_text.main_text(body.format(kept), w).split("\n")
        assert len(got) == 4 and got[2] == " ".join(re.sub("<[^>]*>", "", kept).split()), kept
    for gone in ('<p class="advert">Buy this now, it is cheap and good.</p>', '<p><span class="ad-label">Buy this now, it is cheap and good.</span></p>', '<div class="share-buttons"><p>Share this with all your friends today.</p></div>', '<div id="comments"><p>I think that this is a nice text.</p></div>', '<div role="search"><p>Search for words on this site here.</p></div>', '<div class="site-footer"><p>All the rights belong to the owner.</p></div>'):
        assert len(html_text.main_text(body.format(gone), w).split("\n")) == 3, gone


def test_html_of_very_long_pages_is_quick():
    import time

    w = html_text.train([])
    page = "<html><body><nav><a href=x>a</a></nav><article>" + "".join(f"<p>Paragraph {i} has some words, and it ends here.</p>" + "<div>" * (i % 3 == 0) for i in range(20_000)) + "</section>" * 20_000
    began = time.process_time()
    assert html_text.main_text(page, w).count("\n") == 19_999
    assert time.process_time() - began < 6


def test_html_query_equals_a_plain_extractor(spark):
    import html as entities

    rows = html_text.op6_html_text(spark, DIR).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        inner = "".join(re.findall(r"(?s)<article>(.*?)</article>", pages[r.page_id] or ""))
        blocks = [" ".join(entities.unescape(re.sub(r"<br\s*/?>", " ", b)).split()) for b in re.split(r"</?(?:h1|p)>", re.sub(r"</?b>", "", inner))]
        want = "\n".join(b for b in blocks if b)
        assert (r.text, r.n_chars) == (want, len(want))


def test_html_self_closed_svg_and_formulas():
    w = html_text.train([])
    page = "<html><body><article><h1>T</h1><p>Some text, with words {}and more words.</p><p>More text.</p></article></body></html>"
    want = html_text.main_text(page.format(""), w)
    assert "more words" in want and "More text." in want
    for icon in ("<svg/>", "<svg />", '<SVG class="a>b" hidden/>', "<svg a='1' b=2 />", "<math/>", "<svg><path d=x/>gone</svg>", "<svg a=b/>gone</svg>"):
        assert html_text.main_text(page.format(icon), w) == want, icon
    assert "x+1" in html_text.main_text(page.format("<math><mi>x</mi><mo>+</mo><mn>1</mn></math> "), w)


def test_html_odd_pages(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<"), (4, "<div>" * 3000 + "text"), (5, "<script>")], "page_id long, html string")
    assert {r.page_id: r.n_chars for r in html_text.extract_main_text(pages).collect()}.keys() == {1, 2, 3, 4, 5}


URLS = [None, "x", "http://a.example.org/es/1", "http://EXAMPLE.org/en/12?q", "https://b.com/fr/", "https://b.com/de/x#y", "ftp://com/de/", "http://org", "http://notorg/", "a://b://c/de/", "", "http://É.com/de/é", "http://org/" + "x" * 50_000]


def _judged(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


def test_urls_equal_brute_force(spark):
    pages = spark.createDataFrame([*((i, u, "old") for i, u in enumerate(URLS)), (None, URLS[2], "old"), (2, URLS[2], "old")], "page_id int, url string, verdict string")
    many = [*url_filter.RULES, ("allow", "com", "/de/"), *(("block", f"h{i}.net", f"/{i % 7}") for i in range(3000))]
    for rules in (url_filter.RULES, many, []):
        got = url_filter.judge_urls(pages, rules)
        assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
        rows = got.collect()
        assert len(rows) == len(URLS) + 2
        assert all((r.host, r.path, r.rule, r.verdict) == _judged(r.url, rules) for r in rows)
    assert url_filter.judge_urls(pages.limit(0), url_filter.RULES).count() == 0


def test_equal_digests_are_told_apart_by_the_stored_strings(monkeypatch, tmp_path):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda text: 7)
    (tmp_path / "rules").write_bytes(url_filter.array_file(url_filter.RULES))
    array = url_filter.DigestArray(str(tmp_path / "rules"))
    for url in URLS[2:9]:
        host, path, rule, verdict = _judged(url, url_filter.RULES)
        assert array.judge([host], [path], "allow") == ([rule], [verdict])


def _brute_components(rows):
    word, low = re.compile(r"[^\x20\x09-\x0D]+"), str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets, parent = {}, {}
    for i, text in rows:
        w = word.findall((text or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        parent[i] = i

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and (x := len(sets[a] & sets[b])) and 100 * x >= 75 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard(spark, odd):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    rows = list(enumerate(TEXTS))
    for i in range(100, 220):  # one group of near copies, at all distances, around the threshold
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(60)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == _brute_components(rows)
    assert jaccard_join.drop_near_duplicates(docs).count() == sum(i == c for i, (_, c) in got.items())
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_jaccard_splits_tiles_of_uncounted_shingles(spark, monkeypatch):
    """Shingles that no list holds are in many sets: their tiles are split by true size, and no link is lost."""
    rng = random.Random(11)
    rows = []
    for i in range(700):  # one passage in front of texts of their own, some of which come in near copies
        own = [f"u{i // 2 if i < 80 else i}x{k}" for k in range(8)]
        if i < 80 and i % 2:
            own[-1] = "other"
        rows.append((i, " ".join(["one passage that all of them do have in common", *own, *(["t"] * (i % 3))])))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    monkeypatch.setattr(jaccard_join, "MAX_COMMON", 0)  # an empty list of frequent shingles
    monkeypatch.setattr(jaccard_join, "UNSIGNED", 40)
    monkeypatch.setattr(jaccard_join, "TILE", 64)
    met = []
    monkeypatch.setattr(jaccard_join, "_met", lambda *a, f=jaccard_join._met: met.append(a) or f(*a))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == _brute_components(rows)
    assert len(met) == 2  # the second time for the large tiles


def test_shingles_are_counted_over_the_whole_table(spark):
    """A shingle that each task holds once or twice is counted as often as it occurs."""
    rows = [(i, f"the very same five words a{i} b{i} c{i} d{i} e{i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(50)
    common = jaccard_join._most_common(docs, 5)
    h, _ = jaccard_join.shingle_sets(np.frombuffer(b"the very same five words", np.uint8), np.array([0, 24]), 5)
    assert common.of(h).tolist() == [50] and len(common.keys) == 1


def test_near_duplicates_of_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, "a"), (1, long, "a"), (1, "something else that is short", "b"), (2, long + " x", "c"), (None, long, "d"), (3, None, "e"), (3, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, c0 string")
    got = jaccard_join.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(r.c0 for r in got.collect()) == ["a", "b", "d", "e"]


def test_tiles_lose_no_pair():
    rng = np.random.default_rng(7)
    n, m = 40, 30
    sets = [np.unique(rng.integers(1, 60, n).astype(np.uint64)) for _ in range(m)]
    sizes, comp = np.array([len(s) for s in sets]), np.arange(m)
    sig = [jaccard_join.signature(s) for s in sets]
    a, b = jaccard_join.tile_pairs(np.ones(m, int), comp, sizes, np.zeros(m, int), [b""] * m, sig, 75)
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    for i in range(m):
        for j in range(i + 1, m):
            if jaccard_join.overlap(sets[i], sets[j]) >= jaccard_join.needed(sizes[i], sizes[j], 75):
                assert (i, j) in found


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (5, 5), (200, 40)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(41), 200]} | {100: 100, 101: 100}


def _targets(sizes, weights, share, most):
    """By rounds: what is above a source's limit is dealt again among the others."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, budget = {}, list(order), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if budget * weight[s] / total >= most * sizes[s]]
        if not above:
            return target | {s: budget * weight[s] / total for s in open_}
        target |= {s: most * sizes[s] for s in above}
        budget -= sum(target[s] for s in above)
        open_ = [s for s in open_ if s not in above]
    return target


def test_mixing_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, " w" * rng.randint(1, 40), rng.choice(["a", "b", "c", "é", "z", "\U0001f600"]), 1) for i in range(3000)] + [(1, None, None, 1), (2, "", "e", 1), (None, "a b", None, 1), (5, "x y z", "a", 1), (5, "x y z", "a", 1), (6, "w " * 70_000, "long", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key int")
    for weights, share in (((5, 2, 1), 1.5), ((1, 1, 50), 0.4), ((1,), 3.0)):
        got = mixing.mix_sources(docs, weights, share).collect()
        assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(7), weights, share).collect()))
        sizes = {}
        for _, t, s, _ in rows:
            sizes[s] = sizes.get(s, 0) + len((t or "").split())
        want = _targets(sizes, weights, share, 2)
        by = {}
        for r in got:
            assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
            by.setdefault(r.source, []).append(r)
        for s, own in by.items():  # by hash order, the one of two neighbouring cuts that is nearer to the target
            whole = int(want[s] // sizes[s]) if sizes[s] else 0
            rest, upto, cuts = want[s] - whole * sizes[s], 0, [0]
            keys = {}
            for r in own:
                keys[r.key % 2**64] = keys.get(r.key % 2**64, 0) + r.size
            for k in sorted(keys):
                upto += keys[k]
                cuts.append(upto)
            assert abs(sum(r.taken for r in own) - whole * sizes[s] - min(cuts, key=lambda c: abs(c - rest))) <= 0 or abs(abs(sum(r.taken for r in own) - want[s]) - min(abs(c - rest) for c in cuts)) < 1e-6  # noqa: B023
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_targets_of_many_sources(spark):
    rng = random.Random(13)
    sizes = {f"s{i}": rng.choice([0, rng.randint(1, 10), rng.randint(1, 100_000)]) for i in range(2000)} | {None: 50}
    table = spark.createDataFrame(list(sizes.items()), "source string, n long").repartition(5)
    want = _targets(sizes, (5, 2, 1), 1.5, 2)
    got = {r.source: r.target for r in mixing.with_targets(mixing.ranked_sources(table), (5, 2, 1), 1.5, 2).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_odd_tables(spark):
    """Null and repeated ids, repeated rows, null texts, columns with names of results, and tables without rows."""
    texts = ["one two three four five six", None, "", "an idiot, a clown!", "x " * 30]
    rows = [(i % 4 if i % 5 else None, texts[i % len(texts)], "s" if i % 3 else None, i) for i in range(40)] * 2
    names = ["score", "predicted", "evidence", "n_tokens", "ids_sha256", "key", "batch", "size", "copies", "taken", "component_id", "doc", "c0", "_key", "_batch"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    for name in names:
        docs = docs.withColumn(name, F.lit("old"))
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(4)] + [(None, 1, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    n = len(rows)

    for made, gone in ((quality.score_quality(docs, labels), {"score", "predicted"}), (toxicity.score_toxicity(docs, labels), {"score", "predicted", "evidence"})):
        got = made.collect()
        assert len(got) == n and set(made.columns) == set(docs.columns) and sorted(r.n for r in got) == sorted(r[3] for r in rows)
        assert all(r[c] == "old" for r in got for c in names if c not in gone)
        assert len({(r.text, r.score) for r in got}) == len(texts)  # equal texts, equal scores
    made = bpe.encode_documents(docs)
    got = made.collect()
    assert len(got) == n and all(r[c] == "old" for r in got for c in names if c not in ("n_tokens", "ids_sha256"))
    path = token_store.shared_path(spark, "odd-store")
    token_store.write_store(docs, path)
    stored = token_store.read_store(spark, path).orderBy("start").collect()
    assert sorted(str(r.doc_id) for r in stored) == sorted(str(r[0]) for r in rows) and [r.start for r in stored[1:]] == [r.start + r.n_tokens for r in stored[:-1]]
    pairs = jaccard_join.jaccard_components(docs).collect()
    assert len(pairs) == n and all((r.component_id is None) == (r.doc_id is None) for r in pairs)
    kept = jaccard_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == sum(r[0] is None for r in rows)
    mixed = mixing.mix_sources(docs).collect()
    assert len(mixed) == n and all(0 <= r.taken <= 2 * r.size for r in mixed)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.org/"), "text").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"), F.lit("old").alias("text"), F.lit("old").alias("n_chars"), F.lit("old").alias("page"), F.lit("old").alias("found"), "n")
    for made in (html_text.extract_main_text(pages), url_filter.judge_urls(pages, url_filter.RULES)):
        got = made.collect()
        assert len(got) == n and all(r.page == r.found == "old" for r in got)
    for none in (quality.score_quality(docs.limit(0), labels), toxicity.score_toxicity(docs.limit(0), labels), html_text.extract_main_text(pages.limit(0)), mixing.mix_sources(docs.limit(0)), jaccard_join.drop_near_duplicates(docs.limit(0))):
        assert none.collect() == []


def test_html_keeps_linked_items_and_text_behind_unclosed_elements():
    weights = html_text.train([])
    body = "<p>A first paragraph of the article, with enough words to be one.</p>"
    page = f"<html><body><article>{body}<ul><li>one item of text</li><li><a href='x'>three</a></li><li>another item of text</li></ul>{body}</article></body></html>"
    assert "three" in html_text.main_text(page, weights).split("\n")
    for tag in ("button", "select", "svg", "iframe"):
        page = f"<html><body><article>{body}<div><{tag} class='x'>never this</div><p>But this paragraph stays, as it is part of it.</p></article><p>And this one.</p></body></html>"
        got = html_text.main_text(page, weights)
        assert "But this paragraph stays, as it is part of it." in got and "never this" not in got, tag
        closed = f"<article>{body}<{tag}>not <div>that</div></{tag}><p>But this paragraph stays, as it is part of it.</p></article>"
        got = html_text.main_text(closed, weights)
        assert "that" not in got and "But this paragraph stays" in got, tag
    page = f"<body><article>{body}</article><div id='cookie-law-info-bar'><p>We use small files, and you may agree to them here, or not at all.</p></div></body>"
    assert "agree" not in html_text.main_text(page, weights)
    assert html_text.main_text("<article><p>" + "<button>" * 20_000 + "</p><p>The end of a page that is hard to read.</p></article>", weights)


def test_pipeline_mix_keeps_columns_of_any_name(spark):
    import corpus_pipeline as cp

    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "ab"[i % 2], "x", i) for i in range(50)], "doc_id long, text string, source string, _key string, copies int")
    mixed = cp.mix(spark, docs, DIR)
    assert mixed.columns == docs.columns
    taken = {r.doc_id: r.copies for r in mixing.mix_sources(docs.drop("copies")).collect()}
    got = {}
    for r in mixed.collect():
        assert (r._key, r.copies) == ("x", r.doc_id)
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: c for i, c in taken.items() if c}


def _one_pass(texts):
    data = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)


def test_pipeline_equals_brute_force(spark):
    """Every stage on its own input, against plain loops on one machine."""
    import corpus_pipeline as cp

    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns, name
        before, rows = docs.collect(), out.collect()
        kept[name] = sorted(r.doc_id for r in rows)
        docs, known = spark.createDataFrame(rows, out.schema), {r.doc_id: r for r in before}
        assert {r.doc_id: r for r in rows}.items() <= known.items()  # documents stay as they are
        texts = [r.text for r in before]
        source = spark.createDataFrame(before, out.schema)
        if name == "quality":
            model = quality.train(common.labelled_sample(source, labels, "quality", common.id_bucket("doc_id", 5) != 0, quality.MAX_DOCS, quality.MAX_CHARS, positive=0)[0])
            want = [r.doc_id for r, score in zip(before, model.documents(*_one_pass(texts)), strict=True) if score >= 0.3]
        elif name == "toxicity":
            sample, prior = common.labelled_sample(source, labels, "toxic", common.id_bucket("doc_id", 4) != 2, toxicity.MAX_EXAMPLES, toxicity.MAX_CHARS, share=1 / 3)
            index = toxicity.BlockMaxIndex(sample, prior=prior)
            index.calibrate()
            want = [r.doc_id for r, score in zip(before, index.documents(*_one_pass(texts))[0], strict=True) if score < 0.3]
        elif name == "near_duplicates":
            sets = {}
            for r in before:
                words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
                sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
            leader = {i: i for i in sets}

            def find(i):
                while leader[i] != i:  # noqa: B023
                    i = leader[i]  # noqa: B023
                return i

            ids = sorted(sets)
            for k, i in enumerate(ids):
                for j in ids[:k]:
                    both = len(sets[i] & sets[j])
                    if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                        a, b = sorted((find(i), find(j)))
                        leader[b] = a
            want = [i for i in ids if find(i) == i]
        else:  # the mix: as often as it says, near to each source's target
            size, taken = {}, {}
            count = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
            for r in before:
                size[r.source] = size.get(r.source, 0) + count(r)
            for r in rows:
                taken[r.source] = taken.get(r.source, 0) + count(r)
            most = {s: max(count(r) for r in before if r.source == s) for s in size}
            target = _targets(size, (5, 2, 1), 1.5, 2)
            assert all(abs(taken.get(s, 0) - target[s]) <= most[s] for s in size) and all(kept[name].count(i) <= 2 for i in set(kept[name]))
            continue
        assert kept[name] == sorted(want), name
    assert 0 < len(kept["near_duplicates"]) < len(kept["toxicity"]) < len(kept["quality"])
    coding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(spark, public_tokenizers.path(bpe.RANKS)), special_tokens={})
    got = cp.STAGES[-1][1](spark, docs, DIR).collect()
    want = sorted((r.doc_id, coding.encode_ordinary(r.text or "")) for r in docs.collect())
    assert sorted((r.doc_id, list(r.tokens)) for r in got) == want
