"""Toxicity, quality and language-model scores: exact pieces against brute force, held-out accuracy, edge cases."""

import zlib

import numpy as np
import pytest

from quern.llm import lm, quality, toxicity
from quern.llm.common import block_sums, held_out


def auc(s, y):
    order = np.argsort(np.argsort(s))
    n = y.sum()
    return (order[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def brute_kernel(a, b):
    def phi(w):
        c, out, total = "^" + w, {}, 0.0
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                for k in range(j + 1, min(len(c), i + toxicity.SPAN + 1)):
                    v = toxicity.DECAY ** (k - i - 2)
                    out[c[i], c[j], c[k]] = out.get((c[i], c[j], c[k]), 0) + v
                    total += v * v
        return out, max(total**0.5, toxicity.LEAST_NORM)

    (p, n), (q, m) = phi(a), phi(b)
    return sum(v * q.get(t, 0) for t, v in p.items()) / n / m


def test_kernel_equals_brute_force():
    words = ["idiot", "idxiot", "a", "the", "moron", "internationalisation"]
    for z in words:
        tensor = toxicity.features([z.encode()])[0]
        got = toxicity.kernel_sums([w.encode() for w in words], tensor)
        assert got == pytest.approx([brute_kernel(w, z) for w in words], abs=1e-5)


def test_folding():
    assert toxicity.folded_words("1D1OT i-d-i.o.t réÊß i d i o t ok".encode()) == [b"idiot", b"idiot", b"rees", b"i", b"d", b"i", b"o", b"t", b"ok", b"idiot"]
    # other scripts: letters by code point, no Latin letters made of their bytes
    words = toxicity.folded_words("ты идиот и дурак, ложь「愚か」 naïve".encode())
    assert len(words) == 6 and [len(w) for w in words[:4]] == [2, 5, 1, 5] and words[5] == b"naive"
    assert not any(97 <= c <= 122 for w in words[:5] for c in w) and words[1] != words[3]
    assert toxicity.folded_words(("и" * 500).encode()) == [toxicity.folded_words("и".encode())[0] * 500]


EXTRA = [(9001, None), (9002, ""), (None, "x y"), (9003, "word " * 30000), (9002, "")]


def frames(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    extra = spark.createDataFrame(EXTRA, "doc_id long, text string")
    return docs.union(extra).selectExpr("doc_id", "text", "1 as th", "2 as score", "3 as _id"), labels


def test_held_out_fold(spark):
    rows = [r[:] for r in spark.range(200).select("id", held_out("id")).collect()]
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in rows)


@pytest.mark.parametrize("op, label, least", [("toxicity", "toxic", 0.85), ("quality", "quality", 0.9)])
def test_held_out_accuracy_and_edges(spark, op, label, least):
    docs, labels = frames(spark, "sf0.01")
    if op == "toxicity":
        model = toxicity.train(toxicity.labelled_sample(docs, labels, label))
        out = toxicity.scored(docs, model)
        kept = toxicity.reject(docs, model)
        assert kept.columns == docs.columns == ["doc_id", "text", "th", "score", "_id"]
    else:
        out = quality.scored(docs, quality.fit(docs, labels))
    got = out.collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    scores = {r.doc_id: r.score for r in got}
    assert scores[9001] == scores[9002]
    known = [(scores[r.doc_id], r[label]) for r in labels.filter(held_out()).collect() if r.doc_id in scores]
    s, y = np.array([k[0] for k in known]), np.array([k[1] for k in known])
    assert auc(s, y) > least
    if op == "toxicity":
        assert kept.count() == sum(r.score < 0.5 for r in got)


def test_labelled_rows_and_few_telling_words(spark):
    rows = [(k, f"text {k}") for k in range(60)] + [(1, "again")]
    labels = [(k, k % 2) for k in range(60)] + [(1, 0), (3, 0), (None, 1)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.labelled_sample(docs, known, "toxic", 20)
    assert len(got) == 20
    every = toxicity.labelled_sample(docs, known, "toxic")
    ids = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5]
    assert len(every) == len(ids) + (1 in ids) and sum(y for _, y in every) == sum(k % 2 for k in ids) + (1 in ids)
    # two toxic texts prove little, but the words that tell them apart still serve
    few = [([b"good", b"words", b"here"], 0)] * 5 + [([b"good", b"nasty"], 1), ([b"words", b"vile"], 1)]
    model = toxicity.train(few)
    s = toxicity.score_texts([b"nasty thing", b"good words here"], model, {})
    assert s[0] > s[1]


def test_toxicity_scores_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = toxicity.train(toxicity.labelled_sample(docs, labels, "toxic"))

    def decision(word):
        c, dot, square = [toxicity.MARK, *(x - 97 if x < 128 else x - 128 + 28 for x in word)], 0.0, 0.0
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                for k in range(j + 1, min(len(c), i + toxicity.SPAN + 1)):
                    v = toxicity.DECAY ** (k - i - 2)
                    dot += v * model.tensor[(c[i] * toxicity.BASE + c[j]) * toxicity.BASE + c[k]]
                    square += v * v
        return dot / max(square**0.5, toxicity.LEAST_NORM) + model.bias

    rows = docs.filter("doc_id % 9 = 0").collect()
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    for r in rows:
        values = [decision(w) for w in set(toxicity.folded_words((r.text or "").encode()))] or [model.bias]
        hits = sum(v >= toxicity.SURE for v in values)
        x = [1.0, min(max(max(values), -2.0), 1.2), np.log1p(hits), np.log1p(100 * hits / len(values)), np.log1p(len(values)), float(hits > 0)]
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-sum(a * b for a, b in zip(model.layer, x)))), abs=1e-3)


def test_quality_scores_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    dim, (w1, b1, w2, b2) = quality.DIM, model.layers
    for r in docs.filter("doc_id % 9 = 0").collect():
        ids = quality.Tokens().ids(r.text or "")
        vectors = [model.vectors[i].astype(float) for i in ids]
        mean = sum(vectors, np.zeros(2 * dim)) / max(1, len(ids))
        agree = sum(float(a[dim:] @ b[dim:]) for a, b in zip(vectors, vectors[1:])) / max(1, len(ids) - 1)
        x = np.array([*mean, np.sqrt((mean[dim:] ** 2).sum()), agree, np.log1p(len(ids)) / 10])
        z = np.tanh((x - model.shift) / model.scale @ w1 + b1)
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-float(z @ w2[:, 0] + b2[0]) / model.temperature)), abs=1e-3)


def test_no_labels_give_the_base_rate(spark):
    docs, labels = frames(spark, "sf0.001")
    model = toxicity.train(toxicity.labelled_sample(docs, labels.limit(0), "toxic"))
    assert {round(r.score, 2) for r in toxicity.scored(docs, model).collect()} == {0.5}
    flat = quality.train(np.zeros((0, 2 * quality.DIM + 3)), np.zeros(0, np.int64), np.zeros((quality.BUCKETS, 2 * quality.DIM), np.float32))
    assert flat.score(np.zeros((2, 2 * quality.DIM + 3))) == pytest.approx([0.5, 0.5])
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_context_vectors_equal_brute_force(spark):
    rows = [("a b c, a!",), (None,), ("",), ("b " * 10,)]
    got = quality.context_vectors(spark.createDataFrame(rows, "text string"))
    want = np.zeros((quality.BUCKETS, quality.DIM))
    index = quality.index_vectors() * np.sqrt(quality.SPARSE)
    for (t,) in rows:
        ids = quality.Tokens().ids(t or "")
        for i in range(len(ids)):
            for j in range(max(0, i - quality.REACH), min(len(ids), i + quality.REACH + 1)):
                if i != j:
                    want[ids[i]] += index[ids[j]]
    assert np.allclose(got, want)


def test_block_sums(spark):
    rows = [(k % 5, k, np.full(3, k, np.float32).tobytes()) for k in range(100)]
    got = block_sums(spark.createDataFrame(rows, "block int, part int, vec binary"), 5)
    assert {b: v.tolist() for b, v in got.items()} == {b: [sum(range(b, 100, 5))] * 3 for b in range(5)}


def test_lm_probabilities_sum_to_one_and_gradient():
    rng = np.random.default_rng(3)
    w = lm.start(rng.integers(0, 50, lm.SIZE))
    ctx = rng.integers(0, lm.SIZE + 1, (1, 4)).astype(np.int32)
    every = np.arange(lm.SIZE, dtype=np.int32)
    p = np.exp(lm.log_probabilities(w, np.repeat(ctx, lm.SIZE, axis=0), every))
    assert p.sum() == pytest.approx(1, abs=1e-4)
    ctx, t = rng.integers(0, 50, (256, 4)).astype(np.int32), rng.integers(0, 50, 256).astype(np.int32)
    # gradients against central differences
    loss = lambda: -lm.log_probabilities(w, ctx, t).mean()
    for x, g in zip(w, lm.gradients(w, ctx, t)):
        at = np.unravel_index(int(np.abs(g).argmax()), x.shape)
        was, eps = x[at], 0.05
        x[at] = was + eps
        high = loss()
        x[at] = was - eps
        low = loss()
        x[at] = was
        assert (high - low) / (2 * eps) == pytest.approx(g[at], rel=0.05, abs=1e-4)
    before, past = -loss(), [np.full_like(x, 1e-8) for x in w]
    for _ in range(30):
        lm.step(w, past, ctx, t, 0.1)
    assert -loss() > before + 0.3
    assert np.array_equal(np.concatenate([x.ravel() for x in lm.unflat(lm.flat(w))]), np.concatenate([x.ravel() for x in w]))


def test_lm_whole_table(spark):
    from collections import Counter

    from quern.llm.common import ascii_lower

    docs, _ = frames(spark, "sf0.001")
    docs = docs.withColumnsRenamed({"th": "row_key", "score": "word", "_id": "ids"}).coalesce(1)
    rows = docs.collect()
    got = lm.scored(docs).collect()
    assert len(got) == len(rows)
    # counts and vocabulary
    want = Counter(w for r in rows for w in ascii_lower((r.text or "").encode()).split())
    top, uses = lm.vocabulary(lm.word_counts(docs))
    assert list(top) == [w for w, _ in sorted(want.items(), key=lambda p: (-p[1], p[0]))[: lm.TOP]]
    rest = Counter()
    for w, n in want.items():
        if w not in top:
            rest[lm.word_hash(w) % lm.REST] += n
    assert uses.tolist() == [want[w] for w in top] + [0] * (lm.TOP - len(top)) + [rest[b] for b in range(lm.REST)]
    # scores, word by word
    weights = lm.train(lm.sequences(docs, top), uses)

    def brute(text):
        words = ascii_lower((text or "").encode()).split()
        ids = [top.get(w, lm.TOP + lm.word_hash(w) % lm.REST) for w in words]
        total = 0.0
        for i, w in enumerate(words[:3000]):
            ctx = [ids[j] if 0 <= j < len(ids) else lm.SIZE for j in (i - 2, i - 1, i + 1, i + 2)]
            h = np.tanh(weights[0][ctx].ravel() @ weights[1] + weights[2])
            z = h @ weights[3] + weights[4]
            c, k = ids[i] % lm.CLASSES, ids[i] // lm.CLASSES
            s = h @ weights[5][c] + weights[6][c]
            total += z[c] - np.log(np.exp(z).sum()) + s[k] - np.log(np.exp(s).sum())
            if w not in top:
                total += np.log(want[w] / rest[ids[i] - lm.TOP])
        return len(words), total

    for r in got:
        text = next(x.text for x in rows if x.doc_id == r.doc_id)
        if r.n_tokens <= 3000:
            n, total = brute(text)
            assert r.n_tokens == n and r.sum_logprob == pytest.approx(total, rel=1e-3, abs=1e-3)
            assert r.mean_logprob is None if not n else r.mean_logprob == pytest.approx(total / n, rel=1e-3)
    # a long text in batches of its own
    ids = np.tile(np.arange(300, dtype=np.int32), 100)
    share = np.zeros(lm.SIZE)
    assert lm._score_slice([ids[:10], ids], weights, share)[1] == pytest.approx(lm.score_text(ids, weights, share), rel=1e-5)
    assert lm.scored(docs.limit(0)).count() == 0


def test_lm_blocks_and_limit(monkeypatch):
    """Results don't depend on how many rows are multiplied at once, and logits past the limit are cut as one by one."""
    rng = np.random.default_rng(4)
    w = lm.start(rng.integers(0, 50, lm.SIZE))
    ctx, t = rng.integers(0, lm.SIZE + 1, (5000, 4)).astype(np.int32), (lm.SIZE * rng.random(5000) ** 3).astype(np.int32)
    for factor in (1, 40):
        v = [x * np.float32(factor) for x in w]
        h = np.tanh(v[0][ctx].reshape(5000, -1) @ v[1] + v[2]).astype(np.float64)
        z = np.clip(h @ v[3] + v[4], -60, 60)
        s = np.clip(np.einsum("nh,nhk->nk", h, v[5][t % lm.CLASSES]) + v[6][t % lm.CLASSES], -60, 60)
        n = np.arange(5000)
        want = z[n, t % lm.CLASSES] - np.log(np.exp(z).sum(axis=1)) + s[n, t // lm.CLASSES] - np.log(np.exp(s).sum(axis=1))
        assert np.allclose(lm.log_probabilities(v, ctx, t), want, atol=1e-3)
        whole = lm.gradients(v, ctx, t)
        monkeypatch.setattr(lm, "ROWS", 300)
        assert np.allclose(lm.log_probabilities(v, ctx, t), want, atol=1e-3)
        shares = [[x * np.float32(len(t[a:b]) / 5000) for x in lm.gradients(v, ctx[a:b], t[a:b])] for a, b in ((0, 1), (1, 1700), (1700, 5000))]
        monkeypatch.undo()
        for g, *parts in zip(whole, *shares):
            assert np.allclose(g, sum(parts), atol=1e-4 * np.abs(g).max())
    # a long text in batches
    ids, share = np.tile(np.arange(300, dtype=np.int32), 100), np.zeros(lm.SIZE)
    whole = lm.score_text(ids, w, share)
    monkeypatch.setattr(lm, "BATCH", 4096)
    assert lm.score_text(ids, w, share) == pytest.approx(whole, rel=1e-6)


def test_lm_known_words(spark, monkeypatch):
    """Counts that tasks know need no join, and give the scores that joined counts give."""
    docs, _ = frames(spark, "sf0.001")
    counts = lm.word_counts(docs).cache()
    steps = lm.histogram(counts)
    top, uses = lm.vocabulary(counts, steps)
    n = {bytes(r.word): r.n for r in counts.collect()}
    monkeypatch.setattr(lm, "KNOWN", 6000)
    known = lm.known_words(counts, steps, top)
    # whole steps of counts, the highest ones
    assert 0 < len(known) <= 6000 and not known.keys() & top.keys()
    assert min(n[w] for w in known) > max((k for w, k in n.items() if w not in top and w not in known), default=0)
    assert all(x == pytest.approx(np.log(n[w])) for w, x in known.items())
    plain, told = (lm.sequences(docs, top, k).orderBy("doc_id", "th").collect() for k in (None, known))
    hashes = {lm.word_hash(w): x for w, x in known.items()}
    met = 0
    for a, b in zip(plain, told, strict=True):
        assert a.ids == b.ids and a.known == 0 and b.rare == [h for h in a.rare if h not in hashes]
        assert b.known == pytest.approx(sum(hashes.get(h, 0) for h in a.rare))
        met += len(a.rare) - len(b.rare)
    assert met == sum(n[w] for w in known)
    weights = lm.train(lm.sequences(docs, top), uses)
    monkeypatch.setattr(lm, "train", lambda coded, uses: weights)
    some = lm.scored(docs).orderBy("doc_id", "th").collect()
    monkeypatch.setattr(lm, "KNOWN", 0)
    none = lm.scored(docs).orderBy("doc_id", "th").collect()
    assert [r.sum_logprob for r in some] == pytest.approx([r.sum_logprob for r in none], rel=1e-9, abs=2e-6)


@pytest.mark.parametrize("walks, nats, above", [(4, 0.55, 0.9), (32, 0.25, 0.8)])
def test_lm_learns(spark, monkeypatch, walks, nats, above):
    """As many walks as named really run and are averaged: 4 of a million tokens, 32 of 125,000 (which teach less; the operator's own have two million or more)."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(max(walks, 8), "doc_id")
    top, uses = lm.vocabulary(lm.word_counts(docs))
    coded = lm.sequences(docs, top)
    monkeypatch.setattr(lm, "TASK_TOKENS", int(uses.sum()) // walks)
    ran = []
    sums = lm.block_sums
    monkeypatch.setattr(lm, "block_sums", lambda parts, blocks: (ran.append(parts.rdd.getNumPartitions()), sums(parts, blocks))[1])
    weights = lm.train(coded, uses)
    assert ran == [walks] * lm.ROUNDS
    seqs = [s for s in lm.read_ids(coded.filter("doc_id % 50 = 3").toArrow()["ids"].combine_chunks()) if len(s) >= 20]
    tokens = np.concatenate(seqs)
    trained = np.concatenate([lm.log_probabilities(weights, lm.windows(s), s) for s in seqs])
    unigram = np.log(np.maximum(uses, 1) / uses.sum())[tokens]
    rng = np.random.default_rng(2)
    better = [lm.score_text(s, weights, np.zeros(lm.SIZE)) > lm.score_text(rng.permutation(s), weights, np.zeros(lm.SIZE)) for s in seqs]
    print("learned", trained.mean() - unigram.mean(), np.mean(better))
    assert trained.mean() > unigram.mean() + nats and np.mean(better) > above


def test_lm_trains_on_every_position(spark):
    for n in (1, 2, 7, 40):
        assert sorted(i for turn in range(lm.ROUNDS) for i in np.arange(n)[lm.masked(n, turn)].tolist()) == list(range(n))
    # 7 stands at places 4 modulo 8 only, between two 9s, and the start weights don't know it
    ids = np.tile(np.array([3, 3, 3, 9, 7, 9, 3, 3], np.uint16), 512)
    coded = spark.createDataFrame([(bytearray(ids[: len(ids) - k % 2].tobytes()),) for k in range(40)], "ids binary").coalesce(1)
    uses = np.zeros(lm.SIZE, np.int64)
    w = lm.train(coded, uses)
    ctx, seven = lm.windows(ids.astype(np.int32))[100:101], np.array([7], np.int32)
    assert lm.log_probabilities(w, ctx, seven)[0] > lm.log_probabilities(lm.start(uses), ctx, seven)[0] + 0.5


def test_empty_and_unlabelled_tables(spark):
    docs, labels = frames(spark, "sf0.001")
    assert quality.scored(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0
    got = quality.scored(docs, quality.fit(docs, labels.limit(0))).collect()
    assert len(got) == docs.count() and {round(r.score, 3) for r in got} == {0.5}
    assert toxicity.train(toxicity.labelled_sample(docs.limit(0), labels, "toxic")).layer[1] == 0
