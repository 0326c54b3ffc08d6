"""Classifiers, the piece codec and the pipeline."""

import itertools
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

import corpus_pipeline
from tracewright.llm import piece_codec, quality, sampling, toxicity

PATH = public_tokenizers.path("piece_bpe_32k.model")


def crowd(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = [rng.choice("the of and thing tion ing heon stre bleth anre".split()) + rng.choice(["", "ed", "ly", "er"]) for _ in range(rng.randrange(5, 120))]
        kind = i % 8
        toxic = int(kind == 1)
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["grubnik", "moldwart", "snotpaw"])
        if kind == 2:
            w = [x.upper() + "!!" for x in w]
        if kind == 3:
            w = [x for x in w[:6] for _ in range(25)]
        rows.append((i, " ".join(w), int(kind not in (2, 3)), toxic))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = crowd(900)
    docs = spark.createDataFrame([(i, t, "en", "s1", len(t)) for i, t, _, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int")
    return docs, labels, rows


def accuracy(rows, label):
    held = [r for r in rows if r.held_out]
    assert held and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    return sum(r.predicted == label[r.doc_id] for r in held) / len(held)


def test_quality_on_held_out_rows(spark, tables):
    docs, labels, rows = tables
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == len(rows)
    assert accuracy(got, {r[0]: r[2] for r in rows}) > 0.95


def test_toxicity_on_held_out_rows(spark, tables):
    docs, labels, rows = tables
    model = toxicity.fit(docs, labels)
    assert {"grubnik", "moldwart", "snotpaw"} <= set(model.landmarks)
    assert accuracy(toxicity.score(docs, model).collect(), {r[0]: r[3] for r in rows}) > 0.97
    plain, dotted, spelt, clean = toxicity.scores(model, ["the moldwart of", "the m.o.l-d*wart of", "the m o l d w a r t of", "the thing of"])
    assert min(plain, dotted, spelt) > 0.5 > clean


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_on_odd_tables(spark, tables, module):
    docs, labels, _ = tables
    model = module.fit(docs, labels)
    odd = spark.createDataFrame([(1, None, 1.5), (1, "", 2.5), (None, "x" * 200000, None)], "doc_id long, text string, score double")
    got = module.score(odd, model).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)
    assert module.score(odd.limit(0), model).collect() == []
    # Nothing to learn from: the share of the only class, or no information.
    few = module.fit(docs, labels.limit(0))
    assert isinstance(few, float) and 0 <= few <= 1
    assert all(r.score == few for r in module.score(odd, few).collect())


def test_kernel_matches_enumeration():
    def plain(s, t, p, gap):
        pick = lambda x: list(itertools.combinations(range(len(x)), p))
        return sum(gap ** (i[-1] - i[0] + j[-1] - j[0] + 2) for i in pick(s) for j in pick(t) if all(s[a] == t[b] for a, b in zip(i, j)))

    for s, t in (("stupid", "stxupid"), ("aabbcc", "abc"), ("ab", "ab"), ("clown", "crown"), ("дурак", "думак")):
        got = toxicity.kernel(toxicity.pad([s, s]), toxicity.pad([t, t]))
        assert got == pytest.approx([plain(s, t, 3, toxicity.GAP)] * 2)


def test_chunks_cover_every_byte():
    data = [b"", b"ab", bytes(range(1, 250)) * 9, None]
    rows, first = quality.chunks(data)
    for text, a, b in zip(data, first, first[1:]):
        text, step = text or b"", quality.CHUNK - quality.WIDTH
        whole = b"".join(bytes(r[:step]) for r in rows[a:b]) + bytes(rows[b - 1][step:])
        assert whole.rstrip(b"\0") == text


def odd_texts():
    rng = random.Random(5)
    texts = [None, "", " ", "   lead  and trail ", "日本語 テスト 🙂🙂", "a" * 700, " " * 300, "<s> <0x0A> <unk>", "tab\tnew\nline", "0123456789" * 40, "é" * 200 + " " + "x" * 300]
    return texts + ["".join(rng.choice(" ab e\nthing.é,🙂 1") for _ in range(rng.randrange(1, 400))) for _ in range(60)]


def test_ids_equal_the_library_and_come_back(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(i, t, "keep") for i, t in enumerate(odd_texts())] + [(5, "a" * 700, "again"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, run string")
    for giant, chunk in ((1 << 16, 1 << 15), (40, 17), (40, 61)):
        out = piece_codec.decode(piece_codec.encode(docs, PATH, giant, chunk), PATH).collect()
        assert sorted((str(r.doc_id), r.run) for r in out) == sorted((str(r[0]), r[2]) for r in rows)
        for r in out:
            assert r.ids == (library.encode(r.text) if r.text else [])
            assert r.decoded == (r.text or "")
    assert piece_codec.encode(docs.limit(0), PATH).collect() == []


def test_space_mark_in_text(spark):
    docs = spark.createDataFrame([(1, "a▁b ▁ c")], "doc_id long, text string")
    row = piece_codec.decode(piece_codec.encode(docs, PATH), PATH).first()
    assert row.ids == sentencepiece.SentencePieceProcessor(model_file=PATH).encode("a▁b ▁ c")
    assert row.decoded == "a b   c"


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(6)
    rows = crowd(400, 1)
    stems = "the of and thing tion ing heon stre bleth anre".split()
    passage = " ".join(rng.choice(stems) + rng.choice(["", "ed", "ly", "er"]) for _ in range(60))
    head = " ".join(rng.choice(stems) + rng.choice(["", "ed", "ly", "er"]) for _ in range(60))
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, _, _ in rows]
    docs += [(1000, docs[0][1], "en", "s0", 1), (1001, passage + " tail one here", "en", "s1", 1), (1002, head + "\n" + passage, "en", "s1", 1), (1003, None, "en", None, None), (1004, "", "en", "s2", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "mixing", "sentencepiece"]
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        if name != "sentencepiece":
            assert now.dtypes == before.dtypes
        kept[name] = now.collect()
    good = {i for i, _, q, _ in rows if q}
    first = {r.doc_id for r in kept["quality"]}
    assert len(first & good) > 0.95 * len(good) and len(first - good - {1000, 1001, 1002, 1003, 1004}) < 10
    second = {r.doc_id for r in kept["near_dedup"]}
    assert 1000 not in second and {1003, 1004} & first <= second
    third = {r.doc_id: r.text for r in kept["substring_dedup"]}
    assert third[1001] == passage + " tail one here" and third[1002] == head
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert abs(words(kept["mixing"]) - 1.5 * words(kept["substring_dedup"])) < 10
    assert all(r.n_chars == len(r.text) for r in kept["mixing"] if r.doc_id == 1002)
    assert all(len(r.ids) == r.n_tokens > 0 for r in kept["sentencepiece"]) and len(kept["sentencepiece"]) == len(kept["mixing"])


def test_similarities_are_kernels_of_all_pairs():
    rng = random.Random(3)
    marks = ["loser", "dumb", "grubnik", "moldwart", "aaaa", "xy", "дурак"]
    words = ["lser", "dmb", "grbnk", "mldwrt", "", "ab", "dumber", "aaaaaa", "zzzz", "драк"] + ["".join(rng.choices("abdelmorsuw", k=rng.randrange(3, 33))) for _ in range(300)]
    got = toxicity.similarities(words, marks)
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            pair, own, ref = (float(toxicity.kernel(toxicity.pad([x]), toxicity.pad([y]))[0]) for x, y in ((w, m), (w, w), (m, m)))
            assert got[i, j] == pytest.approx((pair / max(own * ref, 1e-12) ** 0.5) ** toxicity.POWER, abs=1e-9), (w, m)
    masked = [toxicity.clean(w) for w in ("l*ser", "d*mb", "gr*bn*k")]
    assert (np.diag(toxicity.similarities(masked, marks[:3])) > 0.4**toxicity.POWER).all()


def plain_score(model, text):
    """A text's score word by word, by the kernel itself."""
    margins, text = [], text or ""
    for sentence in toxicity._SENTENCE.split(text):
        best = np.zeros(model.root.shape[1])
        for word in sentence.split() + (toxicity.spelt(sentence) if toxicity._SPELT.search(text) else []):
            for w in toxicity.pieces(toxicity.clean(word)):
                row = []
                for m in model.landmarks:
                    pair, own, ref = (float(toxicity.kernel(toxicity.pad([x]), toxicity.pad([y]))[0]) for x, y in ((w, m), (w, w), (m, m)))
                    row.append((pair / max(own * ref, 1e-12) ** 0.5) ** toxicity.POWER)
                best = np.maximum(best, np.array(row) @ model.root)
        margins.append(best @ model.weights)
    return 1 / (1 + np.exp(-(model.slope * (max(margins) + model.offset) + model.shift)))


def test_toxicity_scores_match_plain_code(spark, tables):
    docs, labels, rows = tables
    model = toxicity.fit(docs, labels)
    texts = [None, "", "the grubnik. of thing\nmoldwarted", "the g r u b n i k of", "Ünïcode gru\u00e9bnik!", "x" * 90] + [r[1][:200] for r in rows[:12]]
    assert toxicity.scores(model, texts) == pytest.approx([plain_score(model, t) for t in texts], abs=1e-5)
    words = toxicity.WordMap(model.landmarks, model.root)
    assert [float(toxicity.scores(model, [t], words)[0]) for t in texts] == pytest.approx(toxicity.scores(model, texts).tolist())


def test_insults_in_another_script(spark):
    rng = random.Random(8)
    stems = "это текст слово дом лес река небо поле".split()
    rows = []
    for i in range(400):
        w = [rng.choice(stems) + rng.choice(["", "а", "ом", "ы"]) for _ in range(rng.randrange(5, 40))]
        if i % 2:
            w[rng.randrange(len(w))] = rng.choice(["грубник", "злюкарь"])
        rows.append((i, " ".join(w), i % 2))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert accuracy(toxicity.score(docs, model).collect(), {i: x for i, _, x in rows}) > 0.97
    plain, inserted, clean = toxicity.scores(model, ["это грубник дом", "это груббник дом", "это слово дом"])
    assert plain > 0.5 and inserted > 5 * clean


def test_network_matches_plain_convolution(spark, tables):
    docs, labels, rows = tables
    net = quality.fit(docs, labels)

    def plain(text):
        data = text or b""
        features = []
        for begin in range(0, max(1, len(data) - quality.WIDTH), quality.CHUNK - quality.WIDTH):
            chunk = data[begin : begin + quality.CHUNK].ljust(quality.CHUNK, b"\0")
            values = [np.concatenate([net.embed[b] for b in chunk[i : i + quality.WIDTH]]) @ net.filters for i in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)]
            features.append(np.maximum(np.max(values, axis=0) + net.bias, 0))
        pooled = np.concatenate([np.max(features, axis=0), np.mean(features, axis=0), np.min(features, axis=0)])
        return 1 / (1 + np.exp(-(pooled.astype(np.float64) @ net.weights + net.offset)))

    data = [None, b"", b"abc", bytes(range(256)) * 5] + [r[1].encode() for r in rows[:10]]
    assert quality.probabilities(net, data) == pytest.approx([plain(t) for t in data], abs=1e-4)


def scanned(model, text, chunk):
    """Ids by matrices, their product and the chunks between the states, without Spark."""
    whole, rows = " " + text, []
    for n, i in enumerate(range(0, len(whole), chunk)):
        base, stop = max(0, i - model.longest), min(len(whole), i + chunk)
        around = whole[base : stop + model.longest]
        rows.append((n, base, around, [base + x for pair in model.transfer(around, i - base, stop - base, i == 0, stop == len(whole)) for x in pair]))
    table = pa.table({"key": ["k"] * len(rows), "node": pa.array([r[0] for r in rows], pa.int32()), "matrix": pa.array([r[3] for r in rows], pa.list_(pa.int64()))})
    total = piece_codec._combine(table)["matrix"][0].as_py()
    assert len(total) == 4
    for some in (1, len(rows) // 2):  # associative: the product of two products is the same
        halves = [piece_codec._combine(t) for t in (table[:some], table[some:]) if t.num_rows]
        assert piece_codec._combine(pa.concat_tables(halves))["matrix"][0].as_py() == total
    table = table.append_column("left", pa.array([total[:2]] * len(rows))).append_column("right", pa.array([total[2:]] * len(rows)))
    ids = []
    for (_, base, around, _), state in zip(rows, piece_codec._hand_down(table).to_pylist()):
        ids += model.encode([around[state["left"][1] - base : state["right"][1] - base]])[0].tolist()
    return ids


def test_scan_cuts_words_and_runs_without_spaces():
    library, model = sentencepiece.SentencePieceProcessor(model_file=PATH), piece_codec.load(PATH)
    rng = random.Random(11)
    texts = ["a" * 300, "ab" * 200, " " * 150, "  x   " * 40, "これは日本語の文章です東京都に住んでいます" * 12, "internationalization" * 20, "_" * 200, "🙂é" * 60]
    for alphabet in ("ab ", " x", "theing ", "あいう 東京", "0123. ", 'aA\'"\n '):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30, 300))) for _ in range(8)]
    for text in texts:
        for chunk in (17, 40, 128):
            assert scanned(model, text, chunk) == library.encode(text), (text, chunk)


def test_stages_on_empty_and_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, None, None, None, None), (None, text, "en", "s", 1), (None, text, "en", "s", 1), (1, text, "en", None, 1), (1, text, "de", None, 1), (1, "quite another text of one doc_id", "en", None, 1), (2, None, "en", "s", None), (3, "", "en", "s", 0)]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), str(tmp_path)).collect() == []
        assert stage(spark, spark.createDataFrame(rows, schema), str(tmp_path)).count() > 0
    kept = corpus_pipeline.minhash_dedup(spark, spark.createDataFrame(rows, schema), str(tmp_path)).collect()
    assert sorted((r.text or "")[:5] for r in kept if r.doc_id == 1) == ["quite", "w0 w1"]
    assert sum(r.doc_id is None for r in kept) == 3 and {2, 3} <= {r.doc_id for r in kept}
    mixed = corpus_pipeline.source_mix(spark, spark.createDataFrame(rows, schema), str(tmp_path)).collect()
    taken = corpus_pipeline.mixing.mix(spark.createDataFrame(rows, schema)).collect()
    assert sum(len(r.text.split()) for r in mixed) == sum(r.taken for r in taken)


def test_a_task_learns_from_the_sample_in_order(spark, tables):
    docs, labels = tables[0], tables[1]
    sample = sampling.labelled(docs, labels, "quality", sampling.remainder("doc_id", 3) != 1, 40)
    rows = sorted(sample.collect(), key=lambda r: r.doc_id)
    assert len(rows) > 40 and all(sum(r.label == v for r in rows) <= 40 for v in (0, 1))
    assert sampling.fitted(sample.repartition(5), lambda data, y: (data, y)) == ([bytes(r.text) for r in rows], [r.label for r in rows])
    assert sampling.fitted(sample.limit(0), lambda data, y: (data, y)) == ([], [])
