"""Token alignment, decontamination and centroid clustering against brute force, and on odd inputs."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tracewright.llm import alignment, centroids, contamination
from tracewright.llm.queries import BYTE_BPE, PIECE_BPE

DOCS = "doc_id long, text string, key string, term string, n int"


def documents(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "k", "t", 1) for i, t in enumerate(texts)], DOCS)


ODD = [
    "The quick brown fox isn't here.", "", None, "  two  spaces\n\nand\ttabs ", "naïve café Straße 中文字符 日本語", "emoji 😀😀 mix", "a▁b is not ours", "<|endoftext|> stays text <s> </s>",
    "x" * 3000, "ab" * 2000, "\x00\x01\x07 bytes", "The quick brown fox isn't here.", "1234567890 3.14159 0x1F", "é combining ‍ joiner", "한국어 텍스트",
]


def brute_alignment(texts):
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    a.encode_special_tokens = True
    vocab = {i: s for s, i in json.load(open(BYTE_BPE, encoding="utf-8"))["model"]["vocab"].items()}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    rows, seen = [], Counter()
    for t in texts:
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        bytes_a = [bytes(back[c] for c in vocab[i]) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
        if not t or not (b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode()):
            rows.append(([], [], []))
            continue
        ends = [set(np.cumsum([len(x) for x in side]).tolist()) for side in (bytes_a, bytes_b)]
        cuts, found, sides = sorted(ends[0] & ends[1]), [], []
        for ids, parts in ((ids_a, bytes_a), (ids_b, bytes_b)):
            groups, end = [[] for _ in cuts], 0
            for i, p in zip(ids, parts):
                end += len(p)
                groups[next(k for k, c in enumerate(cuts) if end <= c)].append(i)
            sides.append(groups)
        found = list(zip(*sides))
        rows.append((ids_a, ids_b, found))
        seen.update({(x, y) for g in found for x in g[0] for y in g[1]})
    top = {}
    for (x, _), n in seen.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for ids_a, ids_b, found in rows:
        links = [(x, y) for g in found for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in found)
        out.append((len(ids_a), len(ids_b), len(found), len(links), sum(seen[p] == top[p[0]] for p in links), sum(seen[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if found else ""))
    return out, seen, top


@pytest.mark.parametrize("hot", [alignment.HOT, 40])
def test_alignment_is_that_of_common_ends(spark, hot):
    """With all pairs sent to the tasks, and with most of them met by the join."""
    words = "The quick brown fox isn't über straße naïve 中文 😀 tokenization internationalization 2024".split()
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(40)]
    want, _, _ = brute_alignment(texts)
    rows = alignment.align(documents(spark, texts).repartition(5), BYTE_BPE, PIECE_BPE, hot=hot).collect()
    got = {r.doc_id: tuple(r)[1:] for r in rows}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == want[i], t


def test_pair_counts(spark):
    texts = ["one two three", "one two", "one", None]
    _, seen, top = brute_alignment(texts)
    got = {(r.a, r.b): (r.n_docs, r.best) for r in alignment.pair_counts(documents(spark, texts), BYTE_BPE, PIECE_BPE).collect()}
    assert got == {p: (n, n == top[p[0]]) for p, n in seen.items()}


def test_wide_groups_are_expanded_by_distinct_ids(monkeypatch):
    rng = np.random.default_rng(5)
    ids_a, ids_b = rng.integers(0, 9, 200), rng.integers(0, 7, 150)
    group_a, group_b = np.sort(rng.integers(0, 6, 200)), np.sort(rng.integers(0, 6, 150))
    document = np.array([0, 0, 0, 1, 1, 1])
    plain = alignment.links(ids_a, ids_b, group_a, group_b, document, 7, 63)
    monkeypatch.setattr(alignment, "WIDE", 10)
    wide = alignment.links(ids_a, ids_b, group_a, group_b, document, 7, 63)
    assert all((x == y).all() for x, y in zip(plain, wide)) and plain[1].sum() == sum((group_a == g).sum() * (group_b == g).sum() for g in range(6))
    assert all((x == y).all() for x, y in zip(plain, alignment.unpack(alignment.pack(*plain))))


def test_ranks_give_the_librarys_ids():
    from tokenizers import Tokenizer

    library, side = Tokenizer.from_file(BYTE_BPE), alignment.ByteLevel(BYTE_BPE)
    library.encode_special_tokens = True
    rng = random.Random(11)
    alphabet = "ab cdE'sltré1٣ \n\t 　中😀-_.,<|endoftext|>"
    texts = [t for t in ODD if t] + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(400)]
    assert side._ranks is not None
    assert side.encode(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_alignment_of_nothing(spark):
    assert alignment.align(documents(spark, []), BYTE_BPE, PIECE_BPE).count() == 0
    rows = alignment.align(documents(spark, [None, "", "same", "same"], [None, 1, 2, 2]), BYTE_BPE, PIECE_BPE).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_a) for r in rows) == [(False, 1, 0), (False, 2, 1), (False, 2, 1), (True, 0, 0)]
    assert {r.groups_sha256 for r in rows if not r.n_a} == {""}


def test_alignment_of_a_very_long_text(spark):
    text = "long texts are one document too. " * 60_000
    r = alignment.align(documents(spark, [text]), BYTE_BPE, PIECE_BPE).first()
    assert r.n_a > 400_000 and r.n_links >= r.n_groups > 400_000


TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_contamination(texts, items, window):
    out = []
    windows = [(i, w[k : k + window]) for i, t in items for w in [terms(t)] if w for k in range(max(1, len(w) - window + 1))]
    for t in texts:
        words, hit, ids = terms(t), set(), set()
        for i, w in windows:
            for p in range(len(words) - len(w) + 1):
                if words[p : p + len(w)] == w:
                    hit.update(range(p, p + len(w)))
                    ids.add(i)
        named = sorted(str(i) for i in ids if i is not None)
        out.append((len(words), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return out


def bench(spark, items):
    return spark.createDataFrame([(i, t, "x", 3) for i, t in items], "item_id long, text string, doc_id string, pos int")


@pytest.mark.parametrize("window", [3, 10])
def test_decontamination_finds_every_window(spark, window):
    rng = random.Random(window)
    vocabulary = ["the", "of", "Of", "a1", "É", "é", "straße", "b", "c", "zz", "q"]
    text = lambda n: "".join(w + rng.choice([" ", ", ", "\n", "--"]) for w in rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice([0, 1, 2, 5, 12, 25]))) for i in range(14)] + [(7, "the of the"), (20, None), (21, "same words here"), (22, "same words here"), (None, "q q zz b")]
    texts = [text(rng.randint(0, 60)) for _ in range(60)] + ["x " + (rng.choice(items)[1] or "") + " y " + (rng.choice(items)[1] or "") for _ in range(40)]
    texts += [None, "", "...", "!same WORDS, here?", "a" * 5000, "word " * 4000, texts[0], texts[0]]
    want = brute_contamination(texts, items, window)
    ids = [*range(len(texts) - 2), 0, 0]
    ids[1] = None
    rows = contamination.decontaminate(documents(spark, texts, ids), bench(spark, items), window).collect()
    key = lambda i, r: (i is None, i or 0, *r)
    assert sorted(key(r.doc_id, (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in rows) == sorted(key(i, w) for i, w in zip(ids, want))
    assert any(w[-1] for w in want) and not all(w[-1] for w in want)


def test_decontamination_of_nothing_and_of_long_texts(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven")]
    assert contamination.decontaminate(documents(spark, []), bench(spark, items)).count() == 0
    assert [r.contaminated for r in contamination.decontaminate(documents(spark, ["one two"]), bench(spark, [])).collect()] == [False]
    text = "filler words " * 100_000 + items[0][1].upper() + " filler" * 100_000 + " " + items[0][1]
    r = contamination.decontaminate(documents(spark, [text]), bench(spark, items)).first()
    assert (r.n_words, r.n_hit, r.n_items) == (300_022, 22, 1)


def test_matches_give_the_runs(spark):
    items = [(5, "a b c d e f"), (6, "c d e")]
    rows = contamination.matches(documents(spark, ["z a b c d q c d e f"]), bench(spark, items), 3).collect()
    assert sorted((r.item_id, r.end - r.begin) for r in rows) == [("5", 4), ("5", 4), ("6", 3)]


def test_proximity_matches(spark):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choices("abcdefgh", k=4))) for i in range(12)]
    texts = [" ".join(rng.choices("abcdefghij", k=rng.randint(1, 25))) for _ in range(40)]
    slop, want = 2, set()
    for d, t in enumerate(texts):
        words = terms(t)
        for i, item in items:
            need = set(terms(item))
            if any(need <= set(words[p : p + 4 + slop]) for p in range(len(words))):
                want.add((d, str(i)))
    got = {(r.doc, r.item_id) for r in contamination.near_matches(documents(spark, texts), bench(spark, items), 4, slop).collect()}
    assert got == want and want


def brute_clusters(vectors, k, rounds):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in vectors if i is not None and v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                c = [*c[:j], [sum(col) // len(mine) for col in zip(*mine)], *c[j + 1 :]]
    found = [(i, *near(v)) for i, v in kept]
    total = Counter()
    for _, d, j in found:
        total[j] += d
    return sorted((i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in found)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, hash string")


@pytest.mark.parametrize("scale", [1.0, 5e5])
def test_clusters_are_exact(spark, scale):
    """Grouped, tied and repeated vectors; at the larger scale components pass 26 bits."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(5, 64))
    rows = [(i, [float(x) for x in scale * np.round(centres[i % 5] + rng.normal(size=64) * 0.3, 2)]) for i in range(300)]
    rows += [(300 + i, rows[i % 3][1]) for i in range(40)] + [(400 + i, [float(i % 2) * scale] * 64) for i in range(20)]
    rows += [(500, None), (501, [1.0]), (502, [None] * 64), (503, [float("nan")] * 64), (504, [float("inf")] + [0.0] * 63), (None, [0.0] * 64), (0, rows[9][1])]
    got = sorted(tuple(r) for r in centroids.cluster(vectors(spark, rows).repartition(3), leaf=4).collect())
    assert got == brute_clusters(rows, 16, 3)


def test_few_and_no_vectors(spark):
    rows = [(3, [1.5] * 64), (4, [-2.0] * 64)]
    assert sorted(tuple(r) for r in centroids.cluster(vectors(spark, rows)).collect()) == brute_clusters(rows, 16, 3)
    assert centroids.cluster(vectors(spark, [])).count() == 0 and centroids.cluster(vectors(spark, [(1, None)])).count() == 0


def test_trees_prune_and_take_whole_nodes():
    rng = np.random.default_rng(1)
    c = rng.integers(-50, 50, (8, 3)) * 100
    x = c[rng.integers(0, 8, 2000)] + rng.integers(-9, 10, (2000, 3))
    tree = centroids.Tree(x)
    owner, counts, sums, done = centroids.filtered(tree, c)
    far = ((tree.x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (owner == far.argmin(axis=1)).all() and (counts == np.bincount(owner, minlength=8)).all()
    assert all((sums[j] == tree.x[owner == j].sum(axis=0)).all() for j in range(8))
    assert done["whole"] > 0 and done["pruned"] > 0 and done["compared"] < far.size / 4


def test_vocabularies_are_read_from_their_files():
    assert BYTE_BPE == public_tokenizers.path("byte_bpe_50k.json") and len(alignment.Pieces(PIECE_BPE).bytes) == 32_000
