"""Cross-tokenizer alignment: minimal groups of tokens of two tokenizers, and how often corpus-wide two ids are linked.

Each text is encoded once by both.  Tokens are nodes, and tokens of the two sides that overlap in bytes are joined by union-find; a component is a minimal
group, between two neighbouring places where tokens of both sides end.  Every token names the token of the other side that
covers its first byte (a token of side A that begins together with one of side B names nobody), so the roots are found for a whole batch by
path halving.  Components expand to links.

A document's linked id pairs go out once each, with how often it links them.  They are added up per task before they are
shuffled.  The most frequent pairs, at most ``HOT`` of them, are sent to all tasks, which look them up where the document's pairs are; only the
rest meets its counts by a join.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, cut

#: Most pairs of ids that are sent to all tasks (17 bytes each); id pairs that a task adds up before it passes them on; links of one group
#: above which it is expanded by distinct ids.
HOT, ADDED, WIDE = 1 << 19, 1 << 20, 4096
#: The alphabet of byte-level vocabularies, fixed by the format: printable bytes stand for themselves, the others for 256 and on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_OF = {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}


class ByteLevel:
    """Side A: a byte-level .json vocabulary.  Encodes by ranks where merges are in the order of ids, else by the library of the format."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.bytes = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for text, i in vocab.items():
            self.bytes[i] = bytes(_BYTE_OF[c] for c in text) if all(c in _BYTE_OF for c in text) else b""
        kind = model.get("pre_tokenizer") or {}
        in_order = all(vocab["".join(m if isinstance(m, list) else m.split(" "))] == 256 + i for i, m in enumerate(merges))
        if in_order and kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not model.get("normalizer"):
            ranks = {self.bytes[i]: i for text, i in vocab.items() if text not in special}
            self._ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        else:
            self._ranks, self._library = None, Tokenizer.from_file(path)
            self._library.no_truncation()
            self._library.no_padding()
            self._library.encode_special_tokens = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self._ranks is not None:
            return [self._ranks.encode_ordinary(t) for t in texts]
        return [e.ids for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]


#: How byte-level vocabularies cut a text before they merge, fixed by the format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Pieces:
    """Side B: a .model file; its encoder adds the space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: self._model.is_control(i) or self._model.is_unknown(i) or self._model.is_unused(i)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.vocab_size())]
        self.bytes = [b"" if special(i) else bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


def groups(end_a: np.ndarray, end_b: np.ndarray, start_a: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the group of each token of A and of B, from 0 in order; both sides cover the same bytes, and no token is empty."""
    n = len(end_a)
    cover_a = np.searchsorted(end_b, start_a, side="right")
    parent = np.concatenate([np.where(start_b[cover_a] < start_a, n + cover_a, np.arange(n)), np.searchsorted(end_a, start_b, side="right")]) if n else np.zeros(0, dtype=np.int64)
    while True:
        above = parent[parent]
        if (above == parent).all():
            break
        parent = above
    number = np.cumsum(parent[:n] == np.arange(n)) - 1
    found = number[parent]
    return found[:n], found[n:]


def _expand(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranges ``first[i]:first[i] + counts[i]``, end to end."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())


def links(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, document: np.ndarray, size_b: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document * size + a * size_b + b, times) of each document's linked id pairs, in order; ``document`` is that of each group."""
    n = len(document)
    count_a, count_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    first_b = np.concatenate([[0], np.cumsum(count_b)])[:-1]
    wide = count_a * count_b > WIDE
    some = ~wide[group_a]
    fan = count_b[group_a[some]]
    key = np.repeat(document[group_a[some]] * size + ids_a[some].astype(np.int64) * size_b, fan) + ids_b[_expand(first_b[group_a[some]], fan)]
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    key, times = key[new], np.diff(np.append(new, len(key)))
    for g in np.flatnonzero(wide):
        (a, n_a), (b, n_b) = (np.unique(ids[group == g], return_counts=True) for ids, group in ((ids_a, group_a), (ids_b, group_b)))
        more = (document[g] * size + a.astype(np.int64)[:, None] * size_b + b[None, :]).ravel()
        key, times = np.concatenate([key, more]), np.concatenate([times, np.outer(n_a, n_b).ravel()])
    if wide.any():
        key, back = np.unique(key, return_inverse=True)
        times = np.bincount(back, weights=times).astype(np.int64)
    return key, times


def _transposed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), 8).T).tobytes()


def pack(codes: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending codes and their times as compressed bytes."""
    steps = np.diff(codes, prepend=0).astype(np.int64)
    return len(codes).to_bytes(8, "little") + pa.compress(_transposed(steps) + _transposed(times.astype(np.int64)), codec="zstd", asbytes=True)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.decompress(data[8:], 16 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    steps, times = (np.ascontiguousarray(part.reshape(8, n).T).view(np.int64).ravel() for part in (raw[: 8 * n], raw[8 * n :]))
    return np.cumsum(steps), times


class Aligner:
    """Both tokenizers with what a batch of texts needs of them."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.size_a, self.size_b = len(self.a.bytes), len(self.b.bytes)
        self.size = self.size_a * self.size_b
        self._bytes = [pa.array(side.bytes, pa.binary()) for side in (self.a, self.b)]
        self._lengths = [np.array([len(x) for x in side.bytes], dtype=np.int64) for side in (self.a, self.b)]
        # Decimal ids with what may follow them: within a side of a group, after A's side, after B's side.
        self._texts = pa.array([f"{i}{mark}" for mark in ",|;" for i in range(max(self.size_a, self.size_b))])

    def _encoded(self, side: int, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Ids end to end, where each text's begin, and each text's joined bytes."""
        lists = (self.a, self.b)[side].encode(texts)
        first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        ids = np.fromiter((i for x in lists for i in x), dtype=np.int64, count=first[-1])
        at = np.concatenate([[0], np.cumsum(self._lengths[side][ids])])[first]
        data = b"".join(self._bytes[side].take(pa.array(ids)).to_pylist()) if len(ids) < 64 else bytes(self._joined(self._bytes[side], ids))
        return ids, first, [data[b:e] for b, e in zip(at[:-1], at[1:])]

    @staticmethod
    def _joined(table: pa.Array, ids: np.ndarray) -> memoryview:
        """The values at ``ids``, end to end: those of a taken array lie so."""
        taken = table.take(pa.array(ids))
        offsets = np.frombuffer(taken.buffers()[1], dtype=np.int32)[taken.offset : taken.offset + len(taken) + 1]
        return memoryview(taken.buffers()[2])[offsets[0] : offsets[-1]]

    def align(self, texts: list[str | None]) -> dict[str, list]:
        """Columns n_a, n_b, n_groups, n_links, groups_sha256 and pairs of the texts."""
        out = {k: [0] * len(texts) for k in ("n_a", "n_b", "n_groups", "n_links")} | {"groups_sha256": [""] * len(texts), "pairs": [None] * len(texts)}
        asked = [i for i, t in enumerate(texts) if t]
        spaced = [" " + texts[i] for i in asked]
        ids_a, first_a, bytes_a = self._encoded(0, spaced)
        ids_b, first_b, bytes_b = self._encoded(1, [texts[i] for i in asked])
        good = np.array([x == y == s.encode() for x, y, s in zip(bytes_a, bytes_b, spaced)], dtype=bool)
        if not good.any():
            return out
        n_a, n_b = np.diff(first_a), np.diff(first_b)
        ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
        asked, n_a, n_b = np.array(asked)[good], n_a[good], n_b[good]
        size_a, size_b = self._lengths[0][ids_a], self._lengths[1][ids_b]
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        group_a, group_b = groups(end_a, end_b, end_a - size_a, end_b - size_b)
        edge_a, edge_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        total = int(group_a[-1]) + 1
        document = np.empty(total, dtype=np.int64)
        document[group_a] = np.repeat(np.arange(len(asked)), n_a)
        n_groups = np.bincount(document, minlength=len(asked))
        n_links = np.bincount(document, weights=np.bincount(group_a, minlength=total) * np.bincount(group_b, minlength=total), minlength=len(asked)).astype(np.int64)
        key, times = links(ids_a, ids_b, group_a, group_b, document, self.size_b, self.size)
        cuts = np.searchsorted(key, np.arange(len(asked) + 1) * self.size)
        text, at = self._text(ids_a, ids_b, group_a, group_b, edge_a, edge_b)
        for d, i in enumerate(asked):
            out["n_a"][i], out["n_b"][i], out["n_groups"][i], out["n_links"][i] = (int(x[d]) for x in (n_a, n_b, n_groups, n_links))
            out["groups_sha256"][i] = hashlib.sha256(text[at[d] : at[d + 1] - 1]).hexdigest()
            some = slice(cuts[d], cuts[d + 1])
            out["pairs"][i] = pack(key[some] - d * self.size, times[some])
        return out

    def _text(self, ids_a, ids_b, group_a, group_b, edge_a, edge_b) -> tuple[memoryview, np.ndarray]:
        """All groups as text, each ended by a semicolon, and where each document's begin."""
        width, n = max(self.size_a, self.size_b), len(ids_a) + len(ids_b)
        last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (group_a, group_b))
        # A token of A stands behind all tokens of B of the groups before it, one of B behind those of A of its group and before.
        place_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a, side="left")
        place_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, side="right")
        code = np.empty(n, dtype=np.int64)
        code[place_a], code[place_b] = ids_a + width * last_a, ids_b + 2 * width * last_b
        taken = self._texts.take(pa.array(code))
        offsets = np.frombuffer(taken.buffers()[1], dtype=np.int32)[: n + 1]
        return memoryview(taken.buffers()[2]), offsets[edge_a + edge_b]


_COLUMNS = "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"


def encoded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each row of ``docs``: a ``key`` of its own, doc_id, counts, the digest of its groups and its packed id pairs; written out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        for batch in by_bytes(batches, "text"):
            out = {"key": batch.column("key"), "doc_id": batch.column("doc_id")} | aligner.align(batch.column("text").to_pylist())
            schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("pairs", pa.binary())])
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    named = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(named.mapInArrow(rows, _COLUMNS))


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of documents to (code, documents), added up over up to ``ADDED`` pairs at a time."""
    empty = np.zeros(0, dtype=np.int64)

    def add(parts):
        code, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return code, np.bincount(back, weights=np.concatenate([p[1] for p in parts]), minlength=len(code)).astype(np.int64)

    def ready(code, n):
        return pa.RecordBatch.from_pydict({"code": pa.array(code), "n": pa.array(n)})

    total, waiting, held = (empty, empty), [], 0
    for batch in batches:
        for data in batch.column("pairs"):
            if not data.is_valid:
                continue
            code, _ = unpack(data.as_py())
            waiting.append((code, np.ones(len(code), dtype=np.int64)))
            held += len(code)
            if held >= ADDED:
                total, waiting, held = add([total, *waiting]), [], 0
                if len(total[0]) >= 2 * ADDED:
                    yield ready(*total)
                    total = (empty, empty)
    if waiting:
        total = add([total, *waiting])
    if len(total[0]):
        yield ready(*total)


def counted(coded: DataFrame, size_b: int) -> DataFrame:
    """(code, n, best): in how many documents each id pair is linked, and whether no pair of its A id is linked in more."""
    n = cut(coded.select("pairs").mapInArrow(_added, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).withColumn("a", F.floor(F.col("code") / size_b)))
    top = n.groupBy("a").agg(F.max("n").alias("top"))
    return cut(n.join(top, "a").select("code", "n", (F.col("n") == F.col("top")).alias("best")))


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a, b, n_docs, best): the corpus-wide table of linked ids, as ``align`` counts them."""
    size_b = len(Pieces(path_b).bytes)
    return counted(encoded(docs, path_a, path_b), size_b).select(F.floor(F.col("code") / size_b).alias("a"), (F.col("code") % size_b).alias("b"), F.col("n").alias("n_docs"), "best")


def align(docs: DataFrame, path_a: str, path_b: str, hot: int = HOT) -> DataFrame:
    """Align two tokenizers on each text and weigh its links by how many documents hold them.

    ``path_a``: a byte-level .json vocabulary, which encodes space + text; ``path_b``: a .model file, which adds the space.  Strings of special tokens in
    texts are plain text.  A token's bytes are A's byte-level characters decoded and B's piece in UTF-8 with U+2581 as space, or its byte.  Null and empty texts, and those whose joined bytes of
    either side differ from space + text, have no tokens.  A group lies between neighbouring byte offsets at which tokens of both sides end; every
    token of A in it is linked with every one of B, for each occurrence.  Repeated rows are documents of their own, a null doc_id stays null, other
    columns are ignored, an empty table gives no rows.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is linked in as many documents as any pair of their A id), count_sum (of documents, over
    links) and groups_sha256 (of ``a1,a2|b1;a3|b2,b3``, or empty without tokens).
    """
    spark = docs.sparkSession
    size_b = len(Pieces(path_b).bytes)
    coded = encoded(docs.select("doc_id", "text"), path_a, path_b)
    counts = counted(coded, size_b)
    # At most ``hot`` rows of three numbers, whatever the size of the corpus.
    most = counts.orderBy(F.desc("n"), "code").limit(hot).toArrow().sort_by("code")
    known = spark.sparkContext.broadcast(tuple(most.column(c).to_numpy(zero_copy_only=False) for c in ("code", "n", "best")))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, numbers, best = known.value
        for batch in batches:
            out = {c: [] for c in ("n_best", "count_sum", "rare", "rare_times")}
            for data in batch.column("pairs"):
                code, times = unpack(data.as_py()) if data.is_valid else (np.zeros(0, dtype=np.int64),) * 2
                at = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
                hit = codes[at] == code if len(codes) else np.zeros(len(code), dtype=bool)
                out["n_best"].append(int(times[hit][best[at[hit]]].sum()))
                out["count_sum"].append(int((times[hit] * numbers[at[hit]]).sum()))
                out["rare"].append(code[~hit])
                out["rare_times"].append(times[~hit])
            lists = pa.list_(pa.int64())
            more = [pa.array(out["n_best"], pa.int64()), pa.array(out["count_sum"], pa.int64()), pa.array(out["rare"], lists), pa.array(out["rare_times"], lists)]
            keep = [c for c in batch.schema.names if c != "pairs"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + more, names=[*keep, *out])

    looked = coded.mapInArrow(look, _COLUMNS.replace("pairs binary", "n_best long, count_sum long, rare array<long>, rare_times array<long>"))
    rare = looked.where("size(rare) > 0").select("key", F.explode(F.arrays_zip("rare", "rare_times")).alias("p")).select("key", F.col("p.rare").alias("code"), F.col("p.rare_times").alias("times"))
    rare = rare.join(counts, "code").groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    zero = F.lit(0).cast("long")
    rows = looked.drop("rare", "rare_times").join(rare, "key", "left")
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", zero)).alias("count_sum"), "groups_sha256")
