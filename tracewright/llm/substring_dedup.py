"""Substring dedup over a compacted De Bruijn graph of words.

The graph's nodes are k-mers, and storing an edge for every word would cost more than the text.  So each
window of ``window`` words selects one of its k-mers (winnowing), and the run of windows that select the
same k-mer is one edge through it, keyed by that k-mer and by a hash of all the run's words.  The selection
depends on the window's words alone, so equal windows lie in runs with an equal k-mer.

1. k-mers that occur in one document only are dropped, and with them nearly all of a clean corpus.
2. Where every run of a k-mer has the same words the graph does not branch there: a Spark join with the
   run's source (the smallest document that has it, and its coordinates there) settles all its windows.
3. Where runs of a k-mer differ the graph branches.  One copy of each such run, at its source
   coordinates, is expanded to single windows, and these are joined with their own sources.
4. Runs and windows that follow each other in a document and in its source are compacted to one long
   path.  Its words are read at the source coordinates and digested there, and it is removed only if the
   document's own words give that digest.

Only documents that some path touches are shuffled with their texts.  They are told from the others by a
bitmap of the hashes of their doc_ids, which has a fixed size; a false hit costs a shuffled row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import apart, by_bytes, cut, texts

WINDOW, KMER = 50, 10
#: Bits of a selection key that hold the word's position in the batch (a text has under 2**31 words); the rest hold the k-mer's hash.
_POSITION = np.uint64((1 << 31) - 1)
#: Bits of the bitmap of touched documents; it is broadcast, in at most BITMAP / 8 bytes.
BITMAP = 1 << 26
#: Words of a block of a source.  A long path is digested block by block, so that the digests asked of a source are bounded by its length, however many copies it has.
BLOCK = 128
_DOC = ["doc_id", "tag"]


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values, by doubling."""
    width = 1
    while width * 2 <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = size - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def paths(w: W.Words, window: int = WINDOW, kmer: int = KMER) -> dict[str, np.ndarray]:
    """Runs of each text: text number, selected k-mer, hash of the run's words, first word, words."""
    hashes = W.word_hashes(w)
    empty = {k: np.zeros(0, dtype=np.int64) for k in ("text", "kmer", "path", "start", "length")}
    if len(hashes) < window:
        return empty
    runs = W.Runs(hashes)
    grams = runs.windows(kmer)
    keys = (grams & ~_POSITION) | (_POSITION - np.arange(len(grams), dtype=np.uint64))
    chosen = (_POSITION - (_sliding_min(keys, window - kmer + 1) & _POSITION)).astype(np.int64)
    owner = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    starts = np.flatnonzero(owner[: len(chosen)] == owner[window - 1 : window - 1 + len(chosen)])
    if not len(starts):
        return empty
    chosen, text = chosen[starts], owner[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    lo, hi = starts[at], starts[np.append(at[1:], len(starts)) - 1] + window
    anchor = chosen[at]
    content = W.mix(runs.spans(lo, hi) + (anchor - lo).astype(np.uint64))
    return {"text": text[at], "kmer": grams[anchor].view(np.int64), "path": content.view(np.int64), "start": lo - w.first[text[at]], "length": hi - lo}


def _once(text: np.ndarray, keys: list[np.ndarray], start: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Rows to keep of those with equal text and keys, and the starts of the others for each kept row; null if there are none.

    Text that repeats a few words has the same run again and again; it is one row of the document then.
    """
    order = np.lexsort((start, *keys, text))
    new = np.ones(len(order), dtype=bool)
    new[1:] = False
    for column in (text, *keys):
        new[1:] |= column[order[1:]] != column[order[:-1]]
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(order)))
    offsets = np.concatenate([[0], np.cumsum(sizes - 1)]).astype(np.int32)
    return order[first], pa.ListArray.from_arrays(pa.array(offsets), pa.array(start[order[~new]].astype(np.int32)), mask=pa.array(sizes == 1))


def _place(tags: pa.Array, start: np.ndarray) -> pa.Array:
    """A row's tag and a word of its text in one number."""
    return pa.array((tags.to_numpy(zero_copy_only=False).astype(np.int64) << 32) | start)


def _path_rows(window: int, kmer: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            found = paths(W.split(texts(batch.column("text"))), window, kmer)
            keep, also = _once(found["text"], [found["kmer"], found["path"]], found["start"])
            at, start = pa.array(found["text"][keep]), found["start"][keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found["kmer"][keep]), pa.array(found["path"][keep]), batch.column("doc_id").take(at), _place(batch.column("tag").take(at), start), pa.array(found["length"][keep].astype(np.int32)), also],
                names=["kmer", "path", "doc_id", "place", "length", "also"],
            )

    return rows


def _edge_rows(window: int):
    """Each row's texts and ranges to the windows in the ranges."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            w = W.split(texts(batch.column("text")))
            windows = W.Runs(W.word_hashes(w)).windows(window)
            owner, starts = [], []
            for i, ranges in enumerate(batch.column("ranges").to_pylist()):
                at = np.unique(np.concatenate([np.arange(x, x + r["length"] - window + 1) for r in ranges for x in (r["start"], *(r["also"] or ()))]))
                owner.append(np.full(len(at), i))
                starts.append(at)
            owner, starts = np.concatenate(owner), np.concatenate(starts)
            edges = windows[starts + w.first[owner]].view(np.int64)
            keep, also = _once(owner, [edges], starts)
            take = pa.array(owner[keep])
            yield pa.RecordBatch.from_arrays(
                [pa.array(edges[keep]), batch.column("doc_id").take(take), _place(batch.column("tag").take(take), starts[keep]), also],
                names=["edge", "doc_id", "place", "also"],
            )

    return rows


def _digest(parts: list[bytes], start: int, length: int) -> bytes:
    """What tells a run of words: 128 bits of a cryptographic hash."""
    return hashlib.blake2b(b" ".join(parts[start : start + length]), digest_size=16).digest()


def _source_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the words at the coordinates that are asked of a source."""
    for batch in by_bytes(batches, "text"):
        out = {"doc_id": [], "tag": [], "start": [], "length": [], "digest": []}
        for doc_id, tag, text, asked in zip(batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), texts(batch.column("text")), batch.column("ranges").to_pylist()):
            parts = text.split()
            for a in asked:
                for name, value in zip(out, (doc_id, tag, a["start"], a["length"], _digest(parts, a["start"], a["length"]))):
                    out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("tag", pa.int32()), ("start", pa.int32()), ("length", pa.int32()), ("digest", pa.binary())]))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words without those of verified spans, and of runs that repeat inside the document what a verified span holds."""
    for batch in by_bytes(batches, "text"):
        removed, total, digest, kept = [], [], [], []
        for text, spans, again in zip(texts(batch.column("text")), batch.column("spans").to_pylist(), batch.column("again").to_pylist()):
            parts = (text or b"").split()
            total.append(len(parts))
            if spans:
                change = np.zeros(len(parts) + 1, dtype=np.int64)
                for s in spans:
                    for start in s["starts"]:
                        if _digest(parts, start, s["length"]) == s["digest"]:
                            change[start] += 1
                            change[start + s["length"]] -= 1
                told = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
                for run in again or ():
                    lo, hi = run["start"], run["start"] + run["length"]
                    if told[hi] - told[lo] == hi - lo:
                        words = parts[lo:hi]
                        for start in run["also"]:
                            if parts[start : start + hi - lo] == words:
                                change[start] += 1
                                change[start + hi - lo] -= 1
                stay = np.cumsum(change[:-1]) == 0
                parts = [parts[i] for i in np.flatnonzero(stay)]
            removed.append(total[-1] - len(parts))
            rest = b" ".join(parts)
            digest.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest if removed[-1] else text)
        columns = [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns + [batch.column("more")], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "more"])


def touched(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``docs`` whose key may be among ``ids``, and those whose key is not, without a shuffle of ``docs``."""
    slot = F.pmod(F.xxhash64(key), F.lit(BITMAP)) + 1
    bits = ids.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket_")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits_"))
    place = F.pmod(slot - 1, F.lit(32768))
    byte = F.conv(F.hex(F.substring("bits_", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("shiftright", byte, F.pmod(place, F.lit(8)).cast("int")).bitwiseAND(1) == 1, F.lit(False))
    seen = docs.withColumn("bucket_", F.bitmap_bucket_number(slot)).join(F.broadcast(bits), "bucket_", "left").withColumn("hit_", hit).drop("bucket_", "bits_")
    return seen.where("hit_").drop("hit_"), seen.where("not hit_").drop("hit_")


def _compacted(spans: DataFrame) -> DataFrame:
    """Spans that overlap or follow each other at one distance from one source, as one."""
    path = [*_DOC, "source", "source_tag", "shift"]
    order = Window.partitionBy(*path).orderBy("start")
    before = F.max(F.col("start") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order))
    rows = rows.groupBy(*path, "run").agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("length")) - F.min("start")).cast("int").alias("length"))
    return rows.drop("run")


def _blocks(spans: DataFrame) -> DataFrame:
    """Spans cut at the blocks of their sources: a row for each piece of a source that a document has, with all places where it has it."""
    end = F.col("source_start") + F.col("length")
    rows = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("source_start") / BLOCK), F.floor((end - 1) / BLOCK))))
    low, high = F.greatest("source_start", F.col("block") * BLOCK), F.least(end, (F.col("block") + 1) * BLOCK)
    rows = rows.select(*_DOC, "source", "source_tag", (low + F.col("shift")).cast("int").alias("start"), low.cast("int").alias("source_start"), (high - low).cast("int").alias("length"))
    return rows.groupBy(*_DOC, "source", "source_tag", "source_start", "length").agg(F.collect_list("start").alias("starts"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """Remove words covered by a window that also starts in a document with a smaller doc_id.

    Words are runs of non-space bytes, unchanged; windows are judged on the input.  A null text has no
    words; texts shorter than ``window`` lose nothing.  Repeats inside one document, and between rows
    of the same doc_id, do not count.  A row with a null doc_id takes no part.  An empty table gives
    no rows.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), kept_text (the text
    unchanged where nothing is removed, else the kept words joined by one space) and more, a struct
    with the other columns of ``docs``.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *rest).alias("more"))
    rows = rows.withColumn("tag", F.hash("text"))
    known = rows.where("doc_id is not null and text is not null").select(*_DOC, "text", "more")
    path = known.select(*_DOC, "text").mapInArrow(_path_rows(window, kmer), "kmer long, path long, doc_id long, place long, length int, also array<int>")
    shared = path.groupBy("kmer").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("kmer")
    path = cut(apart(path, "kmer").join(apart(shared, "kmer"), "kmer_").withColumnRenamed("kmer_", "kmer"))
    compact = path.groupBy("kmer", "path").agg(F.min("doc_id").alias("source"), F.min_by("place", "doc_id").alias("source_place"))
    branching = compact.groupBy("kmer").agg((F.count("*") > 1).alias("branches"))
    compact = apart(compact, "kmer").join(apart(branching, "kmer"), "kmer_").withColumn("kmer", F.bitwise_not("kmer_")).drop("kmer_")
    tag = lambda place: F.shiftright(place, 32).cast("int")
    start = lambda place: F.col(place).bitwiseAND(0x7FFFFFFF).cast("int")
    path = apart(path, "kmer", "path").join(apart(compact, "kmer", "path"), ["kmer_", "path_"]).where("doc_id > source or branches")
    path = cut(path.select("doc_id", "place", "length", "also", "source", "source_place"))
    near, far = touched(known, path.select("doc_id").union(path.select("source")))
    # Where the graph branches, the sources' own runs become single windows.  All joins with texts read one shuffle of them.
    ranges = path.where("doc_id = source").select("doc_id", tag("place").alias("tag"), F.struct(start("place").alias("start"), "length", "also").alias("range"))
    ranges = ranges.groupBy(*_DOC).agg(F.collect_list("range").alias("ranges"))
    edges = near.join(ranges, _DOC).select(*_DOC, "text", "ranges", "more").mapInArrow(_edge_rows(window), "edge long, doc_id long, place long, also array<int>")
    sources = edges.groupBy("edge").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), F.min_by("place", "doc_id").alias("source_place")).where("source < last").drop("last")
    single = apart(edges, "edge").join(apart(sources, "edge"), "edge_").where("doc_id > source").withColumn("length", F.lit(window))
    columns = ["doc_id", "place", "length", "also", "source", "source_place"]
    spans = path.where("doc_id > source").select(*columns).union(single.select(*columns))
    # One row for each different run of a document: its first place meets the source, its other places meet the first one inside the document.
    spans = cut(spans.select("doc_id", tag("place").alias("tag"), start("place").alias("start"), "length", "also", "source", tag("source_place").alias("source_tag"), start("source_place").alias("source_start")))
    again = spans.where("also is not null").groupBy(*_DOC).agg(F.collect_list(F.struct("start", "length", "also")).alias("again"))
    # Dealt by document once, for all that follows.
    spans = _compacted(spans.withColumn("shift", F.col("start") - F.col("source_start")).drop("source_start", "also").repartition(*_DOC))
    spans = cut(_blocks(spans.withColumn("source_start", F.col("start") - F.col("shift"))))
    asked = spans.select(F.col("source").alias("doc_id"), F.col("source_tag").alias("tag"), F.struct(F.col("source_start").alias("start"), "length").alias("range")).distinct()
    asked = asked.groupBy(*_DOC).agg(F.collect_list("range").alias("ranges"))
    told = near.join(asked, _DOC).select(*_DOC, "text", "ranges", "more").mapInArrow(_source_rows, "doc_id long, tag int, start int, length int, digest binary")
    told = told.groupBy("doc_id", "tag", "start", "length").agg(F.first("digest").alias("digest"))
    at = ["source", "source_tag", "source_start", "length"]
    told = told.select(F.col("doc_id").alias("source"), F.col("tag").alias("source_tag"), F.col("start").alias("source_start"), "length", "digest")
    # A block with many copies is a hot key here.
    spans = apart(spans, "source").join(apart(told, "source"), ["source_", *at[1:]]).groupBy(*_DOC).agg(F.collect_list(F.struct("starts", "length", "digest")).alias("spans"))
    out = near.join(spans.join(again, _DOC, "left"), _DOC, "left").select("doc_id", "text", "spans", "again", "more")
    odd = far.select("doc_id", "text", "more").union(rows.where("doc_id is null or text is null").select("doc_id", "text", "more"))
    out = out.union(odd.select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"), F.lit(None).cast(again.schema["again"].dataType).alias("again"), "more"))
    more = docs.sparkSession.createDataFrame([], rows.select("more").schema).schema["more"].dataType.simpleString()
    return out.mapInArrow(_remove, f"doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, more {more}")
