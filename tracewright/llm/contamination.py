"""Benchmark decontamination by a positional inverted index, in DataFrame functions only.

1. The corpus frequency of every term of the benchmark is counted over all documents.  A window with a
   term that no document has cannot occur and goes.
2. Each other window names its two rarest terms.  The places of these terms in all documents are the stored
   index: (term, row, pos).
3. The rarest term's list, moved back by the term's offset in the window, gives the places where the window may
   begin; the second list, moved back by its own offset, is intersected with them.  The rarest term is rare in
   most windows, so little comes of a common term unless a window has no other.
4. What is left is confirmed term by term: neighbouring windows at one distance between item and document are one stretch, its terms
   meet the postings of the documents that are touched, and runs of matches as long as a window are hits.

Rows of documents are told apart by ``doc`` (the doc_id, -1 for null) and ``mark``, a 64-bit hash of the text, so repeated ids of
different texts are judged apart and equal rows alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, cut, lower_ascii
from .substring_dedup import touched

WINDOW = 10
#: What stands between words of a text whose A-Z are not lower-cased yet.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ROW = ["doc", "mark"]
#: Terms are sent to all tasks up to so many characters in all; more of them are met by a shuffle of the words.
FEW = 1 << 22


def parts(text: Column) -> Column:
    """The words of a text in order, not lower-cased; an empty string may stand at the beginning and at the end."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), BETWEEN)


def word_count(words: Column) -> Column:
    return (F.size(words) - (words[0] == "").cast("int") - ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")).cast("long")


def postings(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, term, pos) of every word; ``pos`` counts words, from 0 or 1."""
    out = rows.select(*keys, F.posexplode(parts(F.col(text))).alias("pos", "word")).where("word <> ''")
    # Most words are in lower case already; translating is dear.
    return out.select(*keys, F.when(F.lower("word") != F.col("word"), lower_ascii(F.col("word"))).otherwise(F.col("word")).alias("term"), "pos")


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("doc")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(_doc(), F.xxhash64(F.col("text").cast("string")).alias("mark"), F.col("text").cast("string").alias("text"))


def _sent(terms: DataFrame) -> DataFrame:
    """Distinct terms, written out, and marked for sending to all tasks if their measured size allows it."""
    terms = cut(terms.select("term").distinct())
    size = terms.agg(F.sum(F.length("term") + 16).alias("n")).first().n or 0
    return F.broadcast(terms) if size <= FEW else terms


def _rarest(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """The windows' terms with their corpus frequency; windows with a term that no document has go."""
    often = postings(docs, "text").join(_sent(windows), "term").groupBy("term").agg(F.count("*").alias("often"))
    return windows.join(often, "term")


def item_windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(item, at, term) of each item's words, and (item, first, size, at, term) of each window's.

    ``item`` tells items apart: a null item_id and items that share an id but not a text are items of their own.
    """
    named = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    named = named.select(F.struct("item_id", F.sha2("text", 256).alias("hash")).alias("item"), "text")
    words = postings(named, "text", "item")
    words = words.withColumn("at", (F.row_number().over(Window.partitionBy("item").orderBy("pos")) - 1).cast("int")).select("item", "at", "term")
    words = cut(words)
    sizes = words.groupBy("item").agg(F.count("*").cast("int").alias("words"))
    first = F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - window + 1), F.greatest(F.lit(0), F.least(F.col("at"), F.col("words") - window))))
    return words, words.join(sizes, "item").withColumn("first", first).select("item", "first", F.least(F.lit(window), "words").alias("size"), "at", "term")


def _starts(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, mark, item, first, size, begin): where a window may begin, by the lists of its two rarest terms."""
    ranked = _rarest(windows, docs)
    terms = ranked.groupBy("item", "first", "size").agg(F.count("*").alias("known"), F.array_sort(F.collect_list(F.struct("often", "at", "term"))).alias("terms")).where("known = size")
    seeds = cut(terms.select("item", "first", "size", F.col("terms")[0].alias("a"), F.when(F.col("size") > 1, F.col("terms")[1]).alias("b")))
    wanted = seeds.select(F.explode(F.array("a.term", "b.term")).alias("term")).where("term is not null")
    index = cut(postings(docs, "text", *_ROW).join(_sent(wanted), "term"))
    # A term's list may be long and asked for by many windows.
    one = apart(index.withColumn("h", F.xxhash64("term")), "h").join(apart(seeds.withColumn("h", F.xxhash64("a.term")), "h"), "h_").where("term = a.term")
    one = one.select(*_ROW, "item", "first", "size", (F.col("pos") - (F.col("a.at") - F.col("first"))).alias("begin"), F.col("b.term").alias("other"), (F.col("b.at") - F.col("first")).alias("behind"))
    lone = one.where("other is null")
    two = one.where("other is not null").withColumn("place", F.col("begin") + F.col("behind"))
    two = two.join(index.select(*_ROW, F.col("term").alias("other"), F.col("pos").alias("place")), [*_ROW, "other", "place"])
    columns = [*_ROW, "item", "first", "size", "begin"]
    return lone.select(*columns).union(two.select(*columns)).where("begin >= 0")


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Exact phrase matches: (doc, mark, item_id, item, begin, end), longest runs of an item's words of at least a window.

    ``begin`` and ``end`` (exclusive) count the document's words as ``postings`` does.  A run lies at one distance between item and document; runs at
    other distances are rows of their own.  Rows with a null text have none.
    """
    rows = _rows(docs).where("text is not null")
    words, windows = item_windows(items, window)
    starts = cut(_starts(windows, rows))
    # Windows that follow each other at one distance are one stretch.
    line = Window.partitionBy(*_ROW, "item", "shift").orderBy("first")
    found = starts.select(*_ROW, "item", "size", "first", (F.col("begin") - F.col("first")).alias("shift"))
    found = found.withColumn("new", F.coalesce(F.col("first") > F.lag(F.col("first") + F.col("size")).over(line), F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(line))
    found = found.groupBy(*_ROW, "item", "shift", "size", "run").agg(F.min("first").alias("low"), F.max(F.col("first") + F.col("size")).alias("high"))
    asked = found.select(*_ROW, "item", "shift", "size", F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("at")).join(words, ["item", "at"]).withColumn("pos", F.col("shift") + F.col("at"))
    near, _ = touched(rows, starts.select("doc"), "doc")
    told = postings(near, "text", *_ROW).join(_sent(words), "term")
    hit = asked.join(told, [*_ROW, "pos", "term"]).distinct()
    line = Window.partitionBy(*_ROW, "item", "shift").orderBy("at")
    hit = hit.withColumn("island", F.col("at") - F.row_number().over(line))
    hit = hit.groupBy(*_ROW, "item", "shift", "size", "island").agg(F.min("pos").alias("begin"), (F.max("pos") + 1).alias("end")).where(F.col("end") - F.col("begin") >= F.col("size"))
    return hit.select(*_ROW, F.col("item.item_id").alias("item_id"), "item", "begin", "end")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Which words of each document lie inside an occurrence of a window of a benchmark item.

    Words are runs of characters other than ASCII punctuation, spaces and controls, A-Z lower-cased.  A window is ``window`` consecutive words of an
    item; an item of fewer words, but not none, is one window.  ``items``: item_id, text.  Null and empty texts have no words, on both sides.  Rows
    with a null doc_id are judged like any other, repeated rows fare alike.  Repeated items count once for each different id; items
    without an id hit words but are not listed.  Other columns are ignored.  Empty tables give no rows, or no hits.

    Returns doc_id, n_words, n_hit, n_items, items_sha256 (of the item_ids, sorted as strings and comma-joined), contaminated.
    """
    found = cut(matches(docs, items, window))
    spans = found.select(*_ROW, "begin", "end").distinct()
    before = F.max("end").over(Window.partitionBy(*_ROW).orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("begin", F.coalesce(before, F.col("begin"))))
    n_hit = spans.withColumn("fresh", fresh).groupBy(*_ROW).agg(F.sum("fresh").cast("long").alias("n_hit"))
    ids = found.where("item_id is not null").select(*_ROW, "item_id").distinct().groupBy(*_ROW).agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
    hits = n_hit.join(ids, _ROW, "left")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _doc(), F.xxhash64(F.col("text").cast("string")).alias("mark"), word_count(parts(F.col("text"))).alias("n_words"))
    zero = F.lit(0).cast("long")
    rows = rows.join(hits, _ROW, "left").withColumn("n_hit", F.coalesce("n_hit", zero)).withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    return rows.select("doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def near_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 5) -> DataFrame:
    """Proximity matches: (doc, mark, item_id, first, begin): all terms of a window, in whatever order, within ``window + slop`` words.

    The stretches of a document that may match lie around the places of the window's rarest term; each of its other terms, from the rarest on, must have a place in
    the same stretch, and lists are intersected one after the other.  ``first`` is the window's place in the item, ``begin`` the first word of a stretch; a
    term that a window has twice is asked for once.  Rows with a null text have none.
    """
    rows = _rows(docs).where("text is not null")
    _, windows = item_windows(items, window)
    once = _rarest(windows.select("item", "first", "size", "term").distinct(), rows)
    sizes = windows.select("item", "first", "term").distinct().groupBy("item", "first").agg(F.count("*").alias("terms"))
    order = Window.partitionBy("item", "first").orderBy("often", "term")
    once = once.withColumn("rank", F.row_number().over(order)).withColumn("known", F.count("*").over(Window.partitionBy("item", "first"))).join(sizes, ["item", "first"]).where("known = terms")
    once = cut(once.select("item", "first", "size", "term", "rank", "terms"))
    index = cut(postings(rows, "text", *_ROW).join(_sent(once), "term"))
    left = index.join(once.where("rank = 1"), "term")
    reach = F.col("size") + slop
    left = cut(left.select(*_ROW, "item", "first", "size", "terms", F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - reach + 1), F.col("pos"))).alias("begin")))
    for rank in range(2, window + 1):
        done = left.where(F.col("terms") < rank)
        more = left.where(F.col("terms") >= rank).join(once.where(F.col("rank") == rank).select("item", "first", "term"), ["item", "first"])
        # A place serves the stretches that begin up to a window and the slop before it; both sides meet by blocks of that length.
        block = lambda c: F.floor(c / (window + slop))
        more = more.withColumn("block", F.explode(F.array(block(F.col("begin")), block(F.col("begin")) + 1)))
        more = more.join(index.select(*_ROW, "term", "pos", block(F.col("pos")).alias("block")), [*_ROW, "term", "block"])
        more = more.where((F.col("pos") >= F.col("begin")) & (F.col("pos") < F.col("begin") + reach)).select(*left.columns).distinct()
        left = cut(done.union(more))
    best = left.groupBy(*_ROW, "item", "first").agg(F.min("begin").alias("begin"))
    return best.select(*_ROW, F.col("item.item_id").alias("item_id"), "first", "begin")


def oracle(window: int = WINDOW) -> str:
    """DuckDB SQL for ``decontaminate`` over ``documents`` and ``benchmark``."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    with d as (select row_number() over () as r, doc_id, {words} as w from documents), i as (select cast(item_id as varchar) as item_id, {words} as w from benchmark),
    win as (select distinct item_id, least({window}, len(w)) as k, array_to_string(w[p:p + least({window}, len(w)) - 1], ' ') as t
        from (select item_id, w, unnest(range(1, greatest(1, len(w) - {window} + 1) + 1)) as p from i where len(w) > 0)),
    k as (select distinct k from win),
    runs as (select r, k, p, array_to_string(w[p:p + k - 1], ' ') as t from (select r, w, k, unnest(range(1, len(w) - k + 2)) as p from d, k where len(w) >= k)),
    hit as (select r, runs.k, p, item_id from runs join win on runs.t = win.t and runs.k = win.k),
    spot as (select r, count(distinct q) as n from (select r, unnest(range(p, p + k)) as q from (select distinct r, p, k from hit)) group by r),
    ids as (select r, count(*) as n, string_agg(item_id, ',' order by item_id collate "binary") as s from (select distinct r, item_id from hit) group by r)
    select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(spot.n, 0) as bigint) as n_hit, cast(coalesce(ids.n, 0) as bigint) as n_items,
        sha256(coalesce(s, '')) as items_sha256, coalesce(spot.n, 0) > 0 as contaminated from d left join spot using (r) left join ids using (r)"""
