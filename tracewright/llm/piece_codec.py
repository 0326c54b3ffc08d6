"""SentencePiece encoding and decoding of whole texts, with giant documents as a max-plus parallel scan of chunks.

A model whose pieces carry the space mark at their start only never merges across the start of a word,
so a text falls into units: spaces and the word behind them.  Equal units are encoded once a batch, all at
the same time, by numpy passes that apply each unit's best merge.

A giant text is cut into chunks at fixed places, in the middle of words too.  Its ids are one path through the lattice
of pieces.  For a byte-pair model that path is not the one of the largest sum of piece scores but the only one in which
every two neighbours agree: encoding their two texts as one gives just the two.  (If merging were ever to
cross from one piece into the next, the first such merge would come in the encoding of these two alone,
too.)  So a step scores 0 if the two agree and minus infinity if not, and the scan is max-plus over these scores:

1. the state at a chunk's edge is the piece that holds the character before it; each chunk yields the matrix of
   scores from the states at its left edge to those at its right, as the pairs that score 0;
2. matrices are combined associatively, up a tree of WAY children a node, and the states at
   all edges are handed down the tree again;
3. each chunk is encoded by itself between the pieces at its edges: a run of neighbours that agree is the
   encoding of its own text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes

MARK = "▁"
#: Texts above GIANT characters are scanned in chunks of CHUNK characters.
GIANT, CHUNK = 1 << 16, 1 << 15
#: Units above this many characters are merged one by one with a heap.
LONG_UNIT = 128
#: Children of a node of the tree over chunks, and levels of it: WAY ** LEVELS chunks are more than a string can have.
WAY, LEVELS = 64, 3
#: Pairs of pieces of which it is remembered whether they agree.
KNOWN_PAIRS = 1 << 20
BATCH_BYTES, BATCH_IDS = 1 << 20, 1 << 19


def bounds(lengths) -> np.ndarray:
    """Where runs of these lengths begin, and the end of the last."""
    return np.concatenate([[0], np.cumsum(np.asarray(lengths, dtype=np.int64))]).astype(np.int64)


class Pieces:
    """Tables of a byte-pair model: symbols of characters, merges of pairs, bytes of pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        normal = {names[i]: i for i in range(size) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("pieces that hold a space mark after a letter are not supported")
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        if not all(model.is_byte(int(i)) for i in self.byte):
            raise ValueError("the model has no byte pieces")
        self.prefix = len(model.encode("a")) != 0 and model.encode("a", out_type=str)[0].startswith(MARK)
        single = sorted((ord(p), i) for p, i in normal.items() if len(p) == 1)
        self.chars, self.char_ids = (np.array(x, dtype=np.int64) for x in zip(*single))
        order = {i: r for r, i in enumerate(sorted(normal.values(), key=lambda i: -model.get_score(i)))}
        pairs = {}
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                a, b = normal.get(piece[:cut]), normal.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (order[i], i)
        self.ids, self.longest, self.agreed = normal, max(map(len, normal)), {}
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int64)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], dtype=np.int64)
        self.pairs = pairs
        plain = [bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else names[i].replace(MARK, " ").encode() for i in range(size)]
        self.text = np.frombuffer(b"".join(plain), dtype=np.uint8)
        self.text_at = bounds([len(p) for p in plain])

    def merges(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging each pair; a rank of 2**31 where there is none."""
        key = np.where((left >= 0) & (right >= 0), left << 32 | right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        good = self.keys[at] == key
        return np.where(good, self.rank[at], 1 << 31), np.where(good, self.made[at], -1)

    def symbols(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A symbol for each character, -1 - code point for unknown ones, and where units begin."""
        points = np.frombuffer("".join(units).replace(" ", MARK).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.chars, points), len(self.chars) - 1)
        return np.where(self.chars[at] == points, self.char_ids[at], -1 - points), bounds([len(u) for u in units])

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each unit, and where each unit's begin."""
        symbols, begin = self.symbols(units)
        lengths = np.diff(begin)
        out: list[np.ndarray | None] = [None] * len(units)
        for u in np.flatnonzero(lengths > LONG_UNIT):
            out[u] = self._merge_long(symbols[begin[u] : begin[u + 1]])
        owner = np.repeat(np.arange(len(units)), lengths)
        keep = lengths[owner] <= LONG_UNIT
        symbols, owner = symbols[keep], owner[keep]
        done_symbols, done_owner = [], []
        rank = made = None
        while len(symbols):
            if rank is None:
                rank, made = np.full(len(symbols), 1 << 31), np.full(len(symbols), -1)
                inner = owner[1:] == owner[:-1]
                rank[:-1][inner], made[:-1][inner] = self.merges(symbols[:-1][inner], symbols[1:][inner])
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(rank << 31 | np.arange(len(rank)), first)
            live = best >> 31 < 1 << 31
            sizes = np.diff(np.append(first, len(owner)))
            stay = np.repeat(live, sizes)
            done_symbols.append(symbols[~stay])
            done_owner.append(owner[~stay])
            at = best[live] & ((1 << 31) - 1)
            symbols[at] = made[at]
            stay[at + 1] = False
            # Only pairs with the new symbol change.
            new = np.zeros(len(symbols), dtype=bool)
            new[at] = True
            symbols, owner, rank, made, new = symbols[stay], owner[stay], rank[stay], made[stay], new[stay]
            at = np.flatnonzero(new)
            rank[at], made[at] = 1 << 31, -1
            after = at[(at + 1 < len(symbols))]
            after = after[owner[after] == owner[after + 1]]
            before = at[at > 0] - 1
            before = before[owner[before] == owner[before + 1]]
            for pair in (after, before):
                rank[pair], made[pair] = self.merges(symbols[pair], symbols[pair + 1])
        for u in np.flatnonzero(lengths > LONG_UNIT):
            done_symbols.append(out[u])
            done_owner.append(np.full(len(out[u]), u))
        symbols, owner = np.concatenate([np.zeros(0, np.int64), *done_symbols]), np.concatenate([np.zeros(0, np.int64), *done_owner])
        order = np.argsort(owner, kind="stable")
        return self._with_bytes(symbols[order], owner[order], len(units))

    def _with_bytes(self, symbols: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters become their bytes."""
        unknown = np.flatnonzero(symbols < 0)
        if len(unknown):
            data = [chr(-1 - int(s)).encode("utf-8", "surrogatepass") for s in symbols[unknown]]
            width = np.ones(len(symbols), dtype=np.int64)
            width[unknown] = [len(d) for d in data]
            spread, owner = np.repeat(symbols, width), np.repeat(owner, width)
            spread[np.repeat(symbols < 0, width)] = self.byte[np.frombuffer(b"".join(data), dtype=np.uint8)]
            symbols = spread
        return symbols.astype(np.int32), np.searchsorted(owner, np.arange(n + 1))

    def _merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The same merges over one long unit, best first, the leftmost of equals first."""
        value, n = symbols.tolist(), len(symbols)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and value[i] >= 0 and value[j] >= 0 and (found := self.pairs.get(value[i] << 32 | value[j])):
                heapq.heappush(heap, (found[0], i, j, value[i], value[j], found[1]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, j, a, b, made = heapq.heappop(heap)
            if value[i] != a or after[i] != j or value[j] != b:
                continue
            value[i], value[j], after[i] = made, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([v for v in value if v is not None], dtype=np.int64)

    def piece(self, text: str) -> int | None:
        """The symbol of a text: its piece, or that of an unknown character; None if it is neither."""
        found = self.ids.get(text)
        return -1 - ord(text) if found is None and len(text) == 1 else found

    def agree(self, left: str, right: str) -> bool:
        """Whether two pieces, as texts, stay as they are when they are encoded together; an empty one stays out of it."""
        key = (left, right)
        if key not in self.agreed:
            if len(self.agreed) >= KNOWN_PAIRS:
                self.agreed.clear()
            self.agreed[key] = self._merge_long(self.symbols([left + right])[0]).tolist() == [self.piece(x) for x in key if x]
        return self.agreed[key]

    def transfer(self, text: str, begin: int, end: int, first: bool, last: bool) -> list[tuple[int, int, int, int]]:
        """Pairs of states at the edges ``begin`` and ``end`` of a chunk that score 0, as (from, to) of two pieces.

        ``text`` has the chunk and what pieces may reach beyond it.  The only state at the start of a whole text is (0, 0).
        """
        marked, whole, longest = text.replace(" ", MARK), len(text), self.longest
        # Which of the left states (bits) lead to a place by which last piece.
        at: dict[int, dict[str, int]] = {}
        if first:
            lefts = [(begin, begin)]
            at[begin] = {"": 1}
        else:
            lefts = [(i, j) for i in range(max(0, begin - longest), begin) for j in range(begin, min(whole, i + longest) + 1) if self.piece(marked[i:j]) is not None]
            for bit, (i, j) in enumerate(lefts):
                ends = at.setdefault(j, {})
                ends[marked[i:j]] = ends.get(marked[i:j], 0) | 1 << bit

        def arrivals(j: int, low: int, high: int) -> dict[str, int]:
            """Left states that reach ``j`` by a piece which starts in low..high."""
            out: dict[str, int] = {}
            for i in range(max(low, j - longest), min(high, j - 1) + 1):
                if (ends := at.get(i)) and self.piece(piece := marked[i:j]) is not None:
                    bits = 0
                    for before, some in ends.items():
                        if self.agree(before, piece):
                            bits |= some
                    if bits:
                        out[piece] = bits
            return out

        # No piece crosses the start of a unit, and pieces on both sides of one agree.  So all that lies between the first and the last start is one state.
        starts = _unit_starts(marked, begin + 1, end - 1)
        skip = (starts[0], starts[1]) if starts else (end, end)
        for j in range(begin + 1, skip[0] + 1):
            for piece, bits in arrivals(j, begin, j).items():
                ends = at.setdefault(j, {})
                ends[piece] = ends.get(piece, 0) | bits
        if starts:
            alive = 0
            for bits in at.get(skip[0], {}).values():
                alive |= bits
            at = {skip[1]: {"": alive}} if alive else {}
            for j in range(skip[1] + 1, end + 1):
                at[j] = arrivals(j, skip[1], j)
        out = []
        for j in [end] if last else range(end, min(whole, end + longest - 1) + 1):
            found = dict(at.get(end, {})) if j == end else arrivals(j, begin, end - 1)
            for piece, bits in found.items():
                if piece or last:
                    out += [(*left, j - len(piece), j) for bit, left in enumerate(lefts) if bits >> bit & 1]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin; the texts hold whole units, prefix included."""
        number: dict[str, int] = {}
        uses, counts = [], []
        for text in texts:
            units = unit_list(text)
            counts.append(len(units))
            uses += [number.setdefault(u, len(number)) for u in units]
        ids, begin = self.encode_units(list(number))
        uses = np.array(uses, dtype=np.int64)
        sizes = np.diff(begin)[uses] if len(uses) else np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        flat = ids[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(begin[uses], sizes)] if len(uses) else np.zeros(0, np.int32)
        return flat, bounds(sizes)[bounds(counts)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids, without the space that encoding puts in front."""
        sizes = self.text_at[ids + 1] - self.text_at[ids]
        ends = np.cumsum(sizes)
        data = self.text[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(self.text_at[ids], sizes)].tobytes()
        return data[1:] if self.prefix and data[:1] == b" " else data


def unit_list(text: str) -> list[str]:
    """Units of a text: spaces and the word behind them; spaces at the end are a unit."""
    if not text:
        return []
    parts = text.split(" ")
    if "" not in parts[1:]:
        units = [" " + p for p in parts[1:]]
        return [parts[0], *units] if parts[0] else units
    units, spaces = [parts[0]] if parts[0] else [], 0
    for part in parts[1:]:
        spaces += 1
        if part:
            units.append(" " * spaces + part)
            spaces = 0
    return units + ([" " * spaces] if spaces else [])


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def _ids(path: str, column: str, schema_names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in by_bytes(batches, column, BATCH_BYTES):
            ids, at = model.encode([t or "" for t in batch.column(column).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in schema_names] + [lists], names=[*schema_names, "ids"])

    return run


def _unit_starts(marked: str, low: int, high: int) -> list[int]:
    """The first and the last start of a unit in low..high: a space behind something else; nothing if there is none."""
    first = marked.find(MARK, low, high + 1)
    while first >= 0 and marked[first - 1 : first] == MARK:
        first = marked.find(MARK, first + 1, high + 1)
    if first < 0:
        return []
    last = marked.rfind(MARK, low, high + 1)
    while marked[last - 1 : last] == MARK:
        last = marked.rfind(MARK, low, last)
    return [first, last]


_CHUNKS = "key string, chunk int, base long, begin int, end int, first boolean, last boolean, text string"


def _chunks(path: str, chunk: int):
    """Chunks of a text, each with the characters around it that a piece may reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = load(path).longest
        schema = pa.schema([("key", pa.string()), ("chunk", pa.int32()), ("base", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_()), ("text", pa.string())])
        for batch in by_bytes(batches, "whole", BATCH_BYTES):
            for key, text in zip(batch.column("key").to_pylist(), batch.column("whole").to_pylist()):
                for n, i in enumerate(range(0, len(text), chunk)):
                    base, stop = max(0, i - around), min(len(text), i + chunk)
                    row = {"key": key, "chunk": n, "base": base, "begin": i - base, "end": stop - base, "first": i == 0, "last": stop == len(text), "text": text[base : stop + around]}
                    yield pa.RecordBatch.from_pylist([row], schema=schema)

    return run


def _matrices(path: str):
    """The matrix of each chunk: four numbers (a piece at the left edge, a piece at the right) for each pair of states that scores 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                pairs = model.transfer(row["text"], row["begin"], row["end"], row["first"], row["last"])
                out.append([row["base"] + x for pair in pairs for x in pair])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("chunk"), pa.array(out, pa.list_(pa.int64()))], names=["key", "node", "matrix"])

    return run


def _pairs(matrix: list[int]) -> dict[tuple[int, int], set[tuple[int, int]]]:
    out: dict[tuple[int, int], set[tuple[int, int]]] = {}
    for i in range(0, len(matrix), 4):
        out.setdefault(tuple(matrix[i : i + 2]), set()).add(tuple(matrix[i + 2 : i + 4]))
    return out


def _combine(table: pa.Table) -> pa.Table:
    """The max-plus product of a node's matrices, in order: states that some state between leads from and to."""
    rows = sorted(zip(table.column("node").to_pylist(), table.column("matrix").to_pylist()))
    total = _pairs(rows[0][1])
    for _, matrix in rows[1:]:
        step = _pairs(matrix)
        total = {left: right for left, middle in total.items() if (right := set().union(*(step.get(m, ()) for m in middle)))}
    flat = [x for left, rights in sorted(total.items()) for right in sorted(rights) for x in (*left, *right)]
    return pa.table({"key": table.column("key")[:1], "node": pa.array([rows[0][0] // WAY], pa.int32()), "matrix": pa.array([flat], pa.list_(pa.int64()))})


def _hand_down(table: pa.Table) -> pa.Table:
    """The states at the edges of a node's children, from those at its own: the one path that scores 0."""
    rows = sorted(zip(table.column("node").to_pylist(), table.column("matrix").to_pylist()))
    left, right = tuple(table.column("left")[0].as_py()), tuple(table.column("right")[0].as_py())
    steps, reached = [_pairs(m) for _, m in rows], [{left}]
    for step in steps:
        reached.append(set().union(*(step.get(x, ()) for x in reached[-1])))
    states = [right]
    for step, before in zip(reversed(steps), reversed(reached[:-1])):
        states.append(next(x for x in sorted(before) if states[-1] in step.get(x, ())))
    states.reverse()
    edge = lambda values: pa.array([list(v) for v in values], pa.list_(pa.int64()))
    return pa.table({"key": pa.array([table.column("key")[0].as_py()] * len(rows)), "node": pa.array([n for n, _ in rows], pa.int32()), "left": edge(states[:-1]), "right": edge(states[1:])})


def _between(path: str):
    """Ids of each chunk from the end of the piece at its left edge to the end of that at its right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            rows = batch.to_pylist()
            ids, at = model.encode([r["text"][r["left"][1] - r["base"] : r["right"][1] - r["base"]] for r in rows])
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("chunk"), lists], names=["key", "chunk", "ids"])

    return run


def encode_giant(texts: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """(key, ids) of (key, whole), each text as a scan of its chunks; a chunk is longer than any piece."""
    if chunk <= load(path).longest:
        raise ValueError("chunks must be longer than the longest piece")
    parts = texts.mapInArrow(_chunks(path, chunk), _CHUNKS).repartition("key", "chunk")
    level = parts.mapInArrow(_matrices(path), "key string, node int, matrix array<long>")
    levels = [level]
    for _ in range(LEVELS):
        level = level.groupBy("key", F.floor(F.col("node") / WAY).cast("int")).applyInArrow(_combine, "key string, node int, matrix array<long>")
        levels.append(level)
    # A whole text has one state at each end.
    states = level.select("key", "node", F.slice("matrix", 1, 2).alias("left"), F.slice("matrix", 3, 2).alias("right"))
    for level in reversed(levels[:-1]):
        above = states.select("key", F.col("node").alias("parent"), "left", "right")
        rows = level.withColumn("parent", F.floor(F.col("node") / WAY).cast("int")).join(above, ["key", "parent"])
        states = rows.groupBy("key", "parent").applyInArrow(_hand_down, "key string, node int, left array<long>, right array<long>")
    coded = parts.join(states.withColumnRenamed("node", "chunk"), ["key", "chunk"]).select("key", "chunk", "base", "text", "left", "right").mapInArrow(_between(path), "key string, chunk int, ids array<int>")
    return coded.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("parts")).select("key", F.flatten("parts.ids").alias("ids"))


def encode(docs: DataFrame, path: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with a column ``ids``: the ids that the model file's library gives for each whole text.

    Null and empty texts have no ids.  A literal space mark in a text comes back as a space.  Repeated rows are encoded each; an empty table gives no rows; other
    columns stay as they are, but for one named ids, which is replaced.
    """
    prefix = " " if load(path).prefix else ""
    rows = docs.drop("ids")
    names = rows.columns
    # The library does not tell the space mark from a space either.
    spaced = F.replace(F.col("text").cast("string"), F.lit(MARK), F.lit(" "))
    whole = F.when(F.length("text") > 0, F.concat(F.lit(prefix), spaced)).otherwise("")
    short = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= giant).withColumn("whole_", whole)
    schema = T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    coded = short.mapInArrow(_ids(path, "whole_", names), schema)
    long = rows.where(F.length("text") > giant).withColumn("key_", F.sha2("text", 256))
    distinct = long.groupBy(F.col("key_").alias("key")).agg(F.first("text").alias("text")).select("key", whole.alias("whole"))
    scanned = encode_giant(distinct, path, chunk)
    return coded.union(long.join(scanned, F.col("key_") == F.col("key")).select(*names, "ids"))


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``coded`` with a column ``decoded``: the text that its ids stand for; null ids give an empty one."""
    rows = coded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for whole in batches:
            total = np.cumsum(np.diff(whole.column("ids").offsets.to_numpy())) // BATCH_IDS
            edges = bounds(np.unique(total, return_counts=True)[1])
            for batch in (whole.slice(i, j - i) for i, j in zip(edges[:-1], edges[1:])):
                column = batch.column("ids")
                flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
                texts = [model.decode(flat[i:j]).decode("utf-8", "replace") for i, j in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))
