"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_bytes

#: Texts above this many characters are encoded in parts; a batch holds about this many bytes.
PART_CHARS, BATCH_BYTES = 1 << 16, 1 << 20


def safe_parts(text: str, size: int = PART_CHARS) -> list[str]:
    """Cut a long text where no token can span the cut.

    The byte-level pre-tokenizer attaches one space to the word behind it, so a cut before a space
    that stands between two non-space characters changes no token.  Without such a place the part
    grows until there is one.
    """
    parts, begin = [], 0
    while len(text) - begin > size:
        at = text.find(" ", begin + size)
        while 0 <= at < len(text) - 1 and (text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if at < 0 or at >= len(text) - 1:
            break
        parts.append(text[begin:at])
        begin = at
    parts.append(text[begin:])
    return parts


def _load(path: str):
    """A function from texts to numbers of tokens, for a .json or a .model file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda batch: [len(x) for x in model.encode(batch, num_threads=1)]), False
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return (lambda batch: [len(x) for x in model.encode_batch_fast(batch, add_special_tokens=False)]), True


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, part_chars: int = PART_CHARS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Count the tokens of ``docs.text`` for each row.

    ``tokenizer_path`` names a vocabulary file that every executor has.  A null text counts as
    empty (0 bytes, 0 tokens), repeated rows are counted each, an empty table gives no rows, and
    columns other than ``doc_id`` and ``text`` are ignored.  Returns doc_id, n_bytes, n_tokens and
    over_limit (more than ``limit`` tokens).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        lengths, splits = _load(tokenizer_path)
        for batch in by_bytes(batches, "text", batch_bytes):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            parts = [safe_parts(t, part_chars) if splits else [t] for t in texts]
            tokens = [0] * len(texts)
            owner = [i for i, p in enumerate(parts) for _ in p]
            flat = [x for p in parts for x in p]
            begin = total = 0
            for k, part in enumerate(flat + [None]):
                if part is None or total >= batch_bytes:
                    for i, n in zip(owner[begin:k], lengths(flat[begin:k])):
                        tokens[i] += n
                    begin, total = k, 0
                total += len((part or "").encode())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                    "n_tokens": pa.array(tokens, pa.int64()),
                    "over_limit": pa.array([n > limit for n in tokens], pa.bool_()),
                }
            )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
