"""Operator 7: token counts, with overlap resynchronisation for huge documents.

A text of more than CHUNK characters is cut into chunks that overlap. Both encodings of
an overlap are compared: where a unit of the pre-tokenizer begins in any context (a space
before a non-space character, see ``tokens``) and both chunks have a token boundary, the
two are spliced. If an overlap holds no such place, it is widened, twice as far each time,
up to the whole chunk; what then still has none is joined with the next chunk and encoded
as one. Only the library's own offsets are used, so counts equal those of the whole text.
Shorter texts are counted from the library's ids of their distinct pieces (``tokens``).
Boundaries are proved for the two pre-tokenizers that ``PieceEncoder.suits`` names; a
vocabulary with another one, or of sentencepiece, has its texts encoded whole.

Defined results: a null text is empty and has no token; special strings inside texts are
handled as the library does by default (none crosses a splice: it holds no space); a null
doc_id stays null; rows are independent, so repeated rows, ties and extra columns change
nothing; a very long text is counted chunk by chunk; an empty table gives no row.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import PieceEncoder

CHUNK, OVERLAP = 1 << 13, 256
KNOWN = 300_000  # pieces that a worker remembers
_STABLE = re.compile(r"(?<=\S) (?=\S)")


def spans(text: str, chunk: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, splice) of chunks: each chunk counts from its splice to the next one's.

    A chunk starts at least one character before its splice and ends after the next
    one's, so that both hold the place with its context.
    """
    out, start, splice, n = [], 0, 0, len(text)
    while True:
        end, width, found = min(start + chunk, n), overlap, None
        while end < n:
            low = max(splice + 1, end - width)
            for m in _STABLE.finditer(text, low, end - 1):
                found = m.start()
            if found is not None:
                break
            if low == splice + 1:  # no place in the whole chunk: join it with the next
                end, width = min(end + chunk, n), chunk
            width *= 2
        out.append((start, end, splice))
        if end >= n:
            return out
        start, splice = max(splice, found - min(width, chunk // 2)), found


def count_huge(library, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text from overlapping chunks; falls back to wider ones where encodings disagree."""
    while len(text) > chunk:
        cut, total, last = spans(text, chunk, overlap), 0, None
        for k, (start, end, splice) in enumerate(cut):
            here = library.encode(text[start:end], add_special_tokens=False).offsets
            first = splice - start
            stop = cut[k + 1][2] - start if k + 1 < len(cut) else end - start
            edges = {a for a, _ in here} | {b for _, b in here}
            if (k and first not in edges) or (k + 1 < len(cut) and stop not in edges):
                break  # not a boundary in this encoding: not aligned
            total += sum(first <= a < stop for a, _ in here)
            last = k
        if last == len(cut) - 1:
            return total
        chunk, overlap = chunk * 4, overlap * 4
    return len(library.encode(text, add_special_tokens=False))


def counted(docs: DataFrame, vocabulary: str, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document's whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if vocabulary.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
            many = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            pieces = PieceEncoder.of(vocabulary) if PieceEncoder.suits(vocabulary) else None
            if pieces is not None:
                pieces.limit = KNOWN
            library = pieces.library if pieces is not None else Tokenizer.from_file(vocabulary)
            library.no_truncation()
            library.no_padding()

            def many(texts: list[str]) -> list[int]:
                small = [t for t in texts if len(t) <= chunk]
                n = iter(pieces.many(small)[1].tolist() if pieces is not None else [len(x) for x in library.encode_batch_fast(small, add_special_tokens=False)])
                return [next(n) if len(t) <= chunk else count_huge(library, t, chunk, overlap) if pieces is not None else len(library.encode(t, add_special_tokens=False)) for t in texts]

        for b in batches:
            n = [x for _, texts in slices(b.column("text")) for x in many([t or "" for t in texts])]
            size = pa.compute.fill_null(pa.compute.binary_length(b.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_bytes": size, "n_tokens": pa.array(n, pa.int64())})

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
