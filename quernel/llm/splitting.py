"""Splitting oversized items at natural boundaries by recursive bisection.

A text over the limit is cut at the strongest boundary near its midpoint; each half that is still
over the limit less the overlap is cut again; then every piece but the first is extended backwards by
the overlap. Boundaries, strongest first: a blank line before an unindented line, a blank line, an
unindented line, a line, the end of a sentence or statement, a blank, any character. Cuts never fall
inside a UTF-8 character.

Only texts over the limit travel to Python; each is handled alone, so no group can be hot.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm.chunk_source import load_chunks
from quernel.sources.tables import table

#: Bytes a piece may have, overlap included, and bytes that neighbours share at most.
LIMIT, OVERLAP = 4_000, 200
#: A cut is looked for within this share of the text around its midpoint before the whole legal range is.
NEAR = 0.25

#: Boundaries by falling strength; a cut is where the match ends (fixed values).
BOUNDARIES = tuple(
    re.compile(p)
    for p in (
        rb"\n[ \t\r]*\n(?=[^\s}\])])",
        rb"\n[ \t\r]*\n(?=\s)",
        rb"\n(?=[^\s}\])])",
        rb"\n",
        rb"[.;!?,}] ?(?=\s|[A-Za-z(\[{])",
        rb"[ \t]+",
    )
)


def _char_start(data: bytes, at: int) -> int:
    """``at`` moved back to the start of a character (invalid UTF-8 moves at most three bytes)."""
    for back in range(4):
        if at - back <= 0 or at >= len(data) or data[at - back] & 0xC0 != 0x80:
            return max(at - back, 0)
    return at


def _cut(data: bytes, start: int, end: int) -> int:
    """The strongest boundary near the midpoint of data[start:end], always inside it and between characters."""
    middle, size = (start + end) // 2, end - start
    for reach in (NEAR, 0.45):
        low, high = max(start + 1, int(middle - size * reach)), min(end - 1, int(middle + size * reach))
        for boundary in BOUNDARIES:
            found = [m.end() for m in boundary.finditer(data, max(start, low - 8), end) if low <= m.end() <= high]
            if found:
                return min(found, key=lambda x: (abs(x - middle), x))
    at = _char_start(data, middle)
    return at if at > start else middle


def split_bytes(data: bytes, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans [start, end) of at most ``limit`` bytes that cover ``data``; each starts at most ``overlap`` bytes before the former's end."""
    if limit < 8 or not 0 <= overlap <= limit // 2:
        raise ValueError("limit must be at least 8 and overlap between 0 and half the limit")
    if len(data) <= limit:
        return [(0, len(data))]
    room, cores, todo = max(limit - overlap, 4), [], [(0, len(data))]
    while todo:
        start, end = todo.pop()
        if end - start <= room:
            cores.append((start, end))
        else:
            at = _cut(data, start, end)
            todo += [(at, end), (start, at)]
    spans = [cores[0]]
    for start, end in cores[1:]:
        back = max(start - overlap, 0)
        while back < start and data[back] & 0xC0 == 0x80:
            back += 1
        line = data.find(b"\n", back, start)
        if 0 <= line < start - 1:
            back = line + 1
        spans.append((back, end))
    return spans


def _carriage_returns(data: bytes, start: int | None, end: int | None) -> bool:
    """The span in the file is wider than the stored text by one byte a line: the file has CRLF, the text LF."""
    return start is not None and end is not None and end - start == len(data) + data.count(b"\n") != len(data)


PIECES = (
    "chunk_id bigint, piece int, n_pieces int, start_byte bigint, end_byte bigint, text_start bigint, text_end bigint, chunk_kind string, symbol_path string"
)


def split_oversized(chunks: DataFrame, texts: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the chunks whose text has more than ``limit`` bytes.

    ``chunks``: chunk_id, start_byte, end_byte, chunk_kind, symbol_path, one row per chunk; ``texts``:
    chunk_id, blob. Other columns are ignored, repeated rows of ``texts`` (the greatest blob counts)
    give one set of pieces. text_start and text_end are offsets in the blob, start_byte and end_byte
    those in the file (null if the chunk's start is null; in a CRLF file each line feed counts twice).
    Null or short blobs, null ids and texts without a chunk give no pieces.
    """
    if limit < 8 or not 0 <= overlap <= limit // 2:
        raise ValueError("limit must be at least 8 and overlap between 0 and half the limit")
    long = (
        texts.where(F.col("chunk_id").isNotNull() & (F.octet_length("blob") > limit))
        .groupBy("chunk_id")
        .agg(F.max("blob").alias("blob"))
    )
    joined = long.join(chunks.select("chunk_id", "start_byte", "end_byte", "chunk_kind", "symbol_path"), "chunk_id")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, data, start, end, kind, symbol in zip(
                batch.chunk_id, batch.blob, batch.start_byte, batch.end_byte, batch.chunk_kind, batch.symbol_path, strict=True
            ):
                data = bytes(data)
                start, end = (None if pd.isna(x) else int(x) for x in (start, end))
                crlf = _carriage_returns(data, start, end)
                spans = split_bytes(data, limit, overlap)
                for k, (a, b) in enumerate(spans):
                    at = [None if start is None else start + x + (data.count(b"\n", 0, x) if crlf else 0) for x in (a, b)]
                    rows.append((i, k, len(spans), *at, a, b, kind, symbol))
            out = pd.DataFrame(rows, columns=["chunk_id", "piece", "n_pieces", "start_byte", "end_byte", "text_start", "text_end", "chunk_kind", "symbol_path"])
            yield out.astype({"start_byte": "Int64", "end_byte": "Int64"})

    return joined.mapInPandas(pieces, PIECES)


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all oversized chunks."""
    return split_oversized(load_chunks(spark, sf_dir), table(spark, sf_dir, "chunk_text"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that had to be split."""
    return p3_pieces(spark, sf_dir).where((F.col("piece") == 0) & (F.col("n_pieces") > 1)).select("chunk_id")


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces}
SQL = {
    "p3_found": "SELECT DISTINCT t.chunk_id FROM chunk_text t JOIN chunks c ON c.id = t.chunk_id WHERE octet_length(t.blob) > 4000",
}
