"""Token ids of documents in compressed binary blocks.

Texts become byte-level BPE ids; each task strings the ids of its documents together and cuts them into blocks of up to
`block` ids (4,096 at most), every block coded by the context-mixing range coder from an empty model and checksummed (CRC-32 of the ids as
little-endian 32-bit numbers). Rows carry what a reader needs to take a block alone: the documents it holds, where in each
it begins and how many ids. Nothing is shuffled.

Defined results: a missing or empty text is listed with 0 ids in the block that is open when it comes. Repeated rows are written each, and rows without id as well.
A long text runs over as many blocks as it needs. Columns other than the id and the text play no part, whatever their names. No rows make no blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import range_coder
from textloom.llm.arrow_text import slices
from textloom.llm.byte_bpe import TOKENIZER, token_ids

#: Blocks coded in lockstep.
LANES = 3072
SCHEMA = "doc_ids array<{}>, first_tokens array<long>, n_tokens array<long>, ids long, crc32 long, payload binary"


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def write_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, block: int = range_coder.TOKENS) -> DataFrame:
    """One row for each block."""
    kind = dict(docs.dtypes)[doc_id]

    def rows(ids: np.ndarray, names: list, counts: np.ndarray, firsts: np.ndarray) -> list[list]:
        """The columns of the blocks over all ids."""
        ends = np.cumsum(counts)
        begins = ends - counts
        blocks = [ids[i : i + block] for i in range(0, max(1, len(ids)), block)]
        parts = []
        for i in range(len(blocks)):
            lo, hi = i * block, i * block + len(blocks[i])
            a, b = np.searchsorted(ends, lo, side="right" if i else "left"), len(ends) if i == len(blocks) - 1 else np.searchsorted(begins, hi, side="left")
            if i:  # texts of 0 ids at the seam are in the block before
                while a < b and counts[a] == 0 and begins[a] == lo:
                    a += 1
            n = np.minimum(ends[a:b], hi) - np.maximum(begins[a:b], lo)
            parts.append((names[a:b], firsts[a:b] + np.maximum(lo - begins[a:b], 0), n))
        payloads = range_coder.encode(blocks)
        columns = [[p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts], [len(x) for x in blocks], [checksum(x) for x in blocks], payloads]
        return columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, names, counts, firsts = [], [], [], []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal ids, names, counts, firsts
            all_ids, n, first = (np.concatenate(x) for x in (ids, counts, firsts))
            whole = len(all_ids) if last else len(all_ids) // block * block
            ends = np.cumsum(n)
            done = len(n) if last else int(np.searchsorted(ends, whole, side="right"))
            over = 0 if last or done >= len(n) else int(whole - (ends[done] - n[done]))  # of a text that goes on
            head = np.append(n[:done], over) if over else n[:done]
            columns = rows(all_ids[:whole], names[: len(head)], head, first[: len(head)])
            types = (pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_ids", "first_tokens", "n_tokens", "ids", "crc32", "payload"])
            names = names[done:]
            rest_n, rest_first = n[done:].copy(), first[done:].copy()
            if over:
                rest_n[0] -= over
                rest_first[0] += over
            ids, counts, firsts = [all_ids[whole:]], [rest_n], [rest_first]

        id_type = None
        for batch, data, offs in slices(batches, "text"):
            id_type = batch.schema.field(0).type
            some, n = token_ids(data, offs, tokenizer)
            ids.append(some)
            counts.append(n)
            firsts.append(np.zeros(len(n), np.int64))
            names += batch.column(0).to_pylist()
            if sum(map(len, ids)) >= LANES * block:
                yield from flush(False)
        if names:
            yield from flush(True)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA.format(kind))


def read_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, first_token, ids) of every part of a document in the blocks; a wrong checksum raises ValueError."""
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = batch.to_pydict()
            for names, firsts, counts, ids, crc in zip(table["doc_ids"], table["first_tokens"], table["n_tokens"], range_coder.decode(table["payload"], table["ids"]), table["crc32"], strict=True):
                if checksum(ids) != crc:
                    raise ValueError(f"checksum of the block from document {names[:1]} is wrong")
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays([pa.array(names, batch.schema.field("doc_ids").type.value_type), pa.array(firsts, pa.int64()), pa.array([ids[e - n : e].astype(np.int32) for e, n in zip(ends, counts, strict=True)], pa.list_(pa.int32()))], ["doc_id", "first_token", "ids"])

    return blocks.mapInArrow(run, f"doc_id {kind}, first_token long, ids array<int>")
