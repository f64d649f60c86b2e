"""Packing: concatenate all documents' ids, and cut them into fixed windows."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored, utf8

LENGTH = 2048
#: Follows each document.
END_ID = 1


#: White space that the fast encoder's pattern engine can't take.
_LONG_RUN = re.compile(r"\s{10000}")


@lru_cache(maxsize=4)
def encoder(path: str, special: bool = False) -> Callable[[str], np.ndarray]:
    """Text to ids of a tokenizer file of the library ``tokenizers``. ``special``: strings of special tokens in the text are these tokens,
    as in the library's own ``encode(text, add_special_tokens=False)``; otherwise they are ordinary text.

    A byte-level BPE whose merges make the ids in order is run by tiktoken, which merges by id and gives the same ids some four times
    as fast; any other file, with ``special`` any text that holds a token added to the file, and any text with a very long run of white
    space, on which its pattern engine overflows its stack, is run by ``tokenizers`` itself.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = not special

    def plain(text: str) -> np.ndarray:
        return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)

    spec = json.loads(open(path, encoding="utf-8").read())
    ranks, pattern = _ranks(spec)
    if ranks is None:
        return plain
    import tiktoken

    added = [t["content"] for t in spec.get("added_tokens") or [] if special or not t.get("special")]
    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        return plain(text) if any(t in text for t in added) or _LONG_RUN.search(text) else np.asarray(fast.encode_ordinary(text), np.uint32)

    return encode


def _ranks(spec: dict) -> tuple[dict[bytes, int] | None, str]:
    """Byte ranks of a byte-level BPE file, or None if merging by id isn't merging by rule there."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or model.get("ignore_merges") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
        return None, ""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"] for t in spec.get("added_tokens") or []}
    ranks = {bytes(byte[c] for c in s): i for s, i in model["vocab"].items() if s not in special}
    merged = [ranks.get(bytes(byte[c] for part in (m.split(" ") if isinstance(m, str) else m) for c in part), -1) for m in model["merges"]]
    if merged != sorted(set(merged)) or merged[:1] == [-1] or len(merged) + 256 != len(ranks):
        return None, ""
    return ranks, r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def pack_ids(ids: np.ndarray) -> bytes:
    """Ids as compressed 16-bit integers where they fit, else 32-bit; the first byte says which."""
    wide = len(ids) and int(ids.max()) > 0xFFFF
    raw = ids.astype("<u4" if wide else "<u2").tobytes()
    return (b"\x04" if wide else b"\x02") + len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack_ids(blob: bytes) -> np.ndarray:
    raw = pa.Codec("zstd").decompress(blob[9:], int.from_bytes(blob[1:9], "little"), asbytes=True) if len(blob) > 9 else b""
    return np.frombuffer(raw, "<u4" if blob[0] == 4 else "<u2").astype("<u4")


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = END_ID, text: str = "text", id: str = "doc_id", special: bool = False) -> DataFrame:
    """First pass: doc_id, ids (packed), n, and the document's place: part (its partition) and before (ids before it there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = encoder(tokenizer, special), TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = utf8(batch, "_text")
            blobs, n, at = [], [], []
            for i in range(batch.num_rows):
                ids = np.append(encode(data[offsets[i] : offsets[i + 1]].tobytes().decode()), np.uint32(end_id))
                blobs.append(pack_ids(ids))
                n.append(len(ids))
                at.append(before)
                before += len(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary()), pa.array(n, pa.int64()), pa.array([part] * len(n), pa.int32()), pa.array(at, pa.int64())], names=["doc_id", "ids", "n", "part", "before"])

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("_text")).mapInArrow(run, "doc_id long, ids binary, n long, part int, before long")


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, text: str = "text", id: str = "doc_id", special: bool = False) -> DataFrame:
    """Pieces of documents in sequences of ``length`` ids: doc_id, start, length, piece (packed ids), ids_crc32, doc_tokens,
    sequence_id, offset.

    Pass 1 tokenizes each document once, stores its ids, and totals the ids of each partition; a prefix sum over these totals (a
    row for each partition) gives every document its global offset. Pass 2 cuts at the multiples of ``length``: a document that
    crosses a border leaves a record on either side. Only the last sequence is not full. Documents stand in the table's own order;
    null and empty texts are the end id alone; rows that repeat and null ids are packed like any other; an empty table gives no piece.
    Other columns are not read. ``special``: see ``encoder``.
    """
    prepare(docs.sparkSession)
    done = stored(tokenized(docs, tokenizer, end_id, text, id, special))
    totals = done.groupBy("part").agg(F.sum("n").alias("_total"))
    w = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("_total").over(w), F.lit(0)).alias("_base"))
    placed = done.join(F.broadcast(base), "part").select("doc_id", "ids", "n", (F.col("_base") + F.col("before")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, blob, n, at in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids = unpack_ids(blob)
                start = 0
                while start < n:
                    seq, offset = divmod(at + start, length)
                    size = min(n - start, length - offset)
                    piece = ids[start : start + size]
                    for column, value in zip(out, (doc, start, size, pack_ids(piece), zlib.crc32(piece.tobytes()), n, seq, offset), strict=True):
                        column.append(value)
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 3 else pa.int64()) for i, c in enumerate(out)], names=["doc_id", "start", "length", "piece", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return placed.mapInArrow(cut, "doc_id long, start long, length long, piece binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = END_ID) -> DataFrame:
    """Whole sequences: sequence_id, ids (array of ``length`` ids, padded at the end) and n (ids before the padding).

    A sequence has ``length`` ids at most, so no group is larger than that. No pieces give no sequences; null and repeated documents are
    told apart by their pieces' places, and other columns are not read.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["offset"].to_pylist(), table["piece"].to_pylist(), strict=True))
        ids = np.concatenate([unpack_ids(x) for _, x in rows])
        full = np.append(ids, np.full(length - len(ids), pad_id, np.uint32))
        return pa.table({"sequence_id": [key[0].as_py()], "ids": pa.array([full.astype(np.int32)], pa.list_(pa.int32())), "n": [len(ids)]})

    return pieces.select("sequence_id", "offset", "piece").groupBy("sequence_id").applyInArrow(run, "sequence_id long, ids array<int>, n long")
