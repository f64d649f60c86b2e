"""SentencePiece encoding by a streaming Viterbi search, and decoding."""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .packing import pack_ids, unpack_ids

SPACE = "▁"
#: Characters of encoded units (runs of spaces with the word after them) that a task remembers at a time, and search states and pairs.
REMEMBERED, STATES = 6_000_000, 600_000
#: The search states of units' first characters are remembered.
HEAD = 7


class Model:
    """Pieces of a model file, of kind BPE or unigram.

    The search walks over the text once. For every boundary it keeps the best way to reach it: the last piece, a backpointer.

    * unigram: the way with the largest sum of scores.
    * BPE: the only way whose neighbouring pieces stay apart when the merges run in order of their scores. A text's encoding is the
      one sequence in which each piece, and each pair of neighbours, encodes to itself, and a beginning of it encodes the beginning
      of the text it covers; so a boundary has exactly one last piece that fits the piece before it.

    Only boundaries within the longest piece can be continued. When all of these lead back to one boundary, the ids before it are final:
    they are given out, and the window moves on. Memory is bounded by the longest piece and not by the text. Where no piece has a space
    after another character, all ways meet before each space that follows one; what stands between such boundaries is a unit, whose
    ids depend on nothing else, so they are remembered and found again. All units take the same search.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.lib, self.lib.get_piece_size()
        usual = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.id = {lib.id_to_piece(i): i for i in usual}
        self.piece = {i: s for s, i in self.id.items()}
        self.score = {i: lib.get_score(i) for i in usual}
        self.byte = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = not any(i == lib.unk_id() for i in self.byte)
        self.raw = {i: bytes([b]) for b, i in enumerate(self.byte)} if self.bytes else {}
        self.bpe = _kind(lib) == 2
        self.longest = max(map(len, self.id), default=1)
        #: every ending of a piece: where a longer one isn't among them, no longer piece can end there either
        self.endings = frozenset(s[k:] for s in self.id for k in range(len(s)))
        #: no piece has a space after another character, so a space after one is a boundary of every way
        self.split = not any(SPACE in s.lstrip(SPACE) for s in self.id)
        self.worst = min(self.score.values(), default=0.0) - 10.0
        #: when a piece is merged: 0 is first; characters are there before all merges
        place = {v: i for i, v in enumerate(sorted({self.score[i] for s, i in self.id.items() if len(s) > 1}, reverse=True))}
        self.turn = {s: -1 if len(s) == 1 else place[self.score[i]] for s, i in self.id.items()}
        #: of BPE pieces, those that encode to themselves, with the two that their last merge joins; the others never appear
        self.halves: dict[str, tuple[str, str]] = {}
        self.usable = {s for s in self.id if not self.bpe or len(s) == 1 or self._merge(s) == [s]}
        #: usable pieces by their characters from the last to the first; "" leads to the piece
        self.tail: dict = {}
        for s in sorted(self.usable) if self.bpe else ():
            node = self.tail
            for c in reversed(s):
                node = node.setdefault(c, {})
            node[""] = s
        self.fits: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.held = 0
        self.heads: dict[str, tuple[list[str | None], list[float]]] = {}

    def _merge(self, s: str) -> list[str]:
        """BPE by its definition, for short strings: join the neighbours of the best score, the leftmost first."""
        x, turn = list(s), self.turn
        while len(x) > 1:
            best = min(((t, k) for k in range(len(x) - 1) if (t := turn.get(x[k] + x[k + 1])) is not None), default=None)
            if best is None:
                break
            k = best[1]
            if len(x) == 2:
                self.halves[s] = (x[0], x[1])
            x[k : k + 2] = [x[k] + x[k + 1]]
        return x

    def apart(self, a: str, b: str) -> bool:
        """Whether pieces a and b stay as they are next to each other; a character without a piece joins nothing.

        Merges are undone from the last on, at the side where it was later. A piece across the border that would have been merged before
        what was undone last (or, on the right, at the same turn, as the leftmost goes first) would have come first.
        """
        ok = self.fits.get((a, b))
        if ok is None:
            if len(self.fits) >= STATES:
                self.fits.clear()
            turn, x, y, limit = self.turn, a, b, 1 << 60
            ok = a not in turn or b not in turn
            while not ok:
                across = turn.get(x + y)
                if across is not None and across < limit:
                    break
                left, right = turn[x], turn[y]
                if left > right:
                    limit, x = left, self.halves[x][1]
                elif right >= 0:
                    limit, y = right + 1, self.halves[y][0]
                else:
                    ok = True
            self.fits[a, b] = ok
        return ok

    def _fill(self, text: str, last: list[str | None], value: list[float], done: int, to: int) -> None:
        """Extend ``last`` (the last piece by boundary, from ``done`` on; None: not reachable) and the unigram ``value`` up to ``to``."""
        endings, usable, tail, fits, apart = self.endings, self.usable, self.tail, self.fits, self.apart
        if self.bpe:
            for j in range(done + len(last), to + 1):
                node, i, found, piece = tail, j - 1, [], None
                while i >= done and (node := node.get(text[i])) is not None:
                    if (s := node.get("")) is not None:
                        found.append(s)
                    i -= 1
                while found:  # the longest first
                    s = found.pop()
                    before = last[j - len(s) - done]
                    if before is None:
                        continue
                    ok = fits.get((before, s)) if before else True
                    if ok or (ok is None and apart(before, s)):
                        piece = s
                        break
                last.append(text[j - 1] if piece is None and last[-1] is not None else piece)
            return
        for j in range(done + len(last), to + 1):
            best, piece, i = -np.inf, None, j - 1
            while i >= done and (s := text[i:j]) in endings:
                if s in usable and last[i - done] is not None and (v := value[i - done] + self.score[self.id[s]]) > best:
                    best, piece = v, s
                i -= 1
            if piece is None and last[-1] is not None:
                best, piece = value[-1] + self.worst, text[j - 1]
            last.append(piece)
            value.append(best)

    def _ids(self, last: list[str | None], size: int) -> list[int]:
        """Ids of the way to the boundary ``size`` after the first."""
        out: list[int] = []
        while size > 0:
            s = last[size]
            i = self.id.get(s)
            if i is None:
                out += reversed(self._fallback(s))
            else:
                out.append(i)
            size -= len(s)
        out.reverse()
        return out

    def stream(self, text: str) -> Iterator[int]:
        """Ids of normalised ``text``, each given out as soon as it is final."""
        for unit in _UNIT.finditer(text) if self.split else (text,):
            yield from (self._unit(unit[0]) if self.split else itertools.chain.from_iterable(self._search(unit)))

    def _unit(self, unit: str) -> Iterable[int]:
        """Ids of a unit: remembered, or searched and then remembered, and given out while they are found if they are too many for that."""
        ids = self.known.get(unit)
        if ids is None:
            runs = self._search(unit)
            if len(unit) > REMEMBERED:
                return itertools.chain.from_iterable(runs)
            ids = self._remember(unit, tuple(itertools.chain.from_iterable(runs)))
        return ids

    def _remember(self, unit: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        if self.held + len(unit) > REMEMBERED:
            self.known.clear()
            self.held = 0
        self.held += len(unit)
        self.known[unit] = ids
        return ids

    def _search(self, text: str) -> Iterator[list[int]]:
        """Ids of ``text`` in runs, each as soon as all ways that can be continued lead back to its end."""
        width, n, head = self.longest, len(text), text[:HEAD]
        if not n:
            return
        start = self.heads.get(head)
        if start is None:
            if len(self.heads) >= STATES:
                self.heads.clear()
            start = ([""], [0.0])
            self._fill(head, *start, 0, len(head))
            self.heads[head] = start
        last, value = start[0].copy(), start[1].copy()
        done, look = 0, max(4 * width, HEAD)
        while done < n:
            at = min(n, done + look)
            self._fill(text, last, value, done, at)
            # boundaries that can still be continued, followed back until they are one
            if at == n:
                yield self._ids(last, n - done)
                return
            alive = {i for i in range(max(done, at - width), at + 1) if last[i - done] is not None}
            while len(alive) > 1:
                top = max(alive)
                alive.remove(top)
                alive.add(top - len(last[top - done]))
            to = alive.pop()
            if to == done:
                look += 4 * width
                continue
            yield self._ids(last, to - done)
            last, value, done, look = last[to - done :], value[to - done :], to, 4 * width

    def _fallback(self, character: str) -> list[int]:
        return [self.byte[b] for b in character.encode()] if self.bytes else [self.lib.unk_id()]

    def encode(self, text: str) -> list[int]:
        whole = self.lib.normalize(text).replace(" ", SPACE) if text else ""
        if not self.split:
            return list(self.stream(whole))
        out: list[int] = []
        known = self.known
        for unit in _UNIT.findall(whole):
            out += known.get(unit) or self._unit(unit)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes that are no UTF-8 give U+FFFD; control ids and unknown ids give nothing."""
        out = b"".join(self.piece[i].encode() if i in self.piece else self.raw.get(i, b"") for i in ids).decode("utf-8", "replace").replace(SPACE, " ")
        return out[1:] if out.startswith(" ") else out


_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def _kind(lib) -> int:
    """1 for unigram and 2 for BPE, from the trainer part of the model file."""
    blob, at = lib.serialized_model_proto(), 0

    def varint(b: bytes, i: int) -> tuple[int, int]:
        x = shift = 0
        while True:
            x |= (b[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if b[i - 1] < 128:
                return x, i

    def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
        i = 0
        while i < len(b):
            tag, i = varint(b, i)
            if tag & 7 == 0:
                v, i = varint(b, i)
            elif tag & 7 == 2:
                size, i = varint(b, i)
                v, i = b[i : i + size], i + size
            else:
                size = 8 if tag & 7 == 1 else 4
                v, i = b[i : i + size], i + size
            yield tag >> 3, v

    trainer = next((v for k, v in fields(blob) if k == 2), b"")
    return next((v for k, v in fields(trainer) if k == 3), 1)


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ids (packed) and n_ids for every row; null and empty texts have no ids.

    Rows that repeat and null ids are encoded row by row; an empty table gives an empty result; other columns are not read.
    """
    prepare(docs.sparkSession)
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            ids = [m.encode(t or "") for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array([pack_ids(np.array(x, np.uint32)) for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())], names=[*keep, "ids", "n_ids"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, ", ".join([f"`{c}` {t}" for c, t in zip(keep, kinds, strict=True)]) + ", ids binary, n_ids long")


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the decoded text of rows with ids; null ids give null."""
    prepare(encoded.sparkSession)
    kinds = [encoded.schema[c].dataType.simpleString() for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = [None if x is None else m.decode(unpack_ids(x).tolist()) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], names=[*keep, "text"])

    return encoded.select(*keep, "ids").mapInArrow(run, ", ".join([f"`{c}` {t}" for c, t in zip(keep, kinds, strict=True)]) + ", text string")


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian 32-bit ids) and same (whether decoding gives the text, null being empty) for every row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            n, crc, same = [], [], []
            for t in batch.column(1).to_pylist():
                ids = m.encode(t or "")
                n.append(len(ids))
                crc.append(zlib.crc32(np.array(ids, "<u4").tobytes()))
                same.append(m.decode(ids) == (t or ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "ids_crc32", "same"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_text")).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, same boolean")
