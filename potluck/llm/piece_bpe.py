"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding merges characters through a score-ordered agenda of adjacent symbol pairs: a pair
stands on the agenda when its joined text is a piece; the best-scored pair (the leftmost of
equals) is merged, its new neighbour pairs are added, and entries whose symbols have been
merged meanwhile are skipped. What is no piece in the end falls back to its UTF-8 bytes.

Texts are cut where no merge can reach across, as the vocabulary shows: before a space sign
that follows another character, at line ends, and between letters and other characters.
Every distinct part of a slice of texts is encoded, decoded and written in decimals once, and
kept in a pool of bounded size for each worker (``parts``); whole texts are put together from
the parts by offsets.

The vocabulary file is read by the sentencepiece library on each executor from a path, a
parameter. With ``verify``, the whole texts of each Arrow batch go to the library too, and
``matches_library`` says per row whether its ids and its decoded text agree, whatever the
worker has in its pool; the agenda's results are returned either way.

Defined cases: null and empty texts give the end id alone and the empty text; U+2581 in a
text is read as a space, as the library does; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from potluck.llm.common import doc_input
from potluck.llm.parts import PartPool, part_array, per_text
from potluck.llm.words import slices, text_buffers

SPACE = "▁"
CONTROL = b"\xff\xff"            # stands for a control id: no text, and never part of UTF-8
SHORT_PART = 24              # up to here the agenda is a plain list, beyond it a heap
LETTER = "A-Za-zÀ-ÖØ-öø-\u02af\u0300-\u036f\u1e00-\u1eff"    # Latin letters and marks on them

_loaded: dict[str, "PieceBpe"] = {}


class PieceBpe:
    """Vocabulary of a sentencepiece BPE model with byte fallback and identity normalization."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        skipped = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(pieces) if not skipped[i]}
        self.rank = {p: -lib.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.is_byte = [lib.is_byte(i) for i in range(n)]
        self.bytes = [CONTROL if lib.is_control(i) else bytes([int(p[3:5], 16)]) if self.is_byte[i]
                      else lib.decode([i]).encode() if lib.is_unknown(i)
                      else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.end = lib.eos_id()
        self.prefixed = lib.encode("a", out_type=str)[0].startswith(SPACE)
        if lib.normalize("  x  Ω ") != (SPACE if self.prefixed else "") + "  x  Ω ".replace(" ", SPACE):
            raise ValueError("only models with identity normalization are supported")
        self.decimals = [b"%d " % i for i in range(n)]
        # no piece holds a space sign or a line end behind another character; none both letters and others
        long = [p.lstrip(SPACE) for p in self.ids if len(p) > 1]
        mixed = re.compile(f"[{LETTER}][^{LETTER}]|[^{LETTER}][{LETTER}]")
        self.cut_words = not any(SPACE in p or "\n" in p for p in long)
        self.cut_letters = self.cut_words and not any(mixed.search(p) for p in long)
        self.pool = PartPool(self._encode_parts, [np.int32, np.uint8, np.uint8])

    def cut(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where parts begin in the texts ``data[bounds[i]:bounds[i + 1]]`` (spaces for space signs)."""
        start = np.zeros(data.size + 1, bool)
        start[bounds] = True
        start = start[:-1]
        if self.cut_words and data.size:
            space, line = data == 32, data == 10
            start |= line
            start[1:] |= line[:-1] | (space[1:] & ~space[:-1])
            if self.cut_letters:
                letter = _letters(data)
                start[1:] |= (letter[1:] != letter[:-1]) & ~space[:-1]
        return np.flatnonzero(start)

    def _encode_parts(self, parts: list[bytes]):
        ids = [self.encode_part(p.decode().replace(" ", SPACE)) for p in parts]
        number, text = self.decimals.__getitem__, self.bytes.__getitem__
        return ids, [b"".join(map(number, i)) for i in ids], [b"".join(map(text, i)) for i in ids]

    def encode_texts(self, column: pa.Array) -> Iterator["Encoded"]:
        """The texts of a column (null: empty), slice by slice."""
        column = pc.replace_substring(column.fill_null(""), SPACE, " ").cast(pa.large_string())
        if self.prefixed:
            column = pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise(
                pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))
        data, offsets = text_buffers(column)
        for at, to in slices(offsets):
            own, bounds = data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
            start = self.cut(own, bounds)
            first = np.searchsorted(start, bounds)
            places = self.pool.places(part_array(own, start, np.append(start[1:], own.size)))
            values = [c.gather(places) for c in self.pool.columns]
            yield Encoded(at, *[x for flat, lengths in values for x in (flat, _bounds(per_text(lengths, first)))])

    def merge(self, text: str) -> list[str]:
        """The symbols of a part after all merges."""
        return self._merge_short(text) if len(text) <= SHORT_PART else self._merge_long(text)

    def _merge_short(self, text: str) -> list[str]:
        symbols, rank, never = list(text), self.rank, float("inf")
        agenda = [rank.get(a + b, never) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == never:
                break
            i = agenda.index(best)
            joined = symbols[i] = symbols[i] + symbols[i + 1]
            del symbols[i + 1], agenda[i]
            if i:
                agenda[i - 1] = rank.get(symbols[i - 1] + joined, never)
            if i < len(agenda):
                agenda[i] = rank.get(joined + symbols[i + 1], never)
        return symbols

    def _merge_long(self, text: str) -> list[str]:
        symbols: list[str] = list(text)
        n, rank = len(symbols), self.rank
        agenda = []
        for i in range(n - 1):
            score = rank.get(symbols[i] + symbols[i + 1])
            if score is not None:
                agenda.append((score, i, i + 1, 2))
        heapq.heapify(agenda)
        right = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            _, a, b, size = pop(agenda)
            joined = symbols[a] + symbols[b]
            if not symbols[a] or not symbols[b] or len(joined) != size:
                continue
            symbols[a], symbols[b] = joined, ""
            c = right[a] = right[b]
            if c < n:
                left[c] = a
                score = rank.get(joined + symbols[c])
                if score is not None:
                    push(agenda, (score, a, c, size + len(symbols[c])))
            p = left[a]
            if p >= 0:
                score = rank.get(symbols[p] + joined)
                if score is not None:
                    push(agenda, (score, p, a, size + len(symbols[p])))
        return [s for s in symbols if s]

    def encode_part(self, text: str) -> tuple[int, ...]:
        out: list[int] = []
        for symbol in self.merge(text):
            found = self.ids.get(symbol)
            if found is None:
                out.extend(self.byte_ids[b] for b in symbol.encode())
            else:
                out.append(found)
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without the end id."""
        return next(self.encode_texts(pa.array([text]))).ids.tolist()

    def decoded(self, raw: bytes, first: int | None) -> bytes:
        """The text of a whole encoding, from the bytes of its pieces and its first id: the sign
        that encoding puts in front is taken off again, if a piece begins with it."""
        return raw[1:] if self.prefixed and first is not None and not self.is_byte[first] and raw[:1] == b" " else raw

    def decode(self, ids: Iterable[int]) -> str:
        """The text of any ids; bytes that are no UTF-8 become U+FFFD one by one."""
        ids = list(ids)
        while ids and self.bytes[ids[-1]] == CONTROL:
            ids.pop()
        raw = b"".join(map(self.bytes.__getitem__, ids))
        try:
            out = raw.decode()
        except UnicodeDecodeError:
            out = self._decode_runs(ids)
        # the sign that encoding puts in front is taken off again, if a piece begins with it
        first = next((i for i in ids if self.bytes[i] != CONTROL), None)
        if self.prefixed and first is not None and not self.is_byte[first] and out.startswith(" "):
            return out[1:]
        return out

    def _decode_runs(self, ids: list[int]) -> str:
        out, run = [], b""
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.bytes[i]
                continue
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[:size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    size = 1
                run = run[size:]
            if i is not None and self.bytes[i] != CONTROL:
                out.append(self.bytes[i].decode())
        return "".join(out)


@dataclass
class Encoded:
    """Encodings of the texts from number ``row`` on: ids, decimals of the ids with a space
    after each, and bytes of the pieces, one text after the other, with the bounds of each."""
    row: int
    ids: np.ndarray
    id_bounds: np.ndarray
    decimals: np.ndarray
    decimal_bounds: np.ndarray
    text: np.ndarray
    text_bounds: np.ndarray


def _bounds(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(lengths.size + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def _letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to characters of ``LETTER``."""
    out = ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122))
    lead = np.flatnonzero(data >= 0xC3)
    lead = lead[lead + 1 < data.size]
    one, two = data[lead], data[lead + 1]
    pair = ((one == 0xC3) & (two != 0x97) & (two != 0xB7)) | ((one >= 0xC4) & (one <= 0xC9)) | (one == 0xCC)
    pair |= ((one == 0xCA) | (one == 0xCD)) & (two <= 0xAF)
    triple = lead[(one == 0xE1) & (two >= 0xB8) & (two <= 0xBB)]
    lead = lead[pair]
    out[lead] = out[lead + 1] = True
    out[triple] = out[triple + 1] = out[triple + 2] = True
    return out


def load(path: str) -> PieceBpe:
    """The vocabulary at ``path``; one copy for each worker process."""
    if path not in _loaded:
        _loaded[path] = PieceBpe(path)
    return _loaded[path]


def encoder(path: str, verify: bool, outputs: tuple[str, ...]):
    """Task function: texts in; the wanted outputs, in Arrow batches, out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        end = str(model.end).encode()
        for batch in batches:
            for e in model.encode_texts(batch.column("text")):
                n = e.id_bounds.size - 1
                first = [int(e.ids[a]) if b > a else None for a, b in zip(e.id_bounds[:-1], e.id_bounds[1:])]
                text, digits = e.text.tobytes(), e.decimals.tobytes()
                decoded = [model.decoded(text[a:b], i) for a, b, i in zip(e.text_bounds[:-1], e.text_bounds[1:], first)]
                counts = np.diff(e.id_bounds) + 1
                out = {"doc_id": batch.column("doc_id").slice(e.row, n)}
                if "carry" in batch.schema.names:
                    out["carry"] = batch.column("carry").slice(e.row, n)
                if "ids" in outputs:
                    ids = np.full(int(counts.sum()), model.end, np.int32)
                    body = np.ones(ids.size, bool)
                    body[np.cumsum(counts) - 1] = False
                    ids[body] = e.ids
                    out["ids"] = pa.ListArray.from_arrays(pa.array(_bounds(counts).astype(np.int32)), pa.array(ids))
                if "decoded" in outputs:
                    out["decoded"] = pa.array(decoded, pa.binary()).cast(pa.string())
                out["n_tokens"] = pa.array(counts)
                out["ids_sha256"] = pa.array([hashlib.sha256(digits[a:b] + end).hexdigest() for a, b in zip(
                    e.decimal_bounds[:-1], e.decimal_bounds[1:])], pa.string())
                out["decoded_sha256"] = pa.array([hashlib.sha256(t).hexdigest() for t in decoded], pa.string())
                if verify:
                    texts = batch.column("text").slice(e.row, n).fill_null("").to_pylist()
                    theirs = model.library.encode(texts, num_threads=1)
                    back = model.library.decode(theirs, num_threads=1)
                    out["matches_library"] = pa.array(
                        [i == e.ids[a:b].tolist() and t.encode() == d for i, t, d, a, b in zip(
                            theirs, back, decoded, e.id_bounds[:-1], e.id_bounds[1:])], pa.bool_())
                yield pa.RecordBatch.from_pydict(out)
    return run


def piece_encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 carry: list[str] | None = None, outputs: tuple[str, ...] = ("ids", "decoded"),
                 verify: bool = False) -> DataFrame:
    """One row per input row: doc_id, on request carry, ids (with the end id) and decoded;
    n_tokens, ids_sha256, decoded_sha256; with ``verify`` matches_library."""
    rows = doc_input(docs, id_col, text_col, carry)
    fields = [T.StructField("doc_id", T.LongType())]
    if carry is not None:
        fields.append(T.StructField("carry", rows.schema["carry"].dataType))
    if "ids" in outputs:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    if "decoded" in outputs:
        fields.append(T.StructField("decoded", T.StringType()))
    fields += [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
               T.StructField("decoded_sha256", T.StringType())]
    if verify:
        fields.append(T.StructField("matches_library", T.BooleanType()))
    return rows.mapInArrow(encoder(model_path, verify, tuple(outputs)), T.StructType(fields))


def piece_decode(df: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the text of its id lists; a null list gives null."""
    @F.pandas_udf(T.StringType())
    def decode(ids):
        model = load(model_path)
        return ids.map(lambda x: None if x is None else model.decode(x))
    return df.withColumn(out_col, decode(F.col(f"`{ids_col}`")))
