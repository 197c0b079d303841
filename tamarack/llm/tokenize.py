"""Encoding of a corpus with a public byte-level BPE tokenizer, reusing content-defined chunks.

Method. Each text is cut where a hash of the preceding bytes hits a mask (content-defined chunking), so the same wording
gives the same chunks in whatever document it stands. A worker keeps the ids of chunks it has met and encodes a chunk only
once; the ids of a document are the joined ids of its chunks. Joins must be exact:

* a *safe* cut lies before a blank that follows a character which is no white space. The tokenizer splits the text at such a
  place anyhow (every alternative of its pattern has at most one leading blank), so both sides keep their ids;
* a stretch longer than HARD bytes without a safe cut (no blanks at all) is cut at any hit of the hash. Such a join is
  repaired: pieces around it are re-encoded from the last pre-token of the left chunk onwards until the pre-token
  boundaries agree with those of the right chunk; behind that point the ids are the same again.

The chunks are shared within a worker process, not over a shuffle: sending every chunk to the executor that owns it and the
ids back would move several times the corpus, while encoding what a worker hasn't met yet costs far less. The plan is a
narrow map over the scan, so it runs at any size without a shuffle.

Defined results: a null or empty text has an empty list; text that looks like a special token is ordinary text; any other
string is encoded exactly as the tokenizer library encodes it whole. Repeated rows give repeated results. Extra columns are
ignored unless named in keep; the result column replaces a kept one of that name.
"""

from __future__ import annotations

import base64
import functools
import importlib
import os
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One cut at about every 2**MASK_BITS-th safe place.
MASK_BITS = 2
#: Bytes without a safe cut after which any hit of the hash cuts.
HARD = 4096
#: Chunks, and ids, that a worker keeps before it starts its table anew.
KEEP_CHUNKS = 400_000
KEEP_IDS = 16_000_000

DEFAULT_RANKS = "byte_bpe_50k.tiktoken"
#: Split pattern of the tokenizer family (fixed value of the public format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str = DEFAULT_RANKS, folder: str | None = None) -> str:
    """Path of a public vocabulary file: folder, else $TOKENIZER_DIR, else the installed package of public tokenizers."""
    folder = folder or os.environ.get("TOKENIZER_DIR")
    if not folder:
        try:
            return importlib.import_module("public_tokenizers").path(name)
        except ImportError:
            folder = "/opt/tokenizers"
    return os.path.join(folder, name)


@functools.lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each position, as one number (positions may be unaligned)."""
    return np.ndarray((len(data) - 7,), dtype="<u8", buffer=data.data, strides=(1,))


def window_hits(padded: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """Which positions (in padded, at least 16 bytes in) are cut: hash of the 16 bytes before them."""
    v = _words(padded)
    with np.errstate(over="ignore"):
        h = (v[at - 8] * np.uint64(0x9E3779B97F4A7C15)) ^ (v[at - 16] * np.uint64(0xC2B2AE3D27D4EB4F))
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return at[(h >> np.uint64(64 - bits)) == 0] if bits else at


def cuts(padded: np.ndarray, starts: np.ndarray, end: int, bits: int = MASK_BITS, hard: int = HARD) -> tuple[np.ndarray, np.ndarray]:
    """Sorted chunk starts in padded (16 bytes of padding, then the texts end to end) and those of them that aren't safe."""
    b = padded[: end]
    blank = np.flatnonzero(b[17:] == 0x20) + 17
    prev, before = b[blank - 1], b[blank - 2]
    # ASCII that isn't blank, or the second byte of a two-byte Latin or Cyrillic letter
    solid = ((prev > 0x20) & (prev < 0x7F)) | ((prev >= 0x80) & ((before == 0xD0) | (before == 0xD1) | ((before == 0xC3))))
    safe = window_hits(padded, blank[solid], bits)
    mark = np.zeros(end, dtype=bool)
    mark[starts] = mark[safe] = True
    first = np.flatnonzero(mark)
    gaps = np.diff(np.append(first, end))
    unsafe = []
    for at in np.flatnonzero(gaps > hard):
        a, z = int(first[at]), int(first[at] + gaps[at])
        inside = np.arange(a + hard // 4, z)
        inside = window_hits(padded, inside[(b[inside] & 0xC0) != 0x80], 10)
        last = a
        for p in inside.tolist():
            if p - last >= hard // 4:
                unsafe.append(p)
                last = p
    more = np.asarray(unsafe, dtype=first.dtype)
    return np.union1d(first, more), more


@functools.lru_cache(maxsize=1)
def _pretokens():
    import regex

    return regex.compile(PATTERN)


def _plain(c: str) -> bool:
    """Characters whose class is the same in every version of the Unicode tables."""
    return c < "ɐ" or "Ѐ" <= c < "Ѡ" or "一" <= c < "鼀" or "぀" <= c < "㄀"


def repair(left: str, right: str, encode) -> tuple[int, int, list[int]]:
    """Characters of left kept, characters of right replaced, and the ids for what lies between.

    left[:kept] and right[replaced:] keep the ids that they have alone.
    """
    pattern = _pretokens()
    kept = 0
    for m in pattern.finditer(left):
        if m.start() and not left[m.start() - 1].isspace() and _plain(left[m.start() - 1]) and _plain(left[m.start()]):
            kept = m.start()
    own = {m.start() for m in pattern.finditer(right)}
    joined, gap = left[kept:] + right, len(left) - kept
    for m in pattern.finditer(joined):
        p = m.start() - gap
        if p > 0 and p in own and _plain(right[p - 1]) and _plain(right[p]):
            return kept, p, encode(joined[: m.start()])
    return kept, len(right), encode(joined)


class ChunkEncoder:
    """Ids of texts, with the ids of chunks kept for reuse."""

    def __init__(self, path: str, bits: int = MASK_BITS, hard: int = HARD):
        self.encode, self.bits, self.hard = encoding(path).encode_ordinary, bits, hard
        self.met = self.encoded = 0
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.lengths: list[int] = []
        self.pool = array("i")

    def _add(self, chunk: bytes) -> int:
        self.encoded += 1
        self.index[chunk] = at = self._keep(self.encode(chunk.decode("utf-8")))
        return at

    def _keep(self, ids: list[int]) -> int:
        self.pool.extend(ids)
        self.lengths.append(len(ids))
        return len(self.lengths) - 1

    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.asarray(self.lengths, dtype=np.int64)
        return np.array(self.pool, dtype=np.int32), np.cumsum(lengths) - lengths, lengths

    def batch(self, column: pa.Array, values: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Offsets of each row's ids (one more than rows) and all ids, or None in their place."""
        if len(self.index) > KEEP_CHUNKS or len(self.pool) > KEEP_IDS:
            self.clear()
        column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
        column = pa.compute.fill_null(column, "")
        _, offsets, data = column.buffers()
        o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        a, z = int(o[0]), int(o[-1])
        padded = np.zeros(16 + z - a + 8, np.uint8)
        if z > a:
            padded[16 : 16 + z - a] = np.frombuffer(data, np.uint8)[a:z]
        end = 16 + z - a
        starts = o[:-1] - a + 16
        filled = starts[np.diff(o) > 0]
        at, unsafe = cuts(padded, filled, end, self.bits, self.hard)
        if not len(at):
            return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.int32) if values else None
        raw = padded[:end].tobytes()
        bounds = np.append(at, end).tolist()
        get, add = self.index.get, self._add
        which = []
        append = which.append
        for p, q in zip(bounds, bounds[1:]):
            chunk = raw[p:q]
            k = get(chunk)
            append(add(chunk) if k is None else k)
        self.met += len(which)
        if len(unsafe):
            which, at = self._repaired(which, at, set(unsafe.tolist()), raw, bounds)
        pool, begin, length = self._table()
        w = np.asarray(which)
        n = length[w]
        total = np.concatenate(([0], np.cumsum(n)))
        rows = total[np.searchsorted(at, np.append(starts, end), side="left")]
        if not values:
            return rows, None
        take = np.repeat(begin[w] - total[:-1], n) + np.arange(total[-1])
        return rows, pool[take]

    def _repaired(self, which: list[int], at: np.ndarray, unsafe: set[int], raw: bytes, bounds: list[int]) -> tuple[list[int], np.ndarray]:
        """The stretches with unsafe joins as one chunk each, their ids joined by repair."""
        out, starts, k = [], [], 0
        while k < len(which):
            j = k + 1
            while j < len(which) and bounds[j] in unsafe:
                j += 1
            starts.append(bounds[k])
            if j == k + 1:
                out.append(which[k])
            else:
                out.append(self._stretch([raw[bounds[i] : bounds[i + 1]].decode("utf-8") for i in range(k, j)]))
            k = j
        return out, np.asarray(starts, dtype=np.int64)

    def _stretch(self, parts: list[str]) -> int:
        ids: list[int] = []
        rest = parts[0]
        for right in parts[1:]:
            kept, replaced, between = repair(rest, right, self.encode)
            ids += self.encode(rest[:kept])
            if replaced < len(right):
                ids += between
                rest = right[replaced:]
            else:  # no agreement within the right chunk: what lies between stays open
                rest = rest[kept:] + right
        ids += self.encode(rest)
        return self._keep(ids)


_encoders: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, bits: int = MASK_BITS) -> ChunkEncoder:
    """The worker's encoder: its chunks serve all batches and tasks that the worker runs."""
    key = (path, bits)
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(path, bits)
    return _encoders[key]


def _with_column(batch: pa.RecordBatch, keep: Sequence[str], name: str, column: pa.Array) -> pa.RecordBatch:
    names = [c for c in keep if c != name]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in names] + [column], names=[*names, name])


def encode_corpus(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), out: str = "ids", path: str | None = None, bits: int = MASK_BITS) -> DataFrame:
    """Adds the list of token ids of text; see the module for method and defined cases."""
    path = path or tokenizer_path()
    keep = [c for c in keep if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, bits)
        for batch in batches:
            offsets, ids = own.batch(batch.column(batch.num_columns - 1))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, type=pa.int32()))
            yield _with_column(batch, keep, out, lists)

    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(T.IntegerType(), True))])
    return source.mapInArrow(run, schema)


def count_tokens(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), out: str = "n_tokens", path: str | None = None, bits: int = MASK_BITS) -> DataFrame:
    """Adds the number of token ids of text (0 for null or empty), without building the lists."""
    path = path or tokenizer_path()
    keep = [c for c in keep if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, bits)
        for batch in batches:
            offsets, _ = own.batch(batch.column(batch.num_columns - 1), values=False)
            yield _with_column(batch, keep, out, pa.array(np.diff(offsets)))

    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField(out, T.LongType(), True)])
    return source.mapInArrow(run, schema)
