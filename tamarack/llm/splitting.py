"""Splitting oversized items at natural boundaries.

An item longer than its limit becomes ordered pieces. Dynamic programming over the boundary positions of the text minimises
the summed cut penalties plus a penalty for uneven sizes, subject to the maximum length; each piece after the first begins up
to overlap characters before the end of the piece before it, again at a boundary: the strongest within the overlap, or else the end
of its first clause or word. Boundaries and their penalties: blank line,
line end, end of a sentence, end of a clause, white space, and - only where a stretch has none of these - the edge between
two grapheme clusters (no cut within a surrogate, a combining sequence, a joined emoji or a line end of two characters).

Lengths are code points. Pieces are exact substrings: they cover the text from its first to its last character, so nothing is
lost, and offsets allow a round trip. Items within the limit come out as they are only if keep_small is set.

Cost: the program runs over the boundaries of one text. Weak boundaries enter only where stretches between stronger ones are
longer than half of what a piece may hold, so their number stays about length/limit times a constant and a very long text
costs time in proportion to its length. The plan is a narrow map: texts within the limit are filtered out by the scan side.

Defined results: null and empty items have no pieces; a single cluster longer than the limit is cut anyway (between code
points); overlap is at most half of the limit; repeated rows give repeated pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Penalty of a cut by kind of boundary, from the best to the worst.
PENALTY = (0.0, 1.0, 2.0, 4.0, 7.0, 12.0, 40.0)
PARAGRAPH, LINE, SENTENCE, CLAUSE, BLANK, CLUSTER, FORCED = range(7)
#: Weight of the squared relative deviation from even sizes.
BALANCE = 3.0

_STRONG = re.compile(r"(?P<p>(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n)\s*)|(?P<l>\r\n|[\r\n\u2028\u2029\x85\x0b\x0c])|(?P<s>[.!?…。！？][\"'»”“)\]]*\s+(?=\S)|[。！？])")
_CLAUSE = re.compile(r"[,;:–—|][\s]+")
_BLANK = re.compile(r"\s+")
_ABBREVIATION = re.compile(r"(?:\b\w|\bт\.\s?\w|\d|\b(?:ул|пр|стр|кв|вул|буд|см|др|тыс|млн|руб|bzw|Nr|Dr|Prof|Str|z\.\s?B|usw|ca|e\.g|i\.e|etc|No|St|Mr|Mrs))\.\s+$", re.IGNORECASE)


def _clusters():
    import regex

    return regex.compile(r"\X")


def _boundaries(text: str, limit: int, overlap: int) -> tuple[list[int], list[int]]:
    """Positions where text may be cut, in order, with their kinds; 0 and the end included."""
    n = len(text)
    kind: dict[int, int] = {}
    for m in _STRONG.finditer(text):
        k = PARAGRAPH if m.lastgroup == "p" else LINE if m.lastgroup == "l" else SENTENCE
        if k == SENTENCE and _ABBREVIATION.search(text, max(0, m.start() - 8), m.end()):
            k = CLAUSE
        kind[m.end()] = min(k, kind.get(m.end(), FORCED))
    room = max(1, (limit - overlap) // 2)

    def fill(pattern: re.Pattern, k: int, room: int) -> None:
        marks = [0, *sorted(kind), n]
        for a, z in zip(marks, marks[1:]):
            if z - a > room:
                for m in pattern.finditer(text, a, z):
                    if a < m.end() < z:
                        kind.setdefault(m.end(), k)

    fill(_CLAUSE, CLAUSE, room)
    fill(_BLANK, BLANK, room)
    marks = [0, *sorted(kind), n]
    if any(z - a > room for a, z in zip(marks, marks[1:])):
        step = max(1, room // 4)
        whole = _clusters()
        for a, z in zip(marks, marks[1:]):
            if z - a > room:
                last = a
                for m in whole.finditer(text, a, z):
                    for p in range(m.start() + limit, m.end(), max(1, limit // 2)):
                        kind.setdefault(p, FORCED)
                    if m.end() - last >= step and m.end() < z:
                        kind.setdefault(m.end(), CLUSTER)
                        last = m.end()
    kind.pop(0, None)
    kind.pop(n, None)
    at = sorted(kind)
    return [0, *at, n], [PARAGRAPH, *[kind[p] for p in at], PARAGRAPH]


def split_spans(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(begin, end) of each piece of text, in order."""
    if not text:
        return []
    n = len(text)
    if n <= limit:
        return [(0, n)]
    overlap = max(0, min(overlap, limit // 2))
    at, kind = _boundaries(text, limit, overlap)
    # where a piece begins if the one before ends at boundary i: the strongest boundary within the overlap, the farthest of equals
    begin = list(at)
    if overlap:
        for i in range(1, len(at) - 1):
            j, best = i - 1, None
            while j > 0 and at[i] - at[j] <= overlap:
                if best is None or kind[j] <= kind[best]:
                    best = j
                j -= 1
            if best is not None and kind[best] < FORCED:
                begin[i] = at[best]
            else:
                begin[i] = _inside(text, max(1, at[i] - overlap), at[i])
    even = n / -(-n // limit) if n else 1
    cost = [float("inf")] * len(at)
    back = [0] * len(at)
    cost[0] = 0.0
    last = len(at) - 1
    low = 0
    for e in range(1, len(at)):
        while at[e] - begin[low] > limit and low < e - 1:
            low += 1
        c = PENALTY[kind[e]] if e < last else 0.0
        for p in range(e - 1, low - 1, -1):
            if cost[p] == float("inf"):
                continue
            size = at[e] - begin[p]
            if size > limit:
                continue
            off = (size - even) / limit
            total = cost[p] + c + BALANCE * off * off
            if total < cost[e]:
                cost[e], back[e] = total, p
    if cost[last] == float("inf"):  # only where a cluster is longer than the limit
        step = limit - overlap if overlap < limit else limit
        return [(a, min(n, a + limit)) for a in range(0, max(1, n - overlap), step)]
    ends = [last]
    while back[ends[-1]]:
        ends.append(back[ends[-1]])
    ends.reverse()
    spans = [(0, at[ends[0]])]
    for p, e in zip(ends, ends[1:]):  # a piece shorter than the overlap isn't repeated whole
        spans.append((begin[p] if begin[p] > spans[-1][0] else at[p], at[e]))
    return spans


def _inside(text: str, a: int, z: int) -> int:
    """End of the first clause between two places, or else of the first word; the second place if there is neither."""
    for pattern in (_CLAUSE, _BLANK):
        for m in pattern.finditer(text, a, z):
            if m.end() < z:
                return m.end()
    return z


def split_items(items: DataFrame, keep: Sequence[str], text: str, limit: str = "limit", overlap: str = "overlap", keep_small: bool = False) -> DataFrame:
    """Pieces of items: the kept columns with piece_no, begin, end and piece.

    limit and overlap are columns, so that several kinds of items share one pass.
    """
    source = items.select(*[F.col(f"`{c}`") for c in keep], F.col(limit).cast("int").alias("__limit"), F.col(overlap).cast("int").alias("__overlap"), F.col(text).alias("__text"))
    source = source.where(F.length("__text") > (0 if keep_small else F.col("__limit")))
    keep = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, no, begins, ends, pieces = [], [], [], [], []
            texts, limits, overlaps = (b.column(len(keep) + i).to_pylist() for i in (2, 0, 1))
            for r, (t, lim, over) in enumerate(zip(texts, limits, overlaps)):
                for i, (p, q) in enumerate(split_spans(t, lim, over)):
                    row.append(r)
                    no.append(i)
                    begins.append(p)
                    ends.append(q)
                    pieces.append(t[p:q])
            take = pa.array(row, type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(i).take(take) for i in range(len(keep))] + [pa.array(no, pa.int32()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), pa.array(pieces, pa.string())],
                names=[*keep, "piece_no", "begin", "end", "piece"],
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)]]
    return source.mapInArrow(run, ", ".join([*fields, "piece_no int", "begin int", "end int", "piece string"]))


def knowledge_items(simple_documents: DataFrame, chunk_pairs: DataFrame, limits: tuple[int, int, int] = (1600, 1600, 400), overlaps: tuple[int, int, int] = (200, 200, 50)) -> DataFrame:
    """(item_kind, item_key, pos, text, limit, overlap) of contents, parents and children, in one pass over each table."""
    column = lambda kind, key, pos, text, i: F.struct(F.lit(kind).alias("item_kind"), key.cast("string").alias("item_key"), pos.cast("int").alias("pos"), text.alias("text"), F.lit(limits[i]).alias("limit"), F.lit(overlaps[i]).alias("overlap"))
    docs = simple_documents.select(column("content", F.col("id"), F.lit(0), F.col("content"), 0).alias("x")).where(F.length("x.text") > limits[0])
    parent = column("parent", F.col("parent_id"), F.lit(0), F.col("parent_content"), 1)
    child = F.transform(F.coalesce(F.col("children_content"), F.array().cast("array<string>")), lambda t, i: column("child", F.col("parent_id"), i, t, 2))
    pairs = chunk_pairs.select(F.explode(F.filter(F.concat(F.array(parent), child), lambda x: F.length(x["text"]) > x["limit"])).alias("x"))
    return docs.unionByName(pairs).select("x.*")
