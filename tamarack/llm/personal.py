"""Personal information in free text, found by a linear-chain conditional random field and replaced by typed placeholders.

Tokens are runs of letters, runs of digits and single signs. Their features are word shape, affixes, the word itself and the
kind of the blank-separated chunk they stand in, each taken at the places from -CONTEXT to CONTEXT around a token. As every
feature belongs to one token, a token type's scores are summed once per place; decoding then looks them up by number and runs
Viterbi over padded batches in numpy. Chunks met before keep their token numbers.

The field is trained on the driver from labelled/personal.txt (a small table of marked sentences) by stochastic gradient steps
in numpy, in a few seconds, and its weights (of fixed size) go to the workers with the task. Found spans pass an exact check:
an e-mail address has a sign or word for @, a phone number seven digits at least, and so on; blanks and punctuation at the
edges are trimmed.

Long texts are decoded in stretches of MAX_TOKENS that overlap by OVERLAP. Two stretches are joined at a token that both hold for
plain text and that is away from either edge, so no find is cut, whatever stands there; where the overlap has no such token the
text is decoded as one.

Defined results: null and empty texts have no finds and stay as they are; texts of any length are read whole; equal finds of a row
count once; repeated rows give one row per find.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("EMAIL", "PHONE", "ID", "ADDRESS", "NAME")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
CONTEXT = 4
MAX_TOKENS = 400
#: Tokens that neighbouring stretches share, and how many at an edge aren't trusted.
OVERLAP, EDGE = 96, 16
PLACEHOLDER = "[{}]"

_TOKEN = re.compile(r"[^\W\d_]+|\d+|\S")
_AT = re.compile(r"@|\(at\)|\[at\]|\{at\}", re.IGNORECASE)
_CHUNK = re.compile(r"\S+")


def shape(t: str) -> str:
    if t.isdigit():
        return f"d{min(len(t), 12)}"
    if not t[0].isalnum():
        return t[0]
    case = "X" if t.isupper() and len(t) > 1 else "x" if t.islower() else "Xx" if t[0].isupper() else "m"
    script = "l" if t[0] < "ɐ" else "c"
    return f"{case if len(t) > 1 else case + '1'}{script}"


def chunk_kind(chunk: str) -> str:
    if _AT.search(chunk):
        return "at"
    digits = sum(map(str.isdigit, chunk))
    if digits == 0:
        return "word" if chunk.isalpha() else "-" if "-" in chunk else "." if "." in chunk[:-1] else "other"
    return ("n" if digits * 2 > len(chunk) else "m") + ("+" if chunk[0] in "+(" else "") + (":" if "/" in chunk else "") + str(min(digits, 9) // 3)


def token_features(text: str, first: bool, kind: str) -> list[str]:
    low = text.lower()
    out = [f"s={shape(text)}", f"k={kind}", f"f={first}", f"sk={shape(text)}{first}{kind[:2]}"]
    if text[0].isalpha():
        out += [f"w={low}", f"e3={low[-3:]}", f"e2={low[-2:]}", f"b3={low[:3]}", f"e4={low[-4:]}"]
    elif text.isdigit():
        out.append(f"n={len(text)}")
    else:
        out.append(f"w={text}{first}")
    return out


def stretches(n: int) -> list[tuple[int, int]]:
    """(begin, end) of the stretches in which n tokens are decoded."""
    out = [(0, min(n, MAX_TOKENS))] if n else []
    while out and out[-1][1] < n:
        a = out[-1][1] - OVERLAP
        out.append((a, min(n, a + MAX_TOKENS)))
    return out


def joined(parts: list[tuple[int, list[int]]]) -> list[int] | None:
    """One path of those of the stretches, in order; None if two have no plain token in common."""
    path = list(parts[0][1])
    for a, other in parts[1:]:
        shared = len(path) - a
        both = [j for j in range(EDGE, shared - EDGE) if not path[a + j] and not other[j]]
        if not both:
            return None
        j = min(both, key=lambda x: abs(2 * x - shared))
        del path[a + j :]
        path += other[j:]
    return path


class Vocabulary:
    """Numbers of token types (token, whether it begins its chunk, kind of the chunk); chunks keep theirs."""

    def __init__(self) -> None:
        self.types: dict[tuple[str, bool, str], int] = {}
        self.chunks: dict[str, tuple[list[int], list[int], list[int]]] = {}

    def chunk(self, chunk: str) -> tuple[list[int], list[int], list[int]]:
        found = self.chunks.get(chunk)
        if found is None:
            kind = chunk_kind(chunk)
            numbers, begins, ends = [], [], []
            for m in _TOKEN.finditer(chunk):
                key = (m.group(), m.start() == 0, kind)
                numbers.append(self.types.setdefault(key, len(self.types)))
                begins.append(m.start())
                ends.append(m.end())
            found = self.chunks[chunk] = (numbers, begins, ends)
        return found

    def read(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Token numbers of a text with their first and last places."""
        numbers: list[int] = []
        begins: list[int] = []
        ends: list[int] = []
        get, add = self.chunks.get, self.chunk
        for m in _CHUNK.finditer(text):
            c = m.group()
            n, b, e = get(c) or add(c)
            at = m.start()
            numbers += n
            begins += [at + x for x in b]
            ends += [at + x for x in e]
        return numbers, begins, ends


def _padded(sequences: Sequence[Sequence[int]], fill: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.asarray([len(s) for s in sequences])
    out = np.full((len(sequences), int(lengths.max()) + 2 * CONTEXT), fill, np.int64)
    for i, s in enumerate(sequences):
        out[i, CONTEXT : CONTEXT + len(s)] = s
    return out, lengths


class Field:
    """Weights: a score per place, feature and label; transitions; the numbering of features."""

    def __init__(self, features: dict[str, int], weights: np.ndarray, transitions: np.ndarray):
        self.features, self.weights, self.transitions = features, weights, transitions
        self.clear()

    def clear(self) -> None:
        self.vocabulary = Vocabulary()
        self.scores = np.zeros((2 * CONTEXT + 1, 0, len(LABELS)), np.float32)

    def __getstate__(self):
        return self.features, self.weights, self.transitions

    def __setstate__(self, state):
        self.features, self.weights, self.transitions = state
        self.clear()

    def _extend(self) -> None:
        """Scores of the token types that are new since the last batch."""
        types = list(self.vocabulary.types)[self.scores.shape[1] :]
        if not types:
            return
        new = np.zeros((2 * CONTEXT + 1, len(types), len(LABELS)), np.float32)
        for i, t in enumerate(types):
            at = [k for f in token_features(*t) if (k := self.features.get(f)) is not None]
            if at:
                new[:, i] = self.weights[:, at].sum(axis=1)
        self.scores = np.concatenate([self.scores, new], axis=1)

    def decode(self, texts: Sequence[str | None]) -> list[list[tuple[int, int, str]]]:
        """(begin, end, kind) of the finds in each text."""
        if len(self.vocabulary.chunks) > 200_000 or len(self.vocabulary.types) > 200_000:
            self.clear()
        read = [self.vocabulary.read(t) if t else ([], [], []) for t in texts]
        pieces = [(i, a, z) for i, (n, _, _) in enumerate(read) for a, z in stretches(len(n))]
        self._extend()
        parts: list[list[tuple[int, list[int]]]] = [[] for _ in texts]
        order = sorted(range(len(pieces)), key=lambda k: pieces[k][2] - pieces[k][1])
        start = 0
        while start < len(order):
            last = pieces[order[min(len(order), start + 512) - 1]]
            group = [pieces[k] for k in order[start : start + max(16, min(512, 40_000 // max(1, last[2] - last[1])))]]
            start += len(group)
            for (i, a, _), path in zip(group, self._viterbi([read[i][0][a:z] for i, a, z in group])):
                parts[i].append((a, path))
        out: list[list[tuple[int, int, str]]] = []
        for t, (n, b, e), found in zip(texts, read, parts):
            path = joined(sorted(found)) if len(found) > 1 else found[0][1] if found else []
            if path is None:
                path = self._viterbi([n])[0]
            finds, i = [], 0
            while i < len(path):
                if path[i]:
                    kind, j = (path[i] - 1) // 2, i + 1
                    while j < len(path) and path[j] == 2 * kind + 2:
                        j += 1
                    if span := checked(t, b[i], e[j - 1], KINDS[kind]):
                        finds.append(span)
                    i = j
                else:
                    i += 1
            out.append(finds)
        return out

    def _viterbi(self, sequences: Sequence[Sequence[int]]) -> list[list[int]]:
        numbers, lengths = _padded(sequences, self.scores.shape[1])
        table = np.concatenate([self.scores, np.zeros((2 * CONTEXT + 1, 1, len(LABELS)), np.float32)], axis=1)
        width = int(lengths.max())
        emit = np.zeros((len(sequences), width, len(LABELS)), np.float32)
        for o in range(2 * CONTEXT + 1):
            emit += table[o][numbers[:, o : o + width]]
        trans = self.transitions.astype(np.float32)
        score = emit[:, 0] + trans[-1][: len(LABELS)]
        back = np.zeros((len(sequences), width, len(LABELS)), np.int8)
        step = trans[: len(LABELS)]
        final = np.zeros((len(sequences), len(LABELS)), np.float32)
        final[lengths == 1] = score[lengths == 1]
        for t in range(1, width):
            total = score[:, :, None] + step[None]
            best = total.argmax(axis=1)
            back[:, t] = best
            score = np.take_along_axis(total, best[:, None], axis=1)[:, 0] + emit[:, t]
            done = lengths == t + 1
            final[done] = score[done]
        paths = []
        last = final.argmax(axis=1)
        rows = np.arange(len(sequences))
        path = np.zeros((len(sequences), width), np.int64)
        current = last.copy()
        for t in range(width - 1, -1, -1):
            active = t < lengths
            path[active, t] = current[active]
            if t:
                move = active & (lengths > t)
                current[move] = back[rows[move], t, current[move]]
        for i, n in enumerate(lengths.tolist()):
            paths.append(path[i, :n].tolist())
        return paths


_PHONE_OK = re.compile(r"^[+\d(][\d\s()./+-]*\d$")
_DATE = re.compile(r"^(?:\d{4}-\d\d?-\d\d?|\d\d?[./-]\d\d?[./-]\d{2,4})$")


def checked(text: str, a: int, z: int, kind: str) -> tuple[int, int, str] | None:
    """The span trimmed and confirmed, or None."""
    left, right = " \t\n\r,;:.!?\"'«»“„”—–-", " \t\n\r,;:!?\"'«»“„”—–-"
    while a < z and text[a] in left:
        a += 1
    while z > a and text[z - 1] in right:
        z -= 1
    s = text[a:z]
    digits = sum(map(str.isdigit, s))
    if kind == "NAME":
        stop = re.search(r"(?<=\w\w)\.\s", s)
        if stop and " " in s[: stop.start()]:  # a full stop after a whole word ends the name
            s, z = s[: stop.start()], a + stop.start()
        initial = re.search(r"(?:^|[\s.])\w\.$", s) is not None
        if s.endswith(".") and not initial:
            s, z = s[:-1].rstrip(), z - 1
        ok = digits == 0 and len(s) > 2 and (" " in s or "." in s)
    else:
        while s.endswith("."):
            s, z = s[:-1], z - 1
        ok = {"EMAIL": (_AT.search(s) is not None or re.search(r"\s(?:at|собака|ät|æt)\s", s, re.IGNORECASE) is not None) and ("." in s or "dot" in s.lower() or "точка" in s.lower() or "punkt" in s.lower()), "PHONE": digits >= 7 and _PHONE_OK.match(s) is not None and _DATE.match(s) is None, "ID": digits >= 5 and _DATE.match(s) is None, "ADDRESS": digits >= 1 and any(c.isalpha() for c in s)}[kind]
    return (a, z, kind) if ok and s else None


_MARK = re.compile(r"⟦(\w+)\|(.*?)⟧")


def marked(line: str) -> tuple[str, list[tuple[int, int, str]]]:
    """Text and spans of a line of the labelled table."""
    out, spans, at = "", [], 0
    for m in _MARK.finditer(line):
        out += line[at : m.start()]
        spans.append((len(out), len(out) + len(m.group(2)), m.group(1)))
        out += m.group(2)
        at = m.end()
    return out + line[at:], spans


def labelled_sentences() -> list[tuple[str, list[tuple[int, int, str]]]]:
    text = resources.files("tamarack.llm").joinpath("labelled/personal.txt").read_text("utf-8")
    return [marked(line) for line in text.split("\n") if line.strip()]


def train(table: Sequence[tuple[str, list[tuple[int, int, str]]]], epochs: int = 16, batch: int = 128, rate: float = 0.08, decay: float = 2e-4, seed: int = 1, least_word: int = 15, least_affix: int = 8) -> Field:
    """Maximum likelihood by Adam steps over batches of sentences."""
    vocabulary = Vocabulary()
    data = []
    for text, spans in table:
        n, b, e = vocabulary.read(text)
        if not n:
            continue
        y = [0] * len(n)
        for i in range(len(n)):
            for p, q, kind in spans:
                if b[i] >= p and e[i] <= q:
                    y[i] = 1 + 2 * KINDS.index(kind) + (0 if b[i] == p or not (i and b[i - 1] >= p) else 1)
        data.append((n, y))
    counts: dict[str, int] = {}
    per_type = [token_features(*t) for t in vocabulary.types]
    for fs in per_type:
        for f in fs:
            counts[f] = counts.get(f, 0) + 1
    # the words of a small table would be learned by heart: those of a single type are left to shape and affixes
    used = np.zeros(len(per_type), np.int64)
    for n, _ in data:
        np.add.at(used, n, 1)
    weight: dict[str, int] = {}
    for t, fs in enumerate(per_type):
        for f in fs:
            weight[f] = weight.get(f, 0) + int(used[t])
    features = {f: i for i, f in enumerate(sorted(f for f, c in weight.items() if c >= (least_word if f.startswith("w=") and f[2].isalpha() else least_affix if f[:2] in ("e4", "b3", "e3") else 3)))}
    longest = max(map(len, per_type))
    nothing = len(features)
    at = np.full((len(per_type) + 1, longest), nothing)
    for t, fs in enumerate(per_type):
        ks = [features[f] for f in fs if f in features]
        at[t, : len(ks)] = ks
    places, size = 2 * CONTEXT + 1, len(LABELS)
    w = np.zeros((places, nothing + 1, size))
    trans = np.zeros((size + 1, size))
    forbidden = np.zeros((size + 1, size), bool)
    for j in range(2, size, 2):  # I- follows only B- or I- of its kind
        forbidden[:, j] = True
        forbidden[[j - 1, j], j] = False
    trans[forbidden] = -1e4
    m1, m2, t1, t2 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)
    rng = np.random.default_rng(seed)
    data.sort(key=lambda d: len(d[0]))
    groups = [data[i : i + batch] for i in range(0, len(data), batch)]
    step = 0
    for epoch in range(epochs):
        for g in rng.permutation(len(groups)):
            numbers, lengths = _padded([d[0] for d in groups[g]], len(per_type))
            n, width = len(lengths), int(lengths.max())
            y = np.zeros((n, width), np.int64)
            for i, d in enumerate(groups[g]):
                y[i, : len(d[1])] = d[1]
            real = np.arange(width)[None] < lengths[:, None]
            present, inverse = np.unique(numbers, return_inverse=True)
            inverse = inverse.reshape(numbers.shape)
            fs = at[present]
            table_ = w[:, fs].sum(axis=2)
            emit = np.zeros((n, width, size))
            for o in range(places):
                emit += table_[o][inverse[:, o : o + width]]
            # forward and backward in probabilities, scaled at each place
            e = np.exp(emit - emit.max(axis=2, keepdims=True))
            tr = np.exp(trans)
            alpha = np.zeros((n, width, size))
            beta = np.ones((n, width, size))
            alpha[:, 0] = e[:, 0] * tr[-1]
            alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
            for t in range(1, width):
                a = (alpha[:, t - 1] @ tr[:size]) * e[:, t]
                alpha[:, t] = a / a.sum(axis=1, keepdims=True)
            for t in range(width - 2, -1, -1):
                b = (beta[:, t + 1] * e[:, t + 1]) @ tr[:size].T
                b /= b.sum(axis=1, keepdims=True)
                beta[:, t] = np.where(real[:, t + 1, None], b, 1.0)
            gamma = alpha * beta
            gamma /= gamma.sum(axis=2, keepdims=True)
            delta = -gamma
            np.put_along_axis(delta, y[:, :, None], np.take_along_axis(delta, y[:, :, None], 2) + 1, 2)
            delta *= real[:, :, None]
            grad = np.zeros_like(w)
            for o in range(places):
                per = np.zeros((len(present), size))
                flat = inverse[:, o : o + width].ravel()
                for c in range(size):
                    per[:, c] = np.bincount(flat, delta[:, :, c].ravel(), minlength=len(present))
                for c in range(size):
                    grad[o, :, c] = np.bincount(fs.ravel(), np.repeat(per[:, c], longest), minlength=nothing + 1)
            tgrad = np.zeros_like(trans)
            for t in range(1, width):
                on = real[:, t]
                if not on.any():
                    break
                pair = alpha[on, t - 1][:, :, None] * tr[None, :size] * (e[on, t] * beta[on, t])[:, None]
                pair /= pair.sum(axis=(1, 2), keepdims=True)
                tgrad[:size] -= pair.sum(axis=0)
                np.add.at(tgrad, (y[on, t - 1], y[on, t]), 1)
            np.add.at(tgrad, (size, y[:, 0]), 1)
            tgrad[size] -= gamma[:, 0].sum(axis=0)
            step += 1
            lr = rate * (1 - epoch / (epochs + 1))
            for p, gr, a1, a2, reg in ((w, grad / n, m1, m2, decay), (trans, tgrad / n, t1, t2, decay)):
                gr = gr - reg * np.where(np.abs(p) < 1e3, p, 0)
                a1 *= 0.9
                a1 += 0.1 * gr
                a2 *= 0.99
                a2 += 0.01 * gr * gr
                p += lr * (a1 / (1 - 0.9**step)) / (np.sqrt(a2 / (1 - 0.99**step)) + 1e-6)
            w[:, nothing] = 0
            trans[forbidden] = -1e4
    return Field(features, w[:, :nothing].astype(np.float32), trans)


@functools.lru_cache(maxsize=1)
def field() -> Field:
    return train(labelled_sentences())


def redacted(text: str, spans: Sequence[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, z, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], PLACEHOLDER.format(kind)]
            at = z
    return "".join(out) + text[at:]


def find(rows: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """The kept columns with kind, surface and begin (in code points) of every find."""
    return _mapped(rows, text, keep, None)


def redact(rows: DataFrame, text: str, keep: Sequence[str], out: str = "redacted") -> DataFrame:
    """The kept columns with the text, each find replaced by its placeholder."""
    return _mapped(rows, text, keep, out)


def _mapped(rows: DataFrame, text: str, keep: Sequence[str], out: str | None) -> DataFrame:
    keep = [c for c in keep if c != out]
    source = rows.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    sent = rows.sparkSession.sparkContext.broadcast(field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for whole in batches:
            for s in range(0, whole.num_rows, 2000):
                b = whole.slice(s, 2000)
                texts = b.column(len(keep)).to_pylist()
                found = own.decode(texts)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array([t if not f else redacted(t, f) for t, f in zip(texts, found)], pa.string())], names=[*keep, out])
                    continue
                row = [i for i, f in enumerate(found) for _ in f]
                take = pa.array(row, pa.int64())
                flat = [x for f in found for x in f]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i).take(take) for i in range(len(keep))), pa.array([k for _, _, k in flat], pa.string()), pa.array([texts[i][a:z] for i, (a, z, _) in zip(row, flat)], pa.string()), pa.array([a for a, _, _ in flat], pa.int32())],
                    names=[*keep, "kind", "surface", "begin"],
                )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)]]
    return source.mapInArrow(run, ", ".join(fields + ([f"`{out}` string"] if out is not None else ["kind string", "surface string", "begin int"])))
