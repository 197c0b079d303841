"""Languages of documents and of their parts (ru, uk, be, de, en) with a confidence.

Word-first backoff. A word that the training table knows is scored by its log frequency per language; an unseen one by its
character n-grams, the longest first: if none of its 5-grams (with word edges) is known, the 4-grams decide, and so on down
to single letters. A word's scores are normed over the languages, so that a rare word can't outweigh a sentence.

The model is trained where it is used, from labelled/languages.tsv (a small table of labelled sentences); Slavic sentences
also enter transliterated, so that the language is that of the words, whatever the script. It has a fixed size.

Texts are cut into sentences; quotations and asides in brackets of a few words are left out, and words in a script other than
that of most of the sentence (names, terms) don't count. A language is in a text if a whole sentence is (at least MIN_WORDS
words, a clear lead, ending like a sentence); in texts without such a sentence the words of the whole text decide.
Confidence is the share of the language in the text's evidence, from the normed scores.

A worker scores a word once, and a sentence once whatever digits it holds; texts are summed up with numpy, a batch at a time. The
plan is a narrow map.

Parameters that act by size, stated as such: a sentence needs MIN_WORDS words to be a language's evidence, and an aside is left
out if it has up to 60 characters. A longer aside counts like the sentence around it.

Defined results: a null, empty or wordless text has no language (an empty list); repeated rows repeat; decomposed letters,
capitals, soft hyphens and zero-width characters don't matter; any length is read whole.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import unicodedata
from collections.abc import Iterator, Sequence
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("ru", "uk", "be", "de", "en")
LONGEST_GRAM = 5
MIN_WORDS = 3
#: Lead of a sentence's best language over the second, in summed log scores.
MIN_LEAD = 3.0
FLOOR = -6.0
#: Words and sentences that a worker keeps with their scores before it starts anew, between two batches.
KEEP_WORDS, KEEP_SENTENCES = 400_000, 200_000

_WORD = re.compile(r"[^\W\d_]+(?:['’ʼ][^\W\d_]+)*")
_DROP = re.compile("[­​-‏‪-‮⁠-⁤﻿͏᠎]")
#: Asides that say nothing about the language of a sentence: up to six words in quotes or brackets.
_ASIDE = re.compile(r"«[^«»\n]{0,60}»|“[^“”\n]{0,60}”|„[^„“”\n]{0,60}[“”]|\"[^\"\n]{0,60}\"|\([^()\n]{0,60}\)|\[[^\[\]\n]{0,60}\]")
_DIGITS = re.compile(r"\d+")
_URL = re.compile(r"\S+(?:://|@)\S*|www\.\S+")
_ENDING = frozenset(".!?…")
_MONTH = re.compile(r"(?:Jänner|Januar|Februar|Feber|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\b")
_DAY = re.compile(r"(?:^|[^\d/.])\d{1,2}\.$")
_CLOSING = " \t\u00a0»”\")]"

#: Transliterations (fixed values): one common Latin spelling for each letter, with its variants.
_LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "ґ": "g", "д": "d", "е": "e", "ё": "yo", "є": "ye", "ж": "zh", "з": "z", "и": "i", "і": "i", "ї": "yi", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o",
    "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ў": "w", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya", "'": "", "’": "",
}
_VARIANTS = ({}, {"х": "kh", "щ": "shch", "ё": "e", "и": "i"}, {"й": "j", "ю": "ju", "я": "ja", "ё": "jo", "х": "kh", "ц": "c"})
_UK = {"и": "y", "г": "h", "х": "kh", "щ": "shch"}


def latinise(text: str, table: dict[str, str]) -> str:
    return "".join(table.get(c, c) for c in text)


def normal(text: str) -> str:
    return _DROP.sub("", text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text))


def prepared(text: str) -> str:
    """Text as it is cut into sentences: normal form, without addresses."""
    return without_addresses(normal(text))


def without_addresses(text: str) -> str:
    return _URL.sub(" ", text) if "://" in text or "@" in text or "www." in text else text


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def is_latin(word: str) -> bool:
    return word[0] < "ɐ"


@functools.lru_cache(maxsize=1)
def training_table() -> list[tuple[str, str]]:
    text = resources.files("tamarack.llm").joinpath("labelled/languages.tsv").read_text("utf-8")
    return [tuple(line.split("\t", 1)) for line in text.splitlines() if "\t" in line]  # type: ignore[misc]


class LanguageModel:
    """Log scores per language of words, normed to sum to one as probabilities."""

    def __init__(self, table: Sequence[tuple[str, str]], languages: Sequence[str] = LANGUAGES):
        self.languages = tuple(languages)
        at = {x: i for i, x in enumerate(self.languages)}
        # each word of a language is taken apart once, with the weight of all its places
        found: list[dict[str, float]] = [{} for _ in self.languages]

        def add(language: str, text: str, weight: float) -> None:
            mine = found[at[language]]
            for w in words(text):
                mine[w] = mine.get(w, 0.0) + weight

        for language, text in table:
            text = _ASIDE.sub(" ", normal(text)).lower()
            add(language, text, 1.0)
            if language in ("ru", "uk", "be"):
                for v in _VARIANTS:
                    add(language, latinise(text, _LATIN | (_UK if language == "uk" else {}) | v), 0.5 if language == "ru" else 0.25)
        counts: list[dict[str, list[float]]] = [{} for _ in range(LONGEST_GRAM + 1)]  # 0: whole words
        for k, mine in enumerate(found):
            for w, n in mine.items():
                for size in range(LONGEST_GRAM + 1):
                    into = counts[size]
                    for g in [w] if size == 0 else grams(w, size):
                        row = into.get(g)
                        if row is None:
                            row = into[g] = [0.0] * len(self.languages)
                        row[k] += n
        self.tables, self.letters = [], {}
        for size, by in enumerate(counts):
            rows = np.array(list(by.values()), dtype=float).reshape(-1, len(self.languages))
            alpha = 0.05 if size == 0 else 0.2
            self.tables.append(dict(zip(by, np.log((rows + alpha) / (rows.sum(axis=0) + 1.0)))))
            if size == 1:
                self.letters = {g: np.where(row < 1e-9, -3.0, 0.0) for g, row in zip(by, rows) if len(g) == 1 and row.min() < 1e-9 and row.sum() > 3}
        self.clear()

    def clear(self) -> None:
        """Forgets the words and sentences met. Only ever called between batches, as a batch holds their numbers."""
        self.known: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.met: dict[str, int] = {}
        self.summed = np.zeros((1024, len(self.languages) + 2))

    def score(self, word: str) -> np.ndarray:
        """Normed log scores of a word: as a whole if it is known, else by its longest known n-grams."""
        out = self.tables[0].get(word)
        if out is None:
            for n in range(LONGEST_GRAM, 0, -1):
                found = [t for g in grams(word, n) if (t := self.tables[n].get(g)) is not None]
                if found:
                    out = np.mean(found, axis=0) * min(3.0, math.sqrt(len(found)))
                    break
            else:
                out = np.zeros(len(self.languages))
            for letter in set(word):  # a letter that a language doesn't have rules it out
                row = self.letters.get(letter)
                if row is not None:
                    out = out + row
        top = out.max()
        return np.maximum(out - (top + math.log(np.exp(out - top).sum())), FLOOR)

    def number(self, word: str) -> int:
        k = self.known.get(word)
        if k is None:
            k = self.known[word] = len(self.rows)
            self.rows.append(np.append(self.score(word), [1.0 if is_latin(word) else 0.0]))
        return k

    def sentences(self, sentences: Sequence[str]) -> np.ndarray:
        """One row per sentence: summed scores, the number of words counted (those of its main script), and its share of Latin words.

        Sentences that differ in their digits only are scored once.
        """
        if len(self.known) > KEEP_WORDS or len(self.met) > KEEP_SENTENCES:
            self.clear()
        get = self.met.get
        at = [get(s, -1) for s in sentences]
        if -1 in at:
            first = len(self.met)
            for i, k in enumerate(at):
                if k < 0:
                    at[i] = self.met.setdefault(sentences[i], len(self.met))
            new = list(itertools.islice(self.met, first, None))
            while len(self.summed) < len(self.met):
                self.summed = np.concatenate([self.summed, np.zeros_like(self.summed)])
            self.summed[first : len(self.met)] = self._scored(new)
        return self.summed[np.asarray(at, dtype=np.int64)]

    def _scored(self, sentences: Sequence[str]) -> np.ndarray:
        found = [_WORD.findall(s) for s in sentences]
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        get, number = self.known.get, self.number
        flat = [k if (k := get(w)) is not None else number(w) for f in found for w in f]
        out = np.zeros((len(found), len(self.languages) + 2))
        if not flat:
            return out
        table = np.asarray(self.rows)
        full = np.flatnonzero(lengths)
        starts = (np.cumsum(lengths) - lengths)[full]
        per_word = table[np.asarray(flat)]
        latin = per_word[:, -1]
        share = np.add.reduceat(latin, starts) / lengths[full]
        main = (np.repeat(share, lengths[full]) > 0.6) == (latin > 0.5)
        out[full, :-2] = np.add.reduceat(per_word[:, :-1] * main[:, None], starts, axis=0)
        out[full, -2] = np.add.reduceat(main.astype(float), starts)
        out[full, -1] = share
        return out


@functools.lru_cache(maxsize=1)
def model() -> LanguageModel:
    return LanguageModel(training_table())


def split_sentences(text: str) -> list[str]:
    """Lines, cut after the ends of sentences; a full stop after the number of a day or an item ends none."""
    for end in (". ", "! ", "? ", "… ", ".» ", ".) ", ".” ", "!» ", "?» "):
        text = text.replace(end, end[:-1] + "\n")
    out: list[str] = []
    for s in text.split("\n"):
        if not s or s.isspace():
            continue
        if out and out[-1][-2:-1].isdigit() and out[-1][-1] == "." and _DAY.search(out[-1]) and (_MONTH.match(s) or s[0].islower()):
            out[-1] += " " + s
        else:
            out.append(s)
    return out


def probabilities(score: np.ndarray) -> np.ndarray:
    e = np.exp(np.clip(score - score.max(axis=-1, keepdims=True), -50, 0))
    return e / e.sum(axis=-1, keepdims=True)


class Detected:
    """What a batch of texts says: evidence and certainty per text and language, and the sentences behind it."""

    def __init__(self, texts: Sequence[Sequence[str]], own: LanguageModel):
        """texts: the sentences of each text, as split_sentences(prepared(text)) gives them."""
        self.names = own.languages
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.bounds = np.concatenate(([0], np.cumsum(sizes)))
        n, k = int(self.bounds[-1]), len(self.names)
        whole = np.fromiter((s.rstrip(_CLOSING)[-1:] in _ENDING for t in texts for s in t), dtype=bool, count=n)
        # asides don't reach over line ends, so all sentences are stripped of them at once
        rows = own.sentences(_DIGITS.sub("0", _ASIDE.sub(" ", "\n".join("\n".join(t) for t in texts if t))).lower().split("\n")) if n else np.zeros((0, k + 2))
        self.score, counted, self.latin = rows[:, :k], rows[:, -2], rows[:, -1]
        text_of = np.repeat(np.arange(len(texts)), sizes)
        order = np.sort(self.score, axis=1)
        self.best = self.score.argmax(axis=1) if n else np.zeros(0, np.int64)
        self.clear = (counted >= MIN_WORDS) & (order[:, -1] - order[:, -2] >= MIN_LEAD)
        self.sure = probabilities(self.score).max(axis=1) if n else np.zeros(0)
        use = np.flatnonzero(self.clear & whole)
        self.words = np.bincount(text_of, counted, minlength=len(texts))
        cell = text_of[use] * k + self.best[use]
        weight = np.bincount(cell, counted[use] * self.sure[use], minlength=len(texts) * k).reshape(-1, k)
        certain = np.zeros(len(texts) * k)
        np.maximum.at(certain, cell, self.sure[use])
        self.by_sentence = weight.sum(axis=1) > 0
        # what isn't a sentence of its own still counts as evidence for the languages that are there
        share = weight / np.where(self.by_sentence, weight.sum(axis=1), 1.0)[:, None]
        self.confidence = certain.reshape(-1, k) * (0.5 + 0.5 * share)
        total = np.stack([np.bincount(text_of, self.score[:, j], minlength=len(texts)) for j in range(k)], axis=1)
        single = ~self.by_sentence
        self.weight = np.where(single[:, None], 0.0, weight)
        top = total.argmax(axis=1)
        mass = probabilities(total).max(axis=1) if len(texts) else np.zeros(0)
        alone = np.flatnonzero(single & (self.words > 0))
        self.weight[alone, top[alone]] = 1.0
        self.confidence[alone, top[alone]] = mass[alone]

    def script(self, i: int) -> int:
        """1 for a text nearly all of whose words are Latin, -1 for one nearly without any, 0 between."""
        share = self.latin[self.bounds[i] : self.bounds[i + 1]].mean() if self.words[i] else 0.5
        return 1 if share > 0.8 else -1 if share < 0.2 else 0

    def languages(self, i: int) -> list[tuple[str, float]]:
        """Languages of text i with confidences, most evidence first."""
        w = self.weight[i]
        return [(self.names[k], float(self.confidence[i, k])) for k in np.argsort(-w, kind="stable") if w[k] > 0]

    def spans(self, i: int, languages: Sequence[tuple[str, float]]) -> list[tuple[int, str, float]]:
        """(number, language, confidence) of the sentences of text i."""
        if not languages:
            return []
        there, last, out = {x for x, _ in languages}, languages[0][0], []
        for j in range(self.bounds[i], self.bounds[i + 1]):
            if self.clear[j] and self.names[self.best[j]] in there:
                last = self.names[self.best[j]]
            out.append((int(j - self.bounds[i]), last, float(self.sure[j])))
        return out


def detect(texts: Sequence[str | None], own: LanguageModel | None = None) -> list[tuple[list[tuple[str, float]], list[tuple[int, str, float]]]]:
    """For each text its languages with confidences, most evidence first, and its sentences' (number, language, confidence)."""
    found = Detected([split_sentences(prepared(t)) if t else [] for t in texts], own or model())
    return [(languages := found.languages(i), found.spans(i, languages)) for i in range(len(texts))]


def identify(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Adds languages: array of (lang, confidence), the one with most evidence first."""
    return _mapped(docs, text, keep, segments=False)


def segments(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Stretches of sentences in one language: kept columns, segment_no, lang, confidence, piece."""
    return _mapped(docs, text, keep, segments=True)


def _mapped(docs: DataFrame, text: str, keep: Sequence[str], segments: bool) -> DataFrame:
    keep = list(keep)
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    pairs = pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64())]))

    def step(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(len(keep)).to_pylist()
        if not segments:
            seen = Detected([split_sentences(prepared(t)) if t else [] for t in texts], model())
            column = pa.array([[{"lang": x, "confidence": p} for x, p in seen.languages(i)] for i in range(len(texts))], type=pairs)
            return pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), column], names=[*keep, "languages"])
        found = detect(texts)
        row, no, lang, conf, piece = [], [], [], [], []
        for r, (t, (_, spans)) in enumerate(zip(texts, found)):
            if not spans:
                continue
            parts = split_sentences(prepared(t))
            last = None
            for i, x, p in spans:
                if x == last:
                    piece[-1] += "\n" + parts[i]
                    conf[-1] = max(conf[-1], p)
                else:
                    row.append(r)
                    no.append(0 if last is None else no[-1] + 1)
                    lang.append(x)
                    conf.append(p)
                    piece.append(parts[i])
                last = x
        take = pa.array(row, pa.int64())
        return pa.RecordBatch.from_arrays(
            [*(b.column(i).take(take) for i in range(len(keep))), pa.array(no, pa.int32()), pa.array(lang, pa.string()), pa.array(conf, pa.float64()), pa.array(piece, pa.string())],
            names=[*keep, "segment_no", "lang", "confidence", "piece"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, max(1, b.num_rows), 2000):
                yield step(b.slice(i, 2000))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)]]
    more = ["segment_no int", "lang string", "confidence double", "piece string"] if segments else ["languages array<struct<lang:string,confidence:double>>"]
    return source.mapInArrow(run, ", ".join(fields + more))


#: Spellings of the five languages: codes and names (fixed values).
SPELLINGS = {
    "ru": ("ru", "rus", "russian", "русский", "russisch", "російська", "руская", "russ"),
    "uk": ("uk", "ukr", "ua", "ukrainian", "українська", "украинский", "ukrainisch", "украінская"),
    "be": ("be", "bel", "by", "belarusian", "belarussian", "беларуская", "белорусский", "білоруська", "belarussisch", "belarusisch"),
    "de": ("de", "deu", "ger", "german", "deutsch", "немецкий", "німецька", "нямецкая"),
    "en": ("en", "eng", "english", "englisch", "английский", "англійська", "англійская"),
}


def label_language(label: Column) -> Column:
    """Language that a label names, whatever its spelling; null for none of the five."""
    name = F.lower(F.regexp_replace(F.coalesce(label, F.lit("")), r"[^\p{L}_-]+", ""))
    first = F.regexp_extract(name, r"^(\p{L}+)", 1)
    out = F.lit(None).cast("string")
    for code, names in SPELLINGS.items():
        out = F.when(first.isin(*names), F.lit(code)).otherwise(out)
    return out


def mislabelled(docs: DataFrame, text: str = "text", label: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang, confidence) of documents whose label is missing or wrong, or that are in several languages."""
    found = identify(docs, text, keep=(doc_id, label))
    languages = F.transform("languages", lambda x: x["lang"])
    right = F.coalesce(F.array_contains(languages, label_language(F.col(f"`{label}`"))), F.lit(False))
    case = (F.size("languages") > 1) | ((F.size("languages") == 1) & ~right)
    return found.where(case).select(F.col(f"`{doc_id}`").alias("doc_id"), F.explode("languages").alias("__l")).select("doc_id", "__l.lang", "__l.confidence")
