"""Main body of web pages without their boilerplate.

A page is a flat list of text blocks, here its lines. Each block is described by its word count, link density (the share of its
words that stand in link-like parts: menu items, crumbs, teasers), punctuation, site name and a few stems of furniture
phrases, and by the same of its neighbours. A decision tree, grown in numpy from labelled/pages.tsv and pages_by_hand.tsv (small
tables of pages with a label for each line; those by hand are of other sites and wordings), tells main body from furniture. Lines
of all lengths are described alike. The tree is trained where it is used and has a fixed size.

The description of a line without its neighbours is kept for lines met again; the tree is applied to whole batches. The plan is
a narrow map over the pages plus a broadcast of the register of sites.

Defined results: blank lines have no label and stay between kept lines; null or empty contents have no lines; lines are split
at "\\n" alone; repeated rows repeat; very long pages are read whole; extra columns are carried by name only.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def _by_letter(pattern: str) -> re.Pattern:
    """The same pattern with its alternatives tried by their first letter."""
    letters: dict[str, list[str]] = {}
    rest: list[str] = []
    for branch in re.split(r"\|(?![^()]*\))", pattern):
        (letters.setdefault(branch[0], []) if branch[0].isalpha() and branch[1:2] not in ("?", "*") else rest).append(branch)
    return re.compile("|".join([*rest, *(f"{k}(?:{'|'.join(x[1:] for x in v)})" for k, v in letters.items())]))


_ZERO = re.compile("[​-‏⁠﻿­]")
_SPACE = re.compile(r"\s+")
_EDGE = " \t|»«>›•→*◦▪·‹<"
_NAME = re.compile(r"[^\W_]+(?:[-.][^\W_]+)+")
_DATE_END = re.compile(r"(?:\d{1,2}[./]\d{1,2}[./]\d{2,4}|\d{4}-\d\d-\d\d|\b\d{1,2}\.? \w+ \d{4}|\d+(?:[.,]\d+)? ?\w{0,12})\W*$")
#: Stems of what furniture speaks of.
_STEMS = _by_letter(
    r"cookie|куки|©|copyright|all rights|rechte vorbehalten|права защищ|права захищ|правы аба|newsletter|рассылк|розсилк|рассылк|subscrib|abonnier|подпис|підпис|"
    r"\bshare\b|\bteilen\b|поделит|поділит|weiterempf|empfehl|friend|freund|знаком|другу|другов|link kop|copy link|ссылк|посилан|\bprint\b|druck|распечат|роздрук|печат|друк|"
    r"privacy|datenschutz|приватн|конфиденц|конфіденц|imprint|impressum|sitemap|seitenplan|карта сайт|мапа сайт|выходные данные|accessib|barrierefrei|доступн|feedback|обратная связь|зворотн|"
    r"\bmenu\b|\bmenü\b|меню|navig|разделы|розділи|sections|bereiche|search|suche|поиск|пошук|log ?in|anmelden|войти|увійти|вход в кабинет|skip to|jump to|springen|перейти|к содержан|до вмісту|"
    r"choose another|another language|andere sprache|другой язык|іншу мову|іншую мову|language of|sprache der|язык страниц|мова сторін|"
    r"you are here|sie sind hier|вы здесь|ви тут|back to top|nach oben|наверх|догори|уверх|↑|follow|folgen|следите|стежте|social|соцсет|социальн|соціальн|"
    r"editor|redaktion|редакци|редакці|author|autor|автор|news desk|nachrichtendienst|служба новост|служба новин|stand \d|updated|обновлен|оновлен|aktualis|views|aufrufe|просмотр|перегляд|reading time|minute read|lesezeit|время чтения|час читання|advice team|"
    r"warranty|gewähr|garantie|гаранти|гаранті|liable|haftet|liability|не отвечает|не відповідає|reuse|nachdruck|перепечат|передрук|without consent|согласия|згод|pictures|bilder|изображен|зображен|світлин|фото|archive|archiv|архив|архів|"
    r"version|версия|версія|service line|servicelinie|hotline|телефонная линия|лінія|statistic|statistik|статистик|accept all|alle annehmen|принять все|прийняти всі|visits|besuche|посещен|відвідуван|settings|einstellungen|настройк|налаштуван|agree|einverstanden|соглас|згоден|browser|браузер"
)
_RELATED = _by_letter(
    r"you (?:may|might) also|also (?:like|interesting)|related|similar|more topics|further topics|most read|popular|trending|recommended|read (?:also|more|next)|das könnte|auch interessieren|weitere themen|verwandte|ähnliche|meistgelesen|beliebt|lesen sie auch|"
    r"читайте|вас также|вас может|похожие|схожие|связанные|популярн|самое читаем|ещё по теме|другие темы|смежные|вас також|вас може|схожі|суміжні|пов'язані|найпопулярн|найчитан|падобныя|чытайце|папулярн"
)
_TEASER = _by_letter(
    r"\bvideo\b|видео|відео|calendar|kalender|календар|open day|offenen tür|открытых двер|відкритих двер|\btest\b|тест|\bquiz\b|jobs|вакан|offers|angebote|предложен|пропозиц|rooms? in|zimmer in|комнаты в|кімнати в|how i |so schaffte|как я |як я |\bnews\b|neues aus|новости|новини|навіны|story|история|історія"
)
OWN = ("words", "chars", "sentence", "separators", "row", "heading", "dash", "bullet", "stems", "related", "teaser", "capitals", "digits", "dated", "link_density", "address", "comma_words")
AROUND = ("site", "place", "blank_before", "blank_after", "since_related")


_UPPER, _DIGIT = re.compile(r"[A-ZÀ-ÖØ-ÞЀ-Я]"), re.compile(r"\d")
_COUNTER = re.compile(r" ?\(\d+\)$")


def clean(line: str) -> str:
    return _COUNTER.sub("", " ".join(_ZERO.sub("", line).split()))


def describe(line: str) -> tuple:
    """Features of a cleaned line that don't depend on its page."""
    core = line.strip(_EDGE)
    n = core.count(" ") + 1 if core else 0
    low = core.lower()
    pipes = line.count("|")
    row = line.startswith("|") and pipes >= 3
    separators = 0 if row else core.count("|") + core.count("·") + core.count("▾") + core.count(" / ") + core.count("›") + core.count(" > ") + core.count("] [")
    bullet = line[:1] in "•→»›◦▪≡"
    linked = n if bullet or separators >= 2 or core.startswith("[") else min(n, separators * 2)
    linked = n if "](" in core or "://" in core or "www." in core else linked
    return (
        n,
        len(core),
        core[-1:] in ".!?…:",
        separators,
        row,
        line.startswith("#"),
        line.startswith(("- ", "– ")),
        bullet,
        min(3, len(_STEMS.findall(low))),
        _RELATED.search(low) is not None,
        _TEASER.search(low) is not None,
        len(_UPPER.findall(core)) / (len(core) or 1),
        len(_DIGIT.findall(core)) / (len(core) or 1),
        _DATE_END.search(core) is not None,
        linked / n if n else 0.0,
        core.startswith("©"),
        core.count(","),
    )


def site_names(site: str | None, lines: Sequence[str]) -> list[str]:
    """Names by which a page speaks of its site: the label of its host, else the compound name it uses most."""
    if site:
        label = site.split(".")[0].lower()
        return [label] if len(label) > 2 else [site.lower()]
    found = Counter(x for line in lines for x in {m.lower().split(".")[0] for m in _NAME.findall(line)} if "-" in x and not any(c.isdigit() for c in x))
    top = found.most_common(1)
    return [top[0][0]] if top and top[0][1] >= 2 else []


def features(pages: Sequence[tuple[str | None, str | None]], met: dict[str, tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row per line that isn't blank, over all pages; with the page and line numbers. met keeps what lines look like."""
    rows, page_of, line_of, around = [], [], [], []
    if len(met) > 300_000:
        met.clear()
    edges = []
    for p, (content, site) in enumerate(pages):
        if not content:
            continue
        cleaned = [clean(x) for x in content.split("\n")]
        names = site_names(site, cleaned)
        total = len(cleaned)
        since, before_blank = 99, True
        first = True
        for i, x in enumerate(cleaned):
            if not x:
                before_blank = True
                continue
            d = met.get(x)
            if d is None:
                d = met[x] = describe(x)
            low = x.lower()
            if d[9] and d[0] <= 9:
                since = 0
            elif since < 99:
                since += 1
                if d[5] or d[4] or d[6] or (d[2] and d[0] > 9):
                    since = 99
            around.append((any(nm in low for nm in names), i / total, before_blank, i + 1 >= total or not cleaned[i + 1], min(since, 15)))
            rows.append(d)
            page_of.append(p)
            line_of.append(i)
            edges.append(first)
            first = before_blank = False
    if not rows:
        return np.zeros((0, 1)), np.zeros(0, int), np.zeros(0, int)
    own = np.asarray(rows, dtype=np.float32)
    ring = np.hstack([own, np.asarray(around, dtype=np.float32)])
    start = np.asarray(edges)
    last = np.append(start[1:], True)
    nothing = np.full((1, ring.shape[1]), -1, np.float32)
    before, after = np.vstack([nothing, ring[:-1]]), np.vstack([ring[1:], nothing])
    before[start], after[last] = -1, -1
    two = np.vstack([nothing, before[:-1]])
    two[start] = -1
    beyond = np.vstack([after[1:], nothing])
    beyond[last] = -1
    near = [OWN.index(x) for x in ("words", "sentence", "separators", "row", "heading", "dash", "bullet", "stems", "related", "teaser", "link_density")] + [len(OWN)]
    return np.hstack([ring, before[:, near], after[:, near], two[:, near], beyond[:, near]]), np.asarray(page_of), np.asarray(line_of)


class Tree:
    """Binary decision tree (Gini), grown in numpy."""

    def __init__(self, depth: int = 18, least: int = 4):
        self.depth, self.least = depth, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tree:
        self.feature, self.cut, self.left, self.right, self.value = [], [], [], [], []
        self._grow(x, y.astype(float), self.depth)
        self.arrays = [np.asarray(a) for a in (self.feature, self.cut, self.left, self.right, self.value)]
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        at = len(self.feature)
        for column, v in zip((self.feature, self.cut, self.left, self.right, self.value), (-1, 0.0, at, at, y.mean())):
            column.append(v)
        if depth == 0 or len(y) < 2 * self.least or y.min() == y.max():
            return at
        best = (1e-9, -1, 0.0)
        here = y.mean() * (1 - y.mean())
        for f in range(x.shape[1]):
            v = x[:, f]
            order = np.argsort(v, kind="stable")
            s, t = v[order], np.cumsum(y[order])
            k = np.flatnonzero(s[1:] > s[:-1]) + 1
            k = k[(k >= self.least) & (k <= len(y) - self.least)]
            if not len(k):
                continue
            a, b = t[k - 1] / k, (t[-1] - t[k - 1]) / (len(y) - k)
            gain = here - (k * a * (1 - a) + (len(y) - k) * b * (1 - b)) / len(y)
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (gain[j], f, float(s[k[j] - 1] + s[k[j]]) / 2)
        if best[1] < 0:
            return at
        go = x[:, best[1]] <= best[2]
        self.feature[at], self.cut[at] = best[1], best[2]
        self.left[at] = self._grow(x[go], y[go], depth - 1)
        self.right[at] = self._grow(x[~go], y[~go], depth - 1)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right, value = self.arrays
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            f = feature[at]
            go = x[rows, np.maximum(f, 0)] <= cut[at]
            at = np.where(f < 0, at, np.where(go, left[at], right[at]))
        return value[at]


def labelled_pages(name: str = "pages.tsv") -> list[tuple[str | None, list[tuple[int, str]]]]:
    """Pages of a labelled table: site, and its lines with 1 for furniture, 0 for main body."""
    return read_pages(resources.files("tamarack.llm").joinpath(f"labelled/{name}").read_text("utf-8"))


def read_pages(text: str) -> list[tuple[str | None, list[tuple[int, str]]]]:
    out: list[tuple[str | None, list[tuple[int, str]]]] = []
    for line in text.split("\n"):
        if line.startswith("@"):
            out.append((line[2:] or None, []))
        elif line and out:
            out[-1][1].append((int(line[0]), line[2:]))
    return out


@functools.lru_cache(maxsize=1)
def model() -> Tree:
    return trained((labelled_pages(), 3), (labelled_pages("pages_by_hand.tsv"), 1))


def trained(*tables: tuple[Sequence[tuple[str | None, list[tuple[int, str]]]], int]) -> Tree:
    """Tree of tables of pages, each with the weight of its lines."""
    xs, ys = [], []
    for pages, weight in tables:
        x, page, line = features([("\n".join(t for _, t in lines), site) for site, lines in pages], {})
        xs += [x] * weight
        ys += [np.asarray([pages[p][1][i][0] for p, i in zip(page, line)])] * weight
    return Tree().fit(np.vstack(xs), np.concatenate(ys))


_met: dict[str, tuple] = {}


def label(pages: Sequence[tuple[str | None, str | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(page, line, is furniture) of each line that isn't blank."""
    x, page, line = features(pages, _met)
    if not len(page):
        return page, line, np.zeros(0, bool)
    return page, line, model().predict(x) > 0.5


def boilerplate_lines(pages: DataFrame, id_col: str = "id", content: str = "content", site: str = "site") -> DataFrame:
    """(id, line_no) of the lines that are no main body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 1000):
                b = whole.slice(s, 1000)
                page, line, out = label(list(zip(b.column(1).to_pylist(), b.column(2).to_pylist())))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(page[out].astype(np.int64))), pa.array(line[out].astype(np.int32))], names=["id", "line_no"])

    source = pages.where(F.col(content).isNotNull()).select(F.col(id_col).alias("id"), F.col(content).alias("c"), F.col(site).alias("s"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, line_no int")


def main_body(pages: DataFrame, id_col: str = "id", content: str = "content", site: str = "site", out: str = "main") -> DataFrame:
    """(id, main): the page without its furniture; blank lines are kept once between kept lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 1000):
                b = whole.slice(s, 1000)
                contents = b.column(1).to_pylist()
                page, line, off = label(list(zip(contents, b.column(2).to_pylist())))
                drop: dict[int, set[int]] = {}
                for p, i in zip(page[off].tolist(), line[off].tolist()):
                    drop.setdefault(p, set()).add(i)
                kept = [None if c is None else re.sub(r"\n\s*\n\s*\n+", "\n\n", "\n".join(x for i, x in enumerate(c.split("\n")) if i not in drop.get(p, ()))).strip() for p, c in enumerate(contents)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string())], names=["id", out])

    source = pages.select(F.col(id_col).alias("id"), F.col(content).alias("c"), F.col(site).alias("s"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, `{out}` string")
