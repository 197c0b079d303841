"""Broken question and answer pairs.

Ordered rules, each of which may trigger: emptiness (nothing but white space, placeholder, punctuation, markup or an empty
wrapper), copied question (what isn't taken from the question, word pairs compared, is a phrase of introduction at most),
refusal (phrases of declining in five languages, with nothing but courtesies beside them), language mismatch (question and answer
are in different scripts, or in different languages of one script, and the question doesn't ask for it), truncation (unclosed
delimiters, tags or JSON, an open list item, a dangling conjunction or comma, and abrupt endings).

Script mismatch is decided by the share of Latin words on either side. It says nothing where one side is a transliteration, and
most pairs share a script, so the language model of p10 decides there: it must name another language than the question's.

Abrupt endings are judged by the corpus: how often the last two to six tokens of an answer without final punctuation end a
sentence anywhere in the table, and whether the last token is the beginning of a longer word in the same context. Every different
answer counts once, however many rows repeat it.

Plan. The rules are one narrow pass; of it only ids, defects and hashed contexts of the open answers are kept. Contexts of all
different answers are hashed in numpy, and each batch passes on only the counts of contexts that an open answer has: their set is
sent to the workers while it is small (counted first: at most WANTED keys of eight bytes), else the counts are joined to it by key.
Nothing is gathered per key.

Defined results: a null question is compared as empty (no copy, no language of its own); null answers are empty; repeated
rows give one row per id (of rows that differ the smallest defects); very long answers are read whole; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm import language as L

ORDER = ("empty", "copy", "refusal", "wrong_language", "truncated")

_INVISIBLE = re.compile("[\\s­​-‏‪-‮⁠-⁤﻿͏᠎ᅟᅠㅤ]+")
_NO_WIDTH = re.compile("[­​-‏‪-‮⁠-⁤﻿͏᠎ᅟᅠㅤ]")
_DIGIT = re.compile(r"\d")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->", re.DOTALL)
_ENTITY = re.compile(r"&(?:[a-zA-Z]{2,8}|#\d{1,6}|#x[0-9a-fA-F]{1,6});")
_PLACEHOLDER = re.compile(
    r"(?:n ?/? ?a|null|none|nil|nan|undefined|empty|todo|tbd|tba|xxx+|test|no answer|answer|ответ|нет ответа|пусто|нет|немає|відповідь|няма|keine antwort|antwort|leer|без ответа|placeholder|lorem ipsum|error|unknown|string|text|текст)",
    re.IGNORECASE,
)
_WORD = re.compile(r"\w+(?:['’ʼ-]\w+)*")
_CITATION = re.compile(r"(?:\s*\[\d+(?:\s*,\s*\d+)*\])+\s*$")


def unwrap(answer: str) -> tuple[str, bool]:
    """The text inside JSON or code fences, and whether a wrapper was left open."""
    text, opened = answer.strip(), False
    if text.startswith("```"):
        body = re.sub(r"^```[a-zA-Z]*\s*", "", text)
        opened = not body.rstrip().endswith("```")
        text = body.rstrip().removesuffix("```").strip()
    if text.startswith(("{", "[")) and re.match(r"[{\[]\s*(?:[\"'{\[]|$)", text):
        try:
            value = json.loads(text)
        except ValueError:
            inner = re.match(r"\{\s*\"(?:answer|response|text|content|reply)\"\s*:\s*\"?(.*)", text, re.DOTALL)
            return (inner.group(1) if inner else text), True
        parts: list[str] = []

        def collect(v) -> None:
            if isinstance(v, str):
                parts.append(v)
            elif isinstance(v, dict):
                for k in ("answer", "response", "text", "content", "reply"):
                    if k in v:
                        return collect(v[k])
                for x in v.values():
                    collect(x)
            elif isinstance(v, list):
                for x in v:
                    collect(x)

        collect(value)
        text = "\n".join(parts)
    return text, opened


def bare(text: str) -> str:
    """Text without tags, entities and invisible characters."""
    text = _TAG.sub(" ", text) if "<" in text else text
    text = _ENTITY.sub(" ", text) if "&" in text else text
    return _INVISIBLE.sub(" ", text).strip() if _NO_WIDTH.search(text) else " ".join(text.split())


#: Five words are no placeholder.
_FIVE = re.compile(r"(?:[^\W_]+[\W_]+){4}[^\W_]")
_CORE = re.compile(r"[\w/]+")


def is_empty(text: str) -> bool:
    """Whether a bare text says nothing."""
    if _FIVE.search(text):
        return False
    core = " ".join(_CORE.findall(text)).strip("/_ ")
    return not core or _PLACEHOLDER.fullmatch(core) is not None


def is_copy(q: list[str], a: list[str]) -> bool:
    """Whether tokens a give back the question's tokens q and add nothing."""
    if not q or not a:
        return False
    if a == q:
        return True
    pairs = set(zip(q, q[1:]))
    if pairs.isdisjoint(zip(a, a[1:])):
        return False
    taken = [False] * len(a)
    for i, p in enumerate(zip(a, a[1:])):
        if p in pairs:
            taken[i] = taken[i + 1] = True
    own = taken.count(False)
    # words of the question that a changed neighbour hides count as taken if most of the rest is
    loose = own - sum(1 for w, t in zip(a, taken) if not t and w in set(q))
    copied = len(a) - own
    return copied >= max(3, 0.5 * len(a)) and loose <= 5 and (own <= 6 or own <= 0.25 * len(a))


def branches(pattern: str) -> list[str]:
    """The alternatives of a pattern."""
    out, depth, at, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append(pattern[at:i])
            at = i + 1
        i += 2 if c == "\\" else 1
    return [*out, pattern[at:]]


def by_first_letter(patterns: Sequence[str]) -> re.Pattern:
    """One pattern for all: those that begin at the edge of a word are tried there only, and by their first letter."""
    letters: dict[str, list[str]] = {}
    rest: list[str] = []
    for branch in (x for p in patterns for x in branches(p)):
        if not branch.startswith(r"\b"):
            rest.append(branch)
            continue
        own = branch[2:]
        if own.startswith("(?:") and own[(end := _closing(own)) + 1 : end + 2] not in ("?", "*", "+", "{"):
            heads = [x + own[end + 1 :] for x in branches(own[3:end])]
        else:
            heads = [own]
        for h in heads:
            letters.setdefault(h[0] if h[0].isalpha() and h[1:2] not in ("?", "*") else "", []).append(h)
    groups = [f"{k}(?:{'|'.join(x[len(k) :] for x in v)})" for k, v in letters.items()]
    return re.compile("|".join([rf"\b(?:{'|'.join(groups)})", *rest]), re.IGNORECASE)


def _closing(pattern: str) -> int:
    """Place of the bracket that closes the one at the beginning."""
    depth, i = 0, 0
    while True:
        depth += (pattern[i] == "(") - (pattern[i] == ")")
        if not depth:
            return i
        i += 2 if pattern[i] == "\\" else 1


# Phrases in which an assistant declines, by language; a sentence with one of them declines.
REFUSALS = (
    # Russian
    r"\bне (?:могу|смогу|сможем|можем)\b.{0,40}\b(?:ответ|помо|подсказ|сказать|предостав|обсужд|дать|консульт|прокоммент|раскры|выполн|сообщ)",
    r"\b(?:ответить|помочь|подсказать|сказать|сообщить)\b.{0,30}\bне (?:могу|смогу|сможем|можем|получится|выйдет)\b",
    r"\bязыков(?:ая|ой) модел", r"\bвыходит за (?:рамки|пределы)", r"\bза (?:рамками|пределами) (?:моих|моей)", r"\bнет (?:у меня )?(?:информации|данных|сведений|ответа|доступа)\b.{0,40}\b(?:тем|вопрос|этом|об)",
    r"\bу меня нет (?:\w+ )?(?:информации|данных|сведений|ответа|доступа|возможности|полномочий|права)", r"\bя (?:всего лишь |всего-навсего |просто |только )?(?:бот|чат-бот|ассистент|помощник|ии|программа)\b",
    r"\bне (?:располагаю|обладаю|владею|имею)\b.{0,30}\b(?:информац|данны|сведени|доступ|прав|полномоч|возможност)", r"\b(?:такие|подобные|эти|данные) (?:вопросы|темы) (?:я )?не (?:обсуждаю|комментирую|рассматриваю)",
    r"\bне (?:обсуждаю|комментирую|консультирую|отвечаю)\b", r"\bне (?:удалось|получилось|смог|смогла) (?:найти|подобрать|отыскать|ответить)", r"\bотвечать не (?:буду|стану)", r"\bя (?:здесь |тут )?(?:бессилен|бессильна)|\bздесь я бессил|\bтут я бессил",
    r"\b(?:промолчу|воздержусь|вынужден(?:а)? отказать|отказываюсь)\b", r"\bне (?:моя|в моей) компетенц", r"\bне вправе\b", r"\bне в (?:силах|состоянии) (?:ответ|помо)", r"\bзатрудняюсь (?:ответ|сказать)", r"\bничего (?:об этом )?не (?:знаю|нашёл|нашел|нашла|нашлось)", r"\bничего нет, поэтому",
    r"\b(?:этого )?я не знаю\b", r"\b(?:ответа|ответ) (?:здесь |тут |на это )?(?:не будет|дать нельзя|невозмож\w+)", r"\bне даю советов",
    # Ukrainian
    r"\bне (?:можу|зможу|можемо)\b.{0,40}\b(?:відпов|допомог|підказ|сказати|надати|обговор|дати|коментув|повідом)", r"\b(?:відповісти|допомогти|підказати|сказати)\b.{0,30}\bне (?:можу|зможу|вийде)\b", r"\bмовна модель|\bмовну модель",
    r"\bвиходить за (?:рамки|межі)", r"\bпоза (?:межами|моїми)", r"\bу мене (?:немає|нема) (?:\w+ )?(?:інформації|даних|відомостей|відповіді|доступу|можливості)", r"\bнемає (?:інформації|даних|відомостей)\b.{0,30}\b(?:тем|питан|про це)",
    r"\bя (?:лише |всього лише |усього лише |тільки |просто )?(?:бот|чат-бот|асистент|помічник|програма)\b", r"\bне (?:маю|володію)\b.{0,30}\b(?:інформац|дани|відомост|доступ|прав|повноваж|можливост)", r"\bтакі питання (?:я )?не обговорюю|\bтаких питань (?:я )?не обговорюю",
    r"\bне (?:обговорюю|коментую|консультую|відповідаю)\b", r"\bне (?:вдалося|вдалось|зміг|змогла) (?:знайти|підібрати|відповісти)", r"\bвідповідати не (?:буду|стану)", r"\b(?:безсилий|безсила)\b", r"\b(?:промовчу|утримаюся|утримаюсь|відмовляюся|відмовляюсь)\b", r"\bнічого немає, тому", r"\bне даю порад", r"\bя не знаю\b",
    # Belarusian
    r"\bне (?:магу|змагу)\b.{0,40}\b(?:адказ|дапам|падказ|сказаць|даць)", r"\b(?:адказаць|дапамагчы)\b.{0,30}\bне (?:магу|змагу)\b", r"\bмоўная мадэль", r"\bвыходзіць за (?:рамкі|межы)", r"\bу мяне няма (?:\w+ )?(?:інфармацыі|даных|дадзеных|звестак|адказу|доступу)",
    r"\bя (?:толькі |усяго толькі |проста )?(?:бот|чат-бот|памочнік|праграма)\b", r"\bне (?:маю)\b.{0,30}\b(?:інфармац|даны|звест|доступ)", r"\bне (?:абмяркоўваю|каментую|кансультую)\b", r"\bне (?:удалося|ўдалося|змог|змагла) (?:знайсці|адказаць)", r"\bбяссіл", r"\b(?:прамаўчу|устрымаюся|адмаўляюся)\b", r"\bнічога няма, таму", r"\bне даю парад",
    # German
    r"\bkann ich (?:\w+ ){0,6}(?:nicht|keine|leider)", r"\bich kann (?:\w+ ){0,6}(?:nicht|keine)\b", r"\bsprachmodell\b", r"\b(?:liegen|liegt) mir (?:\w+ ){0,3}(?:keine|nichts)", r"\bhabe ich (?:\w+ ){0,4}(?:keine|nichts|keinen)\b", r"\bich habe (?:\w+ ){0,4}(?:keine (?:informationen|angaben|daten|auskunft|antwort)|keinen zugriff|nichts gefunden)",
    r"\bnicht (?:zuständig|befugt|berechtigt|in der lage)\b", r"\b(?:ist|war|wäre) mir (?:\w+ ){0,3}nicht möglich", r"\b(?:möchte|darf|werde|will) ich (?:\w+ ){0,4}(?:keine?|nichts?|nicht)\b", r"\bich (?:möchte|darf|werde|will) (?:\w+ ){0,4}(?:keine?|nichts?|nicht)\b", r"\bbespreche ich nicht|\bbeantworte ich nicht|\bich (?:bespreche|beantworte) (?:\w+ ){0,3}nicht",
    r"\bübersteigt (?:leider )?meine", r"\bkeine (?:antwort|auskunft|hilfe) (?:gegeben|erteilt|möglich)|\b(?:kann|können) (?:\w+ ){0,4}nicht (?:beantwortet|beantworten)", r"\baußerhalb (?:meiner|meines)", r"\bich bin (?:nur|bloß|lediglich) (?:ein|eine) (?:bot|chatbot|assistent|programm)", r"\bgeht über (?:meine|das)", r"\bich weiß (?:es|das|dazu)? ?(?:leider )?nicht\b", r"\bweiterhelfen kann ich|\bda bin ich (?:leider )?(?:machtlos|überfragt|ratlos)|\b(?:machtlos|überfragt)\b",
    # English
    r"\bi(?:'m| am) (?:sorry|afraid)\b.{0,40}\b(?:can't|cannot|can not|unable|not able|don't|no )", r"\bi (?:can't|cannot|can not|could not|couldn't|won't|will not) (?:\w+ ){0,3}(?:answer|help|assist|say|tell|provide|discuss|give|comment|advise|find)", r"\b(?:as|i(?:'m| am)) an? (?:ai )?language model", r"\bas an ai\b",
    r"\bi (?:don't|do not) (?:have|discuss|know|give|answer|possess|comment)", r"\bi have (?:no|nothing)\b", r"\bbeyond (?:what i|my|the scope)", r"\boutside (?:my|the) (?:scope|area|remit|field)", r"\b(?:i(?:'m| am)) (?:only|just|merely) (?:a|an) (?:bot|chatbot|assistant|program)", r"\bi(?:'m| am) (?:not able|unable|not allowed|not in a position)",
    r"\bi (?:must|have to|would rather|prefer to|would prefer to) (?:decline|not|stay silent)", r"\bi was (?:not able|unable) to", r"\b(?:i )?(?:found|find) nothing\b.{0,40}\b(?:so|therefore)", r"\bunable to (?:answer|help|assist|find)", r"\bso i(?:'d| would|'ll| will) (?:rather )?(?:not|say nothing|stay silent|keep quiet|pass)", r"\b(?:can't|cannot) help (?:you )?(?:with|here|there)", r"\bi(?:'m| am) powerless|\bnot something i can", r"\bno (?:answer|information|help|advice) (?:can|will|could) be\b|\bcan(?:not|'t) be (?:answered|discussed|given)\b|\bdo not discuss (?:such|these)|\bsuch questions i",
)
_REFUSAL = by_first_letter(REFUSALS)
_COURTESY = re.compile(
    r"^\W*(?:здравствуйте|добрый (?:день|вечер)|привет|уважаем\w+|чем могу (?:помочь|быть полезен)|попробуйте (?:переформулировать|спросить|задать)|надеюсь на (?:ваше )?понимание|обратитесь|извините|простите|к сожалению|удачи|спасибо|благодар\w+|всего (?:доброго|хорошего)|вітаю|добрий (?:день|вечір)|доброго дня|чим можу допомогти|спробуйте|сподіваюс\w*|вибачте|на жаль|щасти|дякую|добры дзень|вітаю|чым магу|паспрабуйце|спадзяюс\w*|прабачце|на жаль|guten (?:tag|abend)|hallo|womit kann ich|wie kann ich|versuchen sie|ich hoffe auf|danke|vielen dank|entschuldigung|leider|tut mir leid|bitte wenden|viel (?:erfolg|glück)|hello|hi\b|good (?:day|morning|evening)|how can i help|what can i|please (?:try|contact|ask|rephrase)|i hope|thank you|thanks|sorry|unfortunately|good luck)\b",
    re.IGNORECASE,
)


#: Whether sentences met, which come with digits made zeros, decline.
_declines: dict[str, bool] = {}


def declines(sentence: str) -> bool:
    found = _declines.get(sentence)
    if found is None:
        if len(_declines) > L.KEEP_SENTENCES:
            _declines.clear()
        found = _declines[sentence] = _REFUSAL.search(sentence) is not None
    return found


def is_refusal(sentences: list[str]) -> bool:
    """Whether a sentence declines and nothing but courtesies stands beside it."""
    said = [declines(s) for s in sentences]
    return any(said) and sum(len(_WORD.findall(s)) for s, no in zip(sentences, said) if not no and not _COURTESY.search(s)) <= 6


_ASKED = {
    "en": r"английск|англійськ|англійск|englisch|english|по-английски|по-англійськи", "de": r"немецк|німецьк|нямецк|deutsch|german\b|по-немецки|по-німецьки", "ru": r"русск|російськ|расійск|russisch|russian|по-русски",
    "uk": r"украинск|українськ|украінск|ukrainisch|ukrainian|по-украински", "be": r"белорусск|білоруськ|беларуск|belarussisch|belarusisch|belarusian|по-белорусски",
}
_ASKED = {k: re.compile(v, re.IGNORECASE) for k, v in _ASKED.items()}
_REPLY = re.compile(r"\b(?:ответ|отвеча|напиш|пиши|пишите|скажите|объясн|відпов|дайте|напиш|поясн|адка|напіш|reply|repl|answer|respond|write|explain|antwort|schreib|erklär)", re.IGNORECASE)


def asked_languages(question: str) -> set[str]:
    out: set[str] = set()
    for s in L.split_sentences(question):
        if _REPLY.search(s):
            out |= {k for k, p in _ASKED.items() if p.search(s)}
    return out


_PAIRED = (("(", ")"), ("[", "]"), ("«", "»"), ("{", "}"))
_DANGLING = re.compile(
    r"(?:^|[\s(«„“\"])(?:и|а|но|или|что|чтобы|если|когда|как|который|которая|которые|которое|потому|поэтому|так как|в|во|на|с|со|к|ко|по|за|из|от|до|для|при|о|об|под|над|у|без|через|между|не|ни|только если|либо|"
    r"і|й|та|або|але|що|щоб|якщо|коли|як|який|яка|які|бо|у|з|із|зі|до|від|для|про|під|над|без|через|між|не|ні|калі|што|каб|альбо|або|ці|з|са|да|ад|пра|пад|"
    r"und|oder|aber|dass|wenn|weil|ob|als|wie|der|die|das|den|dem|des|ein|eine|einen|einem|einer|eines|im|in|an|am|auf|aus|bei|beim|mit|nach|von|vom|zu|zum|zur|für|über|unter|vor|durch|ohne|gegen|um|bis|nicht|sie|"
    r"and|or|but|that|if|when|because|whether|as|the|a|an|of|to|in|on|at|by|for|from|with|without|about|into|onto|over|under|than|is|are|was|were|be|must|has|have|had|will|your|their|its|not)$",
    re.IGNORECASE,
)
_OPEN_ITEM = re.compile(r"(?:^|[\n;:]|[.!?]\s)\s*(?:\d{1,2}[.)]|[-•*–—])\s*$")
_TRAIL = re.compile(r"[\s\U0001F000-\U0001FAFF☀-➿️‍]+$")


def _tags_open(text: str) -> bool:
    if re.search(r"<[/a-zA-Z][^<>]*$", text):
        return True
    opened = Counter(t.lower() for t in re.findall(r"<(b|i|u|p|a|em|strong|code|pre|ul|ol|li|div|span|blockquote|table|tr|td|h[1-6])(?:\s[^<>]*)?>", text, re.IGNORECASE))
    closed = Counter(t.lower() for t in re.findall(r"</([a-z]+[1-6]?)\s*>", text, re.IGNORECASE))
    return any(n > closed[t] for t, n in opened.items() if t not in ("p", "li"))


#: Signs that can stand open.
_OPENING = re.compile(r"[<&(\[«{„`*]")


def _opened(text: str) -> bool:
    """Whether a tag, a bracket, a quotation or a mark is left open."""
    if ("<" in text and _tags_open(text)) or ("&" in text and re.search(r"&[a-z]{2,6}$", text)):
        return True
    plain = _TAG.sub("", text) if "<" in text else text
    if any(a in plain and plain.count(a) > plain.count(z) for a, z in _PAIRED):
        return True
    if "„" in plain and plain.count("„") > plain.count("“") + plain.count("”") + plain.count('"'):
        return True
    return bool(plain.count("```") % 2 or plain.count("**") % 2)


def trimmed(text: str) -> str:
    """Text without tags, and without white space, signs and citations at its end."""
    plain = _TAG.sub("", text) if "<" in text else text
    if plain[-1:].isspace() or plain[-1:] >= "\u2600":
        plain = _TRAIL.sub("", plain)
    return _CITATION.sub("", plain) if plain.rstrip()[-1:] == "]" else plain


def is_cut_open(text: str, wrapper_open: bool) -> bool:
    """Truncation that the answer shows by itself."""
    if wrapper_open or (_OPENING.search(text) and _opened(text)):
        return True
    end = trimmed(text)
    if end.rstrip()[-1:] in _ITEM_ENDS and _OPEN_ITEM.search(end):
        return True
    end = end.rstrip()
    if end[-1:] in ",;:–—-/(«„+&=":
        return True
    shorn = end[:-1] if end[-1:] == "…" else end.rstrip(".") if end[-2:] == ".." else end
    # no dangling word is longer than what is looked at
    return shorn[-1:] not in _STOPS and _DANGLING.search(shorn[-80:].rstrip("\"'»”“*_ ")) is not None


_ITEM_ENDS, _STOPS = frozenset(".)-•*–—"), frozenset(".!?")
_TOKEN = re.compile(r"\w+(?:['’ʼ-]\w+)*|\n|[^\w\s]")


def stream(text: str) -> list[str]:
    """Tokens with punctuation and line ends, digits alike."""
    return _TOKEN.findall(_DIGIT.sub("0", L.normal(trimmed(text)).lower()))


_ENDING = frozenset(".!?…\n")
_CLOSERS = frozenset("\"'»“”)*_")


def in_items(t: list[str]) -> list[bool]:
    """For each token whether its line is a list item."""
    out, item = [], False
    for i, w in enumerate(t):
        if i == 0 or t[i - 1] == "\n":
            after = t[i + 1] if i + 1 < len(t) else ""
            item = w in ("-", "•", "*", "–", "—") or (w.isdigit() and len(w) < 3 and after in (".", ")"))
        out.append(item)
    return out


def tail(text: str) -> list[str] | None:
    """Kind of the line and last tokens (as many as the longest context) of a text that ends without final punctuation, else None."""
    last = trimmed(text).rstrip()
    if last[-1:] in _STOPS and last[-2:-1].isalnum():
        return None
    t = stream(text)
    while t and t[-1] in _CLOSERS:
        t = t[:-1]
    while t and t[-1] == "…" or len(t) > 1 and t[-1] == t[-2] == ".":
        t = t[:-1]
        while t and t[-1] == ".":
            t = t[:-1]
    if not t or t[-1] in _ENDING:
        return None
    kind = "item" if in_items(t)[-1] else "text"
    return [kind, *[*["^"] * CONTEXTS[-1], *t][-CONTEXTS[-1] :]]


#: Numbers of tokens by whose endings an open answer is judged; the longest that the corpus knows decides.
CONTEXTS = (2, 3, 4, 6)
#: A context must have been met so often.
KNOWN = 3
#: Up to so many contexts of open answers are sent to the workers.
WANTED = 1_000_000
#: Hashes of tokens that a worker keeps before it starts anew.
KEEP_TOKENS = 400_000


class Tokens:
    """Hashes of tokens met, and whether they are words."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.hashes: list[int] = []
        self.words: list[bool] = []

    def _add(self, w: str) -> int:
        k = self.index[w] = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(w))
        self.words.append(w[0].isalnum())
        return k

    def of(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hash and word flag of each token."""
        if len(self.index) > KEEP_TOKENS:
            self.__init__()
        get, add = self.index.get, self._add
        at = np.array([k if (k := get(w)) is not None else add(w) for w in tokens], np.int64)
        return np.array(self.hashes, np.uint64)[at], np.array(self.words, bool)[at]


_tokens = Tokens()
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def token_hash(w: str) -> int:
    return xxhash.xxh3_64_intdigest(w)


def mixed(h: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Hash of a sequence with one token more."""
    with np.errstate(over="ignore"):
        h = (h ^ token) * _M1
        return (h ^ (h >> np.uint64(31))) * _M2


def context_keys(item: np.ndarray, hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Keys of the n tokens that end at each place, with the kind of the line."""
    h = np.where(item, np.uint64(2 * n + 1), np.uint64(2 * n))
    for k in range(n - 1, -1, -1):
        h = mixed(h, hashes[at - k])
    return h


def tail_keys(tails: list[list[str]]) -> np.ndarray:
    """Of each tail its keys, one for each of CONTEXTS, then the key of what stands before its last token in the shortest but one."""
    if not tails:
        return np.zeros((0, len(CONTEXTS) + 1), np.uint64)
    hashes, _ = _tokens.of([w for t in tails for w in t[1:]])
    item = np.array([t[0] == "item" for t in tails])
    last = np.arange(1, len(tails) + 1) * CONTEXTS[-1] - 1
    return np.stack([*(context_keys(item, hashes, last, n) for n in CONTEXTS), open_keys(item, hashes, last)], axis=1)


def open_keys(item: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What context_keys of CONTEXTS[1] has before its last token is added."""
    n = CONTEXTS[1]
    h = np.where(item, np.uint64(2 * n + 1), np.uint64(2 * n))
    for k in range(n - 1, 0, -1):
        h = mixed(h, hashes[at - k])
    return h


_JUDGED = "id string, defects array<string>, " + ", ".join(f"last{n} long" for n in CONTEXTS) + ", before long"


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 2000):
            b = whole.slice(start, 2000)
            ids, questions, answers = (b.column(i).to_pylist() for i in range(3))
            asked = {q: i for i, q in enumerate(dict.fromkeys(questions))}
            given = {a: i for i, a in enumerate(dict.fromkeys(answers))}
            inner = [unwrap(a) if a is not None else ("", False) for a in given]
            texts = [L.normal(bare(t)) for t, _ in inner]
            q_texts = [L.normal(q) if q else "" for q in asked]
            empty = [is_empty(t) for t in texts]
            q_parts = [L.split_sentences(L.without_addresses(q)) for q in q_texts]
            a_parts = [[] if e else L.split_sentences(_DIGIT.sub("0", L.without_addresses(_CITATION.sub("", t) if t[-1:] == "]" else t))) for t, e in zip(texts, empty)]
            model = L.model()
            theirs, own = L.Detected(q_parts, model), L.Detected(a_parts, model)
            q_lang, a_lang = [theirs.languages(i) for i in range(len(asked))], [own.languages(i) for i in range(len(given))]
            q_tokens, a_tokens = [_WORD.findall(q.lower()) for q in q_texts], [[] if e else _WORD.findall(t.lower()) for t, e in zip(texts, empty)]
            refused = [not e and is_refusal(p) for p, e in zip(a_parts, empty)]
            cut = [not e and is_cut_open(t, wrapped) for (t, wrapped), e in zip(inner, empty)]
            tails = [None if e or c else tail(t) for (t, _), e, c in zip(inner, empty, cut)]
            opened, ends = tail_keys([t for t in tails if t is not None]), np.cumsum([t is not None for t in tails]) - 1
            found, keys = [], []
            for q, a in zip(questions, answers):
                i, j = asked[q], given[a]
                defects = []
                if empty[j]:
                    found.append(["empty"])
                    keys.append(None)
                    continue
                if is_copy(q_tokens[i], a_tokens[j]):
                    defects.append("copy")
                if refused[j]:
                    defects.append("refusal")
                if q_lang[i] and a_lang[j] and len(a_tokens[j]) >= 3 and len(q_tokens[i]) >= 2 and (own_lang := a_lang[j][0])[0] not in {x for x, _ in q_lang[i]} and differ(q_lang[i], own_lang, theirs.script(i) * own.script(j) < 0) and a_lang[j][0][0] not in asked_languages(q or ""):
                    defects.append("wrong_language")
                if cut[j]:
                    defects.append("truncated")
                found.append(defects)
                keys.append(None if tails[j] is None or cut[j] else int(ends[j]))
            at = pa.array(keys, pa.int64())
            columns = [pa.array(opened[:, c].view(np.int64)).take(at) for c in range(len(CONTEXTS) + 1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(found, pa.list_(pa.string())), *columns], names=["id", "defects", *(f"last{n}" for n in CONTEXTS), "before"])


def differ(theirs: list[tuple[str, float]], own: tuple[str, float], scripts: bool) -> bool:
    """Whether an answer's language, which isn't among the question's, surely differs; scripts: whether they are written in different ones."""
    if scripts or own[1] < 0.6:
        return scripts
    near = {"ru", "uk", "be"}  # short questions in a script that these share tell little
    return not (len(theirs) == 1 and theirs[0][1] < 0.98 and {own[0], theirs[0][0]} <= near)


_COUNTED = "key long, n_end long, n_on long, n_longer long"


def _ending_counts(batches: Iterator[pa.RecordBatch], wanted: np.ndarray | None, before: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Of contexts: how often a sentence ends with them, how often it goes on, and how often a longer last token stands there.

    wanted: sorted keys of the contexts asked for, before: those that open_keys gives; None for all.
    """
    most = CONTEXTS[-1]
    for b in batches:
        words: list[str] = []
        for a in b.column(0).to_pylist():
            words += ["^"] * most
            words += stream(unwrap(a)[0])
        if not words:
            continue
        words.append("^")
        hashes, word = _tokens.of(words)
        n = len(words)
        sign = {c: token_hash(c) for c in [*_ENDING, *_CLOSERS, "^", "-", "•", "*", "–", "—", ")"]}
        is_ = lambda chars: np.isin(hashes, np.array([sign[c] for c in chars], np.uint64))
        pad, line_end = is_("^"), is_("\n")
        # the kind of a line follows from its first tokens
        first = np.flatnonzero(~pad & (np.concatenate(([True], (pad | line_end)[:-1]))))
        number = np.fromiter((w.isdigit() and len(w) < 3 for w in (words[i] for i in first)), bool, len(first))
        after = is_(".)")
        starts_item = is_("-•*–—")[first] | (number & after[np.minimum(first + 1, n - 1)])
        line = np.searchsorted(first, np.arange(n), side="right") - 1
        item = (line >= 0) & starts_item[np.maximum(line, 0)] if len(first) else np.zeros(n, bool)
        # what follows a token, closing signs passed over
        closing = is_("\"»“”)")
        place = np.where(closing, n, np.arange(n))
        follower = np.minimum.accumulate(place[::-1])[::-1]
        at = np.flatnonzero(word)
        nearest = follower[np.minimum(at + 1, n - 1)]
        ended = pad[nearest] | is_(".!?…\n")[nearest]
        last = pad[at + 1]
        ended, going = ended & ~last, ~ended & ~last
        keys, end, on = [], [], []
        for k in CONTEXTS:
            key = context_keys(item[at], hashes, at, k)
            keep = ~last if wanted is None else ~last & _among(key, wanted)
            keys.append(key[keep])
            end.append(ended[keep])
            on.append(going[keep])
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        n_end = np.bincount(inverse, np.concatenate(end), minlength=len(every)).astype(np.int64)
        n_on = np.bincount(inverse, np.concatenate(on), minlength=len(every)).astype(np.int64)
        # longer words: of each word, all its beginnings in the same place
        head = open_keys(item[at], hashes, at)
        there = np.arange(len(at)) if before is None else np.flatnonzero(_among(head, before))
        longer: Counter[tuple[int, str]] = Counter((int(head[i]), words[at[i]]) for i in there)
        parts = [(h, token_hash(w[:j]), c) for (h, w), c in longer.items() for j in range(1, len(w))]
        if parts:
            h, t, c = (np.array(x, np.uint64) for x in zip(*parts))
            key = mixed(h, t)
            keep = np.ones(len(key), bool) if wanted is None else _among(key, wanted)
            every2, inverse = np.unique(key[keep], return_inverse=True)
            n_longer = np.bincount(inverse, c[keep].astype(float), minlength=len(every2)).astype(np.int64)
        else:
            every2, n_longer = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        none = lambda x: np.zeros(len(x), np.int64)
        columns = [np.concatenate([every, every2]).view(np.int64), np.concatenate([n_end, none(every2)]), np.concatenate([n_on, none(every2)]), np.concatenate([none(every), n_longer])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "n_end", "n_on", "n_longer"])


def _among(key: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(key), bool)
    return known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key


def judge(pairs: DataFrame, id_col: str = "id", question: str = "question", answer: str = "answer", min_end: float = 0.15, wanted: int = WANTED) -> DataFrame:
    """(id, defects): every defect each pair shows, in the order of the rules; pairs without defects have an empty list."""
    from tamarack.session import cut

    sc = pairs.sparkSession.sparkContext
    rows = pairs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{question}`").alias("question"), F.col(f"`{answer}`").alias("answer"))
    rest = [f"last{n}" for n in CONTEXTS] + ["before"]
    judged = rows.mapInArrow(_judged, _JUDGED).groupBy("id").agg(F.min(F.struct("defects", *rest)).alias("r"))
    judged = cut(judged.select("id", "r.*"))
    keys = judged.select(F.explode(F.array(*rest[:-1])).alias("key")).where("key is not null").distinct()
    small = keys.count() <= wanted
    own = [None, None]
    if small:
        sets = (keys, judged.select(F.col("before").alias("key")).where("key is not null").distinct())
        own = [np.sort(x.toArrow().column(0).to_numpy().view(np.uint64)) for x in sets]
    sent = sc.broadcast(own)
    counts = rows.select("answer").where("answer is not null").distinct().mapInArrow(lambda it: _ending_counts(it, *sent.value), _COUNTED)
    if not small:  # the counts that no open answer asks for are dropped before they are summed up
        counts = counts.join(keys, "key", "left_semi")
    counts = cut(counts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n_end", "n_on", "n_longer")]))
    out, abrupt = judged, F.coalesce(F.col(f"longer{CONTEXTS[1]}"), F.lit(0)) > 0
    for n in CONTEXTS:
        known = counts.select(F.col("key").alias(f"last{n}"), (F.col("n_end") + F.col("n_on")).alias(f"seen{n}"), F.col("n_end").alias(f"end{n}"), F.col("n_longer").alias(f"longer{n}"))
        out = out.join(F.broadcast(known) if small else known, f"last{n}", "left")
        abrupt = F.when(F.col(f"seen{n}") >= KNOWN, F.col(f"end{n}") / F.col(f"seen{n}") < min_end).otherwise(abrupt)
    abrupt = F.coalesce(F.col(f"last{CONTEXTS[0]}").isNotNull() & abrupt, F.lit(False))
    return out.select("id", F.when(abrupt, F.array_union("defects", F.array(F.lit("truncated")))).otherwise(F.col("defects")).alias("defects"))


def broken(pairs: DataFrame, **options) -> DataFrame:
    """(id, defect): the first defect of each broken pair."""
    return judge(pairs, **options).where(F.size("defects") > 0).select("id", F.element_at("defects", 1).alias("defect"))
