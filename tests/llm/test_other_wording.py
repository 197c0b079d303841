"""Texts of other sources and wordings than the test tables'."""

from tamarack.llm import language as L
from tamarack.llm import pages as B
from tamarack.llm import personal as D

PAGES = """@ museum.example
1 Skip navigation
1 Visit Exhibitions Learn Shop
1 Home > Learn > School groups
1 This website uses cookies. By continuing you agree to our privacy policy.
1 Deutsch | English
0 # School groups
0 Classes of up to thirty pupils can book a guided tour on any weekday morning.
0 The tour takes ninety minutes and is free for schools in the region.
0 - one adult for every ten pupils
0 - lunch can be eaten in the courtyard
0 Please book at least two weeks ahead, because the mornings in June fill up quickly.
1 Share this page
1 You might also like
1 Family workshops in spring
1 Last modified: 9 May 2022
1 © Museum of Clocks 2022. All rights reserved.
@
1 Zum Hauptinhalt springen
1 Startseite Studium Forschung Kontakt
1 Sie sind hier: Startseite > Studium > Fristen
1 Diese Website verwendet Cookies. Mit der weiteren Nutzung erklären Sie sich einverstanden.
0 Fristen für das Sommersemester
0 Die allgemeine Zulassungsfrist endet am 5. Februar, die Nachfrist am 31. März.
0 Wer die Frist versäumt, kann sich erst für das folgende Semester bewerben.
0 Unterlagen in anderen Sprachen sind mit beglaubigter Übersetzung einzureichen.
1 Seite drucken
1 Weitere Artikel
1 Mensa mit neuem Angebot
1 Impressum | Datenschutz
@
1 Перейти к содержанию
1 Главная Новости Услуги Контакты
1 Вы здесь: Главная > Услуги > Перевод
1 Сайт использует cookie. Продолжая работу с сайтом, вы соглашаетесь с этим.
0 Перевод документов
0 Присяжный переводчик заверяет перевод печатью, и такой перевод принимают все учреждения.
0 Стоимость страницы от 25 евро, готово за три рабочих дня.
1 Поделиться с друзьями
1 Читайте также
1 Апостиль: пошаговая инструкция
1 Все права защищены. Политика конфиденциальности
"""


def test_pages_of_other_sites():
    pages = B.read_pages(PAGES)
    page, line, off = B.label([("\n".join(t for _, t in lines), site) for site, lines in pages])
    truth = [pages[p][1][i][0] == 1 for p, i in zip(page, line)]
    wrong = [(pages[p][1][i][1], bool(o)) for p, i, o, t in zip(page, line, off, truth) if bool(o) != t]
    assert len(wrong) <= 4, wrong
    assert not [x for x, o in wrong if "cookie" in x.lower() or x in ("Deutsch | English", "Share this page")], wrong


def test_personal_information_in_other_wording():
    found = D.field().decode(
        [
            "Please call me back on +44 20 7946 0958, I am at work until five.",
            "Schicken Sie die Rechnung bitte an max.huber@firma.test, danke.",
            "Пишите на ivan_petrov77@post.test в любое время.",
            "The meeting is on 12.05.2026 in room 214 and costs nothing.",
            "My phone is 0664 123 45 67 and my mail is kate@web.test",
        ]
    )
    assert [[k for _, _, k in f] for f in found] == [["PHONE"], ["EMAIL"], ["EMAIL"], [], ["PHONE", "EMAIL"]]


def test_languages_in_other_wording():
    given = {
        "The ferry leaves at seven in the morning, and the crossing takes about three hours.": "en", "Der Zug fährt um sieben Uhr ab, und die Reise dauert ungefähr drei Stunden.": "de",
        "Поезд отправляется в семь утра, и дорога занимает около трёх часов.": "ru", "Потяг вирушає о сьомій ранку, і дорога триває близько трьох годин.": "uk", "Цягнік адпраўляецца а сёмай раніцы, і дарога займае каля трох гадзін.": "be",
        "She had never seen so much snow, so the children stayed outside until it was dark.": "en", "Моя бабушка печёт пироги с капустой каждую субботу.": "ru", "Моя бабуся пече пиріжки з капустою щосуботи.": "uk", "Мая бабуля пячэ пірагі з капустай кожную суботу.": "be",
    }
    found = L.detect(list(given))
    assert [f[0][0][0] for f in found] == list(given.values())


def test_a_batch_with_many_new_words_keeps_its_numbers(monkeypatch):
    monkeypatch.setattr(L, "KEEP_WORDS", 50)
    monkeypatch.setattr(L, "KEEP_SENTENCES", 10)
    own = L.LanguageModel(L.training_table())
    texts = [t for _, t in L.training_table()]
    small = [x for i in range(0, len(texts), 40) for x in L.detect(texts[i : i + 40], own)]
    assert [f[0] for f in small] == [f[0] for f in L.detect(texts, L.LanguageModel(L.training_table()))]


def test_nothing_is_cut_at_the_edge_of_a_stretch():
    def finds(n, wanted):
        text = "Wort " * n + f"und {wanted} oder " + "Wort " * 500 + "ende"
        return [text[a:z] for a, z, _ in D.field().decode([text])[0]]

    assert finds(30, "+43 660 123 45 67") == ["+43 660 123 45 67"]
    for n in range(D.MAX_TOKENS - 20, D.MAX_TOKENS + 4):
        for wanted in ("+43 660 123 45 67", "Schulgasse 12/3/37"):
            assert finds(n, wanted) == finds(30, wanted), n
    plain = D.joined([(0, [0] * 40 + [1] * 60), (4, [0] * 100)])
    assert plain is not None and D.joined([(0, [1] * 100), (4, [1] * 100)]) is None
