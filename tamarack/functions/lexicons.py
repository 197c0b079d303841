"""Word lists and patterns by which questions and texts are sorted. Results depend on them as they stand."""

# Question patterns of the intent router, tried group by group in this order.
CHITCHAT = [
    r"^(привет|здравствуй|добр|хай|хей|hello|hi|hey)[\s!.]*$",
    r"^(спасибо|благодар|thanks|thank you|данке|danke).*[\s!.]*$",
    r"^благодарю[\s!.]*$",
    r"^(пока|до свидания|bye|чао|ciao)[\s!.]*$",
    r"^(как (дела|ты|сам)|что нового)[\s?]*$",
    r"^(ок|окей|okay|понял|понятно|ясно|good|хорошо|отлично)[\s!.]*$",
]
PERSONAL = [
    r"(мой|моя|мои|моё)\s*(прогресс|статус|этап|чек-?лист|профиль)",
    r"на каком.*(я|этапе|шаге)",
    r"где я (сейчас|нахожусь)",
    r"что (я|мне).*(сделал|прошел|прошёл)",
    r"что (дальше|следующ|делать)",
    r"(с чего|как) начать",
    r"следующ(ий|ие|ая) шаг",
    r"что (ты )?(знаешь|помнишь) (обо |про )?мн",
    r"мо(й|и|я) (данные|информаци|универ|город)",
]
PERSONAL_TOOLS = [
    ("get_my_progress", r"(прогресс|статус|этап|чек-?лист|где я|на каком|что.*(сделал|прош))"),
    ("get_next_steps", r"(дальше|следующ|делать|начать|на каком)"),
    ("get_my_profile", r"(профиль|знаешь|помнишь|данные|информаци)"),
    ("get_my_entities", r"(мо(й|и|я).*(универ|город|программ)|сохранён)"),
]
CALCULATOR = [
    r"(дедлайн|срок|deadline).*(подач|когда|для|на)",
    r"когда.*(подавать|подать|дедлайн|срок)",
    r"(сколько|какой).*(стоит|бюджет|расход|денег|нужно денег)",
    r"(бюджет|расход|стоимость).*(на|в|для)",
    r"(рассчита|посчита).*(бюджет|расход|стоимость)",
    r"сколько (дней|времени) (до|осталось)",
    r"успе(ю|ваю|ть).*(подать|дедлайн)",
    r"дедлайн.*(bachelor|бакалавр|master|магистр|phd)",
]
DEADLINE = [r"(дедлайн|срок|deadline)", r"когда.*(подавать|подать)"]
BUDGET = [r"(бюджет|стоимость|расход|сколько.*(стоит|денег|нужно денег))"]
DATE_MATH = [r"сколько (дней|времени) (до|осталось)", r"успе(ю|ваю|ть).*(подать|дедлайн)"]
DOCUMENT = [
    r"(как(ие|ой)|список|чек-?лист).*(документ|бумаг)",
    r"документ.*(нужн|нужен|необходим|требу)",
    r"(что|какие).*(собрать|подготовить|нужн).*(документ|бумаг)",
]
MINE = r"(мо(й|и|я)|мне)"
KNOWLEDGE = [
    r"(что такое|как работает|как устроен|объясни|расскажи)",
    r"(нострификаци|апостиль|aufnahme|ergänzungsprüf|vorstudienlehrgang)",
    r"(как|где).*(получить|оформить|сделать|подать|зарегистрироват)",
    r"(чем|в чём|какая) (разниц|отличи|различи)",
    r"(можно ли|разрешено|допускается)",
    r"(требовани|условия|критерии).*(для|к|на)",
    r"(процесс|процедура|порядок|этапы).*(поступлени|подач|получени)",
    r"(универ|вуз|программ).*(подходит|лучше|рейтинг|сравни)",
    r"(виз|внж|вид на жительство|aufenthalt)",
    r"(стипенди|грант|финансирован|scholarship)",
    r"(жильё|жилье|общежити|studentenheim|wg|квартир)",
    r"(страховк|versicherung|ögk)",
    r"(язык|немецк|deutsch|goethe|ösd|testdaf)",
]

# Patterns of fact and of narrative questions, with their categories.
FACT = [
    (r"\b(дедлайн|срок|когда\s+(подат|сдат|регистрац))", "deadline"),
    (r"\b(deadline|due\s*date|submission\s*date)", "deadline"),
    (r"\bдо\s+какого\s+(числа|срока)", "deadline"),
    (r"\b(последний\s+день|крайний\s+срок)", "deadline"),
    (r"\b(стоимость|цена|плата|сколько\s+стоит)", "cost"),
    (r"\b(tuition|fee|cost|price)", "cost"),
    (r"\b(€|евро|euro)", "cost"),
    (r"\b(семестр|semester)\b.*\b(плат|стоит)", "cost"),
    (r"\b(ÖH-Beitrag|Studienbeitrag)", "cost"),
    (r"\b(уровень\s+(немецк|язык)|B[12]|C[12]|A[12])\b", "language"),
    (r"\b(language\s+level|german\s+level|minimum\s+level|required\s+level)\b", "language"),
    (r"\b(сертификат|TestDaF|ÖSD|Goethe|telc|DSH|TDN[345])", "language"),
    (r"\b(какой\s+уровень|минимальн\w+\s+уровень)", "language"),
    (r"\b(квота|места|мест\b|places|quota)", "quota"),
    (r"(\b(non-eu|не-eu)\b.*\b(квот\w*|quota|мест\w*|процент|%)\b)|(\b(квот\w*|quota|мест\w*|процент|%)\b.*\b(non-eu|не-eu)\b)", "quota"),
    (r"\b(процент|percentage|%)", "quota"),
    (r"\b(требовани[яе]|requirement)", "requirement"),
    (r"\b(документ\w*\s+(нуж|треб|нужн))", "requirement"),
    (r"\b(какие\s+документ\w*|список\s+документ\w*|перечень\s+документ\w*)", "requirement"),
    (r"\b(апостиль|apostille|легализация)", "requirement"),
    (r"\b(адрес|email|телефон|contact|phone)", "contact"),
    (r"\b(MedAT|вступительн\w+\s+экзамен|entrance\s+exam)", "exam"),
    (r"\b(дата\s+(теста|экзамена)|exam\s+date)", "exam"),
    (r"\b(сколько|какое\s+количество|how\s+many|how\s+much)", "quantity"),
]
NARRATIVE = [
    (r"\b(как\s+(подат\w*|поступ\w*|оформ\w*|получ\w*|сдел\w*))", "process"),
    (r"\b(как\s+(подготов\w*|сэконом\w*|повыс\w*|улучш\w*|дойти|усп\w*|напис\w*|выбр\w*))", "process"),
    (r"\bкак\b[^?.!,;:\n]{0,40}\b(подготов\w*|сэконом\w*|повыс\w*|улучш\w*|дойти|усп\w*|напис\w*|выбр\w*|получ\w*)", "process"),
    (r"\b(что\s+делать)", "process"),
    (r"\b(how\s+to|process|procedure|steps)", "process"),
    (r"\b(how\s+should\s+i|how\s+can\s+i|best\s+strategy)", "process"),
    (r"\b(пошагов|шаг\s+за\s+шагом|step\s*by\s*step)", "process"),
    (r"\b(что\s+такое|что\s+значит|explain|what\s+is|what\s+does|meaning\s+of)", "explanation"),
    (r"\b(расскажи|объясни|подробн)", "explanation"),
    (r"\b(лучше|хуже|сравн|выбра|recommend|which\s+is\s+better)", "advice"),
    (r"\b(стоит\s+ли|should\s+I)", "advice"),
    (r"\b(плюсы|минусы|pros|cons)", "advice"),
    (r"\b(стратеги|план\s+действий|checklist|чеклист)", "strategy"),
    (r"\b(подготов\w+\s+к)", "strategy"),
    (r"\b(VWU|vorstudienlehrgang|подготовительн)", "vwu_process"),
    (r"\b(виза|visa|ВНЖ|residence\s+permit|aufenthalt)", "visa_process"),
]
CONNECTOR = r"\b(и|and)\b.{0,25}\b(как|how)\b"

# Universities by their spellings.
UNIVERSITIES = {
    "tu-wien": [r"\bTU\s*Wien\b", r"\bТУ\s*Вена?\b", r"\bтехнически[йи]\s+университет\s+вен"],
    "uni-wien": [r"\bUni\s*Wien\b", r"\bУни\s*Вена?\b", r"\bвенски[йи]\s+университет\b", r"\bунивер\w+\s+вены\b"],
    "wu-wien": [r"\bWU\s*Wien\b", r"\bwirtschaftsuniversität\b", r"\bэкономическ\w+\s+универ"],
    "meduni-wien": [r"\bMedUni\s*Wien\b", r"\bмедицинск\w+\s+университет\s+вен"],
    "tu-graz": [r"\bTU\s*Graz\b", r"\bТУ\s*Грац"],
    "uni-graz": [r"\bUni\s*Graz\b", r"\bУни\s*Грац", r"\bграц\w+\s+университет"],
    "uni-innsbruck": [r"\bUni\s*Innsbruck\b", r"\bинсбрук\w+\s+университет"],
    "jku-linz": [r"\bJKU\b", r"\bLinz\b.*\buniversit", r"\bлинц"],
    "uni-salzburg": [r"\bUni\s*Salzburg\b", r"\bPLUS\b", r"\bзальцбург"],
}

# Tags by the word parts that call for them.
TAGS = {
    "housing:dormitory": ["общежит", "studentenheim", "wg", "дом студента", "студгородок"],
    "housing:private": ["квартир", "аренд", "wohnung", "miet", "приватн"],
    "housing:registration": ["мелдецеттель", "прописк", "регистр", "зареги"],
    "housing:costs": ["стоимость жилья", "цена квартир", "мієт"],
    "food:mensa": ["mensa", "меnса", "столов"],
    "food:cafeteria": ["кафе", "буфет", "кафетери", "cafeteria"],
    "food:dietary": ["веган", "вегетари", "allergic", "диетич"],
    "food:costs": ["стоимость еды", "цена обед", "meal plan"],
    "finance:tuition": ["плата за обучение", "tuition", "studienbeitrag"],
    "finance:fees": ["сбор", "пошлин", "gebühr", "fee"],
    "finance:scholarships": ["стипенди", "scholarship", "grant", "финансовая помощь"],
    "finance:housing_costs": ["жилищные расходы", "housing costs", "mietbeihilfe"],
    "visa:application": ["заявк", "application", "antrag", "поступл"],
    "visa:requirements": ["требовани", "requirement", "erfordernis"],
    "visa:residence": ["вид на жительство", "residence permit", "aufenthaltstitel"],
    "visa:extension": ["продлени", "extension", "verlängerung"],
    "language:german": ["немецк", "german", "deutsch"],
    "language:english": ["английск", "english"],
    "language:requirements": ["язык требовани", "language requirement", "sprachanfordung"],
    "language:courses": ["курс языка", "language course", "sprachkurs"],
    "admission:application": ["поступ в", "admission", "bewerbung", "заявк"],
    "admission:requirements": ["требовани", "prerequisite", "voraussetzung"],
    "admission:deadlines": ["дедлайн", "deadline", "termine"],
    "admission:documents": ["документ", "document", "unterlagen"],
    "general:faq": ["часто задаваемые", "faq", "вопрос ответ"],
    "general:contacts": ["контакт", "адрес", "телефон", "contact", "phone"],
}

# Words of a question that set its focus; housing before food.
FOCUS = {
    "housing": ["жиль", "общежит", "studentenheim", "wg ", "квартир", "аренд", "wohnung", "miet", "meldezettel"],
    "food": ["питан", "еда", "столов", "mensa", "кафе", "ресторан", "перекус", "vegan", "vegetarian", "веган", "вегетари", "canteen", "cafeteria", "meal", "меню"],
}

# Words that count for a topic; ties go to the topic named first.
TOPICS = {
    "housing": ["жиль", "общежит", "studentenheim", "квартир", "аренд", "wohnung", "miet", "meldezettel"],
    "food": ["питан", "еда", "столов", "mensa", "кафе", "ресторан", "меню", "cafeteria", "meal"],
    "visa": ["виз", "visa", "residence permit", "вид на жительство", "aufenthaltstitel"],
    "finance": ["стоимость", "цена", "цены", "tuition", "studienbeitrag", "оплат", "fee", "scholarship", "евро за"],
    "language": ["язык", "german", "английск", "немецк", "language", "сертифик", "certificate"],
    "admission": ["поступ", "прием", "дедлайн", "deadline", "application", "заявк", "зачисл"],
}

# Words by which a stage counts as discussed.
STAGES = {
    "documents_prep": ["документ", "аттестат", "апостиль", "перевод", "справк", "диплом", "нотариальн", "легализ", "копи", "оригинал", "выписк", "приложени"],
    "nostrification": ["нострификац", "признание", "anerkenn", "nostrifik", "bewertung", "подтвержден", "эквивалент"],
    "language": ["немецк", "английск", "язык", "сертификат", "deutsch", "goethe", "osd", "testdaf", "ielts", "toefl", "dsh", "a1", "a2", "b1", "b2", "c1", "c2", "ergänzungsprüf", "vorstudienlehrgang", "курс"],
    "university_choice": ["университет", "вуз", "uni ", "fachhochschule", "программ", "специальност", "факультет", "tu wien", "uni wien", "uni graz", "uni innsbruck", "boku", "wu wien", "выбор", "рейтинг"],
    "application": ["подача", "заявк", "application", "zulassung", "bewerbung", "дедлайн", "срок подач", "онлайн заявк", "подать", "apply"],
    "admission_letter": ["зачислен", "зачисл", "письмо", "zulassungsbescheid", "admission", "offer", "приём", "принят"],
    "visa_residence": ["виз", "внж", "вид на жительство", "aufenthalts", "residence", "permit", "ma35", "магистрат", "посольств", "консульств", "страховк", "финансов", "гарант"],
    "finances": ["стоимост", "стипенди", "оплат", "studiengebühr", "взнос", "scholarship", "oead", "грант", "бюджет", "расход", "сколько стоит", "финанс", "банк"],
    "housing_relocation": ["жильё", "жилье", "квартир", "общежити", "studentenheim", "wg ", "wohnung", "miet", "переезд", "аренд", "регистрац", "мельдунг", "meldezettel"],
}
# Words of a mood, moods tried in this order.
MOODS = {
    "anxious": ["боюсь", "волнуюсь", "страшно", "паник", "не успе", "тревож"],
    "confused": ["запутал", "не понимаю", "сложно", "непонятно", "столько всего"],
    "frustrated": ["достало", "опять", "почему так", "бесит", "устал", "надоел"],
    "excited": ["круто", "ура", "класс", "здорово", "отлично", "супер"],
}
# Patterns of things that users name.
ENTITIES = {
    "university": [
        r"\b(uni(?:versität)?|университет)\s+(wien|вена|graz|грац|innsbruck|инсбрук|salzburg|зальцбург|linz|линц)",
        r"\b(tu|technische)\s+(wien|graz)",
        r"\bboku\b",
        r"\bwu\s+wien\b",
        r"\bmeduni\s+wien\b",
        r"\bjku\s+linz\b",
        r"\bfh\s+\w+\b",
    ],
    "deadline": [
        r"(\d{1,2})[./](\d{1,2})[./](20\d{2})",
        r"до\s+(\d{1,2})\s+(январ|феврал|март|апрел|ма[йя]|июн|июл|август|сентябр|октябр|ноябр|декабр)",
        r"дедлайн[а-я]*\s+(\d{1,2}[./]\d{1,2}[./]?\d{0,4})",
    ],
    "document": [r"\b(аттестат|диплом|апостиль|нострификаци[яю]|справк[ау]|сертификат)\b", r"\b(перевод|transcript|zulassungsbescheid)\b"],
    "program": [r"\b(bachelor|бакалавр|master|магистр|phd|докторант)\b", r"\b(informatik|информатик|wirtschaft|экономик|medizin|медицин)\b"],
    "city": [r"\b(вен[аеу]|vienna|wien)\b", r"\b(грац[е]?|graz)\b", r"\b(инсбрук[е]?|innsbruck)\b", r"\b(линц[е]?|linz)\b", r"\b(зальцбург[е]?|salzburg)\b"],
    "language_level": [r"\b([ABC][12])\b", r"\b(goethe|ösd|osd|testdaf|dsh|ielts|toefl)\b"],
}
# One name for each spelling, in lower case.
ENTITY_NAMES = {
    "university": {
        "universität wien": "Uni Wien",
        "uni wien": "Uni Wien",
        "университет вена": "Uni Wien",
        "tu wien": "TU Wien",
        "technische wien": "TU Wien",
        "tu graz": "TU Graz",
        "technische graz": "TU Graz",
        "wu wien": "WU Wien",
        "meduni wien": "MedUni Wien",
        "jku linz": "JKU Linz",
        "boku": "BOKU Wien",
        "uni graz": "Uni Graz",
        "universität graz": "Uni Graz",
        "университет грац": "Uni Graz",
        "uni innsbruck": "Uni Innsbruck",
        "universität innsbruck": "Uni Innsbruck",
        "университет инсбрук": "Uni Innsbruck",
        "uni salzburg": "Uni Salzburg",
        "universität salzburg": "Uni Salzburg",
        "университет зальцбург": "Uni Salzburg",
    },
    "city": {
        "вена": "Vienna", "вене": "Vienna", "вену": "Vienna", "vienna": "Vienna", "wien": "Vienna",
        "грац": "Graz", "граце": "Graz", "graz": "Graz",
        "инсбрук": "Innsbruck", "инсбруке": "Innsbruck", "innsbruck": "Innsbruck",
        "линц": "Linz", "линце": "Linz", "linz": "Linz",
        "зальцбург": "Salzburg", "зальцбурге": "Salzburg", "salzburg": "Salzburg",
    },
    "program": {"bachelor": "bachelor", "бакалавр": "bachelor", "master": "master", "магистр": "master", "phd": "phd", "докторант": "phd"},
}
# A document that users report on, and what says that they lack or have it; lacking is looked for first.
REPORTED = "zulassungsbescheid"
LACKING = [
    "не получил", "не получал", "не получала", "еще не получил", "ещё не получил", "еще не получал", "ещё не получал", "еще не получала", "ещё не получала",
    "пока не получил", "пока не получал", "пока не получала", "нет zulassungsbescheid", "zulassungsbescheid нет", "не получен",
]
HAVING = ["получил", "получила", "получен", "уже есть", "есть zulassungsbescheid", "имею zulassungsbescheid", "на руках zulassungsbescheid"]

# Topics and places that give a chunk its type.
TOPIC_TYPES = {
    "housing": ["housing"],
    "food": ["student-budget", "nutrition", "food"],
    "visa": ["visa-d", "residence-permit"],
    "finance": ["tuition-fees", "scholarships"],
    "language": ["german-language", "german-requirements", "german-courses", "english-programs"],
    "admission": ["university-application", "admission"],
}
FACT_TYPES = {
    "admission": ["deadline", "requirement", "language_requirement", "quota", "key_dates"],
    "finance": ["tuition", "tuition_tariff", "tuition_exemption"],
    "language": ["vwu_location", "gotcha", "certificate"],
    "university": ["contact", "general_info"],
}
