"""Word lists and labels.

Fixed values: detection results depend on every entry.
"""

# Words that mark a capitalised pair as a place or an organisation, not a person.
TOPONYMS = (
    "новгород", "москва", "санкт", "петербург", "ростов", "краснодар", "екатеринбург", "новосибирск", "казань", "уфа", "омск", "самара",
    "посад", "мартан", "челны", "набережные", "александров", "сергиев", "разина", "степана", "ставрополь", "воронеж", "волгоград", "пермь",
    "красноярск", "саратов", "тюмень", "тольятти", "ижевск", "барнаул", "хабаровск", "владивосток", "ярославль", "иркутск", "махачкала",
    "томск", "оренбург", "кемерово", "рязань", "пенза", "липецк", "лесной", "рубеж", "учебный", "банк", "южное", "бутово", "тихая",
    "слобода", "летняя", "долина", "речной", "квартал", "звёздная", "роща", "школьная", "гавань", "академика", "синтек", "вектор", "тех",
    "лабс", "улица", "проспект", "площадь", "компания", "общество", "федерация", "российская", "министерство", "департамент",
)

# Vocabulary of biometric and special-category data.
BIOMETRIC = ("биометр", "отпечат", "радуж", "ирис", "лицев", "селфи", "faceid", "fingerprint", "voiceprint", "голосов", "геометрия лица")
HEALTH = ("диагноз", "анамнез", "инвалид", "здоровь", "медицин", "психиатр", "вич")
POLITICS = ("политическ", "партия")
BELIEFS = ("религ", "вероисповед", "интим", "сексуаль")
SPECIAL = HEALTH + ("религ", "вероисповед") + POLITICS + ("интим", "сексуаль")

# Vocabulary of identity documents.
DOCUMENT_WORDS = (
    "passport", "passaporte", "personalausweis", "führerschein", "fuhrerschein", "identity card", "identification card", "driver",
    "licence", "license", "date of birth", "date of expiry", "issuing country", "authority", "nationality", "surname", "given names",
    "passport no", "personal no", "bundesrepublik deutschland", "geburtsort", "geburtstag", "vorname", "nachname", "gültig bis",
    "gultig bis", "muster", "republica federativa do brasil", "república federativa do brasil", "republica de chile",
    "república de chile", "cédula", "cedula", "identidad", "nacimiento", "apellidos", "nombres", "nacionalidad", "fecha de", "run ",
    "rut ", "pasaporte", "česká republika", "ceska republika", "občanský průkaz", "obcansky prukaz", "datum narození", "místo narození",
    "platnost do", "romania", "românia", "permis de conducere", "republika e shqipërisë", "republic of albania", "lëtërnjoftim",
    "جواز السفر", "الجنسية", "الاسم", "中华人民共和国", "居民身份证", "签发机关", "有效期限",
    "паспорт", "дата рождения", "место рождения", "гражданство",
)
IDENTITY_WORDS = ("surname", "given", "nationality", "birth", "expiry")

# Words that must stand near a match.
NEAR_BIRTH = ("дата рождения", "родил")
NEAR_INDEX = ("ул", "улица", "просп", "пер", "дом", "квартира", "город", "г.")
NEAR_PASSPORT = ("паспорт", "серия", "номер", "код подразделения")
NEAR_LICENCE = ("водител", "удостовер")
NEAR_CARD = ("visa", "mastercard", "карта", "cvv", "cvc", "номер карты")

# Category names and labels in report order.
CATEGORIES = {
    "name": "ФИО", "birth": "Дата_рождения", "email": "Email", "phone": "Телефон", "snils": "СНИЛС", "address": "Адрес",
    "card": "Банковская_карта", "health": "Здоровье", "inn": "ИНН", "biometric": "Биометрия", "passport": "Паспорт_РФ",
    "account": "Банковский_счёт", "bik": "БИК", "politics": "Политика", "beliefs": "Национальность_раса",
}

# Protection levels, their descriptions and recommendations.
NO_LEVEL = "нет признаков"
LEVELS = {
    "УЗ-1": ("Биометрия / спец. категории", "Спец. категории / биометрия. Требуются меры 1-го уровня защищённости (Приказ ФСТЭК № 21). Шифрование, аттестация ИС, строгий аудит."),
    "УЗ-2": ("Платёжные данные / много гос. ID", "Платёжные данные или гос. идентификаторы в значимом объёме. Меры 2-го уровня защищённости. Шифрование данных, ограниченный доступ."),
    "УЗ-3": ("Гос. идентификаторы / много обычных ПДн", "Государственные идентификаторы или значимые обычные ПДн. Меры 3-го уровня защищённости. Разграничение доступа, резервное копирование."),
    "УЗ-4": ("Обычные ПДн в небольшом объёме", "Обычные ПДн. Базовые меры 4-го уровня защищённости. Ограничение доступа, уведомление об инцидентах."),
}
