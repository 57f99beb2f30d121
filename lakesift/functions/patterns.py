"""Detector patterns for the JVM; ``(?U)`` makes classes and boundaries Unicode-aware.

Fixed values: results depend on every pattern.
"""

EMAIL = r"(?U)\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?U)(?:\+7|8)[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}"
NAME = r"(?U)\b[А-ЯЁ][а-яё]{2,20}\s+[А-ЯЁ][а-яё]{2,20}(?:\s+[А-ЯЁ][а-яё]{2,20})?\b"
BIRTH = r"(?U)\b\d{2}[./]\d{2}[./]\d{4}\b"
INDEX = r"(?U)\b\d{6}\b"
SNILS = r"(?U)\b\d{3}-\d{3}-\d{3}\s?\d{2}\b"
INN12 = r"(?U)(?<!\d)\d{12}(?!\d)"
INN10 = r"(?U)(?<!\d)\d{10}(?!\d)"
PASSPORT = r"(?U)\b\d{4}\s\d{6}\b"
MRZ = r"[A-Z0-9<]{20,}"
LICENCE = r"(?U)(?<!\d)\d{10,12}(?!\d)"
CARD = r"(?U)(?:\d[ \-]*?){13,19}"
CVV = r"(?iU)\b(?:CVV|CVC|CVV2)\b"
ACCOUNT = r"(?iU)(?:р/с|расч[её]тн(?:ый)?\s+сч[её]т)[^\d]*(\d{20})"
BIK = r"(?iU)бик[^\d]*(\d{9})"
DATE = r"(?iU)\b(?:\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4}|\d{1,2}\s+[A-Z]{3,9}\s+\d{2,4})\b"
