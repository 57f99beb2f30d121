"""Pieces of DuckDB SQL for the oracle: the detectors said a second time, with RE2 and lists."""

from __future__ import annotations

from lakesift.functions import lexicon
from lakesift.functions.matching import any_of
from lakesift.plans.corpus import CORPUS

TABLES = {n: n for n in ("documents", "pages", "orders")}
# The detectors' patterns, spelled for RE2.
EMAIL = r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?:\+7|8)[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}"
NAME = r"(?:^|[^\p{L}\p{N}_])([А-ЯЁ][а-яё]{2,20}\s+[А-ЯЁ][а-яё]{2,20}(?:\s+[А-ЯЁ][а-яё]{2,20})?)(?:$|[^\p{L}\p{N}_])"
BIRTH, INDEX, PASSPORT = r"\b\d{2}[./]\d{2}[./]\d{4}\b", r"\b\d{6}\b", r"\b\d{4}\s\d{6}\b"
SNILS, MRZ, CARD, RUN = r"\b\d{3}-\d{3}-\d{3}\s?\d{2}\b", "[A-Z0-9<]{20,}", r"(?:\d[ \-]*?){13,19}", r"\d+"
CVV, ACCOUNT = r"(?i)\b(?:CVV|CVC|CVV2)\b", r"(?i)(?:р/с|расч[её]тн(?:ый)?\s+сч[её]т)[^\d]*(\d{20})"
BIK = r"(?i)бик[^\d]*(\d{9})"
DATE = r"(?i)\b(?:\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4}|\d{1,2}\s+[A-Z]{3,9}\s+\d{2,4})\b"


def found(rx: str, group: int = 0, text: str = "text") -> str:
    return f"regexp_extract_all({text}, '{rx}', {group})"


def count(rx: str) -> str:
    return f"len({found(rx)})"


def matches_any(c: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({c}, '{w}')" for w in words) + ")"


def contained(words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains(low, '{w}')::bigint" for w in words) + ")"


def luhn(x: str) -> str:
    d = rf"regexp_replace({x}, '\D', '', 'g')"
    v = f"substr({d}, j, 1)::bigint"
    twice = f"case when (j - 1) % 2 = length({d}) % 2 then case when {v} > 4 then 2 * {v} - 9 else 2 * {v} end else {v} end"
    return f"(length({d}) between 13 and 19 and list_sum(list_transform(range(1, length({d}) + 1), lambda j: {twice})) % 10 = 0)"


def _weighted(d: str, weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"{w} * substr({d}, {i}, 1)::bigint" for i, w in enumerate(weights, 1)) + ")"


def snils(x: str) -> str:
    d = rf"regexp_replace({x}, '\D', '', 'g')"
    return f"({_weighted(d, (9, 8, 7, 6, 5, 4, 3, 2, 1))} % 101 % 100 = substr({d}, 10, 2)::bigint)"


def inn10(d: str) -> str:
    return f"({_weighted(d, (2, 4, 10, 3, 5, 9, 4, 6, 8))} % 11 % 10 = substr({d}, 10, 1)::bigint)"


def inn12(d: str) -> str:
    one, two = _weighted(d, (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)), _weighted(d, (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8))
    return f"({one} % 11 % 10 = substr({d}, 11, 1)::bigint and {two} % 11 % 10 = substr({d}, 12, 1)::bigint)"


def runs(least: int, most: int, test: str = "true") -> str:
    return f"list_filter({found(RUN)}, lambda x: case when length(x) between {least} and {most} then {test} else false end)"


def near(name: str, words: tuple[str, ...], width: int, test: str = "true") -> str:
    """Numbers of the matches ``m_<name>`` with a word near; in ``test`` the match is ``m_<name>[i]``."""
    pos = f"list_sum(list_transform(s_{name}[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m_{name}[1:i-1], lambda q: length(q))), 0)"
    ok = f"regexp_matches(low[greatest({pos} - {width}, 0) + 1 : {pos} + {width}], '{any_of(words)}')"
    some = f"list_filter(range(1, len(m_{name}) + 1), lambda i: {test} and {ok})"
    return f"case when {matches_any('low', words)} then {some} else [] end"


SPANS = {"birth": BIRTH, "index": INDEX, "passport": PASSPORT, "run": RUN, "card": CARD}


def rows(select: str, spans: tuple[str, ...] = (), body: str = CORPUS, more: str = "") -> str:
    """``select`` over the corpus with ``low`` and, for each of ``spans``, matches m_ and what lies between them s_."""
    cols = "".join(f", {found(SPANS[s])} as m_{s}, regexp_split_to_array(text, '{SPANS[s]}') as s_{s}" for s in spans)
    return f"with corpus as ({body.format(**TABLES)}),\nx as (select *, lower(text) as low{cols} from corpus){more}\nselect {select}"


CARDS = near("card", lexicon.NEAR_CARD, 40, luhn("m_card[i]"))
LICENCES = near("run", lexicon.NEAR_LICENCE, 30, "length(m_run[i]) between 10 and 12")
GROUPS = {
    "g_common": f"{count(EMAIL)} + {count(PHONE)} + least(len({found(NAME, 1)}), 10)"
    f" + len({near('birth', lexicon.NEAR_BIRTH, 40)}) + len({near('index', lexicon.NEAR_INDEX, 40)})",
    "g_gov": f"len(list_filter({found(SNILS)}, lambda x: {snils('x')})) + len({runs(12, 12, inn12('x'))}) + len({runs(10, 10, inn10('x'))})"
    f" + len({near('passport', lexicon.NEAR_PASSPORT, 60)}) + len({LICENCES}) + regexp_matches(text, '{MRZ}')::bigint",
    "g_pay": f"len({CARDS}) + {count(ACCOUNT)} + {count(BIK)} + regexp_matches(text, '{CVV}')::bigint",
    "g_bio": f"{matches_any('low', lexicon.BIOMETRIC)}::bigint",
    "g_special": f"{matches_any('low', lexicon.SPECIAL)}::bigint",
}
ALL = tuple(SPANS)
GROUP_CTE = ",\ng as (select kind, id, text, low, " + ", ".join(f"({v})::bigint as {k}" for k, v in GROUPS.items()) + " from x)"
TOTAL = "(g_common + g_gov + g_pay + g_bio + g_special)"
HEAVY = f"({TOTAL} >= 5 or " + " + ".join(f"({k} > 0)::int" for k in GROUPS) + " >= 2)"
LEVEL = f"""case when text = '' then '—' when g_special > 0 or g_bio > 0 then case when {HEAVY} then 'УЗ-1' else 'УЗ-2' end
    when g_pay > 0 or g_gov > 0 then case when {HEAVY} then 'УЗ-2' else 'УЗ-3' end
    when g_common > 0 then case when {HEAVY} then 'УЗ-3' else 'УЗ-4' end else '{lexicon.NO_LEVEL}' end"""
CLEAN_NAMES = f"list_filter({found(NAME, 1)}, lambda n: not {matches_any('lower(n)', lexicon.TOPONYMS)})"
DATES = count(DATE)
SCORE = (
    f"(least(3.0::double, 0.6::double * {contained(lexicon.DOCUMENT_WORDS)}) + least(2.4::double, 0.8::double * {count(MRZ)})"
    f" + case when {DATES} >= 2 then 0.8::double else 0::double end + case when {contained(lexicon.IDENTITY_WORDS)} >= 3 then 1::double else 0::double end)"
)
STRONG = f"(g_gov > 0 or g_pay > 0 or g_bio > 0 or g_special > 0 or regexp_matches(text, '{EMAIL}') or regexp_matches(text, '{PHONE}'))"
DECIDE = {
    "text": f"case when text = '' then false else {STRONG} or len({CLEAN_NAMES}) >= 2 end",
    "data": f"case when text = '' then false else {STRONG} or len({CLEAN_NAMES}) >= 10 end",
    "images": f"case when text = '' then false else {STRONG} or {SCORE} >= 2 or ({SCORE} >= 1 and len({CLEAN_NAMES}) >= 1) or ({DATES} >= 2 and {SCORE} >= 0.8) end",
}
_KEYWORDS = f"{contained(lexicon.DOCUMENT_WORDS)}"
SCORE_REASONS = (
    f"list_filter([case when {_KEYWORDS} > 0 then 'kw=' || {_KEYWORDS} end, case when {count(MRZ)} > 0 then 'mrz' end,"
    f" case when {DATES} >= 2 then 'dates=' || {DATES} end, case when {contained(lexicon.IDENTITY_WORDS)} >= 3 then 'id_combo' end], lambda r: r is not null)"
)
_NAMES = f"len({CLEAN_NAMES})"
RULES = {
    "text": f"case when {STRONG} then 'strong' when {_NAMES} >= 2 then 'fio_count=' || {_NAMES} end",
    "data": f"case when {STRONG} then 'strong' when {_NAMES} >= 10 then 'fio_count=' || {_NAMES} end",
    "images": f"case when {STRONG} then 'strong' when {SCORE} >= 2 then 'doc_score>=2' when {SCORE} >= 1 and {_NAMES} >= 1 then 'doc_score+fio'"
    f" when {DATES} >= 2 and {SCORE} >= 0.8 then 'dates_score=' || {DATES} end",
}


def reasons(top_dir: str) -> str:
    """The rule that decides, then what the score is made of."""
    return f"case when text = '' then 'empty' else array_to_string(list_concat(list_filter([{RULES[top_dir]}], lambda r: r is not null), {SCORE_REASONS}), ' | ') end"


def stars(c: str, keep: int) -> str:
    return f"(case when length({c}) <= {2 * keep} then repeat('*', length({c})) else {c}[1:{keep}] || repeat('*', length({c}) - {2 * keep}) || {c}[-{keep}:] end)"
