"""Variant spellings of names typed by people, linked by merge-and-rematch resolution.

Method: every spelling is read into a profile: what it names (person, company of a line of business, institution
of a town, town, region, event of a year, concept), the core name in a skeleton that is the same for Cyrillic and
Latin letters, cases and genders, and qualifiers (given name, initial, line, institution, year, genre). Records with
equal profiles, and the two spellings of one record, merge at once. Then rounds follow: the merged records'
spellings, given names, initials and qualifiers are united, the richer profiles are blocked again by all their cores (of every
kind: a company, institution, place, event or concept by every core with every qualifier of its spellings), and a
record with only an initial or a bare surname merges into the one record it is compatible with (none where there
are several: namesakes stay apart). Misspelt cores meet in blocks of their one-letter deletions (full names of
their two-letter ones; long cores in blocks of the same deletions as hashes, long full names by the pieces two edits
leave) and are compared by edit distance. The rounds end when no merge occurs.

Qualifiers must agree: other given names, other lines of one brand, other institutions of one town, a town and its
region, and other years of one event stay apart. Middle initials are noise here and decide nothing. Recorded types
are not used.

Scale: all steps are joins on hashed keys over distinct profiles, not rows: a spelling that a third of all rows share
is one profile, so no block holds it more than once. Components are found by label propagation in tables written
to the shared folder; nothing is collected.

Defined results: null and empty names, and debris without letters, link to nothing; a null original_name is
skipped; repeated rows of one key count once; empty tables give no pairs; very long names are read and compared
whole; ambiguous short forms link to none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import written

# Common given names, and the short forms of each.
MALE = (
    "александр алексей анатолий андрей антон аркадий артем борис вадим валентин валерий василий виктор виталий владимир владислав вячеслав геннадий "
    "георгий глеб григорий данила денис дмитрий евгений егор иван игорь илья кирилл константин лев леонид максим марк матвей михаил никита николай олег "
    "павел петр роман руслан семен сергей станислав степан тимофей федор эдуард юрий ярослав"
).split()
FEMALE = (
    "александра алина алла анастасия ангелина анна валентина валерия варвара вера вероника виктория галина дарья диана ева евгения екатерина елена "
    "елизавета жанна зинаида зоя инна ирина карина кристина ксения лариса лидия любовь людмила маргарита марина мария надежда наталья нина оксана ольга "
    "полина раиса светлана софия тамара татьяна ульяна юлия яна"
).split()
SHORT = {
    "саша": "александр александра", "шура": "александр александра", "женя": "евгений евгения", "валя": "валентин валентина", "лера": "валерия",
    "леша": "алексей", "алеша": "алексей", "толя": "анатолий", "боря": "борис", "вадик": "вадим", "вася": "василий", "витя": "виктор", "виталик": "виталий",
    "володя": "владимир", "вова": "владимир", "влад": "владислав", "слава": "вячеслав станислав", "гена": "геннадий", "жора": "георгий", "гоша": "георгий",
    "гриша": "григорий", "даня": "данила", "дима": "дмитрий", "митя": "дмитрий", "ваня": "иван", "костя": "константин", "лева": "лев", "леня": "леонид",
    "макс": "максим", "миша": "михаил", "коля": "николай", "паша": "павел", "петя": "петр", "рома": "роман", "сеня": "семен", "сережа": "сергей",
    "степа": "степан", "тима": "тимофей", "федя": "федор", "эдик": "эдуард", "юра": "юрий", "настя": "анастасия", "аня": "анна", "нюра": "анна", "варя": "варвара",
    "вика": "виктория", "галя": "галина", "даша": "дарья", "катя": "екатерина", "лена": "елена", "лиза": "елизавета", "зина": "зинаида", "ира": "ирина",
    "ксюша": "ксения", "лара": "лариса", "лида": "лидия", "люба": "любовь", "люда": "людмила", "рита": "маргарита", "маша": "мария", "надя": "надежда",
    "наташа": "наталья", "оля": "ольга", "поля": "полина", "рая": "раиса", "света": "светлана", "соня": "софия", "тома": "тамара", "таня": "татьяна", "уля": "ульяна", "юля": "юлия",
}
# Lines of business and how they are written.
LINES = {
    "банк": "банк bank банка б-к бк", "агро": "агро agro агр ак", "транс": "транс trans тр", "телеком": "телеком telecom telekom тк тел", "нефть": "нефть neft oil нк нефт неф",
    "энерго": "энерго energo энерг эн эк", "строй": "строй stroy stroj стр ск", "фарм": "фарм pharm farm фар фк", "инвест": "инвест invest инв", "авиа": "авиа avia", "маш": "маш mash", "хим": "хим him chem",
}
LEGAL = set("ао ооо оао зао пао пао ип гк группа группы группе компания компании корпорация холдинг ao ooo pao zao llc ltd inc group company фирма концерн".split())
GENRES = {"программа": "программа программы program programma прог прогр", "индекс": "индекс индекса index indeks инд", "метод": "метод метода method metod", "проект": "проект проекта project", "стандарт": "стандарт"}
SHOWS = set("форум форума кубок кубка выставка выставки фестиваль фестиваля конференция саммит премия конкурс чемпионат forum cup kubok festival vystavka expo summit фест выст конф".split())
CITY = set("г город города гор city town gorod пос поселок село".split())
REGION = set("область области обл край края республика район района region oblast".split())
TITLES = set("г-н г-жа господин госпожа гн гжа mr mrs ms dr д-р доктор тов".split())
SMALL = set("по и в на of the for при имени им".split())

_CYR = dict(zip("абвгдезийклмнопрстуфхцчшщъыьэ", ["a", "b", "v", "g", "d", "e", "z", "i", "j", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "h", "c", "4", "w", "w", "", "i", "", "e"])) | {"ё": "e", "ж": "q", "ю": "ju", "я": "ja"}
_LAT = [("shch", "w"), ("sch", "w"), ("zh", "q"), ("ch", "4"), ("sh", "w"), ("kh", "h"), ("ts", "c"), ("tz", "c"), ("ph", "f"), ("x", "ks")]
_LOOK = str.maketrans("aceopxykmtbhu", "асеорхукмтвни")
_LOOK_BACK = str.maketrans("асеорхукмтвн", "aceopxykmtbh")
_MIXED_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[^\W_]+(?:-[^\W\d_]{1,2}(?![^\W_]))?")
_YEAR = re.compile(r"(?<!\d)((?:19|20)\d\d)(?!\d)|['’`ʼ](\d\d)(?!\d)")


def one_script(text: str) -> str:
    """Words that mix alphabets by look-alikes come out in the alphabet most of their other letters have."""

    def fix(m: re.Match) -> str:
        w = m.group()
        latin = [c for c in w if "a" <= c <= "z"]
        cyr = [c for c in w if "а" <= c <= "я" or c == "ё"]
        if not latin or not cyr:
            return w
        sure = sum(c not in "aceopxykmtbhu" for c in latin) - sum(c not in "асеорхукмтвн" for c in cyr)
        return w.translate(_LOOK_BACK) if sure > 0 else w.translate(_LOOK)

    return _MIXED_WORD.sub(fix, text)


@lru_cache(maxsize=100_000)
def skeleton(word: str) -> str:
    """One spelling for both alphabets; single letters for single sounds, so that edits count alike."""
    if any("а" <= c <= "я" or c == "ё" for c in word):
        out = "".join(_CYR.get(c, c) for c in word)
    else:
        word = word.replace("w", "v")
        for a, b in _LAT:
            word = word.replace(a, b)
        word = re.sub(r"(?<=[aeiou])y|y(?=[aeiou])", "j", word).replace("y", "i")
        out = re.sub(r"['’`ʼ]", "", word).replace("ia", "ja").replace("iu", "ju")
    out = out.replace("ts", "c").replace("kh", "h").replace("sh", "w").replace("zh", "q")
    return out.replace("je", "e")


def _cases(name: str) -> list[str]:
    """A given name's nominative and genitive (and a few other cases)."""
    if name == "павел":
        return [name, "павла", "павлу"]
    if name == "лев":
        return [name, "льва"]
    if name == "петр":
        return [name, "петра", "петру"]
    if name.endswith("ия"):
        return [name, name[:-1] + "и", name[:-1] + "ю", name[:-1] + "ей"]
    if name.endswith("ья") or name.endswith("я"):
        return [name, name[:-1] + "и", name[:-1] + "ю"]
    if name.endswith("а"):
        return [name, name[:-1] + ("и" if name[-2] in "гкхжшчщ" else "ы"), name[:-1] + "у", name[:-1] + "е"]
    if name.endswith("ь"):
        return [name, name[:-1] + "и"] if name == "любовь" else [name, name[:-1] + "я"]
    if name.endswith("й"):
        return [name, name[:-1] + "я", name[:-1] + "ю"]
    return [name, name + "а", name + "у"]


@lru_cache(maxsize=1)
def _givens() -> dict[str, tuple[frozenset[str], str]]:
    """skeleton -> (canonical given names, gender or '')."""
    found: dict[str, set[tuple[str, str]]] = {}
    for gender, names in (("m", MALE), ("f", FEMALE)):
        for name in names:
            for form in _cases(name):
                found.setdefault(skeleton(form), set()).add((name, gender))
    by = {n: "m" for n in MALE} | {n: "f" for n in FEMALE}
    for short, full in SHORT.items():
        for form in [short, short[:-1] + "и", short[:-1] + "ы"]:
            for name in full.split():
                found.setdefault(skeleton(form), set()).add((name, by[name]))
    return {k: (frozenset(n for n, _ in v), "".join({g for _, g in v}) if len({g for _, g in v}) == 1 else "") for k, v in found.items()}


@lru_cache(maxsize=1)
def _line_words() -> dict[str, str]:
    return {skeleton(w): line for line, ws in LINES.items() for w in [line, *ws.split()]}


@lru_cache(maxsize=1)
def _genre_words() -> dict[str, str]:
    return {skeleton(w): g for g, ws in GENRES.items() for w in ws.split()}


@lru_cache(maxsize=1)
def _show_words() -> frozenset[str]:
    return frozenset(skeleton(w) for w in SHOWS)


@lru_cache(maxsize=200_000)
def distance(a: str, b: str) -> int:
    """Optimal string alignment distance up to 2; 3 for more."""
    n, m = len(a), len(b)
    if abs(n - m) > 2:
        return 3
    i = 0
    while i < n and i < m and a[i] == b[i]:
        i += 1
    while n > i and m > i and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b, n, m = a[i:n], b[i:m], n - i, m - i
    # Rows of the five cells on and about the diagonal: those farther off are 3 or more.
    before, row = None, [3, 3, 0, 1, 2]
    for i in range(1, n + 1):
        now = [3] * 5
        for k in range(max(0, 2 - i), min(4, m - i + 2) + 1):
            j = i + k - 2
            if j == 0:
                now[k] = i
                continue
            now[k] = min(3, row[k] + (a[i - 1] != b[j - 1]), now[k - 1] + 1 if k else 3, row[k + 1] + 1 if k < 4 else 3)
            if before is not None and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                now[k] = min(now[k], before[k] + 1)
        if min(now) > 2:
            return 3
        before, row = row, now
    return min(3, row[m - n + 2])


def _like(word: str, table) -> str | None:
    """The table's word that ``word`` is, or is one edit from (five letters or more)."""
    if word in table:
        return word
    if len(word) >= 5:
        for w in table:
            if len(w) >= 5 and abs(len(w) - len(word)) <= 1 and distance(word, w) == 1:
                return w
    return None


@lru_cache(maxsize=100_000)
def _given(word: str, loose: bool = False) -> tuple[frozenset[str], str, int] | None:
    """(given names, their gender or '', edits): those the word spells, else the nearest within one edit (five letters
    or more), or with ``loose`` within one (three) or two (five). Several nearest ones all count."""
    table = _givens()
    if word in table:
        return (*table[word], 0)
    least = 3 if loose else 5
    if len(word) < least:
        return None
    most = 2 if loose and len(word) >= 5 else 1
    best, found = most, []
    for w in table:
        if len(w) >= least and abs(len(w) - len(word)) <= best:
            d = distance(word, w)
            if d < best:
                best, found = d, [w]
            elif d == best:
                found.append(w)
    if not found:
        return None
    options = frozenset().union(*(table[w][0] for w in found))
    genders = {table[w][1] for w in found}
    return options, genders.pop() if len(genders) == 1 else "", best


def _of_gender(options: frozenset[str], gender: str) -> tuple[str, ...]:
    """The options that agree with a surname's form, if any do."""
    fit = {n for n in options if n in (MALE if gender == "m" else FEMALE)} if gender and len(options) > 1 else options
    return tuple(sorted(fit or options))


_SURNAME = (
    (re.compile(r"([sc])k(?:ij|oj|ogo|omu|im|ja)$"), "sk", "m"), (re.compile(r"([sc])k(?:aja|uju)$"), "sk", "f"),
    (re.compile(r"(?<=..)([oe])v(?:a|oj|u)$"), "v", "f"), (re.compile(r"(?<=..)([oe])v(?:im|e)?$"), "v", "m"),
    (re.compile(r"(?<=..)in(?:a|oj|u)$"), "in", "f"), (re.compile(r"(?<=..)in(?:im|e)?$"), "in", "m"),
    (re.compile(r"enko$"), "enko", ""),
    # Misspelt endings.
    (re.compile(r"([sc])k[jaiogu]{1,5}$"), "sk", ""), (re.compile(r"(?<=..)([oe])v[aou]{1,3}$"), "v", ""), (re.compile(r"(?<=..)in[aou]{2,3}$"), "in", ""),
)


def surname(sk: str) -> tuple[str, str]:
    """(stem with its class, gender of the form or ''): one core for both genders and the cases."""
    for pattern, kind, gender in _SURNAME:
        m = pattern.search(sk)
        if m:
            stem = sk[: m.start()]
            if kind == "sk" and m.group(1) == "c":
                stem += "t"
            if kind == "v":
                return stem + "ov", gender
            return stem + kind, gender
    return sk, ""


_ADJ = re.compile(r"([sc])k(?:ij|ogo|omu|im|aja|oj|uju|oe|ja)$")
_TOWN = re.compile(r"([sc])k(?:a|u|e|om)?$")


def _stem(m: re.Match, sk: str) -> str:
    return sk[: m.start()] + ("t" if m.group(1) == "c" else "")


def _first(sk: str) -> str:
    return sk[:2] if sk[:2] in ("ju", "ja") else sk[:1]


#: kind, core, givens or qualifiers (sorted), initial, gender, the core word as it stands
Profile = tuple[str, str, tuple[str, ...], str, str, str]


def read_name(name: str | None) -> Profile | None:
    """What a spelling names; None for debris."""
    p = _read_name(name)
    return p if p is None or len(p) == 6 else (*p, p[1])


def _read_name(name: str | None) -> tuple | None:
    if not name:
        return None
    text = unicodedata.normalize("NFKC", html.unescape(name)).replace("nbsp;", " ")
    text = re.sub("[­​-‍⁠﻿́]", "", text).lower().replace("й", "й").replace("ё", "е")
    text = one_script(text)
    text = re.sub(r"[–—]", "-", text)
    year = _YEAR.search(text)
    body = _YEAR.sub(" ", text) if year else text
    tokens = [t for t in _TOKEN.findall(body) if any(c.isalpha() for c in t)]
    if not tokens or sum(len(t) for t in tokens) < 3:
        return None
    sks = [skeleton(t.replace("-", "")) for t in tokens]
    shows, genres, lines = _show_words(), _genre_words(), _line_words()
    # An event: a year, and a name beside the kind of event.
    if year:
        rest = [s for s in sks if _like(s, shows) is None and len(s) >= 3]
        if rest:
            y = year.group(1) or "20" + year.group(2)
            return ("event", max(rest, key=len), (y,), "", "")
    # A concept: a genre word and a name.
    if len(sks) >= 2:
        g = [_like(s, genres) for s in sks]
        rest = [s for s, x in zip(sks, g) if x is None and len(s) >= 4]
        kinds = [genres[x] for x in g if x is not None]
        if kinds and len(rest) == 1:
            return ("concept", rest[0], (kinds[0],), "", "")
    region = [t for t in tokens if t in REGION or _like(skeleton(t), {"oblast"})]
    if region and len(tokens) >= 2:
        rest = [s for t, s in zip(tokens, sks) if t not in region]
        core = max(rest, key=len)
        m = _ADJ.search(core) or _TOWN.search(core)
        return ("region", _stem(m, core) if m else core, (), "", "")
    city = [i for i, (t, s) in enumerate(zip(tokens, sks)) if t in CITY or _like(s, {"gorod"}) is not None]
    if len(city) == 1 and len(tokens) == 2 and not re.match(r"^\s*г-", text):
        core = sks[1 - city[0]]
        m = _TOWN.search(core)
        # "Г." may be an initial: then only a town's ending tells.
        if len(core) >= 4 and (len(tokens[city[0]]) > 1 or m and not _ADJ.search(core)):
            return ("town", _stem(m, core) + "sk" if m else core, (), "", "")
    titled = bool(re.match(r"^\s*г-?(?:н|жа|на|жи)\b", text))
    tokens = [t for t in tokens if t not in TITLES]
    sks = [skeleton(t.replace("-", "")) for t in tokens]
    if not tokens:
        return None
    # An institution of a town: an adjective or a town, and two words or an abbreviation.
    adj = [i for i, s in enumerate(sks) if _ADJ.search(s) and len(s) >= 6]
    towns = [i for i, s in enumerate(sks) if _TOWN.search(s) and len(s) >= 6 and not _ADJ.search(s)]
    long_words = [i for i, t in enumerate(tokens) if t not in SMALL and len(t) >= 1]
    cut = re.match(r"^\s*([^\W\d_]{4,})\.\s", text)
    place = adj[0] if adj else towns[0] if towns and len(tokens) >= 3 else None
    if place is None and cut and len(tokens) >= 3 and _given(sks[0]) is None:
        place = 0
    if place is not None and not titled and len(tokens) >= 2:
        others = [i for i in long_words if i != place]
        known_given = any(_given(sks[i], len(tokens[i]) >= 5 or not tokens[i].isascii() and len(tokens[i]) >= 4) is not None for i in others)
        if len(others) == 1:
            s = sks[others[0]]
            if not known_given and 2 <= len(s) <= 5 and len(tokens[others[0]]) >= 2 and tokens[others[0]] not in LEGAL:
                m = _ADJ.search(sks[place]) or _TOWN.search(sks[place])
                return ("inst", _stem(m, sks[place]) if m else sks[place], (s,), "", "")
        elif len(others) >= 2 and sum(len(tokens[i]) == 1 for i in others) < len(others) - 1 and not (known_given and len(others) == 1):
            m = _ADJ.search(sks[place]) or _TOWN.search(sks[place])
            code = "".join(_first(sks[i]) for i in others)
            return ("inst", _stem(m, sks[place]) if m else sks[place], (code,), "", "")
    # A company: brand and line, apart or in one word.
    plain = [(t, s) for t, s in zip(tokens, sks) if t not in LEGAL]
    if len(plain) == 2 or (len(plain) == 1 and len(tokens) > 1) or len(plain) == 1:
        hit = [(i, _like(s, lines)) for i, (_, s) in enumerate(plain)]
        known = [(i, x) for i, x in hit if x is not None]
        if len(plain) == 2 and known:
            i, x = known[-1] if len(known) == 1 else min(known, key=lambda k: len(plain[k[0]][1]))
            brand = plain[1 - i][1]
            if len(brand) >= 4 and not (len(plain[i][0]) <= 2 and _given(brand)):
                # "line of X": the brand in the genitive.
                if i == 0 and brand.endswith("a") and len(brand) >= 6 and brand[-2] not in "aeiou":
                    brand = brand[:-1]
                return ("company", brand, (lines[x],), "", "")
        if len(plain) == 1 and len(plain[0][1]) >= 8:
            for w, line in lines.items():
                if len(w) >= 4 and w[0] == "s" and plain[0][1].endswith("c" + w[1:]):  # t and s met as one letter
                    return ("company", plain[0][1][: -len(w)] + "t", (line,), "", "")
                if len(w) >= 4 and plain[0][1].endswith(w) and len(plain[0][1]) - len(w) >= 4 and not _ADJ.search(plain[0][1]):
                    return ("company", plain[0][1][: -len(w)], (line,), "", "")
    # A person: a surname with a given name or an initial; a bare surname by its ending.
    names = [s for t, s in plain if len(t) > 1]
    letters = [t for t, _ in plain if len(t) == 1]
    if len(plain) <= 4 and names:
        if len(names) == 2:
            # Which of the two is the given name: the one with fewer edits, then the shorter; with more slips only beside a surname's ending.
            ends = [any(p.search(x) for p, _, _ in _SURNAME) for x in names]
            read = [(i, _given(names[i], ends[1 - i] and not ends[i])) for i in (0, 1)]
            read = [(g[2], len(names[i]), i, g) for i, g in read if g is not None]
            if read:
                _, _, i, (options, gender, _) = min(read, key=lambda x: x[:3])
                core, form = surname(names[1 - i])
                quals = _of_gender(options, "f" if form == "f" and not options & set(MALE) else form if form == "m" else "")
                return ("person", core, quals, "", (gender or form) if len(quals) == 1 else "", names[1 - i])
        if len(names) == 1:
            core, form = surname(names[0])
            if letters:
                mark = skeleton(letters[0])
                return ("person", core, (), mark[:2] if mark[:1] == "j" else mark[:1], form)
            m = _TOWN.search(names[0])
            if m and len(names[0]) >= 6 and not _ADJ.search(names[0]):
                return ("town", _stem(m, names[0]) + "sk", (), "", "")
            if core != names[0] or form or names[0].endswith("enko"):
                return ("person", core, (), "", form)
    if len(plain) == 1 and len(plain[0][1]) >= 6:
        return ("town", plain[0][1], (), "", "")  # a single word of no known ending: compared with towns
    core = " ".join(sorted(s for _, s in plain)) if plain else " ".join(sorted(sks))
    return ("other", core, (), "", "") if len(core) >= 3 else None


def initial_of(given: str) -> str:
    sk = skeleton(given)
    return sk[:2] if sk[:1] == "j" else sk[:1]


KEY_LETTERS = 64
PROFILE = "key string, kind string, core string, quals array<string>, initial string, gender string, raw string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.string()), ("kind", pa.string()), ("core", pa.string()), ("quals", pa.list_(pa.string())), ("initial", pa.string()), ("gender", pa.string()), ("raw", pa.string())])
    for b in batches:
        out: dict[str, list] = {n: [] for n in schema.names}
        for key, spellings in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for p in {read_name(x) for x in spellings} - {None}:
                for n, v in zip(schema.names, (key, *p)):
                    out[n].append(list(v) if n == "quals" else v)
        yield pa.RecordBatch.from_pydict(out, schema=schema)


def _deletions(core: str, most: int = 1) -> set[str]:
    """The core and its deletions of up to ``most`` letters: two cores within so many edits or swaps share one. Long cores come
    alone: they meet by ``_long_keys``."""
    out = last = {core}
    if len(core) < KEY_LETTERS:
        for _ in range(most):
            last = {v[:i] + v[i + 1 :] for v in last for i in range(len(v))}
            out = out | last
    return out


_PRIME, _BASE = (1 << 61) - 1, 0x1B873593A5A5C3D1


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _hashed_deletions(core: str) -> set[int]:
    """Hashes of the core and its one-letter deletions, in time proportional to its length."""
    n, whole, power = len(core), 0, 1
    heads = [0]
    for c in core:
        whole = (whole * _BASE + ord(c)) % _PRIME
        heads.append(whole)
    out = {whole}
    for i in range(n - 1, -1, -1):
        out.add((whole + (heads[i] - heads[i + 1]) * power) % _PRIME)
        power = power * _BASE % _PRIME
    return out


def _pieces(core: str) -> Iterator[str]:
    """Keys of which two cores within two edits or swaps share one: those touch four fifths of a core at most (a swap two), and
    the fifth left lies up to two letters aside in the other, whose length is ``n``."""
    for n in range(len(core) - 2, len(core) + 3):
        for k in range(5):
            start, end = n * k // 5, n * (k + 1) // 5
            for by in range(-2, 3):
                if abs(by) + abs(len(core) - n - by) <= 2 and start + by >= 0 and end + by <= len(core):
                    yield f"{n}.{k}.{_digest(core[start + by : end + by])}"


def _long_keys(core: str, wide: bool) -> Iterator[str]:
    """What ``_deletions`` would give a long core, in keys of bounded length, whose number grows with the core's length at most."""
    return _pieces(core) if wide else map(str, _hashed_deletions(core))


KEYS_AT_ONCE = 100_000


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, stratum, core, wide) to its blocks: deletions (of two letters with ``wide``, from the eight letters on that two
    edits leave of ten), letters in any order, and consonants (from the six letters on that two edits leave of eight; with
    ``wide`` of any length). Cores that two edits may make long have the keys of long ones too."""
    names = ["id", "block"]
    for b in batches:
        ids, keys = [], []
        for i, stratum, core, wide in zip(*(b.column(k).to_pylist() for k in range(4))):
            own = [f"{stratum}|{v}" for v in _deletions(core, 2 if wide and len(core) >= 8 else 1)]
            if wide or len(core) >= 6:
                own += [f"{stratum}|#{''.join(sorted(core))}", f"{stratum}|%{_bones(core)}"]
            if len(core) >= KEY_LETTERS - 2:
                mark = _digest(stratum)
                own += [f"{mark}~{v}" for v in _long_keys(core, wide)]
            ids += [i] * len(own)
            keys += own
            if len(keys) >= KEYS_AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string())], names=names)
                ids, keys = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string())], names=names)


def _bones(core: str) -> str:
    return re.sub("[aeiouj]", "", core)


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distances; ``swap``: the same letters in another order, or the same consonants: what two slips leave most often; ``n``: the
    letters of the longer core."""
    for b in batches:
        x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
        d = [distance(p, q) for p, q in zip(x, y)]
        swap = [sorted(p) == sorted(q) or _bones(p) == _bones(q) for p, q in zip(x, y)]
        n = [max(len(p), len(q)) for p, q in zip(x, y)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d, pa.int32()), pa.array(swap, pa.bool_()), pa.array(n, pa.int32())], names=["a", "b", "d", "swap", "n"])


def blocks(cores: DataFrame) -> DataFrame:
    """(id, block) of (id, stratum, core, wide), the block as a 64-bit hash."""
    return cores.select("id", "stratum", "core", "wide").mapInArrow(_keys, "id bigint, block string").select("id", F.xxhash64("block").alias("block")).distinct()


def near_pairs(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """(a, b, d, swap, n): pairs of (id, stratum, core, wide) rows that share a block, with the distance of their cores; d <= 2."""
    # Written in pieces: the driver keeps every plan and re-plans it after each of its stages, so small plans cost it less.
    lb = written(blocks(left), "blocks")
    if right is None:
        rb, right, rule = lb, left, F.col("a") < F.col("b")
    else:
        rb, rule = written(blocks(right), "blocks"), F.col("a") != F.col("b")
    met = lb.withColumnRenamed("id", "a").join(rb.withColumnRenamed("id", "b"), "block").filter(rule).select("a", "b").distinct()
    met = written(met, "met")
    met = met.join(left.select(F.col("id").alias("a"), F.col("core").alias("ca")), "a").join(right.select(F.col("id").alias("b"), F.col("core").alias("cb")), "b")
    return written(met.select("a", "b", "ca", "cb").mapInArrow(_distances, "a bigint, b bigint, d int, swap boolean, n int").filter("d <= 2"), "near")


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """(id, comp): the least id of each node's component, for nodes with an edge. Labels spread along edges and jump
    to their label's label, so rounds grow with the logarithm of a component's width."""
    both = written(edges.selectExpr("a", "b").unionAll(edges.selectExpr("b as a", "a as b")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("comp")), "labels")
    for _ in range(most):
        around = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("comp").alias("low"))
        step = labels.join(around, labels["id"] == around["a"]).select("id", F.least("comp", "low").alias("comp"), F.col("comp").alias("old"))
        jump = step.select(F.col("id").alias("to"), F.col("comp").alias("root"))
        new = step.join(jump, step["comp"] == jump["to"], "left").select("id", F.least("comp", F.coalesce("root", "comp")).alias("comp"), "old")
        new = written(new, "labels")
        labels = new.select("id", "comp")
        if not new.filter("comp <> old").limit(1).count():
            return labels
    raise RuntimeError(f"components: labels still change after {most} steps")


def spellings(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, names): the spellings of every row of both tables."""
    e = entities.filter("id is not null").select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("key"), F.array("normalized_name", "original_name").alias("names"))
    a = aliases.filter("id is not null").select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("key"), F.array("alias_name").alias("names"))
    return e.unionByName(a)


def _initials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds what a given name implies: its initial and its gender."""
    sex = {n: "m" for n in MALE} | {n: "f" for n in FEMALE}
    for b in batches:
        names = b.column("given").to_pylist()
        yield pa.RecordBatch.from_arrays([b.column("given"), pa.array([initial_of(n) for n in names], pa.string()), pa.array([sex.get(n, "") for n in names], pa.string())], names=["given", "first", "sex"])


def resolve(names: DataFrame) -> DataFrame:
    """(key, entity) of (key, names): rows of one entity share the number; rows that name nothing are left out."""
    read = names.mapInArrow(_read, PROFILE)
    qual = F.array_join("quals", "+")
    full = (F.col("kind") == "person") & (F.size("quals") == 1)
    sure = F.when(full, F.lit("")).otherwise(F.col("gender"))  # a given name decides the gender
    read = written(read.withColumn("gender", sure).withColumn("id", F.xxhash64("kind", "core", qual, "initial", "gender")), "profiles")
    profiles = written(read.groupBy("id").agg(F.first("kind").alias("kind"), F.first("core").alias("core"), F.first("quals").alias("quals"), F.first("initial").alias("initial"), F.first("gender").alias("gender"), F.count_distinct("key").alias("rows")), "distinct")
    # Two spellings of one record: all its profiles are one.
    same = read.groupBy("key").agg(F.min("id").alias("a"), F.collect_set("id").alias("ids")).filter(F.size("ids") > 1).select("a", F.explode("ids").alias("b")).filter("a <> b").distinct()
    # Misspelt cores under equal qualifiers.
    stratum = F.concat_ws("|", "kind", qual, "initial", "gender")
    cores = profiles.select("id", stratum.alias("stratum"), "core", full.alias("wide"))
    # Full names are compared a second time with the surname's ending as it stands: slips occur there too.
    cores = written(cores, "cores")
    whole = read.filter(full).groupBy("id").agg(F.min("raw").alias("core")).join(cores.select("id", "stratum", "wide"), "id").select("id", "stratum", "core", "wide")
    whole = written(whole, "whole")
    slips = near_pairs(cores).join(cores.select(F.col("id").alias("a"), "wide"), "a")
    slips = slips.filter("n >= 5 and (d <= 1 or (n >= 8 and swap) or (wide and n >= 10))").select("a", "b")
    slips = slips.unionByName(near_pairs(whole).filter("d <= 1 or swap or n >= 11").select("a", "b"))
    # Misspelt words of an institution change its code: it joins the best supported code of the town within one edit.
    inst = written(profiles.filter("kind = 'inst'").select("id", F.col("core").alias("stratum"), F.col("quals")[0].alias("core"), F.lit(False).alias("wide"), "rows"), "inst")
    met = near_pairs(inst.drop("rows"), inst.drop("rows")).filter("d <= 1").select("a", "b")
    two = met.join(inst.select(F.col("id").alias("a"), F.col("core").alias("ca"), F.col("rows").alias("na")), "a").join(inst.select(F.col("id").alias("b"), F.col("core").alias("cb"), F.col("rows").alias("nb")), "b")
    two = two.filter("length(ca) >= 3 and (na < nb or (na = nb and ca > cb))").filter(F.levenshtein("ca", "cb", 1) >= 0)
    two = two.select("a", F.struct(F.col("nb").alias("n"), F.col("cb").alias("c"), "b").alias("to"))
    codes = written(two.groupBy("a").agg(F.max("to").alias("to")).select("a", F.col("to.b").alias("b")), "codes")
    same, slips = written(same, "same"), written(slips, "slips")
    found = components(same.unionByName(slips).unionByName(codes))
    things = True
    while True:  # each round merges two components at least, so the rounds end
        more = _rematch(profiles, found)
        if things:  # people's merges change nothing for the others
            again = written(_rematch_things(profiles, found), "things-met")
            things = again.limit(1).count() > 0
            more = more.unionByName(again) if things else more
        more = written(more, "more")
        if not more.limit(1).count():
            break
        own = found.select(F.col("id").alias("k"), "comp")
        ends = more.join(own, F.col("a") == F.col("k"), "left").select(F.coalesce("comp", "a").alias("a"), "b").join(own, F.col("b") == F.col("k"), "left")
        found = written(_contracted(found, components(ends.select("a", F.coalesce("comp", "b").alias("b")))), "found")
    return read.select("key", "id").join(found, "id", "left").select("key", F.coalesce("comp", "id").alias("entity")).distinct()


def _contracted(found: DataFrame, joined: DataFrame) -> DataFrame:
    """``found`` (id, comp) after components were joined: ``joined`` is (id, comp) over its numbers and those of single profiles."""
    to = joined.select(F.col("id").alias("was"), F.col("comp").alias("now"))
    moved = found.join(to, found["comp"] == to["was"], "left").select("id", F.coalesce("now", "comp").alias("comp"))
    return moved.unionByName(joined.join(found.select("id"), "id", "left_anti"))


def _rematch_things(profiles: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b): new merges of companies, institutions, places, events, concepts. A merged record has every core with every
    qualifier of its spellings, so it meets those that share any core (within a slip) and any qualifier of its kind."""
    things = profiles.filter("kind <> 'person'").join(found, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    united = things.groupBy("comp", "kind").agg(F.collect_set("core").alias("cores"), F.collect_set(F.array_join("quals", "+")).alias("quals"))
    every = united.select("comp", "kind", F.explode("cores").alias("core"), "quals").select("comp", "kind", "core", F.explode("quals").alias("qual"))
    every = every.select("comp", F.concat_ws("|", "kind", "qual").alias("stratum"), "core")
    every = written(every.withColumn("id", F.xxhash64("comp", "stratum", "core")).withColumn("wide", F.lit(False)), "things")
    near = near_pairs(every.select("id", "stratum", "core", "wide")).join(every.select(F.col("id").alias("a"), F.col("comp").alias("x")), "a")
    near = near.filter("n >= 5 and (d <= 1 or (n >= 8 and swap))").join(every.select(F.col("id").alias("b"), F.col("comp").alias("y")), "b").select("x", "y")
    # The same core and qualifier in two records: one row a group, to its least record.
    same = every.groupBy("stratum", "core").agg(F.min("comp").alias("y"), F.collect_set("comp").alias("all")).filter(F.size("all") > 1).select(F.explode("all").alias("x"), "y")
    return near.unionByName(same).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _rematch(profiles: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b): new merges of people known by an initial or a bare surname with the one richer profile they fit."""
    people = profiles.filter("kind = 'person'").join(found, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    merged = people.groupBy("comp").agg(
        F.collect_set("core").alias("cores"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.size("quals") == 1, F.col("quals")).otherwise(F.array().cast("array<string>"))))).alias("givens"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.size("quals") > 1, F.col("quals")).otherwise(F.array().cast("array<string>"))))).alias("options"),
        F.collect_set(F.when(F.col("initial") != "", F.col("initial"))).alias("initials"),
        F.collect_set(F.when(F.col("gender") != "", F.col("gender"))).alias("genders"),
    )
    given = merged.select("comp", F.explode("givens").alias("given"))
    meaning = given.select("given").distinct().mapInArrow(_initials, "given string, first string, sex string")
    implied = given.join(meaning, "given").groupBy("comp").agg(F.collect_set("first").alias("firsts"), F.collect_set(F.when(F.col("sex") != "", F.col("sex"))).alias("sexes"))
    none = F.array().cast("array<string>")
    merged = merged.join(implied, "comp", "left").withColumn("initials", F.array_union("initials", F.coalesce("firsts", none))).withColumn("genders", F.when(F.size(F.coalesce("sexes", none)) > 0, F.col("sexes")).otherwise(F.col("genders")))
    merged = written(merged.drop("firsts", "sexes"), "merged")
    rank = F.when(F.size("givens") > 0, 2).when((F.size("initials") > 0) | (F.size("options") > 0), 1).otherwise(0)
    merged = merged.withColumn("rank", rank)
    one = written(merged.select(F.col("comp"), F.explode("cores").alias("core"), "rank").withColumn("id", F.xxhash64("comp", "core")), "one")
    poor = one.filter("rank < 2").select("id", F.lit("p").alias("stratum"), "core", F.lit(False).alias("wide"))
    rich = one.filter("rank > 0").select("id", F.lit("p").alias("stratum"), "core", F.lit(False).alias("wide"))
    pairs = near_pairs(poor, rich).filter("d <= 1")
    # Equal cores count whether or not the comparison above met them under one id.
    side = one.select(F.col("id"), "comp")
    met = pairs.join(side.select(F.col("id").alias("a"), F.col("comp").alias("x")), "a").join(side.select(F.col("id").alias("b"), F.col("comp").alias("y")), "b")
    equal = one.filter("rank < 2").select(F.col("comp").alias("x"), "core").join(one.filter("rank > 0").select(F.col("comp").alias("y"), "core"), "core").select("x", "y", F.lit(0).alias("d"))
    met = met.select("x", "y", "d").unionByName(equal).filter("x <> y").groupBy("x", "y").agg(F.min("d").alias("d"))
    met = written(met, "met")
    l = merged.select(*[F.col(c).alias(f"x_{c}") for c in ("comp", "givens", "options", "initials", "genders", "rank")])
    r = merged.select(*[F.col(c).alias(f"y_{c}") for c in ("comp", "givens", "options", "initials", "genders", "rank")])
    met = met.join(l, F.col("x") == F.col("x_comp")).join(r, F.col("y") == F.col("y_comp")).filter("x_rank < y_rank")
    free = lambda a, b: (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)
    fits = met.filter(free("x_initials", "y_initials") & ((F.size("x_options") == 0) | (F.size("y_givens") == 0) | F.arrays_overlap("x_options", "y_givens")) & free("x_genders", "y_genders"))
    fits = written(fits.select("x", "y", "d"), "fits")
    # The nearest core counts; among equals there must be only one.
    w = fits.groupBy("x").agg(F.min("d").alias("least"))
    only = fits.join(w, "x").filter("d = least").groupBy("x").agg(F.count_distinct("y").alias("n"), F.min("y").alias("y")).filter("n = 1")
    return only.select(F.col("x").alias("a"), F.col("y").alias("b"))


def linked_pairs(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key_a, key_b), key_a < key_b as strings: every two rows of one entity."""
    links = written(resolve(spellings(entities, aliases)), "links")
    a = links.select(F.col("key").alias("key_a"), "entity")
    b = links.select(F.col("key").alias("key_b"), "entity")
    return a.join(b, "entity").filter("key_a < key_b").select("key_a", "key_b").distinct()
