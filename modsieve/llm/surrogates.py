"""Surrogates for personal data, with DataFrame functions only.

Detected entities get keyed replacements of their own kind and format. A replacement is a keyed
permutation without fixed points, so different entities never share one, none stays as it was, and
an entity has the same one everywhere. A four-round Feistel network over the entity's characters
(each within its own class: digits stay digits, letters stay letters of their script and case, in
names vowels stay vowels) takes it to another entity of its shape, one place is moved on by one,
and the network's inverse takes it back. Separators, top-level domains, country codes, titles,
particles and the first digit of an area code or card stay; octets of addresses are permuted as
numbers; check digits of cards and IBANs stay right or wrong as they were.

Names are found by titles (Mr, Frau, Herr Dr., Professor, ...) or a listed given name before them, with
all the capitalised words and initials that follow; by the end of a family name after other capitalised
words (Dmitri Ivanov); and in Chinese, Japanese and Korean by the title after them. Then every
other mention of their words in the same text is one of them too. A name is replaced word by
word, so titled and bare mentions agree; ideographs, syllables and kana move within their blocks. What stays of
a phone number depends on its digits alone, so that all its formats have one surrogate. Listed given names turn into others of their list, so of
the same gender and script; other words keep their last letter, which tells gender in many
languages. A permuted word that meets a listed name is permuted again (as often as there are listed
names of its shape, at most), so the map of all words stays one to one.

The collision check groups the distinct entities by surrogate and raises an error if two share one
or one equals its original.

Defined cases: a null text stays null; a text without entities stays as it is; a null doc_id stays
null; repeated rows are treated alike; very long texts are treated whole; letters that are alone in
their class (in script, case and sound) stay; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Given names by gender and script; titles by gender; particles of names.
NAMES = {
    "f": "anna maria laura julia sofia emma clara elena lucia marta carmen alice louise camille helena katharina petra sabine monika ingrid claire sarah emily olivia grace".split(),
    "m": "john james robert michael thomas peter daniel david martin paul klaus stefan jürgen andreas pierre jean louis antoine carlos miguel javier antonio luis diego oliver".split(),
    "cf": "анна мария елена ольга наталья ирина татьяна светлана".split(),
    "cm": "иван пётр алексей дмитрий сергей андрей михаил николай".split(),
}
LISTED = tuple(n for listed in NAMES.values() for n in listed)
TITLES = "Professorin|Professor|Prof|Doktor|Doctor|Dra|Dr|Dipl\\.-Ing|Ing|Rev|Reverend|Sir|Lady|Lord|Captain|Mrs|Mr|Ms|Miss|Mister|Herrn|Herr|Frau|Monsieur|Madame|Mme|Señora|Señor|Sra|Sr|Doña|Don|Госпожа|Господин"
PARTICLES = ("van", "von", "de", "der", "den", "di", "da", "del", "la", "le")
#: Ends of family names that tell one after another capitalised word, what begins sentences before
#: such words, and titles that follow a name in Chinese, Japanese and Korean.
FAMILY = "ov|ova|ev|eva|sky|ski|ska|skaya|enko|vich|wicz|ović|ić|escu|shvili|dze|oğlu|sson|dottir|poulos|ов|ова|ев|ева|ский|ская|енко|вич"
STARTERS = "In|At|On|To|From|For|With|By|Of|And|But|Or|The|This|That|Near|Im|Am|Bei|Aus|Nach|Von|Zu|Und|Der|Die|Das|Den|Ein|Eine|El|La|Los|Las|Un|Una|En|De|Del|Con|Por|Le|Les|Une|Du|Des|Dans|Et|В|На|Из|От|И"
HONORIFICS = "先生|女士|小姐|太太|教授|博士|老师|老師|さん|様|さま|くん|ちゃん|氏| ?씨| ?님| ?선생님| ?교수님"

_WORD = r"(?:[ODL]['’])?\p{Lu}[\p{L}\p{M}]+"
_WORDS = rf"{_WORD}(?:-{_WORD})?"
#: Loops over words are possessive, as a greedy one takes a stack frame for each word and long runs
#: end the executor. Where a greedy loop would give words back, the pattern says what it gives back to.
_ITEM = rf"(?:{_WORDS}|\p{{Lu}}\.(?:-?\p{{Lu}}\.)*+)"
_MORE = rf"(?:(?: (?:{'|'.join(PARTICLES)})(?= ))*+ {_ITEM})"
_TITLE = rf"(?:(?:{TITLES})\.? )"
_KIN = rf"\p{{Lu}}[\p{{L}}\p{{M}}]*(?:{FAMILY})(?!\p{{L}})"
#: Up to the last family name of a run of items; up to the last top-level domain of a run of labels.
_TO_KIN = rf"(?: (?!{_KIN}){_ITEM})*+ "
_TO_LAST_KIN = rf"(?:{_TO_KIN}(?={_KIN}){_ITEM}(?={_TO_KIN}{_KIN}))*+{_TO_KIN}{_KIN}"
_LABEL = r"[A-Za-z0-9-]++\."
_TO_TLD = rf"(?:(?![A-Za-z]{{2}}){_LABEL})*+"
_TO_LAST_TLD = rf"(?:{_TO_TLD}(?=[A-Za-z]{{2}}){_LABEL}(?={_TO_TLD}[A-Za-z]{{2}}))*+{_TO_TLD}[A-Za-z]{{2,}}"
PATTERNS = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@{_LABEL}{_TO_LAST_TLD}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?=[+(0-9])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3,4}[ .-]?[0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,4}(?![0-9]))",
    "card": r"(?<![0-9A-Za-z])[2-6][0-9]{3}(?:[ -]?[0-9]{4}){3}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])(?=[0-9])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "name": rf"(?<!\p{{L}})(?=\p{{Lu}})(?:{_TITLE}++(?:(?:{'|'.join(PARTICLES)}) )*+{_ITEM}{_MORE}*+|(?:{_TITLE}(?={_TITLE}))++{_ITEM}{_MORE}*+|(?:{'|'.join(n.title() for n in LISTED)}){_MORE}++|(?!(?:{STARTERS}) ){_WORD}{_TO_LAST_KIN})",
    "cjk": rf"(?:[\u4E00-\u9FFF]{{2,4}}?|[\u30A1-\u30FA]{{2,8}}|[\uAC00-\uD7A3]{{2,4}}?)(?:{HONORIFICS})",
}
KINDS = tuple(PATTERNS)
#: Texts without a digit or an at sign hold names only.
_NAMED = "|".join(f"(?:{PATTERNS[k]})" for k in ("name", "cjk"))
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Marks around entities while a text is split, and the escape of marks in the text itself.
MARK, ESCAPE = "", ""


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Alphabet:
    """Classes of characters, each permuted within itself. A character is found by its place among
    all of them; arrays tell its class's start and size."""

    def __init__(self, classes: list[str]) -> None:
        self.classes = classes
        self.all = "".join(classes)
        starts, sizes, at = [0], [0], 0
        for c in classes:
            starts += [at] * len(c)
            sizes += [len(c)] * len(c)
            at += len(c)
        numbers = lambda x: F.split(F.lit(",".join(map(str, x))), ",").cast("array<int>")
        self._numbers = lambda: (numbers(starts), numbers(sizes))

    def permuted(self, s: Column, tweak: Column, free: Column | None = None) -> Column:
        """``s`` with its characters permuted; ``free``: a string of 0 and 1 whose 0 marks places that stay."""
        starts, sizes = self._numbers()
        held = (lambda i: F.substring(free, i + 1, F.lit(1)) == "0") if free is not None else (lambda i: F.lit(False))
        places = F.transform(F.split(s, ""), lambda c, i: F.struct(c.alias("c"), F.when(held(i), 0).otherwise(F.instr(F.lit(self.all), c)).alias("p")))
        start = lambda x: F.get(starts, x["p"])
        back = lambda x, v: F.when(x["p"] > 0, F.substring(F.lit(self.all), (start(x) + v + 1).cast("int"), F.lit(1))).otherwise(x["c"])

        def moved(found: Column) -> Column:
            new = _deranged(F.transform(found, lambda x: x["p"] - 1 - start(x)), F.transform(found, lambda x: F.get(sizes, x["p"])), tweak)
            return F.array_join(F.zip_with(found, new, back), "")

        return _let(places, moved)


def _letters() -> list[str]:
    """Classes of letters by script, age (plain, accented, rare) and sound. Lower and upper case have
    classes of their own, in one order, so that case does not change how a word is permuted."""
    paired: dict[tuple, list[str]] = defaultdict(list)
    single: dict[tuple, list[str]] = defaultdict(list)
    for c in map(chr, [*range(0x41, 0x2E80), *range(0xA640, 0xA7D0), *range(0xAB30, 0xABC0)]):
        kind = unicodedata.category(c)
        if kind not in ("Ll", "Lu"):
            continue
        base = unicodedata.normalize("NFD", c)[0].lower()
        script = unicodedata.name(c).split()[0]
        common = ord(c) < 0x80 or 0xC0 <= ord(c) < 0x180 or 0x370 <= ord(c) < 0x460
        plain = ord(c) < 0x80 or 0x391 <= ord(c) < 0x3CA and base == c.lower() or 0x410 <= ord(c) < 0x450
        key = (script, common, plain, base in "aeiouyæœøαεηιουωаеиоуыэюяіє")
        upper = c.upper()
        if kind == "Ll" and len(upper) == 1 and upper != c and upper.lower() == c:
            paired[key].append(c)
        elif not (kind == "Lu" and len(c.lower()) == 1 and c.lower().upper() == c):
            single[(script, kind, common)].append(c)
    both = ["".join(x) for x in paired.values()]
    return [*both, *(x.upper() for x in both), *("".join(x) for x in single.values())]


_DIGIT, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
PLAIN = Alphabet([_DIGIT, _LOWER, _LOWER.upper()])
SPOKEN = Alphabet([_DIGIT, *_letters()])
_CLASS = {c: k for k, x in enumerate(SPOKEN.classes) for c in x}
#: The most listed names of one shape: so often may a permuted word meet a listed name.
MOST = max(Counter(tuple(_CLASS[c] for c in n[:-1]) + (n[-1],) for n in LISTED).values())


def _round(acc: Column, r: Column, sizes: Column, tweak: Column, sign: int) -> Column:
    """One Feistel round: every other place moves by an amount that the places in between decide."""
    others = F.array_join(F.filter(F.transform(acc, lambda x, i: F.when((i + r) % 2 == 1, F.concat(i.cast("string"), F.lit("="), x.cast("string")))), lambda x: x.isNotNull()), ",")

    def shifted(x: Column, i: Column, seed: Column) -> Column:
        size = F.get(sizes, i)
        add = F.conv(F.substring(F.md5(F.concat_ws("|", seed, i.cast("string"))), 1, 12), 16, 10).cast("long")
        return F.when(((i + r) % 2 == 0) & (size > 0), F.pmod(x + add if sign > 0 else x - F.pmod(add, size), size)).otherwise(x)

    return _let(F.concat_ws("|", tweak, r.cast("string"), others), lambda seed: F.transform(acc, lambda x, i: shifted(x, i, seed))).cast("array<bigint>")


def _deranged(values: Column, sizes: Column, tweak: Column) -> Column:
    """A keyed permutation without fixed points of an array of numbers; places of size 0 stay: four
    rounds, the first place of size 2 or more moved on by one, and the four rounds undone."""

    def turned(size: Column) -> Column:
        there = F.aggregate(F.sequence(F.lit(0), F.lit(3)), values.cast("array<bigint>"), lambda acc, r: _round(acc, r, size, tweak, 1))
        moved = _let(F.array_position(F.transform(size, lambda s: s > 1), F.lit(True)) - 1, lambda first: F.transform(there, lambda x, i: F.when(i == first, F.pmod(x + 1, F.get(size, i))).otherwise(x)))
        return F.aggregate(F.sequence(F.lit(3), F.lit(0), F.lit(-1)), moved.cast("array<bigint>"), lambda acc, r: _round(acc, r, size, tweak, -1))

    return _let(sizes, turned)


def _refilled(s: Column, new: Column, place: str = "[0-9]") -> Column:
    """``s`` with its characters that match ``place`` replaced, one by one, by those of ``new``."""
    return F.array_join(F.zip_with(F.split(s, place, -1), F.split(new, ""), lambda gap, d: F.concat(gap, F.coalesce(d, F.lit("")))), "")


def _luhn(digits: Column) -> Column:
    """The check digit that the digits before the last one ask for."""
    n = F.length(digits)
    total = F.aggregate(
        F.transform(F.split(digits, ""), lambda c, i: F.when(i >= n - 1, 0).when((n - i) % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))), F.lit(0), lambda a, x: a + x
    )
    return F.pmod(-total, F.lit(10))


def _iban_check(country: Column, account: Column) -> Column:
    """The two check digits, as a number, that a country and an account ask for."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: F.when(c.rlike("[0-9]"), acc * 10).otherwise(acc * 100) + value(c)
    rest = F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0), lambda acc, c: F.pmod(step(acc, c), F.lit(97)).cast("int"))
    return F.lit(98) - rest


def _iban(s: Column, tweak: Column) -> Column:
    whole = F.replace(s, F.lit(" "), F.lit(""))
    country, check, account = F.substring(whole, 1, 2), F.substring(whole, 3, 2).cast("int"), F.substring(whole, F.lit(5), F.length(whole))
    digits = lambda new: F.pmod(_iban_check(country, new) + check - _iban_check(country, account), F.lit(100))
    return _let(PLAIN.permuted(account, tweak), lambda new: _refilled(s, F.concat(country, F.lpad(digits(new).cast("string"), 2, "0"), new), "[^ ]"))


def _is_listed(word: Column) -> Column:
    return F.array_contains(F.array(*map(F.lit, LISTED)), F.lower(word)) & ((word == F.initcap(word)) | (word == F.upper(word)))


def _word(word: Column, tweak: Column) -> Column:
    """The surrogate of one word of a name."""
    low = F.lower(word)
    turned = []
    for k, listed in NAMES.items():
        n, names = len(listed), F.array(*map(F.lit, listed))
        shift = F.conv(F.substring(F.md5(F.concat_ws("|", tweak, F.lit(k))), 1, 8), 16, 10).cast("long") % (n - 1) + 1
        other = F.element_at(names, (F.pmod(F.array_position(names, low) - 1 + shift, F.lit(n)) + 1).cast("int"))
        turned.append(F.when(F.array_contains(names, low), F.when(word == F.upper(word), F.upper(other)).otherwise(F.initcap(other))))
    free = lambda w: F.when(F.length(w) > 2, F.concat(F.repeat(F.lit("1"), F.length(w) - 1), F.lit("0"))).otherwise(F.lit("11"))
    walk = F.aggregate(F.sequence(F.lit(0), F.lit(MOST)), word, lambda acc, i: F.when((i == 0) | _is_listed(acc), SPOKEN.permuted(acc, tweak, free(acc))).otherwise(acc))
    return F.when(_is_listed(word), F.coalesce(*turned)).otherwise(walk)


def _bare(s: Column) -> Column:
    """A name without its title."""
    return F.regexp_replace(s, rf"^{_TITLE}++|(?:{HONORIFICS})$", "")


def _wide(s: Column, tweak: Column) -> Column:
    """Ideographs, syllables and kana, each moved within its block of code points (of three bytes in UTF-8)."""
    low = lambda c: F.when(F.ascii(c) >= 0xAC00, 0xAC00).when(F.ascii(c) >= 0x4E00, 0x4E00).otherwise(0x30A1)
    size = lambda c: F.when(F.ascii(c) >= 0xAC00, 11172).when(F.ascii(c) >= 0x4E00, 20992).otherwise(90)
    byte = lambda n: F.lpad(F.hex(n), 2, "0")
    utf8 = lambda n: F.decode(F.unhex(F.concat(byte(F.lit(0xE0).bitwiseOR(F.shiftright(n, 12))), byte(F.lit(0x80).bitwiseOR(F.shiftright(n, 6).bitwiseAND(63))), byte(F.lit(0x80).bitwiseOR(n.bitwiseAND(63))))), "UTF-8")
    letters = F.split(s, "")
    moved = _deranged(F.transform(letters, lambda c: F.ascii(c) - low(c)), F.transform(letters, size), tweak)
    return F.array_join(F.zip_with(letters, moved, lambda c, v: utf8((low(c) + v).cast("long"))), "")


def _country(digits: Column) -> Column:
    """Digits of the country code that a number of eleven digits or more begins with, else 0: by the
    digits alone, so that a number has one, however it is written."""
    three = r"^(?:2[1-69]|3[578]|42|5[09]|6[789]|8[0578]|9[679])"
    return F.when(F.length(digits) < 11, 0).when(digits.rlike("^[17]"), 1).when(digits.rlike(three), 3).otherwise(2)


def surrogate(kind: Column, s: Column, key: Column) -> Column:
    """The replacement of an entity."""
    tweak = F.concat_ws("|", key, kind)
    digits = F.regexp_replace(s, "[^0-9]", "")
    tld = F.length(F.regexp_extract(s, r"\.[A-Za-z]+$", 0))
    email = PLAIN.permuted(s, tweak, F.concat(F.repeat(F.lit("1"), (F.length(s) - tld).cast("int")), F.repeat(F.lit("0"), tld)))
    code = _country(digits)
    phone = _refilled(s, PLAIN.permuted(digits, tweak, F.concat(F.repeat(F.lit("0"), (code + 1).cast("int")), F.repeat(F.lit("1"), (F.length(digits) - code - 1).cast("int")))))
    free = F.concat(F.lit("0"), F.repeat(F.lit("1"), (F.length(digits) - 2).cast("int")), F.lit("0"))
    last = lambda inner: F.pmod(_luhn(inner) + F.substring(digits, -1, 1).cast("int") - _luhn(digits), F.lit(10))
    card = _let(PLAIN.permuted(digits, tweak, free), lambda inner: _refilled(s, F.concat(F.substring(inner, F.lit(1), F.length(inner) - 1), last(inner).cast("string"))))
    ip = F.array_join(_deranged(F.split(s, r"\.").cast("array<bigint>"), F.array(*[F.lit(256)] * 4), tweak).cast("array<string>"), ".")
    bare = _bare(s)
    stays = lambda w: w.isin(" ", "-", *PARTICLES)
    cjk = F.concat(_wide(bare, tweak), F.substring(s, F.length(bare) + 1, F.length(s)))
    words = F.transform(F.split(bare, "(?<=[ -])|(?=[ -])"), lambda w: F.when(stays(w), w).otherwise(_word(w, tweak)))
    name = F.concat(F.substring(s, F.lit(1), F.length(s) - F.length(bare)), F.array_join(words, ""))
    ssn = _refilled(s, PLAIN.permuted(digits, tweak))
    return F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ip", ip).when(kind == "iban", _iban(s, tweak)).when(kind == "ssn", ssn).when(kind == "cjk", cjk).otherwise(name)


def _kind(s: Column) -> Column:
    kinds = [F.when(F.regexp_like(s, F.lit(f"^(?:{PATTERNS[k]})$")), F.lit(k)) for k in KINDS]
    return F.coalesce(*kinds, F.when(s.rlike(r"^[\u30A1-\u30FA\u4E00-\u9FFF\uAC00-\uD7A3]"), F.lit("cjk")).otherwise(F.lit("name")))  # bare mentions


def canonical(kind: Column, s: Column) -> Column:
    """What entities must share to be the same one."""
    return F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(s, "[^0-9]", "")).when(kind == "iban", F.replace(s, F.lit(" "), F.lit(""))).when(kind == "email", F.lower(s)).when(kind.isin("name", "cjk"), _bare(s)).otherwise(s)


def _pattern(text: Column) -> Column:
    """What to look for in a text: entities by pattern, and every word of a name that it holds."""
    names = F.regexp_extract_all(text, F.lit(PATTERNS["name"]), F.lit(0))
    words = F.array_distinct(F.filter(F.flatten(F.transform(names, lambda n: F.split(_bare(n), "[ -]"))), lambda w: ~w.isin(*PARTICLES) & ~w.contains(".") & (F.length(w) > 1)))
    known = F.array_join(F.array_distinct(F.concat(words, F.transform(words, F.upper))), "|")
    wide = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PATTERNS["cjk"]), F.lit(0)), _bare))
    base = F.when(F.regexp_like(text, F.lit("[0-9@]")), F.lit(ANY)).otherwise(F.lit(_NAMED))
    base = F.when(F.size(words) > 0, F.concat(base, F.lit(r"|(?<!\p{L})(?:"), known, F.lit(r")(?!\p{L})"))).otherwise(base)
    return F.when(F.size(wide) > 0, F.concat(base, F.lit("|"), F.array_join(wide, "|"))).otherwise(base)


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_entities, entities): every text with its entities replaced; ``entities``
    has their kinds, originals and surrogates in order. Keep ``key`` secret: who has it can undo
    the permutations."""
    text = F.replace(F.replace(F.col("text").cast("string"), F.lit(ESCAPE), F.lit(ESCAPE + "b")), F.lit(MARK), F.lit(ESCAPE + "a"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    pieces = rows.select("doc_id", F.split(F.regexp_replace("text", _pattern(F.col("text")), F.lit(re.escape(MARK) + "$0" + re.escape(MARK))), MARK, -1).alias("pieces"))
    back = lambda s: F.replace(F.replace(s, F.lit(ESCAPE + "a"), F.lit(MARK)), F.lit(ESCAPE + "b"), F.lit(ESCAPE))
    odd = F.filter("pieces", lambda x, i: i % 2 == 1)
    tagged = pieces.withColumn("found", F.transform(odd, lambda s: F.struct(_kind(s).alias("kind"), s.alias("original"))))
    named = tagged.withColumn("entities", F.transform("found", lambda e: F.struct(e["kind"].alias("kind"), e["original"].alias("original"), surrogate(e["kind"], e["original"], F.lit(key)).alias("surrogate"))))
    even = F.filter("pieces", lambda x, i: i % 2 == 0)
    joined = F.array_join(F.zip_with(even, F.col("entities.surrogate"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    out = written(named.select("doc_id", back(joined).alias("text"), F.coalesce(F.size("entities"), F.lit(0)).cast("long").alias("n_entities"), "entities"), "surrogates")
    # the collision check: distinct entities of a kind with one surrogate, or their own
    every = out.filter("n_entities > 0").select(F.inline("entities"))
    pairs = every.select("kind", canonical(F.col("kind"), F.col("original")).alias("one"), canonical(F.col("kind"), F.col("surrogate")).alias("other")).distinct()
    bad = pairs.groupBy("kind", "other").agg(F.count("*").alias("n"), F.max(F.col("one") == F.col("other")).alias("same")).filter("n > 1 or same").limit(1).collect()
    if bad:
        raise ValueError(f"surrogates of kind {bad[0].kind} collide")
    return out
