"""Names: folding, keys, tokens and letter values, as built-in expressions."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bind

#: Letters that do not decompose, and their spelling.
TRANSLITERATED = {"æ": "ae", "Æ": "Ae", "ø": "o", "Ø": "O", "œ": "oe", "Œ": "Oe", "ß": "ss", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ı": "i"}
#: Tokens that tell what kind of club it is, not which.
CLUB_TOKENS = ("fc", "sk", "ps", "nfc", "ac", "as", "cf", "cd", "sc", "fk", "nk", "if", "bk", "afc", "sv", "rc", "ud", "sd", "ca", "cs", "kv", "kf", "ks", "pfc")
#: Tokens that different sources write or leave out.
LOOSE_TOKENS = (
    "fc", "afc", "cf", "sc", "ac", "as", "ssc", "us", "cd", "ud", "sd", "rc", "rcd", "ca", "cs", "sv", "vfb", "vfl", "tsg", "fsv", "bsc", "sk", "fk", "kv", "krc",
    "city", "united", "town", "hotspur", "albion", "athletic", "county", "rovers", "wanderers", "calcio", "club", "de", "del", "la", "le", "1", "04", "05", "1899", "1846", "1909", "1913", "1907")
#: Tokens trimmed at the start or end of a name; the last of them that fits counts.
TRIMMED = ("fc", "sk", "fk", "sc", "cf", "ac", "as", "nk", "hnk", "cd", "ca", "ss", "us", "if")
#: Tokens that never stand for a whole name.
GENERIC = (
    "sporting", "real", "city", "united", "town", "club", "athletic", "atletico", "dynamo", "dinamo", "spartak", "lokomotiv", "olympic", "olympique", "racing", "rapid", "sport", "sportiv", "inter",
    "borussia", "bayer", "fortuna", "victoria", "concordia", "academy", "wanderers", "rovers", "albion", "county", "juniors", "young", "red", "star", "national", "central", "north", "south", "east",
    "west", "new", "san", "santa", "saint", "st", "deportivo", "universidad", "universitatea")
#: Words that say nothing about a name.
STOP_WORDS = (
    "fc", "cf", "sc", "ac", "as", "afc", "cd", "ca", "ss", "us", "sv", "sk", "fk", "nk", "hnk", "if", "bk", "ol", "rc", "sd", "ud", "club", "de", "cp",
    "sl", "rsc", "bc", "sp", "the", "1", "bsc", "vfb", "vfl", "tsg", "aj")
#: Abbreviated tokens and what they stand for.
EXPANSIONS = {"wolves": "wolverhampton", "spurs": "tottenham", "man": "manchester", "utd": "united", "nott": "nottingham"}
#: Names whose tokens differ from source to source, and the other source's name.
ALIASES = {
    "QPR": "Queens Park Rangers", "West Brom": "West Bromwich", "Sheffield Weds": "Sheffield Wednesday", "Ath Madrid": "Atletico Madrid", "Ath Bilbao": "Athletic Bilbao",
    "Paris SG": "Paris Saint-Germain", "Sp Lisbon": "Sporting CP", "Sp Braga": "Braga", "Sp Gijon": "Sporting Gijon", "Ein Frankfurt": "Eintracht Frankfurt", "Espanol": "Espanyol",
    "St Etienne": "Saint Etienne", "Buyuksehyr": "Istanbul Basaksehir", "Hearts": "Heart of Midlothian", "St Truiden": "Sint-Truiden", "AEK": "AEK Athens", "PAOK": "PAOK",
    "Rennes": "Stade Rennais", "Brest": "Stade Brestois", "For Sittard": "Fortuna Sittard", "Goztep": "Goztepe", "Hamburg": "Hamburger SV", "St. Gilloise": "Union Saint-Gilloise",
    "Waasland-Beveren": "Waasland Beveren", "Ad. Demirspor": "Adana Demirspor", "Akhisar Belediyespor": "Akhisar", "M'gladbach": "Borussia Monchengladbach",
    "Fortuna Dusseldorf": "Fortuna Dusseldorf", "Nott'm Forest": "Nottingham Forest", "Sheffield United": "Sheffield United", "Vallecano": "Rayo Vallecano"}


def _decomposed() -> tuple[str, str, dict[str, str]]:
    """All characters whose compatibility decomposition has one ASCII character, those characters, and the letters that have more."""
    one, plain, more = [], [], {}
    for c in map(chr, range(128, sys.maxunicode + 1)):
        to = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() if unicodedata.decomposition(c) else ""
        if len(to) == 1:
            one.append(c)
            plain.append(to)
        elif to and unicodedata.category(c).startswith("L"):
            more[c] = to
    return "".join(one), "".join(plain), more


ACCENTED, PLAIN, LIGATURES = _decomposed()


def _spelled(c: Column, letters: dict[str, str]) -> Column:
    """`c` with each letter of a map spelled out; one lambda, so the plan stays small wherever it is named."""
    pairs = F.array(*[F.struct(F.lit(odd).alias("odd"), F.lit(plain).alias("plain")) for odd, plain in letters.items()])
    return F.aggregate(pairs, c, lambda text, p: F.replace(text, p["odd"], p["plain"]))


def ascii_fold(c: Column) -> Column:
    """Plain letters for accented ones, by Unicode's own decompositions; any other character outside ASCII goes."""
    folded = F.regexp_replace(F.translate(_spelled(c, {**TRANSLITERATED, **LIGATURES}), ACCENTED, PLAIN), r"[^\x00-\x7F]", "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(c)


def _words_fold(c: Column) -> Column:
    """ascii_fold for keys: only letters and digits come out of it, so folding makes no separators."""
    kept = [(odd, plain) for odd, plain in zip(ACCENTED, PLAIN) if plain.isalnum()]
    spelled = _spelled(c, {odd: plain for odd, plain in {**TRANSLITERATED, **LIGATURES}.items() if plain.isalnum()})
    folded = F.translate(spelled, "".join(odd for odd, _ in kept), "".join(plain for _, plain in kept))
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(folded, r"[^\x00-\x7F]", "")).otherwise(c)


def squash(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(_words_fold(c)), "[^a-z0-9]", "")


def tokens(c: Column) -> Column:
    """The squashed words between white space, hyphens, dots and slashes; the text is folded once, before it is split."""
    return F.filter(F.split(F.regexp_replace(F.lower(_words_fold(c)), r"[^a-z0-9\s\-./]", ""), r"[\s\-./]+"), lambda t: t != "")


def core_tokens(c: Column, drop=CLUB_TOKENS) -> Column:
    """The tokens without club words; all of them if nothing is left."""
    core = lambda every: bind(F.filter(every, lambda t: ~t.isin(*drop)), lambda some: F.when(F.size(some) > 0, some).otherwise(every))
    return bind(tokens(c), core)


def core_key(c: Column, drop=CLUB_TOKENS) -> Column:
    return F.array_join(core_tokens(c, drop), "")


def sorted_key(c: Column) -> Column:
    return F.array_join(F.array_sort(tokens(c)), "")


def loose_keys(c: Column) -> Column:
    keys = lambda t: F.array(F.array_join(t, ""), F.array_join(F.array_sort(t), ""), sorted_key(c))
    return F.filter(F.array_distinct(bind(core_tokens(c), keys)), lambda k: k != "")


def candidates(c: Column, alias: Column | None = None) -> Column:
    """Guesses at the spelling a name has elsewhere, likeliest first, each once: its alias without and with spaces, the
    folded name likewise, the name without a club token at an end likewise, its last and its first token if they are of four
    letters or more and not generic."""
    base = F.trim(F.regexp_replace(ascii_fold(c), "[.']", ""))
    parts = F.filter(F.split(base, r"\s+"), lambda t: t != "")
    first, last = (F.try_element_at(parts, F.lit(k)) for k in (1, -1))
    ends = F.array(F.lower(first), F.lower(last))
    token = F.try_element_at(F.filter(F.array(*map(F.lit, TRIMMED)), lambda t: F.array_contains(ends, t)), F.lit(-1))
    short = F.when(token.isNull(), base).otherwise(F.array_join(F.filter(parts, lambda t: F.lower(t) != token), " "))
    single = F.filter(F.array(last, first), lambda t: (F.length(t) >= 4) & ~F.lower(t).isin(*GENERIC))
    forms = [x for text in ([] if alias is None else [alias]) + [base, short] for x in (F.replace(text, F.lit(" "), F.lit("")), text)]
    found = F.concat(F.array(*forms), F.when(F.size(parts) > 1, single).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def as_map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def aliased(c: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """The other source's name for a name that has one, else the name."""
    return F.coalesce(F.try_element_at(as_map(aliases), c), c)


def token_set(c: Column, expansions: dict[str, str] = EXPANSIONS) -> Column:
    """Distinct tokens of two or more letters or digits that are no stop-words, abbreviations spelled out, in order."""
    words = F.filter(F.split(F.lower(_words_fold(c)), "[^a-z0-9]+"), lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS))
    return F.array_sort(F.array_distinct(F.transform(words, lambda t: F.coalesce(F.try_element_at(as_map(expansions), t), t))))


#: The Chaldean letter table, letters by their value from 1 to 8.
SECOND_VALUES = ("AIJQY", "BKR", "CGLS", "DMT", "EHNX", "UVW", "OZ", "FP")


def digit_sum(n: Column) -> Column:
    return F.aggregate(F.split(n.cast("string"), ""), F.lit(0), lambda a, d: a + F.coalesce(d.try_cast("int"), F.lit(0)))


def digital_root(n: Column, masters: bool = True, steps: int = 3) -> Column:
    """Digit sums until one digit is left; 11, 22 and 33 stop it if `masters`."""
    def step(x, _):
        return F.when((x <= 9) | (x.isin(11, 22, 33) if masters else F.lit(False)), x).otherwise(digit_sum(x))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), n.cast("int"), step)


def letter_values(c: Column) -> dict[str, Column]:
    """pyth, chald, soul, express, master and namelen of a name's letters A-Z."""
    letters = F.filter(F.split(F.regexp_replace(F.upper(c), "[^A-Z]", ""), ""), lambda x: x != "")
    pyth = lambda x: (F.ascii(x) - 65) % 9 + 1
    total = lambda arr, f: F.aggregate(arr, F.lit(0), lambda a, x: a + f(x))
    chald = lambda x: sum((F.when(x.isin(*group), i).otherwise(0) for i, group in enumerate(SECOND_VALUES, 1)), F.lit(0))
    full = digital_root(total(letters, pyth))
    return {
        "pyth": full, "chald": digital_root(total(letters, chald), masters=False),
        "soul": digital_root(total(F.filter(letters, lambda x: x.isin(*"AEIOU")), pyth)), "express": full,
        "master": F.when(full.isin(11, 22, 33), 1).otherwise(0), "namelen": F.size(letters)}
