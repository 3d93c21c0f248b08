"""PII surrogates: keyed, type-consistent replacements, in Spark expressions only.

Entities are found by one pattern per type, in order of precedence.  An entity
has a canonical form (lower case, without separators of numbers), so that its
spellings share a surrogate; the surrogate is laid out in the format found:
separators, case and length stay, each symbol is replaced within its class
(digits, vowels, consonants of the Latin script, accented Latin letters, Greek,
Cyrillic; other letters become Latin consonants), card numbers and IBANs keep
valid check digits, an address keeps valid octets, an IPv6 address is written in
full, a country code, a trunk 0 and a mail suffix stay.

People are found after a title or a phrase that introduces a name: up to three
given names or initials, particles (von, de la, ...) and the last word, which is the
surname.  Then the words of these names are found wherever else they stand in the
document: a first name where other given names or initials lead on to a surname,
and a surname by itself, but where it is an ordinary word: before a capitalised
word that is no such name (White House), and at the start of a sentence if the
document has it in lower case too.  Surnames and first names are entities of their
own, so a surname has one surrogate whatever stands before it.  Titles, initials,
particles and a possessive 's stay; apostrophes of both kinds and combining marks
belong to a name and stay in their places.  First names are built from syllables in the script of the
original, with an ending of the gender that titles tell: of one found with
several, the title that tells a gender counts, and of both genders neither.

The symbols go through a four-round Feistel network whose round functions are
keyed hashes.  It permutes the strings of one type and pattern, so different
entities get different surrogates by construction; first names and values that
the network maps onto themselves or onto an entity of the corpus do not have
that protection.  So all distinct entities are checked against each other and
against the corpus, and those that collide draw again with another salt until
none is left.  Only such exceptions are joined back to the documents.

Forms found: mail in Latin, Greek and Cyrillic letters; IBANs; phones with a plus
sign, with an area code in brackets, as 3-3-4 digits (after a 1 or not), with a
trunk 0 and groups, or as any ten digits in a row; SSNs with hyphens; IPv4, and
IPv6 with a decimal digit in it; cards in fours, as 4-6-4 and 4-6-5 or in a row;
people as said above.  Other forms are left as they are.

Defined results: a null text stays null; all that is no entity stays byte for
byte, private-use characters too; texts of any length are handled whole; rows
with equal, repeated or null ids get equal results for equal texts; an empty
table gives an empty result; extra columns are kept.  They are written as
Parquet on the way, so their types must be ones that it holds, or void.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm._native import SENTINEL, STAND_IN, cut_at, let
from wordloom.llm._shared import spool

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_H = "[0-9A-Fa-f]{1,4}"
#: Eight groups, or fewer around '::'; one decimal digit at least, which words around '::' in code lack.
_GROUPS = "|".join([rf"(?:{_H}:){{7}}{_H}", *(rf"(?:{_H}:){{1,{7 - k}}}(?::{_H}){{1,{k}}}" for k in range(1, 7)), rf":(?::{_H}){{1,7}}", rf"(?:{_H}:){{1,7}}:"])
_IPV6 = rf"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*[0-9])(?:{_GROUPS})(?![0-9A-Za-z:]|\.[0-9])"
#: Scripts written with spaces, so that a mail address does not run on into the words beside it.
_LETTER = r"\p{IsLatin}\p{IsGreek}\p{IsCyrillic}"
_MAIL = rf"{_LETTER}\p{{M}}0-9"
#: Without a plus sign or brackets: 3-3-4 digits, a trunk 0 and groups, or ten digits in a row.
_LOCAL_PHONE = "|".join((
    r"(?<![0-9.-])(?:1[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    r"(?<![0-9A-Za-z.+/-])0(?:[0-9]{1,4}[ /-][0-9]{5,8}|[0-9]{2,4}[ ./-][0-9]{3,4}[ ./-][0-9]{3,4}|[0-9](?:[ .-][0-9]{2}){4})(?![0-9-])",
    r"(?<![0-9A-Za-z.,+_-])(?:1[ .-])?[0-9]{10}(?![0-9A-Za-z_-]|[.,][0-9])",
))
#: A capital and more letters with their marks; a hyphen or an apostrophe goes on to a letter, but for a possessive s.
_NAME = r"\p{Lu}(?=[\p{L}\p{M}]|['’-]\p{Lu})[\p{L}\p{M}]*+(?:(?:-|['’](?![sS](?![\p{L}\p{M}])))[\p{L}\p{M}]++)*+"
_INITIAL = r"(?:\p{Lu}\p{M}*\.-?)++"
#: What stands between given names and a surname (fixed values).
PARTICLES = "von van vom zu zum zur der den dem de du des da do dos di del della la le el al bin ibn ben ter ten af av".split()
_PARTICLE = f"(?:{'|'.join(PARTICLES)})"
#: Titles that tell a gender or none, and phrases that introduce a name (fixed values).
TITLES = {
    "m": "Mr Sir Herr Señor Sr Monsieur Don".split(),
    "f": "Mrs Ms Miss Frau Señora Sra Madame Mme Doña".split(),
    "x": "Dr Prof".split(),
}
CUES = "my name is|My name is|Name:|Signed,|Sincerely,|Regards,|Author:|Contact:|Attn:|Mein Name ist|mein Name ist|Ich heiße|ich heiße|Je m'appelle|je m'appelle|Me llamo|me llamo".split("|")
_TITLE = {gender: rf"(?:{'|'.join([*titles, *(t.upper() for t in titles)])})\.?" for gender, titles in TITLES.items()}
_ANY_TITLE = "|".join(_TITLE.values())
_BEFORE_NAME = f"(?:{_ANY_TITLE}|{'|'.join(CUES)}) "
#: First letters, vowels and endings by gender of first names, for each script (fixed values).
SYLLABLES = {
    "latin": ("bdfghjklmnprstvz", "aeiou", {"m": "n r s k l", "f": "na ra la ia sa", "x": "y e i o en"}),
    "greek": ("βγδζθκλμνπρσστφχ", "αεηιο", {"m": "ς ν ρης νος μος", "f": "να ρα λα ια σα", "x": "ι ε ο ην ις"}),
    "cyrillic": ("бвгдзклмнпрстфжх", "аеиоу", {"m": "н р с к л", "f": "на ра ла ия са", "x": "и е о ей ен"}),
}
#: (type, pattern), in order of precedence.
TYPES = (
    ("email", rf"(?<![{_MAIL}._%+-])[{_MAIL}._%+-]+@[{_MAIL}-]+(?:\.[{_MAIL}-]+)*\.[{_LETTER}]{{2,}}"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("phone", r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,4}(?![0-9])|" + _LOCAL_PHONE),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("ip", rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])|{_IPV6}"),
    ("card", r"(?<![0-9A-Za-z])(?:[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9A-Za-z])"),
    ("person", rf"(?<!\p{{L}}){_BEFORE_NAME}(?!(?:{_ANY_TITLE}) )(?:(?:{_NAME}|{_INITIAL}) ){{0,3}}(?:{_PARTICLE} ){{0,3}}{_NAME}"),
)
ANY = "|".join(f"(?:{p})" for _, p in TYPES)
#: Classes of symbols; a symbol is replaced by one of its class.
CLASSES = ("0123456789", "aeiouy", "bcdfghjklmnpqrstvwxz", "àáâãäåæèéêëìíîïòóôõöøœùúûüýÿ", "çñßðþš", "αεηιουωάέήίόύώ", "βγδζθκλμνξπρσςτφχψ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь")
#: Numbers of what has no string in CLASSES: octets, letters of other scripts (by code point), nibbles of IPv6.
OCTET, OTHER, NIBBLE = -1, -2, -3
HEX = "0123456789abcdef"
ROUNDS = 4
#: Digits of a phone number that stay: those after its plus sign, up to a separator, a 1 before one, and a trunk 0.
_KEPT_HEAD = {"phone": r"^(?:\+[0-9]{1,3}(?=[ .(-])|1(?=[ .-])|0)", "iban": r"^[A-Z]{2}[0-9]{2}"}


#: Every person has one of these; every other entity holds a digit or an at sign.
_HINTS = tuple(dict.fromkeys([*(x for titles in TITLES.values() for t in titles for x in (t, t.upper())), *CUES]))
#: Words that may be names that the document has elsewhere.
_WORDS = rf"(?<![\p{{L}}\p{{M}}\p{{N}}'’-]){_NAME}(?: (?:{_NAME}|{_INITIAL}))*+"
#: A sentinel in a text is written as two other characters while the text is cut.
_MARK_B, _MARK_C = "\ue002", "\ue003"


def _escaped(text: Column) -> Column:
    safe = F.replace(F.replace(text, F.lit(STAND_IN), F.lit(STAND_IN + _MARK_B)), F.lit(SENTINEL), F.lit(STAND_IN + _MARK_C))
    return F.when(text.contains(SENTINEL) | text.contains(STAND_IN), safe).otherwise(text)


def _restored(piece: Column) -> Column:
    raw = F.replace(F.replace(piece, F.lit(STAND_IN + _MARK_C), F.lit(SENTINEL)), F.lit(STAND_IN + _MARK_B), F.lit(STAND_IN))
    return F.when(piece.contains(STAND_IN), raw).otherwise(piece)


def _cut(text: Column) -> Column:
    """The text cut at its entities; one without any hint of them is a single piece, which saves the long pattern."""

    def cut(t: Column) -> Column:
        hint = t.rlike("[0-9@]")
        for word in _HINTS:
            hint = hint | t.contains(word)
        return F.when(hint, cut_at(t, ANY)).otherwise(F.array(t))

    return let(_escaped(F.coalesce(text, F.lit(""))), cut)


def _type(piece: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(TYPES):
        kind = F.when(piece.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(kind)
    return kind


def _entity(kind: Column, head: Column, body: Column, tail: Column, gender: Column) -> Column:
    return F.struct(kind.alias("kind"), head.alias("head"), body.alias("body"), tail.alias("tail"), gender.alias("gender"))


def _name(kind: str, body: Column, gender: Column) -> Column:
    return _entity(F.lit(kind), F.lit(""), body, F.lit(""), gender)


def _frame(kind: Column, piece: Column) -> Column:
    """struct<kind, head, body, tail, gender>: what stays, what is replaced, what stays; not for names."""
    head = F.lit("")
    for name, pattern in _KEPT_HEAD.items():
        head = F.when(kind == name, F.regexp_extract(piece, pattern, 0)).otherwise(head)
    tail = F.when(kind == "email", F.regexp_extract(piece, rf"\.[{_LETTER}]{{2,}}$", 0)).otherwise(F.lit(""))

    def split(x: Column) -> Column:
        size = F.char_length(piece) - F.char_length(x["head"]) - F.char_length(x["tail"])
        return _entity(kind, x["head"], piece.substr(F.char_length(x["head"]) + 1, size), x["tail"], F.lit(None).cast("string"))

    return let(F.struct(head.alias("head"), tail.alias("tail")), split)


def _found(title: Column, given: Column, entity: Column) -> Column:
    """What a piece holds: a kept title, the words before a surname (first names, and with a null e what stays) and the entity proper."""
    return F.struct(title.alias("title"), given.alias("given"), entity.alias("e"))


_E = "struct<kind:string,head:string,body:string,tail:string,gender:string>"
_GIVEN = f"array<struct<w:string,e:{_E}>>"
_FOUND = f"struct<title:string,given:{_GIVEN},e:{_E}>"
_PIECE = f"struct<before:string,p:string,x:{_FOUND}>"


def _framed(piece: Column) -> Column:
    none = F.array().cast(_GIVEN)

    def person(x: Column) -> Column:
        rest = piece.substr(F.char_length(x["title"]) + 1, F.char_length(piece))
        gender = F.lit("x")
        for key in ("m", "f"):
            gender = F.when(x["title"].rlike(f"^{_TITLE[key]} $"), F.lit(key)).otherwise(gender)

        def named(y: Column) -> Column:
            words = F.split(y["rest"], " ")
            given = lambda w: F.struct(w.alias("w"), F.when(w.rlike(f"^{_NAME}$"), _name("first", w, y["gender"])).cast(_E).alias("e"))
            return _found(x["title"], F.transform(F.slice(words, 1, F.size(words) - 1), given).cast(_GIVEN), _name("person", F.element_at(words, -1), F.lit(None).cast("string")))

        return let(F.struct(rest.alias("rest"), gender.alias("gender")), named)

    def of(kind: Column) -> Column:
        title = F.regexp_extract(piece, f"^{_BEFORE_NAME}", 0)
        return F.when(kind == "person", let(F.struct(title.alias("title")), person)).otherwise(_found(F.lit(""), none, _frame(kind, piece)))

    return let(_type(piece), of).cast(_FOUND)


def _piece(before: Column, p: Column, x: Column) -> Column:
    return F.struct(before.alias("before"), p.alias("p"), x.cast(_FOUND).alias("x")).cast(_PIECE)


def _pieces(text: Column) -> Column:
    """array<struct<before, p, x>>: the text in order, x what is found in p or null."""
    nothing = F.lit(None).cast(_FOUND)
    cut = F.transform(_cut(text), lambda p, i: _piece(F.lit(""), p, F.when(i % 2 == 1, _framed(p)).otherwise(nothing)))

    def with_names(pieces: Column) -> Column:
        people = F.filter(pieces, lambda c: c["x"]["e"]["kind"] == "person")
        key = lambda e: F.lower(e["body"])
        surnames = F.array_distinct(F.transform(people, lambda c: key(c["x"]["e"])))
        given = F.flatten(F.transform(people, lambda c: F.filter(c["x"]["given"], lambda g: g["e"].isNotNull())))
        firsts = F.array_distinct(F.transform(given, lambda g: F.struct(key(g["e"]).alias("key"), g["e"]["gender"].alias("gender"))))
        # surnames that the document also has as ordinary words
        common = F.filter(surnames, lambda n: F.exists(pieces, lambda c: c["x"].isNull() & F.contains(c["p"], F.concat(F.lit(" "), n, F.lit(" ")))))

        def again(names: Column) -> Column:
            """Pieces without entities, cut anew at words that are such names."""

            def word(words: Column, w: Column, i: Column, opens: Column) -> Column:
                before = F.when(i > 0, F.lit(" ")).otherwise(F.lit(""))
                low = F.lower(w)
                at = lambda k: F.lower(F.get(words, i + k))
                is_surname = lambda x: F.coalesce(F.array_contains(names["surnames"], x), F.lit(False))
                is_first = lambda x: F.exists(names["firsts"], lambda f: f["key"] == x)
                goes_on = lambda k: F.coalesce(is_first(at(k)) | F.get(words, i + k).rlike(f"^{_INITIAL}$"), F.lit(False))
                leads = is_surname(at(1)) | (goes_on(1) & (is_surname(at(2)) | (goes_on(2) & is_surname(at(3)))))
                own = F.when(leads, F.get(F.filter(names["firsts"], lambda f: f["key"] == low), F.lit(0)))
                after_first = (i > 0) & F.coalesce(is_first(F.lower(F.get(words, F.greatest(i - 1, F.lit(0))))), F.lit(False))
                before_noun = F.get(words, i + 1).isNotNull() & ~is_surname(at(1)) & ~goes_on(1) & (w != F.upper(w))
                ordinary = (before_noun | (opens & (i == 0) & F.array_contains(names["common"], low))) & ~after_first
                hit = lambda e: _found(F.lit(""), F.array().cast(_GIVEN), e).cast(_FOUND)
                surname = is_surname(low) & ~ordinary
                return let(own, lambda f: _piece(before, w, F.when(f.isNotNull(), hit(_name("first", w, f["gender"]))).when(surname, hit(_name("person", w, F.lit(None).cast("string")))).otherwise(nothing)))

            def run(parts: Column, q: Column, i: Column, start: Column) -> Column:
                left = F.get(parts, F.greatest(i - 1, F.lit(0)))
                opens = left.rlike("[.!?]['\"”’)]*\\s*$") | (start & (i == 1) & (F.trim(left) == ""))
                each = let(F.struct(F.split(q, " ").alias("words"), opens.alias("opens")), lambda y: F.transform(y["words"], lambda w, k: word(y["words"], w, k, y["opens"])))
                return F.when(i % 2 == 1, each).otherwise(F.array(_piece(F.lit(""), q, nothing)))

            plain = lambda c, n: let(cut_at(c["p"], _WORDS), lambda parts: F.flatten(F.transform(parts, lambda q, i: run(parts, q, i, n == 0))))
            return F.flatten(F.transform(pieces, lambda c, n: F.when(c["x"].isNull(), plain(c, n)).otherwise(F.array(c))))

        kept = F.struct(surnames.alias("surnames"), firsts.alias("firsts"), common.alias("common"))
        return F.when(F.size(people) == 0, pieces).otherwise(let(kept, again))

    return let(cut, with_names)


def _class(c: Column) -> Column:
    found = F.when(c.rlike(r"^\p{L}$"), F.lit(OTHER))
    for k, symbols in enumerate(CLASSES):
        found = F.when(F.position(c, F.lit(symbols)) > 0, F.lit(k)).otherwise(found)
    return found


def _symbols(x: Column) -> Column:
    """The replaceable symbols of a body: array<struct<v, n, k>>, value, size and number of the class.

    An IPv4 address is four symbols of size 256, an IPv6 address 32 of size 16, written out in full.
    """
    letters = F.filter(F.transform(F.split(F.lower(x["body"]), ""), lambda c: F.struct(c.alias("c"), _class(c).alias("k"))), lambda s: s["k"].isNotNull())
    names = F.array(*[F.lit(c) for c in CLASSES])
    plain = F.transform(
        letters,
        lambda s: F.struct(
            F.when(s["k"] == OTHER, F.ascii(s["c"])).otherwise(F.position(s["c"], F.get(names, s["k"])) - 1).alias("v"),
            F.when(s["k"] == OTHER, F.lit(0x110000)).otherwise(F.char_length(F.get(names, s["k"]))).alias("n"),
            s["k"].alias("k"),
        ),
    )
    octets = F.transform(F.split(x["body"], r"\."), lambda o: F.struct(o.cast("int").alias("v"), F.lit(256).alias("n"), F.lit(OCTET).alias("k")))
    return F.when((x["kind"] == "ip") & x["body"].contains(":"), _nibbles(x["body"])).when(x["kind"] == "ip", octets).otherwise(plain)


def _nibbles(body: Column) -> Column:
    """The 32 symbols of an IPv6 address, whatever its spelling."""
    groups = lambda p: F.filter(F.split(F.coalesce(p, F.lit("")), ":"), lambda g: g != "")
    sides = F.split(F.lower(body), "::")
    left, right = groups(F.get(sides, F.lit(0))), groups(F.get(sides, F.lit(1)))
    zeros = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0)))
    written = F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.lpad(g, 4, "0")), "")
    digits = F.filter(F.split(written, ""), lambda c: c != "")
    return F.transform(digits, lambda c: F.struct((F.position(c, F.lit(HEX)) - 1).alias("v"), F.lit(16).alias("n"), F.lit(NIBBLE).alias("k")))


def canonical(x: Column) -> Column:
    """The key of an entity: type, kept parts and symbols; case and separators do not count."""

    def key(symbols: Column) -> Column:
        values = F.array_join(F.transform(symbols, lambda s: F.concat_ws(":", s["k"].cast("string"), s["v"].cast("string"))), ",")
        return F.concat_ws("/", x["kind"], _bare(F.concat(x["head"], x["tail"])), values)

    return F.when(x["kind"] == "first", F.concat(F.lit("first/"), _bare(x["body"]))).otherwise(let(_symbols(x), key))


def _bare(kept: Column) -> Column:
    """Kept parts as keys have them: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(kept), "[^\\p{L}0-9]", "")


def _permuted(symbols: Column, key: Column) -> Column:
    """A keyed permutation of the symbol strings of one pattern of classes.  Both arguments are lambda variables."""
    half = F.floor(F.size(symbols) / 2).cast("int")
    seed = F.struct(F.slice(symbols, 1, half).alias("a"), F.slice(symbols, half + 1, F.greatest(F.size(symbols), F.lit(1))).alias("b"))

    def one_round(s: Column, r: Column) -> Column:
        """The left half moves by what a keyed hash makes of the right one; then they change places."""
        pad = F.xxhash64(key, r, F.transform(s["b"], lambda y: y["v"]), F.transform(s["b"], lambda y: y["k"]))

        def moved(p: Column) -> Column:
            step = lambda i: F.pmod(F.xxhash64(p, i), F.lit(1 << 20))
            shifted = lambda y, i: F.struct(F.pmod(y["v"] + step(i), y["n"]).cast("int").alias("v"), y["n"].alias("n"), y["k"].alias("k"))
            return F.struct(s["b"].alias("a"), F.transform(s["a"], shifted).alias("b"))

        return let(pad, moved)

    return let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), seed, one_round), lambda done: F.concat(done["a"], done["b"]))


def _luhn(digits: Column, over_check: bool) -> Column:
    """Luhn sum modulo 10 of an array of digit values (a lambda variable); ``over_check``: the last one is the check digit."""
    shift = 0 if over_check else 1
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, i: F.when(F.pmod(n - i + shift, F.lit(2)) == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.pmod(F.aggregate(doubled, F.lit(0), lambda a, d: a + d), F.lit(10))


def _values(symbols: Column) -> Column:
    return F.transform(symbols, lambda s: s["v"])


def _replaced(x: Column, secret: str, salt: Column) -> Column:
    """Symbols of the surrogate of a framed entity."""
    key = F.sha2(F.concat_ws("/", F.lit(secret), x["kind"], _bare(x["head"]), salt.cast("string")), 256)

    def with_check(bare: Column) -> Column:
        check = let(_values(bare), lambda v: F.pmod(10 - _luhn(v, False), F.lit(10)))
        return F.concat(bare, F.array(F.struct(check.cast("int").alias("v"), F.lit(10).alias("n"), F.lit(0).alias("k"))))

    def of(symbols: Column, k: Column) -> Column:
        valid = (x["kind"] == "card") & (let(_values(symbols), lambda v: _luhn(v, True)) == 0)
        checked = let(F.slice(symbols, 1, F.greatest(F.size(symbols) - 1, F.lit(0))), lambda most: let(_permuted(most, k), with_check))
        return F.when(valid, checked).otherwise(_permuted(symbols, k))

    return let(_symbols(x), lambda symbols: let(key, lambda k: of(symbols, k)))


def _laid_out(x: Column, secret: str, salt: Column) -> Column:
    """The surrogate in the format of the entity, but for a first name."""
    names = F.array(*[F.lit(c) for c in CLASSES])
    symbol = lambda names_of, v: names_of.substr(v + 1, F.lit(1))
    written = F.transform(
        _replaced(x, secret, salt),
        lambda s: F.when(s["k"] == OCTET, s["v"].cast("string"))
        .when(s["k"] == NIBBLE, symbol(F.lit(HEX), s["v"]))
        .when(s["k"] == OTHER, symbol(F.lit(CLASSES[2]), F.pmod(s["v"], F.lit(len(CLASSES[2])))))
        .otherwise(symbol(F.get(names, s["k"]), s["v"])),
    )
    places = F.transform(F.split(x["body"], ""), lambda c: F.struct(c.alias("c"), _class(F.lower(c)).isNotNull().alias("hit")))

    def lay(w: Column) -> Column:
        def put(s: Column, p: Column) -> Column:
            symbol = F.get(w, s["i"])
            cased = F.when(p["c"] != F.lower(p["c"]), F.upper(symbol)).otherwise(symbol)
            return F.struct((s["i"] + p["hit"].cast("int")).alias("i"), F.concat(s["out"], F.when(p["hit"], cased).otherwise(p["c"])).alias("out"))

        start = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))
        quads = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.array_join(F.slice(w, i * 4 + 1, 4), "")), ":")
        quads = F.when(x["body"] != F.lower(x["body"]), F.upper(quads)).otherwise(quads)
        return F.when((x["kind"] == "ip") & x["body"].contains(":"), quads).when(x["kind"] == "ip", F.array_join(w, ".")).otherwise(F.aggregate(places, start, put)["out"])

    body = let(written, lay)
    return F.when(x["kind"] == "iban", let(body, lambda new: F.concat(_iban_head(x, new), new))).otherwise(F.concat(x["head"], body, x["tail"]))


def _mod_97(account: Column) -> Column:
    """Of the number that digits, and letters as 10 to 35, make."""
    step = lambda r, c: F.when(c.rlike("[0-9]"), F.pmod(r * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(r * 100 + F.ascii(c) - 55, F.lit(97)))
    symbols = F.filter(F.split(F.regexp_replace(F.upper(account), "[^A-Z0-9]", ""), ""), lambda c: c != "")
    return F.aggregate(symbols, F.lit(0), step)


def _iban_head(x: Column, body: Column) -> Column:
    """Country and check digits of a new body: valid ones if the old ones were."""
    country, check = x["head"].substr(1, 2), 98 - _mod_97(F.concat(body, x["head"].substr(1, 2), F.lit("00")))
    valid = _mod_97(F.concat(x["body"], x["head"])) == 1
    return F.concat(country, F.lpad(F.when(valid, check).otherwise(F.pmod(check + 1, F.lit(100))).cast("string"), 2, "0"))


def _first_name(x: Column, secret: str, salt: Column) -> Column:
    """Syllables in the script of the name and an ending of its gender; later draws are longer, so there are always enough."""
    scripts = {"greek": r"\p{IsGreek}", "cyrillic": r"\p{IsCyrillic}"}

    def chosen(of: Callable[[str], Column]) -> Column:
        out = of("latin")
        for script, pattern in scripts.items():
            out = F.when(x["body"].rlike(pattern), of(script)).otherwise(out)
        return out

    def ending(script: str) -> Column:
        out = F.lit(SYLLABLES[script][2]["x"])
        for gender in ("m", "f"):
            out = F.when(x["gender"] == gender, F.lit(SYLLABLES[script][2][gender])).otherwise(out)
        return out

    kit = F.struct(chosen(lambda s: F.lit(SYLLABLES[s][0])).alias("onsets"), chosen(lambda s: F.lit(SYLLABLES[s][1])).alias("vowels"), chosen(ending).alias("endings"))

    def part(k: Column, name: Column) -> Column:
        digest = F.sha2(F.concat_ws("/", F.lit(secret), F.lit("first"), _bare(name), salt.cast("string")), 256)

        def built(h: Column) -> Column:
            digit = lambda place, size: F.pmod(F.floor(h / place), F.lit(size)).cast("int")
            syllable = lambda i: F.concat(k["onsets"].substr(digit(80**i, 16) + 1, F.lit(1)), k["vowels"].substr(digit(80**i * 16, 5) + 1, F.lit(1)))
            more = [F.when(salt >= least, syllable(i)).otherwise(F.lit("")) for i, least in ((2, 3), (3, 8))]
            name_of = F.initcap(F.concat(syllable(0), syllable(1), *more, F.get(F.split(k["endings"], " "), digit(80**4, 5))))
            return F.when((F.char_length(name) > 1) & (name == F.upper(name)), F.upper(name_of)).otherwise(name_of)

        return let(F.conv(digest.substr(1, 13), 16, 10).cast("long"), built)

    return let(kit, lambda k: F.array_join(F.transform(F.split(x["body"], "-"), lambda name: part(k, name)), "-"))


def _surrogate_of(x: Column, secret: str, salt: Column) -> Column:
    return F.when(x["kind"] == "first", _first_name(x, secret, salt)).otherwise(_laid_out(x, secret, salt))


def cut_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs``, written, with wordloom_cut: the pieces of a text that holds an entity, which is then null itself; null for all others.

    The long patterns run here and nowhere else; neither the pieces of a text nor
    the text are stored twice.  Columns of type void, which Parquet lacks, are left out.
    """
    held = lambda pieces: F.when(F.exists(pieces, lambda c: c["x"].isNotNull()), pieces)
    cut = docs.withColumn("wordloom_cut", let(_pieces(F.col(text).cast("string")), held))
    void = [f.name for f in docs.schema if f.dataType.typeName() == "void"]
    plain = F.when(F.col("wordloom_cut").isNull(), F.col(text).cast("string") if text in void else F.col(text)).alias(text)
    columns = [c for c in docs.columns if c not in void or c == text]
    return spool(cut.select(*[plain if c == text else F.col(f"`{c}`") for c in columns], "wordloom_cut"), "pii-cut", "snappy")


def entities(cut: DataFrame) -> DataFrame:
    """doc_id and one struct<kind, head, body, tail, gender> with its id for each entity, one row each; ``cut``: of :func:`cut_documents`."""
    hits = F.filter("wordloom_cut", lambda c: c["x"].isNotNull())
    both = lambda c: F.filter(F.concat(F.array(c["x"]["e"]), F.transform(c["x"]["given"], lambda g: g["e"])), lambda e: e.isNotNull())
    found = cut.where("wordloom_cut is not null").select("doc_id", F.explode(F.flatten(F.transform(hits, both))).alias("e"))
    return found.select("doc_id", "e", canonical(F.col("e")).alias("id"))


def salts(found: DataFrame, secret: str, most_rounds: int = 32) -> DataFrame:
    """id, salt, gender of the entities that need another draw (salt > 0) or are found with several genders.

    ``found``: rows of :func:`entities`.  Distinct entities are small beside the
    texts.  A surrogate collides if it is an entity of the corpus or if another
    entity has it; of several, the least id keeps it.
    """
    seen = found.groupBy("id").agg(F.min("e").alias("e"), F.max(F.when(F.col("e.gender") == "m", 1).otherwise(0)).alias("m"), F.max(F.when(F.col("e.gender") == "f", 1).otherwise(0)).alias("f"), F.max(F.when(F.col("e.gender") == "x", 1).otherwise(0)).alias("x"))
    gender = F.when(F.col("e.kind") == "first", F.when(F.expr("m > f"), "m").when(F.expr("f > m"), "f").otherwise("x"))
    distinct = spool(seen.select("id", F.col("e").withField("gender", gender).alias("e"), (F.expr("m + f + x") > 1).alias("mixed")), "pii-entities")
    drawn = distinct.select("id", "e", "mixed", F.lit(0).alias("salt"))
    for _ in range(most_rounds):
        surrogate = _surrogate_of(F.col("e"), secret, F.col("salt"))
        named = F.col("e.kind").isin("first", "person")
        again = F.when(named, F.col("e").withField("body", F.col("new"))).otherwise(_frame(F.col("e.kind"), F.col("new")))
        drawn = spool(drawn.withColumn("new", surrogate).withColumn("new_id", canonical(again)), "pii-draws")
        firsts = drawn.groupBy("new_id").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = drawn.join(firsts, "new_id").where("id <> first").select("id")
        known = drawn.join(distinct.select(F.col("id").alias("new_id")), "new_id", "left_semi").select("id")
        bad = spool(shared.union(known).distinct(), "pii-collisions")
        if bad.isEmpty():
            return drawn.where("salt > 0 or mixed").select("id", "salt", F.col("e.gender").alias("gender"))
        redrawn = bad.withColumn("again", F.lit(1))
        drawn = drawn.join(redrawn, "id", "left").select("id", "e", "mixed", (F.col("salt") + F.coalesce("again", F.lit(0))).alias("salt"))
    raise RuntimeError(f"surrogates still collide after {most_rounds} draws")


def surrogate(docs: DataFrame, secret: str) -> DataFrame:
    """``docs`` with entities in ``text`` replaced, and pii_counts map<type, count>.

    ``secret`` keys the surrogates: who knows it can test guesses of what stood there.
    If ``docs`` has a column pii_counts, it stays and the new one is called wordloom_pii_counts.
    """
    docs_cut = cut_documents(docs)
    found = spool(entities(docs_cut), "pii")
    exceptions = salts(found, secret)
    by_doc = spool(found.join(exceptions, "id").groupBy("doc_id").agg(F.collect_set(F.struct("id", "salt", "gender")).alias("wordloom_salts")), "pii-salts")
    # a written table of exceptions: broadcast only if Spark finds it under its threshold; texts without entities stay where they are
    by_doc = by_doc.withColumnRenamed("doc_id", "wordloom_doc")
    held, plain = docs_cut.where("wordloom_cut is not null"), docs_cut.where("wordloom_cut is null")
    held = held.join(by_doc, held["doc_id"].eqNullSafe(by_doc["wordloom_doc"]), "left").drop("wordloom_doc")
    cut = held.unionByName(plain.withColumn("wordloom_salts", F.lit(None).cast(by_doc.schema["wordloom_salts"].dataType)))
    known = F.coalesce(F.col("wordloom_salts"), F.array().cast("array<struct<id:string,salt:int,gender:string>>"))

    def written(e: Column) -> Column:
        """An entity's surrogate, drawn as its exception says if there is one."""

        def drawn(hit: Column) -> Column:
            gendered = F.when(hit.isNotNull() & (e["kind"] == "first"), e.withField("gender", hit["gender"])).otherwise(e)
            return let(F.struct(gendered.alias("e"), F.coalesce(hit["salt"], F.lit(0)).alias("salt")), lambda y: _surrogate_of(y["e"], secret, y["salt"]))

        exception = F.when(F.size(known) > 0, let(canonical(e), lambda own: F.get(F.filter(known, lambda s: s["id"] == own), F.lit(0))))
        return let(exception, drawn)

    def put(c: Column) -> Column:
        x = c["x"]
        given = F.transform(x["given"], lambda g: F.concat(F.when(g["e"].isNull(), g["w"]).otherwise(written(g["e"])), F.lit(" ")))
        return F.concat(c["before"], F.when(x.isNull(), _restored(c["p"])).otherwise(F.concat(x["title"], F.array_join(given, ""), written(x["e"]))))

    kinds = F.transform(F.filter("wordloom_cut", lambda c: c["x"].isNotNull()), lambda c: c["x"]["e"]["kind"])

    def count(name: str) -> Column:
        return F.coalesce(F.size(F.filter(kinds, lambda k: k == name)), F.lit(0)).cast("long")

    counts = F.map_from_arrays(F.array(*[F.lit(n) for n, _ in TYPES]), F.array(*[count(n) for n, _ in TYPES]))
    name = "wordloom_pii_counts" if "pii_counts" in docs.columns else "pii_counts"
    text = F.when(F.col("wordloom_cut").isNotNull(), F.array_join(F.transform("wordloom_cut", put), "")).otherwise(F.col("text"))
    here = {c: F.col(f"`{c}`") if c in docs_cut.columns else F.lit(None).alias(c) for c in docs.columns}
    kept = [text.alias(c) if c == "text" else here[c] for c in docs.columns]
    return cut.select(*kept, counts.alias(name))
