"""Surrogates for personal data: keyed, consistent in type, gender, script and format.

Entities are found by patterns: e-mail addresses, telephone, card, social security and account (IBAN) numbers, IP addresses,
secrets (long hexadecimal and prefixed tokens), and names after a form of address, whose parts are replaced one by one, as are
their further mentions in the text; an initial gets a letter, which others may share. An
entity's surrogate is drawn from a keyed digest of its kind and canonical form, letter for letter and digit for digit, so the same
entity has the same surrogate in all documents, however it was spaced or capitalised there; it is then written in the format of
the original. Valid card and account numbers stay valid, invalid ones invalid; names keep gender and script.

Distinctness: all distinct entities are in one table. A surrogate that two entities draw, or that is itself an entity of the
documents, goes to at most one of them; the others draw again, until all have their own. Built-in expressions only.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ohmtide.llm.common import drop_written, join_small, quoted, written
from ohmtide.llm.native import let, positions

FEMALE = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Mme", "Madame", "Mademoiselle", "Sra", "Señora", "Doña", "Signora", "г-жа", "госпожа", "Госпожа", "MRS", "MISS", "FRAU", "MME"]
MALE = ["Mr", "Sir", "Herr", "Monsieur", "Sr", "Señor", "Don", "Signor", "г-н", "господин", "Господин", "MR", "HERR"]
#: Say nothing of gender.
NEUTRAL = ["Dr", "DR", "Prof", "PROF", "Professor", "Доктор", "доктор"]
_F, _M, _N = "|".join(FEMALE), "|".join(MALE), "|".join(NEUTRAL)
_FIRST = "".join(sorted({w[0] for w in FEMALE + MALE + NEUTRAL}))
_ADDRESS = rf"(?<![\p{{L}}\p{{N}}])(?=[{_FIRST}])(?:{_F}|{_M}|{_N})\.? "
#: A part of a name: letters, small or capital, with an apostrophe after the first or before a capital one. Not a second title.
_NAME = rf"(?!(?:{_N})(?![\p{{L}}]))\p{{Lu}}(?:['’]?\p{{L}})(?:\p{{L}}|['’](?=\p{{Lu}})){{0,28}}"
_PARTICLE = "(?:van|von|der|den|de|del|della|la|da|di|zu) "
_PART = rf"(?:{_NAME}[ -]|\p{{Lu}}\.[ -]?|\p{{Lu}}[ -]|{_PARTICLE})"
#: Parts before one that is found. Java looks behind over plain runs and nested options only.
_BEFORE = 7
_BEHIND = ""
for _ in range(_BEFORE):
    _BEHIND = rf"(?:(?:\p{{Lu}}[\p{{L}}'’]{{1,30}}[ -]|\p{{Lu}}\.[ -]?|\p{{Lu}}[ -]|{_PARTICLE}){_BEHIND})?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

#: In the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,8}",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64})(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}+.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?(?:\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\d(?:[ .-]?\d{2,4}){2,4})|(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4})(?![\p{N}])",
    "ssn": r"(?<![\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{N}-])",
    "ip": rf"(?<![\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{N}}]|\.\p{{N}})",
    "ipv6": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![\p{N}])\d(?:[ -]?\d){12,18}(?![\p{N}])",
    "name": rf"(?=\p{{Lu}})(?<={_ADDRESS}{_BEHIND})(?:{_NAME}|\p{{Lu}})(?![\p{{L}}])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Parts of all forms of address and prefixes of tokens: a line without any of them, and without a digit or @, has no entity and is not looked at further.
STEMS = ["Mr", "Ms", "Miss", "Mad", "Frau", "Mme", "Sra", "Señor", "Doña", "Sign", "г-", "оспо", "Sir ", "Herr", "Monsieur", "Sr", "Don ", "MR", "MISS", "MME", "FRAU", "HERR", "Dr", "DR", "Prof", "PROF", "октор", "AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-"]
#: Where entities can be: runs of words (between white space) with a digit or @ in each, a form of address with names, or a
#: token with a known prefix. Looking for
#: these first takes one quick pass; the patterns above then see little of a text. White space bounds a run, so what they look for
#: before and after an entity is the same as in the text.
_DIGITS = r"[^\s0-9@]*+[0-9@]\S*+"
SPAN = rf"(?<!\S){_DIGITS}(?: (?:{_DIGITS}|[A-Z]{{4}}(?= )))*+|{_ADDRESS}{_PART}{{0,{_BEFORE}}}(?:{_NAME}|\p{{Lu}})(?![\p{{L}}])|(?<![\p{{L}}\p{{N}}])(?=[Ags])(?:AKIA|gh[pousr]_|sk-)[0-9A-Za-z]+"
#: What marks an entity's place in a text, and what stands for these two characters where the text itself has them.
MARK, ESCAPE = "\ue000", "\ue001"

ONSETS = ["b", "br", "d", "dr", "f", "g", "gr", "h", "k", "kl", "l", "m", "n", "p", "r", "s", "st", "t", "tr", "v"]
VOWELS = ["a", "e", "i", "o", "u"]
CYRILLIC_ONSETS = ["б", "бр", "в", "г", "гр", "д", "ж", "з", "к", "кр", "л", "м", "н", "п", "р", "с", "ст", "т", "тр", "ш"]
CYRILLIC_VOWELS = ["а", "е", "и", "о", "у"]
GREEK_ONSETS, GREEK_VOWELS = ["β", "γ", "δ", "ζ", "θ", "κ", "λ", "μ", "ν", "π", "ρ", "σ", "στ", "τ", "τρ", "φ", "χ"], ["α", "ε", "η", "ι", "ο"]
ARMENIAN_ONSETS, ARMENIAN_VOWELS = ["բ", "գ", "դ", "զ", "լ", "կ", "մ", "ն", "պ", "ս", "տ", "ր"], ["ա", "ե", "ի", "ո"]
#: Names of other scripts with capitals get Latin ones.
SCRIPTS = {"latin": ("Latin", ONSETS, VOWELS), "cyrillic": ("Cyrillic", CYRILLIC_ONSETS, CYRILLIC_VOWELS), "greek": ("Greek", GREEK_ONSETS, GREEK_VOWELS), "armenian": ("Armenian", ARMENIAN_ONSETS, ARMENIAN_VOWELS)}
#: Country codes of one digit, and of two; all others have three.
ONE_DIGIT, TWO_DIGITS = ("1", "7"), tuple("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
ENDINGS = {
    ("latin", "given_n"): ["ly", "kim", "ren", "sha", "vin"], ("cyrillic", "given_n"): ["ша", "ня", "ля", "ка", "ги"],
    ("latin", "given_f"): ["na", "lia", "ra", "ine", "elle"], ("latin", "given_m"): ["n", "rt", "no", "lf", "ck"], ("latin", "surname"): ["ner", "sen", "lt", "rez", "ton"],
    ("greek", "given_n"): ["λη", "νι"], ("greek", "given_f"): ["να", "λια", "ρω"], ("greek", "given_m"): ["νος", "ρης", "λας"], ("greek", "surname"): ["ίδης", "άκης", "ρός", "λης"],
    ("armenian", "given_n"): ["ն", "կ"], ("armenian", "given_f"): ["նե", "ինե"], ("armenian", "given_m"): ["մեն", "կ"], ("armenian", "surname"): ["յան", "նց"],
    ("cyrillic", "given_f"): ["на", "лия", "ра", "ся", "та"], ("cyrillic", "given_m"): ["н", "р", "слав", "мир", "т"], ("cyrillic", "surname"): ["нов", "рин", "лев", "ков", "тин"],
}


def _pick(values: list[str], byte: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), byte % len(values))


def kind_of(match: Column) -> Column:
    found = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        found = F.when(match.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(found)
    return found


def canonical(kind: Column, match: Column) -> Column:
    """What is the same however an entity is written."""
    squeezed = F.regexp_replace(match, "[^A-Za-z0-9]", "")
    # Ten digits are a number of country 1, as are the same after +1.
    phone = F.when(F.length(squeezed) == 10, F.concat(F.lit("1"), squeezed)).otherwise(squeezed)
    return F.when(kind == "phone", phone).when(kind.isin("card", "ssn"), squeezed).when(kind == "iban", F.upper(squeezed)).when(kind == "secret", match).otherwise(F.lower(match))


def _entities(text: Column) -> Column:
    """array<struct<kind, canonical, raw>> of a text's entities, in order."""

    def of(raw: Column, between: Column) -> Column:
        def honour(k: Column) -> Column:
            x = F.get(between, k)
            after = lambda forms: x.rlike(rf"(?:^|[^\p{{L}}\p{{N}}])(?:{forms})\.? (?:{_PARTICLE})*$")
            return F.when(after(_F), F.lit("f")).when(after(_M), F.lit("m")).when(after(_N), F.lit("n"))

        def joined(k: Column) -> Column:
            return F.coalesce(F.get(between, k).rlike(rf"^(?:\.?[ -]|\.)(?:{_PARTICLE})*$"), F.lit(False))

        def entity(m: Column, k: Column) -> Column:
            gender = honour(k)
            for back in range(_BEFORE, 0, -1):
                near = joined(k)
                for i in range(1, back):
                    near = near & joined(k - i)
                gender = F.coalesce(gender, F.when(near, honour(k - back)))
            more = joined(k + 1) & F.coalesce(F.get(raw, k + 1).rlike(r"^\p{Lu}[\p{L}'’]*$"), F.lit(False))
            part = F.when(F.length(m) == 1, F.lit("initial")).when(more, F.concat(F.lit("given_"), F.coalesce(gender, F.lit("n")))).otherwise(F.lit("surname"))
            return let(kind_of(m), lambda kind: F.struct(F.when(kind == "name", part).otherwise(kind).alias("kind"), canonical(kind, m).alias("canonical"), m.alias("raw")))

        return F.transform(raw, entity)

    def of_span(span: Column) -> Column:
        found = let(F.regexp_extract_all(span, F.lit(ANY), F.lit(0)), lambda raw: F.when(F.size(raw) > 0, let(F.split(span, ANY, -1), lambda between: of(raw, between))))
        return F.coalesce(found, F.array().cast("array<struct<kind:string,canonical:string,raw:string>>"))

    def of_line(line: Column) -> Column:
        return F.flatten(F.transform(F.regexp_extract_all(line, F.lit(SPAN), F.lit(0)), of_span))

    return F.flatten(F.transform(F.filter(F.split(text, "\n"), _hinted), of_line))


def _hinted(line: Column) -> Column:
    """Whether a line can have an entity. No pattern goes over a line's end."""
    some = line.rlike("[0-9@]")
    for stem in STEMS:
        some = some | line.contains(stem)
    return some


def _masked(text: Column) -> Column:
    """A text with MARK for each entity; its own MARK and ESCAPE are escaped."""
    escaped = lambda x: F.replace(F.replace(x, F.lit(ESCAPE), F.lit(ESCAPE + "a")), F.lit(MARK), F.lit(ESCAPE + "b"))

    def of_line(line: Column) -> Column:
        spans = F.transform(F.regexp_extract_all(line, F.lit(SPAN), F.lit(0)), lambda x: F.array_join(F.transform(F.split(x, ANY, -1), escaped), MARK))
        return let(spans, lambda m: F.array_join(F.transform(F.split(line, SPAN, -1), lambda x, i: F.concat(escaped(x), F.coalesce(F.get(m, i), F.lit("")))), ""))

    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(_hinted(x), of_line(x)).otherwise(escaped(x))), "\n")


def _unmasked(masked: Column, surrogates: Column) -> Column:
    """The surrogates at their places, and the text's own characters as they were."""
    restored = lambda x: F.replace(F.replace(x, F.lit(ESCAPE + "b"), F.lit(MARK)), F.lit(ESCAPE + "a"), F.lit(ESCAPE))

    def put(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda x, i: F.concat(restored(x), F.coalesce(F.get(surrogates, i)["surrogate"], F.lit("")))), "")

    # Further mentions of the text's names, capitalised as found or all in capitals, get the surrogate of the first such part.
    def renamed(parts: Column, names: Column, pattern: Column) -> Column:
        def of(m: Column) -> Column:
            e = F.get(F.filter(names, lambda e: F.lower(e["raw"]) == F.lower(m)), F.lit(0))
            return F.when(m == F.upper(m), F.upper(e["surrogate"])).otherwise(F.initcap(e["surrogate"]))

        def one(x: Column) -> Column:
            found = let(F.transform(F.regexp_extract_all(x, pattern, F.lit(0)), of), lambda f: F.array_join(F.transform(F.split(x, pattern, -1), lambda y, i: F.concat(y, F.coalesce(F.get(f, i), F.lit("")))), ""))
            return F.when(F.rlike(x, pattern), found).otherwise(x)

        return F.transform(parts, one)

    def whole(names: Column) -> Column:
        forms = F.array_distinct(F.flatten(F.transform(names, lambda e: F.array(e["raw"], F.upper(e["raw"]), F.initcap(e["raw"])))))
        return F.concat(F.lit("(?<![\\p{L}\\p{N}])(?:"), F.array_join(forms, "|"), F.lit(")(?![\\p{L}\\p{N}])"))

    names = F.filter(surrogates, lambda e: e["kind"].isin(*[k for k in NAMES if k != "initial"]))
    # The names and their pattern are made once for a text.
    parts = let(names, lambda e: let(whole(e), lambda p: let(F.split(masked, MARK, -1), lambda x: F.when(F.size(e) > 0, renamed(x, e, p)).otherwise(x))))
    return let(parts, put)


def _keyed(key: str, message: Column) -> Column:
    """HMAC-SHA-256 of a string, in hexadecimal."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(x ^ 0x36 for x in raw)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytes(x ^ 0x5C for x in raw)), F.unhex(inner)), 256)


def _stream(key: str, attempt: int) -> Column:
    """128 keyed bytes of an entity, in hexadecimal."""
    seed = F.concat_ws("\x1f", F.lit(str(attempt)), F.col("kind"), F.col("canonical"))
    return F.concat(*[_keyed(key, F.concat(F.lit(f"{i}\x1f"), seed)) for i in range(4)])


def _byte(stream: Column, i: Column | int) -> Column:
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substring(stream, (i % 128) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letters(text: Column, stream: Column, first: Column | int = 0) -> Column:
    """Letter for letter and digit for digit; all else stays."""

    def one(c: Column, i: Column) -> Column:
        b = _byte(stream, i + first)
        digit, low, up = c.between("0", "9"), c.between("a", "z"), c.between("A", "Z")
        return (
            F.when(digit, (b % 10).cast("string"))
            .when(low, F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), b % 26 + 1, F.lit(1)))
            .when(up, F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), b % 26 + 1, F.lit(1)))
            .when(c.between("а", "я"), F.substring(F.lit("абвгдежзийклмнопрстуфхцчшщъыьэюя"), b % 32 + 1, F.lit(1)))
            .when(c.between("α", "ω"), F.substring(F.lit("αβγδεζηθικλμνξοπρστυφχψω"), b % 24 + 1, F.lit(1)))
            .when(c.rlike(r"\p{L}"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), b % 26 + 1, F.lit(1)))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def luhn_digit(payload: Column) -> Column:
    """The check digit that follows a payload of digits."""
    n = F.length(payload)

    def weighed(i: Column) -> Column:
        d = F.substring(payload, i + 1, F.lit(1)).cast("int")
        return let(F.when((n - i) % 2 == 1, 2 * d).otherwise(d), lambda x: F.when(x > 9, x - 9).otherwise(x))

    total = F.aggregate(F.transform(positions(n), weighed), F.lit(0), lambda a, x: a + x)
    return (10 - total % 10) % 10


def iban_digits(country: Column, account: Column) -> Column:
    """The two check digits of an account number."""
    chars = F.split(F.concat(account, country, F.lit("00")), "")

    def step(a: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (a * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.lpad((98 - F.aggregate(chars, F.lit(0), step)).cast("string"), 2, "0")


def _name(stream: Column, attempt: int) -> Column:
    others = F.lit(False)
    for name in ("cyrillic", "greek", "armenian"):
        others = others | F.col("canonical").rlike(rf"^\p{{Is{SCRIPTS[name][0]}}}")
    out = None
    for (script, kind), ends in ENDINGS.items():
        of_script, onsets, vowels = SCRIPTS[script]
        # Later draws are longer, so that there are always enough.
        parts = [x for i in range(2 + attempt // 2) for x in (_pick(onsets, _byte(stream, 2 * i)), _pick(vowels, _byte(stream, 2 * i + 1)))]
        own = F.concat(*parts, _pick(ends, _byte(stream, 100)))
        if (script, kind) == ("cyrillic", "surname"):
            own = F.concat(own, F.when(F.col("canonical").endswith("а"), F.lit("а")).otherwise(F.lit("")))
        is_own = (~others if script == "latin" else F.col("canonical").rlike(rf"^\p{{Is{of_script}}}")) & (F.col("kind") == kind)
        out = F.when(is_own, own) if out is None else out.when(is_own, own)
    return out


#: Draws in the space of an entity's own length and range. Each later one has a wider space: addresses and telephone numbers are a
#: character longer with each, so that there are soon more than enough. Other kinds have more values than any corpus has entities.
FIRM = 4


def draw(key: str, attempt: int) -> Column:
    """The surrogate of columns kind and canonical, in canonical form."""
    c, kind = F.col("canonical"), F.col("kind")

    def of(s: Column) -> Column:
        n = F.length(c)
        more = lambda chars: F.concat(F.lit(""), *[F.substring(F.lit(chars), _byte(s, 127 - i) % len(chars) + 1, F.lit(1)) for i in range(attempt + 1 - FIRM)])
        at = F.instr(c, "@")
        host = F.substring(c, at + 1, n)
        tld = F.substring_index(host, ".", -1)
        name = F.substring(host, F.lit(1), F.length(host) - F.length(tld))
        # The host has a stream of its own: addresses of one host stay so.
        host_stream = F.concat(*[_keyed(key, F.concat_ws("\x1f", F.lit(str(i)), F.lit("host"), host)) for i in range(4)])
        email = F.concat(_letters(F.substring(c, F.lit(1), at - 1), s), more("abcdefghijklmnopqrstuvwxyz"), F.lit("@"), _letters(name, host_stream), tld)
        drawn = _letters(c, s)
        rest = lambda i: F.substring(drawn, i, n)
        exchange = F.when((F.length(c) == 11) & (F.substring(c, 5, 3) == "555"), F.concat(F.lit("555"), rest(8))).otherwise(rest(5)) if attempt < 3 else rest(5)
        # The country code stays, by the fixed numbering plan.
        code = F.when(F.substring(c, 1, 1).isin(*ONE_DIGIT), 1).when(F.substring(c, 1, 2).isin(*TWO_DIGITS), 2).otherwise(3)
        local = F.when(code == 1, F.concat(F.substring(drawn, 3, 2), exchange)).otherwise(F.substring(drawn, code + 2, n))
        phone = F.concat(F.substring(c, F.lit(1), code), (2 + _byte(s, 1) % 8).cast("string"), local, more("0123456789"))
        payload = F.concat(F.substring(c, 1, 1), F.substring(drawn, F.lit(2), n - 2))
        valid = luhn_digit(F.substring(c, F.lit(1), n - 1)).cast("string") == F.substring(c, -1, 1)
        card = F.concat(payload, F.when(valid, luhn_digit(payload)).otherwise((luhn_digit(payload) + 1 + _byte(s, 120) % 9) % 10).cast("string"))
        ssn = F.concat((1 + _byte(s, 0) % 5).cast("string"), rest(2))
        octets = [_byte(s, i) for i in range(4)]
        # An address stays in its range (private, loopback, link-local) while that has room, then goes to the largest private one.
        private = F.when(c.startswith("192.168."), "192.168.").when(c.startswith("169.254."), "169.254.").when(c.rlike(r"^172\.(?:1[6-9]|2\d|3[01])\."), F.concat(F.lit("172."), (16 + octets[1] % 16).cast("string"), F.lit(".")))
        wide = F.when(c.startswith("10."), "10.").when(c.startswith("127."), "127.")
        private, wide = (private, wide) if attempt < FIRM else (F.lit(None).cast("string"), F.coalesce(wide, F.when(private.isNotNull(), "10."))) if attempt < 3 * FIRM else (F.lit(None).cast("string"), F.lit(None).cast("string"))
        start = F.coalesce(private, F.concat(F.coalesce(wide, F.concat((11 + octets[0] % 89).cast("string"), F.lit("."))), octets[1].cast("string"), F.lit(".")))
        ip = F.concat(start, octets[2].cast("string"), F.lit("."), octets[3].cast("string"))
        hexed = F.array_join(F.transform(F.split(c, ""), lambda x, i: F.when(x.between("0", "9") | x.between("a", "f"), F.substring(F.lit("0123456789abcdef"), _byte(s, i) % 16 + 1, F.lit(1))).when(x.between("A", "F"), F.substring(F.lit("0123456789ABCDEF"), _byte(s, i) % 16 + 1, F.lit(1))).otherwise(x)), "")
        is_hex = c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
        lead = F.regexp_extract(c, "^(?:AKIA|gh[pousr]_|sk-)", 0)
        secret = F.when(is_hex, hexed).otherwise(F.concat(lead, F.substring(drawn, F.length(lead) + 1, n)))
        country, account = F.substring(c, 1, 2), rest(5)
        right = iban_digits(country, F.substring(c, F.lit(5), n)) == F.substring(c, 3, 2)
        iban = F.concat(country, F.when(right, iban_digits(country, account)).otherwise(F.substring(drawn, 3, 2)), account)
        return (
            F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ssn", ssn).when(kind == "ip", ip)
            .when(kind == "initial", drawn).when(kind == "ipv6", hexed).when(kind == "secret", secret).when(kind == "iban", iban).otherwise(_name(s, attempt))
        )

    return let(_stream(key, attempt), of)


def assign(entities: DataFrame, key: str, most: int = 30) -> DataFrame:
    """kind, canonical, surrogate for distinct entities (kind, canonical): one surrogate each, none that is an entity itself."""
    taken_names = entities.select("kind", F.col("canonical").alias("surrogate"))
    # An alphabet has no letters that are no initials, so these are drawn once and may be shared.
    initials = entities.where("kind = 'initial'").withColumn("surrogate", draw(key, 0)).select("kind", "canonical", "surrogate")
    left, done = entities.where("kind <> 'initial'"), None
    for attempt in range(most):
        drawn = written(left.withColumn("surrogate", draw(key, attempt)), "drawn")
        first = drawn.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical"))
        fine = first.join(taken_names, ["kind", "surrogate"], "left_anti")
        if done is not None:
            fine = fine.join(done, ["kind", "surrogate"], "left_anti")
        fine = written(fine.select("kind", "canonical", "surrogate"), "assigned")
        done = fine if done is None else done.unionByName(fine)
        left = written(drawn.select("kind", "canonical").join(fine, ["kind", "canonical"], "left_anti"), "undrawn")
        if not left.count():
            return done.unionByName(initials)
    raise RuntimeError(f"after {most} draws, entities are left without a surrogate")


#: Kinds of parts of names.
NAMES = ("given_f", "given_m", "given_n", "surname", "initial")


def written_as(kind: Column, raw: Column, surrogate: Column) -> Column:
    """A surrogate in the format of the original: its separators, and its capitals."""
    plain = F.regexp_replace(surrogate, r"[^\p{L}\p{N}]", "")
    short = (kind == "phone") & (F.length(F.regexp_replace(raw, r"[^0-9]", "")) == 10)
    letters = F.split(F.when(short, F.substring(plain, F.lit(2), F.length(plain))).otherwise(plain), "")

    def overlay(own: Column) -> Column:
        chars = F.split(raw, "")
        is_own = lambda c: c.rlike(r"[\p{L}\p{N}]")

        def step(a: Column, c: Column) -> Column:
            x = F.get(own, a["k"])
            return F.when(is_own(c), F.struct((a["k"] + 1).alias("k"), F.concat(a["s"], F.when(c != F.lower(c), F.upper(x)).otherwise(x)).alias("s"))).otherwise(F.struct(a["k"].alias("k"), F.concat(a["s"], c).alias("s")))

        # What a wider space has added follows at the end.
        return F.aggregate(chars, F.struct(F.lit(0).alias("k"), F.lit("").alias("s")), step, lambda a: F.concat(a["s"], F.array_join(F.slice(own, a["k"] + 1, F.greatest(F.size(own) - a["k"], F.lit(0))), "")))

    names = F.concat(F.upper(F.substring(surrogate, 1, 1)), F.substring(surrogate, F.lit(2), F.length(surrogate)))
    names = F.when((F.length(raw) > 1) & (raw == F.upper(raw)), F.upper(surrogate)).otherwise(names)
    return F.when(kind.isin("ip", "ipv6", "secret"), surrogate).when(kind.isin(*NAMES), names).when((kind == "email") & (F.length(surrogate) != F.length(raw)), F.when(raw == F.upper(raw), F.upper(surrogate)).otherwise(surrogate)).otherwise(let(letters, overlay))


def replace(documents: DataFrame, key: str) -> DataFrame:
    """All columns of `documents` with the entities in `text` replaced, and entities (array<struct<kind, surrogate>>, in order).

    Null and empty texts stay as they are, with no entities; texts without entities are unchanged to the byte; repeated rows come
    out alike; an empty table gives no rows. Other columns, of any names but `entities`, are passed on. Further mentions of a found
    name in the same text are replaced too, but not listed; names never found after a form of address stay.
    """
    rows = documents.select("doc_id", F.xxhash64("text").alias("th"), _entities(F.col("text")).alias("e")).where(F.size("e") > 0)
    found = written(rows.select("doc_id", "th", F.posexplode("e").alias("k", "e")).select("doc_id", "th", "k", "e.*").distinct(), "entities")
    n = found.count()
    entities = written(found.select("kind", "canonical").distinct(), "distinct-entities")
    mapping = assign(entities, key)
    own = join_small(found, mapping, n, ["kind", "canonical"], "inner")
    own = own.select("doc_id", "th", F.struct("k", "kind", written_as(F.col("kind"), F.col("raw"), F.col("surrogate")).alias("surrogate"), "raw").alias("e"))
    lists = own.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list("e")).alias("ohmtide_e")).withColumnsRenamed({"doc_id": "ohmtide_id", "th": "ohmtide_th"})
    lists = written(lists, "replacements")
    for old in (found, entities):
        drop_written(documents.sparkSession, old)
    keyed = documents.withColumn("ohmtide_text_hash", F.xxhash64("text"))
    joined = join_small(keyed, lists, n, F.expr("doc_id <=> ohmtide_id AND ohmtide_text_hash = ohmtide_th"), "left")
    text = F.when(F.col("ohmtide_e").isNotNull(), _unmasked(_masked(F.col("text")), F.col("ohmtide_e"))).otherwise(F.col("text"))
    listed = F.transform(F.coalesce("ohmtide_e", F.array().cast("array<struct<k:int,kind:string,surrogate:string,raw:string>>")), lambda e: F.struct(e["kind"].alias("kind"), e["surrogate"].alias("surrogate")))
    return joined.select(*[text.alias("text") if c == "text" else quoted(c) for c in documents.columns if c != "entities"], listed.alias("entities"))
