"""Scalar rules as Column expressions: units, signs, header roles, text and number forms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: header words, unit prefixes, status words ---------------------------------------------------------------
PREFIXES = {"": 1.0, "n": 1e-9, "u": 1e-6, "m": 1e-3, "k": 1e3, "K": 1e3, "M": 1e6}
FREQUENCY_UNITS = {"hz": 1.0, "khz": 1e3, "mhz": 1e-3}
IMPEDANCE_UNITS = {"ohm": (1.0, "ohm"), "mohm": (1e-3, "ohm"), "kohm": (1e3, "ohm"), "ohm-cm2": (1.0, "ohm_cm2")}
TIME_UNITS = {"ms": 1e-3, "us": 1e-6, "min": 60.0, "s": 1.0}
ROLES = ("frequency", "zreal", "zimag", "modulus", "phase", "valid", "index", "time")
#: (role, where a word stands, word). `has`, `starts` and `is` look at the letters and digits of a header alone, `stem` at these
#: without a unit at their end, `mark` at the header with its signs. The first line that fits gives the role.
HEADER_WORDS = (
    ("frequency", "has", "frequency"), ("frequency", "starts", "freq"), ("frequency", "is", "f"), ("frequency", "is", "频率"), ("frequency", "is", "频率hz"),
    ("zreal", "has", "zreal"), ("zreal", "has", "impedancereal"), ("zreal", "mark", "z'"), ("zreal", "starts", "rez"), ("zreal", "starts", "realz"),
    ("zreal", "stem", "real"), ("zreal", "stem", "re"), ("zreal", "stem", "zre"), ("zreal", "stem", "zprime"),
    ("zimag", "has", "zimag"), ("zimag", "has", "impedanceimaginary"), ("zimag", "has", "zdoubleprime"), ("zimag", "mark", "z''"), ("zimag", "starts", "imz"), ("zimag", "starts", "imagz"), ("zimag", "starts", "negimz"),
    ("zimag", "stem", "imag"), ("zimag", "stem", "im"), ("zimag", "stem", "zim"), ("zimag", "stem", "imaginary"), ("zimag", "stem", "negimag"), ("zimag", "stem", "minusimag"),
    ("modulus", "has", "modulus"), ("modulus", "has", "zmod"), ("modulus", "mark", "|z|"),
    ("phase", "has", "phase"), ("phase", "has", "相位"),
    ("valid", "is", "valid"), ("valid", "is", "有效"),
    ("index", "is", "index"), ("index", "is", "序号"),
    ("time", "is", "time"), ("time", "is", "times"), ("time", "is", "elapsedtime"), ("time", "is", "elapsedtimes"), ("time", "is", "时间"), ("time", "is", "时间s"),
)
#: What says that a column holds -Im Z (in its header with signs, at the start of its letters, in the notes of its file), and Im Z.
NEGATIVE_MARKS = ("-z''", "-zim", "-im(z", "-imz", "negz", "minusz", "-zdoubleprime", "-impedanceimaginary", "-imag", "-im(")
NEGATIVE_STARTS = ("negzimag", "negimz", "negimag", "minusimag")
NEGATIVE_NOTES = ("we.-z", "-z''")
NEGATIVE_NOTE_WORD = "negzimag"
POSITIVE_WORDS = ("zimag", "imaginary", "zdoubleprime")
# ---------------------------------------------------------------------------------------------------------------------------


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def finite_double(text: Column) -> Column:
    """The finite number a text holds, else null."""
    return finite(F.trim(text).try_cast("double"))


def norm_header(text: Column) -> Column:
    """A header's token: small letters, u for micro, ohm for omega, digits, a-z and CJK only."""
    x = F.translate(F.lower(F.coalesce(text, F.lit(""))), "μµ", "uu")
    return F.regexp_replace(F.regexp_replace(x, "[ωΩ]", "ohm"), "[^0-9a-z一-鿿]+", "")


def plain_primes(text: Column) -> Column:
    """Typographic primes and minus signs as ASCII."""
    return F.regexp_replace(F.translate(text, "′’−－", "''--"), "″", "''")


def _any(test, words) -> Column:
    """Whether test(word) holds for some word."""
    return F.exists(F.array(*[F.lit(w) for w in words]), test)


def _cut(text: Column, ends: tuple[str, ...]) -> Column:
    """The text without the first of some ends that it has."""
    out = text
    for end in reversed(ends):
        out = F.when(text.endswith(end), F.substring(text, F.lit(1), F.length(text) - len(end))).otherwise(out)
    return out


def header_role(text: Column) -> Column:
    """The role that a header's wording gives a column, by HEADER_WORDS; null if none. Units never decide."""
    table = F.array(*[F.struct(F.lit(role).alias("role"), F.lit(where).alias("where"), F.lit(word).alias("word")) for role, where, word in HEADER_WORDS])

    def stemmed(x: Column) -> Column:
        area = _cut(x["letters"], ("cm2",))
        stem = _cut(F.when(area.endswith("ohm"), area).otherwise(x["letters"]), ("kohm", "mohm", "ohm"))
        return F.struct(x["signs"].alias("signs"), x["letters"].alias("letters"), stem.alias("stem"))

    def fits(x: Column, a: Column) -> Column:
        word, where = a["word"], a["where"]
        # A single prime is none where two stand.
        mark = x["signs"].contains(word) & ~((word == "z'") & x["signs"].contains("z''"))
        return (
            F.when(where == "has", x["letters"].contains(word)).when(where == "starts", x["letters"].startswith(word))
            .when(where == "is", x["letters"] == word).when(where == "stem", x["stem"] == word).otherwise(mark)
        )

    signs = F.lower(plain_primes(text))
    both = let(signs, lambda s: F.struct(s.alias("signs"), norm_header(s).alias("letters")))
    # A field without letters, as most numbers are, is no header.
    return F.when(text.rlike(r"\p{L}"), let(let(both, stemmed), lambda x: F.get(F.filter(table, lambda a: fits(x, a)), 0)["role"]))


def _unit_tokens(text: Column) -> Column:
    """A header's runs of letters, runs of digits and single signs, with ohm and u spelt out; `cm` stands alone after a unit."""
    plain = F.regexp_replace(F.translate(text, "μµ", "uu"), "[ωΩΩ]", "ohm")
    tokens = F.regexp_extract_all(plain, F.lit(r"[A-Za-z]+|\d+|[^A-Za-z\d\s]"), F.lit(0))
    apart = F.transform(tokens, lambda t: F.when(F.lower(t).endswith("cm") & (F.length(t) > 2), F.array(F.substring(t, F.lit(1), F.length(t) - 2), F.lit("cm"))).otherwise(F.array(t)))
    return F.flatten(apart)


def _prefixed(tokens: Column, unit: str) -> Column:
    """The factor of the SI prefix before the only mention of a unit; null unless there is exactly one."""
    table = F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in pair])
    of = lambda t: F.when(F.lower(t).endswith(unit), table[F.substring(t, F.lit(1), F.length(t) - len(unit))])
    found = F.array_compact(F.transform(tokens, of))
    return F.when(F.size(found) == 1, F.get(found, 0))


def frequency_scale(header: Column, unit: str = "auto") -> Column:
    """Factor to Hz; null where the header does not name one unit. A declared `mhz` is millihertz; in a header, case decides."""
    if unit != "auto":
        return F.lit(FREQUENCY_UNITS[unit])
    return _prefixed(_unit_tokens(header), "hz")


def impedance_scale(header: Column, unit: str = "auto") -> Column:
    """struct<factor, basis>: to ohm, or ohm cm2; null where the unit is missing, not unique, or per area."""
    if unit != "auto":
        factor, basis = IMPEDANCE_UNITS[unit]
        return F.struct(F.lit(factor).alias("factor"), F.lit(basis).alias("basis"))

    def of(tokens: Column) -> Column:
        # Each length in a header, with its power: the token after it, but for a caret.
        def length(t: Column, i: Column) -> Column:
            caret = (F.get(tokens, i + 1) == "^").cast("int")
            after = lambda k: F.coalesce(F.get(tokens, i + k + F.coalesce(caret, F.lit(0))), F.lit(""))
            minus = after(1).isin("-", "−", "⁻")
            square = after(1).isin("2", "²") | (minus & after(2).isin("2", "²"))
            return F.when(F.lower(t) == "cm", F.when(minus | F.coalesce(F.get(tokens, i - 1) == "/", F.lit(False)), "per").when(square, "area")).when(F.lower(t).isin("m", "mm") & square, "other")

        lengths = F.array_compact(F.transform(tokens, length))
        factor = _prefixed(tokens, "ohm")
        bad = F.arrays_overlap(lengths, F.array(F.lit("per"), F.lit("other")))
        return F.when(~bad & factor.isNotNull(), F.struct(factor.alias("factor"), F.when(F.array_contains(lengths, "area"), "ohm_cm2").otherwise("ohm").alias("basis")))

    return let(_unit_tokens(header), of)


def time_scale(header: Column) -> Column:
    """Factor to seconds; null where the header names no unit. Seconds alone need brackets, or to follow the word for time."""
    text = F.regexp_replace(F.translate(F.lower(header), "μµ", "uu"), "秒", "s")
    letters = norm_header(text)
    seconds = text.contains("(s)") | text.contains("[s]") | (letters.endswith("s") & F.coalesce(header_role(letters) == "time", F.lit(False)))
    named = {u: letters.contains(u) for u in TIME_UNITS} | {"s": seconds}
    named["ms"] = named["ms"] & ~named["min"]
    return F.coalesce(*[F.when(named[u], F.lit(x)) for u, x in TIME_UNITS.items()])


def imaginary_sign(header: Column, convention: str = "auto", note: Column | None = None) -> Column:
    """What to multiply the imaginary column by to get -Im Z: 1 or -1; null if nothing decides. Phase and modulus never do."""
    if convention in ("neg-zimag", "zimag"):
        return F.lit(1 if convention == "neg-zimag" else -1)
    signs = F.translate(F.lower(plain_primes(header)), " _", "")
    letters = norm_header(header)
    noted = F.translate(F.lower(F.coalesce(note if note is not None else F.lit(None).cast("string"), F.lit(""))), " ", "")
    negative = _any(signs.contains, NEGATIVE_MARKS) | _any(letters.startswith, NEGATIVE_STARTS) | _any(noted.contains, NEGATIVE_NOTES) | norm_header(noted).contains(NEGATIVE_NOTE_WORD)
    positive = _any(letters.contains, POSITIVE_WORDS) | F.coalesce(header_role(header) == "zimag", F.lit(False))
    return F.when(negative, 1).when(positive, -1)


def modulus(zreal: Column, neg_zimag: Column) -> Column:
    return F.hypot(zreal, neg_zimag)


def phase_degrees(zreal: Column, neg_zimag: Column) -> Column:
    """Null at Z = 0."""
    return F.when(modulus(zreal, neg_zimag) > 0, F.degrees(F.atan2(-neg_zimag, zreal)))


def omega(frequency_hz: Column) -> Column:
    return F.lit(2 * math.pi) * frequency_hz


def tau(frequency_hz: Column) -> Column:
    return F.lit(1.0) / omega(frequency_hz)


def area_normalized(value: Column, basis: Column, area_cm2: Column) -> Column:
    """Ohm to ohm cm2, once; null without a positive area."""
    return F.when(basis == "ohm_cm2", value).when(area_cm2 > 0, value * area_cm2)


def slug(text: Column) -> Column:
    x = F.regexp_replace(text, "[^0-9A-Za-z._-]+", "_")
    return F.substring(F.regexp_replace(F.regexp_replace(x, "_+", "_"), "^[_.]+|[_.]+$", ""), 1, 120)


def six_digits(x: Column) -> Column:
    """A number in at most six significant digits, as text; `null` where there is none."""
    return F.coalesce(F.format_string("%.6g", finite(x)), F.lit("null"))


def spreadsheet_safe(text: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets a leading apostrophe."""
    return F.when(text.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def digest24(*parts: Column) -> Column:
    """Identity of a canonical string of parts: 24 hexadecimal digits."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256), 1, 24)


def source_uid(path: Column) -> Column:
    return digest24(F.lit("source"), path)


def spectrum_uid(source: Column, content_sha256: Column, spectrum_id: Column) -> Column:
    return digest24(F.lit("spectrum"), source, content_sha256, spectrum_id)
