"""Scalar functions on Columns: identifiers, names, labels, dates and escapes. All stay in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The identifier's shape, its noise characters and its look-alike tables.
SERIAL = r"^(?:\d{2}[0-9A-HJ-NP-Z]{5}|TC?-\d{4,6}|LC-\d{4})\z"
NOISE = "'’‘`\",.  "
TRIVIAL = ("OoIli", "00111")
DIGRAPHS = (("tJ", "U"), ("IJ", "U"), ("lJ", "U"), ("tt", "U"))
SYMBOLS = ("¿Øø", "200")
LOWERCASE = ("gsqt", "959L")
DIGIT_PLACES = ("LTSBGZAQD", "115862400")
LOOKALIKES = "O0 Q0 D0 I1 L1 S5 S8 S9 B8 Z2 G6 G9 T7 A4 17 09".split()
# Words that tell sides apart, and those that may be glued to a number, longest first.
ORIENTATION = (
    "ost west nord sued sud no nw so sw nordost nordwest suedost suedwest sudost sudwest links rechts mitte oben unten innen aussen".split()
)
SUFFIXES = "nordost nordwest suedost suedwest sudost sudwest ost west nord sued sud".split()
def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is evaluated, and written into the plan, once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@lru_cache
def _expansions(change: Callable[[str], str]) -> tuple[str, str]:
    """All characters beyond ASCII that `change` changes, but for Hangul syllables, and what they become, joined by \x1f."""
    codes = (c for c in range(0x80, 0x110000) if not (0xAC00 <= c < 0xD7A4 or 0xD800 <= c < 0xE000 or 0x3FFFE < c < 0xE0000 or c >= 0xE1000))
    table = {chr(c): change(chr(c)) for c in codes}
    changed = {c: to for c, to in table.items() if to != c}
    return "".join(changed), "\x1f".join(changed.values())


def _bare(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


@lru_cache
def _others(kind: Callable[[str], bool]) -> str:
    """A pattern of a character of another kind than `kind`, by Unicode's tables: the JVM's may be older."""
    kept = [c for c in range(0x80, 0x40000) if not 0xD800 <= c < 0xE000 and kind(chr(c))]
    starts = [c for c, before in zip(kept, [-1, *kept], strict=False) if c != before + 1]
    ends = [c for c, after in zip(kept, [*kept[1:], -1], strict=True) if c + 1 != after]
    inside = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in zip(starts, ends, strict=True))
    ascii_ = "".join(chr(c) for c in range(0x80) if kind(chr(c)))
    return f"[^{ascii_}{inside}]"


#: First letters, vowels and ends of a Hangul syllable, by Unicode's rule.
HANGUL = [[chr(start + i) for i in range(n)] for start, n in ((0x1100, 19), (0x1161, 21), (0x11A7, 28))]


def _ascii(x: Column) -> Column:
    return x.rlike(r"^[\x00-\x7F]*\z")


def _changed(x: Column, change: Callable[[str], str], hangul: bool = False) -> Column:
    """`x` with every character beyond ASCII changed as `change` does it, by Unicode's tables; ASCII texts stay as they are."""
    keys, values = (F.lit(t) for t in _expansions(change))
    to = F.split(values, "\x1f")

    def jamo(c: Column) -> Column:
        at = F.ascii(c) - 0xAC00
        parts = (F.floor(at / 588), F.floor(at / 28) % 21, at % 28)
        letter = [F.get(F.split(F.lit("\x1f".join(h)), "\x1f"), p.cast("int")) for h, p in zip(HANGUL, parts, strict=True)]
        return F.concat(letter[0], letter[1], F.when(parts[2] > 0, letter[2]).otherwise(""))

    def one(c: Column) -> Column:
        at = F.instr(keys, c)
        out = F.when(at > 0, F.get(to, at - 1)).otherwise(c)
        return F.when((c >= "\uac00") & (c <= "\ud7a3"), jamo(c)).otherwise(out) if hangul else out

    every = lambda v: F.array_join(F.transform(F.split(v, ""), lambda c: F.when(c <= "\x7f", c).otherwise(one(c))), "")
    return bound(x, lambda v: F.when(_ascii(v), v).otherwise(every(v)))


def fold_marks(x: Column) -> Column:
    """Compatibility decomposition without combining marks: no diacritics, ligatures, full-width or circled forms."""
    return _changed(x, _bare, hangul=True)


#: Stands before the number of a principal, as a pattern; the label of a site's own numbering.
NUMBER_PREFIX = r"No\.?"


def number_split(x: Column, prefix: str = NUMBER_PREFIX) -> Column:
    """struct(number, name) of `prefix n name`; all else is the name."""
    pattern = rf"(?s)^(?:{prefix})\s*(\d{{1,3}})\b[.,]?\s*(.*)\z"
    number = F.nullif(F.regexp_extract(x, pattern, 1), F.lit("")).cast("int")
    return F.struct(number.alias("number"), F.when(number.isNotNull(), F.trim(F.regexp_extract(x, pattern, 2))).otherwise(x).alias("name"))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def casefold(x: Column) -> Column:
    """Full case folding: letters that fold to several ones too."""
    return bound(x, lambda v: F.when(_ascii(v), F.lower(v)).otherwise(_changed(F.translate(v, UPPER, UPPER.lower()), str.casefold)))


def serial_valid(x: Column) -> Column:
    return F.coalesce(x.rlike(SERIAL), F.lit(False))


def repair_serial(raw: Column) -> Column:
    """struct(serial, valid, suspect). Suspect: it took more than the trivial repairs."""
    made = lambda s, valid, suspect: F.struct(s.alias("serial"), valid.alias("valid"), F.lit(suspect).alias("suspect"))

    def whole(clean: Column) -> Column:
        digraphs = reduce(lambda s, d: F.replace(s, F.lit(d[0]), F.lit(d[1])), DIGRAPHS, clean)
        return F.upper(F.translate(F.translate(F.translate(digraphs, *TRIVIAL), *SYMBOLS), *LOWERCASE))

    def placed(full: Column) -> Column:
        digits = F.concat(F.translate(F.substring(full, 1, 2), *DIGIT_PLACES), F.substring(full, 3, 5))
        return F.when((F.length(full) == 7) & ~full.contains("-"), digits).otherwise(full)

    def judged(clean: Column) -> Column:
        trivial = F.translate(clean, *TRIVIAL)
        full = bound(bound(whole(clean), placed), lambda s: made(s, serial_valid(s), True))
        return F.when(serial_valid(clean), made(clean, F.lit(True), False)).when(serial_valid(trivial), made(trivial, F.lit(True), False)).otherwise(full)

    return bound(F.translate(fold_marks(raw), NOISE, ""), judged)


def lookalike_equal(a: Column, b: Column) -> Column:
    """Same length, and every position is equal or one of the confusable pairs."""
    pairs = F.array(*(F.lit(p) for x in LOOKALIKES for p in (x, x[::-1])))
    letters = lambda s: F.split(F.upper(s), "")
    each = F.zip_with(letters(a), letters(b), lambda x, y: (x == y) | F.array_contains(pairs, F.concat(x, y)))
    return (F.length(a) == F.length(b)) & F.forall(each, lambda ok: ok)


def lookalike_block(s: Column) -> Column:
    """A key that look-alikes share: one letter per class of connected confusable pairs."""
    return F.translate(F.upper(s), "OQDS958BG6LI7TZA", "0000000000111124")


#: Letters of a text that `lookalike_spellings` writes out; what follows them meets by its class.
SPELLED = 8


def lookalike_key(s: Column) -> Column:
    """What a text is found by among `lookalike_spellings`: its first letters as they are, the others by `lookalike_block`."""
    return bound(F.upper(s), lambda u: F.concat(F.left(u, F.lit(SPELLED)), lookalike_block(F.substring(u, F.lit(SPELLED + 1), F.length(u)))))


def lookalike_spellings(s: Column, seen: list[tuple[int, str]]) -> Column:
    """The keys (lookalike_key) of all look-alikes of `s`, of which each letter that has look-alikes is only written where it is `seen`
    (place from 0, letter); an array that grows with the look-alikes there can be, not with the class."""
    known = F.array(*(F.lit(f"{place}{c}") for place, c in seen)) if seen else F.array().cast("array<string>")
    pairs = sorted({p for x in LOOKALIKES for p in (x, x[::-1])})
    others = F.create_map(*(F.lit(x) for c in sorted({p[0] for p in pairs}) for x in (c, "".join(p[1] for p in pairs if p[0] == c))))

    def ways(c: Column, place: Column) -> Column:
        near = F.filter(F.split(F.try_element_at(others, c), ""), lambda o: F.array_contains(known, F.concat(place.cast("string"), o)))
        return F.concat(F.array(c), F.coalesce(near, F.array().cast("array<string>")))

    u = F.upper(s)
    letters = F.transform(F.split(F.left(u, F.lit(SPELLED)), ""), ways)
    rest = lookalike_block(F.substring(u, F.lit(SPELLED + 1), F.length(u)))
    each = F.aggregate(letters, F.array(F.lit("")), lambda made, own: F.flatten(F.transform(made, lambda m: F.transform(own, lambda c: F.concat(m, c)))))
    return F.transform(each, lambda m: F.concat(m, rest))


def norm_door(x: Column) -> Column:
    """Letters and digits of any script, folded, with 0 as o."""
    kept = lambda v: F.when(_ascii(v), F.regexp_replace(F.lower(v), "[^a-z0-9]", "")).otherwise(F.regexp_replace(casefold(fold_marks(v)), _others(str.isalnum), ""))
    return F.replace(bound(x, kept), F.lit("0"), F.lit("o"))


def door_digits(x: Column) -> Column:
    """The digits, zeros kept, of all forms that decompose to digits too."""
    return bound(x, lambda v: F.when(_ascii(v), F.regexp_replace(v, "[^0-9]", "")).otherwise(F.regexp_replace(fold_marks(v), _others(str.isdigit), "")))


def door_sides(x: Column) -> Column:
    """The marks by which otherwise like names differ, in order: compass and position words, lone letters, a compass word behind a number."""
    words = F.regexp_extract_all(casefold(fold_marks(x)), F.lit("([a-z0-9]+)"), 1)
    known = F.array(*map(F.lit, ORIENTATION))
    glued = lambda t: F.regexp_extract(t, r"^[0-9]+(" + "|".join(SUFFIXES) + r")$", 1)
    side = lambda t: F.when((F.length(t) == 1) & t.rlike("[a-z]"), t).when(F.array_contains(known, t), t).otherwise(F.nullif(glued(t), F.lit("")))
    return F.array_sort(F.array_distinct(F.filter(F.transform(words, side), lambda t: t.isNotNull())))


def edit_distance(a: Column, b: Column, cap: int = 3) -> Column:
    """Levenshtein distance, `cap` where it is that or more."""
    d = F.levenshtein(a, b, cap - 1)
    return F.when(d < 0, cap).otherwise(d)


def synthetic_serial(name: Column) -> Column:
    return F.concat(F.lit("MX:"), F.substring(F.upper(F.sha1(casefold(F.trim(name)))), 1, 10))


def resource_label(door_name: Column, room: Column, serial: Column) -> Column:
    """The name, else the serial; the room follows the name unless it is one of its words."""
    words = F.split(F.trim(door_name), r"\s+")
    return F.when(door_name == "", serial).when((room != "") & ~F.array_contains(words, F.trim(room)), F.concat(door_name, F.lit(" ("), room, F.lit(")"))).otherwise(door_name)


def principal_label(person_name: Column, number: Column, serial: Column, prefix: str = "No. ") -> Column:
    return F.coalesce(F.nullif(person_name, F.lit("")), F.concat(F.lit(prefix), number.cast("string")), serial)


def norm_code(x: Column) -> Column:
    """Upper-case ASCII code of 1 to 4 letters or digits, else null."""
    code = F.upper(F.regexp_replace(fold_marks(F.trim(x)), r"[^\x00-\x7F]", ""))
    return F.when(code.rlike(r"^[A-Z0-9]{1,4}\z"), code)


def derive_code(name: Column, used: Column, prefix: str = "") -> Column:
    """The shortest prefix (1 to 4 characters) of the name's letters and digits that is not in `used`, else null."""
    meant = F.regexp_replace(F.trim(name), rf"(?i)^{prefix}\s+", "") if prefix else F.trim(name)
    stem = F.regexp_replace(F.upper(F.regexp_replace(fold_marks(meant), r"[^\x00-\x7F]", "")), "[^A-Z0-9]", "")
    taken = F.transform(used, lambda c: F.upper(c))
    tries = F.array(*(F.when(F.length(stem) >= n, F.substring(stem, 1, n)) for n in range(1, 5)))
    return F.get(F.filter(tries, lambda c: c.isNotNull() & ~F.array_contains(taken, c)), F.lit(0))


def group_label(groups: Column, prefix: str = "") -> Column:
    """Label of an array of struct(name, code, implicit): codes in the order of names; the implicit one only alone;
    joined without a sign if all have one character, else by '-'. Empty for no group."""
    ordered = F.array_sort(F.transform(groups, lambda g: F.struct(casefold(g["name"]).alias("name"), g["code"].alias("code"), g["implicit"].alias("implicit"))))
    shown = F.when(F.size(ordered) > 1, F.filter(ordered, lambda g: ~g["implicit"])).otherwise(ordered)
    codes = F.transform(shown, lambda g: g["code"])
    joined = F.when(F.forall(codes, lambda c: F.length(c) == 1), F.array_join(codes, "")).otherwise(F.array_join(codes, "-"))
    return F.when(F.size(groups) == 0, "").otherwise(F.concat(F.lit(prefix), joined))


def collapse_ws(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), r"\s+", " ")


def align_key(x: Column) -> Column:
    return F.regexp_replace(casefold(x), "[^a-z0-9]", "")


def location_concat(*parts: Column) -> Column:
    return F.concat_ws(".", *(F.nullif(p, F.lit("")) for p in parts))


def iso_date(x: Column) -> Column:
    """ISO 8601 calendar dates (2024-01-02, 20240102) and week dates (2024-W01-2, 2024W012, 2024-W01, 2024W01: its Monday), else null."""
    plain = F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.try_to_date(x, "yyyy-MM-dd")).when(x.rlike(r"^\d{8}\z"), F.try_to_date(x, "yyyyMMdd"))
    part = lambda k: F.regexp_extract(x, r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?\z", k)
    year = F.nullif(part(1), F.lit("")).cast("int")
    fourth = F.make_date(F.when(year > 0, year), F.lit(1), F.lit(4))  # always in the first week
    week, day = part(2).try_cast("int"), F.coalesce(part(3).try_cast("int"), F.lit(1))
    date = F.date_add(fourth, ((week - 1) * 7 + day - 1 - F.weekday(fourth)).cast("int"))
    # The dashes are all there or none; a year has the weeks whose Thursday it has.
    shaped = x.rlike(r"^\d{4}(-W\d{2}(-[1-7])?|W\d{2}[1-7]?)\z")
    thursday = F.date_add(date, (4 - day).cast("int"))
    return F.coalesce(plain, F.when(shaped & (week >= 1) & (F.year(thursday) == year), date))


def utc_iso(ts: Column) -> Column:
    """The instant in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def md_escape(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"([\\`*_\[\]])", r"\\$1"), r"^([#>+\-=])", r"\\$1")


def sql_literal(x: Column) -> Column:
    return F.when(x.isNull(), "NULL").otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'")))
