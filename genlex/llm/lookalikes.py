"""Problem 4: one consistent form for text that looks the same but is written with other characters.

Method: look-alike characters are mapped to one character each (a single JVM ``translate``), the mapped values are
grouped under an accent-sensitive, case-insensitive Unicode collation in SQL, each class gets a deterministic member
as its canonical form, and that is joined back to every row.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genlex.session import materialize

# Letters of other alphabets that are drawn like a Latin letter, as "Latin letter: look-alikes".
LOOKALIKE_LETTERS = {
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐ", "C": "СϹᏟꓚ", "D": "Ꭰꓓꓒ", "E": "ЕΕᎬꓰ", "F": "Ϝꓝ", "G": "Ԍꓖ", "H": "НΗᎻꓧ", "I": "ІΙӀꓲ", "J": "ЈᎫꓙ",
    "K": "КΚᏦꓗ", "L": "Ꮮꓡ", "M": "МΜϺᎷꓟ", "N": "Νꓠ", "O": "ОΟՕꓳ", "P": "РΡᏢꓑ", "Q": "Ԛ", "R": "Ꮢꓣ", "S": "ЅՏᏚꓢ", "T": "ТΤᎢꓔ",
    "U": "Սꓴ", "V": "Ѵꓦ", "W": "Ԝꓪ", "X": "ХΧꓫ", "Y": "ҮΥꓬ", "Z": "ΖᏃꓜ",
    "a": "аαɑ", "b": "Ƅ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡց", "h": "һհ", "i": "іιıɩ", "j": "јϳ", "k": "к", "l": "ӏ", "m": "м", "n": "ո",
    "o": "оοօσ", "p": "рρ", "q": "ԛգ", "s": "ѕ", "t": "т", "u": "սυʋ", "v": "νѵ", "w": "ԝѡ", "x": "хχ", "y": "уүγ", "z": "ᴢ",
    "ë": "ё", "è": "ѐ", "ï": "їϊ", "á": "ά", "ó": "ό", "í": "ί", "Ë": "Ё", "È": "Ѐ", "Ï": "ЇΪ", "Á": "Ά", "Ó": "Ό", "Í": "Ί", "É": "Έ",
    "-": "‐‑‒–—―−﹘﹣－", "'": "’‘ʼʹ′＇‛`´", '"': "“”„‟″＂",
    "fi": "ﬁ", "fl": "ﬂ", "ff": "ﬀ", "ffi": "ﬃ", "ffl": "ﬄ", "st": "ﬆﬅ",
}
#: Variation selectors and joiners that draw nothing; the format characters (category Cf) are added by rule.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍ㅤ" + "".join(map(chr, range(0xFE00, 0xFE10)))
COLLATION = "UNICODE_CI"
BLANKS = r"[\s\p{Z}\p{Cf}\p{Cc}]+"


@cache
def _tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(from, to) of ``translate`` and the multi-letter replacements. Widths, fonts and spaces come from Unicode's own rules."""
    one: dict[str, str] = {}
    drop: set[str] = set(INVISIBLE)
    for code in [*range(0x80, 0xD800), *range(0xE000, 0x20000)]:
        ch = chr(code)
        category = unicodedata.category(ch)
        if category == "Cf":
            drop.add(ch)
        elif category == "Zs":
            one[ch] = " "
        elif unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>", "<font>", "<compat>")):
            plain = unicodedata.normalize("NFKC", ch)
            if len(plain) == 1 and plain.isascii() and plain.isprintable():
                one[ch] = plain
    for latin, others in LOOKALIKE_LETTERS.items():
        if len(latin) == 1:
            one |= dict.fromkeys(others, latin)
    many = tuple((other, latin) for latin, others in LOOKALIKE_LETTERS.items() if len(latin) > 1 for other in others)
    one = {k: v for k, v in one.items() if k not in drop}
    return "".join(one) + "".join(sorted(drop)), "".join(one.values()), many


@cache
def _composed() -> tuple[str, ...]:
    """Letter + combining mark and its one-character form, for every pair that Unicode composes from an ASCII letter."""
    pairs: list[str] = []
    for letter in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
        for mark in range(0x300, 0x330):
            whole = unicodedata.normalize("NFC", letter + chr(mark))
            if len(whole) == 1:
                pairs += [letter + chr(mark), whole]
    return tuple(pairs)


def compose(text: Column) -> Column:
    """Join letters with the combining accent after them; texts without combining characters pass untouched."""
    pairs = F.create_map(*[F.lit(x) for x in _composed()])
    parts = F.transform(F.regexp_extract_all(text, F.lit("(?s)(.[\\u0300-\\u036f]*)"), F.lit(1)), lambda x: F.coalesce(pairs[x], x))
    return F.when(text.rlike("[\\u0300-\\u036f]"), F.array_join(parts, "")).otherwise(text)


def map_lookalikes(text: Column) -> Column:
    """Map look-alike characters to one each, drop invisible ones, cut blanks at the ends and shorten runs of blanks to one space.

    null stays null; a text of blanks and invisible characters only becomes the empty string.
    """
    source, target, many = _tables()
    for other, latin in many:
        text = F.replace(text, F.lit(other), F.lit(latin))
    text = F.translate(text, source, target)
    return compose(F.regexp_replace(F.regexp_replace(text, f"^{BLANKS}|{BLANKS}$", ""), BLANKS, " "))


def canonical_forms(texts: DataFrame, text_col: str) -> DataFrame:
    """``(raw, canonical)``: one row per distinct text with the canonical form of its equivalence class.

    Distinct texts are counted first, with map-side combine, so that a text that fills a third of all rows is one row from
    there on. Classes are groups of mapped texts under the collation ``UNICODE_CI``: case and the way an accent is encoded
    do not matter, accents themselves do. The canonical form is the lower-cased member with the fewest characters outside
    a-z, then the smallest in binary order. null and unreadable texts (blank or invisible characters only) have no class
    and get no row; an empty table gives an empty result.
    """
    raw = texts.select(F.col(text_col).alias("raw")).where(F.col("raw").isNotNull()).groupBy("raw").agg(F.lit(1).alias("one"))
    mapped = raw.select("raw", map_lookalikes(F.col("raw")).alias("mapped")).where("mapped <> ''")
    mapped = materialize(mapped.select("raw", F.lower("mapped").alias("mapped")))  # read twice below
    members = mapped.groupBy("mapped").agg(F.lit(1).alias("one")).select("mapped", F.collate("mapped", COLLATION).alias("same"))
    plainness = F.struct(F.length(F.regexp_replace("mapped", "[a-z]", "")).alias("odd"), F.col("mapped").alias("form"))
    classes = members.groupBy("same").agg(F.min(plainness)["form"].alias("canonical"))
    of_member = members.join(classes, "same").select("mapped", "canonical")
    return mapped.join(of_member, "mapped").select("raw", "canonical")


def with_canonical(rows: DataFrame, text_col: str, forms: DataFrame, name: str = "canonical") -> DataFrame:
    """``rows`` plus ``name``; null where the text has no class. A hot text meets one row of ``forms``, so its rows may be split."""
    found = forms.select(F.col("raw").alias("__raw"), F.col("canonical").alias("__form"))
    keep = [rows[c] for c in rows.columns if c != name]
    return rows.join(found, rows[text_col] == found["__raw"], "left").select(*keep, F.col("__form").alias(name))


def same_reading(left: DataFrame, left_id: str, left_text: str, right: DataFrame, right_id: str, right_text: str) -> DataFrame:
    """Pairs of ids whose texts read the same but differ after lower-casing and cutting ordinary spaces at both ends.

    Every pair is given, repeated rows included. Both sides are grouped by written form first: the comparison of written
    forms runs once per pair of forms and ids are joined to forms after it. null or unreadable texts match nothing.
    """
    a = left.select(F.col(left_id).alias("a_id"), F.col(left_text).alias("a_text")).where("a_text is not null")
    b = right.select(F.col(right_id).alias("b_id"), F.col(right_text).alias("b_text")).where("b_text is not null")
    forms = materialize(canonical_forms(a.select(F.col("a_text").alias("t")).unionByName(b.select(F.col("b_text").alias("t"))), "t"))
    fa = a.select("a_text").distinct().join(forms, F.col("a_text") == F.col("raw")).select("a_text", "canonical")
    fb = b.select("b_text").distinct().join(forms, F.col("b_text") == F.col("raw")).select("b_text", "canonical")
    differ = F.lower(F.trim("a_text")) != F.lower(F.trim("b_text"))
    pairs = fa.join(fb, "canonical").where(differ).select("a_text", "b_text", "canonical")
    return a.join(materialize(pairs), "a_text").join(b, "b_text").select("a_id", "b_id", "canonical")
