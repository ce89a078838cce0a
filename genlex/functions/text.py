"""Column expressions on text: cleaning, sentences, tokens, markers. All run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V

TOKEN = r"(?:[cdjlmnstCDJLMNST]|[qQ]u)['’]|\p{L}+(?:[-·‧⋅•∙/.]\p{L}+|\(\p{L}+\)?\p{L}*)*|\p{N}+|[^\s\p{L}\p{N}]"
SENTENCE_END = r"([.!?…])\s+"
SEPARATOR_CLASS = "[·‧.⋅•∙/(]"


def _longest_first(words) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


_STEM = "[A-zÀ-ú]"
#: anchored forms; the class A-z keeps the signs between Z and a, and only the first is case-insensitive
SEPARATOR_FORM = rf"^(?iuU)(?:{_STEM}+)((?:{SEPARATOR_CLASS})(?:{_longest_first(V.FEMININE_ENDINGS)}))(?:\b)"
UPPER_FORM = rf"^(?U)(?:{_STEM}+?)({_longest_first(V.FEMININE_ENDINGS)})(?:\b)"


def phrase_pattern(phrases) -> str:
    """Whole phrases in any case, in the order given."""
    return r"(?iuU)\b(" + "|".join(re.escape(p).replace("\\ ", " ") for p in phrases) + r")\b"


def sentences(text: Column) -> Column:
    """Sentence texts; null gives an empty array, blank pieces are left out."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), SENTENCE_END, "$1\n"), r"\n+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def tokens(text: Column) -> Column:
    """Word forms with their inclusive endings kept on, elided clitics on their own, numbers, and single other signs."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TOKEN})"), F.lit(1))


def phrase_hits(sentence_array: Column, phrases) -> Column:
    """Every match in every sentence, as array<struct<sentence, hit>>."""
    p = phrase_pattern(phrases)
    return F.flatten(F.transform(sentence_array, lambda s: F.transform(F.regexp_extract_all(s, F.lit(p), F.lit(1)), lambda m: F.struct(s.alias("sentence"), m.alias("hit")))))


def separator_form(token: Column) -> Column:
    """The sign and ending of an inclusive form such as ``·e``, or null."""
    return F.nullif(F.regexp_extract(token, SEPARATOR_FORM, 1), F.lit(""))


def upper_form(token: Column) -> Column:
    """The capital ending of a form such as ``auteurRICES``, or null; all-capital words have none."""
    return F.when(token != F.upper(token), F.nullif(F.regexp_extract(token, UPPER_FORM, 1), F.lit("")))


def _entities() -> dict[str, str]:
    """The public list of HTML 5 character references, as the standard library has it, without the ``&``."""
    from html.entities import html5

    return html5


def unescape_html(text: Column) -> Column:
    """All named and numeric character references as characters; unknown ones stay. Texts without ``&`` pass untouched.

    References without a semicolon count where HTML allows them (``&eacute`` but not ``&mdash``), the longest name first.
    """
    named = _entities()
    loose = sorted((n for n in named if not n.endswith(";")), key=len, reverse=True)
    piece = rf"(&#[0-9]{{1,7}};?|&#[xX][0-9a-fA-F]{{1,6}};?|&[A-Za-z][A-Za-z0-9]*;|&(?:{'|'.join(loose)})|&|[^&]+)"
    table = F.create_map(*[F.lit(x) for n, c in named.items() for x in ("&" + n, c)])
    windows = F.create_map(*[F.lit(x) for n in range(0x80, 0xA0) for x in (n, bytes([n]).decode("cp1252", "ignore") or chr(n))])

    def sign(p: Column) -> Column:
        digits = F.regexp_extract(p, r"^&#([0-9]+);?$", 1)
        number = F.when(digits != "", digits.cast("int")).otherwise(F.conv(F.regexp_extract(p, r"^&#[xX]([0-9a-fA-F]+);?$", 1), 16, 10).cast("int"))
        bad = (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
        char = F.when(bad, "\ufffd").when(number.between(0x80, 0x9F), windows[number]).otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        # of a run such as &nbspx; only the start may be a name
        start = F.regexp_extract(p, rf"^&(?:{'|'.join(loose)})", 0)
        known = F.coalesce(F.try_element_at(table, p), F.when(start != "", F.concat(F.try_element_at(table, start), F.substring(p, F.length(start) + 1, F.length(p)))))
        return F.when(F.startswith(p, F.lit("&#")) & (F.length(p) > 2), F.coalesce(char, p)).when(F.startswith(p, F.lit("&")), F.coalesce(known, p)).otherwise(p)

    whole = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(piece), F.lit(1)), sign), "")
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def remove_html(text: Column) -> Column:
    """Unescape character references, drop tags and links, runs of white space to one space. Script and style bodies go with their tags."""
    text = F.regexp_replace(unescape_html(text), r"(?is)<(script|style)\b[^>]*>.*?</\1>", "")
    text = F.regexp_replace(text, r"<[/!a-zA-Z][^<>]*>", "")
    text = F.regexp_replace(text, r"http[s]?://\S+", "")
    return F.regexp_replace(text, r"[\s\p{Z}\x1c-\x1f\x85]+", " ")


def clean_if_marked(text: Column) -> Column:
    """Clean only texts that have one of the separators."""
    return F.when(text.rlike(SEPARATOR_CLASS), remove_html(text)).otherwise(text)


def drop_sentences_with(text: Column, words) -> Column:
    """If any of the words occurs (as a substring, any case), drop the sentences that have one as a whole word."""
    whole = r"(?iuU)\b(?:" + "|".join(words) + r")\b"
    touched = F.lower(text).rlike("|".join(words))
    return F.when(touched, F.array_join(F.filter(sentences(text), lambda s: ~s.rlike(whole)), " ")).otherwise(text)


def capitalize(word: Column) -> Column:
    """First letter upper, all others lower (also of later words)."""
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word))))


def generic_sentence(noun: Column, h_aspirated: list[str]) -> Column:
    """The carrier sentence with ``l'`` before a vowel or mute h, else ``le``."""
    first = F.substring(noun, 1, 1)
    bare = F.regexp_replace(noun, r"^\p{Punct}+|\p{Punct}+$", "")
    elides = first.isin(*V.VOWELS) | ((first == "h") & ~bare.isin(*h_aspirated))
    return F.concat(F.lit("Toute sa vie durant, "), F.when(elides, "l'").otherwise("le"), F.lit(" "), noun, F.lit(" n'a fait qu'essuyer les échecs."))


def strip_content(text: Column, punctuation: bool = False) -> Column:
    """Without tags and blanks; optionally without a leading ``, `` or a trailing comma."""
    bare = F.trim(F.regexp_replace(text, r"<[^>]*>", ""))
    return F.trim(F.regexp_replace(bare, r"(^(, )|,$)", "")) if punctuation else bare


def translate_values(c: Column, table: dict[str, str]) -> Column:
    """trimmed value through a table, others unchanged."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(pairs[F.trim(c)], F.trim(c))


def merged_classes(cls: Column, sub: Column) -> Column:
    """The distinct non-empty ones of class and subclass, joined by ``, ``."""
    return F.array_join(F.array_distinct(F.filter(F.array(cls, sub), lambda x: x.isNotNull() & (x != ""))), ", ")


def blank_to_null(c: Column) -> Column:
    return F.when(~c.rlike(r"^\s*$"), c)


def dataset_of(text_id: Column) -> Column:
    """dataset name of an id without its trailing number."""
    return F.regexp_replace(text_id, r"_\d+$", "")


def dataset_group(dataset: Column) -> Column:
    """group of a dataset; unknown names raise."""
    out = F.raise_error(F.concat(F.lit("unknown dataset "), dataset)).cast("string")
    for group, names in V.DATASET_GROUPS.items():
        out = F.when(dataset.isin(*names), group).otherwise(out)
    return out


def suffix_score(word: Column, compat: bool = False) -> Column:
    """H4: 1 if the word has a human suffix. ``compat=True`` always gives 0, as a broken suffix file does."""
    return F.lit(0) if compat else word.rlike("(?:" + "|".join(V.HUMAN_SUFFIXES) + ")$").cast("int")


def indicator_score(gloss: Column, indicators) -> Column:
    """H2 for one gloss: how many indicators it contains (substrings count)."""
    low = F.lower(gloss)
    return sum((F.contains(low, F.lit(w)).cast("int") for w in indicators), F.lit(0))


def headword(complete: Column) -> Column:
    """The word form of a dictionary headword."""
    head = F.lower(F.split(complete, ",")[0])
    special = head.rlike("|".join(V.SPECIAL_SPLIT_WORDS))
    bad = head.rlike("|".join(V.BADLY_FORMATTED_WORDS))
    pieces = F.split(complete, " ")
    first = F.when(pieces[0].isin("un", "une"), F.get(pieces, F.lit(1))).otherwise(pieces[0])
    plain = F.lower(F.regexp_replace(F.regexp_replace(first, r"[.,\d\s]|\(\w+\)", ""), r"\((-)\)", "-"))
    gendered = "|".join(f"({base})-{other}$" for base, other in V.GENDER_SUFFIXES.items())
    return F.when(special, head).when(bad, F.replace(head, F.lit("subst."), F.lit(""))).otherwise(F.regexp_replace(plain, gendered, "$1"))


def sections(text: Column) -> Column:
    """Map of section name to content; a section runs to the next heading, the last of a name wins."""
    heads = [h for hs in V.SECTION_HEADINGS.values() for h in hs]
    mark = "(" + "|".join(re.escape(h) for h in heads) + r")\s*[.:−]?\s*"
    pieces = F.split(F.regexp_replace(text, mark, "\u0001$1\u0002"), "\u0001")
    named = F.create_map(*[F.lit(x) for name, hs in V.SECTION_HEADINGS.items() for h in hs for x in (h, name)])
    found = F.transform(F.slice(pieces, 2, 1_000_000), lambda p: F.struct(named[F.split(p, "\u0002")[0]].alias("name"), F.trim(F.split(p, "\u0002")[1]).alias("content")))
    last = F.filter(F.transform(found, lambda x, i: F.struct(x["name"].alias("name"), x["content"].alias("content"), i.alias("i"))), lambda x: ~F.exists(F.slice(found, x["i"] + 2, F.size(found) + 1), lambda y: y["name"] == x["name"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["name"], x["content"])))


def derivatives(content: Column) -> Column:
    """Comma-separated derivatives, trimmed, the first full stop of each removed; null without content."""
    return F.transform(F.split(content, ","), lambda d: F.regexp_replace(F.trim(d), r"^([^.]*)\.", "$1"))


def result_counts(text: Column) -> Column:
    """struct<first, last, total> of ``Résultats a à b/n``, null where it does not parse."""
    p = r"Résultats (\d+) à (\d+)/(\d+)"
    return F.when(text.rlike(p), F.struct(*[F.regexp_extract(text, p, k + 1).cast("int").alias(n) for k, n in enumerate(("first", "last", "total"))]))


def interesting_definitions(definitions: Column) -> Column:
    """Distinct definitions, a trailing `` :`` removed, that mention a person word (as a substring)."""
    cleaned = F.array_distinct(F.transform(definitions, lambda d: F.trim(F.regexp_replace(d, r"\s:$", ""))))
    return F.filter(cleaned, lambda d: F.lower(d).rlike("|".join(V.DEFINITION_WORDS)))


def example_parts(html: Column) -> Column:
    """struct<example, author, title, date> of an example's HTML."""
    grab = lambda c: F.regexp_extract(html, f'<span class="{c}">(.*?)</span>', 1)
    example = strip_content(F.regexp_replace(F.split(html, '<span class="tlf_cauteur">')[0], r"^((?s:.*?))\d+\. ", "$1"))
    title = F.regexp_replace(strip_content(grab("tlf_ctitre"), True), r",(t. \d+)", ", $1")
    date = F.trim(F.regexp_replace(grab("tlf_cdate"), r"^([^,]*),", "$1"))
    return F.struct(example.alias("example"), strip_content(grab("tlf_cauteur")).alias("author"), title.alias("title"), date.alias("date"))


def sense_rank(glosses_json: Column) -> Column:
    """rank of the first key of a gloss object: 0 for a key that ends in ``item``, else the number after it; null on failure."""
    key = F.get(F.json_object_keys(glosses_json), F.lit(0))
    return F.when(key.endswith("item"), 0).otherwise(F.nullif(F.regexp_extract(key, r"item(\d+)$", 1), F.lit("")).try_cast("int"))


def is_feminine_pair(word_type: Column, complete: Column) -> Column:
    """substantives such as ``ACTEUR, TRICE`` whose second part is shorter than the first by more than one letter."""
    parts = F.split(complete, ",")
    shorter = F.length(F.trim(F.get(parts, F.lit(1)))) < F.length(F.trim(parts[0])) - 1
    return F.coalesce(F.contains(word_type, F.lit("subst")) & complete.rlike(r"^[A-Z]+,\s[A-Z]+") & shorter, F.lit(False))


def is_clean_noun(word: Column) -> Column:
    """at least three characters, no digit, only letters, digits and ``_``."""
    return (F.length(word) >= 3) & ~word.rlike(r"\d") & word.rlike(r"^[\p{L}\p{N}_]+$")


def fallback_noun(male_label: Column, label: Column) -> Column:
    """F16: the male label unless blank, else the first word of the label."""
    return F.coalesce(blank_to_null(male_label), F.split(F.trim(label), r"\s+")[0])
