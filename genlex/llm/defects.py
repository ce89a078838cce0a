"""Problem 3: instruction-response pairs whose response is no sound answer, with the kind of defect.

Method: ordered rules in built-in expressions (no Python per row): emptiness, copies, unclosed delimiters and abrupt endings,
refusal phrases in four languages, and script mismatch. Scripts cannot tell French, English, German and Spanish apart, so the
last rule also compares profiles of function words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookalikes import BLANKS

# What stands for "no answer" (lower case, without blanks at the ends). "aucun" and "none" can be answers and are not here.
NO_ANSWER = (
    "n/a", "n.a.", "#n/a", "na", "nan", "null", "(null)", "nil", "undefined", "tbd", "todo", "[vide]", "(vide)", "<vide>", "vide", "[empty]", "(empty)", "<empty>", "empty", "[leer]", "(leer)", "[vacío]", "(vacío)",
    "(sans réponse)", "[sans réponse]", "sans réponse", "pas de réponse", "(pas de réponse)", "aucune réponse", "réponse à venir", "à compléter", "(no answer)", "[no answer]", "no answer", "no response", "no output", "<no output>", "<nooutput>", "<noinput>",
    "keine antwort", "(keine antwort)", "sin respuesta", "(sin respuesta)",
)
# Labels that stand before an instruction or an answer.
LABELS = r"(?:consigne|instruction|question|demande|énoncé|prompt|réponse|response|answer|output|sortie|antwort|frage|aufgabe|anweisung|respuesta|pregunta|instrucción|tarea)"

# Function words, common adverbs and request verbs by language; a word found in two lists counts for neither.
FUNCTION_WORDS = {
    "fr": "l d qu n c j de a à y en le la les des du une un est sont dans pour avec sur qui que quoi ce cet cette ces ne pas plus au aux et ou où quand chaque tous toute tout on il elle ils elles nous vous leur leurs ses sa son être fait comme mais donc car par sans sous chez entre très aussi peut doit doivent faut je tu mon ma mes votre notre cela pourquoi comment jamais rien combien plusieurs environ voici voilà selon avant après pendant depuis près malgré dont afin parce si se s même deux trois quatre cinq six sept huit neuf dix premier puis bien souvent parfois cependant oui non aucun quelle quel donne rédige écris décris explique imagine propose résume classe réponds cite recopie traduis",
    "en": "the a an of to and in is are was were that this these those for with on at by from as it its be been not no yes or but if when which who whom what how why there their they them he she his her you your we our can could should must will would may might do does did have has had about into every each nobody never someone give write describe explain answer list translate two three four five six seven eight nine ten however besides sometimes before after during since until while because than then so such only also very near beside word person sure course first next long ago",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber ist sind war waren nicht kein keine zu mit von für auf im in am bei nach aus wenn dann ob dass als wie wer was warum man er sie es wir ihr ich du sich sein ihre seine jeder jede jedes wird werden hat haben kann muss soll darf zuerst noch nur sehr auch niemand zwei drei vier fünf sechs sieben acht neun zehn jedoch früher manchmal trotz vor während seit bis weil durch über unter zwischen gilt beschreibe schreibe erkläre antworte nenne gib übersetze gern ja nein wort tag",
    "es": "el la los las un una unos unas de del y o pero es son era no sí que qué quien quién por para con sin sobre entre en se su sus lo al como cómo cuando cuándo cada todo todos toda nadie nunca hay más muy también este esta estos estas ese esa yo tú usted él ella nosotros ellos ser está puede debe fue porque primero luego dos tres cuatro cinco seis siete ocho nueve diez antes después durante desde hasta según cerca pesar además veces antaño ejemplo general caso supuesto día describe escribe explica responde da resume traduce palabra",
}
# Letters and signs that only one of these languages uses.
OWN_LETTERS = {"fr": "èêàâîôçœûëù", "en": "", "de": "äöüß", "es": "ñáíóú¿¡"}
LATIN = "[A-Za-zªºÀ-ÖØ-öø-ʸ]"
BEYOND_LATIN = r"[\u0370-\u1FFF\u2C60-\uD7FF\uF900-\x{10FFFF}]"
SCRIPTS = {
    "latin": r"\p{IsLatin}", "cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "arabic": r"\p{IsArabic}", "hebrew": r"\p{IsHebrew}",
    "cjk": r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]", "devanagari": r"\p{IsDevanagari}", "thai": r"\p{IsThai}",
}

# How an answer declines. Matched in lower case with plain apostrophes and single blanks, at the start of a sentence after the
# openings below. What is repeated gives nothing back, so no text makes the match try it in several ways.
OPENINGS = (
    r"(?:merci (?:pour|de) [^.!?]*+[.!?] ?+|bonjour[^.!?,]*+[.!?,] ?+|thank you [^.!?]*+[.!?] ?+|hello[^.!?,]*+[.!?,] ?+|danke [^.!?]*+[.!?] ?+|gracias [^.!?]*+[.!?] ?+)?"
    r"(?:(?:je suis (?:vraiment |sincèrement |profondément )?(?:désolée?|navrée?)|désolée?|navrée?|hélas|malheureusement|je regrette|pardon|excusez-moi|toutes mes excuses|i'm (?:very |really |so )?sorry|i am (?:very |really |so )?sorry|sorry|"
    r"unfortunately|apologies|my apologies|i apologi[sz]e|i regret|i'm afraid|i am afraid|es tut mir (?:sehr )?leid|tut mir leid|leider(?: gilt)?|entschuldigung|lo siento(?: mucho)?|por desgracia|lamentablemente|desafortunadamente|lamento|perdón|disculpe)"
    r" ?+[,:;.!–—-]*+ ?+(?:(?:mais|but|aber|pero|que|that|however|jedoch)\b)?+ ?+,?+ ?+)*+"
)
DECLINES = (
    r"(?:je|nous) ne (?:peux|puis|pourrai|pourrais|saurais|pouvons) (?:malheureusement |hélas )?(?:pas|point|rien)\b(?! que)", r"je ne suis pas (?:en mesure|autorisée?|habilitée?|capable|en position|programmée?)",
    r"(?:il|cela) (?:m'est|nous est) (?:malheureusement |hélas )?impossible", r"impossible (?:pour moi )?de (?:répondre|traiter|donner suite|vous aider)", r"(?:en tant (?:que|qu')[^,.!?]*, )?(?:je|nous) (?:dois|devons|préfère|préférons|me vois contrainte? de|suis contrainte? de) (?:\w+ )?(?:décliner|refuser|m'abstenir|ne pas)",
    r"je (?:décline|refuse|m'abstiens)", r"je ne (?:souhaite|veux|désire|compte) pas", r"(?:mes|les) (?:consignes|règles|instructions|principes) (?:m'interdisent|ne me permettent pas|ne m'autorisent pas|m'empêchent)", r"je n'ai pas (?:le droit|l'autorisation|accès|la possibilité|la permission)",
    r"on ne m'a pas (?:donné|autorisé|permis)", r"(?:cette|votre|la) (?:question|demande|requête) (?:dépasse|sort|excède)", r"je préfère ne pas",
    r"i (?:can't|cannot|can not|could not|couldn't|won't|will not|must decline|have to decline|must refuse|am unable|am not able|am not allowed|am not permitted|don't have access|do not have access|prefer not to|would prefer not|would rather not)", r"i'(?:m|d) (?:not able|unable|not allowed|not permitted|rather not|prefer not)",
    r"(?:as an? [^,.!?]*, )i (?:can't|cannot|must|am not|am unable)", r"this is (?:something|a topic|a request) i (?:have to|must) (?:decline|refuse)", r"(?:my|the) (?:guidelines|instructions|rules) (?:forbid|do not allow|don't allow|prevent)",
    r"(?:das|dies|dazu|darauf|diese (?:bitte|frage|anfrage)|hier|dabei) (?:kann|darf|muss|möchte|werde) ich (?:leider )?(?:nicht|nichts|ablehnen|nicht \w+)", r"ich (?:kann|darf|möchte|werde) (?:das|dies|dazu|darauf|ihnen|dir|diese \w+|hierzu)?\s*(?:leider )?(?:nicht|nichts|keine)\b", r"ich (?:muss|möchte) [^.!?]{0,40}ablehnen", r"(?:es ist mir|mir ist es) nicht (?:möglich|erlaubt|gestattet)",
    r"no (?:puedo|podría|podemos|me es posible|me está permitido|estoy autorizad[oa]|estoy en condiciones|tengo (?:permiso|acceso))", r"(?:debo|tengo que|prefiero) (?:rechazar|declinar|no )", r"me es imposible", r"(?:mis|las) (?:normas|instrucciones|reglas) (?:me prohíben|no me permiten)",
)
# What an instruction asks for. Verbs count as requests at its start only; elsewhere they tell what somebody does.
ASKS_REFUSAL = r"\b(?:refus|lettre de refus|réponse négative|refusal|rejection|ablehnung|absage|negativa|rechazo)\b|^\W*(?:refuse[rz]?|décline[rz]?|decline|reject|turn down|politely (?:refuse|decline)|lehne|rechaza|declina)\b"
ASKS_COPY = (
    r"^\W*(?:recopie[rz]?|copie[rz]?|répète[rz]?|répéter|répétez|reproduis\w*|reproduire|copy|repeat|reproduce|kopiere|wiederhole|schreibe? .{0,30}\bab\b|copia|copie|repite|reproduce)\b|"
    r"\b(?:sans (?:rien )?(?:y )?(?:changer|modifier)|mot pour mot|à l'identique|verbatim|word for word|without (?:any )?chang\w+|unchanged|wortwörtlich|wort für wort|unverändert|sin cambiar|palabra por palabra)\b"
)
ASKS_LANGUAGE = (
    r"\b(?:tradui[st]\w*|traduire|traduction|translat(?:e|es|ed|ing|ion)|übersetz(?:e|en|t|ung)|traduce|traducir|traduzca|traducción)\b|\ben (?:anglais|français|allemand|espagnol|italien|portugais|latin|russe|chinois|japonais|arabe|néerlandais|breton|occitan)\b|"
    r"\b(?:in|into) (?:english|french|german|spanish|italian|portuguese|latin|russian|chinese|japanese|arabic|dutch)\b|\b(?:auf|ins) (?:deutsch|deutsche|englisch|englische|französisch|französische|spanisch|spanische|italienisch)\b|\ben (?:inglés|francés|alemán|español|italiano|portugués)\b"
)
DELIMITERS = (("(", ")"), ("[", "]"), ("{", "}"), ("«", "»"), ("“", "”"), ("‹", "›"))
LONG = 4_000  # letters: longer copies are told by their shingles, as edit distance takes quadratic time


def _bare(text: Column) -> Column:
    """Without blanks and invisible characters at the ends; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^{BLANKS}|{BLANKS}$", "")


def _plain(text: Column) -> Column:
    """Lower case, plain apostrophes, every run of blanks one space."""
    return F.regexp_replace(F.lower(F.translate(text, "’‘ʼ`´", "'''''")), r"[\s\p{Z}]+", " ")


def _words(text: Column) -> Column:
    """Letters and digits in lower case, everything else one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _lines(text: Column) -> Column:
    """Runs of blanks in a line shortened to one space, none at its ends, several blank lines to one."""
    text = F.regexp_replace(text, r"[ \t\x0b\f\r\u00a0\u202f]+", " ")
    return F.regexp_replace(F.regexp_replace(text, r" ?\n ?", "\n"), r"\n\n+", "\n\n")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _count(text: Column, sign: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))) / len(sign)


def _decide(counts: dict[str, Column]) -> Column:
    """The key with the highest count, if twice as high as any other and at least two more; else null."""
    ranked = F.array_sort(F.array(*[F.struct((-c).alias("n"), F.lit(k).alias("k")) for k, c in counts.items()]))
    return _let(ranked, lambda r: F.when((r[1]["n"] - r[0]["n"] >= 2) & (r[0]["n"] <= 2 * r[1]["n"]), r[0]["k"]))


def language_of(text: Column) -> Column:
    """fr, en, de or es by function words and letters that belong to one of them only; null where they do not decide.

    Words are looked up in hash sets, which costs a tenth of matching them as alternatives of a pattern; most are in none and
    need one look-up.
    """
    lists = {k: set(v.split()) for k, v in FUNCTION_WORDS.items()}
    own = {k: sorted(w for w in v if not any(w in o for j, o in lists.items() if j != k)) for k, v in lists.items()}
    every = sorted(w for v in own.values() for w in v)
    digit = {k: n for n, k in enumerate(own)}

    def worth(w: Column) -> Column:
        out = F.lit(digit["fr"])
        for k in ("es", "de", "en"):
            out = F.when(w.isin(*own[k]), digit[k]).otherwise(out)
        return out

    def judge(x: Column) -> Column:
        known = F.filter(x["words"], lambda w: w.isin(*every))
        return _let(F.transform(known, worth), lambda v: _decide({k: F.size(v) - F.size(F.array_remove(v, n)) + (F.length(F.regexp_replace(x["letters"], f"[^{OWN_LETTERS[k]}]", "")) if OWN_LETTERS[k] else F.lit(0)) for n, k in enumerate(own)}))

    low = F.lower(F.coalesce(text, F.lit("")))
    letters = F.regexp_replace(low, f"[^{''.join(OWN_LETTERS.values())}]+", "")
    return _let(F.struct(F.split(low, r"[^\p{L}]+").alias("words"), letters.alias("letters")), judge)


def script_of(text: Column) -> Column:
    """The script of most letters; null where they do not decide. Texts without any sign beyond Latin, most of all, need one look."""
    text = F.coalesce(text, F.lit(""))
    all_latin = F.when(text.rlike(f"{LATIN}(?s:.*?){LATIN}"), "latin")
    return F.when(~text.rlike(BEYOND_LATIN), all_latin).otherwise(_decide({k: F.regexp_count(text, F.lit(p)) for k, p in SCRIPTS.items()}))


def is_empty(bare: Column) -> Column:
    """Nothing there: null, blanks, no letter or digit, a stand-in for nothing, or a label without anything after it."""
    return ~bare.rlike(r"[\p{L}\p{N}]") | F.lower(bare).isin(*NO_ANSWER) | (F.length(bare) < 30) & _plain(bare).rlike(f"^{LABELS} ?:$")


def is_refusal(plain_asked: Column, plain: Column) -> Column:
    """A sentence among the first two declines, and the instruction did not ask for a text that declines."""
    declines = rf"(?U)^(?:[^.!?]{{0,80}}[.!?] )?{OPENINGS}(?:{'|'.join(DECLINES)})"
    return plain.rlike(declines) & ~plain_asked.rlike(f"(?U){ASKS_REFUSAL}")


def is_copy(plain_asked: Column, asked: Column, given: Column) -> Column:
    """The output's words are the instruction's, once or several times over, with at most a tenth of the characters or one word in eight changed.

    ``asked`` and ``given`` are words. Of more than ``LONG`` characters: at least 0.8 of all shingles of five words are common to both.
    """
    over_and_over = (F.length(given) > F.length(asked)) & (F.trim(F.replace(given, asked, F.lit(""))) == "")
    close = (F.length(given) > 0) & (F.abs(F.length(asked) - F.length(given)) * 10 <= F.length(asked))
    short = F.length(asked) <= LONG
    distance = F.levenshtein(F.when(close & short & (asked != given), asked), F.when(close & short, given))
    shingles = lambda c: _let(F.split(c, " "), lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 5, F.lit(0))), lambda k: F.xxhash64(*[F.get(w, k + j) for j in range(5)]))))
    both = _let(F.struct(shingles(asked).alias("a"), shingles(given).alias("b")), lambda x: F.size(F.array_intersect(x["a"], x["b"])) >= 0.8 * F.size(F.array_union(x["a"], x["b"])))
    swapped = _let(F.struct(F.split(asked, " ").alias("a"), F.split(given, " ").alias("b")), lambda x: (F.size(x["a"]) == F.size(x["b"])) & (F.size(F.filter(F.zip_with(x["a"], x["b"], lambda v, w: v != w), lambda d: d)) * 8 <= F.greatest(F.size(x["a"]), F.when(F.size(x["a"]) >= 5, F.lit(8)).otherwise(0))))
    near = (F.length(given) > 0) & (F.abs(F.length(asked) - F.length(given)) * 4 <= F.length(asked)) & swapped
    same = (asked == given) | F.when(short, distance * 10 <= F.length(asked)).otherwise(both)
    return ((close & same) | near | over_and_over) & ~plain_asked.rlike(f"(?U){ASKS_COPY}")


def is_truncated(asked: Column, text: Column, words: Column) -> Column:
    """Something is left open (a bracket, a quotation, a code block), or the text stops without an end.

    A text that stops after a letter, digit or separator still counts as complete if it is a very short answer, a list whose
    items all go without a full stop, a closing line or a source note after a blank line, or a passage taken from the instruction.
    ``text``: as ``_lines`` gives it; ``asked`` and ``words``: words of instruction and output.
    """
    signs = F.regexp_replace(text, r"[^()\[\]{}«»“”‹›\"`]+", "")
    unequal = lambda s: reduce(lambda a, b: a | b, [_count(s, a) > _count(s, b) for a, b in DELIMITERS] + [_count(s, '"') % 2 == 1])
    opened = (signs != "") & (_let(signs, unequal) | (_count(text, "```") % 2 == 1))

    def stops(x: Column) -> Column:
        lines, blocks, end = x["lines"], x["blocks"], x["end"]
        last = F.element_at(lines, -1)
        ended = end.isin(*".!?…»”\"')]}’›") | (end.isin("*", "_", "`") & last.rlike(r"[.!?…][*_`]+$"))
        separator = end.isin(*",;:([{«“–—/-")
        short = (F.size(lines) == 1) & (F.size(F.split(last, r"\s+")) <= 3) & ~separator
        items = F.filter(lines, lambda t: t.rlike(r"^(?:\d{1,3}[.)]|[-*•–])\s"))
        open_items = F.filter(items, lambda t: ~F.substring(t, -1, 1).isin(*".!?…;,"))
        bare_list = last.rlike(r"^(?:\d{1,3}[.)]|[-*•–])\s+\S") & (F.size(items) >= 2) & (F.size(open_items) == F.size(items)) & ~separator
        closing = F.element_at(blocks, -1)
        before = F.substring(F.get(blocks, F.size(blocks) - 2), -1, 1)
        tail = (F.size(blocks) > 1) & before.isin(*".!?…»”\"')]}") & ~F.contains(closing, F.lit("\n")) & (F.length(closing) <= 61) & closing.rlike(r"^\p{Lu}") & ~separator
        short_tail = F.size(F.split(last, r"\s+")) <= 4
        note = last.rlike(r"^\p{Lu}[\p{L} ]{0,20}\s?:\s*\S")
        address = F.element_at(F.split(last, " "), -1).rlike(r"https?://\S+$|\S@\S+\.\p{L}+$")
        return ~ended & ~(short | bare_list | (tail & (short_tail | note)) | address)

    parts = F.struct(F.split(text, r"\n+").alias("lines"), F.split(text, r"\n\n").alias("blocks"), F.substring(text, -1, 1).alias("end"))
    taken = F.coalesce((F.length(words) > 0) & F.contains(asked, words), F.lit(False))
    marker_only = F.substring(text, -6, 6).rlike(r"\n(?:\d{1,3}[.)]|[-*•–])$")
    return opened | marker_only | (_let(parts, stops) & ~taken)


def is_other_language(plain_asked: Column, asked: Column, bare_asked: Column, bare: Column, words: Column) -> Column:
    """Script or language of the output differs from the instruction's, which neither asks for a language nor holds the output itself."""
    body = F.regexp_replace(bare, r"(?s)^[^.!?:\n]{1,25}[.!?:]\s++(?=.{21})", "")  # without an opening such as "Of course."
    scripts, languages = script_of(bare_asked) != script_of(bare), language_of(bare_asked) != language_of(body)
    held = F.coalesce(F.contains(asked, words), F.lit(False))
    return (F.coalesce(scripts, F.lit(False)) | F.coalesce(languages, F.lit(False))) & ~plain_asked.rlike(f"(?U){ASKS_LANGUAGE}") & ~held


def defects(pairs: DataFrame, id_col: str = "pair_id", instruction_col: str = "instruction", output_col: str = "output") -> DataFrame:
    """``(id_col, defect)``: one row per pair and triggered defect among empty, copy, truncated, refusal and language.

    The rules run in this order and each triggered one gives a row. Truncation, refusal and language are judged of outputs
    that say something (not of empty ones), truncation and language of answers (a copy ends where its instruction ends and
    speaks its language). A null or blank instruction is no defect: the rules that compare with it then do not fire. Repeated
    rows give repeated results, an empty table none; whole texts are read, of any length, in time linear in it. One narrow
    stage: no shuffle, no Python; each normal form of a text is computed once, and the dearer rules see only what is left.
    """
    i, o = F.col("i"), F.col("o")
    src = pairs.select(F.col(id_col).alias("id"), _bare(F.col(instruction_col).cast("string")).alias("i"), _bare(F.col(output_col).cast("string")).alias("o"))
    label = r"^[^.!?:\n]{1,40}:\s*"  # "Instruction:", "You ask:": what stands before is no answer
    forms = src.select("id", "i", "o", _plain(i).alias("pi"), _plain(o).alias("po"), _words(i).alias("wi"), _words(o).alias("wo"), F.when(o.rlike(label), _words(F.regexp_replace(o, label, ""))).alias("wl"), _lines(o).alias("lo"), is_empty(o).alias("empty"))
    pi, po, wi, wo, lo = (F.col(c) for c in ("pi", "po", "wi", "wo", "lo"))
    asks, says = F.length(wi) > 0, ~F.col("empty")
    flags = forms.select("*", F.coalesce(says & asks & (is_copy(pi, wi, wo) | F.coalesce(is_copy(pi, wi, F.col("wl")), F.lit(False))), F.lit(False)).alias("copy"))
    answers = says & ~F.col("copy")
    found = F.array_compact(
        F.array(
            F.when(F.col("empty"), "empty"), F.when(F.col("copy"), "copy"), F.when(answers & is_truncated(wi, lo, wo), "truncated"), F.when(says & is_refusal(pi, po), "refusal"),
            F.when(answers & asks & is_other_language(pi, wi, i, o, wo), "language"),
        )
    )
    return flags.select(F.col("id").alias(id_col), F.explode(found).alias("defect"))
