import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from genlex.functions import text as T
from genlex.functions import values as V


def column(spark, f, values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}").select("k", f(F.col("v")).alias("x")).orderBy("k").select("x").collect()]


SEPARATOR_CASES = {
    "auteur·e": "·e", "auteur·rice": "·rice", "étudiant(e)": "(e", "étudiant.e.s": ".e", "premi·ère": "·ère", "brûl·e": "·e", "cœur·e": None, "et/le": "/le", "print(e)": "(e", "maison": None, "": None,
}


def test_separator_form(spark):
    assert column(spark, T.separator_form, list(SEPARATOR_CASES)) == list(SEPARATOR_CASES.values())


def test_upper_form(spark):
    assert column(spark, T.upper_form, ["auteurRICES", "ÉTUDIANTE", "sûrE", "étudiantE", None]) == ["RICES", None, None, "E", None]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.text("aeiourtéèû", min_size=1, max_size=6), st.sampled_from(V.SEPARATORS), st.sampled_from([*V.FEMININE_ENDINGS, "x", "ard"]), st.booleans()), min_size=20, max_size=60))
def test_separator_form_agrees_with_python(spark, parts):
    words = [s + sep + (e.lower() if low else e) for s, sep, e, low in parts]
    p = re.compile(r"[A-zÀ-ú]+((" + "|".join(map(re.escape, V.SEPARATORS)) + ")(?:" + "|".join(sorted(V.FEMININE_ENDINGS, key=len, reverse=True)) + r"))\b", re.IGNORECASE)
    assert column(spark, T.separator_form, words) == [m.group(1) if (m := p.match(w)) else None for w in words]


def test_phrases(spark):
    got = column(spark, lambda c: T.phrase_hits(T.sentences(c), V.INCLUSIVE_PAIRS), ["Ceux et celles qui lisent. Il ou elle écrit, il ou elle dort.", None, "", "ceuxetcelles"])
    assert [[h["hit"] for h in x] for x in got] == [["Ceux et celles", "Il ou elle", "il ou elle"], [], [], []]
    assert got[0][0]["sentence"] == "Ceux et celles qui lisent."


def test_tokens_keep_inclusive_forms_and_split_clitics(spark):
    assert column(spark, T.tokens, ["L'auteur·rice voit 12 étudiant(e)s.", None]) == [["L'", "auteur·rice", "voit", "12", "étudiant(e)s", "."], []]


def test_very_long_text(spark):
    long = "Un mot. " * 50_000 + "-a" * 2000
    assert len(column(spark, T.sentences, [long])[0]) == 50_001
    assert len(column(spark, T.tokens, ["x " * 100_000])[0]) == 100_000


def test_cleaning(spark):
    assert column(spark, T.remove_html, ["<p>a&nbsp;&lt; b</p>\n http://x.y/z fin", None]) == ["a < b fin", None]


def test_cleaning_needs_a_separator(spark):
    assert column(spark, T.clean_if_marked, ["<i>x", "a <i>gr·e<i>"]) == ["<i>x", "a gr·e"]


def test_sentence_removal(spark):
    f = lambda c: T.drop_sentences_with(c, V.ORACLE_WORDS)
    assert column(spark, f, ["La pythie parle. Il pleut.  Fin.", "Rien  ici.", "Coracle seul. Fin.", None]) == ["Il pleut. Fin.", "Rien  ici.", "Coracle seul. Fin.", None]


def test_small_expressions(spark):
    assert column(spark, T.capitalize, ["dUPONT durand", "é", ""]) == ["Dupont durand", "É", ""]
    assert column(spark, lambda c: T.generic_sentence(c, ["héros"]), ["homme", "héros", "avocat", "maçon"]) == [f"Toute sa vie durant, {d} {n} n'a fait qu'essuyer les échecs." for d, n in (("l'", "homme"), ("le", "héros"), ("l'", "avocat"), ("le", "maçon"))]
    assert column(spark, lambda c: T.translate_values(c, V.CLASS_NAMES), [" NH-Mét", "N Général", "autre", None]) == ["profession", "", "autre", None]
    assert column(spark, T.dataset_of, ["llama_12", "gpt4o_mini_3", "x"]) == ["llama", "gpt4o_mini", "x"]
    assert column(spark, T.blank_to_null, [" ", "", "a ", None]) == [None, None, "a ", None]
    assert column(spark, T.suffix_score, ["acteur", "table", "fille"]) == [1, 0, 0]
    assert column(spark, lambda c: T.suffix_score(c, compat=True), ["acteur"]) == [0]
    assert column(spark, lambda c: T.indicator_score(c, V.HUMAN_INDICATORS), ["the whole person", ""]) == [2, 0]
    assert column(spark, T.sense_rank, ['{"a.item": "x"}', '{"a.item12": "x"}', "broken", '{"z": 1}', None]) == [0, 12, None, None, None]
    assert column(spark, T.is_clean_noun, ["ab", "abc", "a1c", "a_c", "a-c"]) == [False, True, False, True, False]


def test_dataset_group(spark):
    assert column(spark, T.dataset_group, ["oasst2", "llama"]) == ["human_instr", "llm_local"]
    with pytest.raises(Exception, match="unknown dataset"):
        column(spark, T.dataset_group, ["x"])


def test_dictionary_parsers(spark):
    assert column(spark, T.headword, ["campagnard-arde, adj.", "un tribordais, subst.", "ALTER EGO, subst.", "anti(-)impérialiste, adj.", "Cryptocommunistesubst., x", "danseur-euse, s."]) == ["campagn", "tribordais", "alter ego", "anti-impérialiste", "cryptocommuniste", "danseur"]
    text = "Prononc. : [a]. Étymol. et Hist. 1200. Der. et composés a, b. , c. Étymol. : deux"
    got = column(spark, T.sections, [text])[0]
    assert got == {"prononciation": "[a].", "etyhist": "deux", "derives": "a, b. , c."}
    assert column(spark, T.derivatives, ["a, b. , c.", None]) == [["a", "b", "c"], None]
    r = column(spark, T.result_counts, ["Résultats 1 à 20/345 ", "rien"])
    assert (tuple(r[0]), r[1]) == ((1, 20, 345), None)
    html = '12. Un <b>exemple</b>, <span class="tlf_cauteur">Hugo</span><span class="tlf_ctitre">, Les M.,t. 2,</span><span class="tlf_cdate">1862,</span>'
    assert tuple(column(spark, T.example_parts, [html])[0]) == ("Un exemple,", "Hugo", "Les M., t. 2", "1862")
    assert column(spark, T.interesting_definitions, [["Personne qui lit :", "Personne qui lit", "Chose"]], "array<string>") == [["Personne qui lit"]]


def test_feminine_pair(spark):
    rows = spark.createDataFrame([("subst. masc.", "ACTEUR, TRICE"), ("adj.", "ACTEUR, TRICE"), ("subst.", "ACTEUR"), ("subst.", "AMI, AMIE"), (None, None)], "t string, c string")
    assert [r[0] for r in rows.select(T.is_feminine_pair(F.col("t"), F.col("c"))).collect()] == [False] * 5
    longer = spark.createDataFrame([("subst.", "EXAMINATEUR, TRICE")], "t string, c string")
    assert longer.where(T.is_feminine_pair(F.col("t"), F.col("c"))).count() == 1


def test_every_character_reference(spark):
    import html

    texts = ["&ecirc;&mdash;&#8217;&#xe9;&#XE9 &ocirc;&ugrave; &amp;eacute; &unknown; & a&b &eacute &notit; &#0; &#150; &#x1F600; &hearts;&NotEqualTilde; &", "sans rien", None, "&nbsp;&lt;b&gt;", "&#;&#x;&;", "&copyright", "&" * 50]
    assert column(spark, T.unescape_html, texts) == [None if t is None else html.unescape(t) for t in texts]
    every = "".join("&" + n + (" " if not n.endswith(";") else "") for n in html.entities.html5)
    assert column(spark, T.unescape_html, [every]) == [html.unescape(every)]
