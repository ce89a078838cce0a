import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from genlex.functions import text as T
from genlex.operators import agreement, annotate, clean, features, filters, lexicon, markers, models, report, sampling, scoring, threads, validate

TOKENS = "text_id string, i int, sent_id int, text string, lemma string, pos string, dep string, morph map<string,string>"


def tokens(spark, *texts):
    """Each text: a list of (text, lemma, pos)."""
    return spark.createDataFrame([(f"t{k}", i, 0, *tok, "", {}) for k, toks in enumerate(texts) for i, tok in enumerate(toks)], TOKENS)


def words(spark, *ws):
    return spark.createDataFrame([(w,) for w in ws], "noun string")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_gate_and_logs(spark):
    t = tokens(spark, [("un", "un", "DET"), ("médecin", "médecin", "NOUN"), ("Le", "le", "DET"), ("élève", "élève", "NOUN")], [("voisin", "voisin", "NOUN"), ("print(e)", "print(e)", "NOUN"), ("et/le", "et", "CCONJ"), ("auteur·e", "auteur·e", "NOUN"), ("auteurRICES", "x", "NOUN"), ("gens", "gens", "NOUN")])
    gated = markers.human_nouns(t, words(spark, "médecin", "élève", "voisin", "gens", "gens"))
    assert [r[1] for r in rows(gated.select("i", "text", "text_id"), "text_id", "i")] == ["médecin", "élève", "voisin", "auteur·e", "auteurRICES", "gens"]
    assert rows(markers.masculine_generics(gated, words(spark, "voisin", "voisin")).select("text", "from_epicene")) == [("voisin", 0), ("voisin", 0)]  # a list is a bag
    assert rows(markers.epicene_generics(t, gated, words(spark, "médecin", "élève")).select("text", "from_epicene")) == [("médecin", 1)]  # "Le" is not "le"
    assert rows(markers.neutral_nouns(gated).select("neutral")) == [("gens",)]


def test_counts_agree_with_logs(spark):
    texts = spark.createDataFrame([("a", "Un médecin et le voisin. Ce voisin dort."), ("b", "La médecin, les gens."), ("c", "Rien.")], "id string, body string")
    lex = spark.createDataFrame([(w, w, "NOUN") for w in ("médecin", "voisin", "gens")], "form string, lemma string, pos string")
    t = annotate.rule_annotate(texts, "id", "body", lex)
    h, g, e = words(spark, "médecin", "voisin", "gens"), words(spark, "voisin", "voisin"), words(spark, "médecin")
    gated = markers.human_nouns(t, h)
    logs = markers.masculine_generics(gated, g).unionByName(markers.epicene_generics(t, gated, e))
    want = {r["text_id"]: r["count"] for r in logs.groupBy("text_id").count().collect()}
    got = {r["text_id"]: (r["human_noun_count"], r["n_logs"]) for r in markers.marker_counts(t, h, g, e).collect()}
    assert got == {"a": (3, 4), "b": (2, 0)} and want == {"a": 4}
    plain = t.drop("p_text", "p_pos")  # the same through the window
    assert rows(markers.epicene_generics(plain, markers.human_nouns(plain, h), e)) == rows(markers.epicene_generics(t, gated, e))


def test_records_of_texts_without_tokens(spark):
    texts = spark.createDataFrame([("d", "t0", "Tous et toutes ici."), ("d", "t9", None)], "dataset string, text_id string, text string")
    rec = markers.records(texts, tokens(spark, [("voisin", "voisin", "NOUN")]), words(spark, "voisin"), words(spark, "voisin"), words(spark, "élève"))
    got = {r["text_id"]: r for r in rec.collect()}
    assert got["t0"]["human_noun_count"] == 1 and got["t0"]["masc_gen_logs"][0]["masc_gen"] == "voisin" and got["t0"]["incl_greetings_logs"][0]["hit"] == "Tous et toutes"
    assert got["t9"]["human_noun_count"] == 0 and got["t9"]["masc_gen_logs"] == [] and got["t9"]["incl_pairs_logs"] == []


def test_rule_annotator(spark):
    texts = spark.createDataFrame([("a", "L’auteur·rice lit. Un Voisin!"), ("b", None)], "id string, body string")
    lex = spark.createDataFrame([("auteur", "auteur", "NOUN"), ("voisin", "voisin", "NOUN"), ("voisin", "voisiner", "VERB")], "form string, lemma string, pos string")
    whole = annotate.rule_annotate(texts, "id", "body", lex)
    assert [tuple(r) for r in whole.orderBy("i").select("p_text", "p_pos").collect()][:3] == [(None, None), ("L’", "DET"), ("auteur·rice", "NOUN")]
    got = rows(whole.select("i", "sent_id", "text", "lemma", "pos"))
    assert got == [(0, 0, "L’", "l'", "DET"), (1, 0, "auteur·rice", "auteur", "NOUN"), (2, 0, "lit", "lit", "X"), (3, 0, ".", ".", "PUNCT"), (4, 1, "Un", "un", "DET"), (5, 1, "Voisin", "voisin", "NOUN"), (6, 1, "!", "!", "PUNCT")]


def test_model_annotator(spark):
    load = lambda: lambda batch: [[(0, w, w.lower(), "X", "", {}) for w in t.split()] for t in batch]
    texts = spark.createDataFrame([("a", "Un Mot"), ("b", None)], "id string, body string")
    assert rows(annotate.model_annotate(texts, "id", "body", load).select("text_id", "i", "lemma")) == [("a", 0, "un"), ("a", 1, "mot")]


def test_cell_filters(spark):
    t = tokens(spark, [("mon", "mon", "DET"), ("vieux", "vieux", "ADJ"), ("voisin", "voisin", "NOUN")], [("ce", "ce", "DET")], [("gens", "gens", "NOUN")], [("le", "le", "DET"), ("voisin", "voisin", "NOUN")])
    g = words(spark, "voisin")
    assert rows(filters.specific_determiner(t, g)) == [("t0",)]
    assert rows(filters.masculine_generic(t, g)) == [("t0",), ("t3",)]
    ents = spark.createDataFrame([("t0", "x", "PER"), ("t1", "chez Zoé ici", "MISC"), ("t2", "Paris", "LOC"), ("t3", "Zoélie", "MISC")], "text_id string, text string, label string")
    person = filters.person_entity(ents, spark.createDataFrame([("Zoé",)], "prenoms string"))
    assert rows(person) == [("t0",), ("t1",)]
    data = spark.createDataFrame([("t0", "a", "e"), ("t1", "b", "f"), ("t2", "c", None), ("t3", "d", "h")], "id string, c1 string, c2 string")
    flags = {"c1": {"spec": filters.specific_determiner(t, g), "person": person, "neutral": filters.neutral_word(t)}, "c2": {}}
    assert rows(filters.blank_cells(data, "id", ["c1", "c2"], flags, neutral=True)) == [("t0", None, "e", 0), ("t1", None, "f", 0), ("t2", "c", None, 1), ("t3", "d", "h", 0)]
    assert filters.content_columns("alpaca", ["user_content", "x"]) == ["user_content"] and filters.columns_of_type(["User_Content1", "a"], "content") == ["User_Content1"]
    with pytest.raises(ValueError):
        filters.content_columns("?", [])
    qui = spark.createDataFrame([("t0", 0, 0, "Qui", "qui", "PRON", "nsubj", {"PronType": "Int,Rel"}), ("t1", 0, 0, "qui", "qui", "PRON", "nsubj", {})], TOKENS)
    assert rows(filters.interrogative_who(qui)) == [("t0",)]


def test_scores(spark):
    rec = spark.createDataFrame([("a", 0, []), ("a", 2, []), ("a", 4, [1]), ("a", 1, [1, 1, 1]), ("b", 0, []), ("b", None, None)], "dataset string, human_noun_count int, masc_gen_logs array<int>")
    s = scoring.text_scores(rec)
    got = {r["dataset"]: r for r in scoring.dataset_scores(s).collect()}
    assert (got["a"]["overall_m_score"], got["a"]["mean_m_score"], got["a"]["bias_rate"]) == (round(2 / 7, 6), round(1.25 / 3, 6), round(2 / 3, 6))
    assert got["b"]["mean_m_score"] is None and got["b"]["overall_m_score"] is None and got["b"]["n_scored"] == 0
    assert rows(scoring.histogram(s)) == [("a", 0, 1), ("a", 2, 1), ("a", 10, 1)]
    third = spark.createDataFrame([("a", 10, [1, 1, 1])], "dataset string, human_noun_count int, masc_gen_logs array<int>")
    assert rows(scoring.histogram(scoring.text_scores(third))) == [("a", 3, 1)]
    assert scoring.text_scores(rec.select("dataset", F.lit(None).cast("int").alias("real_human_nouns_count"), F.lit(None).cast("array<int>").alias("real_masc_gen_logs")), real=True).where("m_score is not null").count() == 0


def test_verdicts(spark):
    def line(i, content):
        import json

        return json.dumps({"custom_id": i, "response": {"body": {"choices": [{"message": {"content": content}}]}}})

    lines = spark.createDataFrame([(0, line("x", '{"auteur":1,"auteur_2":0,"ami":0}')), (1, line("x", "broken")), (2, "{}"), (3, "no json"), (4, line("y", '{"a":1}')), (5, line("y", '{"a":0}'))], "line_no long, value string")
    v = {r["custom_id"]: r["verdicts"] for r in validate.parse_verdicts(lines).collect()}
    assert v == {"x": {"auteur": 1, "auteur_2": 0, "ami": 0}, "y": {"a": 0}}
    assert validate.count_unparsed(lines).first()[0] == 1
    rec = spark.createDataFrame([("x", [("auteur",), ("ami",), ("aut",)]), ("z", [("auteur",)])], "text_index_dataset string, masc_gen_logs array<struct<token:string>>")
    for positive, kept, n in ((True, ["auteur"], 1), (False, ["auteur", "ami"], 3)):
        got = {r["text_index_dataset"]: r for r in validate.apply_verdicts(rec, validate.parse_verdicts(lines, positive)).collect()}
        assert [x["token"] for x in got["x"]["real_masc_gen_logs"]] == kept and got["x"]["real_human_nouns_count"] == n
        assert got["z"]["real_masc_gen_logs"] is None


def test_reports(spark):
    nouns = spark.createDataFrame([("d", "a"), ("d", "a"), ("d", "b"), ("e", "a")], "dataset string, noun string")
    dic = spark.createDataFrame([("a", "x, y"), ("b", "x"), ("c", "z"), ("a", "x, y")], "noun string, merged_classes string")
    c = report.class_counts(nouns, dic, top=1)
    assert rows(c) == [("d", "x", 2), ("e", "x", 1)]
    assert rows(report.top_classes(report.class_counts(nouns, dic), top=2)) == [("d", "x", 2), ("d", "y", 1), ("e", "x", 1), ("e", "y", 1)]
    logs = ", ".join(f"{m}_logs array<int>" for m in ("incl_greetings", "neutral_prons", "incl_pairs", "neutral", "separator", "upper"))
    rec = spark.createDataFrame([("llama", 1, "llama_266", [1], [], [], [], [1], []), ("llama", 2, "llama_1", [], [], [], [], [1], [1])], f"dataset string, text_index int, text_index_dataset string, {logs}")
    got = {r["marker"]: (r["count"], r["pct"]) for r in report.marker_rates(rec).collect()}
    assert got["incl_greetings"] == (0, 0.0) and got["fem_endings"] == (1, 50.0)


def test_sequential_dedup(spark):
    def keep(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "pos int, t string")
        return [r["pos"] for r in clean.dedup_sequential(df, "t", "pos").orderBy("pos").collect()]

    assert keep(["a", "a"]) == [0]
    assert keep(["a/  b", "a/  b"]) == [0, 1]
    assert keep(["a/  b", "a/ b"]) == [0]
    assert keep([]) == [] and keep([None, None, ""]) == [0, 1, 2]
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "b", "/", " ", "  "]) for _ in range(rng.randint(0, 4))) for _ in range(400)]
    import re

    cleaner = lambda t: re.sub(r"\s+", " ", t) if "/" in t else t
    seen, want = set(), []
    for k, t in enumerate(texts):
        if t not in seen:
            seen.add(cleaner(t))
            want.append(k)
    assert keep(texts) == want
    twice = spark.createDataFrame([(1, "a/ &amp;lt;b&amp;gt;"), (2, "a/ b")], "pos int, t string")
    assert [r["pos"] for r in clean.not_idempotent(twice, "t").collect()] == [1]


def test_lexicon_algebra(spark):
    base = words(spark, "Rouge", "rouge", "maison", None)
    assert rows(lexicon.drop_words(base, "noun", words(spark, "ROUGE"))) == [(None,), ("Rouge",), ("maison",)]
    dm = spark.createDataFrame([("Belge", 1, 1), ("Élève", 1, 0), ("Maçon", 0, 0)], "__dmnt__nm string, __dmnt__epicene int, __dmnt__proper_noun int")
    assert rows(lexicon.epicene_list(dm)) == [("médecin",), ("élève",)]
    assert rows(lexicon.symmetric_difference(words(spark, "a", "a", "b"), words(spark, "b", "c"))) == [("c",)]
    assert rows(lexicon.word_candidates(words(spark, "a", "b", "c", "D"), words(spark, "a"), words(spark, "b", "a"))) == [("c",)]
    nh = spark.createDataFrame([("a", "C1", "S1"), ("a", "C2", "S2")], "lexeme string, class string, subclass string")
    t = lexicon.classes_of(words(spark, "A", "b"), "noun", nh, "tlfi")
    assert rows(t) == [("A", "C1", "S1"), ("A", "C2", "S2"), ("b", "", "")]
    d = lexicon.classes_of(words(spark, "b", "z"), "noun", spark.createDataFrame([("b", "X", "Y")], "lexeme string, class string, subclass string"), "dmnt")
    assert rows(lexicon.merge_classes(t, d)) == [("A", "C1", "S1"), ("b", "", ""), ("z", "", "")]  # "" beats X
    final = lexicon.final_dictionary(spark.createDataFrame([("a", " NH-Mét", "Pays"), ("b", "N Général", ""), ("c", "NH-Mét", "N de Fonction")], "noun string, class string, subclass string"))
    assert rows(final) == [("a", "profession", "demonym", "profession, demonym"), ("b", "", "", ""), ("c", "profession", "profession", "profession")]
    assert rows(lexicon.overwrite_classes(words(spark, "a", "b").selectExpr("noun", "'x' class", "'y' subclass"), words(spark, "b", "c").selectExpr("noun", "'n' class", "string(null) subclass"))) == [("a", "x", "y"), ("b", "n", "y"), ("c", "n", None)]
    assert rows(lexicon.demonym_entries(words(spark, "Français", "Français", "Belge")).select("noun")) == [("Français",), ("Français",)]
    w = spark.createDataFrame([('{"0.form":"actrice","1.form":"Ève"}', '{"0.tags":"feminine","1.tags":"feminine","2.tags":"feminine"}'), ("broken", None)], "forms_json string, tags_json string")
    assert rows(lexicon.feminine_forms(w, words(spark, "x"))) == [("actrice",)]
    h = lexicon.human_list([words(spark, "belge", "ami", "as")], words(spark, "Belge"), words(spark, "as"))
    assert rows(h) == [("Belge",), ("ami",)]
    idx = lexicon.word_index({"x": spark.createDataFrame([(2, "b"), (1, "b"), (3, None)], "id long, word string"), "y": spark.createDataFrame([(7, "a")], "id long, word string")})
    assert rows(idx) == [(1, "a", None, 7), (2, "b", 1, None)]
    empty = lexicon.word_index({"x": spark.createDataFrame([], "id long, word string")})
    assert empty.count() == 0


def test_threads(spark):
    m = spark.createDataFrame([("1", None), ("2", "1"), ("3", "2"), ("4", "1"), ("9", None), ("7", "8"), ("8", "7"), ("6", "gone")], "message_id string, parent_id string")
    assert rows(threads.thread_paths(m)) == [("1", "3", ["1", "2", "3"]), ("1", "4", ["1", "4"])]
    assert threads.thread_paths(spark.createDataFrame([], "message_id string, parent_id string")).count() == 0
    t = spark.createDataFrame([("c", 0, "system", "s"), ("c", 1, "prompter", "u1"), ("c", 2, "assistant", "a1"), ("c", 3, "prompter", "u2"), ("d", 0, "assistant", "x")], "conv_id string, turn int, role string, text string")
    t = threads.normal_role(t)
    assert rows(threads.wide_dialogues(t)) == [("c", "u1", "a1", "u2"), ("d", "", "x", "")]
    assert rows(threads.first_of_role(t, "user")) == [("c", "u1"), ("d", "")]
    assert rows(threads.cut_last_user(t).select("conv_id", "turn")) == [("c", 0), ("c", 1), ("c", 2), ("d", 0)]


def test_quotas(spark):
    df = spark.createDataFrame([(s, f"{s}{k}") for s, n in (("a", 6), ("b", 3), ("c", 1)) for k in range(n)], "source string, instruction string")
    assert rows(sampling.proportional_quotas(df, "source", 5)) == [("a", 6, 4), ("b", 3, 1), ("c", 1, 0)]
    got = rows(sampling.stratified_sample(df, "source", "instruction", 5))
    assert len(got) == 5 and rows(sampling.stratified_sample(df.repartition(7), "source", "instruction", 5)) == got
    assert sampling.stratified_sample(df, "source", "instruction", 99).count() == 10
    blanks = spark.createDataFrame([("a", ""), ("a", None), ("a", "x")], "source string, instruction string")
    assert sampling.stratified_sample(blanks, "source", "instruction", 3).count() == 1


@settings(max_examples=3, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=80), st.integers(1, 60))
def test_quotas_sum(spark, sources, n):
    df = spark.createDataFrame([(str(s), i) for i, s in enumerate(sources)], "source string, i int")
    q = rows(sampling.proportional_quotas(df, "source", n))
    assert sum(x[2] for x in q) <= max(n, len(sources)) and all(x[2] <= x[1] for x in q)


def test_samples(spark):
    df = spark.createDataFrame([("d", k, "x" if k % 2 else None) for k in range(10)] + [("e", k, "y") for k in range(5)], "g string, pos int, req string")
    assert rows(sampling.capped_per_group(df, "g", "pos", "req", ["d"], cap=2).select("g", "pos")) == [("d", 1), ("d", 3)] + [("e", k) for k in range(5)]
    w = spark.createDataFrame([(f"{'A' if k % 2 else 'a'}{k}",) for k in range(2000)], "noun string")
    s = sampling.fraction_sample(w, "noun")
    assert s.where("noun like 'a%'").count() == 1000 and 120 < s.where("noun like 'A%'").count() < 280
    assert 0.75 < sampling.train_split(w, "noun").where("is_train").count() / 2000 < 0.85
    assert sampling.hash_sample(w, "noun", 10).count() == 10


def test_kappa_and_votes(spark):
    same = spark.createDataFrame([("a", "a"), ("b", "b"), (None, "b")], "x string, y string")
    assert agreement.cohen_kappa(same, "x", "y").first()["kappa"] == 1.0
    const = spark.createDataFrame([("a", "a")], "x string, y string")
    assert agreement.cohen_kappa(const, "x", "y").first()["kappa"] is None
    assert agreement.cohen_kappa(const.limit(0), "x", "y").first()["n"] == 0
    mixed = spark.createDataFrame([("1", "1"), ("1", "0"), ("0", "0"), ("0", "0")], "x string, y string")
    ab, ba = agreement.cohen_kappa(mixed, "x", "y").first(), agreement.cohen_kappa(mixed, "y", "x").first()
    assert ab["kappa"] == ba["kappa"] == 0.5
    order = spark.createDataFrame([("{'a': 1, 'b': 0}", '{"b":0,"a":1}'), ("{'a': 0}", "{'a': 0}")], "x string, y string")
    assert agreement.cohen_kappa(order, "x", "y").first()["kappa"] < 1 and agreement.cohen_kappa(order, "x", "y", canonical=True).first()["kappa"] == 1
    p = [spark.createDataFrame([("w", a, q), ("v", b, q)], "word string, prediction int, probability double") for a, b, q in ((1, 1, 0.9), (1, 0, 0.6), (1, 1, 0.7))]
    votes = agreement.vote_table(*p)
    assert rows(agreement.unanimous(votes, 3, 2).select("word")) == [("w",)] and rows(agreement.disagreements(votes).select("word")) == [("v",)] and agreement.unanimous(votes, 3, 3).count() == 0


def test_features(spark):
    paths = spark.createDataFrame([("w", "s1", 0, "salesperson.n.01"), ("w", "s2", 0, "artifact.n.01"), ("w", "s2", 1, "thing.n.01")], "word string, synset string, path_id int, node string")
    assert rows(features.hypernym_scores(paths)) == [("w", 0.5, 0.5)]
    gl = spark.createDataFrame([("w", "s1", "A person who works"), ("w", "s2", "a tool")], "word string, synset string, gloss string")
    assert rows(features.definition_scores(gl)) == [("w", 1.0, 0.5)]
    seeds = spark.createDataFrame([([1.0, 0.0], True), ([0.0, 2.0], False), ([0.0, 0.0], False)], "vector array<double>, is_human boolean")
    v = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 0.0]), ("c", None)], "word string, vec array<double>")
    assert rows(features.seed_scores(v, seeds, "word", "vec")) == [("a", 0.6, 0.8), ("b", 0.0, 0.0), ("c", 0.0, 0.0)]
    f = spark.createDataFrame([("w", 1.0, 0.0, 0.0, 0.0, 0.5, 0.5, 1, [1.0])], "word string, hypernym_human double, hypernym_non_human double, def_human double, def_non_human double, seed_human double, seed_non_human double, suffix int, vec array<double>")
    r = features.rule_scores(f).first()
    assert (r["classification"], r["human_score"], r["non_human_score"]) == ("human", 0.85, 0.45)
    assert len(features.feature_matrix(f, "vec").first()["features"]) == 8
    with pytest.raises(Exception, match="missing"):
        features.feature_matrix(f.withColumn("vec", F.array(F.lit(float("nan")))), "vec").collect()
    pos = features.positive_words(spark.createDataFrame([(" ", "chef de gare"), ("maire", "x")], "entity_male_label string, entityLabel string"), words(spark, "a(b)"), words(spark, "ami"))
    assert rows(pos) == [("ami", 1), ("chef", 1), ("maire", 1)]
    neg = spark.createDataFrame([("table", "s", "artifact.n.01"), ("chat_noir", "s2", "living_thing.n.01"), ("roi", "s3", "person.n.01"), ("ab", "s4", "object.n.01"), ("maire", "s5", "object.n.01")], "word string, synset string, node string")
    assert rows(features.negative_words(neg, pos, category=True)) == [("chat noir", "living_being"), ("table", "artifact")]


def test_models(spark):
    rng = random.Random(0)
    data = [(f"w{k}", [rng.gauss(y, 0.4), rng.gauss(0, 1)], y) for k in range(200) for y in [k % 2]]
    df = spark.createDataFrame(data, "word string, features array<double>, label int")
    for model in (models.fit_logistic(df), models.fit_trees(df, depth=3, rounds=5, min_rows=5)):
        p = models.predict(model, df).join(df, "word")
        assert p.where("prediction = label").count() > 170
    ext = models.predict_external(df, lambda: lambda ws: [0.9 for _ in ws])
    assert ext.where("prediction = 1").count() == 200


def test_one_hop(spark):
    known = spark.createDataFrame([("Acteur",), (None,)], "word string")
    e = spark.createDataFrame([("actrice", "acteur, femme"), ("x", "autre")], "word string, definition string")
    assert rows(clean.expand_one_hop(known, e)) == [("actrice", "acteur", "acteur, femme")]
    assert T.TOKEN


def test_labels_of_nouns(spark):
    load = lambda: lambda texts: ["NH-Mét" if t.endswith("échecs.") and "boulanger" in t else "Autre" if t == "roi" else "" for t in texts]
    got = annotate.label_nouns(words(spark, "boulanger", "roi", "xyz", None, ""), load, [], batch=2)
    assert rows(got) == [("boulanger", "NH-Mét"), ("roi", "Autre"), ("xyz", "")]


def test_gendered_labels(spark):
    e = spark.createDataFrame([("q1", "acteur", None), ("q2", "duc", "titre de noblesse"), ("q3", "roi", "monarque")], "entity string, entityLabel string, description string")
    f = spark.createDataFrame([("q1", "actrice"), ("q2", "duchesse")], "entity string, label string")
    m = spark.createDataFrame([("q9", "x")], "entity string, label string")
    assert rows(lexicon.gendered_labels(e, f, m)) == [("q1", "acteur", "actrice", None)]


def test_release(spark):
    from genlex import session

    df = session.materialize(words(spark, "a"))
    assert df.count() == 1 and session.release(spark) >= 1 and session.release(spark) == 0


def test_dialogue_turns_keep_every_message(spark):
    m = [("r", None, "prompter"), ("a1", "r", "Assistant"), ("u2", "a1", " user"), ("a2", "u2", "bot"), ("u3", "a2", "human"), ("a3", "u3", "gpt"), ("u4", "a3", "user"), ("u5", "a3", "user"), ("s", "r", "moderator"), ("lone", None, "user"), ("o", "gone", "assistant")]
    df = spark.createDataFrame([(i, p, role, i.upper(), None, None) for i, p, role in m], "message_id string, parent_id string, role string, content string, created_at timestamp, ingested_at timestamp")
    got = rows(threads.dialogue_turns(threads.latest_turns(df)).select("conv_id", "role", "n", "text"))
    whole = [("a3", "assistant", k, f"A{k}") for k in (1, 2, 3)] + [("a3", "user", 1, "R"), ("a3", "user", 2, "U2"), ("a3", "user", 3, "U3")]
    assert got == sorted([*whole, ("s", "user", 1, "R")])


def test_no_path_is_too_long(spark):
    chain = spark.range(1200).selectExpr("cast(id as string) as message_id", "cast(nullif(id - 1, -1) as string) as parent_id")
    got = threads.thread_paths(chain).collect()
    assert [(r["root_id"], r["leaf_id"]) for r in got] == [("0", "1199")] and got[0]["path"] == [str(k) for k in range(1200)]
    with pytest.raises(ValueError):
        threads.thread_paths(chain, max_depth=1000)


def test_ordinals_need_no_task_per_key(spark):
    rows = [("hot", k) for k in range(3000)] + [("b", 5), ("b", 2), ("c", 1)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(7)
    got = {(r["k"], r["v"]): r["n"] for r in lexicon.ordinals(df, ["k"], ["v"], "n").collect()}
    assert got == {("hot", k): k + 1 for k in range(3000)} | {("b", 2): 1, ("b", 5): 2, ("c", 1): 1}
    assert lexicon.ordinals(df.limit(0), ["k"], ["v"], "n").count() == 0
