from genlex.llm import defects as D

FR = "Explique comment le boulanger range les outils du matin."
ANSWER = "Le boulanger range les outils quand il est tard. Il faut aussi penser aux autres."
CASES = [
    (FR, None, {"empty"}), (FR, "", {"empty"}), (FR, " ​\n", {"empty"}), (FR, "N/A", {"empty"}), (FR, "Réponse :", {"empty"}), (FR, "[vide]", {"empty"}), (FR, "...", {"empty"}), (FR, "-", {"empty"}),
    (FR, ANSWER, set()), ("Combien de voisins ?", "Aucun", set()), ("Combien ?", "Douze", set()), ("Oui ou non ?", "Non.", set()), ("", ANSWER, set()), (None, ANSWER, set()), ("  ", FR, set()),
    (FR, "Le boulanger range les outils du matin et puis il", {"truncated"}), (FR, "Il dit : « le", {"truncated"}), (FR, '{"a": 1, "b":', {"truncated"}), (FR, "1. Un pas.\n2. Deux pas.\n-", {"truncated"}), (FR, "Voici la liste des outils du boulanger :", {"truncated"}), (FR, "1. Un pas.\n2. Il faut\n3. Les outils du", {"truncated"}),
    ("Cite trois métiers.", "- potier\n- meunier\n- voisin", set()), (FR, ANSWER + "\n\nCordialement", set()), (FR, ANSWER + "\n\nSource : cahier de l'atelier, page 12", set()), ("Donne en JSON.", '{"a": 1}', set()), (FR, "On dit : « Il est tard. »", set()),
    (FR, "Je suis désolé, mais je ne peux pas répondre à cette demande.", {"refusal"}), (FR, "Merci pour votre message. Hélas, je préfère ne pas donner suite.", {"refusal"}), ("Describe the baker.", "I'm sorry, but I cannot help with this request.", {"refusal"}), ("Beschreibe einen Tag, an dem der Müller liest.", "Leider gilt: diese Bitte muss ich ablehnen.", {"refusal"}), ("Describe un día en que el relojero lee.", "Lo siento, pero no puedo responder a esta petición.", {"refusal"}),
    (FR, "Je ne peux que recommander la patience. " + ANSWER, set()), (FR, "Désolé pour le retard, voici la réponse. " + ANSWER, set()), ("Rédige un refus poli pour un voisin.", "Madame, je suis désolé, mais je ne peux pas vous prêter la carte. Bien à vous.", set()),
    (FR, FR, {"copy"}), (FR, FR.upper(), {"copy"}), (FR, "Consigne : " + FR, {"copy"}), (FR, FR[:-1], {"copy"}), ("Recopie sans rien changer la phrase suivante : Il pleut sur la ville.", "Il pleut sur la ville.", set()), (FR, FR + " " + ANSWER, set()),
    (FR, FR + " " + FR, {"copy"}), (FR, "Vous demandez : " + FR, {"copy"}), (FR, FR.replace("boulanger", "toujours"), {"copy"}), (FR, FR.replace("boulanger range", "toujours bien"), set()), (FR, "Vous demandez ceci : « " + FR + " » Ma réponse est simple. " + ANSWER, set()),
    (FR, "The baker keeps the tools when the night is long, and then he reads the book.", {"language"}), ("Traduis en anglais : « Il faut ranger les outils. »", "You should sort the tools with great care and then read the book.", set()), (FR, "Булочник хранит инструменты дома и читает книгу.", {"language"}), ("Write about the baker and the tools of the town.", "Sure! Le boulanger range les outils dans la cour avec les voisins.", {"language"}),
]


def test_cases(spark):
    df = spark.createDataFrame([(k, i, o, "clash", "clash") for k, (i, o, _) in enumerate(CASES)], "pair_id long, instruction string, output string, i string, id string")
    got = {}
    for r in D.defects(df).collect():
        got.setdefault(r["pair_id"], set()).add(r["defect"])
    wrong = {c[:2]: (c[2], got.get(k, set())) for k, c in enumerate(CASES) if got.get(k, set()) != c[2]}
    assert not wrong


def test_several_defects_and_repeats(spark):
    df = spark.createDataFrame([(1, FR, "I'm sorry, but I cannot help with this request because the rules of the house are"), (1, FR, None), (1, FR, None)], "pair_id long, instruction string, output string")
    assert sorted(r["defect"] for r in D.defects(df).collect()) == ["empty", "empty", "language", "refusal", "truncated"]


def test_empty_table_and_long_text(spark):
    schema = "pair_id long, instruction string, output string"
    assert D.defects(spark.createDataFrame([], schema)).count() == 0
    long = ANSWER * 5_000
    assert {r["pair_id"] for r in D.defects(spark.createDataFrame([(1, FR, long)], schema)).collect()} == set()


def test_padded_and_long_texts_take_linear_time(spark):
    """Blanks between an opening and the rest, rows of newlines, long copies, long words: none may make a rule try again and again."""
    import time

    long = " ".join(f"mot{k % 997} du boulanger numéro {k}" for k in range(12_000))
    rows = [
        (1, FR, "Désolé" + " " * 20_000 + "je ne peux pas répondre."), (2, FR, "Désolé" + ", " * 5_000 + "voici. " + ANSWER), (3, FR, ANSWER + "\n" * 20_000 + "Cordialement"), (4, long, long), (5, long, long.replace("numéro 7", "numero 7")),
        (6, FR, "x" * 200_000), (7, long, " ".join(reversed(long.split()))), (8, FR, "a@" * 50_000), (9, FR, "merci pour " * 20_000),
    ]
    began = time.time()
    got = {}
    for r in D.defects(spark.createDataFrame(rows, "pair_id long, instruction string, output string")).collect():
        got.setdefault(r["pair_id"], set()).add(r["defect"])
    assert time.time() - began < 60
    assert got[1] == {"refusal"} and 2 not in got and 3 not in got and got[4] == {"copy"} and got[5] == {"copy"} and "copy" not in got.get(7, set())
