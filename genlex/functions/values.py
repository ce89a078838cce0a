"""Word lists, phrases and tables that results depend on, stated as they are."""

# Phrases of inclusive writing and neutral pronouns.
INCLUSIVE_GREETINGS = ("tous et toutes", "toutes et tous", "messieurs, dames", "mesdames et messieurs", "messieurs dames", "messieurs et mesdames")
INCLUSIVE_PAIRS = (
    "ceux et celles", "celles et ceux", "ceux ou celles", "celles ou ceux", "celui ou celle", "celle ou celui", "ils et elles", "elles et ils", "eux et elles", "elles et eux",
    "ils ou elles", "elles ou ils", "eux ou elles", "elles ou eux", "elle ou il", "il ou elle", "la ou le", "un ou une", "le ou la", "une ou un",
)
NEUTRAL_PRONOUNS = ("iel", "iels", "ielle", "ielles", "celleux", "elleux", "ille", "illes")
NEUTRAL_NOUNS = ("personne", "personnes", "individu", "individus", "gens")

# Feminine endings and the signs that join them to a masculine form.
FEMININE_ENDINGS = (
    "E", "ES", "SE", "SES", "EUSE", "EUSES", "EURE", "EURES", "RICE", "RICES", "ICE", "ICES", "NE", "NES", "ÈRE", "ÈRES", "ERE", "ERES", "TE", "TES", "VE", "VES", "LLE", "LLES", "LE", "LES",
)
SEPARATORS = ("·", "‧", ".", "⋅", "•", "∙", "/", "(")
CODE_WORDS = (
    "print", "print(e)", "print(e", "del", "del(e)", "del(e", "except", "except(e", "except(e)", "match(e)", "match", "match(e", "return", "return(e", "return(e)",
)

# Determiners.
MASCULINE_DETERMINERS = ("ce", "cet", "un", "le", "du")
SPECIFIC_DETERMINERS = ("mon", "ton", "son", "sa", "notre", "votre", "leur", "ce", "cet")
EXTRA_EPICENES = ("médecin",)
ORACLE_WORDS = ("oracle", "pythie", "oracles", "pythies")

# Endings of masculine demonyms and the class they get.
DEMONYM_ENDINGS = ("ais", "ois", "ain", "ien", "in", "an", "en", "ol", "and", "ec", "on", "ard", "urc")
DEMONYM_CLASS = ("N de Population (Gentilé)", "Pays")

# Translations of classes and subclasses; apostrophes as in the sources.
CLASS_NAMES = {
    "N de Population (Gentilé)": "demonym", "N d'Agent": "doer", "NH-Mét": "profession", "N de Statut": "status", "Autre": "other", "N de Patient/Déverbal passif": "patient",
    "NH-Spé": "speciality", "NH-Fonc": "profession", "N d’Adepte/de Partisan": "", "N Relationnel": "relationship", "N de Caractérisant": "attribute", "N d’Habitant": "demonym",
    "NH-Grade": "title", "NH-Titre": "title", "N d’Âge": "", "N de Bénéficiaire": "recipient", "N Général": "", "N de Possesseur": "",
}
SUBCLASS_NAMES = {
    "Pays": "demonym", "N de Profession": "profession", "Membre": "", "N de Pratique": "", "N de Créateur": "doer", "N de Fonction": "profession", "N de Spécialité": "speciality",
    "Région": "demonym", "Parenté": "relationship", "Ville": "demonym", "Grade": "title", "N de Défaut moral": "attribute", "N d’Interprète": "", "N de Qualité morale": "",
    "Titre": "title", "Supranational": "", "Société": "",
}
VOWELS = "aâéeèiïîoôöuûüAÂÉEÈIÏÎOÔÖUÛÜ"

# Dataset groups and excluded report ids.
DATASET_GROUPS = {
    "human_instr": ("oasst2", "hh_rlhf", "alpaca", "oracle"), "llm_prop": ("gemini", "gpt4o_mini", "claude-3-haiku"), "llm_local": ("llama", "ministral", "mistral-small"),
}
FALSE_POSITIVES = (
    "llama_266", "llama_3610", "claude-3-haiku_6120", "claude-3-haiku_7216", "mistral-small_1429", "mistral-small_3132", "claude-3-haiku_1862", "gpt4o_mini_3936", "mistral-small_959",
)

# Seeds, indicators and suffixes of the human-noun scores.
HUMAN_SEEDS = ("personne", "homme", "femme", "individu", "humain", "gens")
NON_HUMAN_SEEDS = ("objet", "chose", "machine", "animal", "plante", "substance", "outil", "appareil", "sentiment")
HUMAN_INDICATORS = (
    "someone", "somebody", "person", "people", "individual", "professional", "specialist", "expert", "practitioner", "worker", "employee", "occupation", "profession", "who", "whose",
    "personality", "character", "member", "leader", "follower", "participant", "parent", "child", "sibling", "relative",
)
NON_HUMAN_INDICATORS = (
    "object", "thing", "item", "device", "tool", "machine", "equipment", "apparatus", "instrument", "substance", "material", "element", "chemical", "plant", "animal", "organism", "species",
    "concept", "idea", "notion", "theory", "principle", "place", "location", "area", "region", "structure", "amount", "quantity", "measure", "unit", "state", "condition", "situation", "circumstance",
)
HUMAN_NODES = ("person.n.01", "human.n.01", "worker.n.01", "employee.n.01")
NON_HUMAN_NODES = ("artifact.n.01", "substance.n.01", "plant.n.01", "animal.n.01")
HUMAN_SUFFIXES = (
    "ant", "ante", "ent", "ente", "ateur", "atrice", "ien", "ienne", "aire", "eron", "eronne", "iste", "if", "ive", "and", "ande", "in", "ine", "esse", "on", "onne", "teur", "trice", "eur", "euse",
    "ier", "ière", "ais", "aise", "ois", "oise", "ard", "arde", "ain", "aine", "euf", "euve", "urge", "graphe", "naute", "anthrope", "crate", "mane", "pathe", "phile", "phobe",
)
SCORE_WEIGHTS = (0.4, 0.3, 0.3, 0.3)

# Dictionary pages.
DEFINITION_WORDS = ("personne", "individu", "homme", "femme", "celui", "celle")
SECTION_HEADINGS = {"prononciation": ("Prononc.",), "etyhist": ("Étymol. et Hist.", "Étymol. ET HIST.", "Étymol."), "derives": ("Der. et composés",)}
EXCLUDED_HEADWORDS = ("alopécique", "anonymographe")
SPECIAL_SPLIT_WORDS = ("vice-premier", "alter ego", "persona non grata")
BADLY_FORMATTED_WORDS = ("cryptocommuniste",)
GENDER_SUFFIXES = {"eur": "euse", "ard": "arde", "er": "ère", "us": "use"}
CONTEXT_CLASSES = {"bracket_text": "tlf_ccrochet", "indicator": "tlf_cemploi", "domain": "tlf_cdomaine", "phrase": "tlf_csyntagme"}
# spellings of two speakers (lower case)
USER_NAMES = "user prompter human utilisateur utilisatrice humain usuario benutzer nutzer customer client".split()
ASSISTANT_NAMES = "assistant assistante bot chatbot gpt chatgpt ai ia model modèle asistente assistent agent".split()
# What people and exports write where a field has no value (compared in lower case, without blanks at the ends).
STAND_INS = (
    "", "-", "--", "---", "–", "—", "_", "?", "??", "???", ".", "..", "...", "…", "/", "#n/a", "n/a", "n.a.", "na", "n/d", "nd", "n.d.", "nan", "nil", "none", "null", "(null)",
    "vide", "(vide)", "[vide]", "aucun", "aucune", "néant", "inconnu", "inconnue", "non renseigné", "non renseignée", "non précisé", "non précisée", "non disponible", "non défini",
    "indéfini", "indéterminé", "sans objet", "s.o.", "à compléter", "à définir", "todo", "tbd", "unknown", "undefined", "missing", "not available", "not applicable", "unbekannt", "desconocido",
)
