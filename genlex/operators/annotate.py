"""Token tables. Everything after annotation works on ``tokens(text_id, i, sent_id, text, lemma, pos, dep, morph)``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genlex.functions import text as T
from genlex.session import materialize

TOKEN_SCHEMA = "text_id string, i int, sent_id int, text string, lemma string, pos string, dep string, morph map<string,string>"
# Closed word classes of the rule annotator.
DETERMINERS = "le la les l' un une des du ce cet cette ces mon ton son ma ta sa mes tes ses notre votre leur nos vos leurs chaque tout tous toute toutes plusieurs".split()
PRONOUNS = "je tu il elle on nous vous ils elles qui que quoi celui celle ceux celles iel iels".split()


def raw_tokens(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(text_id, i, sent_id, text, p_text)`` for every token; i counts from 0 over the text, p_text is the token before.

    The neighbour comes from the token array before it is exploded: no window, no shuffle. Null and empty texts have no rows.
    """
    per_sentence = F.transform(T.sentences(F.col(text_col)), lambda s, k: F.transform(T.tokens(s), lambda t: F.struct(k.alias("sent_id"), t.alias("text"))))
    split = texts.select(F.col(id_col).alias("text_id"), F.flatten(per_sentence).alias("toks"))
    shifted = F.concat(F.array(F.lit(None).cast("struct<sent_id:int,text:string>")), F.col("toks"))
    pairs = F.zip_with("toks", shifted, lambda t, p: F.struct(t["sent_id"].alias("sent_id"), t["text"].alias("text"), p["text"].alias("p_text")))
    exploded = split.select("text_id", F.posexplode(pairs).alias("i", "t")).where("t.text is not null")
    return exploded.select("text_id", "i", "t.sent_id", "t.text", "t.p_text")


def _low(text: Column) -> Column:
    return F.lower(F.replace(text, F.lit("’"), F.lit("'")))


def _form(text: Column) -> Column:
    """The form to look up: an inclusive form by its stem, a form with a capital ending without it."""
    low = _low(text)
    stem = F.regexp_extract(low, r"^\p{L}+(?:-\p{L}+)*", 0)
    capital_tail = F.regexp_extract(text, r"^(\p{Lu}?\p{Ll}+)\p{Lu}+$", 1)
    plain = text.rlike(r"^\p{Ll}+$")  # most tokens: they need no other pattern
    return F.when(plain, text).when(text.rlike(r"\p{Ll}\p{Lu}+$"), F.lower(capital_tail)).when(low.rlike(T.SEPARATOR_CLASS), stem).otherwise(low)


def _pos(found: Column, text: Column) -> Column:
    low = _low(text)
    closed = F.when(low.isin(*DETERMINERS), "DET").when(low.isin(*PRONOUNS), "PRON").when(~low.rlike(r"[\p{L}\p{N}]"), "PUNCT").when(low.rlike(r"^\p{N}+$"), "NUM").otherwise("X")
    return F.coalesce(found, F.when(text.isNotNull(), closed))


def rule_annotate(texts: DataFrame, id_col: str, text_col: str, lexicon: DataFrame) -> DataFrame:
    """Deterministic annotator: forms are looked up in ``lexicon(form, lemma, pos)``, inclusive forms by their stem.

    Forms in no list get pos ``X`` and themselves as lemma; dep and morph are empty. Beside the token columns it gives text and
    pos of the token before (``p_text``, ``p_pos``). Its results are its own: a statistical tagger differs. A lexicon form should
    be unique; of several the smallest (pos, lemma) counts. The lexicon joins are left to Spark's own size check, so a large
    lexicon is not broadcast.
    """
    toks = raw_tokens(texts, id_col, text_col)
    forms = lexicon.groupBy(F.lower("form").alias("form")).agg(F.min(F.struct("pos", "lemma")).alias("e")).select("form", F.col("e.lemma").alias("lex_lemma"), F.col("e.pos").alias("lex_pos"))
    before = forms.select(F.col("form").alias("p_form"), F.col("lex_pos").alias("p_lex_pos"))
    joined = toks.withColumn("form", _form(F.col("text"))).join(forms, "form", "left").withColumn("p_form", _form(F.col("p_text"))).join(before, "p_form", "left")
    empty = F.create_map().cast("map<string,string>")
    return joined.select(
        "text_id", "i", "sent_id", "text", F.coalesce("lex_lemma", _low(F.col("text"))).alias("lemma"), _pos(F.col("lex_pos"), F.col("text")).alias("pos"), F.lit("").alias("dep"), empty.alias("morph"),
        "p_text", _pos(F.col("p_lex_pos"), F.col("p_text")).alias("p_pos"),
    )


def phrase_nouns(tokens: DataFrame, phrases: DataFrame) -> DataFrame:
    """Tokens where nouns of several words are one noun: the first word gets the noun as lemma and pos ``NOUN``, the others pos ``X``.

    ``phrases``: (noun, n), n lower-case tokens joined by one blank, unique. A phrase lies within one sentence; of several that
    start at a token the longest counts; one that starts inside another is left out. Only words that begin a phrase are joined with what
    follows them. ``tokens`` is read several times: pass a written table.
    """
    low = tokens.select("text_id", "sent_id", "i", _low(F.col("text")).alias("w"))
    firsts = phrases.select(F.split("noun", " ")[0].alias("w"), "n").distinct()
    starts = low.join(firsts, "w").select("text_id", "sent_id", F.col("i").alias("at"), "n")
    span = starts.join(low, ["text_id", "sent_id"]).where("i >= at and i < at + n")
    spelt = span.groupBy("text_id", "at", "n").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("l"))
    spelt = spelt.select("text_id", "at", "n", F.array_join(F.transform("l", lambda x: x["w"]), " ").alias("noun"))
    hits = materialize(spelt.join(phrases, ["noun", "n"]).groupBy("text_id", "at").agg(F.max(F.struct("n", "noun")).alias("h")).select("text_id", "at", "h.n", "h.noun"))
    heads = hits.select("text_id", F.col("at").alias("i"), "noun", F.lit(False).alias("inside"))
    rest = hits.select("text_id", F.explode(F.sequence(F.col("at") + 1, F.col("at") + F.col("n") - 1)).alias("i"), F.lit(None).cast("string").alias("noun"), F.lit(True).alias("inside"))
    marks = heads.unionByName(rest).groupBy("text_id", "i").agg(F.max("noun").alias("noun"), F.max("inside").alias("inside"))
    out = tokens.join(marks, ["text_id", "i"], "left")
    pos = F.when(F.col("inside"), "X").when(F.col("noun").isNotNull(), "NOUN").otherwise(F.col("pos"))
    lemma = F.when(~F.col("inside") & F.col("noun").isNotNull(), F.col("noun")).otherwise(F.col("lemma"))
    return out.withColumns({"pos": pos, "lemma": lemma}).select(*tokens.columns)


def model_annotate(texts: DataFrame, id_col: str, text_col: str, load, batch: int = 32) -> DataFrame:
    """Annotation by a statistical model in Arrow batches. ``load()`` runs once per worker and returns ``annotate(list of texts)``,
    which gives for each text a list of (sent_id, text, lemma, pos, dep, morph dict). Null texts are skipped."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        annotate = load()
        for pdf in batches:
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch]
                rows = [(str(tid), i, *tok) for tid, toks in zip(part["text_id"], annotate(part["text"].tolist()), strict=True) for i, tok in enumerate(toks)]
                yield pd.DataFrame(rows, columns=["text_id", "i", "sent_id", "text", "lemma", "pos", "dep", "morph"])

    src = texts.select(F.col(id_col).cast("string").alias("text_id"), F.col(text_col).alias("text")).where("text is not null")
    return src.mapInPandas(run, TOKEN_SCHEMA)


def label_nouns(nouns: DataFrame, load, h_aspirated: list[str], batch: int = 32) -> DataFrame:
    """``(noun, label)``: the first entity label of the noun in its carrier sentence, else of the bare noun, else ``""``.

    ``load()`` runs once per worker and returns ``label(list of texts)``, which gives a label or ``""`` for each. Nouns without a
    label are asked a second time only. Null nouns are skipped.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        label = load()
        for pdf in batches:
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch].reset_index(drop=True)
                found = [x or "" for x in label(part["sentence"].tolist())]
                again = [j for j, x in enumerate(found) if not x]
                for j, x in zip(again, label([part["noun"][j] for j in again]) if again else [], strict=True):
                    found[j] = x or ""
                yield pd.DataFrame({"noun": part["noun"], "label": found})

    src = nouns.select("noun").where("noun <> ''").select("noun", T.generic_sentence(F.col("noun"), h_aspirated).alias("sentence"))
    return src.mapInPandas(run, "noun string, label string")
