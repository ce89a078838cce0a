"""Named queries of the library's own operators over the test tables, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genlex.functions import text as T
from genlex.functions import values as V
from genlex.operators import agreement, annotate, clean, features, filters, lexicon, markers, report, sampling, scoring, threads, validate
from genlex.session import materialize, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# Small lexicons of words that occur in the tables, the same in both engines.
HUMANS = "boulanger facteur lecteur jardinier vigneron musicien archiviste danseur potier apprenti élève médecin gardien étudiant voisin personne personnes gens".split()
PLURALS = {"boulangers": "boulanger", "facteurs": "facteur", "lecteurs": "lecteur", "jardiniers": "jardinier", "vignerons": "vigneron", "musiciens": "musicien", "archivistes": "archiviste", "danseurs": "danseur", "potiers": "potier", "apprentis": "apprenti", "voisins": "voisin", "étudiants": "étudiant", "gardiens": "gardien"}
GENERICS = ["boulanger", "facteur", "lecteur", "jardinier", "vigneron", "musicien", "danseur", "potier", "apprenti", "gardien", "étudiant", "voisin", "voisin"]  # one entry twice: a list is a bag
EPICENES = ["archiviste", "élève", "médecin"]
COMMON_PHRASES = ["il faut", "tous les", "selon la coutume"]  # phrases that the tables do have
ADJECTIVES = ["vieux", "vieil", "vieille", "jeune", "grande", "patient"]
DETERMINED = [*GENERICS, "cas", "texte"]
CLASSES = [("boulanger", "profession", ""), ("facteur", "profession", "doer"), ("lecteur", "doer", ""), ("jardinier", "profession", ""), ("vigneron", "profession", "doer"), ("musicien", "speciality", "profession"), ("voisin", "relationship", ""), ("étudiant", "status", ""), ("potier", "profession", "doer"), ("danseur", "speciality", "")]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _words(spark: SparkSession, words: list[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "noun string")


def _values(words) -> str:
    q = lambda x: "'" + str(x).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(q(x) for x in (w if isinstance(w, tuple) else (w,))) + ")" for w in words)


LEXICON = [(w, w, "NOUN") for w in HUMANS] + [(f, lemma, "NOUN") for f, lemma in PLURALS.items()] + [(w, w, "ADJ") for w in ADJECTIVES] + [(w, w, "NOUN") for w in ("cas", "texte")]


def _lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "form string, lemma string, pos string")


#: of a text column: no blanks at its ends, lower case
_KEY = "lower(regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))".format
_LANG = f"regexp_extract({_KEY('lang')}, '^[^-_]*')"
_SOURCE = f"nullif({_KEY('source')}, '')"


def _key(c: str) -> Column:
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def _in_language(spark: SparkSession, d: str, code: str) -> DataFrame:
    """The documents of a language in every spelling (FR, fr-FR, fr_CA) with one spelling per source; null or blank lang is unknown and in no language."""
    docs = table(spark, d, "documents").where(F.col("text").isNotNull() & (F.regexp_extract(_key("lang"), "^[^-_]*", 0) == code))
    return docs.withColumn("source", F.nullif(_key("source"), F.lit("")))


def _all_french(spark: SparkSession, d: str) -> DataFrame:
    return _in_language(spark, d, "fr").select(F.coalesce("source", F.lit("none")).alias("dataset"), F.col("doc_id").alias("text_id"), "text")


def _french(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("lang = 'fr' and text is not null").select(F.coalesce("source", F.lit("none")).alias("dataset"), F.col("doc_id").alias("text_id"), "text")


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return annotate.rule_annotate(_french(spark, d), "text_id", "text", _lexicon(spark))


_TOKEN_RE = T.TOKEN.replace("'", "''")
_DET, _PRON = _values(annotate.DETERMINERS), _values(annotate.PRONOUNS)
_ENDINGS = T._longest_first(V.FEMININE_ENDINGS)
#: the token table in SQL: sentences, tokens, lexicon look-up; RE2 knows ASCII word boundaries only, so forms are anchored at both sides
TOKENS_SQL = f"""
    french as (select coalesce(source, 'none') as dataset, doc_id as text_id, text from documents where lang = 'fr' and text is not null),
    pieces as (select text_id, unnest(l) as s, generate_subscripts(l, 1) as k from (select text_id, regexp_split_to_array(regexp_replace(text, '([.!?…])\\s+', '\\1' || chr(10), 'g'), '\\n+') as l from french)),
    sents as (select text_id, k, trim(s, ' ') as s from pieces where trim(s, ' ') <> ''),
    toks as (select text_id, k, unnest(l) as text, generate_subscripts(l, 1) as j from (select text_id, k, regexp_extract_all(s, '{_TOKEN_RE}') as l from sents)),
    numbered as (select text_id, text, row_number() over (partition by text_id order by k, j) - 1 as i, lower(replace(text, '’', '''')) as low from toks),
    keyed as (select *, case when regexp_matches(text, '\\p{{Ll}}\\p{{Lu}}+$') then lower(regexp_extract(text, '^(\\p{{Lu}}?\\p{{Ll}}+)\\p{{Lu}}+$', 1)) when regexp_matches(low, '[·‧.⋅•∙/(]') then regexp_extract(low, '^\\p{{L}}+(?:-\\p{{L}}+)*') else low end as form from numbered),
    lex(form, lemma, pos) as (values {_values(LEXICON)}),
    tokens as (select text_id, i, text, coalesce(lex.lemma, low) as lemma, coalesce(lex.pos, case when low in (select * from (values {_DET})) then 'DET' when low in (select * from (values {_PRON})) then 'PRON' when not regexp_matches(low, '[\\p{{L}}\\p{{N}}]') then 'PUNCT' when regexp_matches(low, '^\\p{{N}}+$') then 'NUM' else 'X' end) as pos
               from keyed left join lex using (form)),
    forms as (select *, nullif(regexp_extract(text, '^(?i:[A-zÀ-ú]+)((?:[·‧.⋅•∙/(])(?i:{_ENDINGS}))(?:$|[^\\p{{L}}\\p{{N}}_])', 1), '') as separator,
                     case when text <> upper(text) then nullif(regexp_extract(text, '^(?:[A-zÀ-ú]+?)({_ENDINGS})(?:$|[^\\p{{L}}\\p{{N}}_])', 1), '') end as upper_ from tokens where pos = 'NOUN'),
    humans(noun) as (values {_values(HUMANS)}),
    gated as (select * from forms where lemma in (select noun from humans) or (separator is not null and text not in ({", ".join("'" + w + "'" for w in V.CODE_WORDS)})) or upper_ is not null),
    generics(noun) as (values {_values(GENERICS)}),
    determined(noun) as (values {_values(DETERMINED)}),
    epicenes(noun) as (values {_values(EPICENES)}),
    prev as (select text_id, i, lag(text) over w as p_text, lag(pos) over w as p_pos from tokens window w as (partition by text_id order by i)),
    logs as (select g.text_id, g.i, 0 as from_epicene, g.lemma from gated g join generics on lemma = noun
             union all select g.text_id, g.i, 1, g.lemma from gated g join epicenes on lemma = noun join prev using (text_id, i) where p_pos = 'DET' and p_text in ('ce', 'cet', 'un', 'le', 'du')),
    per_text as (select f.dataset, f.text_id, coalesce(h.n, 0) as hn, least(coalesce(m.n, 0), coalesce(h.n, 0)) as mg, coalesce(m.n, 0) as raw_mg
                 from french f left join (select text_id, count(*) as n from gated group by 1) h using (text_id) left join (select text_id, count(*) as n from logs group by 1) m using (text_id))
"""


@dataclass(frozen=True)
class Words:
    """The texts and word lists that a query works on; each is a function of (spark, folder)."""

    french: Callable
    tokens: Callable
    humans: Callable
    generics: Callable
    epicenes: Callable
    determined: Callable
    classes: Callable


def _inline(words: list[str]) -> Callable:
    return lambda spark, d: _words(spark, words)


INLINE = Words(_french, _tokens, _inline(HUMANS), _inline(GENERICS), _inline(EPICENES), _inline(DETERMINED), lambda spark, d: spark.createDataFrame(CLASSES, "noun string, class string, subclass string"))


def _generic_logs(spark: SparkSession, d: str, words: Words = INLINE) -> tuple[DataFrame, DataFrame, DataFrame]:
    toks = words.tokens(spark, d)
    gated = markers.human_nouns(toks, words.humans(spark, d))
    logs = markers.masculine_generics(gated, words.generics(spark, d)).unionByName(markers.epicene_generics(toks, gated, words.epicenes(spark, d)))
    return toks, gated, logs


def _scores(spark: SparkSession, d: str, words: Words = INLINE) -> DataFrame:
    """Counts instead of collected logs: all that the scores need."""
    counts = markers.marker_counts(words.tokens(spark, d), words.humans(spark, d), words.generics(spark, d), words.epicenes(spark, d))
    j = words.french(spark, d).select("dataset", "text_id").join(counts, "text_id", "left")
    return scoring.text_scores(j.withColumn("masc_gen_logs", F.array_repeat(F.lit(1), F.coalesce("n_logs", F.lit(0)).cast("int"))))


@query(f"with {TOKENS_SQL} select dataset, count(*) as n_texts, count(*) filter (hn > 0) as n_scored, sum(hn)::bigint as total_hn, sum(mg)::bigint as total_mg, round(case when sum(hn) > 0 then sum(mg) / sum(hn) end, 6) as overall_m_score, round(avg(mg / hn) filter (hn > 0), 6) as mean_m_score, round(avg((mg > 0)::int) filter (hn > 0), 6) as bias_rate from per_text group by dataset")
def m_score_by_source(spark: SparkSession, d: str, words: Words = INLINE) -> DataFrame:
    """F1 J4 J5 T6-T8 A4-A7 V3 V4"""
    return scoring.dataset_scores(_scores(spark, d, words))


@query(f"with {TOKENS_SQL} select dataset, floor(round(mg / hn * 10, 9))::int as bin, count(*) as n from per_text where hn > 0 group by 1, 2")
def m_score_histogram(spark: SparkSession, d: str, words: Words = INLINE) -> DataFrame:
    """A8 R1"""
    return scoring.histogram(_scores(spark, d, words))


@query(f"with {TOKENS_SQL}, r as (select dataset, round(100 * avg((mg > 0)::int) filter (hn > 0), 6) as bias_rate_pct, round(100.0 * count(*) filter (raw_mg > 0) / count(*), 6) as coverage_pct from per_text group by 1) select *, row_number() over (order by coverage_pct desc, dataset)::int as rank from r")
def use_rate(spark: SparkSession, d: str, words: Words = INLINE) -> DataFrame:
    """A10 A11 R3"""
    return report.use_rate(_scores(spark, d, words))


@query(f"with {TOKENS_SQL} select text_id, i::int as i, lemma as masc_gen, from_epicene::int as from_epicene from logs")
def masculine_generic_logs(spark: SparkSession, d: str, words: Words = INLINE) -> DataFrame:
    """T6 T7 A20 J5"""
    return _generic_logs(spark, d, words)[2].select("text_id", "i", "masc_gen", "from_epicene")


@query(f"with {TOKENS_SQL} select text_id, i::int as i, text as token, separator, upper_ as upper from gated where separator is not null or upper_ is not null")
def inclusive_forms(spark: SparkSession, d: str, words: Words = INLINE) -> DataFrame:
    """T8 T9 T10"""
    return markers.human_nouns(words.tokens(spark, d), words.humans(spark, d)).where("separator is not null or upper is not null").select("text_id", "i", F.col("text").alias("token"), "separator", "upper")


@query(f"with {TOKENS_SQL} select text_id, i::int as i, lemma as neutral from gated where lemma in ('personne', 'personnes', 'individu', 'individus', 'gens')")
def neutral_noun_logs(spark: SparkSession, d: str, words: Words = INLINE) -> DataFrame:
    """T11"""
    return markers.neutral_nouns(markers.human_nouns(words.tokens(spark, d), words.humans(spark, d))).select("text_id", "i", "neutral")


def _count_phrases(phrases) -> str:
    # every non-word sign is doubled first, so that neighbouring matches do not share one; blanks inside phrases double too
    return f"len(regexp_extract_all(regexp_replace(text, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g'), '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:{'|'.join(p.replace(', ', ',,  ').replace(' ', '  ') if ', ' not in p else p.replace(', ', ',,  ') for p in phrases)})(?:$|[^\\p{{L}}\\p{{N}}_])'))"


@query(f"with f as (select doc_id as text_id, text from documents where lang = 'fr' and text is not null), c as (select text_id, {_count_phrases(V.INCLUSIVE_GREETINGS)} as greetings, {_count_phrases(V.INCLUSIVE_PAIRS)} as pairs, {_count_phrases(V.NEUTRAL_PRONOUNS)} as pronouns, {_count_phrases(COMMON_PHRASES)} as common from f) select text_id, greetings::int as greetings, pairs::int as pairs, pronouns::int as pronouns, common::int as common from c where greetings + pairs + pronouns + common > 0")
def phrase_marker_counts(spark: SparkSession, d: str, french=_french) -> DataFrame:
    """T12 T13 T14"""
    marks = markers.phrase_markers(F.col("text"))
    counts = [F.size(marks[f"{m}_logs"]).alias(n) for m, n in (("incl_greetings", "greetings"), ("incl_pairs", "pairs"), ("neutral_prons", "pronouns"))]
    c = french(spark, d).select("text_id", *counts, F.size(T.phrase_hits(T.sentences(F.col("text")), COMMON_PHRASES)).alias("common"))
    return c.where("greetings + pairs + pronouns + common > 0")


@query(f"""with {TOKENS_SQL}, ph as (select text_id, {_count_phrases(V.INCLUSIVE_GREETINGS)} as g, {_count_phrases(V.INCLUSIVE_PAIRS)} as p, {_count_phrases(V.NEUTRAL_PRONOUNS)} as n from french),
    t as (select f.dataset, f.text_id, g > 0 as incl_greetings, n > 0 as neutral_prons, p > 0 as incl_pairs, text_id in (select text_id from gated where lemma in ('personne', 'personnes', 'individu', 'individus', 'gens')) as neutral_words, text_id in (select text_id from gated where separator is not null or upper_ is not null) as fem_endings from french f join ph using (text_id))
    select dataset, marker, sum(v::int)::bigint as count, round(100.0 * sum(v::int) / count(*), 6) as pct from (unpivot t on incl_greetings, neutral_prons, incl_pairs, neutral_words, fem_endings into name marker value v) group by dataset, marker""")
def marker_rates(spark: SparkSession, d: str, words: Words = INLINE) -> DataFrame:
    """T12-T17 A9 R4 F20"""
    rec = markers.records(words.french(spark, d), words.tokens(spark, d), words.humans(spark, d), words.generics(spark, d), words.epicenes(spark, d))
    return report.marker_rates(rec.withColumns({"text_index": F.col("text_id"), "text_index_dataset": F.concat_ws("_", "dataset", F.col("text_id").cast("string"))}))


@query(f"with {TOKENS_SQL}, r as (select f.dataset, f.text_id, (select count(*) from gated g where g.text_id = f.text_id) as human_noun_count, (select count(*) from logs l where l.text_id = f.text_id) as n_logs from french f) select dataset, text_id, human_noun_count::int as human_noun_count, n_logs::int as n_logs from r")
def text_records(spark: SparkSession, d: str, words: Words = INLINE) -> DataFrame:
    """T17"""
    rec = markers.records(words.french(spark, d), words.tokens(spark, d), words.humans(spark, d), words.generics(spark, d), words.epicenes(spark, d))
    return rec.select("dataset", "text_id", "human_noun_count", F.size("masc_gen_logs").alias("n_logs"))


_CLASS_SQL = f"{TOKENS_SQL}, cls(noun, class, subclass) as (values {_values(CLASSES)}), dict as (select distinct noun, unnest(list_filter([class, subclass], lambda x: x <> '')) as class from cls), counts as (select dataset, class, count(distinct c.noun) as freq from (select distinct f.dataset, g.lemma as noun from gated g join french f using (text_id)) u join dict c using (noun) group by 1, 2), top as (select dataset, class, freq from counts qualify row_number() over (partition by dataset order by freq desc, class) <= 5)"


def _class_counts(spark: SparkSession, d: str, words: Words = INLINE) -> DataFrame:
    gated = markers.human_nouns(words.tokens(spark, d), words.humans(spark, d))
    nouns = gated.join(words.french(spark, d).select("text_id", "dataset"), "text_id").select("dataset", F.col("lemma").alias("noun"))
    dictionary = words.classes(spark, d)
    return report.class_counts(nouns, dictionary.withColumn("merged_classes", T.merged_classes(F.col("class"), F.col("subclass"))))


@query(f"with {_CLASS_SQL} select * from top")
def class_counts(spark: SparkSession, d: str, words: Words = INLINE) -> DataFrame:
    """A2 D5 D6 R2"""
    return _class_counts(spark, d, words)


@query(f"with {_CLASS_SQL}, best as (select class from (select class, sum(freq) as t from top group by 1) order by t desc, class limit 5) select dataset, class, coalesce(freq, 0) as freq from (select distinct dataset from top) cross join best left join top using (dataset, class)")
def top_classes(spark: SparkSession, d: str, words: Words = INLINE) -> DataFrame:
    """A3"""
    return report.top_classes(_class_counts(spark, d, words))


_SPEC_SQL = "select distinct text_id from (select text_id, pos, lower(text) as low, lead(pos) over w as p1, lead(lemma) over w as l1, lead(pos, 2) over w as p2, lead(lemma, 2) over w as l2 from tokens window w as (partition by text_id order by i)) where low in ('mon', 'ton', 'son', 'sa', 'notre', 'votre', 'leur', 'ce', 'cet') and pos = 'DET' and ((p1 = 'NOUN' and l1 in (select noun from determined)) or (p1 = 'ADJ' and p2 = 'NOUN' and l2 in (select noun from determined)))"


@query(f"with {TOKENS_SQL} {_SPEC_SQL}")
def specific_determiners(spark: SparkSession, d: str, words: Words = INLINE) -> DataFrame:
    """T1 A20"""
    return filters.specific_determiner(words.tokens(spark, d), words.determined(spark, d))


@query(f"with {TOKENS_SQL}, bad as ({_SPEC_SQL} union select distinct text_id from tokens where pos = 'NOUN' and lemma in (select noun from generics)), neut as (select distinct text_id from tokens where pos = 'NOUN' and lemma in ('personne', 'personnes', 'individu', 'individus', 'gens')) select text_id, text_id in (select text_id from bad) as blanked, case when text_id not in (select text_id from bad) then (text_id in (select text_id from neut))::int end as neutral from french")
def cell_filter(spark: SparkSession, d: str, words: Words = INLINE) -> DataFrame:
    """F14 T1 T2 T4"""
    toks = words.tokens(spark, d)
    g = words.generics(spark, d)
    flags = {"text": {"spec": filters.specific_determiner(toks, words.determined(spark, d)), "generic": filters.masculine_generic(toks, g), "neutral": filters.neutral_word(toks)}}
    out = filters.blank_cells(words.french(spark, d).select("text_id", "text"), "text_id", ["text"], flags, neutral=True)
    return out.select("text_id", F.col("text").isNull().alias("blanked"), "neutral")


_ENT_SQL = "ents as (select doc_id, unnest(regexp_extract_all(text, '\\p{Lu}\\p{L}+(?: \\p{Lu}\\p{L}+)*')) as e from documents)"


@query(f"with {_ENT_SQL} select distinct doc_id as text_id from (select doc_id, unnest(string_split(e, ' ')) as w from ents) where w in (select prenoms from first_names)")
def person_entities(spark: SparkSession, d: str) -> DataFrame:
    """Capitalised runs stand in for MISC entities"""
    p = F.lit(r"(\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*)")
    ents = table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), F.explode(F.regexp_extract_all("text", p, F.lit(1))).alias("text")).withColumn("label", F.lit("MISC"))
    return filters.person_entity(ents, table(spark, d, "first_names"))


@query("select count(doc_id) as doc_id, count(text) as text, count(lang) as lang, count(source) as source from documents")
def non_null_counts(spark: SparkSession, d: str) -> DataFrame:
    """A12"""
    return filters.non_null_counts(table(spark, d, "documents"), ["doc_id", "text", "lang", "source"])


_CLEAN_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<script\\b[^>]*>.*?</script>|<style\\b[^>]*>.*?</style>', '', 'g'), '<[/!a-zA-Z][^<>]*>', '', 'g'), 'https?://[^\\s]+', '', 'g'), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g')"


def _clean_sql(c: str) -> str:
    """References by the public list of names, and by number in either base."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    names = "MAP {" + ", ".join(f"{q('&' + n)}: {q(v)}" for n, v in html5.items() if n.endswith(";")) + "}"
    sign = f"case when regexp_matches(x, '^&#[0-9]+;$') then chr(regexp_extract(x, '[0-9]+')::int) when regexp_matches(x, '^&#[xX][0-9a-fA-F]+;$') then chr(('0x' || regexp_extract(x, '[xX](.*);', 1))::int) else coalesce(({names})[x], x) end"
    return _CLEAN_SQL.format(f"case when contains({c}, '&') then array_to_string(list_transform(regexp_extract_all({c}, '&[^;&\\s]+;|[^&]+|&'), lambda x: {sign}), '') else {c} end")


@query(f"select doc_id, md5({_clean_sql('text')}) as cleaned_md5 from documents where text is not null")
def clean_html(spark: SparkSession, d: str) -> DataFrame:
    """T15"""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.remove_html(F.col("text")).cast("binary")).alias("cleaned_md5"))


@query(f"with c as (select doc_id, text, case when regexp_matches(text, '[·‧.⋅•∙/(]') then {_clean_sql('text')} else text end as cleaned from documents) select doc_id from c where text is null or text <> cleaned union select min(doc_id) from c where text is not null group by cleaned having bool_or(text = cleaned) and min(doc_id) in (select doc_id from c where text = cleaned)")
def dedup_sequential(spark: SparkSession, d: str) -> DataFrame:
    """U8 T16"""
    return clean.dedup_sequential(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id")


@query("select source, min(doc_id) as doc_id from documents where source is not null group by source")
def first_seen_sources(spark: SparkSession, d: str) -> DataFrame:
    """U9"""
    return clean.first_seen(table(spark, d, "documents"), "source", "doc_id")


@query("select doc_id, case when regexp_matches(lower(text), 'boulanger|facteur') then array_to_string(list_filter(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?…])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x, ' ')), lambda x: x <> ''), lambda x: not regexp_matches(x, '(?i)(?:^|[^\\p{L}\\p{N}_])(?:boulanger|facteur)(?:$|[^\\p{L}\\p{N}_])')), ' ') else text end as text from documents where text is not null")
def drop_sentences(spark: SparkSession, d: str) -> DataFrame:
    """T18"""
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.drop_sentences_with(F.col("text"), ("boulanger", "facteur")).alias("text"))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").select(F.trim("message_id").alias("message_id"), F.nullif(F.trim("parent_id"), F.lit("")).alias("parent_id"))
    return lexicon.keep_first(m.where("message_id is not null"), ["message_id"], [F.coalesce("parent_id", F.lit(""))])


@query("""with recursive m as (select trim(message_id, ' ') as message_id, nullif(min(coalesce(trim(parent_id, ' '), '')), '') as parent_id from messages where message_id is not null group by 1),
    t as (select message_id as root_id, message_id as leaf_id, 1 as n from m where parent_id is null union all select root_id, m.message_id, n + 1 from t join m on m.parent_id = t.leaf_id)
    select root_id, leaf_id, n::int as n from t where n > 1 and leaf_id not in (select parent_id from m where parent_id is not null)""")
def thread_paths(spark: SparkSession, d: str) -> DataFrame:
    """D1 J11"""
    return threads.thread_paths(_tree(spark, d)).select("root_id", "leaf_id", F.size("path").alias("n"))


#: every path from a root to a message without replies, message by message
_TURNS_SQL = f"""recursive v as (select nullif(trim(message_id, ' '), '') as id, nullif(trim(parent_id, ' '), '') as parent, lower(trim(role, ' ')) as r, coalesce(content, '') as text, ingested_at, created_at from messages),
    s as (select id, parent, case when r in (select * from (values {_values(V.USER_NAMES)})) then 'user' when r in (select * from (values {_values(V.ASSISTANT_NAMES)})) then 'assistant' else coalesce(r, '') end as role, text, ingested_at, created_at from v where id is not null),
    m as (select id, parent, role, text from s qualify row_number() over (partition by id order by ingested_at desc nulls last, created_at desc nulls last, coalesce(parent, '') desc, role desc, text desc) = 1),
    t as (select id as root_id, id as last_id, [id] as path from m where parent is null union all select root_id, m.id, list_append(path, m.id) from t join m on m.parent = t.last_id),
    x as (select last_id as conv_id, root_id, unnest(path) as id, generate_subscripts(path, 1) as turn from t where len(path) > 1 and last_id not in (select parent from m where parent is not null)),
    turns as (select conv_id, root_id, turn, role, text from x join m using (id))"""


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return threads.paths_in_turns(threads.latest_turns(table(spark, d, "messages")))


_CUT_SQL = "cut as (select * from (select *, max(turn) over (partition by conv_id) as last from turns) where not (turn = last and role = 'user'))"


@query(f"with {_TURNS_SQL}, {_CUT_SQL}, n as (select conv_id, role || '_content' || row_number() over (partition by conv_id, role order by turn) as cell, text from cut where role in ('user', 'assistant')) select * from (pivot n on cell using coalesce(max(text), '') group by conv_id)")
def dialogue_wide(spark: SparkSession, d: str) -> DataFrame:
    """Every turn, in as many columns as the longest dialogue needs"""
    return threads.wide_dialogues(threads.cut_last_user(_turns(spark, d)))


@query(f"""with recursive v as (select nullif(trim(message_id, ' '), '') as id, nullif(trim(parent_id, ' '), '') as parent, lower(trim(role, ' ')) as r, coalesce(content, '') as text, ingested_at, created_at from messages),
    s as (select id, parent, case when r in (select * from (values {_values(V.USER_NAMES)})) then 'user' when r in (select * from (values {_values(V.ASSISTANT_NAMES)})) then 'assistant' else coalesce(r, '') end as role, text, ingested_at, created_at from v where id is not null),
    m as (select id, parent, role, text from s qualify row_number() over (partition by id order by ingested_at desc nulls last, created_at desc nulls last, coalesce(parent, '') desc, role desc, text desc) = 1),
    t as (select id as root_id, id as last_id, [id] as path from m where parent is null union all select root_id, m.id, list_append(path, m.id) from t join m on m.parent = t.last_id),
    l as (select root_id, case when m.role = 'user' then path[:-2] else path end as path from t join m on m.id = last_id where len(path) > 1 and last_id not in (select parent from m where parent is not null)),
    c as (select distinct path[-1] as conv_id, root_id, path from l), x as (select conv_id, root_id, unnest(path) as id, generate_subscripts(path, 1) as turn from c)
    select conv_id, root_id, role, (row_number() over (partition by conv_id, role order by turn))::int as n, text from x join m using (id) where role in ('user', 'assistant')""")
def dialogue_turns(spark: SparkSession, d: str) -> DataFrame:
    """D1-D4 A18 in long form, paths that differ only in the message cut off once"""
    return threads.dialogue_turns(threads.latest_turns(table(spark, d, "messages")))


@query(f"with {_TURNS_SQL} select conv_id, coalesce(arg_min(text, turn) filter (role = 'user'), '') as text from turns group by conv_id")
def first_user(spark: SparkSession, d: str) -> DataFrame:
    """A19"""
    return threads.first_of_role(_turns(spark, d), "user")


@query(f"with {_TURNS_SQL}, {_CUT_SQL} select conv_id, turn from cut")
def cut_last_user(spark: SparkSession, d: str) -> DataFrame:
    """D2"""
    return threads.cut_last_user(_turns(spark, d)).select("conv_id", "turn")


_QUOTA_SQL = "c as (select source, count(*) as n from documents where source is not null group by 1), s as (select *, n / sum(n) over () as share from c), b as (select *, trunc(share * 500)::bigint as base from s), r as (select *, 500 - sum(base) over () as rest, row_number() over (order by share desc, source) as place from b)"


@query(f"with {_QUOTA_SQL} select source, n, least(base + (place <= rest)::int, n)::bigint as quota from r")
def stratified_quota(spark: SparkSession, d: str) -> DataFrame:
    """G1 A1 A23"""
    return sampling.proportional_quotas(table(spark, d, "documents").where("source is not null"), "source", 500)


@query(f"with {_QUOTA_SQL} select source, least(base + (place <= rest)::int, n)::bigint as n from r where base + (place <= rest)::int > 0")
def stratified_sample_sizes(spark: SparkSession, d: str) -> DataFrame:
    """G1: rows drawn by source; which rows is fixed by a hash that SQL lacks"""
    docs = table(spark, d, "documents").where("source is not null").select("doc_id", "source")
    return sampling.stratified_sample(docs, "source", "doc_id", 500).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query()
def capital_sample(spark: SparkSession, d: str) -> DataFrame:
    """Hash-based, compared with a brute-force form in the tests"""
    words = table(spark, d, "lexicon_entries").select("noun").where("noun is not null").distinct()
    return sampling.train_split(sampling.fraction_sample(words, "noun"), "noun")


@query("select doc_id from documents where n_chars is not null and (source <> 'forum' or source is null) and source is not null union all select doc_id from documents where n_chars is not null and source = 'forum' qualify row_number() over (partition by source order by doc_id) <= 250")
def capped_per_group(spark: SparkSession, d: str) -> DataFrame:
    """A15"""
    return sampling.capped_per_group(table(spark, d, "documents"), "source", "doc_id", "n_chars", ["forum"]).select("doc_id")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    inner = F.when(F.col("event_id") % 7 == 0, "broken").otherwise(F.concat(F.lit('{\\"a\\":'), (F.col("event_id") % 2).cast("string"), F.lit(',\\"a_2\\":1}')))
    value = F.concat(F.lit('{"custom_id":"u'), F.col("user_id").cast("string"), F.lit('","response":{"body":{"choices":[{"message":{"content":"'), inner, F.lit('"}}]}}}'))
    return table(spark, d, "events").select(F.col("event_id").alias("line_no"), value.alias("value"))


@query("select 'u' || user_id as custom_id, (max_by(event_id, event_id) % 2)::int as a, 1 as a_2 from events where event_id % 7 <> 0 group by user_id")
def verdict_parse(spark: SparkSession, d: str) -> DataFrame:
    """S9 V1"""
    return validate.parse_verdicts(_lines(spark, d)).select("custom_id", F.col("verdicts")["a"].alias("a"), F.col("verdicts")["a_2"].alias("a_2"))


@query("select count(*) as n_unparsed from events where event_id % 7 = 0")
def verdict_unparsed(spark: SparkSession, d: str) -> DataFrame:
    """S9"""
    return validate.count_unparsed(_lines(spark, d))


@query("""with v as (select user_id, max_by(event_id, event_id) % 2 as a from events where event_id % 7 <> 0 group by user_id), u as (select distinct user_id from events)
    select 'u' || u.user_id as text_index_dataset, case when v.user_id is not null then 1 + a end::int as real_human_nouns_count, case when v.user_id is not null then 1 + a end::int as n_logs from u left join v using (user_id)""")
def verdict_apply(spark: SparkSession, d: str) -> DataFrame:
    """Logs of the tokens a and b against positive verdicts a and a_2"""
    log = F.array(F.struct(F.lit("a").alias("token")), F.struct(F.lit("b").alias("token")))
    rec = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("text_index_dataset")).distinct().withColumn("masc_gen_logs", log)
    out = validate.apply_verdicts(rec, validate.parse_verdicts(_lines(spark, d), positive_only=True))
    hit = F.when(F.col("real_human_nouns").isNotNull(), F.size("real_masc_gen_logs") * F.col("real_human_nouns_count"))
    return out.select("text_index_dataset", "real_human_nouns_count", hit.alias("n_logs"))


@query("""with m as (select original_annotation as x, annotator_annotation as y, count(*) as n from annotations where original_annotation is not null and annotator_annotation is not null group by all), t as (select sum(n) as n, sum(n) filter (x = y) as same from m),
    c as (select sum(a.n::double * b.n) as c from (select x, sum(n) as n from m group by 1) a join (select y, sum(n) as n from m group by 1) b on a.x = b.y)
    select n::bigint as n, round(same / n, 6) as po, round(coalesce(c, 0) / (n::double * n), 6) as pe, round((same / n - coalesce(c, 0) / (n::double * n)) / (1 - coalesce(c, 0) / (n::double * n)), 6) as kappa from t, c""")
def kappa(spark: SparkSession, d: str) -> DataFrame:
    """A17"""
    return agreement.cohen_kappa(table(spark, d, "annotations"), "original_annotation", "annotator_annotation")


_VOTE_SQL = "votes as (select vec_id::varchar as word, (embedding[1] > 0)::int as p1, (embedding[2] > 0)::int as p2, (embedding[3] > 0)::int as p3, round((embedding[1]::double + embedding[2]::double + embedding[3]::double), 6) as probability_sum from embeddings)"


def _votes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    parts = [e.select(F.col("vec_id").cast("string").alias("word"), (F.col("embedding")[k] > 0).cast("int").alias("prediction"), F.col("embedding")[k].cast("double").alias("probability")) for k in range(3)]
    return agreement.vote_table(*parts).withColumn("probability_sum", F.round("probability_sum", 6))


@query(f"with {_VOTE_SQL} select word, probability_sum from votes where p1 + p2 + p3 = 3 and probability_sum >= 0.1")
def vote_unanimous(spark: SparkSession, d: str) -> DataFrame:
    """V6 A13 J10"""
    return agreement.unanimous(_votes(spark, d), 3, 0.1).select("word", "probability_sum")


@query(f"with {_VOTE_SQL} select word, p1, p2, p3, probability_sum from votes where p1 + p2 + p3 = 2")
def vote_split(spark: SparkSession, d: str) -> DataFrame:
    """V5"""
    return agreement.disagreements(_votes(spark, d), 2).select("word", "p1", "p2", "p3", "probability_sum")


@query("""with seeds as (select label, list_transform(embedding, lambda x: x::double) as v, label < 4 as human from embeddings qualify row_number() over (partition by label order by vec_id) = 1), unit as (select human, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) as u from seeds),
    e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), s as (select e.vec_id, human, avg(list_inner_product(v, u) / sqrt(list_inner_product(v, v))) as c from e, unit group by 1, 2)
    select vec_id, round(max(c) filter (human), 6) as seed_human, round(max(c) filter (not human), 6) as seed_non_human from s group by 1""")
def seed_cosine(spark: SparkSession, d: str) -> DataFrame:
    """H3: each label's first vector is a seed"""
    e = table(spark, d, "embeddings")
    seeds = e.groupBy("label").agg(F.min(F.struct("vec_id", "embedding"))["embedding"].alias("vector")).select("vector", (F.col("label") < 4).alias("is_human"))
    return features.seed_scores(e, seeds, "vec_id", "embedding")


@query("select entry_id, regexp_matches(noun, '(?:" + "|".join(V.HUMAN_SUFFIXES) + ")$')::int as suffix from lexicon_entries where noun is not null")
def suffix_score(spark: SparkSession, d: str) -> DataFrame:
    """H4"""
    return table(spark, d, "lexicon_entries").where("noun is not null").select("entry_id", T.suffix_score(F.col("noun")).alias("suffix"))


@query("""with p as (select p_partkey % 97 as word, p_partkey % 11 as synset, case p_partkey % 4 when 0 then 'salesperson.n.01' when 1 then 'artifact.n.01' when 2 then 'animal.n.01' else 'thing.n.01' end as node from part)
    select word::varchar as word, round(sum((node = 'salesperson.n.01')::int) / count(distinct synset), 6) as hypernym_human, round(sum((node in ('artifact.n.01', 'animal.n.01'))::int) / count(distinct synset), 6) as hypernym_non_human from p group by 1""")
def hypernym_scores(spark: SparkSession, d: str) -> DataFrame:
    """H1 A14"""
    k = F.col("p_partkey")
    node = F.when(k % 4 == 0, "salesperson.n.01").when(k % 4 == 1, "artifact.n.01").when(k % 4 == 2, "animal.n.01").otherwise("thing.n.01")
    return features.hypernym_scores(table(spark, d, "part").select((k % 97).cast("string").alias("word"), (k % 11).alias("synset"), F.lit(0).alias("path_id"), node.alias("node")))


_IND = lambda words: " + ".join(f"contains(lower(gloss), '{w}')::int" for w in words)


@query(f"with g as (select source as word, doc_id as synset, text as gloss from documents where lang = 'en' and text is not null and source is not null) select word, round(sum({_IND(V.HUMAN_INDICATORS)}) / count(distinct synset), 6) as def_human, round(sum({_IND(V.NON_HUMAN_INDICATORS)}) / count(distinct synset), 6) as def_non_human from g group by 1")
def definition_scores(spark: SparkSession, d: str) -> DataFrame:
    """H2"""
    return _definition_scores(table(spark, d, "documents").where("lang = 'en' and text is not null and source is not null"))


def _definition_scores(g: DataFrame) -> DataFrame:
    return features.definition_scores(g.select(F.col("source").alias("word"), F.col("doc_id").alias("synset"), F.col("text").alias("gloss")))


@query("""with f as (select p_partkey, (p_partkey % 7) / 7.0 as hh, (p_partkey % 5) / 5.0 as hn, (p_partkey % 3) / 3.0 as dh, (p_partkey % 4) / 4.0 as dn, (p_partkey % 9) / 9.0 as sh, (p_partkey % 8) / 8.0 as sn, p_partkey % 2 as suf from part),
    s as (select p_partkey, round(hh * 0.4 + dh * 0.3 + sh * 0.3 + suf * 0.3, 6) as human_score, round(hn * 0.4 + dn * 0.3 + sn * 0.3 + suf * 0.3, 6) as non_human_score from f)
    select p_partkey, human_score, non_human_score, case when human_score > non_human_score then 'human' else 'non_human' end as classification, case when abs(human_score - non_human_score) < 0.02 then 'uncertain' when human_score > non_human_score then 'human' else 'non_human' end as batch_class from s""")
def rule_class(spark: SparkSession, d: str) -> DataFrame:
    """H5 H6"""
    k = F.col("p_partkey")
    cols = {"hypernym_human": 7, "hypernym_non_human": 5, "def_human": 3, "def_non_human": 4, "seed_human": 9, "seed_non_human": 8}
    f = table(spark, d, "part").select("p_partkey", *[((k % n) / float(n)).alias(c) for c, n in cols.items()], (k % 2).alias("suffix"))
    return features.rule_scores(f).select("p_partkey", "human_score", "non_human_score", "classification", "batch_class")


_NHUMA = "nhuma as (select lower(noun) as lexeme, min(class) as class, min(subclass) as subclass from lexicon_entries where origin = 'nhuma' and noun is not null group by 1)"


def _class_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lex = table(spark, d, "lexicon_entries").where("noun is not null")
    nhuma = lex.where("origin = 'nhuma'").groupBy(F.lower("noun").alias("lexeme")).agg(F.min("class").alias("class"), F.min("subclass").alias("subclass"))
    left = lexicon.classes_of(lex.where("origin = 'tlfi'").select(F.lower("noun").alias("noun")).distinct(), "noun", nhuma, "tlfi")
    right = lexicon.classes_of(lex.where("origin = 'dmnt'").select(F.lower("noun").alias("noun")).distinct(), "noun", nhuma, "dmnt")
    return left, right


@query(f"""with {_NHUMA}, t as (select distinct lower(noun) as noun from lexicon_entries where origin = 'tlfi' and noun is not null), m as (select distinct lower(noun) as noun from lexicon_entries where origin = 'dmnt' and noun is not null)
    select noun, coalesce(class, '') as class, coalesce(subclass, '') as subclass from (select noun from t union select noun from m) left join nhuma on lexeme = noun""")
def class_merge(spark: SparkSession, d: str) -> DataFrame:
    """J1 J2 J3 U7"""
    return lexicon.merge_classes(*_class_tables(spark, d))


@query(f"""with {_NHUMA}, c(k, v) as (values ('Divers', 'other')), x as (select lexeme as noun, trim(coalesce(class, ''), ' ') as class, trim(coalesce(subclass, ''), ' ') as subclass from nhuma)
    select noun, class, subclass, array_to_string(list_filter(case when class = subclass then [class] else [class, subclass] end, lambda z: z <> ''), ', ') as merged_classes from x""")
def final_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """F18 D6"""
    lex = table(spark, d, "lexicon_entries").where("noun is not null and origin = 'nhuma'")
    nhuma = lex.groupBy(F.lower("noun").alias("noun")).agg(F.coalesce(F.min("class"), F.lit("")).alias("class"), F.coalesce(F.min("subclass"), F.lit("")).alias("subclass"))
    return lexicon.final_dictionary(nhuma)


@query("""with d as (select lower(noun) as noun, min(class) as class, min(subclass) as subclass from lexicon_entries where noun is not null and origin = 'wikt' group by 1), a as (select noun, arg_min(class, o) as class, arg_min(subclass, o) as subclass from (select lower(noun) as noun, class, subclass, row(class, subclass) as o from lexicon_entries where noun is not null and origin = 'model' and class is not null and subclass is not null) group by 1)
    select noun, coalesce(a.class, d.class) as class, coalesce(a.subclass, d.subclass) as subclass from d full join a using (noun)""")
def class_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """J14"""
    lex = table(spark, d, "lexicon_entries").where("noun is not null")
    base = lex.where("origin = 'wikt'").groupBy(F.lower("noun").alias("noun")).agg(F.min("class").alias("class"), F.min("subclass").alias("subclass"))
    return lexicon.overwrite_classes(base, lex.where("origin = 'model' and class is not null and subclass is not null").select(F.lower("noun").alias("noun"), "class", "subclass"))


@query("select count(*) filter (class is null or class = '') as n_missing, count(*) as n, round(100.0 * count(*) filter (class is null or class = '') / count(*), 6) as pct_missing from lexicon_entries")
def missing_classes(spark: SparkSession, d: str) -> DataFrame:
    """A16"""
    return lexicon.missing_classes(table(spark, d, "lexicon_entries"))


@query("""with w as (select distinct w from (select lower(noun) as w from lexicon_entries union all select lower(wordform) from tlfi_words) where w is not null)
    select row_number() over (order by w) as word_id, w as word, l.id as lex_id, t.id as tlfi_id from w left join (select lower(noun) as k, min(entry_id) as id from lexicon_entries group by 1) l on l.k = w left join (select lower(wordform) as k, min(word_id) as id from tlfi_words group by 1) t on t.k = w""")
def word_index(spark: SparkSession, d: str) -> DataFrame:
    """U2 A21 J9 D10"""
    return lexicon.word_index({
        "lex": table(spark, d, "lexicon_entries").select(F.col("entry_id").alias("id"), F.lower("noun").alias("word")),
        "tlfi": table(spark, d, "tlfi_words").select(F.col("word_id").alias("id"), F.lower("wordform").alias("word")),
    })


_SETS_SQL = "dem as (select distinct noun from lexicon_entries where origin = 'dmnt' and noun is not null), gold as (select distinct noun from lexicon_entries where origin = 'nhuma' and noun is not null), rec as (select distinct wordform as noun from tlfi_words where wordform is not null)"


@query(f"with {_SETS_SQL} select noun from (select noun from dem except select noun from gold) where noun not in (select noun from rec where noun not in (select noun from gold)) and not regexp_matches(noun[1], '^\\p{{Lu}}')")
def candidate_except(spark: SparkSession, d: str) -> DataFrame:
    """U3 F8 H14"""
    lex = table(spark, d, "lexicon_entries")
    pick = lambda o: lex.where((F.col("origin") == o) & F.col("noun").isNotNull()).select("noun")
    return lexicon.word_candidates(pick("dmnt"), pick("nhuma"), table(spark, d, "tlfi_words").where("wordform is not null").select(F.col("wordform").alias("noun")))


@query("select k from (select c_custkey as k from customer union all select s_suppkey from supplier) group by k having count(*) = 1")
def symmetric_difference(spark: SparkSession, d: str) -> DataFrame:
    """U4"""
    return lexicon.symmetric_difference(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")))


@query("select entry_id, noun from lexicon_entries where noun is null or noun not in (select lower(wordform) from tlfi_words where wordform is not null)")
def drop_words(spark: SparkSession, d: str) -> DataFrame:
    """F3 J6"""
    return lexicon.drop_words(table(spark, d, "lexicon_entries").select("entry_id", "noun"), "noun", table(spark, d, "tlfi_words").select("wordform").where("wordform is not null"))


@query("select c_custkey, case when c_nationkey = 1 then c_name else lower(c_name) end as c_name, case when c_nationkey = 1 then c_mktsegment else lower(c_mktsegment) end as c_mktsegment from customer")
def lowercase_unless_proper(spark: SparkSession, d: str) -> DataFrame:
    """F15"""
    out = lexicon.lower_unless_proper(table(spark, d, "customer"), "c_nationkey")
    return out.select("c_custkey", "c_name", "c_mktsegment")


@query("select word_id, coalesce(case when not regexp_matches(etyhist, '^\\s*$') then etyhist end, regexp_split_to_array(trim(completewordform, ' '), '\\s+')[1]) as noun from tlfi_words")
def fallback_noun(spark: SparkSession, d: str) -> DataFrame:
    """F16"""
    return table(spark, d, "tlfi_words").select("word_id", T.fallback_noun(F.col("etyhist"), F.col("completewordform")).alias("noun"))


@query("select word_id from tlfi_words where contains(wordtype, 'subst') and regexp_matches(completewordform, '^[A-Z]+,\\s[A-Z]+') and length(trim(string_split(completewordform, ',')[2], ' ')) < length(trim(string_split(completewordform, ',')[1], ' ')) - 1")
def feminine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """F7"""
    return table(spark, d, "tlfi_words").where(T.is_feminine_pair(F.col("wordtype"), F.col("completewordform"))).select("word_id")


@query("select entry_id, replace(noun, '_', ' ') as noun from lexicon_entries where length(noun) >= 3 and not regexp_matches(noun, '[0-9]') and regexp_matches(noun, '^[\\p{L}\\p{N}_]+$')")
def clean_nouns(spark: SparkSession, d: str) -> DataFrame:
    """F10"""
    return table(spark, d, "lexicon_entries").where(T.is_clean_noun(F.col("noun"))).select("entry_id", F.replace("noun", F.lit("_"), F.lit(" ")).alias("noun"))


@query("select entry_id, noun, 'N de Population (Gentilé)' as class, 'Pays' as subclass from lexicon_entries where regexp_matches(noun, '(?:ais|ois|ain|ien|in|an|en|ol|and|ec|on|ard|urc)$')")
def demonym_entries(spark: SparkSession, d: str) -> DataFrame:
    """D8"""
    lex = table(spark, d, "lexicon_entries").select("entry_id", "noun")
    return lexicon.demonym_entries(lex).join(lex, "noun").select("entry_id", "noun", "class", "subclass").distinct()


@query("""with base as (select distinct noun from (select lower(noun) as noun from lexicon_entries union select lower(wordform) from tlfi_words) where noun is not null), dem as (select distinct wordform as noun from tlfi_words where regexp_matches(wordform, '^\\p{Lu}'))
    select noun from base where upper(noun[1]) || lower(noun[2:]) not in (select noun from dem) and noun not in (select noun from lexicon_entries where noun is not null and origin = 'model') union select noun from dem""")
def human_list(spark: SparkSession, d: str) -> DataFrame:
    """D9 U2"""
    lex, tlfi = table(spark, d, "lexicon_entries"), table(spark, d, "tlfi_words")
    dem = tlfi.where(F.col("wordform").rlike(r"^\p{Lu}")).select(F.col("wordform").alias("noun"))
    return lexicon.human_list([lex.select(F.lower("noun").alias("noun")), tlfi.select(F.lower("wordform").alias("noun"))], dem, lex.where("origin = 'model' and noun is not null").select("noun"))


@query("""with e as (select distinct word_id, trim(regexp_replace(unnest(json_extract_string(worddefinitionfeatures, '$[*].definition')), '\\s:$', ''), ' ') as definition from tlfi_words where json_valid(worddefinitionfeatures))
    select word_id, definition from e where regexp_matches(lower(definition), 'personne|individu|homme|femme|celui|celle')""")
def definitions_of_persons(spark: SparkSession, d: str) -> DataFrame:
    """All definitions of each entry, distinct within it"""
    parsed = F.from_json("worddefinitionfeatures", "array<struct<definition: string>>")
    t = table(spark, d, "tlfi_words").select("word_id", F.filter(F.transform(parsed, lambda x: x["definition"]), lambda x: x.isNotNull()).alias("defs"))
    return t.select("word_id", F.explode(T.interesting_definitions(F.col("defs"))).alias("definition"))


@query("""select word_id, trim(unnest(json_extract_string(derives, '$[*]')), ' ') as derived from tlfi_words where json_valid(derives)""")
def derived_words(spark: SparkSession, d: str) -> DataFrame:
    """D5 D15"""
    return table(spark, d, "tlfi_words").select("word_id", F.explode(F.from_json("derives", "array<string>")).alias("x")).select("word_id", F.trim("x").alias("derived"))


@query("""with h as (select word_id, completewordform as c, lower(string_split(completewordform, ',')[1]) as head, string_split(completewordform, ' ') as p from tlfi_words where completewordform is not null)
    select word_id, case when regexp_matches(head, 'vice-premier|alter ego|persona non grata') then head else regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(case when p[1] in ('un', 'une') then p[2] else p[1] end, '[.,0-9\\s]|\\([A-Za-z0-9_]+\\)', '', 'g')), '(eur)-euse$', '\\1'), 'ard-arde$', ''), 'er-ère$', ''), 'us-use$', '') end as word from h""")
def headwords(spark: SparkSession, d: str) -> DataFrame:
    """D16"""
    return table(spark, d, "tlfi_words").where("completewordform is not null").select("word_id", T.headword(F.col("completewordform")).alias("word"))


@query("""with e as (select word_id, wordform, lower(regexp_extract(parentword, '^[^\\p{L}\\p{N}_]*([\\p{L}\\p{N}\\p{M}_-]+)', 1)) as first from tlfi_words where parentword is not null)
    select word_id, first as parent_word, wordform as word from e where first in (select lower(wordform) from tlfi_words where wordform is not null)""")
def expand_one_hop(spark: SparkSession, d: str) -> DataFrame:
    """The parent word stands in for a definition's first word"""
    t = table(spark, d, "tlfi_words")
    entries = t.where("parentword is not null").select(F.struct("word_id", "wordform").alias("word"), F.col("parentword").alias("definition"))
    out = clean.expand_one_hop(t.where("wordform is not null").select(F.col("wordform").alias("word")), entries)
    return out.select("word.word_id", "parent_word", F.col("word.wordform").alias("word"))


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def scan_filter_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """F1 A1 on the largest table: filter and columns reach the scan"""
    t = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.count(F.lit(1)).alias("n"))


# The whole job beside queries whose SQL compares lang and source exactly: every spelling of a language, one key per source.
@query(ORACLE["phrase_marker_counts"].replace("lang = 'fr'", f"{_LANG} = 'fr'"))
def whole_phrase_marker_counts(spark: SparkSession, d: str) -> DataFrame:
    """T12 T13 T14"""
    return phrase_marker_counts(spark, d, _all_french)


@query(ORACLE["definition_scores"].replace("lang = 'en'", f"{_LANG} = 'en'").replace("select source as word", f"select {_SOURCE} as word").replace("source is not null", f"{_SOURCE} is not null"))
def whole_definition_scores(spark: SparkSession, d: str) -> DataFrame:
    """H2"""
    return _definition_scores(_in_language(spark, d, "en").where("source is not null"))


# The same with the whole lexicon: every noun of lexicon_entries is a human noun and a masculine generic (the table is the dictionary of
# generics), in one or more words, with the best class and subclass of its rows. The inline lists are an addition, each word once.
def _lexicon_nouns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lexicon_entries").select(lexicon.noun_key(F.col("noun")).alias("noun")).where("noun <> ''").distinct()


def _with_lexicon(words: list[str], without: tuple[str, ...] = ()) -> Callable:
    return lambda spark, d: _lexicon_nouns(spark, d).where(~F.col("noun").isin(*without)).unionByName(_words(spark, words)).distinct()


def _whole_tokens(spark: SparkSession, d: str) -> DataFrame:
    nouns = _lexicon_nouns(spark, d).withColumn("n", F.size(F.split("noun", " ")))
    inline = _lexicon(spark)
    single = nouns.where("n = 1").select(F.col("noun").alias("form"), F.col("noun").alias("lemma"), F.lit("NOUN").alias("pos")).join(inline.select("form"), "form", "left_anti")
    toks = materialize(annotate.rule_annotate(_all_french(spark, d), "text_id", "text", inline.unionByName(single)))
    return materialize(annotate.phrase_nouns(toks, nouns.where("n > 1")))


def _whole_classes(spark: SparkSession, d: str) -> DataFrame:
    best = lexicon.best_values(table(spark, d, "lexicon_entries"), table(spark, d, "lexicon_origins"), ["class", "subclass"])
    inline = spark.createDataFrame(CLASSES, "noun string, class string, subclass string")
    return lexicon.final_dictionary(best).select("noun", "class", "subclass").unionByName(inline)


WHOLE = Words(_all_french, _whole_tokens, _with_lexicon(HUMANS), _with_lexicon(GENERICS, tuple(EPICENES)), _inline(EPICENES), _with_lexicon(DETERMINED), _whole_classes)


def _key_sql(c: str) -> str:
    """The noun key of an SQL column: lower-case tokens joined by one blank."""
    plain = f"replace(regexp_replace({c}, '\\p{{Cf}}', '', 'g'), '’', '''')"
    return f"array_to_string(regexp_extract_all(lower(regexp_replace({plain}, '[\\s\\p{{Z}}]+', ' ', 'g')), '{_TOKEN_RE}'), ' ')"


def _class_sql(c: str, names: dict[str, str]) -> str:
    """The best value of a column per noun, through its table of names."""
    value = f"regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
    best = f"arg_min({value}, row(coalesce(trust_rank, 2147483647), coalesce(-epoch_us(updated_at), 9223372036854775807), entry_id)) filter (lower({value}) not in (select * from (values {_values(V.STAND_INS)})))"
    return f"coalesce((select v from (values {_values(list(names.items()))}) t(k, v) where k = best_{c}), best_{c}, '') as {c}", f"{best} as best_{c}"


_CLASS_PICKS = [_class_sql("class", V.CLASS_NAMES), _class_sql("subclass", V.SUBCLASS_NAMES)]
#: what differs in the SQL of a whole_ query, by what its inline form says
_WHOLE_SQL = {
    "french as (select coalesce(source, 'none') as dataset, doc_id as text_id, text from documents where lang = 'fr' and text is not null)": f"lexn as (select distinct {_key_sql('noun')} as noun from lexicon_entries where noun is not null), french as (select coalesce({_SOURCE}, 'none') as dataset, doc_id as text_id, text from documents where {_LANG} = 'fr' and text is not null)",
    "numbered as (select text_id, text,": "numbered as (select text_id, k, text,",
    f"lex(form, lemma, pos) as (values {_values(LEXICON)})": f"""inl(form, lemma, pos) as (values {_values(LEXICON)}),
    lex(form, lemma, pos) as (select * from inl union all select noun, noun, 'NOUN' from lexn where noun <> '' and not contains(noun, ' ') and noun not in (select form from inl)),
    phr as (select noun, len(string_split(noun, ' ')) as n, string_split(noun, ' ')[1] as w from lexn where contains(noun, ' ')),
    starts as (select distinct text_id, keyed.k, i, n from keyed join phr on low = w),
    spelt as (select s.text_id, s.i, n, string_agg(b.low, ' ' order by b.i) as noun from starts s join keyed b on b.text_id = s.text_id and b.k = s.k and b.i >= s.i and b.i < s.i + n group by 1, 2, 3),
    hits as (select text_id, i, max(n) as n, arg_max(noun, n) as noun from spelt join phr using (noun, n) group by 1, 2),
    inside as (select distinct text_id, i + unnest(range(1, n)) as i from hits)""",
    "tokens as (select text_id, i, text, coalesce": "single as (select text_id, i, text, coalesce",
    "from keyed left join lex using (form)),": "from keyed left join lex using (form)),\n    tokens as (select s.text_id, s.i, s.text, case when c.i is null then coalesce(h.noun, s.lemma) else s.lemma end as lemma, case when c.i is not null then 'X' when h.i is not null then 'NOUN' else s.pos end as pos from single s left join hits h on h.text_id = s.text_id and h.i = s.i left join inside c on c.text_id = s.text_id and c.i = s.i),",
    f"humans(noun) as (values {_values(HUMANS)})": f"humans(noun) as (select noun from lexn union values {_values(HUMANS)})",
    f"generics(noun) as (values {_values(GENERICS)})": f"generics(noun) as (select noun from lexn where noun not in ({_values(EPICENES)}) union values {_values(GENERICS)})",
    f"determined(noun) as (values {_values(DETERMINED)})": f"determined(noun) as (select noun from lexn union values {_values(DETERMINED)})",
    f"cls(noun, class, subclass) as (values {_values(CLASSES)})": f"bestcls as (select {_key_sql('noun')} as noun, {', '.join(b for _, b in _CLASS_PICKS)} from lexicon_entries left join lexicon_origins using (origin) where noun is not null group by 1), cls(noun, class, subclass) as (select noun, {', '.join(p for p, _ in _CLASS_PICKS)} from bestcls union all values {_values(CLASSES)})",
}


def _whole(sql: str) -> str:
    for inline, whole in _WHOLE_SQL.items():
        sql = sql.replace(inline, whole)
    return sql


for _f in (m_score_by_source, m_score_histogram, use_rate, masculine_generic_logs, inclusive_forms, neutral_noun_logs, marker_rates, text_records, class_counts, top_classes, specific_determiners, cell_filter):
    QUERIES[f"whole_{_f.__name__}"] = partial(_f, words=WHOLE)
    ORACLE[f"whole_{_f.__name__}"] = _whole(ORACLE[_f.__name__])
